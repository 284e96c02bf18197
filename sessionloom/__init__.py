"""Analytics over the session logs of coding agents, on Spark."""
