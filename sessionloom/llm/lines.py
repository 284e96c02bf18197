"""Line dedup by how many pages of a site carry a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

#: A line on more than this share of a site's pages, and on this many pages at least, is boilerplate.
RATIO, LEAST_PAGES = 0.075, 4
#: White space that lines are compared without at their ends.
EDGES = " \t\r\x0b\x0c"
#: The host in a URL. What isn't a URL is a site's name itself.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: Up to so many boilerplate lines the list is broadcast; beyond, pages go to their site's list, each site's in SALTS parts.
MOST_BROADCAST, SALTS = 200_000, 64
_KEY = "struct<a:bigint,b:bigint>"


def _key(line):
    """Two hashes, 128 bits together."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: str):
    return F.split(F.col(text), "\n", -1)


def _trimmed(line):
    return F.btrim(line, F.lit(EDGES))


def site_of(host: str):
    """The host of a URL in small letters; other values as they are."""
    found = F.regexp_extract(F.col(host), HOST, 1)
    return F.when(found != "", F.lower(found)).otherwise(F.col(host))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, line keys: the lines of each site that stand on more than `ratio` of its pages and on at least `least_pages`.

    Pages of a site with the same text count as one, so that copies don't make a page's own lines boilerplate. A page counts once however
    often it repeats the line; lines are compared without white space at their ends, and blank ones never count. Counts are made before
    the shuffle, so a site or a line that has a third of all rows is a few partial counts. A site can have at most
    (mean lines a page) / ratio such lines.
    """
    lines = F.array_distinct(F.filter(F.transform(_lines(text), _trimmed), lambda x: x != ""))
    page = F.xxhash64(text).alias("page")
    each = docs.select(site_of(host).alias("host"), page, F.explode(F.transform(lines, _key)).alias("key"))
    pages = docs.select(site_of(host).alias("site"), page).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    found = each.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    over = found.join(pages, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.col("pages") * ratio)
    return over.groupBy("host").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False) -> DataFrame:
    """docs with the site's boilerplate lines cut out of `text`; all other columns and all rows stay.

    The rest of the lines keep their order and bytes. A null host is a site of its own. A null text stays null; a text of boilerplate
    alone becomes empty. Repeated rows are one page and are cut alike; an empty table gives no rows. counts adds n_lines and n_dropped
    (0 for null texts). The lists of boilerplate are broadcast up to MOST_BROADCAST lines in all. Beyond that the pages are shuffled to
    them by site and salt, so that a site with a third of all pages is SALTS parts.
    """
    site, keys, salt = fresh(docs, "ld_site", "ld_keys", "ld_salt")
    bad = materialize(boilerplate(docs, host, text, ratio, least_pages), "lines").select(F.col("host").alias(site), F.col("keys").alias(keys))
    same = site_of(host).eqNullSafe(F.col(site))
    if (bad.agg(F.sum(F.size(keys)).alias("n")).first()["n"] or 0) <= MOST_BROADCAST:
        joined = docs.join(F.broadcast(bad), same, "left")
    else:
        parts = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(parts.hint("merge"), same & (F.pmod(F.xxhash64(docs[text]), F.lit(SALTS)) == F.col(salt)), "left")
    keep = F.filter(_lines(text), lambda x: ~F.array_contains(F.coalesce(F.col(keys), F.array().cast(f"array<{_KEY}>")), _key(_trimmed(x))))
    left = F.when(F.col(keys).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    out = [left.alias(c) if c == text else docs[c] for c in docs.columns]
    if counts:
        n = F.coalesce(F.size(_lines(text)), F.lit(0))
        n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
        out += [F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias(n_lines), F.when(F.col(text).isNull() | F.col(keys).isNull(), 0).otherwise(n - F.size(keep)).cast("long").alias(n_dropped)]
    return joined.select(*out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of all documents, with their source as the site (its host where it is a URL). Null texts stay null, a null source is a site,
    repeated rows are one page, an empty table gives no rows, other columns aren't read."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


_TRIM = "trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls,
    CASE WHEN regexp_extract(source, '{HOST}', 1) <> '' THEN lower(regexp_extract(source, '{HOST}', 1)) ELSE source END AS site
  FROM documents),
pages AS (SELECT site, count(*) AS pages FROM (SELECT DISTINCT site, text FROM d) GROUP BY site),
each AS (SELECT DISTINCT site, text, {_TRIM.format("l")} AS line FROM (SELECT site, text, unnest(ls) AS l FROM d)),
bad AS (
  SELECT e.site, e.line FROM each e JOIN pages p ON e.site IS NOT DISTINCT FROM p.site
  WHERE e.line <> '' GROUP BY e.site, e.line, p.pages HAVING count(*) >= {LEAST_PAGES} AND count(*) > p.pages * CAST({RATIO} AS DOUBLE)),
lines AS (SELECT doc_id, site, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM d),
marked AS (
  SELECT n.doc_id, n.i, n.l, b.line IS NOT NULL AS bad FROM lines n
  LEFT JOIN bad b ON n.site IS NOT DISTINCT FROM b.site AND {_TRIM.format("n.l")} = b.line),
back AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '') AS text, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, b.text, coalesce(b.n_lines, 0) AS n_lines, coalesce(b.n_dropped, 0) AS n_dropped FROM d LEFT JOIN back b ON d.doc_id = b.doc_id
"""
