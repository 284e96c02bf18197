"""Shell lines as columns: the commands of a line with their words, redirects and connectors, and what stands behind wrappers. Nothing is run or expanded."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Binaries that run the command behind them, and their options that take a word.
WRAPPERS = {
    "env": ("-u", "--unset", "-S", "--split-string"), "nice": ("-n", "--adjustment"), "timeout": ("--signal", "-s", "-k", "--kill-after"), "stdbuf": (), "nohup": (), "command": (),
    "sudo": ("-u", "--user", "-g", "--group", "-C", "-D", "-R", "--role", "-t", "--type"), "exec": (),
    "doas": ("-u", "-C"), "time": ("-f", "-o"), "ionice": ("-c", "--class", "-n", "--classdata", "-p", "--pid"), "setsid": (), "xargs": ("-I", "-n", "-P", "-L", "-d", "-s"),
}
ELEVATING = ("sudo", "doas")
MOST_WRAPPERS = 5
#: Words that stand where a command could and aren't one.
_KEYWORDS = {"if", "then", "elif", "else", "fi", "while", "until", "do", "done", "esac", "!", "{", "}"}
_HEADERS = {"for", "select", "case"}
_OPERATOR = re.compile(r"\|\||&&|;;&|;;|;&|\|&|\||;|&(?!>)|\n")
_REDIRECT = re.compile(r"(?:\d+|\{\w+\})?(&>>|&>|<<<|<<-|<<|<>|<&|>&|>>|>\||>|<(?!\()|>(?!\())")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*\+?=")
_DURATION = re.compile(r"(?:\d+(?:\.\d+)?[smhd]?|infinity)$")
_NUMBER = re.compile(r"-?\d+$")
_EXTENSION = re.compile(r"\.(?:exe|cmd|bat|com)$", re.IGNORECASE)

_S = T.StringType()
_COMMANDS = T.ArrayType(T.StructType([
    T.StructField("binary", _S), T.StructField("subcommand", _S), T.StructField("words", T.ArrayType(_S)), T.StructField("flags", T.ArrayType(_S)), T.StructField("elevated", T.BooleanType()), T.StructField("connector", _S),
    T.StructField("redirects", T.ArrayType(T.StructType([T.StructField("op", _S), T.StructField("target", _S)]))), T.StructField("inside", _S),
]))


def _closing(line: str, at: int) -> int:
    """The place behind the parenthesis that closes the one before `at`; quotes and substitutions inside count as such."""
    depth = 1
    while at < len(line) and depth:
        c = line[at]
        if c == "\\":
            at += 1
        elif c == "'":
            at = line.find("'", at + 1) if "'" in line[at + 1 :] else len(line)
        elif c == '"':
            at = _quoted(line, at + 1)[1] - 1
        depth += (c == "(") - (c == ")")
        at += 1
    return at


def _quoted(line: str, at: int) -> tuple[str, int]:
    """The text in double quotes that begins at `at`, and the place behind them. Substitutions stay as they are written."""
    out = []
    while at < len(line) and line[at] != '"':
        if line[at] == "\\" and at + 1 < len(line):
            out.append(line[at + 1] if line[at + 1] in '"\\$`\n' else line[at : at + 2])
            at += 2
        elif line.startswith("$(", at):
            end = _closing(line, at + 2)
            out.append(line[at:end])
            at = end
        else:
            out.append(line[at])
            at += 1
    return "".join(out), at + 1


class _Line:
    """One pass over a line. `open` holds what is still to be closed, the innermost last: "(" for subshells, "{" and a function's name for bodies,
    "case" for branches; pattern tells that a branch's pattern is read."""

    def __init__(self, line: str):
        self.line, self.at, self.commands, self.open, self.documents = line, 0, [], [], []
        self.words: list[str] = []
        self.redirects: list[tuple[str, str]] = []
        self.pending, self.header, self.name, self.pattern = "", False, "", False
        self.run()

    def inside(self) -> str:
        return next((name for _, name in reversed(self.open) if name), "")

    def end(self, connector: str) -> None:
        """A command ends here; where none stands, a connector belongs to the one before if that has none yet."""
        if self.words or self.redirects:
            self.commands.append((self.words, connector, self.redirects, self.inside()))
        elif connector and self.commands and not self.commands[-1][1]:
            self.commands[-1] = (self.commands[-1][0], connector, *self.commands[-1][2:])
        self.words, self.redirects, self.pending, self.header = [], [], "", False

    def close(self, kind: str) -> None:
        """Closes the innermost of a kind, and what is open inside it; nothing where none is open."""
        if any(k == kind for k, _ in self.open):
            while self.open.pop()[0] != kind:
                pass

    def skip_documents(self) -> None:
        """Here-documents' bodies, which begin behind a line's end, are no commands."""
        for mark, tabs in self.documents:
            while self.at < len(self.line):
                stop = self.line.find("\n", self.at)
                stop = len(self.line) if stop < 0 else stop
                row = self.line[self.at : stop]
                self.at = stop + 1
                if (row.lstrip("\t") if tabs else row) == mark:
                    break
        self.documents = []

    def word(self) -> tuple[str, bool]:
        """The next word without its quotes, and whether it had any."""
        out, bare, line = [], True, self.line
        while self.at < len(line):
            c = line[self.at]
            if c in " \t\n;|&()" and not (c == "(" and out and out[-1] in ("$", "?", "*", "+", "@")):
                break
            if c in "<>":
                if not line.startswith("(", self.at + 1):
                    break
                self.at += 2
                self.nested()
                out.append("/dev/fd")
            elif c == "'":
                stop = line.find("'", self.at + 1)
                stop = len(line) if stop < 0 else stop
                out.append(line[self.at + 1 : stop])
                self.at, bare = stop + 1, False
            elif c == '"':
                text, self.at = _quoted(line, self.at + 1)
                out.append(text)
                bare = False
            elif c == "\\":
                if not line.startswith("\n", self.at + 1):
                    out.append(line[self.at + 1 : self.at + 2])
                    bare = False
                self.at += 2
            elif c == "`":
                stop = line.find("`", self.at + 1)
                stop = len(line) if stop < 0 else stop
                out.append(line[self.at : stop + 1])
                self.at, bare = stop + 1, False
            elif line.startswith("$(", self.at):
                stop = _closing(line, self.at + 2)
                out.append(line[self.at : stop])
                self.at, bare = stop, False
            elif line.startswith("${", self.at):
                stop = line.find("}", self.at)
                stop = len(line) - 1 if stop < 0 else stop
                out.append(line[self.at : stop + 1])
                self.at, bare = stop + 1, False
            else:
                out.append(c)
                self.at += 1
        return "".join(out), bare

    def nested(self) -> None:
        """A process substitution: its commands are the line's too, beside the one that it is a word of."""
        stop = _closing(self.line, self.at)
        inner = _Line(self.line[self.at : stop - 1])
        self.commands += [(w, "", r, self.inside()) if k == len(inner.commands) - 1 else (w, c, r, self.inside()) for k, (w, c, r, _) in enumerate(inner.commands)]
        self.at = stop

    def run(self) -> None:
        line = self.line
        while self.at < len(line):
            c = line[self.at]
            if c in " \t\r":
                self.at += 1
            elif line.startswith("\\\n", self.at):
                self.at += 2
            elif c == "#":
                stop = line.find("\n", self.at)
                self.at = len(line) if stop < 0 else stop
            elif not self.pending and (m := _REDIRECT.match(line, self.at)):
                self.pending, self.at = m[1], m.end()
            elif self.pattern and c in "(|\n":
                self.at += 1
            elif self.pattern and c == ")":
                self.at, self.pattern = self.at + 1, False
            elif m := _OPERATOR.match(line, self.at):
                self.pattern = m[0].startswith(";") and len(m[0]) > 1 and any(kind == "case" for kind, _ in self.open)
                self.end(";" if m[0] == "\n" or m[0].startswith(";") else m[0])
                self.at = m.end()
                if m[0] == "\n":
                    self.skip_documents()
            elif c == "(":
                self.at += 1
                if len(self.words) == 1 and (m := re.compile(r"\s*\)\s*").match(line, self.at)):  # a function's name
                    self.name, self.words, self.at = self.words[0], [], m.end()
                elif not self.words:
                    self.open.append(("(", ""))
            elif c == ")":
                self.at += 1
                self.end("")
                self.close("(")
            else:
                self.take(*self.word())
        self.end("")

    def take(self, word: str, bare: bool) -> None:
        if self.pending:
            if self.pending in ("<<", "<<-"):
                self.documents.append((word, self.pending == "<<-"))
            else:
                self.redirects.append((self.pending, word))
            self.pending = ""
        elif self.pattern:
            if bare and word == "esac":
                self.pattern = False
                self.close("case")
        elif self.header:
            if word == "in" and self.open and self.open[-1][0] == "case":
                self.header, self.pattern = False, True
        elif not self.words and bare and word in _HEADERS:
            self.header = True
            if word == "case":
                self.open.append(("case", ""))
        elif not self.words and bare and word == "function":
            self.name, _ = self._next_name()
        elif not self.words and bare and word in _KEYWORDS:
            if word == "{":
                self.open.append(("{", self.name))
                self.name = ""
            elif word == "}":
                self.close("{")
            elif word == "esac":
                self.close("case")
        else:
            self.words.append(word)

    def _next_name(self) -> tuple[str, bool]:
        while self.at < len(self.line) and self.line[self.at] in " \t":
            self.at += 1
        found = self.word()
        if m := re.compile(r"\s*\(\s*\)\s*").match(self.line, self.at):
            self.at = m.end()
        return found


def _name(word: str) -> str:
    return _EXTENSION.sub("", re.split(r"[/\\]", word)[-1].lower())


def _unwrapped(words: list[str]) -> tuple[int, bool]:
    """The place of the word that names the binary, behind assignments and wrappers, and whether one of these elevates."""
    at, elevated = 0, False
    for _ in range(MOST_WRAPPERS + 1):
        while at < len(words) and _ASSIGNMENT.match(words[at]):
            at += 1
        name = _name(words[at]) if at < len(words) else ""
        if name not in WRAPPERS or _ == MOST_WRAPPERS:
            break
        elevated |= name in ELEVATING
        at += 1
        while at < len(words) and words[at].startswith("-"):
            option = words[at]
            at += 1
            # a word that an option takes: as it is known to, or as it can only be a number
            takes = option in WRAPPERS[name] or (at < len(words) and "=" not in option and _NUMBER.match(words[at]) and name != "timeout")
            if takes and at < len(words) and not words[at].startswith("-"):
                at += 1
        if name == "timeout" and at < len(words) and _DURATION.match(words[at]):
            at += 1
    return at, elevated


def commands_in(line: str | None) -> list[dict]:
    """The commands of a line, in order. Substitutions $( ) and ` ` stay words; here-documents are skipped; bodies of loops and functions count."""
    out = []
    for words, connector, redirects, inside in _Line(line or "").commands:
        at, elevated = _unwrapped(words)
        rest = words[at + 1 :]
        out.append({
            "binary": _name(words[at]) if at < len(words) else "", "subcommand": rest[0] if rest and not rest[0].startswith("-") else None, "words": words[at:], "flags": [w for w in rest if w.startswith("-")],
            "elevated": elevated, "connector": connector, "redirects": [{"op": o, "target": t} for o, t in redirects], "inside": inside,
        })
    return out


@pandas_udf(_COMMANDS)
def parsed(lines: pd.Series) -> pd.Series:
    """The commands of each line; null and blank lines have none. A line that comes often in a batch is read once."""
    seen = {x: commands_in(x if isinstance(x, str) else "") for x in lines.unique()}
    return lines.map(seen)


def with_commands(rows: DataFrame, command: str = "command", to: str = "commands") -> DataFrame:
    """Adds the parsed commands of a line, for all that asks about them: the line is read once."""
    return rows.withColumn(to, parsed(F.col(command)))


def binaries(commands: Column) -> Column:
    """The name of the binary of each parsed command, without its folder."""
    return F.filter(F.transform(commands, lambda c: c["binary"]), lambda b: b != "")


def short_flags(flags: Column) -> Column:
    """flags, and the single letters of joined short ones."""
    each = lambda f: F.when(f.rlike("^-[A-Za-z]{2,3}$"), F.concat(F.array(f), F.transform(F.split(F.substr(f, F.lit(2)), ""), lambda c: F.concat(F.lit("-"), c)))).otherwise(F.array(f))
    return F.array_distinct(F.flatten(F.transform(flags, each)))
