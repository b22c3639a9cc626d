"""SQL text: tokens, statements, partial SQL of change events, optional fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<space>\s+) | (?P<comment>--[^\n]*|/\*.*?\*/) | (?P<string>[eE]?'(?:[^'\\]|''|\\.)*') | (?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
      | (?P<name>"(?:[^"]|"")*"|[A-Za-z_][\w$]*) | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?) | (?P<sym>::|<=|>=|<>|!=|\|\||.)""",
    re.X | re.S,
)


def tokens(sql: str, blanks: bool = False) -> Iterator[tuple[str, str]]:
    """(kind, text) of each token; white space and comments only with blanks."""
    for m in _TOKEN.finditer(sql):
        kind = "string" if m.lastgroup == "tag" or m.group("dollar") else m.lastgroup or "sym"
        if blanks or kind not in ("space", "comment"):
            yield kind, m.group(0)


def statements(sql: str) -> list[str]:
    """Statements that end in ``;`` outside of quotes and parentheses, in order."""
    out, now, depth = [], [], 0
    for kind, text in tokens(sql, blanks=True):
        depth += (text == "(") - (text == ")") if kind == "sym" else 0
        now.append(text)
        if text == ";" and kind == "sym" and depth <= 0:
            out.append("".join(now).strip())
            now = []
    rest = "".join(now).strip()
    return [s for s in [*out, rest] if s and s != ";"]


def unquote(text: str) -> str | None:
    """The value of a SQL literal: quoted, E-quoted, dollar-quoted, or null."""
    if text.lower() == "null":
        return None
    if m := re.fullmatch(r"\$(\w*)\$(.*)\$\1\$", text, re.S):
        return m[2]
    if text[:1] in "eE" and text[1:2] == "'":
        plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        body = text[2:-1].replace("''", "'")
        return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else plain.get(m[1], m[1]), body, flags=re.S)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    return text


def partial_sql(op: str, text: str) -> dict[str, str | None]:
    """The columns of a partial statement: ``(a,b) values (..)`` for I,
    ``c=v,.. where k=v and ..`` for U, ``k=v and ..`` for D."""
    t = list(tokens(text))
    name = lambda x: x[1:-1].replace('""', '"') if x[:1] == '"' else x
    if op == "I":
        at = next(i for i, (k, x) in enumerate(t) if k == "name" and x.lower() == "values")
        names = [name(x) for k, x in t[1 : at - 1] if k == "name"]
        values = [unquote(x) for _, x in t[at + 2 : -1] if x != ","]
        if len(names) != len(values):
            raise ValueError(f"{len(names)} names and {len(values)} values")
        return dict(zip(names, values, strict=True))
    if op not in ("U", "D"):
        raise ValueError(f"unknown operation: {op}")
    out: dict[str, str | None] = {}
    for i in range(1, len(t) - 1):
        if t[i][1] == "=" and t[i - 1][0] == "name":
            out.setdefault(name(t[i - 1][1]), unquote(t[i + 1][1]))
    return out


def statements_of(c: Column) -> Column:
    """An array of a script's statements."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else statements(x))

    return run(c)


def partial_sql_map(op: Column, text: Column) -> Column:
    @F.pandas_udf("map<string,string>")
    def run(o: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else partial_sql(a, b) for a, b in zip(o, s, strict=True)])

    return run(op, text)


def build_query(parts: list[tuple[str, bool]], params: dict) -> tuple[str, dict]:
    """(SQL with :names, the parameters it has) of fragments (text, required).

    A fragment names parameters as ``{name}``; one that lacks a parameter is
    left out, or is an error if required.
    """
    out, used = [], {}
    for text, required in parts:
        names = re.findall(r"\{(\w+)\}", text)
        lacking = [n for n in names if n not in params]
        if lacking and required:
            raise KeyError(lacking[0])
        if not lacking:
            out.append(re.sub(r"\{(\w+)\}", r":\1", text))
            used.update((n, params[n]) for n in names)
    return " ".join(out), used
