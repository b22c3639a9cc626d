"""Text codecs as Column expressions: url-encoded rows, SQL and COPY quoting,
array text, names, natural sort keys, timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_encode(c: Column) -> Column:
    """Space becomes +, letters, digits, ``_.-`` stay, all other bytes are %xx in lower case."""
    parts = F.split(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), "%")
    lowered = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lower(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))))
    return F.when(c.rlike(r"\A[A-Za-z0-9_.-]*\z"), c).otherwise(F.array_join(lowered, "%"))


def url_row(fields: dict[str, Column]) -> Column:
    """``a=1&b&c=``: a null value has no ``=``, an empty one has."""
    name = lambda k: F.lit(k) if re.fullmatch("[A-Za-z0-9_.-]*", k) else url_encode(F.lit(k))
    parts = [F.when(v.isNull(), name(k)).otherwise(F.concat(name(k), F.lit("="), url_encode(v))) for k, v in fields.items()]
    return F.concat_ws("&", *parts)


def url_decode(c: Column) -> Column:
    """+ is a space, %xx a byte; a % that two hexadecimal digits don't follow stays."""
    coded = F.contains(c, F.lit("%")) | F.contains(c, F.lit("+"))
    return F.when(coded, F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(c)


def url_map(text: Column) -> Column:
    """A url-encoded row as a map. Segments are split before they are decoded;
    empty segments are skipped, a later duplicate of a name wins, a name
    without ``=`` is null."""
    parts = F.filter(F.split(text, "&"), lambda x: x != "")
    name = lambda x: url_decode(F.substring_index(x, "=", 1))
    value = lambda x: F.when(F.contains(x, F.lit("=")), url_decode(F.substring(x, F.instr(x, "=") + 1, F.length(x))))
    pairs = F.transform(parts, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    # Bound by a function of their own, the pairs are made once and not again for each of them.
    last = lambda made: F.filter(made, lambda p, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.get(F.transform(F.array(pairs), last), F.lit(0)))


def quote_literal(c: Column) -> Column:
    body = F.replace(c, F.lit("'"), F.lit("''"))
    escaped = F.concat(F.lit("E'"), F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(c.isNull(), "null").when(F.contains(c, F.lit("\\")), escaped).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def quote_copy(c: Column) -> Column:
    out = c
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit("\\N"))


def quote_json(c: Column) -> Column:
    """A JSON string; ``/`` is escaped, too, so that it may stand in a script."""
    named = {"\\": "\\\\", '"': '\\"', "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = c
    for a, b in (named | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in named}).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))


# Reserved words of the SQL dialect, which identifiers must quote.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column "
    "concurrently constraint create cross current_catalog current_date current_role current_schema current_time "
    "current_timestamp current_user default deferrable desc distinct do else end errors except false fetch for foreign freeze "
    "from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit "
    "localtime localtimestamp natural new not notnull null off offset old on only or order outer over overlaps placing primary "
    "references returning right select session_user similar some symmetric table then to trailing true union unique user using "
    "variadic verbose when where window with"
).split()


def quote_ident(c: Column) -> Column:
    plain = c.rlike("^[a-z_][a-z0-9_]*$") & ~c.isin(RESERVED)
    return F.when(plain, c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def unquote_ident(c: Column) -> Column:
    """The name that an identifier means: quoted as it stands, else in lower case; a stray quote is an error."""
    quoted = (F.length(c) > 1) & F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"'))
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted, inner).when(F.instr(c, '"') > 1, F.raise_error("unsupported identifier").cast("string")).otherwise(F.lower(c))


def unquote_full_name(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\.", 2), unquote_ident), ".")


def name_parts(c: Column, default: str = "public") -> Column:
    """(schema, name), split at the first dot."""
    at = F.instr(c, ".")
    rest = F.array_join(F.slice(F.split(c, r"\."), 2, F.size(F.split(c, r"\."))), ".")
    return F.struct(F.when(at > 0, F.substring_index(c, ".", 1)).otherwise(default).alias("schema"), F.when(at > 0, rest).otherwise(c).alias("name"))


def full_name(c: Column) -> Column:
    p = name_parts(c)
    return F.concat_ws(".", p["schema"], p["name"])


def quote_full_name(c: Column) -> Column:
    p = name_parts(c)
    return F.concat_ws(".", quote_ident(p["schema"]), quote_ident(p["name"]))


def pg_array(items: Column) -> Column:
    """Array text: null elements are NULL; empty ones, and those with other
    than lower-case letters, digits and a few marks, are quoted."""
    plain = lambda x: x.rlike(r"^[0-9a-z_.%&=()<>*/+-]+$")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    item = lambda x: F.when(x.isNull(), "NULL").when(plain(x), x).otherwise(quoted(x))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, item), ","), F.lit("}"))


def parse_pg_array(c: Column) -> Column:
    """The elements of one-dimensional array text, a leading ``[a,b]=`` aside;
    an unquoted NULL is null, malformed text an error, null stays null."""
    body = F.regexp_replace(c, r"^\[[^\]]*\]=", "")
    shape = r'^\{(?:(?:"(?:[^"\\]|\\.)*"|[^,"{}]+)(?:,(?:"(?:[^"\\]|\\.)*"|[^,"{}]+))*)?\}$'
    parts = F.regexp_extract_all(F.substring(body, F.lit(2), F.length(body) - 2), F.lit(r'("(?:[^"\\]|\\.)*"|[^,"]+)'), F.lit(1))
    item = lambda x: F.when(F.startswith(x, F.lit('"')), _unescaped(F.substring(x, F.lit(2), F.length(x) - 2))).when(F.upper(x) != "NULL", _unescaped(x))
    bad = F.raise_error(F.concat(F.lit("bad array: "), c)).cast("array<string>")
    return F.when(c.isNull(), F.lit(None)).when(body.rlike(shape), F.transform(parts, item)).otherwise(bad)


# Letters that a backslash gives another meaning.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}


def _unescaped(c: Column) -> Column:
    """Backslash escapes of a text: named ones, octal numbers, else the character itself."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\[0-7]{1,3}|\\.|[^\\]+|\\$)"), F.lit(1))
    names = F.create_map(*(F.lit(x) for kv in _ESCAPES.items() for x in kv))
    one = lambda x: F.when(x.rlike(r"^\\[0-7]"), F.char(F.conv(F.substring(x, 2, 3), 8, 10).cast("int")))
    rest = lambda x: F.when(F.startswith(x, F.lit("\\")) & (F.length(x) > 1), F.coalesce(F.try_element_at(names, F.substring(x, 2, 1)), F.substring(x, 2, 1))).otherwise(x)
    return F.array_join(F.transform(parts, lambda x: F.coalesce(one(x), rest(x))), "")


def unescape(c: Column) -> Column:
    return _unescaped(c)


def unescape_copy(c: Column) -> Column:
    r"""A COPY field: ``\N`` is null."""
    return F.when(c != "\\N", _unescaped(c))


def quote_bytea(c: Column) -> Column:
    r"""Bytes as text: control bytes and those from 0x7f on as ``\ooo``, a backslash doubled."""
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    octal = lambda b: F.concat(F.lit("\\"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))
    one = lambda h: F.when((byte(h) < 32) | (byte(h) >= 127), octal(byte(h))).when(h == "5C", F.lit("\\\\")).otherwise(F.char(byte(h)))
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(c), F.lit("([0-9A-F]{2})"), F.lit(1)), one), "")


def quote_bytea_literal(c: Column) -> Column:
    return quote_literal(quote_bytea(c))


def quote_bytea_copy(c: Column) -> Column:
    return quote_copy(quote_bytea(c))


def quote_statement(template: str, values: dict[str, Column]) -> Column:
    """A statement with each ``%(name)s`` replaced by the quoted value; ``%%`` is a percent sign."""
    parts = re.split(r"%\((\w+)\)s", template)
    return F.concat(*(quote_literal(values[x].cast("string")) if i % 2 else F.lit(x.replace("%%", "%")) for i, x in enumerate(parts)))


def record_list(c: Column) -> Column:
    """Array text of url-encoded records as an array of maps."""
    return F.transform(parse_pg_array(c), url_map)


def changelog(old: Column, new: Column, fields: list[str]) -> Column:
    """``name: old -> new`` of each field that differs, in lines; nulls are empty."""
    text = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    lines = [F.when(text(old, k) != text(new, k), F.concat(F.lit(f"{k}: "), text(old, k), F.lit(" -> "), text(new, k))) for k in fields]
    return F.concat_ws("\n", *lines)


def connect_pairs(c: Column) -> Column:
    """``key=value key2='quoted \\' value'`` as a map."""
    parts = F.regexp_extract_all(c, F.lit(r"(\w+\s*=\s*(?:'(?:[^'\\]|\\.)*'|[^\s']\S*|))"), F.lit(1))
    value = lambda x: F.regexp_replace(x, r"^\w+\s*=\s*", "")
    plain = lambda v: F.when(F.startswith(v, F.lit("'")), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), plain(value(x)).alias("v"))))


def acl_parts(c: Column) -> Column:
    """``who=rights/owner`` as a struct; an empty who is public; null where it is none of that."""
    shape = r'^("(?:[^"]|"")*"|[^"=]*)=(\w*[*\w]*)/(.+)$'
    who = F.regexp_extract(c, shape, 1)
    return F.when(c.rlike(shape), F.struct(F.when(who == "", "public").otherwise(unquote_ident(who)).alias("who"), F.regexp_extract(c, shape, 2).alias("rights"), unquote_ident(F.regexp_extract(c, shape, 3)).alias("owner")))


def natural_key(c: Column, fold: bool = False) -> Column:
    """An array that sorts texts with runs of digits by their value, whatever
    their length, and digits before all else: the number of significant digits
    comes before them."""
    c = F.lower(c) if fold else c
    value = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    item = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.lpad(F.length(value(x)).cast("string"), 10, "0"), value(x))).otherwise(F.concat(F.lit("\x02"), x))
    return F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), item)


def iso_timestamp(c: Column) -> Column:
    """``YYYY-MM-DD[ T]HH:MM[:SS[.,frac]][zone]``; null where it is none of that."""
    shape = r"^(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d)(:\d\d)?([.,]\d+)?\s*(Z|[+-]\d\d(?::?\d\d)?)?$"
    got = [F.regexp_extract(c, shape, i) for i in range(1, 6)]
    seconds = F.when(got[2] == "", ":00").otherwise(got[2])
    zone = F.when(got[4].rlike(r"^[+-]\d\d$"), F.concat(got[4], F.lit(":00"))).when(got[4].rlike(r"^[+-]\d{4}$"), F.concat(F.substring(got[4], 1, 3), F.lit(":"), F.substring(got[4], 4, 2))).otherwise(got[4])
    return F.when(c.rlike(shape), F.try_to_timestamp(F.concat(got[0], F.lit(" "), got[1], seconds, F.translate(got[3], ",", "."), zone)))


def valid_utf8(data: Column) -> Column:
    """Text of bytes: broken sequences and NUL become the replacement character."""
    return F.translate(F.make_valid_utf8(data), "\u0000", "\ufffd")


def size_bytes(c: Column) -> Column:
    """``10 MB``-like sizes in bytes; units are powers of 1024; null where it is none."""
    shape = r"^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?)(?:I?B)?\s*$"
    unit = F.regexp_extract(F.upper(c), shape, 2)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(F.upper(c).rlike(shape), (F.regexp_extract(F.upper(c), shape, 1).try_cast("double") * F.pow(F.lit(1024), power)).cast("long"))
