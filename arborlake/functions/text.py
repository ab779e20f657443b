"""Column expressions for paths, ids and names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot, lower-cased; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob(name: Column, *patterns: str) -> Column:
    """Whether the name fits one of the shell patterns."""
    return reduce(or_, [_glob(name, p) for p in patterns], F.lit(False))


def _glob(name: Column, pattern: str) -> Column:
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in pattern)
    return name.rlike(f"(?s)^{out}$")


def is_uuid4(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID4), F.lit(False))


def as_uuid(*parts: Column) -> Column:
    """An id in the form of a UUID4 that is the same for the same parts."""
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-4"), h.substr(14, 3), F.lit("-a"), h.substr(18, 3), F.lit("-"), h.substr(21, 12))


def to_hex(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("0x"), F.lower(F.hex(n))))


def from_hex(s: Column) -> Column:
    """The positive number, or null where the form is wrong."""
    n = F.when(s.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(s, 3, 15), 16, 10).cast("long"))
    return F.when(n > 0, n)


def escape_token(t: Column) -> Column:
    """JSON Pointer: ~ before /."""
    return F.replace(F.replace(t, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def build_pointer(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("/"), escape_token(t))), "")


def pointer_order(p: Column) -> Column:
    """A key that sorts pointers like the arrays of their tokens, parents first, and is no longer than they are."""
    low = F.replace(F.replace(p, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(low, F.lit("/"), F.lit("\x00"))


def parse_pointer(p: Column) -> Column:
    """The tokens; null where a pointer that is not empty doesn't start with /."""
    return F.when(p == "", F.array().cast("array<string>")).when(p.startswith("/"), F.transform(F.split(F.substring(p, 2, 1 << 30), "/"), unescape_token))


def key_path_pointer(path: Column) -> Column:
    """`a.b[0].c` as a pointer."""
    return build_pointer(F.split(F.regexp_replace(path, r"\[(\d+)\]", ".$1"), r"\."))
