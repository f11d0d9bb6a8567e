"""Text functions.  The empty sequence counts as '' where the language says so."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(_s(c), r"[ \t\r\n]+", " "))


def string_length(c: Column) -> Column:
    return F.length(_s(c)).cast("long")


def substring(c: Column, start: Column | float, length: Column | float | None = None) -> Column:
    """Characters at positions p with round(start) <= p < round(start) + round(length), from 1; bounds may lie outside."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    begin = F.floor(lit(start) + 0.5)
    first = F.greatest(begin, F.lit(1))
    if length is None:
        return F.substring(_s(c), first.cast("int"), F.length(_s(c)))
    end = begin + F.floor(lit(length) + 0.5)
    return F.when(end > first, F.substring(_s(c), first.cast("int"), (end - first).cast("int"))).otherwise("")


def substring_before(c: Column, mark: str) -> Column:
    """What stands before the mark; '' if it does not occur."""
    return F.when(F.instr(_s(c), mark) > 0, F.substring_index(_s(c), mark, 1)).otherwise("") if mark else F.lit("")


def substring_after(c: Column, mark: str) -> Column:
    s = _s(c)
    at = F.instr(s, mark)
    return F.when(at > 0, F.substring(s, at + len(mark), F.length(s))).otherwise("") if mark else s


def translate(c: Column, old: str, new: str) -> Column:
    return F.translate(_s(c), old, new)


def contains(c: Column, part: str) -> Column:
    return _s(c).contains(part)


def starts_with(c: Column, part: str) -> Column:
    return _s(c).startswith(part)


def ends_with(c: Column, part: str) -> Column:
    return _s(c).endswith(part)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points; empty if either is."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def java_pattern(pattern: str, flags: str = "") -> str:
    """The pattern with the language's flags i, s, m, x and q."""
    if "q" in flags:
        pattern = re.escape(pattern)
    elif "x" in flags:
        pattern = re.sub(r"(\[(?:\\.|[^\]\\])*\])|\s+", lambda m: m[1] or "", pattern)
    inline = "".join(f for f in "ism" if f in flags and not (f != "i" and "q" in flags))
    return f"(?{inline}){pattern}" if inline else pattern


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return _s(c).rlike(java_pattern(pattern, flags))


def replace(c: Column, pattern: str, new: str, flags: str = "") -> Column:
    """With flag q the replacement is literal; otherwise $n stands for groups."""
    return F.regexp_replace(_s(c), java_pattern(pattern, flags), new.replace("\\", "\\\\").replace("$", "\\$") if "q" in flags else new)


def tokenize(c: Column, pattern: str | None = None, flags: str = "") -> Column:
    """Tokens as an array; without a pattern, split at white space after trimming.  '' and the empty sequence have none."""
    if pattern is None:
        s = normalize_space(c)
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))
    return F.when(_s(c) == "", F.array().cast("array<string>")).otherwise(F.split(_s(c), java_pattern(pattern, flags), -1))


def token_count(c: Column, pattern: str | None = None, flags: str = "") -> Column:
    """count(tokenize(..)) without making the tokens.  A pattern that matches nothing at all is no separator, so it is refused."""
    if pattern is None:
        return F.regexp_count(_s(c), F.lit(r"[^ \t\n\r]+")).cast("long")
    if "q" not in flags and re.compile(pattern).fullmatch(""):
        raise ValueError("a separator that matches the empty text")
    plain = len(pattern) == 1 and pattern not in "\\.^$*+?{}[]|()" and not flags
    cuts = F.length(_s(c)) - F.length(F.replace(_s(c), F.lit(pattern), F.lit(""))) if plain else F.regexp_count(_s(c), F.lit(java_pattern(pattern, flags)))
    return F.when(_s(c) == "", 0).otherwise(cuts + 1).cast("long")


def analyze_string(c: Column, pattern: str, flags: str = "") -> Column:
    """Parts in order as an array of (matched, text, groups): the matching and the other parts of the text.

    groups holds what each group of a match caught."""
    p = java_pattern(pattern, flags)
    n = re.compile(re.sub(r"\(\?[ism]+\)", "", p)).groups
    found, rest = F.regexp_extract_all(_s(c), F.lit(p), F.lit(0)), F.split(_s(c), p, -1)
    groups = [F.regexp_extract_all(_s(c), F.lit(p), F.lit(i)) for i in range(1, n + 1)]
    no_groups = F.array().cast("array<string>")
    pair = F.transform(
        F.sequence(F.lit(0), F.size(rest) - 1),
        lambda i: F.array(
            F.struct(F.lit(False).alias("matched"), F.get(rest, i).alias("text"), no_groups.alias("groups")),
            F.struct(F.lit(True).alias("matched"), F.get(found, i).alias("text"), (F.array(*(F.get(g, i) for g in groups)) if groups else no_groups).alias("groups")),
        ),
    )
    return F.filter(F.flatten(pair), lambda x: F.coalesce(F.length(x["text"]) > 0, F.lit(False)))


def to_codepoints(c: Column) -> Column:
    return F.when(_s(c) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(_s(c), ""), lambda x: F.ascii(x)))


@F.pandas_udf(T.StringType())
def from_codepoints(points: pd.Series) -> pd.Series:
    """Code points to text.  Spark's chr() is taken modulo 256, so Arrow batches do it."""
    return points.map(lambda p: None if p is None else "".join(map(chr, p)))


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """A normal form of Unicode; form '' leaves the text."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "" if t is None else unicodedata.normalize(form, t) if form else t)

    return run(c)


def encode_for_uri(c: Column) -> Column:
    """Everything but letters, digits and -_.~ as %XX."""
    out = F.url_encode(_s(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iri_to_uri(c: Column) -> Column:
    """Only what no URI may hold as %XX."""
    kept = "".join(f"{x}" for x in "!#$%&'()*+,-./:;=?@[]_~")
    out = encode_for_uri(c)
    for x in kept:
        code = f"%{ord(x):02X}"
        if x != "%" and x not in "-_.~":
            out = F.replace(out, F.lit(code), F.lit(x))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def escape_html_uri(c: Column) -> Column:
    """Only characters outside printable ASCII as %XX."""
    parts = F.transform(F.split(_s(c), ""), lambda x: F.when((F.ascii(x) < 32) | (F.ascii(x) > 126), F.url_encode(x)).otherwise(x))
    return F.array_join(parts, "")


def resolve_uri(relative: Column, base: Column) -> Column:
    """A relative reference against an absolute base, for references without dot segments."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(relative.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative).when(relative.startswith("/"), F.concat(root, relative)).when(relative == "", base).otherwise(F.concat(folder, relative))


def character_map(c: Column, mapping: dict[str, str]) -> Column:
    """Characters replaced by strings at serialization, all at once."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.array_join(F.transform(F.split(_s(c), ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
