"""Numbers: arithmetic that is not SQL's, number formats, numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.atomize import round_half_even, round_half_up

ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}

INTEGERS = ("tinyint", "smallint", "int", "bigint")
MATH = {"pi": lambda: F.lit(3.141592653589793), "exp": F.exp, "exp10": lambda c: F.pow(F.lit(10.0), c), "log": F.ln, "log10": F.log10, "pow": F.pow, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2}
ROUND = {"round": round_half_up, "round-half-to-even": round_half_even, "floor": F.floor, "ceiling": F.ceil, "abs": F.abs}


def integer_divide(a: Column, b: Column) -> Column:
    """idiv: the quotient towards zero, exact for integers of any size; other numbers divide as doubles."""
    whole = F.typeof(a).isin(*INTEGERS) & F.typeof(b).isin(*INTEGERS)
    q = a / b
    return F.when(whole, F.call_function("div", a.try_cast("long"), b.try_cast("long"))).otherwise(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).try_cast("long"))


def modulo(a: Column, b: Column) -> Column:
    """mod: the sign follows the dividend."""
    return a % b


def format_number(c: Column, picture: str, decimal: str = ".", grouping: str = ",", nan: str = "NaN", infinity: str = "Infinity") -> Column:
    """A number by a picture such as #,##0.00; ties go to even."""
    plain = picture.replace(grouping, "\u0001").replace(decimal, ".").replace("\u0001", ",")
    out = F.call_function("format_number", F.abs(c), F.lit(plain))
    if (decimal, grouping) != (".", ","):
        out = F.translate(out, ".,", decimal + grouping)
    out = F.when(F.isnan(c), nan).when(F.abs(c) == float("inf"), infinity).otherwise(out)
    return F.when((c < 0) & ~F.isnan(c), F.concat(F.lit("-"), out)).otherwise(out)


def roman(c: Column, upper: bool = False) -> Column:
    """Roman numerals for 1 to 3999; other numbers in digits."""
    out, rest = F.lit(""), c.cast("int")
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), (rest / value).cast("int")))
        rest = rest % value
    out = F.when((c >= 1) & (c < 4000), out).otherwise(c.cast("string"))
    return F.upper(out) if upper else out


def alphabetic(c: Column, upper: bool = False) -> Column:
    """a, b, .. z, aa, ab, ..; 0 and below in digits."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    n = c.cast("long")
    step = lambda s: F.struct(F.concat(F.substr(letters, ((s["n"] - 1) % 26 + 1).cast("int"), F.lit(1)), s["text"]).alias("text"), F.floor((s["n"] - 1) / 26).cast("long").alias("n"))
    start = F.struct(F.lit("").alias("text"), n.alias("n"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda s, _: F.when(s["n"] > 0, step(s)).otherwise(s), lambda s: s["text"])
    out = F.when(n > 0, out).otherwise(n.cast("string"))
    return F.upper(out) if upper else out


def words(c: Column) -> Column:
    """English words for 0 to 999,999."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))

    def below_hundred(n: Column) -> Column:
        low = F.when(n % 10 > 0, F.concat(F.lit("-"), F.get(ones, (n % 10).cast("int")))).otherwise("")
        return F.when(n < 20, F.get(ones, n.cast("int"))).otherwise(F.concat(F.get(tens, F.floor(n / 10).cast("int")), low))

    def below_thousand(n: Column) -> Column:
        rest = F.when(n % 100 > 0, F.concat(F.lit(" and "), below_hundred(n % 100))).otherwise("")
        return F.when(n < 100, below_hundred(n)).otherwise(F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred"), rest))

    n = c.cast("long")
    rest = F.when(n % 1000 >= 100, F.concat(F.lit(" "), below_thousand(n % 1000))).when(n % 1000 > 0, F.concat(F.lit(" and "), below_thousand(n % 1000))).otherwise("")
    big = F.concat(below_thousand(F.floor(n / 1000)), F.lit(" thousand"), rest)
    return F.when((n >= 0) & (n < 1000), below_thousand(n)).when((n >= 0) & (n < 1_000_000), big).otherwise(n.cast("string"))


def ordinal_suffix(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, .. 11th."""
    n = F.abs(c.cast("long"))
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), end)


def numeral(c: Column, token: str, ordinal: bool = False, grouping_separator: str = "", grouping_size: int = 3) -> Column:
    """A number by a format token: 1, 01, a, A, i, I, w, W, Ww."""
    if token in ("i", "I"):
        return roman(c, token == "I")
    if token in ("a", "A"):
        return alphabetic(c, token == "A")
    if token in ("w", "W", "Ww"):
        out = words(c)
        return F.upper(out) if token == "W" else F.initcap(out) if token == "Ww" else out
    out = c.cast("string")
    if len(token) > 1:
        out = F.when(F.length(out) < len(token), F.lpad(out, len(token), "0")).otherwise(out)
    if grouping_separator:
        out = F.reverse(F.regexp_replace(F.reverse(out), rf"(\d{{{grouping_size}}})(?=\d)", "$1" + grouping_separator))
    return F.concat(out, F.regexp_extract(ordinal_suffix(c), r"[a-z]+$", 0)) if ordinal else out


def numbers(cs: Column, tokens: list[str], separators: list[str], start_at: tuple[int, ...] = (1,)) -> Column:
    """A list of ordinals, as level=multiple gives, by a format such as 1.a.i; the last token, separator and start serve what is left."""
    at = lambda seq, i: seq[min(i, len(seq) - 1)]
    own = max(len(tokens), len(separators) + 1, len(start_at))  # levels with a token, separator or start of their own

    def mark(i: int) -> Column:
        return F.lit(at(separators, i - 1) if separators else ".")

    def one(i: int, n: Column) -> Column:
        return numeral(n + (at(start_at, i) - 1), at(tokens, i))

    out = F.coalesce(one(0, F.get(cs, F.lit(0))), F.lit(""))
    for i in range(1, own):
        out = F.concat(out, F.when(F.size(cs) > i, F.concat(mark(i), one(i, F.get(cs, F.lit(i))))).otherwise(""))
    deeper = F.transform(F.slice(cs, own + 1, F.greatest(F.size(cs) - own, F.lit(0))), lambda n: F.concat(mark(own), one(own, n)))
    return F.concat(out, F.array_join(deeper, ""))
