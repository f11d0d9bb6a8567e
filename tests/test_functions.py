"""Scalar functions, sources, sinks and stream plans on small inputs."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import atomize, json
from lamina.functions import collections as C
from lamina.functions import dates as D
from lamina.functions import numbers as N
from lamina.functions import strings as S
from lamina.functions import values
from lamina.functions.udf import Functions
from lamina.operators import messages
from lamina.sources import readers, sinks
from lamina.streaming.plan import AnalysisError, Plan, classify, streamable


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


@pytest.mark.parametrize(("lexical", "want"), [("007", "7"), ("-0e0", "-0"), ("1E6", "1.0E6"), ("-1E-6", "-0.000001"), (".001", "0.001"), ("23.", "23")])
def test_json_numbers(spark, lexical, want):
    assert one(spark, json.canonical_number(F.lit(lexical))) == want


def test_rounding(spark):
    r = lambda x: one(spark, atomize.round_half_up(F.lit(x)))
    assert [r(-2.5), r(2.5), r(-0.5), r(0.49)] == [-2.0, 3.0, -0.0, 0.0]


def test_effective_boolean(spark):
    e = lambda v, k: one(spark, atomize.ebv(F.lit(v).cast(k), k))
    assert [e("", T.StringType()), e("0", T.StringType()), e(0, T.IntegerType()), e(float("nan"), T.DoubleType()), e(None, T.LongType()), e(True, T.BooleanType())] == [False, True, False, False, False, True]


def test_text_of_numbers(spark):
    d = lambda x: one(spark, atomize.double_text(F.lit(x).cast("double")))
    assert [d(1e6), d(0.5), d(12.0), d(float("nan")), d(float("inf")), d(-1.5e-7)] == ["1.0E6", "0.5", "12", "NaN", "INF", "-1.5E-7"]
    assert one(spark, atomize.decimal_text(F.lit("1.500").cast("decimal(9,3)"))) == "1.5"


def test_strings(spark):
    assert one(spark, S.substring(F.lit("12345"), 1.5, 2.6)) == "234"
    assert one(spark, S.substring(F.lit("12345"), 0, 3)) == "12"
    assert one(spark, S.substring(F.lit("12345"), -42)) == "12345"
    assert one(spark, S.substring_before(F.lit("tattoo"), "attoo")) == "t"
    assert one(spark, S.substring_after(F.lit("tattoo"), "x")) == ""
    assert one(spark, S.encode_for_uri(F.lit("a b/é~*"))) == "a%20b%2F%C3%A9~%2A"
    assert one(spark, S.iri_to_uri(F.lit("http://x/é b?q=1"))) == "http://x/%C3%A9%20b?q=1"
    assert one(spark, S.escape_html_uri(F.lit("a b-é"))) == "a b-%C3%A9"
    assert one(spark, S.resolve_uri(F.lit("b.xml"), F.lit("http://h/d/a.xml?q"))) == "http://h/d/b.xml"
    assert one(spark, S.from_codepoints(S.to_codepoints(F.lit("aé\U0001f600")))) == "aé\U0001f600"
    assert one(spark, S.normalize_unicode(F.lit("é"))) == "é"
    assert one(spark, S.tokenize(F.lit("  a  b "))) == ["a", "b"]
    assert one(spark, S.tokenize(F.lit(""), ",")) == []
    assert one(spark, S.replace(F.lit("a.b.c"), ".", "$", "q")) == "a$b$c"
    assert one(spark, S.matches(F.lit("HELLO"), "h e l+ o", "xi")) is True
    assert one(spark, S.character_map(F.lit("a&b"), {"&": "+", "b": "&"})) == "a+&"


def test_analyze_string(spark):
    parts = one(spark, S.analyze_string(F.lit("a1b22"), r"([0-9])[0-9]*"))
    assert [(p.matched, p.text, p.groups) for p in parts] == [(False, "a", []), (True, "1", ["1"]), (False, "b", []), (True, "22", ["2"])]


def test_numerals(spark):
    n = lambda v, token, **kw: one(spark, N.numeral(F.lit(v), token, **kw))
    assert [n(1999, "I"), n(4, "i"), n(28, "A"), n(5, "001"), n(1234567, "1", grouping_separator=","), n(13, "1", ordinal=True), n(100, "w"), n(3005, "Ww")] == ["MCMXCIX", "iv", "AB", "005", "1,234,567", "13th", "one hundred", "Three Thousand And Five"]
    assert one(spark, N.numbers(F.array(F.lit(2), F.lit(3), F.lit(4)), ["1", "a", "i"], [".", "."], (1, 1, 5))) == "2.c.viii"
    assert one(spark, N.format_number(F.lit(-1234.5), "#.##0,00", ",", ".")) == "-1.234,50"
    assert one(spark, N.format_number(F.lit(float("nan")), "#,##0.00")) == "NaN"
    assert one(spark, N.integer_divide(F.lit(-7), F.lit(2))) == -3


def test_dates(spark):
    t = F.lit("2024-03-05 06:07:08").cast("timestamp")
    assert one(spark, D.format_date(t, "[D1] [MNn] [Y0001] at [H01]:[m01]")) == "5 March 2024 at 06:07"
    assert one(spark, D.day_time_duration(F.lit(93784))) == "P1DT2H3M4S"
    assert one(spark, D.day_time_duration(F.lit(0))) == "PT0S"
    with pytest.raises(ValueError):
        D.picture("[Q]")


def test_ordered_maps(spark):
    m = C.ordered_map([(F.lit("fruit"), F.lit(1)), (F.lit("veg"), F.lit(2)), (F.lit("grain"), F.lit(3))])
    assert one(spark, C.keys(C.put(m, F.lit("veg"), F.lit(9)))) == ["fruit", "veg", "grain"]
    assert one(spark, C.values(C.put(m, F.lit("new"), F.lit(9)))) == [1, 2, 3, 9]
    assert one(spark, C.keys(C.remove(m, F.lit("fruit")))) == ["veg", "grain"]
    assert one(spark, C.values(C.merge(m, C.ordered_map([(F.lit("veg"), F.lit(7))]), use="use-last"))) == [1, 7, 3]
    assert one(spark, C.get(m, F.lit("none"))) is None


def test_arrays(spark):
    a = F.array(*(F.lit(x) for x in (3, 1, 2, 3)))
    assert one(spark, C.insert_before(a, 2, F.lit(9))) == [3, 9, 1, 2, 3]
    assert one(spark, C.remove_at(a, 1)) == [1, 2, 3]
    assert one(spark, C.index_of(a, F.lit(3))) == [1, 4]
    assert one(spark, C.tail(F.array().cast("array<int>"))) == []
    assert one(spark, C.for_each_pair(a, F.array(F.lit(10), F.lit(20)), lambda x, y: x + y)) == [13, 21]
    assert one(spark, C.sort(a, lambda x: -x)) == [3, 3, 2, 1]
    assert one(spark, atomize.text(C.flatten(F.array(F.array(F.lit("MHK"), F.lit("MMP")), F.array(F.lit("A"), F.lit("B")))), T.ArrayType(T.StringType()))) == "MHK MMP A B"


def test_functions_override():
    base, own = Functions(), None
    base.define("f", lambda x: x + 1)
    own = Functions(base)
    own.define("f", lambda x: base.call("f", x) * 2)
    assert own.call("f", F.lit(1)) is not None
    assert own.lookup("g", 1) is None
    with pytest.raises(LookupError):
        own.call("f", F.lit(1), F.lit(2))


def test_output_methods(spark):
    df = spark.createDataFrame([("a<b", 1.0, None)], "s string, n double, e string")
    out = lambda **k: sinks.serialized(df, sinks.Output(**k)).first()[0]
    assert out(method="xml") == "<row><s>a&lt;b</s><n>1</n><e/></row>"
    assert out(method="html") == "<row><s>a&lt;b</s><n>1</n><e></e></row>"
    assert out(method="text", item_separator="|") == "a<b|1|"
    assert out(method="json") == '{"s":"a<b","n":1.0}'
    assert one(spark, sinks.element("br", method="xhtml")) == "<br />"


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "href string, v int")
    sinks.write_results(df, str(tmp_path / "out"), "href")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_results(df, str(tmp_path / "few"), "href", limit=1)
    with pytest.raises(ValueError):
        sinks.write_results(df.withColumn("href", F.lit("../x")), str(tmp_path / "up"), "href")


def test_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<l><i n='1'>x</i><i n='2'>y</i></l>")
    (tmp_path / "b.xml").write_text("<l><i n='3'>z</i></l>")
    s = readers.Sources(spark)
    s.register_collection("c", [str(tmp_path / "b.xml"), str(tmp_path / "a.xml")])
    rows = s.collection("c", "i", "_n int, _VALUE string").orderBy("_document", "_n").collect()
    assert [(r._document, r._n) for r in rows] == [(0, 3), (1, 1), (1, 2)]
    assert s.available(str(tmp_path / "a.xml")) and not s.available(str(tmp_path / "none.xml"))
    assert s.lines(str(tmp_path / "a.xml")).count() == 1
    assert readers.empty_source(spark).count() == 1


def test_stream_plans():
    assert classify(["filter", "for-each"], keyed=False) is Plan.STATELESS
    assert classify(["filter", "sum"], keyed=False) is Plan.KEYED_STATE
    assert classify(["accumulator"], keyed=True) is Plan.KEYED_STATE
    assert classify(["filter", "sort"], keyed=True) is Plan.BATCH
    assert not streamable(["last"], keyed=True)
    with pytest.raises(AnalysisError):
        classify(["iterate"], keyed=False)
    with pytest.raises(AnalysisError):
        classify(["teleport"], keyed=True)


def test_templates_and_types(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "b", [])], "i int, s string, a array<int>")
    assert [r[0] for r in df.select(values.template(df, "{i}:{s}|{a}{{}}")).collect()] == ["1:|1 2{}", "2:b|{}"]
    assert [r[0] for r in df.select(values.instance_of(df, "a", "int", "*")).collect()] == [True, True]
    assert [r[0] for r in df.select(values.instance_of(df, "a", "string", "*")).collect()] == [False, True]
    assert [r[0] for r in df.select(values.instance_of(df, "s", "string")).collect()] == [False, True]
    with pytest.raises(PySparkException):
        values.coerced(df.select("i", "s"), "i int, s int").collect()
    with pytest.raises(ValueError):
        values.context_item(None, "required")
    with pytest.raises(PySparkException):
        df.select(values.treat_as(F.col("i"), F.col("i") < 2, "small")).collect()
    numbers = [r[0] for r in spark.range(1000).select(values.random_number(7, F.col("id"))).collect()]
    assert numbers == [r[0] for r in spark.range(1000).repartition(5).orderBy("id").select(values.random_number(7, F.col("id"))).collect()]
    assert 0.45 < sum(numbers) / 1000 < 0.55


@pytest.mark.parametrize(("pattern", "path", "want"), [("a/b", "/x/a/b", True), ("/a/b", "/x/a/b", False), ("/a/*", "/a/c", True), ("/a/**/d", "/a/b/c/d", True), ("/a/**/d", "/a/d", True), ("a/@x", "/r/a/@x", True), ("/a/*", "/a/@x", False)])
def test_path_patterns(pattern, path, want):
    assert bool(re.search(values.path_pattern(pattern), path)) is want


def test_messages(spark):
    df, seen = messages.observed(spark.range(10), n=F.count(F.lit(1)), top=F.max("id"))
    df.collect()
    assert messages.report(seen) == {"n": 10, "top": 9}
