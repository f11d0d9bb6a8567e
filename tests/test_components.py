"""JSON as XML, analysis of plans, templates and packages, shared folders, positions, scratch names."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina import session as session_module
from lamina.functions import json_xml, numbers, strings
from lamina.operators import grouping, joins, sequence, sets, sorting, windows
from lamina.operators import templates as P
from lamina.sources import readers, sinks
from lamina.streaming import analysis
from lamina.streaming.plan import AnalysisError


@pytest.mark.parametrize("value", [{"a": [1, 2.5, {"b": None}], "c": True, 'q"<&': 'x\n"é'}, [], {}, "s", None, False, [[], [{}]], 0])
def test_json_and_xml_and_back(value):
    assert json.loads(json_xml.to_json_text(json_xml.to_xml_text(json.dumps(value)))) == value


def test_json_keeps_numbers_as_written_and_the_first_of_a_name():
    assert json_xml.to_json_text(json_xml.to_xml_text('{"a": 1.50e3, "a": 2, "b": 12345678901234567890}')) == '{"a":1.50e3,"b":12345678901234567890}'


@pytest.mark.parametrize("bad", ["<a/>", f'<map xmlns="{json_xml.NAMESPACE}"><null/></map>', f'<number xmlns="{json_xml.NAMESPACE}">x</number>', f'<boolean xmlns="{json_xml.NAMESPACE}">maybe</boolean>', "<"])
def test_other_xml_is_no_json(spark, bad):
    df = spark.createDataFrame([(bad,), (None,)], "x string")
    assert [r[0] for r in df.select(json_xml.xml_to_json(F.col("x"), lax=True)).collect()] == [None, None]
    with pytest.raises(Exception):
        df.select(json_xml.xml_to_json(F.col("x"))).collect()


def test_analysis_names_what_cannot_stream(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert analysis.posture(df) is analysis.Posture.GROUNDED
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert analysis.checked(e.where("value > 1")) is not None
    with pytest.raises(AnalysisError, match="XTSE3430.*Window"):
        analysis.checked(e.withColumn("p", F.row_number().over(Window.orderBy("ts"))))
    with pytest.raises(AnalysisError, match="Sort"):
        analysis.checked(e.orderBy("ts").where("value > 1"))
    assert analysis.buffering(e.groupBy("user_id").count()) is analysis.Buffering.MATCHED


def test_tunnel_parameters_end_with_the_call():
    own = P.Templates()
    own.template("read")(lambda: P.tunnel("x", "none"))
    own.template("through")(lambda: own.call("read"))
    assert own.call("through", tunnel={"x": 1}) == 1
    assert own.call("through") == "none"


def test_packages_refuse_what_is_not_theirs():
    base = P.Package("b", "2.1").define("f", lambda: 1, "final").define("a", None, "abstract")
    with pytest.raises(P.PackageError, match="abstract"):
        P.Package("o").use(base)
    with pytest.raises(P.PackageError, match="final"):
        P.Package("o").use(base, overrides={"f": lambda: 2, "a": lambda: 3})
    with pytest.raises(P.PackageError, match="is not 3"):
        P.Package("o").use(base, "3.*")
    own = P.Package("o").use(base, "2.0+", {"a": lambda: 3}, hide=("f",))
    assert own.call("a") == 3
    with pytest.raises(P.PackageError, match="private"):
        own.call("f")


@pytest.mark.parametrize("wanted, fits", [("*", True), ("2.1", True), ("2", False), ("2.*", True), ("2.0+", True), ("2.2+", False), ("to 2", True), ("1 to 2.0", False), ("1.0, 2.1", True)])
def test_versions(wanted, fits):
    assert P.matches_version("2.1", wanted) == fits


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    known = session_module.shared_folder(spark)
    assert known == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Conf:
        def get(self, name, default=None):
            return default

    class Gone:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Empty()

                    return Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session_module.shared_folder(Gone())


def test_positions_split_a_frequent_first_value(spark, monkeypatch):
    monkeypatch.setattr(sequence, "RANGES", 8)
    rng = random.Random(1)
    rows = [(rng.choice([1.0, 1.0, 1.0, 2.0, None, float("nan")]), rng.choice(["a", "b", None]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "x double, y string, z long")
    got = {r.z: r.pos for r in sequence.with_position(df, ["x", "y", "z"]).collect()}
    key = lambda r: (r[0] is not None, r[0] is not None and r[0] != r[0], r[0] if r[0] is not None and r[0] == r[0] else 0, r[1] is not None, r[1] or "", r[2])
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=key), 1)}


def test_whole_table_windows_are_refused(spark):
    for make in (lambda: sequence.position(["x"], []), lambda: sequence.last([])):
        with pytest.raises(ValueError):
            make()


def test_predicates_without_a_key(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    out = sequence.predicates(df, ["id"], None, lambda p, n: p > 10, lambda p, n: p <= n - 5, lambda p, _: p % 100 == 0)
    assert sorted(r.id for r in out.collect()) == list(range(109, 985, 100))


def test_scratch_columns_clash_with_none(spark):
    names = ["_pos", "_last", "_range", "_before", "_seen", "_change", "_value", "_each", "_begins", "_ends", "_since", "_rank", "_at", "_reach", "_next"]
    df = spark.createDataFrame([(i, i % 2, *range(len(names)), i, 9 - i, 1) for i in range(4)], ["id", "k", *names, "pre", "post", "doc_id"])
    every = {
        "subsequence": sequence.subsequence(df, ["id"], 2), "remove": sequence.remove(df, ["id"], 1, ["k"]), "predicates": sequence.predicates(df, ["id"], ["k"], lambda p, n: p == n), "before": sequence.before_first(df, ["id"], ["k"], F.col("id") > 1),
        "adjacent": grouping.adjacent(df, F.col("k"), ["id"], ["k"]), "starting": grouping.starting_with(df, F.col("id") > 1, ["id"], ["k"]), "ending": grouping.ending_with(df, F.col("id") > 1, ["id"], ["k"]),
        "any": windows.number_any(df, F.col("id") > 0, ["id"], ["k"], F.col("id") > 1), "top": sorting.top_k(df, [sorting.SortKey(F.col("id"))], ["id"], 1, ["k"]), "numbered": sorting.numbered(df, [sorting.SortKey(F.col("k"))], ["id"]),
        "outermost": sets.outermost(df), "innermost": sets.innermost(df), "lookup": joins.key_lookup_any(df, joins.Key(df.select(F.col("id").alias("other")), (F.col("other"),)), F.array("id"), ["id"]),
    }
    for name, out in every.items():
        assert set(df.columns) <= set(out.columns), name
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect()), name


def test_numbers_and_division(spark):
    df = spark.range(1).select(F.array(*(F.lit(i) for i in range(1, 31))).alias("n"), F.lit(9007199254740993).alias("a"), F.lit(-7).alias("b"), F.lit(7.5).alias("c"))
    r = df.select(numbers.numbers(F.col("n"), ["1", "a"], [".", "-"], (1, 5)).alias("t"), numbers.integer_divide(F.col("a"), F.lit(1)).alias("q"), numbers.integer_divide(F.col("b"), F.lit(2)).alias("s"), numbers.integer_divide(F.col("c"), F.lit(-2)).alias("u")).first()
    assert r.t == "1.f-" + "-".join("abcdefghijklmnopqrstuvwxyz"[i - 1 + 4] if i + 4 <= 26 else "a" + "abcdefghij"[i + 4 - 27] for i in range(3, 31))
    assert (r.q, r.s, r.u) == (9007199254740993, -3, -3)


def test_collections_tell_paths_apart(spark, tmp_path):
    sources = readers.Sources(spark)
    paths = [f"{tmp_path}/{p}" for p in ("a/part1", "a/part10", "b/part1")]
    for i, p in enumerate(paths):
        sinks.write(spark.range(1).select((F.col("id") + i).alias("_key")), p, sinks.Output("xml"), "r", "rs")
    sources.register_collection("c", paths)
    assert sorted((r._document, r._key) for r in sources.collection("c", "r", "_key long").collect()) == [(0, 0), (1, 1), (2, 2)]


def test_token_counts_are_the_tokens(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", " ", "a", " a  b\n\tc ", "a,b,,c,", "x.y.z", ",", "aXbxc")], "s string")
    c = F.col("s")
    for pattern, flags in ((None, ""), (",", ""), (".", "q"), (".", ""), ("|", "q"), (r"\s+", ""), ("x", "i"), ("[,.]", "")):
        pairs = df.select(strings.token_count(c, pattern, flags).alias("a"), F.size(strings.tokenize(c, pattern, flags)).cast("long").alias("b")).collect()
        assert all(r.a == r.b for r in pairs), (pattern, pairs)
    with pytest.raises(ValueError):
        strings.token_count(c, "a*")
