"""Operators on small fixtures with known outcomes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamina.operators import aggregates as A
from lamina.operators import control as K
from lamina.operators import grouping as G
from lamina.operators import joins as J
from lamina.operators import merge as M
from lamina.operators import nodes as X
from lamina.operators import sequence as S
from lamina.operators import sets as U
from lamina.operators import windows as W
from lamina.operators.rules import Mode, RuleSet
from lamina.operators.sorting import SortKey, perform_sort
from lamina.plans.registry import QUERIES


@pytest.fixture
def cities(spark):
    return spark.createDataFrame([(1, "milan", "italy", "5"), (2, "paris", "france", "7"), (3, "bristol", "england", "5.0"), (4, "sheffield", "england", "05")], "ord int, name string, country string, pop string")


@pytest.fixture
def xs(spark):
    return spark.createDataFrame([(i, i) for i in range(1, 9)], "ord int, v int")


def values(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_composite_keys_compare_numbers(cities):
    out = G.group_by(cities, {"country": F.col("country"), "pop": F.col("pop").cast("decimal(9,2)")}, ["ord"], names=A.string_join(F.col("name"), "ord", ","))
    assert values(out.orderBy("first_seen"), "names") == ["milan", "paris", "bristol,sheffield"]


def test_sequence_keys_join_each_group_once(cities):
    keys = F.array(F.col("pop").cast("double"), F.length("name").cast("double"))
    out = G.group_by_each(cities, keys, ["ord"], n=F.count(F.lit(1)), names=A.string_join(F.col("name"), "ord", ","))
    assert values(out.where("key = 5"), "names") == ["milan,paris,bristol,sheffield"]


def test_empty_key_joins_no_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a"), (5, None)], "ord int, k string")
    out = G.group_by(df, {"k": F.col("k")}, ["ord"], n=F.count(F.lit(1))).orderBy("first_seen")
    assert values(out, "k", "n") == [("a", 2), ("b", 1)]
    none = G.group_by(df.where("k is null"), {"k": F.col("k")}, ["ord"], n=F.count(F.lit(1)))
    assert none.count() == 0


def test_groups_in_order_of_appearance(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "a")], "id int, cat string")
    out = G.group_by(df, {"cat": F.col("cat")}, ["id"], ids=A.string_join(F.col("id"), "id", ",")).orderBy("first_seen")
    assert values(out, "cat", "ids") == [("a", "1,3,6"), ("b", "2,5"), ("c", "4")]


def test_dates_group_by_instant(spark):
    df = spark.createDataFrame([(1, "milan", "2024-01-01T12:00:00+02:00"), (2, "london", "2024-01-01T12:00:00+00:00"), (3, "paris", "2024-01-01T11:00:00+01:00"), (4, "munich", "2024-01-01T10:00:00+00:00")], "ord int, name string, t string")
    out = G.group_by(df, {"t": F.col("t").cast("timestamp")}, ["ord"], names=A.string_join(F.col("name"), "ord", ",")).orderBy("first_seen")
    assert values(out, "names") == ["milan,paris,munich", "london"]


def test_adjacent_runs(spark):
    names = "a b b b c d b b f g g h".split()
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "doc int, ord int, name string")
    out = G.adjacent(df, F.col("name"), ["ord"], ["doc"]).groupBy("group").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).orderBy("group")
    assert values(out, "name", "n") == [("a", 1), ("b", 3), ("c", 1), ("d", 1), ("b", 2), ("f", 1), ("g", 2), ("h", 1)]
    with pytest.raises(ValueError):
        G.adjacent(df, F.col("name"), ["ord"], [])


def test_starts_and_ends(spark):
    df = spark.createDataFrame([(0, i, k) for i, k in enumerate("xhxxhx")], "doc int, ord int, k string")
    starts = G.starting_with(df, F.col("k") == "h", ["ord"], ["doc"])
    ends = G.ending_with(df, F.col("k") == "h", ["ord"], ["doc"])
    assert values(starts.orderBy("ord"), "group") == [1, 2, 2, 2, 3, 3]
    assert values(ends.orderBy("ord"), "group") == [1, 1, 2, 2, 2, 3]


def test_chained_predicates_count_anew(xs):
    chain = lambda *t: values(S.predicates(xs, ["ord"], [], *t), "v")
    assert chain(lambda p, _: p > 1, lambda p, _: p == 1) == [2]
    assert chain(lambda p, _: p % 2 == 1, lambda p, _: p > 3) == [7]
    assert chain(lambda p, n: p == n) == [8]


def test_slices(xs):
    assert sorted(values(S.subsequence(xs, ["ord"], 2, 3), "v")) == [2, 3, 4]
    assert sorted(values(S.subsequence(xs, ["ord"], 1.5, 2.6), "v")) == [2, 3, 4]
    assert values(S.head(xs, ["ord"]), "v") == [1]
    assert sorted(values(S.tail(xs, ["ord"]), "v")) == list(range(2, 9))
    assert sorted(values(S.remove(xs, ["ord"], 3), "v")) == [1, 2, 4, 5, 6, 7, 8]
    assert values(S.reverse(xs, ["ord"]), "v") == list(range(8, 0, -1))


def test_positions_of_a_whole_table_are_dense(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"))
    out = S.with_position(df, ["k"]).orderBy("k").collect()
    assert [r.pos for r in out] == list(range(1, 10_001))


def test_sums_of_nothing(spark):
    none = spark.createDataFrame([], "v int")
    assert none.agg(A.total(F.col("v"))).first()[0] == 0
    assert none.agg(F.avg("v")).first()[0] is None
    assert none.agg(A.string_join(F.col("v"), "v", ",")).first()[0] == ""


def test_folds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord int, v string")
    join = lambda s, x: F.concat(s, x["v"])
    assert df.agg(A.fold_left(["ord"], ["v"], F.lit(""), join)).first()[0] == "abc"
    assert df.agg(A.fold_right(["ord"], ["v"], F.lit(""), join)).first()[0] == "cba"


def test_cardinality(xs):
    with pytest.raises(PySparkException):
        xs.agg(A.exactly_one(F.col("v"))).collect()
    assert xs.where("v = 3").agg(A.exactly_one(F.col("v"))).first()[0] == 3
    assert xs.where("v = 30").agg(A.zero_or_one(F.col("v"))).first()[0] is None


def test_iterate_breaks(xs):
    df = xs.withColumn("doc", F.lit(0))
    out = W.iterate(df, ["v"], ["ord"], ["doc"], F.lit(0), lambda s, x: s + x["v"], lambda s: s >= 10)
    assert values(out, "result") == [10]

    def body(key, rows):
        total = 0
        for r in rows:
            total += r.v
            yield {"doc": key[0], "total": total}
            if total >= 6:
                return

    assert sorted(values(W.iterate_rows(df, ["ord"], ["doc"], body, "doc int, total int"), "total")) == [1, 3, 6]


def test_accumulator_frames(xs):
    out = W.accumulator(xs.withColumn("doc", F.lit(0)), F.sum("v"), ["ord"], ["doc"]).orderBy("ord")
    assert values(out, "acc_before")[:4] == [0, 1, 3, 6]
    assert values(out, "acc_after")[:4] == [1, 3, 6, 10]


def test_sorting(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "Z", "B", "c", None])], "ord int, v string")
    assert values(perform_sort(df, [SortKey(F.col("v"))], ["ord"]), "v") == [None, "B", "Z", "a", "c"]
    assert values(perform_sort(df, [SortKey(F.col("v"), descending=True)], ["ord"]), "v") == ["c", "a", "Z", "B", None]
    assert values(perform_sort(df, [SortKey(F.col("v"), collation="UNICODE")], ["ord"]), "v") == [None, "a", "B", "c", "Z"]
    numbers = spark.createDataFrame([(i, v) for i, v in enumerate(["10", "9", "x", "1e1"])], "ord int, v string")
    assert values(perform_sort(numbers, [SortKey(F.col("v"), numeric=True)], ["ord"]), "v") == ["x", "9", "10", "1e1"]


def test_merge_in_key_order(spark):
    a, b = (spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "ord int, n int") for ns in ((1, 3, 5, 3), (2, 4, 6, 3)))
    out = M.merged({"a": (a, [F.col("n")], ["ord"]), "b": (b, [F.col("n")], ["ord"])}, ["n"], ["k"]).orderBy("k")
    assert values(out, "k") == [1, 2, 3, 4, 5, 6]
    three = out.where("k = 3").first()
    assert [(x.source, x.order.ord) for x in three.current] == [("a", 1), ("a", 3), ("b", 3)]
    assert (three.n_a, three.n_b) == (2, 1)
    with pytest.raises(M.MergeError):
        M.merged({"a": (a, [F.col("n")], ["ord"]), "b": (b, [F.col("n").cast("string")], ["ord"])}, ["n"], ["k"])
    with pytest.raises(PySparkException):
        spark.range(1).select(M.single_key(F.array(F.lit(1), F.lit(2)))).collect()


def test_keys(spark):
    items = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, [])], "id int, tags array<string>")
    probe = spark.createDataFrame([("p", ["x", "y"]), ("q", ["z"])], "name string, want array<string>")
    found = J.key_lookup_any(probe, J.Key(items, (F.col("tags"),), many=True), F.col("want"), ["name", "id"])
    assert sorted(values(found, "name", "id")) == [("p", 1), ("p", 2)]


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    k = F.col("k")
    rules = RuleSet().rule("low", k == "a", F.lit("1"), priority=1.0).rule("late", k == "a", F.lit("2"), priority=1.0).rule("best", k == "b", lambda n: F.concat(F.lit("<"), n.next_match(), F.lit(">")), priority=2.0).rule("any", F.lit(True), F.lit("any"), pattern="any")
    assert values(rules.apply(df, k).orderBy("id"), "result") == ["2", "<any>", "any"]
    rules.modes["default"] = Mode(on_multiple="fail")
    with pytest.raises(PySparkException):
        rules.apply(df, k).collect()
    strict = RuleSet(modes={"default": Mode("fail")}).rule("a", k == "a", F.lit("x"))
    with pytest.raises(PySparkException):
        strict.apply(df, k).collect()


def test_control(spark, xs):
    assert values(K.on_empty(xs.where("v > 100"), xs.where("v = 1")), "v") == [1]
    assert K.on_empty(xs, xs.where("v = 1")).count() == 8
    assert K.on_non_empty(xs.where("v > 100"), xs).count() == 0
    with pytest.raises(PySparkException):
        K.checked(xs, F.col("v") < 5, "too large").collect()
    assert K.attempt_query(lambda: 1 / 0, (ZeroDivisionError, lambda e: "caught")) == "caught"


def test_trees(spark):
    docs = spark.createDataFrame([(1, "<r><a><b i='1'>x</b><b i='2'/></a><c>y<d/>z</c></r>"), (2, "<r/>"), (3, None)], "doc_id long, xml string")
    n = X.nodes(docs)
    e = n.where("kind = 'element'")
    names = lambda df: [r.name for r in df.where("doc_id = 1").orderBy("pre").collect()]
    at = lambda name: e.where(F.col("name") == name)
    assert names(X.axis(at("r"), e, "descendant")) == ["a", "b", "b", "c", "d"]
    assert names(X.axis(at("d"), e, "ancestor")) == ["r", "c"]
    assert names(X.axis(at("a"), e, "following")) == ["c", "d"]
    assert names(X.axis(at("d"), e, "preceding")) == ["a", "b", "b"]
    assert names(X.axis(at("a"), e, "following-sibling")) == ["c"]
    assert names(X.axis(at("c"), e, "parent")) == ["r"]
    assert names(U.outermost(e.where("name in ('a', 'b', 'd')"))) == ["a", "d"]
    assert names(U.innermost(e.where("name in ('a', 'b', 'r')"))) == ["b", "b"]
    assert [r.string_value for r in X.string_value(n, at("c")).collect()] == ["yz"]
    assert "/r[1]/a[1]/b[2]" in [r.path for r in X.node_path(n).collect()]
    bad = spark.createDataFrame([(1, "<r>"), (2, "<ok/>")], "doc_id long, xml string")
    assert X.nodes(bad, lax=True).count() == 1
    with pytest.raises(PySparkException):
        X.nodes(bad).collect()
    with pytest.raises(PySparkException):
        X.nodes(spark.createDataFrame([(1, "<!DOCTYPE r [<!ENTITY e 'x'>]><r>&e;</r>")], "doc_id long, xml string")).collect()


def test_stream_of_adjacent_groups_has_each_last_run(spark, folder):
    want = QUERIES["group_adjacent"](spark, folder).drop("total").collect()
    got = QUERIES["stream_group_adjacent_all"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
