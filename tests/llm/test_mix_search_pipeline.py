"""Mixing, nearest neighbours and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import decision_list, mixing, multi_index, near_dup
from tests.llm.conftest import ODD, SCHEMA, SMALL
from tests.llm.test_dedup import groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    target = water(dict(sizes))
    source_of = defaultdict(set)
    for i, t, _, s, _ in rows:
        source_of[(i, size(t))].add(s)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        (s,) = [s for s in source_of[(r.doc_id, r.size)] if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6][:1]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_mix(small):
    rows = [tuple(r) for r in small.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = mixing.report(small).collect()
    check_mix(rows, got)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions)
    assert mixing.report(small.repartition(7)).collect() == got


def test_mix_limits_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 7), (None, 3), ("d", 0), ("a", 5)])]
    check_mix(rows, mixing.report(spark.createDataFrame(rows, SCHEMA)).collect())
    assert mixing.report(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.report(odd).count() == len(ODD)


def test_targets_of_many_sources(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 4000]), "en", rng.choice([None, *(f"s{k}" for k in range(300))]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = mixing.report(df).collect()
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 10)
    got = mixing.report(df).collect()
    assert [(r.doc_id, r.taken, r.position) for r in got] == [(r.doc_id, r.taken, r.position) for r in want]
    assert np.allclose([r.target for r in got], [r.target for r in want])
    check_mix(rows, got)


def test_slices_change_no_result(spark, small, monkeypatch):
    want = mixing.report(small).collect()
    monkeypatch.setattr(mixing, "LEAST_DIGITS", 1)
    assert mixing.report(small).collect() == want
    monkeypatch.setattr(mixing, "SLICE_ROWS", 0.001)
    assert mixing.report(small).collect() == want


def test_mix_of_clashing_columns(spark, odd):
    wide = odd.withColumns({"size": F.lit("x"), "_row": F.lit(1), "_h": F.lit(2.0), "Target": F.lit(None).cast("string"), "_pass": F.lit(3)})
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    assert all((r.size, r._row, r._h, r.Target, r._pass) == ("x", 1, 2.0, None, 3) for r in out.collect())
    assert mixing.report(wide).count() == len(ODD)


def test_demand_inverse(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for a in (0.5, 0.0, -0.5):
        share = (1 - a) * F.col("t") + a * F.col("t") ** 2
        assert t.where(F.abs(mixing.demand_inverse(share, F.lit(a)) - F.col("t")) > 1e-9).count() == 0


def test_mixed_rows_hold_what_is_taken(spark):
    rng = random.Random(1)
    rows = [(i, " \n".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(1, 40))), "en", "abcd"[i % 4], i) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.report(df).collect()}
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in mixing.mixed(df).collect():
        words[r.doc_id] += size(r.text)
        assert texts[r.doc_id].startswith(r.text)
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def exact(vectors, k=20):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = np.array([x[n] @ row for row in x])
            rest = np.flatnonzero(ids != i)
            best = rest[np.lexsort((ids[rest], -s[rest]))][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in best]
    return out


def recall(spark, vectors, k=20):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in multi_index.report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact([(i, np.float32(v)) for i, v in vectors], k)
    assert set(got) == set(want)
    hit = total = 0
    for q, best in want.items():
        assert len(got[q]) == len(best)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hit += len({i for i, _ in got[q]} & {i for i, _ in best})
        total += len(best)
    return hit / total


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths", "few", "flat"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "clusters":
        x = x[rng.integers(0, 30, 3000)] + 0.1 * x
        x[:1000] = x[0]
    elif kind == "few":
        x = x[:15]
    elif kind == "flat":
        x = x[:, :3]
    assert recall(spark, list(enumerate(x))) >= 0.9


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    queries = codes[:40] ^ (1 << rng.integers(0, 16, (40, 4))).astype(np.uint16)
    for radius in (0, 3, 4, 7, 24, 64):
        q, r = multi_index.Index(codes).within(queries, np.full(40, radius))
        want = np.argwhere(np.bitwise_count(queries[:, None] ^ codes[None]).sum(-1) <= radius)
        assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("units", [2, 4, 8])
def test_index_of_longer_substrings(units):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (300, 16)).astype(np.uint16)
    codes[100:150] = codes[0]
    queries = codes[:30] ^ (1 << rng.integers(0, 16, (30, 16))).astype(np.uint16)
    for radius in (0, 16, 90, 117, 256):
        q, r = multi_index.Index(codes, units).within(queries, np.full(30, radius))
        want = np.argwhere(np.bitwise_count(queries[:, None] ^ codes[None]).sum(-1) <= radius)
        assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_the_index_spares_comparisons(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 64))
    df = spark.createDataFrame([(i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    counts = multi_index.report(df).where("rank = 1").agg(F.avg("n_probed"), F.avg("n_compared")).first()
    assert counts[1] <= counts[0] < 0.2 * len(x) and counts[1] < 0.1 * len(x)


def test_an_id_asks_once(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.5, 1.0]), (20, [0.25, 0.0]), (20, [0.25, 0.0])]
    got = multi_index.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>", verifySchema=False))
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
    assert rows == [(0, 1, 3, 0.5), (0, 2, 20, 0.25), (0, 3, 20, 0.25), (20, 1, 0, 0.5), (20, 2, 0, 0.25), (20, 3, 0, 0.25), (20, 4, 3, 0.125)]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.report(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 8, 0.5), (0, 3, 8, 0.5), (20, 1, 0, 1.0), (20, 2, 8, 0.5), (20, 3, 8, 0.5)]
    assert multi_index.report(df.limit(0)).count() == 0
    assert multi_index.report(df.where("vec_id = 0")).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_dedup", "secret_scan", "curriculum_mix", "byte_bpe"]
    kept = {r.doc_id for r in decision_list.report(docs, labels).where("kept").collect()}
    one = steps["quality_rules"](spark, docs, SMALL)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = steps["near_dedup"](spark, one, SMALL)
    want = {i for i, _, c in groups([(r.doc_id, r.text) for r in one.collect()], 5, 80) if i == c}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want
    three = steps["secret_scan"](spark, two, SMALL)
    assert three.columns == docs.columns and three.count() == two.count()
    assert not three.where(F.col("text").rlike("AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}")).take(1)
    four = steps["curriculum_mix"](spark, three, SMALL)
    assert four.columns == docs.columns
    taken = sum(r.taken for r in mixing.report(three).collect())
    assert sum(size(r.text) for r in four.collect()) == taken
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == four.count() and corpus_pipeline.ORACLE_SQL is None
    assert sorted(r.decoded_sha256 for r in out.collect()) == sorted(r.s for r in four.select(F.sha2("text", 256).alias("s")).collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, long texts, clashing and extra columns, an empty table, through all stages."""
    lines = " ".join(f"w{i}" for i in range(40))
    more = [(20, lines, "en", "a", 1), (21, lines, None, None, None), (20, lines, "en", "a", 1), (None, lines + " more", "en", "b", 2), (22, f"{lines} password=b7db7aa4a5fcc78305 {lines[::-1]}", "en", "b", 3), (None, None, None, None, None)]
    extra = {"size": F.lit("x"), "Row": F.lit(1), "_stats": F.lit(2.0), "ids": F.lit(None).cast("string"), "kept": F.lit(True), "n_tokens": F.lit("old"), "_nth": F.lit(0)}
    docs = spark.createDataFrame([*ODD, *more], SCHEMA).withColumns(extra)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for part in "ab":
        spark.createDataFrame([(20, 1, None), (None, 0, 1), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    place, at = f"{tmp_path}/a", spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, place)
        stages[name] = before, at
        assert name == "byte_bpe" or at.columns == docs.columns
    texts = lambda name: Counter(r.text for r in stages[name][1].collect())
    assert set(texts("quality_rules")) == {t for _, t, *_ in [*ODD, *more] if t and size(t) >= 10 and len(set(t.split())) > 5}
    assert texts("near_dedup")[lines] + texts("near_dedup")[lines + " more"] == 1
    assert all("b7db7aa4a5fcc78305" not in t for t in texts("secret_scan")) and sum(texts("secret_scan").values()) == sum(texts("near_dedup").values())
    mixed = stages["curriculum_mix"][1].select(F.sha2("text", 256).alias("s")).collect()
    out = corpus_pipeline.run(spark, place)
    assert sorted(r.decoded_sha256 for r in out.collect()) == sorted(r.s for r in mixed)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_near_copies_of_the_pipeline_default(spark):
    assert near_dup.one_of_each.__defaults__ == (5, 80)
