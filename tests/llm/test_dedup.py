"""Near-dedup and sentence dedup against brute force."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import components, near_dup, sentence_dedup, superminhash
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent):
    """Smallest id reachable for each row; rows of one id are one node."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sets:
        for x in s:
            index.setdefault(x, []).append((i, s))
    for i, s in sets:
        near = Counter(j for x in s for j, _ in index[x])
        for j, t in {(j, t) for x in s for j, t in index[x] if near[j]}:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in sets]


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_against_brute_force(spark, small, k, percent):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(near_copies(1, 120, 12) + near_copies(2, 40, 4) + near_copies(3, 60, 30))]
    got = near_dup.report(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(groups(rows, k, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_documents(spark, odd, none):
    got = near_dup.report(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 4]
    assert by_id[None].component_id == 6 and not by_id[None].kept
    assert near_dup.report(none).count() == 0
    kept = near_dup.one_of_each(odd.withColumn("node", F.lit(1)).withColumn("_first", F.lit(2)))
    assert kept.columns == [*odd.columns, "node", "_first"] and {r._first for r in kept.collect()} == {2}
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dup.one_of_each(none).count() == 0


def test_one_of_each_without_ids_and_with_repeated_ids(spark):
    a, b, c, d, e = (near_copies(seed, 1, 1)[0] for seed in range(11, 16))
    lone, near = e.split(), d.split()
    near[-1] = "other"
    rows = [(None, a), (1, b), (1, c), (1, b), (None, d), (None, d), (None, " ".join(near)), (None, " ".join(lone)), (2, " ".join([*lone[:-1], "other"])), (None, ""), (None, None), (3, ""), (3, None)]
    kept = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept if r.text not in (d, " ".join(near))) == Counter([rows[i] for i in (0, 1, 2, 8, 9, 10, 11, 12)])
    assert sum(r.text in (d, " ".join(near)) for r in kept) == 1


def test_sets_that_share_half_a_name_are_told_apart(spark, small, monkeypatch):
    rows = lambda: (sorted(map(tuple, near_dup.report(small).collect())), sorted(map(str, near_dup.one_of_each(small).collect())))
    want, whole = rows(), near_dup.signed
    monkeypatch.setattr(near_dup, "signed", lambda docs, k: whole(docs, k).withColumn("node", F.col("node") % 7))
    assert rows() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared, size in ((300, 400), (3, 4), (50, 100), (1, 1), (900, 1000)):
        a, b = pool[:size], np.concatenate([pool[:shared], pool[2000 : 2000 + size - shared]])
        sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size]), 256)
        assert abs((sig[0] == sig[1]).mean() - shared / (2 * size - shared)) < 0.12


def test_signature_of_one_element_by_the_definition():
    """Slow form of the same draws: a full permutation for each element."""
    h = np.array([12345, 99, 7], np.uint64)
    slots = 16
    want = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    for x in h:
        perm = list(range(slots))
        for j in range(slots):
            place, offer = superminhash._draw(np.array([x]), j, slots)
            perm[j], perm[int(place[0])] = perm[int(place[0])], perm[j]
            want[perm[j]] = min(want[perm[j]], offer[0])
    assert (superminhash.signatures(h, np.array([0, 3]), slots)[0] == want).all()


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(4)
    names = [rng.getrandbits(62) for _ in range(300)]
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[i], names[100 + (i + 1) % 100]) for i in range(100, 200)] + [(names[250], names[200 + i]) for i in range(100) if i != 50]
    labels = {r.node: r.label for r in components.contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({labels[n] for n in names[:100]}) == 1
    assert len({labels[n] for n in names[200:300]}) == 1
    assert labels[names[0]] != labels[names[200]]
    assert components.contracted(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentences_join_to_the_text(small):
    for r in small.select("text").collect() + [(t,) for _, t, *_ in ODD if t]:
        assert "".join(sentence_dedup.sentences(r[0])) == r[0]


def sentences_by_hand(text):
    """The same sentences, one character after another."""
    out, begin, i = [], 0, 0
    blank = lambda c: c.isspace()
    while i < len(text):
        j = i
        if text[j] in ".!?":
            while j < len(text) and text[j] in ".!?":
                j += 1
            k = j
            while k < len(text) and blank(text[k]) and text[k] != "\n":
                k += 1
            i = k
            if k > j:
                out.append(text[begin:k])
                begin = k
            continue
        if blank(text[j]):
            while j < len(text) and blank(text[j]):
                j += 1
            if "\n" in text[i:j]:
                out.append(text[begin:j])
                begin = j
            i = j
            continue
        i += 1
    return [*out, text[begin:]] if begin < len(text) else out


def spans_by_hand(text, run, floor, lone):
    parts = [s.strip() for s in sentences_by_hand(text or "")]
    n = [len(p.split()) for p in parts]
    found = set()
    for i in range(len(parts)):
        if n[i] >= lone:
            found.add((i, i + 1))
            continue
        found |= {(i, j) for j in [next((j for j in range(i + run, len(parts) + 1) if sum(n[i:j]) >= floor), None)] if j}
        found |= {(k, i + 1) for k in [next((k for k in range(i + 1 - run, -1, -1) if sum(n[k : i + 1]) >= floor), None)] if k is not None}
    return parts, found


def removed_by_hand(rows, run, floor, lone):
    """For each row its sentences as they are and whether each is removed; rows in order of their ids, equal rows once."""
    first, cover = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts, found = spans_by_hand(t, run, floor, lone)
        cover[d, t] = [False] * len(parts)
        for i, j in sorted(found):
            if first.setdefault(tuple(parts[i:j]), (d, t, i, j)) != (d, t, i, j):
                cover[d, t][i:j] = [True] * (j - i)
    return cover


@pytest.mark.parametrize("run, floor, lone", [(2, 20, 50), (3, 0, 10**9), (2, 0, 50), (4, 30, 10**9)])
def test_spans_against_brute_force(spark, small, run, floor, lone):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    rows += [(r[0], r[1]) for r in rows[:3]] + [(None, "One two three. Four five. Six.\nSeven! Eight nine."), (10**6, "Six.\nSeven! Eight nine. Ten."), (10**6 + 1, "Lead. Six.\nSeven! Eight nine."), (10**6 + 2, None)]
    cover = removed_by_hand(rows, run, floor, lone)
    got = sentence_dedup.deduplicated(spark.createDataFrame([(d, t, d or -1) for d, t in rows], "doc_id long, text string, at long"), run, floor, lone).collect()
    assert len(got) == len(rows)
    texts = {(d if d is not None else -1): t for d, t in rows}
    for r in got:
        d = r.doc_id
        gone = cover[d, texts[-1 if d is None else d]]
        kept = "".join(s for s, x in zip(sentences_by_hand(texts[-1 if d is None else d] or ""), gone, strict=True) if not x)
        assert (r.n_sentences, r.n_removed, r.text or "") == (len(gone), sum(gone), kept)


def test_a_hot_run_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(sentence_dedup, "HOT", 20)
    rows = [(i, f"Line {i} is its own. And nothing else is here at all for {i}.\n" + "Common words stand here. " * 3) for i in range(300)]
    got = {r.doc_id: r for r in sentence_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 2, 0).collect()}
    cover = removed_by_hand(rows, 2, 0, 50)
    assert [got[d].n_removed for d, _ in rows] == [sum(cover[r]) for r in rows]


def test_planted_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (7, 30, 4, 3, 12))
    docs = [(i, "\n".join([*(sentence(9) for _ in range(5)), passage, *(sentence(8) for _ in range(4))])) for i in range(30)]
    out = {r.doc_id: r for r in sentence_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].text == docs[0][1]
    for i in range(1, 30):
        assert out[i].text == docs[i][1].replace(passage + "\n", "")


def test_sentence_dedup_of_odd_rows(odd, none):
    out = sentence_dedup.deduplicated(odd.withColumn("n_sentences", F.lit(1)).withColumn("row", F.lit("k")).withColumn("_Gone", F.lit(0)))
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns == [*odd.columns, "n_sentences", "row", "_Gone", "_n_sentences", "n_removed"]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert sentence_dedup.report(none).count() == 0


def test_only_own_tables_are_deleted(spark, tmp_path):
    from lamina.llm.common import deleted, written

    other, own = f"{tmp_path}/lamina/documents.parquet", written(spark.range(3), "own")
    spark.range(3).write.parquet(other)
    path = own.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    deleted(spark, spark.read.parquet(other), own)
    assert spark.read.parquet(other).count() == 3
    assert not os.path.exists(path)
