"""Statistics, the additive model and the decision list."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lamina.llm import additive_model, decision_list, labelled
from lamina.llm.text_stats import statistics
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics_against_brute_force(small):
    texts = [r[0] for r in small.select("text").collect()] + [r[1] or "" for r in ODD]
    s = statistics(pa.array(texts, pa.large_string()))
    got = list(zip(*(s[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [base(t) for t in texts]


def test_rules_report(small, labels):
    out = {r.doc_id: r for r in decision_list.report(small, labels).collect()}
    rows = small.collect()
    assert len(out) == len(rows)
    for r in rows:
        b, o = base(r.text), out[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == b
        assert o.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert o.kept == (not o.base_failed and o.rule == 0)


def shares(text):
    """The features by the definition, one text at a time."""
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, dup, repeat = base(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(c.isascii() and c.isalpha() for c in text)
    per, count = max(n, 1), lambda test: sum(map(test, words))
    return (
        math.log1p(n), symbols / per, text.count("!") / per, sum("A" <= c <= "Z" for c in text) / max(letters, 1), sum("0" <= c <= "9" for c in text) / max(chars, 1), dup / max(len(lines), 1), repeat / per, len(set(words)) / per, chars / per,
        count(lambda w: w[-1] in ".,;:?") / per, sum(a == b for a, b in zip(words, words[1:], strict=False)) / per, words.count("|") / per, n / max(len(lines), 1),
    )


def training_rows(documents, labels):
    """(features, label) of the rows that may train, in the order that the sample has."""
    ids = documents.join(labels, "doc_id").where("quality is not null").select("doc_id", "text", "quality", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r.h, r.doc_id, shares(r.text), r.quality) for r in ids if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    return np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def slow_rules(x, y, cuts=256):
    """Sequential covering with every threshold tried by counting; lists of (feature, at least, threshold)."""
    bad, n = y == 0, len(x)
    prune, left, out = np.arange(n) % 3 == 2, np.ones(n, bool), []

    def covered(rule):
        hit = np.ones(n, bool)
        for j, at_least, t in rule:
            hit &= (x[:, j] >= t) if at_least else (x[:, j] <= t)
        return hit

    def grown(inside):
        best, found = 1e-9, None
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        for j in range(x.shape[1]):
            values = sorted(x[inside, j])
            steps = [i for i in range(1, len(values)) if values[i] > values[i - 1]]
            if len(steps) > cuts:
                steps = [steps[int(k)] for k in np.linspace(0, len(steps) - 1, cuts)]
            for at_least in (False, True):
                for i in steps:
                    t = (values[i - 1] + values[i]) / 2
                    hit = inside & ((x[:, j] >= values[i]) if at_least else (x[:, j] < values[i]))
                    p, m = int((hit & bad).sum()), int(hit.sum())
                    gain = p * (math.log2(p / m) - math.log2(p0 / (p0 + n0))) if p else -1.0
                    if gain > best + 1e-9:
                        best, found = gain, (j, at_least, t)
        return found

    while len(out) < 24 and (bad & left & ~prune).any():
        rule = []
        while len(rule) < 4 and (~bad & left & ~prune & covered(rule)).any() and (c := grown(left & ~prune & covered(rule))):
            rule.append(c)
        check = left & prune if (left & prune & bad).any() else left & ~prune

        def score(r, check=check):
            p, m = int((check & covered(r) & bad).sum()), int((check & covered(r) & ~bad).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and score(rule[:-1]) >= score(rule):
            rule.pop()
        p, m = int((check & covered(rule) & bad).sum()), int((check & covered(rule) & ~bad).sum())
        if not rule or p == 0 or p < 0.95 * (p + m) or (bad & left & covered(rule)).sum() < 2:
            break
        out.append(rule)
        left &= ~covered(rule)
    return out


def test_verdicts_against_a_slow_learner(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = slow_rules(*training_rows(documents, marks))
    assert rules
    got = {r.doc_id: r for r in decision_list.report(documents, marks).collect()}
    for r in documents.select("doc_id", "text").collect():
        v, b = shares(r.text), base(r.text)
        fired = any(all(v[j] >= t if at_least else v[j] <= t for j, at_least, t in rule) for rule in rules)
        assert got[r.doc_id].kept == (not (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not fired)


def slow_tree(i, g, h, depth):
    """Values by bin of a tree over the bins i, every cut tried by adding up both sides."""
    total = lambda i: (sum(g[k] for k in i), sum(h[k] for k in i) + additive_model.L2)
    worth = lambda i: total(i)[0] ** 2 / total(i)[1]
    if depth and len(i) > 1:
        gains = [worth(i[:k]) + worth(i[k:]) for k in range(1, len(i))]
        k = gains.index(max(gains)) + 1
        if gains[k - 1] > worth(i) + 1e-12:
            return slow_tree(i[:k], g, h, depth - 1) | slow_tree(i[k:], g, h, depth - 1)
    return {k: total(i)[0] / total(i)[1] for k in i}


def test_trees_against_all_cuts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 9, 20):
        g, h = rng.normal(size=n), rng.random(n)
        want = slow_tree(list(range(n)), g, h, 2)
        assert np.allclose(additive_model._shallow_tree(g, h), [want[k] for k in range(n)])
    for a, b in ((2, 2), (3, 5), (8, 8)):
        g, h = rng.normal(size=(a, b)), rng.random((a, b))
        best = (-1.0, None)
        for i in range(1, a):
            for j in range(1, b):
                cells = [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
                gain = sum(g[c].sum() ** 2 / (h[c].sum() + additive_model.L2) for c in cells)
                if gain > best[0] + 1e-12:
                    table = np.empty((a, b))
                    for c in cells:
                        table[c] = g[c].sum() / (h[c].sum() + additive_model.L2)
                    best = gain, table
        gain, table = additive_model._quadrants(g, h)
        assert np.allclose(table, best[1]) and abs(gain - (best[0] - g.sum() ** 2 / (h.sum() + additive_model.L2))) < 1e-9


def test_scores_against_brute_force(spark):
    """The report's scores, from features of one text after another, a model of the same rows, and its tables read cell by cell."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = additive_model.fit(*training_rows(documents, marks))
    cell = lambda edges, v: sum(v >= e for e in edges)
    got = {r.doc_id: r for r in additive_model.report(documents, marks).collect()}
    for r in documents.select("doc_id", "text").collect():
        v = shares(r.text)
        z = model.intercept + sum(t[cell(e, v[j])] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        z += sum(t[cell(model.pair_edges[a], v[a]), cell(model.pair_edges[b], v[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        o = got[r.doc_id]
        assert abs(o.score - 1 / (1 + math.exp(-z))) < 1e-6
        assert o.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and o.predicted == (o.score >= 0.7)


def test_rules_learn_a_planted_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(labelled.FEATURES)))
    y = 1 - ((x[:, 1] > 0.7) & (x[:, 4] < 0.4)).astype(int)
    rules = decision_list.learn(x, y)
    assert (rules.rejects(x) == (y == 0)).mean() > 0.98
    assert decision_list.learn(x, np.ones(3000, int)).rules == []
    assert decision_list.learn(x[:0], y[:0]).rules == []


def test_rules_and_expression_agree(spark, small, labels):
    rules = decision_list.fitted(small, labels)
    rows = decision_list.verdicts(small.select("doc_id", "text"), rules).select("_stats.*", "rule").toPandas()
    fired = rules.rejects(rows[list(labelled.FEATURES)].to_numpy())
    assert (fired == (rows["rule"].to_numpy() > 0)).all()


def test_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(int)
    model = additive_model.fit(x[:4000], y[:4000])
    assert (0, 2) in model.pairs
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9
    assert additive_model.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_scores_hold_out(spark, labels):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = additive_model.report(documents, marks).join(marks, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert len(good) and len(bad)
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    changed = marks.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality)"))
    again = additive_model.report(documents, changed).orderBy("doc_id").collect()
    assert again == additive_model.report(documents, marks).orderBy("doc_id").collect()


def test_odd_rows(odd, none, labels, no_labels):
    for documents, n in ((odd, len(ODD)), (none, 0)):
        for marks in (labels, no_labels):
            scored = additive_model.report(documents, marks).collect()
            assert len(scored) == n
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
            assert decision_list.report(documents, marks).count() == n
    again = additive_model.scored(odd.withColumn("Score", F.lit(5)), additive_model.fit(*labelled.sample(odd, no_labels)))
    assert again.columns == [*odd.columns, "Score", "_score"] and {r._score for r in again.collect()} == {0.5}
    kept = decision_list.filtered(odd.withColumn("_stats", F.lit(1)).withColumn("Kept", F.lit("x")).withColumn("rule", F.lit(2)), no_labels)
    assert kept.columns == [*odd.columns, "_stats", "Kept", "rule"]
    assert {r.doc_id for r in kept.collect()} == {6, None, 9} - ({9} if base(ODD[-1][1])[0] < 10 else set())
