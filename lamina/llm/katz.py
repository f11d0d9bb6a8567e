"""LM scoring: a Katz backoff model of words, with Good-Turing discounts and exactly normalised backoff weights, of any order from 2.

P(w | h) = d(c) c(h w) / c(h) if c(h w) > 0, else alpha(h) P(w | h'), where h' is h without its first word; P(w) = d'(c) c(w) / N if c(w) > 0, else what
is left, for the one class of unknown words.  alpha(h) makes the sum over all V known words and the unknown class exactly 1.  Each level's discounts
come from its counts of counts up to K; where those are too thin for a factor in (0, 1], it is (r - 1/2) / r.  A context that would leave no mass
gets one count more.  A text begins after one mark, which stands for all words before it, so its first words have shorter contexts.

Counting and scoring move no row per token.  Texts are coded once into blocks of some million tokens, a table in the shared folder.  For
each level a block sends the distinct n-grams it holds, with its own training counts, in one row for each bucket of the key space; a bucket adds up
what all blocks sent, keeps its part of the model as a row of a table, and answers every block with totals in the order of the
block's question.  An n-gram that was seen has an id, by which the next level names it as a context.  A context that is very frequent is dealt to several
buckets by its next word, and its sums are joined again, so no bucket grows with a hot word.  Blocks then evaluate their tokens by recursion: the longest
context first, backing off level by level where an n-gram was not seen.

A level's table has a row for each bucket with its contexts, the length of each one's run of words, the words and the counts; ``ngrams`` gives a row
for each n-gram.  Ids and counts have 64 bits.  Everything is counted over all training rows.  Null texts count as empty: they have one token, the end.
Rows with a null doc_id train; rows that repeat count each; only doc_id and text are read, so other columns may have any names.  Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamina.llm import arrow_text as at
from lamina.llm.common import bounded, dropped, held_out, trimmed, written

#: Rows whose crc32(doc_id as text) mod FOLDS is 2 are held out.  Tokens of a block and, on average, of a bucket; counts up to K are discounted.
FOLDS, BLOCK_TOKENS, BUCKET_TOKENS, K = 7, 1_000_000, 1_500_000, 5
#: Rows of a file of blocks: a reader holds a file's rows at once.
BLOCKS_PER_FILE = 4
END = np.uint64(0x454E44)
_U64 = np.uint64
BEGIN_ID, UNKNOWN_ID = _U64((1 << 64) - 2), _U64((1 << 64) - 1)
#: Words of an n-gram.
ORDER = 2


def _bytes(a: np.ndarray, kind) -> bytes:
    """The numbers by byte planes, all lowest bytes first, compressed: small numbers leave whole planes of zeros."""
    a = np.ascontiguousarray(a.astype(kind))
    if not len(a):
        return b""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    planes = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    """One column of several rows, end to end."""
    return np.concatenate([np.zeros(0, kind), *(_numbers(r[name], kind) for r in rows)])


# --- texts to blocks

BLOCKS = "block long, tokens long, doc_ids array<long>, held binary, lengths binary, codes binary, words binary"


def coded(documents: DataFrame) -> DataFrame:
    """Blocks of whole documents: each document's number of tokens, its tokens as codes, and the block's words as 64-bit hashes by code.

    Codes go by frequency, so most are small."""
    bounded(documents.sparkSession)

    def run(batches):
        part, n, held = TaskContext.get().partitionId(), 0, []
        size = 0
        for batch in batches:
            flat, offsets = at.words(at.column(batch, "text"), lower=True)
            code, distinct = at.coded(flat)
            held.append((batch.column("doc_id").to_pylist(), np.asarray(batch.column("held")), np.diff(offsets), at.hashes(distinct)[code] if len(code) else np.zeros(0, _U64)))
            size += len(code) + batch.num_rows
            if size >= BLOCK_TOKENS:
                yield _block((part << 24) + n, held)
                n, held, size = n + 1, [], 0
        if held:
            yield _block((part << 24) + n, held)
        trimmed()

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), FOLDS).alias("held"))
    return rows.mapInArrow(run, BLOCKS)


def _block(name: int, parts: list[tuple]) -> pa.RecordBatch:
    ids = [i for p in parts for i in p[0]]
    held, counts, words = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    lengths = counts + 1
    stream = np.full(lengths.sum(), END, _U64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(stream), bool)
    inner[ends] = False
    stream[inner] = words
    distinct, codes, often = np.unique(stream, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct, codes = distinct[order], rank[codes]
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([name], pa.int64()), "tokens": pa.array([len(stream)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": [_bytes(held, np.uint8)], "lengths": [_bytes(lengths, np.int32)], "codes": [_bytes(codes, np.uint32)], "words": [_bytes(distinct, _U64)]}
    )


# --- level 1: words


def _bucket_edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins among sorted 64-bit values; buckets are ranges of the upper 32 bits."""
    return np.searchsorted((values >> _U64(32)).astype(np.int64), (np.arange(buckets + 1) << 32) // buckets)


def word_questions(blocks: DataFrame, buckets: int) -> DataFrame:
    """One row for each block and bucket: the block's words there and their counts in its training documents."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, codes = _numbers(r["words"], _U64), _numbers(r["codes"], np.uint32)
                train = np.repeat(_numbers(r["held"], np.uint8) == 0, _numbers(r["lengths"], np.int32))
                order = np.argsort(words)
                counts, words = np.bincount(codes[train], minlength=len(words))[order], words[order]
                edges = _bucket_edges(words, buckets)
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array(some, pa.int32()), "block": pa.array([r["block"]] * len(some), pa.int64()), "words": [_bytes(words[edges[b] : edges[b + 1]], _U64) for b in some], "counts": [_bytes(counts[edges[b] : edges[b + 1]], _U64) for b in some]}
                )

    return blocks.select("block", "held", "lengths", "codes", "words").mapInArrow(run, "bucket int, block long, words binary, counts binary")


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(1, K + 2)]


WORD_MODEL = "bucket int, words array<long>, counts array<long>, known long, tokens long, coc array<long>, answers array<struct<block:long,counts:binary,ids:binary>>"


def _ids(counts: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """An id for each n-gram of a bucket that was seen: its rank by count, times the number of buckets, plus the bucket, so frequent ones have small ids."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return np.where(counts > 0, (rank * buckets + bucket).astype(_U64), UNKNOWN_ID)


def _totals(inverse: np.ndarray, parts: list[np.ndarray], n: int) -> np.ndarray:
    """The sums of the parts' counts by distinct n-gram, in 64 bits."""
    out = np.zeros(n, np.int64)
    np.add.at(out, inverse, np.concatenate([np.zeros(0, np.int64), *(p.astype(np.int64) for p in parts)]))
    return out


def word_model(questions: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket: its words with their counts over all blocks, and the answers."""

    schema = _arrow(WORD_MODEL)

    def run(key, group):
        bucket, parts = key[0].as_py(), [_numbers(w, _U64) for w in group.column("words").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        counts = _totals(inverse, [_numbers(c, np.uint64) for c in group.column("counts").to_pylist()], len(distinct))
        ids = _ids(counts, bucket, buckets)
        cuts = np.cumsum([0, *map(len, parts)])
        answers = [{"block": b, "counts": _bytes(counts[inverse[i:j]], _U64), "ids": _bytes(ids[inverse[i:j]], _U64)} for b, i, j in zip(group.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_pydict(
            {"bucket": [bucket], "words": [distinct.view(np.int64)], "counts": [counts], "known": [int((counts > 0).sum())], "tokens": [int(counts.sum())], "coc": [_counts_of_counts(counts)], "answers": [answers]}, schema=schema
        )

    return questions.groupBy("bucket").applyInArrow(run, WORD_MODEL)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def discounts(coc: list[int]) -> np.ndarray:
    """Katz's factors for counts 0..K; index 0 is unused."""
    d = np.ones(K + 1)
    n = [0, *coc]
    if n[1]:
        top = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else -1.0
            d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for each count."""
    return counts * d[np.where(counts <= K, counts, 0)] if len(counts) else counts.astype(float)


class Words:
    """What level 1 needs beside the counts: N, V, discounts, and the probability of the unknown class."""

    def __init__(self, known: int, tokens: int, coc: list[int]):
        self.known, self.tokens, self.d = known, tokens, discounts(coc)
        self.d[0] = 1.0
        low = sum(r * n for r, n in enumerate(coc[:K], 1))
        mass = sum(self.d[r] * r * n for r, n in enumerate(coc[:K], 1)) + tokens - low
        self.total = tokens if mass < tokens else tokens + 1
        self.unknown = 1 - mass / self.total if self.total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word by its count; all uncounted words are one class."""
        return np.where(counts > 0, discounted(counts, self.d) / max(self.total, 1), self.unknown)


# --- levels from 2: contexts and words

#: A block between levels.  By code: counts and ids of its words; by level from 2 and n-gram of the block: counts, and of its context what scoring needs;
#: ids of the last level's n-grams, to name contexts of the next.
LEVELS = "block long, doc_ids array<long>, held binary, lengths binary, codes binary, word_counts binary, word_ids binary, counts array<binary>, below array<binary>, alpha array<binary>, ids binary"


def enriched(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """Blocks with each word's id and count instead of its hash."""
    answers = model.select("bucket", F.explode("answers").alias("a")).select("bucket", "a.block", "a.counts", "a.ids")
    schema = _arrow(LEVELS)

    def run(left, right):
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        order = np.argsort(_numbers(left.column("words")[0].as_py(), _U64))
        found = {}
        for name in ("counts", "ids"):
            by_code = np.empty(len(order), _U64)
            by_code[order] = _joined(rows, name, _U64)
            found[name] = _bytes(by_code, _U64)
        kept = left.select(["block", "doc_ids", "held", "lengths", "codes"]).to_pydict()
        return pa.Table.from_pydict(kept | {"word_counts": [found["counts"]], "word_ids": [found["ids"]], "counts": [[]], "below": [[]], "alpha": [[]], "ids": [b""]}, schema=schema)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, LEVELS)


class Grams:
    """A block's distinct n-grams of one level, built on those of the level below.

    They are numbered inside the block, by context and word; ``gram`` is each token's number, -1 where the context was never seen in training or
    would reach beyond the beginning.  Questions and answers go by ``order``: by bucket, and inside it by context."""

    def __init__(self, r: dict):
        self.r, self.n = r, 1
        self.lengths, self.codes = _numbers(r["lengths"], np.int32), _numbers(r["codes"], np.uint32).astype(np.int64)
        self.word_ids, self.word_counts = _numbers(r["word_ids"], _U64), _numbers(r["word_counts"], _U64).astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(_numbers(r["held"], np.uint8) == 0, self.lengths)
        self.gram, self.ids, self.counts, self.below = self.codes, self.word_ids, self.word_counts, None

    def level(self, buckets: int) -> Grams:
        """The next level: its n-grams, and where they are asked for."""
        self.n += 1
        context = np.full(len(self.codes), -1, np.int64)
        context[1:] = self.gram[:-1]
        context[self.begin] = len(self.ids) if self.n == 2 else -1
        every_id, often = np.append(self.ids, BEGIN_ID), self.counts
        # every text begins once and ends once, and ends are counted as a word
        often = np.append(often, self.word_counts[self.codes[self.begin + self.lengths - 1]][:1] if len(self.begin) else [0])
        self.asked = (context >= 0) & (every_id[context] != UNKNOWN_ID)
        key, self.inverse = np.unique(context[self.asked] << 32 | self.codes[self.asked], return_inverse=True)
        first, word = key >> 32, key & 0xFFFFFFFF
        self.context, self.word = every_id[first], self.word_ids[word]
        # the n-gram without its first word, one level below: of a context that was seen, so it was asked for there
        one = np.zeros(len(key), np.int64)
        one[self.inverse] = np.flatnonzero(self.asked)
        shorter = self.gram[one] if self.n > 2 else word
        self.lower_counts = self.counts[shorter]
        self.lower_below = self.below[shorter] if self.below is not None else np.zeros(len(key))
        salts = 1 + often[first] // BUCKET_TOKENS
        self.hot = salts > 1
        salt = at.mix(self.word) % salts.astype(_U64)
        bucket = (at.mix(self.context + at.mix(salt)) % _U64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        new = np.ones(len(key), bool)
        ordered = first[self.order]
        new[1:] = ordered[1:] != ordered[:-1]
        new[self.edges[:-1][self.edges[:-1] < self.edges[1:]]] = True
        self.starts = np.flatnonzero(new)
        self.run_of = np.cumsum(new) - 1
        return self

    def known(self, counts: np.ndarray, below: np.ndarray, alpha: np.ndarray, ids: np.ndarray | None) -> Grams:
        """Takes the level's values by n-gram; contexts of the next level are named by ids."""
        self.gram = np.full(len(self.codes), -1, np.int64)
        self.gram[self.asked] = self.inverse
        self.counts, self.below, self.alpha, self.ids = counts.astype(np.int64), below, alpha, ids
        return self

    def answered(self, rows: list[dict]) -> dict[str, np.ndarray]:
        """The buckets' answers, by n-gram."""
        rows = sorted(rows, key=lambda a: a["bucket"])
        out = {}
        for name, kind in (("counts", _U64), ("ids", _U64), ("below", float), ("alpha", float)):
            given = _joined(rows, name, kind)
            if name in ("below", "alpha"):
                given = given[self.run_of]
            by_gram = np.zeros(len(self.order), kind)
            by_gram[self.order] = given if len(given) == len(self.order) else 0
            out[name] = by_gram
        return out

    def stored(self, buckets: int) -> Grams:
        """All levels of which the block holds values; the last one's ids name contexts."""
        levels = len(self.r["counts"])
        for i in range(levels):
            self.level(buckets)
            counts = _numbers(self.r["counts"][i], _U64)
            ids = _numbers(self.r["ids"], _U64) if i == levels - 1 else np.where(counts > 0, _U64(0), UNKNOWN_ID)
            self.known(counts, _numbers(self.r["below"][i], float), _numbers(self.r["alpha"][i], float), ids)
        return self


QUESTIONS = "bucket int, block long, contexts binary, runs binary, words binary, counts binary, lower_counts binary, lower_below binary, hot binary"


def questions(blocks: DataFrame, buckets: int) -> DataFrame:
    """The next level's questions, one row for each block and bucket: contexts, the length of each one's run of words, the words, their training counts in the
    block, and the counts and denominators that give each one's probability one level below."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                g = Grams(r).stored(buckets).level(buckets)
                counts = np.bincount(g.inverse[g.train[g.asked]], minlength=len(g.order))
                out = {name: [] for name in ("contexts", "runs", "words", "counts", "lower_counts", "lower_below", "hot")}
                some = np.flatnonzero(np.diff(g.edges))
                for b in some:
                    i, j = g.edges[b], g.edges[b + 1]
                    here = g.order[i:j]
                    start = g.starts[np.searchsorted(g.starts, i) : np.searchsorted(g.starts, j)]
                    firsts = g.order[start]
                    out["contexts"].append(_bytes(g.context[firsts], _U64))
                    out["runs"].append(_bytes(np.diff(np.append(start, j)), np.uint32))
                    out["words"].append(_bytes(g.word[here], _U64))
                    out["counts"].append(_bytes(counts[here], _U64))
                    out["lower_counts"].append(_bytes(g.lower_counts[here], _U64))
                    # all n-grams of a context have one denominator below
                    out["lower_below"].append(_bytes(g.lower_below[firsts], float) if g.n > 2 else b"")
                    out["hot"].append(_bytes(g.hot[firsts], np.uint8))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "block": pa.array([r["block"]] * len(some), pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})
        trimmed()

    return blocks.select("block", "held", "lengths", "codes", "word_counts", "word_ids", "counts", "below", "alpha", "ids").mapInArrow(run, QUESTIONS)


SUMS = ["total", *(f"n{r}" for r in range(1, K + 1)), "high", "mass"]
MODEL = (
    "bucket int, contexts array<long>, runs array<int>, words array<long>, counts array<long>, sums binary, coc array<long>, "
    f"hot array<struct<context:long,at:int,{','.join(f'{s}:double' for s in SUMS)}>>, answers array<struct<block:long,counts:binary,contexts:binary,unseen:binary,ids:binary>>"
)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers: an index of each distinct pair, in order, where each context's run begins among them, and each pair's place."""
    order = np.lexsort((second, first)) if max(first.max(initial=0), second.max(initial=0)) >> _U64(32) else np.argsort(first << _U64(32) | second, kind="stable")
    a, b = first[order], second[order]
    run = np.ones(len(order), bool)
    run[1:] = a[1:] != a[:-1]
    new = run.copy()
    new[1:] |= b[1:] != b[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], np.flatnonzero(run[new]), inverse


def gram_model(asked: DataFrame, words: Words, below_d: np.ndarray | None, buckets: int, more: bool) -> DataFrame:
    """One row for each bucket: its contexts and n-grams with counts over all blocks, what backing off needs of each context, and the answers.

    below_d: discounts of the level below, if that is not the words'; more: ids of n-grams are needed for a next level."""
    schema = _arrow(MODEL)

    def run(key, group):
        bucket, rows = key[0].as_py(), group.to_pylist()
        contexts, runs = ([_numbers(r[name], kind) for r in rows] for name, kind in (("contexts", _U64), ("runs", np.uint32)))
        spread = lambda values: np.concatenate([np.repeat(v, n) for v, n in zip(values, runs, strict=True)])
        one, start, inverse = _distinct(spread(contexts), _joined(rows, "words", _U64))
        counts = _totals(inverse, [_numbers(r["counts"], _U64) for r in rows], len(one))
        lower = _joined(rows, "lower_counts", _U64).astype(np.int64)[one]
        if below_d is None:
            p = words.p(lower)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                p = discounted(lower, below_d) / spread([_numbers(r["lower_below"], float) for r in rows])[one]
        add = lambda v: np.add.reduceat(v, start).astype(float)
        seen = counts > 0
        sums = np.stack([add(counts), *(add((counts == r).astype(np.int64)) for r in range(1, K + 1)), add(np.where(counts > K, counts, 0)), add(np.where(seen, p, 0.0))])
        names = spread(contexts)[one][start]
        hot = np.unique(np.concatenate([c[_numbers(r["hot"], np.uint8) > 0] for c, r in zip(contexts, rows, strict=True)]))
        places = np.searchsorted(names, hot)
        ids = _ids(counts, bucket, buckets) if more else None
        cuts = np.cumsum([0, *(int(n.sum()) for n in runs)])
        answers = []
        for r, c, n, i, j in zip(rows, contexts, runs, cuts[:-1], cuts[1:], strict=True):
            mine, n = counts[inverse[i:j]], n.astype(np.int64)
            unseen = np.logical_or.reduceat(mine == 0, np.cumsum(n) - n)
            answers.append({"block": r["block"], "counts": _bytes(mine, _U64), "contexts": _bytes(np.searchsorted(names, c), np.uint32), "unseen": _bytes(unseen, np.uint8), "ids": _bytes(ids[inverse[i:j]], _U64) if more else b""})
        # n-grams that no block saw in training are asked for, but are none of the model's
        kept = np.add.reduceat(seen.astype(np.int64), start)
        return pa.Table.from_pydict(
            {"bucket": [bucket], "contexts": [names[kept > 0].view(np.int64)], "runs": [kept[kept > 0].astype(np.int32)], "words": [_joined(rows, "words", _U64)[one][seen].view(np.int64)], "counts": [counts[seen]], "sums": [_bytes(sums.ravel(), float)],
             "coc": [_counts_of_counts(counts)], "hot": [[{"context": int(h.view(np.int64)), "at": int(q)} | {s: float(v) for s, v in zip(SUMS, sums[:, q], strict=True)} for h, q in zip(hot, places, strict=True)]], "answers": [answers]},
            schema=schema,
        )

    return asked.groupBy("bucket").applyInArrow(run, MODEL)


def ngrams(model: DataFrame) -> DataFrame:
    """(context, word, count): a row for each n-gram of a level's table.  context: the id of its words but the last, -2 for the begin; word: the last one's id."""
    ends = F.expr("transform(runs, (n, i) -> aggregate(slice(runs, 1, i + 1), 0, (a, x) -> a + x))")
    by_context = model.select("words", "counts", F.explode(F.arrays_zip("contexts", "runs", ends.alias("ends"))).alias("c"))
    part = lambda name: F.slice(name, F.col("c.ends") - F.col("c.runs") + 1, F.col("c.runs"))
    rows = by_context.select(F.col("c.contexts").alias("context"), F.explode(F.arrays_zip(part("words").alias("word"), part("counts").alias("count"))).alias("g"))
    return rows.select("context", "g.word", "g.count")


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, log10 alpha) of contexts from their sums over seen words: exactly what makes each one's probabilities add up to 1."""
    total, by_count, high, mass = sums[0], sums[1 : K + 1], sums[K + 1], sums[K + 2]
    kept = (by_count * (np.arange(1, K + 1) * d[1:])[:, None]).sum(0) + high
    below = np.where(kept < total * (1 - 1e-12), total, total + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.log10((1 - kept / below) / (1 - mass))
    return below, alpha


def answers(model: DataFrame, d: np.ndarray) -> DataFrame:
    """(bucket, block, counts and ids of the n-grams asked, and for each context asked the denominator and, where an n-gram was not seen, log10 alpha)."""
    parts = model.select("bucket", F.explode("hot").alias("h")).select("bucket", "h.*")
    whole = parts.groupBy("context").agg(*(F.sum(s).alias(s) for s in SUMS))
    joined = parts.select("bucket", "context", "at").join(whole, "context").groupBy("bucket").agg(F.collect_list(F.struct("at", *SUMS)).alias("whole"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sums = _numbers(r["sums"], float).reshape(len(SUMS), -1).copy()
                for h in r["whole"] or []:
                    sums[:, h["at"]] = [h[s] for s in SUMS]
                below, alpha = backoff(sums, d)
                out = {"counts": [], "ids": [], "below": [], "alpha": []}
                for a in r["answers"]:
                    at_ = _numbers(a["contexts"], np.uint32)
                    out["counts"].append(a["counts"])
                    out["ids"].append(a["ids"])
                    out["below"].append(_bytes(below[at_], float))
                    out["alpha"].append(_bytes(np.where(_numbers(a["unseen"], np.uint8) > 0, alpha[at_], 0.0), float))
                names = [a["block"] for a in r["answers"]]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"]] * len(names), pa.int32()), "block": pa.array(names, pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    rows = model.select("bucket", "sums", "answers").join(joined, "bucket", "left").select("bucket", "sums", "answers", "whole")
    return rows.mapInArrow(run, "bucket int, block long, counts binary, ids binary, below binary, alpha binary")


def with_level(blocks: DataFrame, given: DataFrame, buckets: int) -> DataFrame:
    """Blocks with one more level's values."""
    schema = _arrow(LEVELS)

    def run(left, right):
        r = left.to_pylist()[0]
        found = Grams(r).stored(buckets).level(buckets).answered(right.to_pylist())
        r["counts"], r["below"], r["alpha"] = [*r["counts"], _bytes(found["counts"], _U64)], [*r["below"], _bytes(found["below"], float)], [*r["alpha"], _bytes(found["alpha"], float)]
        r["ids"] = _bytes(found["ids"], _U64)
        return pa.Table.from_pylist([r], schema=schema)

    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, LEVELS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(blocks: DataFrame, given: DataFrame, words: Words, ds: list[np.ndarray], buckets: int) -> DataFrame:
    """Every token by recursion over the levels.  given: the last level's answers; ds: discounts by level from 2."""

    def log_p(g: Grams, lower: np.ndarray, d: np.ndarray, counts: np.ndarray, below: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """log10 of each token's probability at a level: its n-gram's if that was seen, else alpha times that of the level below, else, of a context
        that was never seen, the latter alone."""
        out = lower.copy()
        mine = g.inverse
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.log10(discounted(counts.astype(np.int64), d) / below)
        out[g.asked] = np.where(counts[mine] > 0, own[mine], alpha[mine] + lower[g.asked])
        return out

    def run(left, right):
        r = left.to_pylist()[0]
        g = Grams(r)
        count = g.word_counts[g.codes]
        base = np.log10((count + 1) / (words.tokens + words.known + 1))
        token = np.log10(words.p(count))
        levels = len(r["counts"])
        for i in range(levels + 1):
            g.level(buckets)
            if i < levels:
                found = {"counts": _numbers(r["counts"][i], _U64), "below": _numbers(r["below"][i], float), "alpha": _numbers(r["alpha"][i], float)}
                found["ids"] = _numbers(r["ids"], _U64) if i == levels - 1 else np.where(found["counts"] > 0, _U64(0), UNKNOWN_ID)
            else:
                found = g.answered(right.to_pylist())
            token = log_p(g, token, ds[i], found["counts"], found["below"], found["alpha"])
            g.known(found["counts"], found["below"], found["alpha"], found["ids"])
        add = lambda v: np.add.reduceat(v, g.begin)
        n = len(g.lengths)
        return pa.table(
            {"doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": _numbers(r["held"], np.uint8) > 0, "n_tokens": g.lengths.astype(np.int64), "n_known": add((count > 0).astype(np.int64)), "train_tokens": np.full(n, words.tokens, np.int64), "base_score": add(base), "score": add(token)}
        )

    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, SCORES)


def _level_discounts(model: DataFrame) -> np.ndarray:
    d = discounts([int(x or 0) for x in model.select(*(F.sum(F.col("coc")[r]) for r in range(K + 1))).first()])
    d[0] = 1.0
    return d


def scored(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  order: words of the longest n-grams, 2 or more."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = documents.sparkSession
    blocks = written(coded(documents), "blocks", BLOCKS_PER_FILE)
    n = blocks.select(F.sum("tokens")).first()[0] or 0
    buckets = max(8, math.ceil(n / BUCKET_TOKENS))
    unigrams = written(word_model(word_questions(blocks, buckets), buckets), "words", BLOCKS_PER_FILE)
    known, tokens, *coc = (int(x or 0) for x in unigrams.select(F.sum("known"), F.sum("tokens"), *(F.sum(F.col("coc")[r]) for r in range(K + 1))).first())
    words = Words(known, tokens, coc)
    full = written(enriched(blocks, unigrams), "blocks", BLOCKS_PER_FILE)
    dropped(spark, blocks, unigrams)
    ds: list[np.ndarray] = []
    for level in range(2, order + 1):
        model = written(gram_model(questions(full, buckets), words, ds[-1] if ds else None, buckets, level < order), "grams", BLOCKS_PER_FILE)
        dropped(spark)
        ds.append(_level_discounts(model))
        given = answers(model, ds[-1])
        if level < order:
            below, full = full, written(with_level(full, given, buckets), "blocks", BLOCKS_PER_FILE)
            dropped(spark, below, model)
    return scores(full, given, words, ds, buckets)


def report(documents: DataFrame) -> DataFrame:
    """The scores by the model of order ORDER."""
    return scored(documents)
