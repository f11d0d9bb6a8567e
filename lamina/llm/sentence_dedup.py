"""Substring dedup: sliding spans of sentences.

A sentence ends with a line or with ``.``, ``!`` or ``?`` before white space.  Every run of RUN consecutive sentences is hashed; one of fewer than
SPAN_WORDS words is lengthened until it has them, once by the sentences after it and once by those before it, inside its text.  With a floor of
0 words every run counts as it is.  A sentence of LONE_WORDS words is a run by itself.  Runs depend only on what they hold, so a passage that
repeats has the same runs wherever it stands, and they cover it from its first sentence to its last.

128-bit hashes of runs are joined over the whole table.  The first occurrence, by doc_id and place, stays; sentences inside any other are removed.  A
run so frequent that it holds more than a thousandth of all rows (there are at most HOT such) is dealt to several tasks.

Null texts count as empty.  Rows without doc_id come first.  Rows that repeat id and text are one occurrence and fare alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm.common import bounded, dropped, written
from lamina.llm.text_stats import fresh

RUN, SPAN_WORDS, LONE_WORDS = 2, 20, 50
#: A run's rows go to one task up to this share of all rows: one in HOT.
HOT = 1000
_ENDS = re.compile(r"[.!?]+[^\S\n]+|\s*\n\s*")
_U64 = np.uint64
#: Odd multipliers of the two halves of a run's hash.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def sentences(text: str) -> list[str]:
    """The sentences with the white space after them; joined they are the text."""
    cuts = [m.end() for m in _ENDS.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if text else []


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=_U64)


def _keys(h: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run from its sentences' hashes: a polynomial, by differences of prefix sums."""
    n = len(h)
    if not n:
        return np.zeros(0, _U64)
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(h * _powers(base, n), dtype=_U64)])
    inverse = pow(base, -1, 1 << 64)
    return at.mix((total[stop] - total[start]) * _powers(inverse, n)[start] ^ at.mix((stop - start).astype(_U64)))


def spans(texts: list[str], run: int = RUN, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> tuple[np.ndarray, ...]:
    """(text, first sentence, end, first half and second half of the hash) of every run."""
    parts = [sentences(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    doc_begin = np.cumsum(counts) - counts
    n = int(counts.sum())
    flat = [s.strip() for p in parts for s in p]
    digests = b"".join(xxhash.xxh3_128_digest(s) for s in flat)
    halves = np.frombuffer(digests, _U64).reshape(n, 2)
    words = np.fromiter((len(s.split()) for s in flat), np.int64, n)
    before = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(texts)), counts)
    i = np.arange(n)
    lone = words >= lone_words
    ahead = np.where(lone, i + 1, np.maximum(np.searchsorted(before, before[i] + span_words), i + run))
    end = i + 1
    back = np.minimum(np.searchsorted(before, before[end] - span_words, side="right") - 1, end - run)
    fits_ahead = ahead <= (doc_begin + counts)[doc]
    fits_back = (back >= doc_begin[doc]) & ~lone
    start = np.concatenate([i[fits_ahead], back[fits_back]])
    stop = np.concatenate([ahead[fits_ahead], end[fits_back]])
    both = np.unique(start << 32 | stop)
    start, stop = both >> 32, both & 0xFFFFFFFF
    owner = doc[start]
    return owner, start - doc_begin[owner], stop - doc_begin[owner], *(_keys(at.mix(halves[:, k]), base, start, stop) for k, base in enumerate(_BASES))


def spanned(docs: DataFrame, run: int = RUN, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """(k1, k2, doc_id, row, place): every run's hash, its row's id and hash, and its first sentence and end packed into one number."""
    bounded(docs.sparkSession)

    def runs(batches):
        for batch in batches:
            owner, start, stop, k1, k2 = spans(at.column(batch, "text").to_pylist(), run, span_words, lone_words)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(start << 32 | stop)], names=["k1", "k2", "doc_id", "row", "place"]
            )

    return docs.select(F.col("doc_id").cast("long"), "row", "text").mapInArrow(runs, "k1 long, k2 long, doc_id long, row long, place long")


def repeats(found: DataFrame) -> DataFrame:
    """The rows of found, but for the first of each run's.

    Runs that occur once leave after a partial aggregate; rows of a hot run and copies of its first occurrence are dealt by place."""
    occurrence = F.struct("doc_id", "row", "place")
    firsts = written(found.groupBy("k1", "k2").agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    least = max(2, found.count() // HOT)
    hot = F.broadcast(firsts.where(F.col("n") > least).select("k1", "k2", F.ceil(F.col("n") / least).cast("int").alias("parts")))  # at most HOT rows
    dealt = found.join(hot, ["k1", "k2"], "left").withColumn("part", F.pmod(F.xxhash64("row", "place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > least, F.ceil(F.col("n") / least).cast("int")).otherwise(1) - 1))).drop("n")
    return dealt.join(copies, ["k1", "k2", "part"]).where(~occurrence.eqNullSafe(F.col("first"))).select("doc_id", "row", "place")


def deduplicated(documents: DataFrame, run: int = RUN, span_words: int = SPAN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """documents with their columns, text without its repeated spans, and n_sentences, n_removed as the last two columns.

    Where documents have columns of these names, the new ones get underscores before theirs."""
    names = documents.columns
    row, id_name, gone_name, n_name, r_name = (fresh(documents, c) for c in ("_row", "_id", "_gone", "n_sentences", "n_removed"))
    docs = documents.withColumn(row, F.xxhash64("doc_id", "text")).withColumn(id_name, F.col("doc_id").cast("long"))
    found = written(spanned(docs.select(F.col(id_name).alias("doc_id"), F.col(row).alias("row"), "text"), run, span_words, lone_words), "spans")
    gone = written(repeats(found).groupBy("doc_id", "row").agg(F.collect_set("place").alias(gone_name)), "gone")
    dropped(documents.sparkSession, found)
    gone = gone.withColumnsRenamed({"doc_id": "_its_id", "row": "_its_row"})

    def rest(batches):
        for batch in batches:
            texts, gone = batch.column("text"), batch.column(gone_name).to_pylist()
            out, n, removed = texts.to_pylist(), [], []
            for i, t in enumerate(out):
                parts = sentences(t or "")
                n.append(len(parts))
                cover = np.zeros(len(parts) + 1, np.int64)
                for p in gone[i] or ():
                    cover[p >> 32] += 1
                    cover[p & 0xFFFFFFFF] -= 1
                inside = np.cumsum(cover[:-1]) > 0
                removed.append(int(inside.sum()))
                if removed[-1]:
                    out[i] = "".join(s for s, x in zip(parts, inside, strict=True) if not x)
            columns = [pa.array(out, pa.string()) if name == "text" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_name, r_name])

    same = docs[row].eqNullSafe(gone["_its_row"]) & docs[id_name].eqNullSafe(gone["_its_id"])
    joined = docs.join(gone, same, "left").select(*(docs[c] for c in names), gone[gone_name])
    counts = [T.StructField(n_name, T.LongType()), T.StructField(r_name, T.LongType())]
    return joined.mapInArrow(rest, T.StructType([*documents.schema.fields, *counts]))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, one row for each row of documents."""
    return deduplicated(documents.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")
