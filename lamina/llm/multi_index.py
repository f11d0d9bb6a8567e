"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Codes: vectors are extended to one length, which turns the largest inner product into the smallest angle, centred and projected to their
principal axes; iterative quantisation then learns as many rotations as make BITS bits; each brings the axes near the corners of the cube, and signs give the bits.  A
code is split into m substrings of equal length, and each has its own table from values to rows.

Search: two codes within Hamming radius r agree within floor(r / m) bits in one of m substrings, and in the first r mod m + 1 substrings
that bound suffices, one less for the others.  Probing those values, by listing them or by running through the table's own values where those
are fewer, finds every code within r.  Only the rows probed have their whole codes compared, and only those within r their vectors, in double
precision; ``n_probed`` and ``n_compared`` count them for each query.  A query's radius is the one within which a share of a bounded sample lies, and
the split is the one that handles the fewest words of codes on that sample.  Queries that find too few rows search again without a radius.

The index is fitted on at most SAMPLE vectors, those of smallest hashed ids, and holds every row.  Codes and radii are worked out once for each
row.  Rows lie in blocks, queries in chunks, and a task meets one of each; it sends on only its best for each query.  Vectors that are null, zero,
of another length than most, or hold a null or non-finite component take no part, nor do rows without vec_id.  Rows that repeat a vec_id are
candidates each; the id asks once, by its least vector, and none of its own rows answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import bounded, written

SAMPLE, BITS, UNIT, ITERATIONS = 8192, 512, 16, 30
#: Rows of the index in a block, queries in a chunk, queries that probe at once.
BLOCK_ROWS, CHUNK_QUERIES, STEP = 8192, 32768, 32
#: Share of the rows within a query's radius, and how many at least; bits added for the sample's error.
SHARE, LEAST, SLACK = 0.03, 200, 1
#: Substrings are this many units of 16 bits; values within so many bits are listed, of short substrings only.
SPLITS, LISTED = (1, 2, 4, 8, 16), 2


@dataclass
class Codes:
    """Learned codes: what turns vectors into words of 64 bits."""

    longest: float
    mean: np.ndarray
    axes: np.ndarray

    def bits(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        full = np.column_stack([x * (self.longest / np.maximum(np.sqrt((x * x).sum(1)), 1e-300))[:, None] if query else x, rest])
        return (full - self.mean) @ self.axes > 0

    def words(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes by column in units of 16 bits."""
        return np.packbits(self.bits(x, query), axis=1, bitorder="little").view(np.uint16)


def fit(x: np.ndarray, longest: float, bits: int = BITS, seed: int = 5) -> Codes:
    """x: a sample of vectors; longest: the largest length in the whole table."""
    rng = np.random.default_rng(seed)
    full = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))])
    mean = full.mean(0)
    _, _, vt = np.linalg.svd(full - mean, full_matrices=False)
    width = max(UNIT, full.shape[1] // UNIT * UNIT)
    out = []
    for _ in range(-(-bits // width)):
        # fewer dimensions than bits: random directions give the rest
        more = rng.normal(size=(full.shape[1], max(0, width - len(vt))))
        axes = np.column_stack([vt[:width].T, more])
        v = (full - mean) @ axes
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return Codes(longest, mean, np.column_stack(out))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[-1] % 4 == 0:
        a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def radii(codes: np.ndarray, sample: np.ndarray, share: float) -> np.ndarray:
    """For each code the radius within which the share of the sample lies."""
    k = min(len(sample) - 1, int(np.ceil(share * len(sample))))
    return np.array([np.partition(_distance(sample, c), k)[k] + SLACK for c in codes], np.int32)


def ball(bits: int) -> np.ndarray:
    """Masks of all 16-bit words with so many ones or fewer, the fewest first."""
    every = np.arange(1 << UNIT, dtype=np.uint32).astype(np.uint16)
    ones = np.bitwise_count(every)
    return every[np.argsort(ones, kind="stable")][: int((ones <= bits).sum())]


class Index:
    """Tables from substring values to rows for one block; units: the length of a substring in units of 16 bits."""

    def __init__(self, codes: np.ndarray, units: int = 1):
        self.codes, self.units, self.m = codes, units, codes.shape[1] // units
        self.values, self.place = zip(*(np.unique(self._part(codes, s), return_inverse=True) for s in range(self.m)), strict=True)

    def _part(self, codes: np.ndarray, s: int) -> np.ndarray:
        part = np.ascontiguousarray(codes[:, s * self.units : (s + 1) * self.units])
        return part[:, 0] if self.units == 1 else part.view(np.dtype((np.void, 2 * self.units)))[:, 0]

    def probed(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """True for each query (row) and code (column) with a substring so near that the whole may be within the query's radius."""
        found = np.zeros((len(queries), len(self.codes)), bool)
        for s in range(self.m):
            limit = radius // self.m - (s > radius % self.m)
            found |= self._probe(s, queries, limit)[:, self.place[s]]
        return found

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every code within its query's radius: among the rows probed, whose whole codes are compared."""
        q, row = np.nonzero(self.probed(queries, radius))
        near = _distance(queries[q], self.codes[row]) <= radius[q]
        return q[near], row[near]

    def _probe(self, s: int, queries: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which of the table's values lie within each query's limit."""
        wanted, values = self._part(queries, s), self.values[s]
        out = np.zeros((len(queries), len(values)), bool)
        masks = ball(min(LISTED, max(int(limit.max(initial=-1)), 0))) if self.units == 1 else np.zeros(0, np.uint16)
        listed = (limit <= LISTED) & (len(values) > len(masks)) if self.units == 1 else np.zeros(len(queries), bool)
        run = np.flatnonzero(~listed & (limit >= 0))
        if len(run):
            out[run] = _between(wanted[run], values, self.units) <= limit[run, None]
        for i in np.flatnonzero(listed & (limit >= 0)):
            probes = wanted[i] ^ masks[np.bitwise_count(masks) <= limit[i]]
            at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            out[i, at[values[at] == probes]] = True
        return out


def _between(a: np.ndarray, b: np.ndarray, units: int) -> np.ndarray:
    """Distances of all substrings of a from all of b."""
    kind = {1: np.uint16, 2: np.uint32}.get(units, np.uint64)
    a, b = (np.ascontiguousarray(x).view(kind).reshape(len(x), -1) for x in (a, b))
    far = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        far += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return far


def split_of(sample: np.ndarray, queries: np.ndarray, radius: np.ndarray, rows: int) -> int:
    """The length of substrings, in units, that handles the fewest words of codes in a block of so many rows, measured on the sample."""
    width = sample.shape[1]
    costs = {}
    for units in SPLITS:
        if width % units or width // units < 2:
            continue
        m = width // units
        limit = int(radius.max()) // m
        table = len(ball(limit)) if units == 1 and limit <= LISTED else min(rows, 1 << 16) if units == 1 else rows
        costs[units] = table * width / 4 + 4 * Index(sample, units).probed(queries, radius).mean() * rows * width / 4
    return min(costs, key=costs.get, default=1)


def usable(vector: Column) -> Column:
    """True for vectors that take part, but for their length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


CELLS = "query_id long, vec_id long, score double, n_probed long, n_compared long"
EMPTY = pa.schema([(c, pa.float64() if c == "score" else pa.int64()) for c in ("query_id", "vec_id", "score", "n_probed", "n_compared")]).empty_table()


def _cell(k: int, units: int):
    """A task's work: the chunk's queries probe the block's tables; for each query one row of counts and its best rows."""

    def run(left, right):
        ids, q_ids = np.asarray(left.column("id")), np.asarray(right.column("id"))
        out = [EMPTY]
        if len(ids) and len(q_ids):
            order = np.argsort(ids, kind="stable")
            ids, x, q = ids[order], _matrix(left.column("v"))[order], _matrix(right.column("v"))
            index, q_codes, radius = Index(_codes(left)[order], units), _codes(right), np.asarray(right.column("radius"))
            for at in range(0, len(q_ids), STEP):
                here = slice(at, at + STEP)
                probed = index.probed(q_codes[here], radius[here]) & (q_ids[here, None] != ids[None, :])
                i, j = np.nonzero(probed)
                near = _distance(q_codes[here][i], index.codes[j]) <= radius[here][i]
                i, j = i[near], j[near]
                out.append(pa.table({"query_id": q_ids[here], "vec_id": pa.nulls(len(probed), pa.int64()), "score": pa.nulls(len(probed), pa.float64()), "n_probed": probed.sum(1), "n_compared": np.bincount(i, minlength=len(probed))}))
                score = np.einsum("ij,ij->i", q[here][i], x[j])
                best = np.lexsort((j, -score, i))
                i, j, score = i[best], j[best], score[best]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                none = pa.nulls(int(top.sum()), pa.int64())
                out.append(pa.table({"query_id": q_ids[here][i[top]], "vec_id": ids[j[top]], "score": score[top], "n_probed": none, "n_compared": none}))
        return pa.concat_tables(out)

    return run


def _codes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint16).reshape(table.num_rows, -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query id the k rows with the largest inner product that are found, never its own; then n_probed and
    n_compared, the rows whose codes and whose vectors were compared for the query."""
    spark = bounded(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_probed long, n_compared long")
    v = v.where(F.size("v") == common["n"])
    n, wanted, longest = v.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    sample = _matrix(v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v"))
    codes = fit(sample, float(np.sqrt(longest)))
    sample_codes = codes.words(sample)
    share = min(1.0, max(share, LEAST / n))
    tried = codes.words(sample[:STEP], query=True)
    units = split_of(sample_codes, tried, radii(tried, sample_codes, share), min(n, BLOCK_ROWS))
    blocks, chunks = -(-n // BLOCK_ROWS), max(1, -(-wanted // CHUNK_QUERIES))

    def coded(query: bool):
        def run(batches):
            for batch in batches:
                words = codes.words(_matrix(batch.column("v")), query) if batch.num_rows else np.zeros((0, 1), np.uint16)
                out = {"id": batch.column("id"), "v": batch.column("v"), "code": pa.array([w.tobytes() for w in words], pa.binary())}
                if query:
                    out["radius"] = radii(words, sample_codes, share)
                yield pa.RecordBatch.from_pydict(out)

        return run

    kind = v.schema["v"].dataType.simpleString()
    rows = v.select("id", "v").mapInArrow(coded(False), f"id long, v {kind}, code binary")
    queries = v.where("q").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(coded(True), f"id long, v {kind}, code binary, radius int")

    def found(asked: DataFrame) -> DataFrame:
        left = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_cell(k, units), CELLS)

    def ranked(cells: DataFrame) -> DataFrame:
        best = cells.where("vec_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        counts = cells.where("vec_id is null").groupBy("query_id").agg(F.sum("n_probed").alias("n_probed"), F.sum("n_compared").alias("n_compared"))
        return best.select("query_id", "rank", "vec_id", "score").join(counts, "query_id")

    first = written(found(queries), "cells")
    enough = first.groupBy("query_id").agg(F.count("vec_id").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    few = written(queries.join(enough, "id", "left_anti").withColumn("radius", F.lit(UNIT * sample_codes.shape[1])), "few")
    if not few.take(1):
        return ranked(first)
    return ranked(first.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(found(few)))


def report(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return search(embeddings, F.col("vec_id") % 20 == 0)
