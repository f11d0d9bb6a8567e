"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, grouping by union-find.

1. One narrow pass over the texts gives each row its set size, a 128-bit name of its shingle set, band keys and a short signature.
2. Rows with one set are one class, so a thousand copies weigh as much as one text from here on.  Half of the name, the node, stands for it;
   sets that share a node but not the other half get nodes of their own first.
3. Classes that share a band key are candidates.  In each bucket the class with the most company over all its buckets is the pivot,
   and every other member is checked against it alone: as many checks as members.
4. Where a bucket still holds two components, its other members are compared inside tasks, block against block: by signature first, then on
   full sets, and only as long as two members' components differ.  A task gives back the links that join components, fewer than it has
   members.
5. Links are contracted to components in tables; a class hands its component to all its rows.

No bucket is cut, no pair is dropped for a size, and no task holds more than two blocks of a bucket.  At a Jaccard similarity equal to the
threshold the bands miss a pair with probability under 0.0001; every link that is made is exact up to 64-bit hashes of
shingles, of which a chance match in one pair moves its count by one.

Null and empty texts, and texts without words, have the empty set and link with nothing.  In ``report`` rows that repeat a doc_id are one
document for links made by any of them, and a row without doc_id takes part through classes that also hold an id; its component is null
otherwise.  ``one_of_each`` looks at texts alone: ids, repeated or null, neither link rows nor keep them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm import superminhash
from lamina.llm.common import bounded, bounded_broadcast, deleted, dropped, trimmed, written
from lamina.llm.components import contracted
from lamina.llm.text_stats import fresh

BANDS, ROWS = 25, 5
#: Members of a bucket and bytes of their sets in a block; margin below the threshold that an estimate from signatures may have.
BLOCK, BLOCK_BYTES, MARGIN = 4096, 8 << 20, 0.15
_U64 = np.uint64


#: What elements are mixed with for the two halves of a set's name.
_HALVES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _name(elements: np.ndarray, offsets: np.ndarray, half: int = 0) -> np.ndarray:
    """64 of the 128 bits of each set's name, which does not depend on order."""
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(at.mix(elements ^ _U64(_HALVES[half])), dtype=_U64)])
    return at.mix((total[offsets[1:]] - total[offsets[:-1]]) ^ at.mix(np.diff(offsets).astype(_U64)))


def _row() -> Column:
    """A 128-bit name of a row by its doc_id, null or not, and its text."""
    text = F.col("text").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.when(text.isNull(), F.lit("-")).otherwise(F.lit(":")), F.coalesce(text, F.lit("")))))


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row (its name), n_shingles, node and other (the halves of the set's name; node is null if it is empty), keys (of its bands), sig (two bytes for each slot)."""
    bounded(docs.sparkSession)
    slots = BANDS * ROWS

    def run(batches):
        for batch in batches:
            elements, offsets = at.shingle_sets(at.column(batch, "text"), k)
            size = np.diff(offsets)
            some = size > 0
            sig = superminhash.signatures(elements, offsets, slots)
            keys = superminhash.band_keys(sig, ROWS).view(np.int64)
            short = (sig ^ (sig >> _U64(32))).astype(np.uint16)
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(size), pa.array(_name(elements, offsets).view(np.int64), mask=~some), pa.array(_name(elements, offsets, 1).view(np.int64)), lists, pa.array([r.tobytes() for r in short], pa.binary())],
                names=["doc_id", "row", "n_shingles", "node", "other", "keys", "sig"],
            )
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), _row().alias("row"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row binary, n_shingles long, node long, other long, keys array<long>, sig binary")


def told_apart(rows: DataFrame) -> DataFrame:
    """The signed rows; sets that share a node and differ in the other half of their names get nodes by both halves."""
    while (clashes := rows.where("node is not null").groupBy("node").agg(F.min("other").alias("_a"), F.max("other").alias("_b")).where("_a != _b")).take(1):
        own = F.when(F.col("_a").isNotNull(), F.xxhash64("node", "other")).otherwise(F.col("node"))
        old, rows = rows, written(rows.join(clashes, "node", "left").withColumn("node", own).select(*rows.columns), "signatures")
        deleted(rows.sparkSession, old)
    return rows


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, elements) for the wanted (node, other, row): sorted shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            elements, offsets = at.shingle_sets(at.column(batch, "text"), k)
            right = np.flatnonzero(_name(elements, offsets, 1).view(np.int64) == np.asarray(batch.column("other")))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(right)), pa.array([elements[offsets[i] : offsets[i + 1]].tobytes() for i in right], pa.binary())], names=["node", "elements"])
        trimmed()

    wanted = bounded_broadcast(nodes, nodes.count())
    found = docs.select(_row().alias("row"), "text").join(wanted, "row").select("node", "other", "text")
    return found.mapInArrow(run, "node long, elements binary").groupBy("node").agg(F.first("elements").alias("elements"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * size of the intersection >= percent * size of the union, on full sets."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("_x", "_y"))
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = n + m - len(np.unique(np.concatenate([np.frombuffer(x, _U64), np.frombuffer(y, _U64)])))
                if 100 * both >= percent * (n + m - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    x, y = sets.select(F.col("node").alias("a"), F.col("elements").alias("_x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("_y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _rest(open_members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components which still meet in a bucket: enough of them to join all that belong together.

    A bucket's members lie in blocks of bounded bytes; a task compares two blocks at a time.  A pair is looked at in the first bucket that it
    shares, if its components differ so far and its signatures come near the threshold, and then on full sets."""
    rows = open_members.join(sigs, "node").join(sets, "node").select("key", "node", "label", "sig", "keys", "elements")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.sum(F.octet_length("elements")) / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i: both sides go to the cell (i, j)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "sig", "keys", "elements")
    need = BANDS * ROWS * (percent / 100 - MARGIN)

    def run(key, group):
        key, i, j = (k.as_py() for k in key)
        block, node, label = (np.asarray(group.column(c)) for c in ("block", "node", "label"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
        keys = np.asarray(group.column("keys").combine_chunks().flatten()).reshape(len(node), -1)
        raw = group.column("elements").to_pylist()
        sets_: dict[int, frozenset] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        def elements(x: int) -> frozenset:
            if x not in sets_:
                sets_[x] = frozenset(np.frombuffer(raw[x], _U64).tolist())
            return sets_[x]

        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        for x in left:
            y = right[(label[right] != label[x]) & ((node[right] > node[x]) if i == j else True)]
            same = (sig[y] == sig[x]).sum(1)
            y, same = y[same >= need], same[same >= need]
            shared = keys[y] == keys[x]
            mine = keys[x][shared.argmax(1)] == key
            for z in y[mine][np.argsort(-same[mine], kind="stable")]:
                a, b = root(int(label[x])), root(int(label[z]))
                if a != b:
                    s, t = elements(x), elements(z)
                    both = len(s & t)
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        parent[max(a, b)] = min(a, b)
                        found_a.append(node[x])
                        found_b.append(node[z])
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _first() -> Column:
    """Of some rows the one with the smallest doc_id, those without one last, then the smallest name."""
    return F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row"))


def _labelled(documents: DataFrame, k: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, their nodes (node, doc_id, keys) and the labels (node, label) of linked nodes.

    by_id: rows that share a doc_id are linked, and nodes without any doc_id are not."""
    spark = documents.sparkSession
    held = "node is not null and doc_id is not null" if by_id else "node is not null"
    rows = told_apart(written(signed(documents, k), "signatures"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(exploded.join(buckets, "key").select("key", "node", "size"), "members")
    # the pivot: most company over all buckets
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "node").select("key", "node", F.struct("company", "node").alias("rank"))
    pivots = ranked.groupBy("key").agg(F.max("rank")["node"].alias("pivot"))
    unranked, members = members, written(members.join(pivots, "key").select("key", "node", "pivot"), "members")
    wanted = rows.where(held).groupBy("node").agg(F.first("other").alias("other"), _first()["row"].alias("row")).join(members.select("node").distinct(), "node", "left_semi")
    sets = written(full_sets(documents, wanted, k), "sets")
    stars = members.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = linked = written(verified(stars, sets, percent), "links")
    if by_id:
        same = rows.where(held).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).where("a != b")
        links = links.unionByName(same.select("a", F.explode("all").alias("b")))
    labels = contracted(links)

    labelled = members.where("node != pivot").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    open_members = written(labelled.join(open_keys, "key"), "open")
    if open_members.take(1):
        sigs = rows.join(open_members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        more = written(_rest(open_members, sigs, sets, percent), "links")
        if more.take(1):
            deleted(spark, labels)
            labels = contracted(links.unionByName(more))
        deleted(spark, more)
    dropped(spark, unranked, members, sets, linked, open_members)
    return rows, nodes, labels


def classes(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, node, component_id (the smallest doc_id reachable)."""
    rows, nodes, labels = _labelled(documents, k, percent, by_id=True)
    smallest = nodes.select("node", "doc_id").join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("_least"))
    grouped = labels.join(smallest, "label").select("node", "_least")
    alone = nodes.select("node", F.col("doc_id").alias("_own"))
    of_node = alone.join(grouped, "node", "left").select("node", F.coalesce("_least", "_own").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def report(documents: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is component_id), one row for each row of documents."""
    return classes(documents, k, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents without near copies: of each group of texts one row stays, that with the smallest doc_id, or any if none has one.

    Rows that link with nothing all stay, with or without doc_id, and so do all rows with the empty set."""
    rows, _, labels = _labelled(documents, k, percent, by_id=False)
    firsts = rows.where("node is not null").groupBy("node").agg(_first().alias("first")).join(labels, "node", "left")
    firsts = firsts.groupBy(F.coalesce("label", "node")).agg(F.min("first")["row"].alias("row")).select("row", F.lit(False).alias("empty"))
    kept = written(firsts.unionByName(rows.where("node is null").select("row", F.lit(True).alias("empty")).distinct()), "kept")
    row, empty, nth = (fresh(documents, c) for c in ("_row", "_empty", "_nth"))
    ids = bounded_broadcast(kept.select(F.col("row").alias(row), F.col("empty").alias(empty)), kept.count())
    stays = documents.withColumn(row, _row()).join(ids, row)
    repeats = rows.where("node is not null").groupBy("row").count().where("count > 1").join(kept, "row", "left_semi").limit(1)
    if repeats.take(1):
        first = Window.partitionBy(row).orderBy(F.xxhash64(*documents.columns))
        once = stays.where(~F.col(empty)).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
        stays = once.unionByName(stays.where(F.col(empty)))
    return stays.select(*documents.columns)
