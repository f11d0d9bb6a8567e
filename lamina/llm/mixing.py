"""Mixing sources to target weights: a time-varying curriculum.

Sizes are counted in words.  Each source's target is its share of all words by weight, at most a multiple of what it holds; what lies above
is shared again by weight until no target is above its limit.  A source's weight changes over training time t in [0, 1]:
w(t) = 1 + slope * (2 t - 1), so its integral, the cumulative demand, is D(t) = (1 - slope) t + slope t^2, a share of its target.
A document's words lie in one stretch of its source's stream of words, in the order of hashed ids; inverting the demand at the stretch's
middle gives its training position, and a range sort by position gives the order of training.

The stream runs over the source again and again until the target is reached: all documents once for each full pass, then those at the
stream's start once more; the document at the very end gives only its first words.  So taken words equal the target, rounded to words.

Prefix sums run in two levels, by (source, slice of the hash range) and then inside a slice, so no task holds a whole source; there are as many slices as
the number of rows asks for, and they change no result.  Targets are worked out on the driver for up to DRIVER_SOURCES sources, and for more in
tables, by the same rounds.  Null texts have size 0 and take nothing; a null source is a source of its own, last in order.  Columns of documents
may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import written
from lamina.operators.sequence import with_position

WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3
#: Sources whose targets the driver works out; more are worked out in tables.
DRIVER_SOURCES = 200_000
#: Leading hex digits of a row's hash that name its slice: three, or as many as leave about so many rows in a slice of one source.
LEAST_DIGITS, SLICE_ROWS = 3, 50_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> dict[str | None, float]:
    """Targets by source.  Weights repeat along the sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    held, out, left = dict(order), {}, float(sum(n for _, n in order))
    open_ = [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit * held[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(limit * held[s])
        left = left - sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def slopes(n: int) -> list[float]:
    """How each source's weight changes over time: rising, level and falling sources in turn."""
    return [(0.5, 0.0, -0.5)[i % 3] for i in range(n)]


def demand_inverse(share: Column, slope: Column) -> Column:
    """The time t at which a source's cumulative demand (1 - a) t + a t^2 reaches the share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(F.greatest(b * b + 4 * slope * share, F.lit(0.0))) - b) / (2 * slope))


def order_hash() -> Column:
    """A row's place in its source's stream: a hash of id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


KNOWN = "source string, source_size long, target double, _goal long, _slope double"


def _known(totals: DataFrame, weights: tuple[float, ...], limit: int) -> DataFrame:
    """(source, source_size, target, _goal, _slope) of sources with their sizes n."""
    spark = totals.sparkSession
    first = totals.limit(DRIVER_SOURCES + 1).collect()
    if len(first) > DRIVER_SOURCES:
        return many_targets(totals, weights, limit)
    held = {r["source"]: int(r["n"]) for r in first}
    by_source = targets(list(held.items()), weights, limit)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    return F.broadcast(spark.createDataFrame([(s, held[s], by_source[s], math.floor(by_source[s] + 0.5), a) for s, a in zip(order, slopes(len(order)), strict=True)], KNOWN))


def many_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The same for any number of sources: every round of sharing is one aggregate over a table of sources, and writes the next one."""
    ordered = with_position(totals.withColumn("_null", F.isnull("source").cast("int")), ["_null", "source"], None, "_at")
    among = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.col("_at") - 1) % len(values) + 1).cast("int"))
    rows = written(ordered.select("source", F.col("n").alias("source_size"), among(weights).alias("_w"), among(slopes(3)).alias("_slope"), F.lit(None).cast("double").alias("target")), "sources")
    while True:
        left, total = rows.agg(F.sum("source_size") - F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(F.col("target").isNull(), F.col("_w")))).first()
        if total is None:
            break
        share = F.lit(float(left)) * F.col("_w") / F.lit(float(total))
        over = F.col("target").isNull() & (share > limit * F.col("source_size"))
        if not rows.where(over).take(1):
            rows = rows.withColumn("target", F.coalesce("target", share))
            break
        rows = written(rows.withColumn("target", F.when(over, limit * F.col("source_size").cast("double")).otherwise(F.col("target"))), "sources")
    return rows.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).alias("_goal"), "_slope")


def plan(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, whole: bool = False) -> DataFrame:
    """One row for each row of documents: doc_id, size, source_size, target, taken, position (null if nothing is taken), and what they come from.

    whole: the row itself goes along as a struct _row."""
    row = [F.struct(*documents.columns).alias("_row")] if whole else []
    kept = ["_row"] if whole else []
    sized = documents.select("doc_id", "source", size_of(F.col("text")).alias("size"), order_hash().alias("_h"), *row)
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(documents.count(), 1) / SLICE_ROWS, 16)))
    sized = sized.withColumn("_slice", F.substring("_h", 1, digits))
    slices = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    slices = slices.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    known = _known(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, limit)
    slices = slices.join(known, slices["source"].eqNullSafe(known["source"])).drop(known["source"])
    joined = sized.alias("d").join(slices.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._slice") == F.col("s._slice")))
    joined = joined.select("d.doc_id", "d.size", "d._h", "d.source", "d._slice", F.coalesce("s._before", F.lit(0)).alias("_before"), "s.source_size", "s.target", "s._goal", "s._slope", *kept)
    inside = Window.partitionBy("source", "_slice").orderBy("_h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    full, rest = F.expr("_goal div greatest(source_size, 1)"), F.expr("_goal % greatest(source_size, 1)")
    out = joined.withColumn("_at", begin)
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_at")))
    out = out.withColumn("taken", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("size") * full + extra))
    # the first pass's stretch of the stream, cut at the goal
    first = F.least(F.col("size"), F.col("taken"))
    share = (F.col("_at") + first / 2) / F.greatest(F.col("_goal"), F.lit(1))
    position = F.when(F.col("taken") > 0, demand_inverse(F.least(share, F.lit(1.0)), F.col("_slope")))
    return out.withColumn("position", position).select("doc_id", "size", "source_size", "target", "taken", "position", "_h", "_at", "_goal", "_slope", *kept)


def report(documents: DataFrame) -> DataFrame:
    """The plan, range-sorted by training position."""
    out = plan(documents).withColumns({"target": F.round("target", 6), "position": F.round("position", 9)})
    return out.orderBy(F.col("position").asc_nulls_last(), "_h", "doc_id").drop("_h", "_at", "_goal", "_slope")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, a row for each time, in order of training; the last of a source may hold only its first words.

    A row's second and third passes stand later in its source's stream, so they have positions of their own."""
    columns = documents.columns
    taken = plan(documents, whole=True).where("taken > 0")
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size")))
    rows = taken.withColumn("_pass", again).withColumn("_words", F.expr("least(size, taken - _pass * size)"))
    share = (F.col("_pass") * F.col("source_size") + F.col("_at") + F.col("_words") / 2) / F.greatest("_goal", F.lit(1))
    rows = rows.withColumn("_position", demand_inverse(F.least(share, F.lit(1.0)), F.col("_slope")))
    text = F.when(F.col("_words") < F.col("size"), first_words(F.col("_row.text"), F.col("_words"))).otherwise(F.col("_row.text"))
    out = {c: F.col("_row")[c] for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_words") < F.col("size"), F.length(text)).otherwise(F.col("_row.n_chars")).cast(documents.schema["n_chars"].dataType)
    return rows.orderBy("_position", "_h", "_pass").select(*(out[c].alias(c) for c in columns))
