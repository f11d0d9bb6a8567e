"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then twice, of which the faster counts.  Results go to Spark's noop sink, so nothing is cut off by a limit.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "group_by_composite", "group_by_first_seen", "group_by_sequence_key", "group_adjacent", "group_starting_with", "fork_multi_agg", "fork_groupings", "fold_left_running", "parent_positional_agg",
    "key_lookup", "general_comparison_any", "last_seen_lookup", "merge_named_groups", "chained_predicates", "position_global", "number_multiple", "accumulator_before_after", "iterate_break",
    "top_k_per_group", "rules_priority", "rules_next_match", "tokenize_count", "regex_analyze_string", "json_props", "axes_descendant", "result_documents", "stream_watchers", "stream_group_adjacent",
]


def identity_copy(spark, folder: str, n: int = 1_000_000):
    """Reads n elements by row tag and writes them again."""
    from pyspark.sql import functions as F

    from lamina.sources import readers, sinks

    source = f"{folder}/items"
    if not os.path.exists(source):
        spark.range(n).select(F.col("id").alias("_id"), F.concat(F.lit("v"), "id").alias("_VALUE")).repartition(8).write.format("xml").option("rowTag", "item").option("rootTag", "items").save(source)
    out = f"{folder}/copy"
    shutil.rmtree(out, ignore_errors=True)
    rows = readers.xml(spark, source, "item", "_id long, _VALUE string")
    sinks.write(rows, out, sinks.Output("xml"), "item", "items")


def report_over_schema(spark, folder: str, types: int = 12_000):
    """Types of a schema with their number of elements and whether they own something, from 10 MB of XML."""
    from pyspark.sql import functions as F

    from lamina.sources import readers

    source = f"{folder}/types"
    if not os.path.exists(source):
        element = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(F.concat(F.when(i == 1, "Owner").otherwise("Element"), i.cast("string")).alias("_name"), F.lit("xs:string").alias("_type"), F.lit(0).alias("_minOccurs")))
        spark.range(types).select(F.concat(F.lit("Type"), "id").alias("_name"), element.alias("element")).repartition(8).write.format("xml").option("rowTag", "complexType").save(source)
    rows = readers.xml(spark, source, "complexType", "_name string, element array<struct<_name:string,_type:string,_minOccurs:int>>")
    out = rows.select("_name", F.size("element").alias("n"), F.exists("element", lambda e: e["_name"].startswith("Owner")).alias("owned"))
    out.write.format("noop").mode("overwrite").save()


def main() -> None:
    from lamina.plans.registry import QUERIES
    from lamina.session import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="lamina-bench-")
    runs = {name: (lambda q=QUERIES[name]: q(spark, folder).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    runs["identity_copy_1m_items"] = lambda: identity_copy(spark, scratch)
    runs["report_over_10mb_schema"] = lambda: report_over_schema(spark, scratch)
    took: dict[str, float] = {}
    try:
        for name, run in runs.items():
            times = []
            for _ in range(3):
                began = time.perf_counter()
                with contextlib.redirect_stdout(sys.stderr):
                    run()
                times.append(time.perf_counter() - began)
            took[name] = round(min(times[1:]), 3)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
