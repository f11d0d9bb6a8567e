"""Streams beyond the first ones, what a plan's analysis says, results handed over, and components of queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import dates, udf, values
from lamina.operators import grouping as G
from lamina.operators import joins as J
from lamina.operators import merge as M
from lamina.operators import messages, rules
from lamina.operators import templates as P
from lamina.operators import windows as W
from lamina.plans.registry import Tables, query
from lamina.plans.streams import _events
from lamina.session import shared_folder
from lamina.sources import readers, sinks
from lamina.streaming import analysis as Y
from lamina.streaming import stateful as Z

# --- streams

_STARTS = """with c as (select *, case when {0} or row_number() over w = 1 then 1 else 0 end as change from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(change) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from c)
select user_id, grp::bigint as grp, count(*)::bigint as n from g group by user_id, grp"""


@query(_STARTS.format("event_type = 'purchase'"))
def stream_group_starting_with(t: Tables) -> DataFrame:
    """A group begins with each purchase; the open group is there too."""
    rows = _events(t).select("event_id", "ts", "user_id", "event_type")
    out = Z.run_now(Z.runs(rows, "user_id", ["ts", "event_id"], lambda _, row: row.event_type == "purchase", lambda row: (row.event_type,), ("",), "kind string"))
    return out.groupBy("user_id", "grp").agg(F.max("n").alias("n"))


@query(_STARTS.format("lag(event_type) over w = 'purchase'"))
def stream_group_ending_with(t: Tables) -> DataFrame:
    """A group ends with each purchase; the open group is there too."""
    rows = _events(t).select("event_id", "ts", "user_id", "event_type")
    out = Z.run_now(Z.runs(rows, "user_id", ["ts", "event_id"], lambda marks, _: marks[0] == "purchase", lambda row: (row.event_type,), ("",), "kind string"))
    return out.groupBy("user_id", "grp").agg(F.max("n").alias("n"))


@query("""select o_orderpriority as priority, count(*)::bigint as n, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P' group by 1""")
def stream_climbing(t: Tables) -> DataFrame:
    """What a leaf's ancestor says is joined to the leaf as it streams, then filtered and grouped by."""
    lines = Z.file_stream(t.spark, t.folder, "lineitem").select("l_orderkey", "l_quantity")
    above = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    counted = Z.watchers(lines.join(above, "l_orderkey"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), within=["priority"])
    return Z.run_now(counted, "complete")


@query("""select user_id, count(*) filter (event_type = 'view')::bigint as n_views, count(*) filter (event_type = 'purchase')::bigint as n_purchases from events where event_type in ('view', 'purchase') group by 1""")
def stream_merge(t: Tables) -> DataFrame:
    """Two streams, each taken to its end, merged by key: a merge needs the order of both, so it runs in batches."""
    part = lambda kind: Z.run_now(_events(t).where(F.col("event_type") == kind).select("event_id", "user_id"))
    return M.counts({"views": (part("view"), [F.col("user_id")]), "purchases": (part("purchase"), [F.col("user_id")])}, ["user_id"])


@query("""select event_id, acc_after from (select event_id, event_type, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 2) as acc_after from events) where event_type <> 'view'""")
def stream_suppressed(t: Tables) -> DataFrame:
    """Suppressed items give no output, but accumulators still see them."""

    def step(state, row):
        total = state[0] + row.value
        return (total,), ([] if row.event_type == "view" else [{"event_id": row.event_id, "acc_after": total}])

    rows = _events(t).select("event_id", "ts", "user_id", "event_type", "value")
    out = Z.run_now(Z.folded(rows, "user_id", ["ts", "event_id"], step, (0.0,), "total double", "event_id long, acc_after double"))
    return out.select("event_id", F.round("acc_after", 2).alias("acc_after"))


@query("""select true as before, false as after""")
def stream_cancelled(t: Tables) -> DataFrame:
    found = Z.cancelled(_events(t).select("event_id"))
    return t.spark.range(1).select(F.lit(found["before"]).alias("before"), F.lit(found["after"]).alias("after"))


@query("""select n_nationkey::bigint as "_key", upper(n_name) as name from nation""")
def stream_to_stream(t: Tables) -> DataFrame:
    """XML files in, a transformation, XML files out, as a stream; then read back."""
    base = f"{shared_folder(t.spark)}/lamina-xml-{uuid.uuid4().hex}"
    sinks.write(t.nation.select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name")), f"{base}/in", sinks.Output("xml"), "nation", "nations")
    rows = t.spark.readStream.format("xml").option("rowTag", "nation").schema("_key long, name string").load(f"{base}/in")
    changed = Y.checked(rows.select("_key", F.upper("name").alias("name")))
    writer = changed.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/progress")
    writer.foreachBatch(lambda df, n: sinks.write(df, f"{base}/out/{n}", sinks.Output("xml"), "nation", "nations")).start().awaitTermination()
    return readers.xml(t.spark, f"{base}/out/*", "nation", "_key long, name string")


@query("""select * from (values ('filter', 'consuming', 'striding', 'stream-inline', true), ('group', 'keyed', 'grounded', 'buffer-matched', true), ('keyed window', 'keyed', 'grounded', 'buffer-matched', true),
('whole window', 'free-ranging', 'roaming', 'buffer-whole-input', false), ('sort', 'free-ranging', 'roaming', 'buffer-whole-input', false), ('after sort', 'consuming', 'roaming', 'buffer-whole-input', false), ('join', 'keyed', 'grounded', 'buffer-matched', true),
('motionless', 'motionless', 'grounded', 'stream-inline', true), ('limit', 'free-ranging', 'roaming', 'buffer-whole-input', false), ('distinct', 'keyed', 'grounded', 'buffer-matched', true)) v(plan, sweep, posture, buffering, streamable)""")
def stream_plan_analysis(t: Tables) -> DataFrame:
    """Sweep, posture, buffering and streamability of plans, read off the plans themselves."""
    e = t.events
    plans = {
        "filter": e.where("value > 1").select("event_id"),
        "group": e.groupBy("user_id").agg(F.sum("value")),
        "keyed window": e.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))),
        "whole window": e.withColumn("p", F.row_number().over(Window.orderBy("ts"))),
        "sort": e.orderBy("ts"),
        "after sort": e.orderBy("ts").where("value > 1"),
        "join": e.join(t.customer, F.col("user_id") == F.col("c_custkey")),
        "motionless": t.spark.range(3).where("id > 1"),
        "limit": e.limit(5),
        "distinct": e.select("user_id").distinct(),
    }
    rows = []
    for name, df in plans.items():
        try:
            Y.checked(df)
            fine = True
        except Y.AnalysisError:
            fine = False
        top = [s for s in Y.steps(df) if s.operator not in ("Project", "SubqueryAlias", "GlobalLimit", "LocalLimit")] if name not in ("filter", "limit") else Y.steps(df)
        rows.append((name, top[-1].sweep.value, Y.posture(df).value, Y.buffering(df).value, fine))
    return t.spark.createDataFrame(rows, "plan string, sweep string, posture string, buffering string, streamable boolean")


# --- results


def _place(t: Tables, kind: str) -> str:
    return f"{shared_folder(t.spark)}/lamina-{kind}-{uuid.uuid4().hex}"


@query("""select o_orderpriority || '.txt' as href, ((row_number() over (partition by o_orderpriority order by o_orderkey) - 1) // 1000)::bigint as part, o_orderkey from orders""".join(("select href, part, count(*)::bigint as n_items, string_agg(o_orderkey::varchar, chr(10) order by o_orderkey) as content from (", ") group by 1, 2")))
def result_documents_all(t: Tables) -> DataFrame:
    """Every order in its priority's result, in ordered parts of 1,000 items."""
    return sinks.result_parts(t.orders, F.concat("o_orderpriority", F.lit(".txt")), F.col("o_orderkey"), ["o_orderkey"], 1000, "\n")


@query("""select n_name || '.txt' as href, n_nationkey || '' as content from nation""")
def result_handler(t: Tables) -> DataFrame:
    """A handler on the executors gets each result's name and content; here it writes files of the shared folder."""
    place = _place(t, "handled")
    os.makedirs(place) if "://" not in place else None
    folder = place.removeprefix("file:")

    def handler(href: str, content: str) -> None:
        with open(f"{folder}/{href}", "w") as f:
            f.write(content)

    sinks.deliver(t.nation.select(F.concat("n_name", F.lit(".txt")).alias("href"), F.col("n_nationkey").cast("string").alias("content")), handler)
    rows = t.spark.read.text(place, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("href"), F.col("value").alias("content"))
    return rows


@query("""select count(*)::bigint as n, sum(n_nationkey)::bigint as total, true as typed from nation""")
def raw_values(t: Tables) -> DataFrame:
    """Typed values rather than text, taken by the caller."""
    got = [r.n_nationkey for r in t.nation.select("n_nationkey").collect()]
    return t.spark.range(1).select(F.lit(len(got)).cast("long").alias("n"), F.lit(sum(got)).cast("long").alias("total"), F.lit(all(isinstance(v, int) for v in got)).alias("typed"))


@query("""select count(*)::bigint as n, max(event_id)::bigint as last from events""")
def incremental_drain(t: Tables) -> DataFrame:
    """The caller takes results partition by partition, in order, and never holds them all."""
    n = last = 0
    for row in t.events.select("event_id").orderBy("event_id").toLocalIterator(prefetchPartitions=True):
        n, last = n + 1, row.event_id
    return t.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(last).cast("long").alias("last"))


@query("""select count(*)::bigint as n, max(o_totalprice) as most from orders where o_orderstatus = 'F'""")
def message_listener(t: Tables) -> DataFrame:
    """Messages gathered while another query runs."""
    df, seen = messages.observed(t.orders.where("o_orderstatus = 'F'"), n=F.count(F.lit(1)), most=F.max("o_totalprice"))
    df.write.format("noop").mode("overwrite").save()
    found = messages.report(seen)
    return t.spark.createDataFrame([(found["n"], found["most"])], "n long, most double")


@query("""select true as empty""")
def empty_source(t: Tables) -> DataFrame:
    return readers.empty_source(t.spark)


@query("""select n_nationkey as key, true as there, false as streams from nation""")
def preloaded_resource(t: Tables) -> DataFrame:
    """A table under a URI, found before any file; no stream reads it."""
    sources = readers.Sources(t.spark)
    sources.preload("mem:nations", t.nation.select(F.col("n_nationkey").alias("key")))
    return sources.document("mem:nations", "nation").select("key", F.lit(sources.available("mem:nations")).alias("there"), F.lit(sources.stream_available("mem:nations")).alias("streams"))


# --- groups, rules, merging


@query("""select o_custkey as cust, count(*)::bigint as n, string_agg(o_orderkey::varchar, ' ' order by o_orderdate, o_orderkey) as members from orders group by 1""")
def current_group_members(t: Tables) -> DataFrame:
    """current-group() and current-grouping-key(): each customer's orders in order of date."""
    members = G.current_group(["o_orderdate", "o_orderkey"])
    out = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(members.alias("g"))
    return out.select("cust", F.size("g").cast("long").alias("n"), F.array_join(F.transform("g", lambda m: m["o_orderkey"].cast("string")), " ").alias("members"))


@query("""select epoch_us(date_trunc('hour', ts)) as at, count(*)::bigint as n, count(distinct event_id % 3)::bigint as spellings from events group by 1""")
def group_by_instant(t: Tables) -> DataFrame:
    """dateTimes with different offsets fall into one group if they are one instant."""
    spelled = lambda hours, zone: F.concat(F.date_format(F.date_trunc("hour", "ts") + F.expr(f"interval {hours} hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    text = F.when(F.col("event_id") % 3 == 0, spelled(0, "Z")).when(F.col("event_id") % 3 == 1, spelled(2, "+02:00")).otherwise(spelled(-5, "-05:00"))
    rows = t.events.select("event_id", text.alias("text"))
    out = G.group_by(rows, {"at": dates.instant(F.col("text"))}, ["event_id"], n=F.count(F.lit(1)), spellings=F.count_distinct(F.col("event_id") % 3))
    return out.select(F.unix_micros("at").alias("at"), "n", "spellings")


@query("""select p_partkey, case when p_size % 2 = 0 and p_size % 3 = 0 then 'third' when p_size % 2 = 0 then 'even' when p_size % 3 = 0 then 'third' else p_name end as result from part""")
def rules_use_last(t: Tables) -> DataFrame:
    """Of rules of one rank that match, the last declared wins."""
    found = rules.RuleSet().rule("even", F.col("p_size") % 2 == 0, F.lit("even")).rule("third", F.col("p_size") % 3 == 0, F.lit("third"))
    return found.apply(t.part, F.col("p_name")).select("p_partkey", "result")


@query("""select sum(case when p_size % 6 = 0 then 1 else 0 end) > 0 as clash, false as apart from part""")
def rules_fail_on_multiple(t: Tables) -> DataFrame:
    """on-multiple-match=fail: an error if two rules of one rank match an item, none if their ranks differ."""

    def fails(priority: float) -> bool:
        found = rules.RuleSet(modes={"default": rules.Mode(on_multiple="fail")}).rule("even", F.col("p_size") % 2 == 0, F.lit("even")).rule("third", F.col("p_size") % 3 == 0, F.lit("third"), priority=priority)
        try:
            found.apply(t.part, F.col("p_name")).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the engine's own error has the message
            if "several rules" not in str(error):
                raise
            return True
        return False

    return t.spark.range(1).select(F.lit(fails(0.5)).alias("clash"), F.lit(fails(1.0)).alias("apart"))


@query("""select 'kinds' as what, 'merge keys differ in number or type' as error union all select 'cardinality', 'a merge key has more than one value'""")
def merge_key_errors(t: Tables) -> DataFrame:
    """Keys that do not agree are refused before the query runs; a key of several values raises as it runs."""
    try:
        M.merged({"a": (t.nation, [F.col("n_nationkey")], ["n_nationkey"]), "b": (t.region, [F.col("r_name")], ["r_regionkey"])}, [], ["k"])
        kinds = ""
    except M.MergeError as error:
        kinds = str(error).split(":")[0]
    try:
        t.nation.select(M.single_key(F.array("n_nationkey", "n_regionkey"))).write.format("noop").mode("overwrite").save()
        several = ""
    except Exception as error:  # the engine's own error has the message
        several = "a merge key has more than one value" if "a merge key has more than one value" in str(error) else ""
    return t.spark.createDataFrame([("kinds", kinds), ("cardinality", several)], "what string, error string")


@query("""select c_custkey, c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_acctbal > 0 as both, c_nationkey in (select n_nationkey from nation where n_regionkey = 1) or c_acctbal > 0 as either, c_acctbal > 0 and not c_nationkey in (select n_nationkey from nation where n_regionkey = 1) as one from customer""")
def pattern_sets(t: Tables) -> DataFrame:
    """Patterns combined by intersect, union and except; one of them is membership in a variable."""
    member = J.matching(t.customer.select("c_custkey", "c_nationkey"), t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"]).select("c_custkey", F.lit(True).alias("_in"))
    rows = t.customer.join(member, "c_custkey", "left")
    inside, rich = F.coalesce("_in", F.lit(False)), F.col("c_acctbal") > 0
    return rows.select("c_custkey", (inside & rich).alias("both"), (inside | rich).alias("either"), (rich & ~inside).alias("one"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() over w as rnk, dense_rank() over w as dense, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber range between 1 preceding and current row), 2) as near from lineitem window w as (partition by l_orderkey order by l_linenumber)""")
def ranking_and_range(t: Tables) -> DataFrame:
    """Ranks with ties and a frame by value."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.sum("l_quantity").over(w.rangeBetween(-1, 0)), 2).alias("near"))


@query("""select user_id, count(*)::bigint as n from events group by 1""")
def iterate_in_python(t: Tables) -> DataFrame:
    """A fold whose state no expression holds: here a Python set."""

    def body(key, rows):
        seen = set()
        for r in rows:
            seen.add(r.event_id)
        yield {"user_id": key[0], "n": len(seen)}

    return W.iterate_rows(t.events.select("user_id", "ts", "event_id"), ["ts", "event_id"], ["user_id"], body, "user_id long, n long")


# --- components


@query("""select p_partkey, round(p_retailprice * 0.9, 2) as price, 'EUR ' || p_name as label from part""")
def named_templates(t: Tables) -> DataFrame:
    """call-template; a tunnel parameter reaches the inner template though the outer one does not pass it on."""
    own = P.Templates()

    @own.template("inner")
    def inner(name):
        return F.concat(F.lit(P.tunnel("currency", "?")), F.lit(" "), name)

    @own.template("outer")
    def outer(df, rate):
        return df.select("p_partkey", F.round(F.col("p_retailprice") * rate, 2).alias("price"), own.call("inner", F.col("p_name")).alias("label"))

    return own.call("outer", t.part, rate=0.9, tunnel={"currency": "EUR"})


@query("""select '<a id="' || n_nationkey || '" class="own" lang="en"/>' as output from nation""")
def attribute_sets(t: Tables) -> DataFrame:
    """Attribute sets used by one another, of which the last of a name wins; a part that is there only under a static condition."""
    base = P.attribute_set(id=F.col("n_nationkey"), **{"class": F.lit("base")})
    both = P.attribute_set(base, {"class": F.lit("own")}, **(P.use_when(True, lambda: {"lang": F.lit("en")}) or {}))
    return t.nation.select(sinks.element("a", attributes=both).alias("output"))


@query("""select p_partkey, p_retailprice * 2 as own, p_retailprice + 1 as final, 'hidden is private' as error, false as old from part""")
def packages(t: Tables) -> DataFrame:
    """A package that uses another of a range of versions: an override, a final component, one that stays private."""
    base = P.Package("base", "1.2").define("price", lambda c: c).define("price", lambda c: c, "public").define("more", lambda c: c + 1, "final").define("hidden", lambda c: c).define("wanted", None, "abstract")
    own = P.Package("own").use(base, "1.0 to 1.9", {"price": lambda c: c * 2, "wanted": lambda c: c})
    own.components["hidden"] = base.components["hidden"]
    try:
        own.call("hidden", F.lit(1))
        error = ""
    except P.PackageError as found:
        error = str(found)
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", own.call("price", price).alias("own"), own.call("more", price).alias("final"), F.lit(error).alias("error"), F.lit(P.matches_version("1.2", "2.*, 0.9")).alias("old"))


@query("""select n_nationkey as key, n_nationkey * 10 + 1 as result from nation""")
def initial_function(t: Tables) -> DataFrame:
    """A function of the registry called by name and arity from outside."""
    own = udf.Functions()
    own.define("scaled", lambda c, by: c * by + 1)
    return t.nation.select(F.col("n_nationkey").alias("key"), own.call("scaled", F.col("n_nationkey"), F.lit(10)).alias("result"))


@query("""select true as own, false as arity, true as spark, true as kind, false as no_kind, true as instruction, true as property, true as stream""")
def availability(t: Tables) -> DataFrame:
    """function-, type-, element- and stream-available, and the system properties."""
    own = udf.Functions()
    own.define("scaled", lambda c, by: c * by)
    sources = readers.Sources(t.spark)
    found = {
        "own": values.function_available(t.spark, "scaled", own, 2), "arity": values.function_available(t.spark, "scaled", own, 3), "spark": values.function_available(t.spark, "format-number"), "kind": values.type_available("decimal(10,2)"),
        "no_kind": values.type_available("no-such-type"), "instruction": values.element_available("for-each-group"), "property": "version" in values.available_properties(), "stream": sources.stream_available(f"{t.folder}/events.parquet"),
    }
    return t.spark.range(1).select(*(F.lit(v).alias(k) for k, v in found.items()))


@query("""select count(*)::bigint as n, true as one_date, true as one_time, true as shaped from events""")
def current_date_time(t: Tables) -> DataFrame:
    """The current date and time are the same for all rows of a query, and agree with each other."""
    rows = t.events.select(dates.current_date().alias("d"), dates.current_datetime().alias("ts"), dates.current_time().alias("t"))
    shaped = F.bool_and(F.col("t").rlike(r"^\d\d:\d\d:\d\d\.\d{6}$") & (F.to_date("ts") == F.col("d")) & (F.date_format("ts", "HH:mm:ss.SSSSSS") == F.col("t")))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("d") == 1).alias("one_date"), (F.count_distinct("ts") == 1).alias("one_time"), shaped.alias("shaped"))


@query("""select count(*)::bigint as n, true as inside, true as spread, true as again from events""")
def random_numbers(t: Tables) -> DataFrame:
    """Numbers by seed and row: in [0, 1), spread, and the same whatever the partitioning."""
    draw = lambda df: df.select("event_id", values.random_number(7, F.col("event_id")).alias("r"))
    a, b = draw(t.events), draw(t.events.repartition(3)).select("event_id", F.col("r").alias("s"))
    both = a.join(b, "event_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"), (F.abs(F.avg("r") - 0.5) < 0.05).alias("spread"), F.bool_and(F.col("r") == F.col("s")).alias("again"))
