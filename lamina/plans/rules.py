"""Rule dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.rules import Mode, RuleSet
from lamina.plans.registry import Tables, query

def _price_rules() -> RuleSet:
    kind, value = F.col("event_type"), F.col("value")
    return (
        RuleSet()
        .rule("any", F.lit(True), F.lit("event"), pattern="any")
        .rule("purchase", kind == "purchase", F.lit("sale"), pattern="name")
        .rule("big", (kind == "purchase") & (value > 60), F.lit("big sale"))
        .rule("error", kind == "error", F.lit("fault"), priority=2.0)
        .rule("late", F.col("event_id") % 2 == 0, F.lit("even"), priority=0.25)
    )


@query("""select event_id, case when event_type = 'error' then 'fault' when event_type = 'purchase' and value > 60 then 'big sale' when event_id % 2 = 0 then 'even' when event_type = 'purchase' then 'sale' else 'event' end as result,
case when event_type = 'error' then 'error' when event_type = 'purchase' and value > 60 then 'big' when event_id % 2 = 0 then 'late' when event_type = 'purchase' then 'purchase' else 'any' end as rule from events""")
def rules_priority(t: Tables) -> DataFrame:
    return _price_rules().apply(t.events, F.col("event_type"), winner="rule").select("event_id", "result", "rule")


@query("""select o_orderkey, 'text' as mode, case when o_orderstatus = 'F' then 'done' else o_orderstatus end as result from orders
union all select o_orderkey, 'skip', 'done' from orders where o_orderstatus = 'F'
union all select o_orderkey, 'copy', case when o_orderstatus = 'F' then 'done' else o_orderkey::varchar || ':' || o_orderstatus end from orders""")
def rules_on_no_match(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    rules = RuleSet(modes={"text": Mode("text-only-copy"), "skip": Mode("deep-skip"), "copy": Mode("shallow-copy")}).rule("done", done, F.lit("done"), mode="#all")
    copy = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_orderstatus"))
    out = None
    for mode in ("text", "skip", "copy"):
        part = rules.apply(t.orders, F.col("o_orderstatus"), copy, mode).select("o_orderkey", F.lit(mode).alias("mode"), "result")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select event_id, case when event_type = 'purchase' and value > 60 then 'big(' || 'sale(' || event_type || ')' || ')' when event_type = 'purchase' then 'sale(' || event_type || ')' else event_type end as result from events""")
def rules_next_match(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    wrap = lambda name: lambda n: F.concat(F.lit(f"{name}("), n.next_match(), F.lit(")"))
    rules = RuleSet().rule("sale", kind == "purchase", wrap("sale"), pattern="name").rule("big", (kind == "purchase") & (F.col("value") > 60), wrap("big"))
    return rules.apply(t.events, kind).select("event_id", "result")


@query("""select n_nationkey, upper(n_name) as toc, case when n_regionkey = 0 then 'first:' || n_name else n_name end as body from nation""")
def rules_modes(t: Tables) -> DataFrame:
    name = F.col("n_name")
    rules = RuleSet().rule("toc", F.lit(True), F.upper(name), mode="toc").rule("body", F.col("n_regionkey") == 0, F.concat(F.lit("first:"), name), mode="body")
    out = rules.apply(t.nation, name, mode="toc", result="toc")
    return rules.apply(out, name, mode="body", result="body").select("n_nationkey", "toc", "body")


@query("""select p_partkey, case when p_size > 40 then 'own(' || 'lib:' || p_type || ')' when p_size > 20 then 'lib:' || p_type else 'lib' end as result from part""")
def rules_imports(t: Tables) -> DataFrame:
    """An importing set wins by precedence whatever the priorities, and apply-imports reaches the imported rules."""
    library = RuleSet().rule("all", F.lit(True), F.lit("lib"), pattern="any").rule("sized", F.col("p_size") > 20, F.concat(F.lit("lib:"), F.col("p_type")), priority=9.0)
    own = RuleSet().rule("big", F.col("p_size") > 40, lambda n: F.concat(F.lit("own("), n.apply_imports(), F.lit(")")), priority=-1.0)
    return own.imported(library).apply(t.part, F.col("p_type")).select("p_partkey", "result")
