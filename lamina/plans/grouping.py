"""Grouping, aggregation, windows, sorting, joins, merging and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.atomize import numeric
from lamina.functions.numbers import numbers
from lamina.operators import aggregates as A
from lamina.operators import grouping as G
from lamina.operators import joins as J
from lamina.operators import merge as M
from lamina.operators import sequence as S
from lamina.operators import sets as U
from lamina.operators import windows as W
from lamina.operators.sorting import SortKey, numbered, perform_sort, top_k
from lamina.plans.registry import Tables, query

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def r2(c):
    return F.round(c, 2)


@query("""select l_returnflag, l_linestatus, count(*)::bigint as n, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_discount
from lineitem where l_shipdate <= timestamp '2001-06-01' group by 1, 2""")
def group_by_composite(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp"))
    out = G.group_by(rows, {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}, LINE_ORDER[:1], n=F.count(F.lit(1)), sum_qty=r2(F.sum("l_quantity")),
                     revenue=r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))), avg_discount=F.round(F.avg("l_discount"), 6))
    return out.drop("first_seen").orderBy("l_returnflag", "l_linestatus")


@query("""select o_orderpriority as priority, count(*)::bigint as n, min(o_orderkey) as first_seen, row_number() over (order by min(o_orderkey))::bigint as rank from orders group by 1""")
def group_by_first_seen(t: Tables) -> DataFrame:
    out = G.group_by(t.orders, {"priority": F.col("o_orderpriority")}, ["o_orderkey"], n=F.count(F.lit(1)))
    return S.with_position(out, ["first_seen"], None, "rank").orderBy("first_seen")


@query("""with w as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as word from part) select word, count(*)::bigint as n, min(p_partkey) as first_seen from w group by 1""")
def group_by_sequence_key(t: Tables) -> DataFrame:
    return G.group_by_each(t.part, F.split("p_name", " "), ["p_partkey"], "word", n=F.count(F.lit(1)))


@query("""select quality, count(*)::bigint as n, min(doc_id) as first_seen from documents left join labels using (doc_id) where quality is not null group by 1""")
def group_by_empty_key(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return G.group_by(rows, {"quality": F.col("quality")}, ["doc_id"], n=F.count(F.lit(1)))


ISLANDS = """with c as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as change from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(change) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from c)
select user_id, grp::bigint as grp, min(event_type) as event_type, count(*)::bigint as n, round(sum(value), 2) as total from g group by user_id, grp"""


@query(ISLANDS)
def group_adjacent(t: Tables) -> DataFrame:
    marked = G.adjacent(t.events, F.col("event_type"), ["ts", "event_id"], ["user_id"], "grp")
    return marked.groupBy("user_id", "grp").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), r2(F.sum("value")).alias("total"))


@query("""with g as (select *, sum(case when role = 'user' or rn = 1 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as grp from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations))
select conv_id, grp::bigint as grp, count(*)::bigint as n, string_agg(role, ',' order by turn) as roles from g group by conv_id, grp""")
def group_starting_with(t: Tables) -> DataFrame:
    marked = G.starting_with(t.conversations, F.col("role") == "user", ["turn"], ["conv_id"], "grp")
    return marked.groupBy("conv_id", "grp").agg(F.count(F.lit(1)).alias("n"), A.string_join(F.col("role"), "turn", ",").alias("roles"))


@query("""with g as (select *, 1 + coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as grp from events)
select user_id, grp::bigint as grp, count(*)::bigint as n, max(event_id) as last_event from g group by user_id, grp""")
def group_ending_with(t: Tables) -> DataFrame:
    marked = G.ending_with(t.events, F.col("event_type") == "purchase", ["ts", "event_id"], ["user_id"], "grp")
    return marked.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("""select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1 order by revenue desc, l_suppkey limit 10""")
def group_sort_by_agg(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_suppkey").agg(r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))
    return top_k(out, [SortKey(F.col("revenue"), descending=True)], ["l_suppkey"], 10)


@query("""select lower(c_mktsegment) as segment, count(*)::bigint as n from customer group by 1""")
def group_by_collation(t: Tables) -> DataFrame:
    """Keys equal without regard to case."""
    key = F.collate(F.col("c_mktsegment"), "UTF8_LCASE")
    return t.customer.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c_mktsegment").alias("m")).select(F.lower(F.collate("m", "UTF8_BINARY")).alias("segment"), "n")


@query("""select c_custkey, round(coalesce(sum(o_totalprice), 0), 2) as total, count(o_orderkey)::bigint as n from customer left join (select * from orders where o_orderpriority = '1-URGENT') o on c_custkey = o_custkey group by 1""")
def sum_with_zero(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    rows = t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(r2(A.total(F.col("o_totalprice"), F.lit(0.0))).alias("total"), F.count("o_orderkey").alias("n"))


@query("""select r_name, string_agg(n_name, ',' order by n_nationkey) as nations from region join nation on r_regionkey = n_regionkey group by 1""")
def string_join_ordered(t: Tables) -> DataFrame:
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("r_name").agg(A.string_join(F.col("n_name"), "n_nationkey", ",").alias("nations"))


@query("""select distinct o_orderpriority as priority, o_orderstatus as status from orders""")
def distinct_values(t: Tables) -> DataFrame:
    return A.distinct_values(t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")), "priority", "status")


@query("""select c_mktsegment, bool_or(c_acctbal < 0) as some_debt, not bool_or(c_acctbal > 9999) as none_rich, count(*) > 0 as present from customer group by 1""")
def exists_empty(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(A.exists(F.col("c_acctbal") < 0).alias("some_debt"), (~A.exists(F.col("c_acctbal") > 9999)).alias("none_rich"), (F.count(F.lit(1)) > 0).alias("present"))


@query("""select n_regionkey, min(r_name) as name, min(n_nationkey) as first_nation, count(*)::bigint as nations from nation join region on n_regionkey = r_regionkey group by 1""")
def cardinality_checks(t: Tables) -> DataFrame:
    regions = t.region.groupBy("r_regionkey").agg(A.exactly_one(F.col("r_name"), "name").alias("name"))
    nations = t.nation.groupBy("n_regionkey").agg(F.array_min(A.one_or_more(F.col("n_nationkey"))).alias("first_nation"), F.count(F.lit(1)).alias("nations"))
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "name", "first_nation", "nations")


@query("""select count(*)::bigint as n, count(*) filter (where l_discount > 0.05)::bigint as discounted, round(coalesce(sum(l_quantity) filter (where l_returnflag = 'R'), 0), 2) as returned, min(l_shipdate::date)::varchar as first_ship, round(max(l_extendedprice), 2) as top from lineitem""")
def fork_multi_agg(t: Tables) -> DataFrame:
    return A.fork(t.lineitem, n=F.count(F.lit(1)), discounted=A.count_where(F.col("l_discount") > 0.05), returned=r2(A.total_where(F.col("l_quantity"), F.col("l_returnflag") == "R")), first_ship=F.min(F.col("l_shipdate").cast("date")).cast("string"), top=r2(F.max("l_extendedprice")))


@query("""select l_suppkey, count(*) filter (where l_returnflag = 'A')::bigint as a, count(*) filter (where l_returnflag = 'N')::bigint as n, round(coalesce(sum(l_tax) filter (where l_quantity < 10), 0), 4) as small_tax from lineitem group by 1""")
def conditional_aggregates(t: Tables) -> DataFrame:
    small = F.round(A.total_where(F.col("l_tax"), F.col("l_quantity") < 10), 4)
    return t.lineitem.groupBy("l_suppkey").agg(A.count_where(F.col("l_returnflag") == "A").alias("a"), A.count_where(F.col("l_returnflag") == "N").alias("n"), small.alias("small_tax"))


@query("""select l_returnflag, null::varchar as l_linestatus, 'by_flag' as prong, count(*)::bigint as n, round(sum(l_quantity), 2) as qty from lineitem group by l_returnflag
union all select null, l_linestatus, 'by_status', count(*)::bigint, round(sum(l_quantity), 2) from lineitem group by l_linestatus""")
def fork_groupings(t: Tables) -> DataFrame:
    return A.fork_groupings(t.lineitem, {"by_flag": ["l_returnflag"], "by_status": ["l_linestatus"]}, n=F.count(F.lit(1)), qty=r2(F.sum("l_quantity")))


@query("""select event_type, count(*)::bigint as n, round(avg(try_cast(json_extract_string(props, '$.k') as double)), 4) as mean_k, min(try_cast(json_extract_string(props, '$.k') as double)) as least_k, max(try_cast(json_extract_string(props, '$.k') as double)) as most_k, min_by(event_id, event_id) as head from events group by 1""")
def watcher_aggregates(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(A.mean_of_numbers(k), 4).alias("mean_k"), A.least_number(k).alias("least_k"), A.greatest_number(k).alias("most_k"), F.min_by("event_id", "event_id").alias("head"))


@query("""with s as (select user_id, list(value order by ts, event_id) as v from events group by 1) select user_id, round(list_reduce(list_prepend(0.0, v), lambda a, x: greatest(a + x - 50, 0)), 6) as level from s""")
def fold_left_running(t: Tables) -> DataFrame:
    level = A.fold_left(["ts", "event_id"], ["value"], F.lit(0.0), lambda s, x: F.greatest(s + x["value"] - 50, F.lit(0.0)))
    return t.events.groupBy("user_id").agg(F.round(level, 6).alias("level"))


@query("""select conv_id, string_agg(role, '>' order by turn desc) as roles from conversations group by 1""")
def fold_right(t: Tables) -> DataFrame:
    out = A.fold_right(["turn"], ["role"], F.lit(""), lambda s, x: F.when(s == "", x["role"]).otherwise(F.concat(s, F.lit(">"), x["role"])))
    return t.conversations.groupBy("conv_id").agg(out.alias("roles"))


@query(f"""select l_orderkey, round(sum(l_extendedprice), 2) as total, count(*)::bigint as n from (select *, row_number() over (partition by l_orderkey order by {LINE_SQL}) as p from lineitem) where p < 4 group by 1""")
def parent_positional_agg(t: Tables) -> DataFrame:
    rows = S.predicates(t.lineitem, LINE_ORDER, ["l_orderkey"], lambda p, _: p < 4)
    return rows.groupBy("l_orderkey").agg(r2(F.sum("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""select r_name, count(*)::bigint as n, round(sum(s_acctbal), 2) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name like 'A%' group by 1""")
def ancestor_predicate_agg(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where(F.col("r_name").startswith("A")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), r2(F.sum("s_acctbal")).alias("balance"))


# --- joins


@query("""select c_custkey, c_name, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from customer join orders on o_custkey = c_custkey group by 1, 2""")
def key_lookup(t: Tables) -> DataFrame:
    by_customer = J.Key(t.orders.select("o_custkey", "o_totalprice"), (F.col("o_custkey"),))
    found = J.key_lookup(t.customer.select("c_custkey", "c_name"), by_customer, (F.col("c_custkey"),))
    return found.groupBy("c_custkey", "c_name").agg(F.count(F.lit(1)).alias("n"), r2(F.sum("o_totalprice")).alias("total"))


@query("""select a.c_custkey, count(*)::bigint as n from customer a join supplier b on a.c_nationkey = b.s_nationkey and (a.c_custkey % 7) = (b.s_suppkey % 7) group by 1""")
def key_composite(t: Tables) -> DataFrame:
    key = J.Key(t.supplier, (F.col("s_nationkey"), F.col("s_suppkey") % 7))
    return J.key_lookup(t.customer.select("c_custkey", "c_nationkey"), key, (F.col("c_nationkey"), F.col("c_custkey") % 7)).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""with k as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as word from part) select brand, count(distinct p_partkey)::bigint as n from (select 'red' as w, 'warm' as brand union all select 'ring', 'warm' union all select 'blue', 'cold') b join k on k.word = b.w group by brand""")
def key_sequence(t: Tables) -> DataFrame:
    words = J.Key(t.part.select("p_partkey", "p_name"), (F.split("p_name", " "),), many=True)
    probe = t.spark.createDataFrame([("warm", ["red", "ring", "red"]), ("cold", ["blue"])], "brand string, words array<string>")
    return J.key_lookup_any(probe, words, F.col("words"), ["brand", "p_partkey"]).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 490000)""")
def key_pattern_semi(t: Tables) -> DataFrame:
    key = J.Key(t.orders.where("o_totalprice > 490000"), (F.col("o_custkey"),))
    return J.key_lookup(t.customer, key, (F.col("c_custkey"),), "left_semi").select("c_custkey", "c_name")


@query("""select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)""")
def general_comparison_any(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.matching(t.orders.select("o_orderkey"), big, ["o_orderkey"])


@query("""select n_name, r_name from nation join region on n_regionkey = r_regionkey""")
def map_as_lookup(t: Tables) -> DataFrame:
    table = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return J.lookup(t.nation, table, ["n_regionkey"]).select("n_name", "r_name")


@query("""select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""")
def theta_nested_loop(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    test = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return J.nested(a, b, test).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("""select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events""")
def last_seen_lookup(t: Tables) -> DataFrame:
    return t.events.select("event_id", W.last_seen(F.col("value"), F.col("event_type") == "purchase", ["ts", "event_id"], ["user_id"]).alias("last_purchase"))


# --- merge, sets


@query("""select nation, sum(c)::bigint as n_customer, sum(s)::bigint as n_supplier from (select c_nationkey as nation, 1 as c, 0 as s from customer union all select s_nationkey, 0, 1 from supplier) group by 1""")
def merge_two_sources(t: Tables) -> DataFrame:
    return M.counts({"customer": (t.customer, [F.col("c_nationkey")]), "supplier": (t.supplier, [F.col("s_nationkey")])}, ["nation"]).orderBy("nation")


@query("""select nation, string_agg(name, '|' order by rank, id) as names, count(*) filter (where rank = 0)::bigint as n_nation, count(*) filter (where rank = 1)::bigint as n_supplier, coalesce(string_agg(name, ',' order by id) filter (where rank = 1), '') as suppliers
from (select n_nationkey as nation, 0 as rank, n_nationkey::bigint as id, n_name as name from nation union all select s_nationkey, 1, s_suppkey, s_name from supplier) group by 1""")
def merge_named_groups(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    supplier = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = M.merged({"nation": (nation, [F.col("k")], ["id"]), "supplier": (supplier, [F.col("k")], ["id"])}, ["name"], ["nation"])
    names = lambda items, sep: F.array_join(F.transform(items, lambda x: x["name"]), sep)
    return out.select("nation", names(F.col("current"), "|").alias("names"), "n_nation", "n_supplier", names(M.merge_group("supplier"), ",").alias("suppliers"))


@query("""select part, key, pos from (select 0 as part, r_regionkey as key, row_number() over (order by r_regionkey)::bigint as pos from region union all select 1, n_nationkey, (select count(*) from region) + row_number() over (order by n_nationkey) from nation)""")
def seq_concat(t: Tables) -> DataFrame:
    rows = S.concatenated(t.region.select(F.col("r_regionkey").alias("key")), t.nation.select(F.col("n_nationkey").alias("key")))
    return S.with_position(rows, ["_part", "key"]).select(F.col("_part").alias("part"), "key", "pos")


@query("""select c_custkey from customer where c_acctbal < 0 or c_mktsegment = 'BUILDING'""")
def union_identity(t: Tables) -> DataFrame:
    c = t.customer
    return U.union(c.where("c_acctbal < 0"), c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"]).select("c_custkey")


@query("""select c_custkey from customer where c_acctbal < 0 and c_mktsegment = 'BUILDING'""")
def intersect_nodes(t: Tables) -> DataFrame:
    c = t.customer
    return U.intersect(c.where("c_acctbal < 0"), c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"]).select("c_custkey")


@query("""select c_custkey from customer where c_acctbal < 0 and c_mktsegment <> 'BUILDING'""")
def except_nodes(t: Tables) -> DataFrame:
    c = t.customer
    return U.difference(c.where("c_acctbal < 0"), c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"]).select("c_custkey")


# --- windows


@query("""select conv_id, turn, row_number() over (partition by conv_id order by turn)::bigint as pos, count(*) over (partition by conv_id)::bigint as size from conversations""")
def position_last(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", S.position(["turn"], ["conv_id"]).alias("pos"), S.last(["conv_id"]).alias("size"))


@query("""select o_orderkey, row_number() over (order by o_orderdate, o_orderkey)::bigint as pos from orders""")
def position_global(t: Tables) -> DataFrame:
    return S.with_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query(f"""with a as (select *, row_number() over (partition by l_orderkey order by {LINE_SQL}) as p from lineitem), b as (select *, row_number() over (partition by l_orderkey order by {LINE_SQL}) as q from a where p % 2 = 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey from b where q > 1""")
def chained_predicates(t: Tables) -> DataFrame:
    return S.predicates(t.lineitem, LINE_ORDER, ["l_orderkey"], lambda p, _: p % 2 == 1, lambda p, _: p > 1).select(*LINE_ORDER)


@query(f"""select {LINE_SQL} from (select *, row_number() over (partition by l_orderkey order by {LINE_SQL}) as p, count(*) over (partition by l_orderkey) as n from lineitem where l_discount > 0.02) where p = n""")
def match_vs_dispatch_position(t: Tables) -> DataFrame:
    """[last()] counts what survives the filter, not all siblings."""
    return S.predicates(t.lineitem.where("l_discount > 0.02"), LINE_ORDER, ["l_orderkey"], lambda p, n: p == n).select(*LINE_ORDER)


@query("""select conv_id, turn, lag(role) over w as before, lead(role) over w as after from conversations window w as (partition by conv_id order by turn)""")
def lag_lead_siblings(t: Tables) -> DataFrame:


    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query(f"""select {LINE_SQL}, row_number() over (partition by l_orderkey order by {LINE_SQL})::bigint as number from lineitem""")
def number_single(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINE_ORDER, W.number_single(LINE_ORDER, ["l_orderkey"]).alias("number"))


@query("""with s as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)
select event_id, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint as number from s""")
def number_any_from(t: Tables) -> DataFrame:
    return W.number_any(t.events, F.col("event_type") == "click", ["ts", "event_id"], ["user_id"], F.col("event_type") == "signup").select("event_id", "number")


@query(f"""with o as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as a from orders), l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by {LINE_SQL}) as b from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, a::varchar || '.' || b::varchar as number from l join o on l_orderkey = o_orderkey""")
def number_multiple(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", W.number_single(["o_orderkey"], ["o_custkey"]).alias("a"))
    rows = t.lineitem.select(*LINE_ORDER, W.number_single(LINE_ORDER, ["l_orderkey"]).alias("b")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))


    return rows.select(*LINE_ORDER, numbers(W.number_multiple(F.col("a"), F.col("b")), ["1"], ["."]).alias("number"))


@query("""select event_id, round(coalesce(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0), 2) as acc_before, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 2) as acc_after from events""")
def accumulator_before_after(t: Tables) -> DataFrame:
    out = W.accumulator(t.events, F.sum("value"), ["ts", "event_id"], ["user_id"], start=F.lit(0.0))
    return out.select("event_id", r2("acc_before").alias("acc_before"), r2("acc_after").alias("acc_after"))


RUNNING = """with r as (select *, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as total, row_number() over (partition by user_id order by ts, event_id) as p from events)"""


@query(RUNNING + """ select user_id, count(*)::bigint as n, round(max_by(total, p), 2) as total from r group by 1""")
def iterate_running_state(t: Tables) -> DataFrame:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
    step = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["total"] + x["value"]).alias("total"))
    out = W.iterate(t.events, ["value"], ["ts", "event_id"], ["user_id"], start, step, lambda _: F.lit(False))
    return out.select("user_id", "result.n", r2("result.total").alias("total"))


@query(RUNNING + """, b as (select user_id, min(p) as p from r where total > 300 group by 1) select r.user_id, r.event_id as stopped_at, r.p::bigint as n from r join b on r.user_id = b.user_id and r.p = b.p""")
def iterate_break(t: Tables) -> DataFrame:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("at"))
    step = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["total"] + x["value"]).alias("total"), F.when(s["total"] + x["value"] > 300, x["event_id"]).alias("at"))
    out = W.iterate(t.events, ["value"], ["ts", "event_id"], ["user_id"], start, step, lambda s: s["at"].isNotNull())
    return out.where("result.at is not null").select("user_id", F.col("result.at").alias("stopped_at"), "result.n")


@query(RUNNING + """, b as (select user_id, min(p) as p from r where total > 300 group by 1) select r.event_id, round(r.total, 2) as total from r left join b on r.user_id = b.user_id where b.p is null or r.p <= b.p""")
def iterate_emit_until_break(t: Tables) -> DataFrame:
    """Rows up to the one that breaks: a running value and a test decide, so a window serves."""
    out = W.accumulator(t.events, F.sum("value"), ["ts", "event_id"], ["user_id"], start=F.lit(0.0))
    return out.where("acc_before <= 300").select("event_id", r2("acc_after").alias("total"))


# --- sorting


@query("""select c_custkey, row_number() over (order by c_mktsegment desc nulls last, c_acctbal asc nulls first, c_custkey)::bigint as pos from customer order by pos limit 25""")
def sort_multi_key(t: Tables) -> DataFrame:
    keys = [SortKey(F.col("c_mktsegment"), descending=True), SortKey(F.col("c_acctbal"))]
    return numbered(top_k(t.customer, keys, ["c_custkey"], 25), keys, ["c_custkey"]).select("c_custkey", "pos")


@query("""select p_name, row_number() over (order by p_name)::bigint as pos from (select distinct p_name from part)""")
def sort_codepoint(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    return S.with_position(names, ["p_name"]).orderBy("pos")


@query("""select event_id from events order by try_cast(json_extract_string(props, '$.k') as double) asc nulls first, event_id limit 40""")
def sort_numeric_text(t: Tables) -> DataFrame:
    return top_k(t.events, [SortKey(F.get_json_object("props", "$.k"), numeric=True)], ["event_id"], 40).select("event_id")


@query("""select c_custkey, row_number() over (order by c_mktsegment desc nulls last, c_acctbal asc nulls first, c_custkey)::bigint as pos from customer""")
def sort_multi_key_all(t: Tables) -> DataFrame:
    return numbered(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), [SortKey(F.col("c_mktsegment"), descending=True), SortKey(F.col("c_acctbal"))], ["c_custkey"]).select("c_custkey", "pos")


@query("""select event_id, row_number() over (order by try_cast(json_extract_string(props, '$.k') as double) asc nulls first, event_id)::bigint as pos from events""")
def sort_numeric_text_all(t: Tables) -> DataFrame:
    return numbered(t.events.select("event_id", "props"), [SortKey(F.get_json_object("props", "$.k"), numeric=True)], ["event_id"]).select("event_id", "pos")


@query("""select word from (select distinct unnest(string_split(p_name, ' ')) as word from part) order by lower(word)""")
def sort_collation(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return perform_sort(words, [SortKey(F.col("word"), collation="UNICODE")], ["word"])


@query("""select o_orderkey from orders order by o_orderdate, o_orderkey limit 15 offset 10""")
def subsequence_slice(t: Tables) -> DataFrame:
    return S.subsequence(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 11, 15).select("o_orderkey")


@query(f"""select l_orderkey, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, {LINE_SQL}) as r from lineitem) where r <= 2""")
def top_k_per_group(t: Tables) -> DataFrame:
    return top_k(t.lineitem, [SortKey(F.col("l_extendedprice"), descending=True)], LINE_ORDER, 2, ["l_orderkey"]).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("""select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as p from conversations) where p >= 2 and p <> 3""")
def tail_remove(t: Tables) -> DataFrame:
    rest = S.remove(t.conversations, ["turn"], 3, ["conv_id"])
    first = S.head(t.conversations, ["turn"], ["conv_id"]).select("conv_id", "turn")
    return rest.select("conv_id", "turn").join(first, ["conv_id", "turn"], "left_anti")


@query("""select conv_id, role, turn from (select *, row_number() over (partition by conv_id order by turn desc) as p from conversations) where p = 1""")
def reverse_head(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max_by(F.struct("role", "turn"), "turn").alias("x")).select("conv_id", "x.role", "x.turn")


@query("""select event_id from (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen from events) where seen = 0""")
def subsequence_before(t: Tables) -> DataFrame:
    return S.before_first(t.events, ["ts", "event_id"], ["user_id"], F.col("event_type") == "purchase").select("event_id")


@query("""select event_id from (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen from events) where seen = 1""")
def subsequence_from(t: Tables) -> DataFrame:
    return S.from_first(t.events, ["ts", "event_id"], ["user_id"], F.col("event_type") == "purchase").select("event_id")


@query("""select n_nationkey as key, case when n_nationkey + 1 >= 4 then n_nationkey + 3 else n_nationkey + 1 end::bigint as pos from nation union all select -1, 4 union all select -2 + 2 * 0, 5""")
def insert_before(t: Tables) -> DataFrame:
    items = t.spark.createDataFrame([(-1, 0), (-2, 1)], "key int, _i int")
    rows = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("_i"))
    return S.insert_before(rows, ["_i"], 4, items).select("key", "pos")


@query("""select numeric_count::bigint as numeric_count, n::bigint as n from (select count(try_cast(json_extract_string(props, '$.k') as double)) as numeric_count, count(*) as n from events)""")
def untyped_promotion(t: Tables) -> DataFrame:
    return A.fork(t.events, numeric_count=F.count(numeric(F.get_json_object("props", "$.k"))), n=F.count(F.lit(1)))
