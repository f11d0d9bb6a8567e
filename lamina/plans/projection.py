"""Projections, constructors, filters, control flow, comparisons, set membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import collections as C
from lamina.functions import json as J
from lamina.functions import values as V
from lamina.functions.atomize import concat, ebv, general_compare, general_equal, text
from lamina.functions.numbers import integer_divide, modulo
from lamina.functions.udf import Functions, WordsTemplate, evaluate, sql_function
from lamina.operators import control as K
from lamina.operators import sequence as S
from lamina.plans.registry import Tables, query
from lamina.sources.readers import sequence


@query("""select o_orderkey, round(o_totalprice * 1.1, 2) as gross, o_orderstatus || '-' || o_orderpriority as label from orders where o_totalprice > 400000""")
def for_each_project(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 400000").select("o_orderkey", F.round(F.col("o_totalprice") * 1.1, 2).alias("gross"), concat(F.col("o_orderstatus"), F.lit("-"), F.col("o_orderpriority")).alias("label"))


@query("""select vec_id, i::bigint as at, round(embedding[i]::double, 5) as item from embeddings, unnest(generate_series(1, len(embedding))) as g(i)""")
def for_each_member(t: Tables) -> DataFrame:
    return S.members(t.embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", "at", F.round(F.col("item").cast("double"), 5).alias("item"))


@query("""select p_partkey, k as key, v as value from (select p_partkey, 'brand' as k, p_brand as v from part union all select p_partkey, 'type', p_type from part)""")
def for_each_entry(t: Tables) -> DataFrame:
    return S.entries(t.part.select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("m")), "m")


@query("""select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm2 from embeddings""")
def simple_map(t: Tables) -> DataFrame:
    squares = C.for_each(F.col("embedding"), lambda x: x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.round(C.fold_left(squares, F.lit(0.0), lambda a, x: a + x), 4).alias("norm2"))


@query("""select r_name, n_name, length(n_name)::bigint as n from region, nation where n_regionkey = r_regionkey and length(n_name) > 8""")
def flwor_nested(t: Tables) -> DataFrame:
    """for region, for its nations, let n be the length of the name, where n is over 8."""
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("n", F.length("n_name").cast("long"))
    return rows.where("n > 8").select("r_name", "n_name", "n")


@query("""select conv_id, string_agg(role, ' ' order by turn) as roles from conversations group by 1""")
def value_of_join(t: Tables) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(text(F.transform(items, lambda x: x["role"]), T.ArrayType(T.StringType())).alias("roles"))


@query("""select event_id, case when event_type = 'purchase' and value > 50 then 'big' when event_type = 'purchase' then 'small' else 'none' end as size from events""")
def choose_case(t: Tables) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return t.events.select("event_id", K.choose((bought & (F.col("value") > 50), F.lit("big")), (bought, F.lit("small")), otherwise=F.lit("none")).alias("size"))


@query("""select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end as status from orders""")
def switch_case(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", K.switch(F.col("o_orderstatus"), {"O": F.lit("open"), "F": F.lit("filled")}, F.lit("other")).alias("status"))


@query("""select event_id, coalesce(try_cast(substr(event_type, 1, 1) as integer), try_cast(json_extract_string(props, '$.k') as integer), -1)::bigint as k, round(case when (event_id % 3) = 0 then -1 else value / (event_id % 3) end, 4) as ratio from events""")
def try_catch(t: Tables) -> DataFrame:
    k = K.attempt(F.substring("event_type", 1, 1).try_cast("int"), F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).cast("long")
    return t.events.select("event_id", k.alias("k"), F.round(K.attempt(F.try_divide(F.col("value"), F.col("event_id") % 3), F.lit(-1.0)), 4).alias("ratio"))


@query("""select c_custkey, string_agg(o_orderkey::varchar, ' ' order by o_orderkey) as orders from customer join orders on o_custkey = c_custkey where o_totalprice > 450000 group by 1""")
def where_populated(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 450000").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    rows = t.customer.select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("orders", F.array_join(F.transform("keys", lambda k: k.cast("string")), " "))
    return K.where_populated(rows.select("c_custkey", "orders"), "orders")


@query("""select 'none' as name union all select r_name from region union all select 'end'""")
def on_empty(t: Tables) -> DataFrame:
    """A fallback where nothing is found, and an extra row where something is."""
    none = K.on_empty(t.nation.where("n_nationkey < 0").select(F.col("n_name").alias("name")), t.spark.sql("select 'none' as name"))
    return none.unionByName(K.on_non_empty(t.region.select(F.col("r_name").alias("name")), t.spark.sql("select 'end' as name")))


@query("""select p_partkey, p_size from part where p_size >= 1""")
def assert_rows(t: Tables) -> DataFrame:
    return K.checked(t.part, F.col("p_size") >= 1, "a part without a size").select("p_partkey", "p_size")


@query("""select event_id, value > 0 as a, length(event_type) > 0 as b, (event_id % 2) <> 0 as c from events""")
def effective_boolean(t: Tables) -> DataFrame:
    odd = (F.col("event_id") % 2).cast("long")
    return t.events.select("event_id", ebv(F.col("value"), T.DoubleType()).alias("a"), ebv(F.col("event_type"), T.StringType()).alias("b"), ebv(odd, T.LongType()).alias("c"))


@query("""select vec_id, len(list_filter(embedding, lambda x: x > 0.3::float)) > 0 as some_high, len(list_filter(embedding, lambda x: x <= -0.5::float)) = 0 as every_low from embeddings""")
def quantified_some_every(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.embeddings.select("vec_id", C.some(v, lambda x: x > F.lit(0.3).cast("float")).alias("some_high"), C.every(v, lambda x: x > F.lit(-0.5).cast("float")).alias("every_low"))


@query("""select p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'blue']) as named, len(list_filter(string_split(p_name, ' '), lambda x: x > 's')) > 0 as late from part""")
def general_comparison_sequences(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", general_equal(words, F.array(F.lit("red"), F.lit("blue"))).alias("named"), general_compare(words, F.array(F.lit("s")), lambda x, y: x > y).alias("late"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as integer) is not null as castable, try_cast(json_extract_string(props, '$.k') as double) as k from events""")
def cast_castable(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.try_cast("int").isNotNull().alias("castable"), k.try_cast("double").alias("k"))


@query("""select o_orderkey, (o_orderkey // 7)::bigint as q, (o_orderkey % 7)::bigint as r, (-o_orderkey % 7)::bigint as m from orders""")
def arithmetic(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", integer_divide(k, F.lit(7)).alias("q"), modulo(k, F.lit(7)).alias("r"), modulo(-k, F.lit(7)).alias("m"))


@query("""select i as item, i * i as square from range(1, 101) r(i)""")
def range_sequence(t: Tables) -> DataFrame:
    return sequence(t.spark, 1, 100).select("item", (F.col("item") * F.col("item")).alias("square"))


@query("""select p_partkey, p_type as kind, p_size from part where p_size > 45""")
def record_lookup(t: Tables) -> DataFrame:
    record = t.part.select("p_partkey", F.struct(F.col("p_type").alias("kind"), F.col("p_size").alias("size")).alias("r"))
    return record.where("r.size > 45").select("p_partkey", "r.kind", F.col("r.size").alias("p_size"))


@query("""select o_orderkey, round(o_totalprice * (1 - 0.1::double), 4) as net from orders""")
def udf_function(t: Tables) -> DataFrame:
    sql_function(t.spark, "lamina_net", "p DOUBLE, d DOUBLE", "DOUBLE", "p * (1 - d)")
    base = Functions()
    base.define("net", lambda p: p * 1.0)
    own = Functions(base)
    own.define("net", lambda p: F.expr("lamina_net(o_totalprice, 0.1D)") + 0 * base.call("net", p))
    return t.orders.select("o_orderkey", F.round(own.call("net", F.col("o_totalprice")), 4).alias("net"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as a from part) select p_partkey, a[i] as word, i::bigint as at from w, unnest(generate_series(1, len(a))) g(i)""")
def udtf_template(t: Tables) -> DataFrame:
    t.spark.udtf.register("lamina_words", WordsTemplate)
    t.part.createOrReplaceTempView("lamina_part")
    return t.spark.sql("select p_partkey, w.word, cast(w.at as bigint) as at from lamina_part, lateral lamina_words(p_name) w")


@query("""select c_custkey, upper(c_mktsegment) || '!' as v from customer where c_acctbal > 9000""")
def evaluate_dynamic(t: Tables) -> DataFrame:
    return t.customer.where(evaluate("c_acctbal > 9000")).select("c_custkey", evaluate("upper(c_mktsegment) || '!'").alias("v"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, event_type as t from events where json_extract_string(props, '$.k')::bigint > 90""")
def json_props(t: Tables) -> DataFrame:
    v = J.variant(F.col("props"))
    rows = t.events.select("event_id", J.lookup(v, "$.k", "bigint").alias("k"), J.parse(F.col("props"), "k long").alias("p"), F.col("event_type").alias("t"))
    return rows.where("p.k > 90").select("event_id", "k", "t")


@query("""select n_name as name, r_name as region, length(n_name)::bigint as n from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA'""")
def pipeline_chaining(t: Tables) -> DataFrame:
    """A query over another's result, as fn:transform and sequence chaining have it."""

    def first(df: DataFrame) -> DataFrame:
        return df.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))

    def second(df: DataFrame) -> DataFrame:
        return df.where("region <> 'ASIA'").withColumn("n", F.length("name").cast("long"))

    return t.nation.transform(first).transform(second)


@query("""select o_orderkey, 'order ' || o_orderkey || ' {' || o_orderstatus || '}' as label from orders""")
def avt_template(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", V.template(t.orders, "order {o_orderkey} {{{o_orderstatus}}}").alias("label"))


@query("""select p_partkey, p_size::bigint as p_size, p_name, (p_size between 1 and 50) as fits from part""")
def coerce_types(t: Tables) -> DataFrame:
    rows = V.context_item(t.part.withColumn("p_size", F.col("p_size").cast("string")), "required", "p_partkey long, p_size long, p_name string")
    return rows.withColumn("fits", V.treat_as(F.col("p_size"), F.col("p_size") > 0, "a size").between(1, 50))


@query("""select conv_id, n = 1 as one, n <= 1 as at_most, true as some from (select conv_id, count(*) filter (where role = 'system') as n from conversations group by 1)""")
def instance_of_type(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "system", F.col("text"))).alias("x"), F.collect_list("role").alias("r"))
    return rows.select("conv_id", V.instance_of(rows, "x", "string").alias("one"), V.instance_of(rows, "x", "string", "?").alias("at_most"), V.instance_of(rows, "r", "string", "+").alias("some"))


@query("""select n_nationkey, 'NATION_' || n_nationkey as local, (n_regionkey = 1) as same from nation""")
def qname_functions(t: Tables) -> DataFrame:
    a = V.qname(F.col("n_regionkey").cast("string"), F.concat(F.lit("a:"), F.col("n_name")))
    b = V.qname(F.lit("1"), F.concat(F.lit("b:"), F.col("n_name")))
    return t.nation.select("n_nationkey", a["local"].alias("local"), V.qname_equal(a, b).alias("same"))
