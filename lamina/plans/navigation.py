"""Trees, XML and other serialized forms, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import values as V
from lamina.operators import joins as J
from lamina.operators import nodes as X
from lamina.operators import sets as U
from lamina.plans.registry import Tables, query
from lamina.session import shared_folder
from lamina.sources import readers, sinks


def _world(t: Tables) -> DataFrame:
    """One XML document for each region with its nations and suppliers."""
    suppliers = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", sinks.element("supplier", sinks.text_node(F.col("s_name")), attributes={"key": F.col("s_suppkey")}).alias("x")))).alias("s"))
    nations = t.nation.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    inner = F.coalesce(F.array_join(F.transform("s", lambda x: x["x"]), ""), F.lit(""))
    nations = nations.withColumn("x", sinks.element("nation", sinks.element("name", sinks.text_node(F.col("n_name"))), inner, attributes={"key": F.col("n_nationkey")}))
    regions = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "x"))), lambda v: v["x"]), "").alias("body"))
    rows = t.region.join(regions, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("r_regionkey").cast("long").alias("doc_id"), sinks.element("region", F.col("body"), attributes={"name": F.col("r_name")}).alias("xml"))


def _nodes(t: Tables) -> DataFrame:
    return X.nodes(_world(t))


def _elements(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("kind") == "element") & (F.col("name") == name))


@query("""select r_regionkey::bigint as doc_id, count(distinct n_nationkey)::bigint as nations, count(s_suppkey)::bigint as suppliers from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by 1""")
def xml_node_table(t: Tables) -> DataFrame:
    e = _nodes(t).where("kind = 'element'")
    return e.groupBy("doc_id").agg(F.count_if(F.col("name") == "nation").alias("nations"), F.count_if(F.col("name") == "supplier").alias("suppliers"))


@query("""select r_regionkey::bigint as doc_id, n_name as name from nation join region on n_regionkey = r_regionkey""")
def axes_child(t: Tables) -> DataFrame:
    """region/nation/name by two child steps, then the string value."""
    n = _nodes(t)
    names = X.axis(X.axis(_elements(n, "region"), _elements(n, "nation"), "child"), _elements(n, "name"), "child")
    return X.string_value(n, names).select("doc_id", F.col("string_value").alias("name"))


@query("""select n_regionkey::bigint as doc_id, s_suppkey as key from supplier join nation on s_nationkey = n_nationkey""")
def axes_descendant(t: Tables) -> DataFrame:
    n = _nodes(t)
    suppliers = X.axis(_elements(n, "region"), _elements(n, "supplier"), "descendant")
    keys = X.axis(suppliers, n.where("name = 'key'"), "attribute")
    return keys.select("doc_id", F.col("value").cast("long").alias("key"))


@query("""select s_suppkey as key, 3::bigint as n from supplier""")
def axes_ancestor(t: Tables) -> DataFrame:
    """Each supplier with how many elements contain it or are it."""
    n = _nodes(t).where("kind in ('element', 'attribute')")
    e = n.where("kind = 'element'")
    pairs = X.axis(_elements(n, "supplier"), e, "ancestor-or-self", by_context=True).groupBy("doc_id", "context_pre").agg(F.count(F.lit(1)).alias("n"))
    keys = n.where("kind = 'attribute' and name = 'key'").select("doc_id", F.col("parent_pre").alias("context_pre"), F.col("value").cast("long").alias("key"))
    return pairs.join(keys, ["doc_id", "context_pre"]).select("key", "n")


@query("""select n_nationkey::bigint as key, (row_number() over w - 1)::bigint as before, (count(*) over (partition by n_regionkey) - row_number() over w)::bigint as after from nation window w as (partition by n_regionkey order by n_nationkey)""")
def axes_sibling(t: Tables) -> DataFrame:
    n = _nodes(t)
    nations = _elements(n, "nation")
    count = lambda axis, name: X.axis(nations, nations, axis, by_context=True).groupBy("doc_id", "context_pre").agg(F.count(F.lit(1)).alias(name))
    keys = n.where("kind = 'attribute' and name = 'key'").join(nations.select("doc_id", F.col("pre").alias("parent_pre")), ["doc_id", "parent_pre"])
    rows = keys.select("doc_id", F.col("parent_pre").alias("context_pre"), F.col("value").cast("long").alias("key"))
    for axis, name in (("preceding-sibling", "before"), ("following-sibling", "after")):
        rows = rows.join(count(axis, name), ["doc_id", "context_pre"], "left")
    return rows.select("key", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("""with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) as p from nation) select a.n_nationkey::bigint as key, count(s_suppkey)::bigint as later from n a left join n b on a.n_regionkey = b.n_regionkey and b.p > a.p left join supplier on s_nationkey = b.n_nationkey group by 1""")
def axes_following(t: Tables) -> DataFrame:
    """Suppliers that come after a nation has ended."""
    n = _nodes(t)
    nations = _elements(n, "nation")
    after = X.axis(nations, _elements(n, "supplier"), "following", by_context=True).groupBy("doc_id", "context_pre").agg(F.count(F.lit(1)).alias("later"))
    keys = n.where("kind = 'attribute' and name = 'key'").select("doc_id", F.col("parent_pre").alias("context_pre"), F.col("value").cast("long").alias("key"))
    rows = nations.select("doc_id", F.col("pre").alias("context_pre")).join(keys, ["doc_id", "context_pre"]).join(after, ["doc_id", "context_pre"], "left")
    return rows.select("key", F.coalesce("later", F.lit(0)).alias("later"))


@query("""select n_regionkey::bigint as doc_id, '/region[1]/nation[' || row_number() over (partition by n_regionkey order by n_nationkey)::varchar || ']' as path from nation""")
def node_paths(t: Tables) -> DataFrame:
    paths = X.node_path(_nodes(t))
    return paths.where(F.col("path").rlike(r"^/region\[1\]/nation\[\d+\]$")).select("doc_id", "path")


@query("""select r_regionkey::bigint as doc_id, 'region' as name from region""")
def outermost_nodes(t: Tables) -> DataFrame:
    e = _nodes(t).where("kind = 'element'")
    return U.outermost(e).select("doc_id", "name")


@query("""select n_regionkey::bigint as doc_id, count(*)::bigint as n from (select n_regionkey from nation union all select n_regionkey from supplier join nation on s_nationkey = n_nationkey) group by 1""")
def innermost_nodes(t: Tables) -> DataFrame:
    """name and supplier elements hold no other element."""
    e = _nodes(t).where("kind = 'element'")
    return U.innermost(e).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select n_nationkey::bigint as key, n_name as name from nation""")
def xml_roundtrip(t: Tables) -> DataFrame:
    """Rows to XML by the built-in writer's function and back by schema."""
    rows = t.nation.select(F.to_xml(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("x"))
    return rows.select(readers.parse_xml(F.col("x"), "key long, name string").alias("r")).select("r.*")


@query("""select r_regionkey::bigint as doc_id, r_name as name, count(*)::bigint as n from region join nation on n_regionkey = r_regionkey group by 1, 2""")
def xpath_extract(t: Tables) -> DataFrame:
    return _world(t).select("doc_id", F.xpath_string("xml", F.lit("/region/@name")).alias("name"), F.xpath_number("xml", F.lit("count(/region/nation)")).cast("long").alias("n"))


@query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href="[^"]*"'))::bigint as links from pages""")
def html_page_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), F.lit(0))).cast("long").alias("links"))


@query("""select o_orderpriority || '.txt' as href, count(*)::bigint as n_items, string_agg(o_orderkey::varchar, chr(10) order by o_orderkey) as content from orders where o_totalprice > 480000 group by 1""")
def result_documents(t: Tables) -> DataFrame:
    rows = t.orders.where("o_totalprice > 480000")
    return sinks.result_documents(rows, F.concat("o_orderpriority", F.lit(".txt")), F.col("o_orderkey"), ["o_orderkey"], "\n")


@query("""select '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' as output from nation""")
def serialize_json(t: Tables) -> DataFrame:
    return sinks.serialized(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), sinks.Output("json"))


@query("""select n_nationkey || ',' || n_name as output from nation""")
def serialize_csv(t: Tables) -> DataFrame:
    return sinks.serialized(t.nation.select("n_nationkey", "n_name"), sinks.Output("csv"))


@query("""select '<nation><key>' || n_nationkey || '</key><name>' || replace(n_name, '_', '&#95;') || '</name></nation>' as output from nation""")
def serialize_xml(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return sinks.serialized(rows, sinks.Output("xml", character_map={"_": "&#95;"}), "nation")


@query("""select 'map{"key":' || n_nationkey || ',"name":"' || n_name || '"}' as output from nation""")
def serialize_adaptive(t: Tables) -> DataFrame:
    return sinks.serialized(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), sinks.Output("adaptive"))


@query("""select n_nationkey || ' ' || n_name as output from nation""")
def serialize_text(t: Tables) -> DataFrame:
    return sinks.serialized(t.nation.select("n_nationkey", "n_name"), sinks.Output("text"))


@query("""select p_partkey, '<p class="' || p_type || '">' || p_name || '<br></p>' as output from part""")
def serialize_html(t: Tables) -> DataFrame:
    body = sinks.element("p", sinks.text_node(F.col("p_name")), sinks.element("br", method="html"), attributes={"class": F.col("p_type")}, method="html")
    return t.part.select("p_partkey", body.alias("output"))


@query("""select 'a' as uri, '<a><b>1</b><b>2</b></a>' as xml union all select 'c', '<c/>'""")
def xinclude_expand(t: Tables) -> DataFrame:
    docs = t.spark.createDataFrame([("a", '<a><xi:include href="b1"/><xi:include href="b2"/></a>'), ("c", "<c/>")], "uri string, xml string")
    parts = t.spark.createDataFrame([("b1", "<?xml version='1.0'?><b>1</b>"), ("b2", "<b>2</b>")], "uri string, xml string")
    return readers.include(t.spark, docs, parts)


def _place(t: Tables, kind: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(t.spark)}/lamina-{kind}-{uuid.uuid4().hex}"


@query("""select n_nationkey::bigint as "_key", n_name as name from nation""")
def xml_file_source(t: Tables) -> DataFrame:
    """Rows written as an XML file in the shared folder and read by row tag; attributes are _columns."""
    rows = t.nation.select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name"))
    path = _place(t, "xml")
    sinks.write(rows, path, sinks.Output("xml"), "nation", "nations")
    return readers.xml(t.spark, path, "nation", "_key long, name string")


@query("""select n_regionkey::bigint as doc_id, 'nation' as what, count(*)::bigint as n from nation group by 1 union all select n_regionkey, 'any', count(*) from (select n_regionkey from nation union all select n_regionkey from nation join supplier on s_nationkey = n_nationkey) group by 1""")
def path_patterns(t: Tables) -> DataFrame:
    """Elements by path glob: /region/nation, and anything two steps or more below region that is not a nation's text."""
    paths = X.node_path(_nodes(t)).withColumn("path", F.regexp_replace("path", r"\[\d+\]", ""))
    a = paths.where(V.path_matches(F.col("path"), "/region/nation")).groupBy("doc_id").agg(F.lit("nation").alias("what"), F.count(F.lit(1)).alias("n"))
    b = paths.where(V.path_matches(F.col("path"), "/region/*/**/*")).groupBy("doc_id").agg(F.lit("any").alias("what"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("""select a.n_nationkey::bigint as a, count(b.n_nationkey)::bigint as before from nation a left join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey < a.n_nationkey group by 1""")
def node_order(t: Tables) -> DataFrame:
    """How many nations of its document stand before each, by comparing nodes."""
    n = _nodes(t)
    keys = n.where("kind = 'attribute' and name = 'key'").select("doc_id", F.col("parent_pre").alias("pre"), F.col("value").cast("long").alias("key"))
    nations = _elements(n, "nation").select("doc_id", "pre").join(keys, ["doc_id", "pre"])
    a, b = nations.alias("a"), nations.alias("b")
    test = (F.col("a.doc_id") == F.col("b.doc_id")) & V.precedes(F.col("b.doc_id"), F.col("b.pre"), F.col("a.doc_id"), F.col("a.pre"))
    return a.join(b, test, "left").groupBy(F.col("a.key").alias("a")).agg(F.count("b.key").alias("before"))


@query("""select 1::bigint as doc_id, 'element' as kind, 2::bigint as n union all select 1, 'text', 1 union all select 2, 'element', 2 union all select 2, 'text', 1""")
def strip_space_nodes(t: Tables) -> DataFrame:
    """White-space text goes, except below a preserving element."""
    docs = t.spark.createDataFrame([(1, "<a>  <b>x</b>\n</a>"), (2, "<a> <pre> </pre></a>")], "doc_id long, xml string")
    return readers.strip_space(X.nodes(docs), ("pre",)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""select n_nationkey as key, n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey""")
def json_file_source(t: Tables) -> DataFrame:
    """Nested records to JSON files and back."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region")).alias("of"))
    path = _place(t, "json")
    sinks.write(rows, path, sinks.Output("json"))
    return readers.Sources(t.spark).json(path, "key int, of struct<name:string,region:string>").select("key", "of.*")


@query("""select n_nationkey as key, n_name as name from nation""")
def csv_file_source(t: Tables) -> DataFrame:
    path = _place(t, "csv")
    sinks.write(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path, sinks.Output("csv"))
    return readers.Sources(t.spark).csv(path, "key int, name string")


@query("""select n_nationkey || '|' || n_name as line from nation""")
def text_lines_source(t: Tables) -> DataFrame:
    """unparsed-text-lines over what the text method wrote."""
    path = _place(t, "text")
    sinks.write(t.nation.select("n_nationkey", "n_name"), path, sinks.Output("text", item_separator="|"))
    return readers.Sources(t.spark).lines(path)


@query("""select 0 as document, n_nationkey::bigint as "_key" from nation where n_regionkey = 1 union all select 1, n_nationkey from nation where n_regionkey = 0""")
def collection_source(t: Tables) -> DataFrame:
    """A registered collection of two documents, in the order of registration."""
    sources = readers.Sources(t.spark)
    paths = []
    for region in (1, 0):
        path = _place(t, f"part{region}")
        rows = t.nation.where(F.col("n_regionkey") == region).select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name")).coalesce(1)
        sinks.write(rows, path, sinks.Output("xml"), "nation", "nations")
        paths.append(path)
    sources.register_collection("nations", paths)
    return sources.collection("nations", "nation", "_key long, name string").select(F.col("_document").alias("document"), "_key")


@query("""select true as there, false as missing""")
def document_available(t: Tables) -> DataFrame:
    sources = readers.Sources(t.spark)
    found = sources.available(f"{t.folder}/nation.parquet"), sources.available(f"{t.folder}/no-such-table.parquet")
    return t.spark.range(1).select(F.lit(found[0]).alias("there"), F.lit(found[1]).alias("missing"))


@query("""select 1 as id, 5 as n, false as bad union all select 2, null, true""")
def xml_lax_validation(t: Tables) -> DataFrame:
    """Lax validation keeps a row that does not fit its declared type, marked; strict would fail."""
    rows = t.spark.createDataFrame([(1, "<r><n>5</n></r>"), (2, "<r><n>five</n></r>")], "id int, xml string")
    parsed = readers.parse_xml(F.col("xml"), "n int, _corrupt_record string", mode="PERMISSIVE")
    return rows.select("id", parsed.alias("r")).select("id", F.col("r.n").alias("n"), F.col("r._corrupt_record").isNotNull().alias("bad"))


@query("""select string_agg(r_name, ' / ' order by r_regionkey) as output from region""")
def item_separator(t: Tables) -> DataFrame:
    return sinks.item_joined(t.region, "r_name", ["r_regionkey"], " / ")


@query("""select s_suppkey as key, n_name as nation from supplier join nation on s_nationkey = n_nationkey""")
def id_lookup(t: Tables) -> DataFrame:
    """id(): nodes by their identifier, here suppliers' nations by nation id."""
    by_id = J.Key(t.nation.select("n_nationkey", "n_name"), (F.col("n_nationkey"),))
    return J.key_lookup(t.supplier.select("s_suppkey", "s_nationkey"), by_id, (F.col("s_nationkey"),)).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("nation"))


@query("""select r_regionkey::bigint as doc_id, 'd' || r_regionkey || 'n0' as id, count(*)::bigint as children from region join nation on n_regionkey = r_regionkey group by 1, 2""")
def node_functions(t: Tables) -> DataFrame:
    """generate-id, has-children and the name of each document's root."""
    n = _nodes(t)
    roots = n.where("parent_pre is null")
    kids = X.axis(roots, n, "child").groupBy("doc_id").agg(F.count(F.lit(1)).alias("children"))
    return roots.join(kids, "doc_id").select("doc_id", X.generate_id(F.col("doc_id"), F.col("pre")).alias("id"), "children")
