"""Trees as tables: XML texts to nodes, and the axes as joins.

nodes(doc_id, pre, post, level, parent_pre, kind, name, value, sib_pos, name_pos): pre and post are ranks of a node's start and end among all
starts and ends of its document, so containment is a pair of comparisons and document order is pre.
"""

from __future__ import annotations

import xml.sax
from collections.abc import Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, pre long, post long, level int, parent_pre long, kind string, name string, value string, sib_pos long, name_pos long"


class _Builder(xml.sax.ContentHandler, xml.sax.handler.LexicalHandler):
    """Collects rows of one document as parsing goes; DTDs are not processed."""

    def __init__(self, doc_id: int, strip: bool):
        super().__init__()
        self.doc, self.strip, self.clock, self.rows, self.text = doc_id, strip, 0, [], []
        self.open: list[dict] = [{"pre": None, "level": -1, "n": 0, "names": {}, "row": None}]

    def _begin(self, kind: str, name: str | None, value: str | None) -> dict:
        top = self.open[-1]
        top["n"] += 1
        top["names"][name] = top["names"].get(name, 0) + 1
        row = {"doc_id": self.doc, "pre": self.clock, "post": None, "level": top["level"] + 1, "parent_pre": top["pre"], "kind": kind, "name": name, "value": value, "sib_pos": top["n"], "name_pos": top["names"][name]}
        self.clock += 1
        self.rows.append(row)
        return row

    def _leaf(self, kind: str, name: str | None, value: str) -> None:
        row = self._begin(kind, name, value)
        row["post"] = self.clock
        self.clock += 1

    def _flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text and not (self.strip and not text.strip()):
            self._leaf("text", None, text)

    def startElement(self, name, attrs):  # noqa: N802
        self._flush()
        row = self._begin("element", name, None)
        self.open.append({"pre": row["pre"], "level": row["level"], "n": 0, "names": {}, "row": row})
        for i, (k, v) in enumerate(attrs.items(), 1):
            self._leaf("attribute", k, v)
            self.rows[-1]["sib_pos"] = i
        self.open[-1].update(n=0, names={})

    def endElement(self, name):  # noqa: N802
        self._flush()
        row = self.open.pop()["row"]
        row["post"] = self.clock
        self.clock += 1

    def characters(self, content):
        self.text.append(content)

    def processingInstruction(self, target, data):  # noqa: N802
        self._flush()
        self._leaf("pi", target, data)

    def comment(self, content):
        self._flush()
        self._leaf("comment", None, content)

    def startCDATA(self): ...  # noqa: N802

    def endCDATA(self): ...  # noqa: N802

    def startDTD(self, name, public_id, system_id):  # noqa: N802
        raise xml.sax.SAXException("DTDs are not processed")

    def endDTD(self): ...  # noqa: N802


def parse(doc_id: int, text: str, strip_space: bool = False) -> list[dict]:
    """The nodes of one text, in document order."""
    builder = _Builder(doc_id, strip_space)
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setFeature(xml.sax.handler.feature_external_pes, False)
    parser.setContentHandler(builder)
    parser.setProperty(xml.sax.handler.property_lexical_handler, builder)
    parser.parse(StringIO(text))
    return builder.rows


def nodes(df: DataFrame, doc: str = "doc_id", text: str = "xml", strip_space: bool = False, lax: bool = False) -> DataFrame:
    """The node table of a column of XML texts; null texts have no nodes.  lax: texts that are not well formed have none, instead of raising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, xml_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if xml_text is None:
                    continue
                try:
                    rows = parse(doc_id, xml_text, strip_space)
                except xml.sax.SAXException:
                    if not lax:
                        raise
                    continue
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return df.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("level", pa.int32()), ("parent_pre", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("sib_pos", pa.int64()), ("name_pos", pa.int64())]
)


def _axis(context: DataFrame, table: DataFrame, test, distinct: bool = True) -> DataFrame:
    """Nodes of the table on an axis from any context node, each once; test gets (node, context) column getters."""
    c, n = context.select("doc_id", "pre", "post", "parent_pre", "sib_pos", "level").alias("c"), table.alias("n")
    col_n, col_c = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"c.{x}"))
    return n.join(c, (col_n("doc_id") == col_c("doc_id")) & test(col_n, col_c), "left_semi") if distinct else n.join(c, (col_n("doc_id") == col_c("doc_id")) & test(col_n, col_c)).select("n.*", F.col("c.pre").alias("context_pre"))


_NO_ATTRIBUTE = lambda n: n("kind") != "attribute"
AXES = {
    "child": lambda n, c: (n("parent_pre") == c("pre")) & _NO_ATTRIBUTE(n),
    "self": lambda n, c: n("pre") == c("pre"),
    "attribute": lambda n, c: (n("parent_pre") == c("pre")) & (n("kind") == "attribute"),
    "parent": lambda n, c: n("pre") == c("parent_pre"),
    "descendant": lambda n, c: (n("pre") > c("pre")) & (n("post") < c("post")) & _NO_ATTRIBUTE(n),
    "descendant-or-self": lambda n, c: (n("pre") >= c("pre")) & (n("post") <= c("post")) & (_NO_ATTRIBUTE(n) | (n("pre") == c("pre"))),
    "ancestor": lambda n, c: (n("pre") < c("pre")) & (n("post") > c("post")),
    "ancestor-or-self": lambda n, c: (n("pre") <= c("pre")) & (n("post") >= c("post")),
    "following": lambda n, c: (n("pre") > c("post")) & _NO_ATTRIBUTE(n),
    "preceding": lambda n, c: (n("post") < c("pre")) & _NO_ATTRIBUTE(n),
    "following-sibling": lambda n, c: (n("parent_pre") == c("parent_pre")) & (n("pre") > c("pre")) & _NO_ATTRIBUTE(n),
    "preceding-sibling": lambda n, c: (n("parent_pre") == c("parent_pre")) & (n("pre") < c("pre")) & _NO_ATTRIBUTE(n),
}


def axis(context: DataFrame, table: DataFrame, name: str, by_context: bool = False) -> DataFrame:
    """The nodes on an axis from the context nodes, each once; by_context: a row for each pair, with context_pre.

    All axes join on doc_id, those of parent and child also on the parent, so a collection spreads over the cluster by document."""
    return _axis(context, table, AXES[name], distinct=not by_context)


def string_value(table: DataFrame, context: DataFrame) -> DataFrame:
    """(doc_id, pre, string_value) of elements: their text nodes in document order, joined."""
    texts = axis(context, table.where("kind = 'text'"), "descendant", by_context=True)
    joined = texts.groupBy("doc_id", "context_pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("_text"))
    j = joined.select("doc_id", F.col("context_pre").alias("pre"), "_text")
    return context.select("doc_id", "pre").join(j, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("_text", F.lit("")).alias("string_value"))


def generate_id(doc: Column, pre: Column) -> Column:
    return F.concat(F.lit("d"), doc.cast("string"), F.lit("n"), pre.cast("string"))


def node_path(table: DataFrame) -> DataFrame:
    """(doc_id, pre, path) of elements: /a[1]/b[2] with positions among siblings of a name."""
    elements = table.where("kind = 'element'")
    pairs = axis(elements, elements, "ancestor-or-self", by_context=True)
    grouped = pairs.groupBy("doc_id", "context_pre").agg(F.array_sort(F.collect_list(F.struct("pre", "name", "name_pos"))).alias("steps"))
    text = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("/"), s["name"], F.lit("["), s["name_pos"].cast("string"), F.lit("]"))), "")
    return grouped.select("doc_id", F.col("context_pre").alias("pre"), text.alias("path"))


def number_levels(table: DataFrame, name: str) -> DataFrame:
    """level=multiple numbering: for each element of a name, its ancestors' and its own ordinals among siblings of that name."""
    own = table.where((F.col("kind") == "element") & (F.col("name") == name))
    pairs = axis(own, own, "ancestor-or-self", by_context=True)
    grouped = pairs.groupBy("doc_id", "context_pre").agg(F.array_sort(F.collect_list(F.struct("pre", "name_pos"))).alias("_levels"))
    return grouped.select("doc_id", F.col("context_pre").alias("pre"), F.transform("_levels", lambda s: s["name_pos"]).alias("numbers"))


def siblings(table: DataFrame) -> DataFrame:
    """Nodes with the value of the sibling before and after: windows instead of joins."""
    w = Window.partitionBy("doc_id", "parent_pre").orderBy("pre")
    return table.where("kind != 'attribute'").withColumn("before", F.lag("pre").over(w)).withColumn("after", F.lead("pre").over(w))


def _nearest(table: DataFrame, marks: DataFrame, *by: str) -> DataFrame:
    """(doc_id, pre, by.., value): for each element the value of the nearest mark on it or an ancestor.  marks: (doc_id, pre of an element, by.., value)."""
    elements = table.where("kind = 'element'")
    places = elements.join(marks.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi")
    pairs = axis(elements, places, "ancestor-or-self", by_context=True).select("doc_id", "pre", "context_pre")
    found = pairs.join(marks, ["doc_id", "pre"]).groupBy("doc_id", "context_pre", *by).agg(F.max_by("value", "pre").alias("value"))
    return found.select("doc_id", F.col("context_pre").alias("pre"), *by, "value")


def _attributes(table: DataFrame, test: Column) -> DataFrame:
    return table.where((F.col("kind") == "attribute") & test).select("doc_id", F.col("parent_pre").alias("pre"), "name", "value")


def namespaces(table: DataFrame) -> DataFrame:
    """The namespace axis: (doc_id, pre, prefix, uri) of the namespaces in scope of each element; the default one has the prefix ''.

    A declaration hides those of its prefix above it, and one without a URI takes the prefix out of scope; xml is always there."""
    marks = _attributes(table, (F.col("name") == "xmlns") | F.col("name").startswith("xmlns:")).select("doc_id", "pre", F.regexp_replace("name", "^xmlns:?", "").alias("prefix"), "value")
    xml = table.where("kind = 'element'").select("doc_id", "pre", F.lit("xml").alias("prefix"), F.lit("http://www.w3.org/XML/1998/namespace").alias("value"))
    return _nearest(table, marks, "prefix").where("value != ''").unionByName(xml).withColumnRenamed("value", "uri")


def language(table: DataFrame) -> DataFrame:
    """(doc_id, pre, value): the xml:lang in force at each element that has one."""
    return _nearest(table, _attributes(table, F.col("name") == "xml:lang").drop("name"))


def speaks(language: Column, wanted: str) -> Column:
    """lang(): whether a language is the wanted one or a variety of it, whatever the case."""
    return F.coalesce((F.lower(language) == wanted.lower()) | F.lower(language).startswith(wanted.lower() + "-"), F.lit(False))


def base_uri(table: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, pre, base_uri) of elements: the nearest absolute xml:base, else the document's own; documents: (doc_id, uri)."""
    near = _nearest(table, _attributes(table, F.col("name") == "xml:base").drop("name"))
    out = table.where("kind = 'element'").select("doc_id", "pre").join(near, ["doc_id", "pre"], "left").join(documents, "doc_id", "left")
    return out.select("doc_id", "pre", F.coalesce("value", "uri").alias("base_uri"))


def nilled(table: DataFrame) -> DataFrame:
    """Elements with xsi:nil true."""
    marks = _attributes(table, F.col("name") == "xsi:nil").where(F.trim("value").isin("true", "1"))
    return table.where("kind = 'element'").join(marks.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
