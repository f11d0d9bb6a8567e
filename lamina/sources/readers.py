"""Sources: XML, JSON, text and tables from files, columns or values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Sources:
    """Documents by URI: registered tables first, then files.  Preloaded resources and collections live here too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.preloaded, self.collections = spark, {}, {}

    def preload(self, uri: str, df: DataFrame) -> None:
        self.preloaded[uri] = df

    def register_collection(self, uri: str, paths: list[str]) -> None:
        self.collections[uri] = list(paths)

    def available(self, uri: str) -> bool:
        """doc-available: whether a preloaded table or a path of that name exists, on any file system that Spark knows."""
        if uri in self.preloaded:
            return True
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def stream_available(self, uri: str) -> bool:
        """stream-available: whether the path is there and a stream of files can read it, so no preloaded table."""
        return uri not in self.preloaded and self.available(uri)

    def document(self, uri: str, row_tag: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
        """Rows of an XML document: one for each element of the row tag, attributes as _name columns."""
        return self.preloaded[uri] if uri in self.preloaded else xml(self.spark, uri, row_tag, schema, **options)

    def collection(self, uri: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The rows of all registered documents, with ``_document`` as the place in the order of registration."""
        paths = self.collections[uri]
        rows = xml(self.spark, paths, row_tag, schema)
        file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
        place = F.lit(-1)
        for i, p in enumerate(paths):  # a path is a file or a folder of files
            whole = self._whole(p)
            place = F.when((file == whole) | file.startswith(whole + "/"), i).otherwise(place)
        return rows.withColumn("_document", place)

    def _whole(self, uri: str) -> str:
        """A path with its file system, as Spark names files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri.rstrip("/"))
        qualified = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path)
        return re.sub("^file:/+", "file:/", qualified.toUri().toString())

    def text(self, uri: str) -> DataFrame:
        """unparsed-text: one row with the whole text of each file."""
        return self.spark.read.text(uri, wholetext=True).withColumnRenamed("value", "text")

    def lines(self, uri: str) -> DataFrame:
        """unparsed-text-lines."""
        return self.spark.read.text(uri).withColumnRenamed("value", "line")

    def json(self, uri: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
        reader = self.spark.read.option("multiLine", multiline)
        return (reader.schema(schema) if schema else reader).json(uri)

    def parquet(self, uri: str) -> DataFrame:
        return self.spark.read.parquet(uri)

    def csv(self, uri: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
        reader = self.spark.read.option("header", header)
        return (reader.schema(schema) if schema else reader).csv(uri)


def xml(spark: SparkSession, uri: str | list[str], row_tag: str, schema: T.StructType | str | None = None, validation: str = "strip", xsd: str | None = None, **options: str) -> DataFrame:
    """validation: strict fails at the first bad row, lax keeps it in _corrupt_record, strip and preserve take what parses."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST" if validation == "strict" else "PERMISSIVE")
    if xsd:
        reader = reader.option("rowValidationXSDPath", xsd)
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema(schema) if schema else reader).load(uri)


def parse_xml(c: Column, schema: str, **options: str) -> Column:
    """XML in a column to a struct."""
    return F.from_xml(c, schema, options or None)


def empty_source(spark: SparkSession) -> DataFrame:
    """The source of a query without one: a single row."""
    return spark.range(1).select(F.lit(True).alias("empty"))


def sequence(spark: SparkSession, start: int, end: int, name: str = "item") -> DataFrame:
    """start to end, both included."""
    return spark.range(start, end + 1).withColumnRenamed("id", name)


def strip_space(nodes: DataFrame, preserve: tuple[str, ...] = ()) -> DataFrame:
    """Without text nodes of white space only, except below the named elements."""
    blank = (F.col("kind") == "text") & (F.trim(F.regexp_replace("value", r"\s+", " ")) == "")
    if not preserve:
        return nodes.where(~F.coalesce(blank, F.lit(False)))
    kept = nodes.where(F.col("name").isin(*preserve)).select("doc_id", F.col("pre").alias("parent_pre")).withColumn("_keep", F.lit(True))
    out = nodes.join(kept, ["doc_id", "parent_pre"], "left")
    return out.where(~F.coalesce(blank, F.lit(False)) | F.col("_keep")).drop("_keep").select(*nodes.columns)


def include(spark: SparkSession, documents: DataFrame, resources: DataFrame, depth: int = 8) -> DataFrame:
    """XInclude: each ``<xi:include href="x"/>`` in (uri, xml) becomes the text of resource x, to a depth; XML declarations go.

    Every level is one join on the reference, so documents and resources may both be large."""
    tag = r"<xi:include\s+href=[\"']([^\"']+)[\"']\s*(?:parse=[\"']xml[\"']\s*)?/>"
    bare = resources.select(F.col("uri").alias("_href"), F.regexp_replace("xml", r"^\s*<\?xml[^>]*\?>\s*", "").alias("_body"))
    out = documents.select("uri", "xml")
    for _ in range(depth):
        if not out.where(F.col("xml").rlike(tag)).take(1):
            return out
        refs = out.select("uri", "xml", F.posexplode(F.split(F.regexp_replace("xml", tag, "\u0000$1\u0001"), "\u0000"))).select("uri", "xml", "pos", "col")
        href = F.when(F.col("col").contains("\u0001"), F.substring_index("col", "\u0001", 1))
        rest = F.when(F.col("col").contains("\u0001"), F.expr("substring(col, instr(col, '\u0001') + 1)")).otherwise(F.col("col"))
        filled = refs.withColumn("_ref", href).withColumn("_rest", rest).join(bare, F.col("_ref") == F.col("_href"), "left")
        found = F.when(F.col("_ref").isNull(), "").otherwise(F.coalesce("_body", F.raise_error(F.concat(F.lit("no resource "), "_ref"))))
        out = filled.groupBy("uri", "xml").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(found, "_rest").alias("t")))).alias("_parts"))
        out = out.select("uri", F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("xml"))
    raise ValueError("includes nest too deep")
