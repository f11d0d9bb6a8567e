"""Sinks and serialization: xml, html, xhtml, text, json, csv and adaptive output, and secondary results by computed name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import strings
from lamina.functions.atomize import text
from lamina.operators.sequence import with_position

#: HTML elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
MAX_RESULTS = 1000


@dataclass(frozen=True)
class Output:
    """Serialization parameters."""

    method: str = "xml"
    item_separator: str = " "
    character_map: dict[str, str] = field(default_factory=dict)
    omit_declaration: bool = True
    csv_options: dict[str, str] = field(default_factory=dict)


def escape(c: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def element(name: str, *content: Column, attributes: dict[str, Column] | None = None, method: str = "xml") -> Column:
    """An element as text.  content: already serialized.  Empty attributes are left out; a later attribute of a name wins."""
    head = F.concat(F.lit(f"<{name}"), *(F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape(v.cast("string"), True), F.lit('"'))).otherwise("") for k, v in (attributes or {}).items()))
    if method in ("html", "xhtml") and name in VOID:
        return F.concat(head, F.lit(" />" if method == "xhtml" else ">"))
    body = F.concat(*(F.coalesce(c, F.lit("")) for c in content)) if content else F.lit("")
    full = F.concat(head, F.lit(">"), body, F.lit(f"</{name}>"))
    return full if method in ("html", "xhtml") else F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(full)


def text_node(c: Column) -> Column:
    return escape(F.coalesce(c.cast("string"), F.lit("")))


def comment(c: Column) -> Column:
    return F.concat(F.lit("<!--"), F.regexp_replace(c, "--", "- -"), F.lit("-->"))


def processing_instruction(target: str, c: Column) -> Column:
    return F.concat(F.lit(f"<?{target} "), c, F.lit("?>"))


def adaptive(c: Column, kind: T.DataType) -> Column:
    """Adaptive output of a value: strings quoted, maps and arrays in their constructors' form, other items as they print."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true()").otherwise("false()")
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: adaptive(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(adaptive(e["key"], kind.keyType), F.lit(":"), adaptive(e["value"], kind.valueType))
        return F.concat(F.lit("map{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(f'"{f.name}":'), adaptive(c[f.name], f.dataType)) for f in kind.fields]
        return F.concat(F.lit("map{"), F.concat_ws(",", *pairs), F.lit("}"))
    return text(c, kind)


def serialized(df: DataFrame, output: Output, name: str = "row", result: str = "output") -> DataFrame:
    """One text for each row, by the output method."""
    fields = df.schema.fields
    whole = F.struct(*df.columns)
    if output.method == "json":
        out = F.to_json(whole)
    elif output.method == "csv":
        out = F.to_csv(whole, output.csv_options or None)
    elif output.method == "text":
        out = F.concat_ws(output.item_separator, *(text(F.col(f.name), f.dataType) for f in fields))
    elif output.method == "adaptive":
        out = adaptive(whole, df.select(whole.alias("s")).schema["s"].dataType)
    else:
        out = element(name, *(element(f.name, text_node(text(F.col(f.name), f.dataType)), method=output.method) for f in fields), method=output.method)
    if output.character_map:
        out = strings.character_map(out, output.character_map)
    return df.select(out.alias(result))


def item_joined(df: DataFrame, c: str, order: list[str], separator: str) -> DataFrame:
    """All items in one text; for small results."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(c).cast("string").alias("_v"))))
    return df.agg(F.array_join(F.transform(pairs, lambda p: p["_v"]), separator).alias("output"))


def write(df: DataFrame, path: str, output: Output, row_tag: str = "row", root_tag: str = "rows") -> None:
    """Files by the output method, from the executors."""
    writer = df.write.mode("errorifexists")
    if output.method == "xml":
        writer.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)
    elif output.method == "json":
        writer.json(path)
    elif output.method == "csv":
        writer.options(header=True, **output.csv_options).csv(path)
    else:
        serialized(df, output, row_tag).write.text(path)


def result_documents(df: DataFrame, href: Column, content: Column, order: list[str], separator: str = "") -> DataFrame:
    """(href, n_items, content): each secondary result's text, its items in order."""
    rows = df.select(href.alias("href"), F.struct(*order, content.cast("string").alias("_c")).alias("_i"))
    grouped = rows.groupBy("href").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("_i")).alias("_all"))
    return grouped.select("href", "n_items", F.array_join(F.transform("_all", lambda i: i["_c"]), separator).alias("content"))


def result_parts(df: DataFrame, href: Column, content: Column, order: list[str], rows: int, separator: str = "") -> DataFrame:
    """(href, part, n_items, content): each secondary result's text in ordered parts of at most so many items, so no task holds a whole result.

    Joined by the separator in the order of their numbers, from 0, a result's parts are its text."""
    items = df.select(href.alias("href"), *order, content.cast("string").alias("_c")).where(F.col("href").isNotNull())
    placed = with_position(items, ["href", *order], None, "_p")
    begins = F.broadcast(placed.groupBy("href").agg(F.min("_p").alias("_begin"))) if items.select("href").distinct().count() <= MAX_RESULTS else placed.groupBy("href").agg(F.min("_p").alias("_begin"))
    parts = placed.join(begins, "href").withColumn("part", F.floor((F.col("_p") - F.col("_begin")) / rows).cast("long"))
    grouped = parts.groupBy("href", "part").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("_p", "_c"))).alias("_all"))
    return grouped.select("href", "part", "n_items", F.array_join(F.transform("_all", lambda i: i["_c"]), separator).alias("content"))


def write_results(df: DataFrame, path: str, href: str, limit: int = MAX_RESULTS, kind: str = "parquet") -> None:
    """A folder for each value of href; more than ``limit`` results are an error, as are names that leave the folder."""
    names = df.select(href).distinct().limit(limit + 1)
    if names.count() > limit:
        raise ValueError(f"more than {limit} results")
    if names.where(F.col(href).contains("..")).take(1):
        raise ValueError("a result's name leaves the folder")
    df.repartition(href).write.partitionBy(href).format(kind).save(path)


def deliver(df: DataFrame, handler: Callable[[str, str], None]) -> None:
    """Hands (href, content) to a handler on the executors."""

    def each(rows) -> None:
        for r in rows:
            handler(r["href"], r["content"])

    df.select("href", "content").foreachPartition(each)
