"""Values and types: templates, casts that must hold, qualified names, comparison of nodes, seeded random numbers, what is available."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.atomize import text


def template(df: DataFrame, pattern: str) -> Column:
    """A text value template: ``{expression}`` is worked out over the row, ``{{`` and ``}}`` are braces.  Empty values are ''."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{[^{}]*\})", pattern):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            c = F.expr(piece[1:-1])
            parts.append(text(c, df.select(c.alias("c")).schema["c"].dataType))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def castable(c: Column, kind: str) -> Column:
    return c.try_cast(kind).isNotNull()


def treat_as(c: Column, test: Column, what: str) -> Column:
    """The value, which must satisfy the test; else reading it raises."""
    return F.when(F.coalesce(test, F.lit(False)), c).otherwise(F.raise_error(F.lit(f"a value is not {what}")))


def instance_of(df: DataFrame, column: str, kind: str, occurs: str = "") -> Column:
    """Whether a value has a declared type and occurrence: '' one, '?' at most one, '*' any number, '+' at least one.

    Types are known when the query is built; what is left to decide for each row is how many items there are."""
    found = df.schema[column].dataType
    item = found.elementType if isinstance(found, T.ArrayType) else found
    if item.simpleString() != kind:
        return F.coalesce(F.size(column) == 0, F.lit(True)) & F.lit(occurs in ("?", "*")) if isinstance(found, T.ArrayType) else F.col(column).isNull() & F.lit(occurs in ("?", "*"))
    n = F.coalesce(F.size(column), F.lit(0)) if isinstance(found, T.ArrayType) else F.col(column).isNotNull().cast("int")
    return {"": n == 1, "?": n <= 1, "*": n >= 0, "+": n >= 1}[occurs]


def coerced(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df with exactly the columns and types of a declared schema; a value that cannot be cast, or a missing required one, raises."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for f in wanted:
        c = F.col(f.name).try_cast(f.dataType)
        bad = (F.col(f.name).isNotNull() & c.isNull()) | (F.lit(not f.nullable) & F.col(f.name).isNull())
        out.append(F.when(bad, F.raise_error(F.concat(F.lit(f"{f.name}: cannot be {f.dataType.simpleString()}: "), F.coalesce(F.col(f.name).cast("string"), F.lit("empty")))).cast(f.dataType)).otherwise(c).alias(f.name))
    return df.select(*out)


def context_item(df: DataFrame | None, use: str = "optional", schema: str | None = None) -> DataFrame | None:
    """Checks a query's input against its declaration: required, optional or absent, and of a schema."""
    if use == "required" and df is None:
        raise ValueError("the query needs an input")
    if use == "absent" and df is not None:
        raise ValueError("the query takes no input")
    return coerced(df, schema) if df is not None and schema else df


def qname(namespace: Column, name: Column) -> Column:
    """A qualified name; equality is of namespace and local part, the prefix is kept beside."""
    local = F.element_at(F.split(name, ":"), -1)
    prefix = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise("")
    return F.struct(F.coalesce(namespace, F.lit("")).alias("ns"), local.alias("local"), prefix.alias("prefix"))


def qname_equal(a: Column, b: Column) -> Column:
    return (a["ns"] == b["ns"]) & (a["local"] == b["local"])


def same_node(doc_a: Column, a: Column, doc_b: Column, b: Column) -> Column:
    return (doc_a == doc_b) & (a == b)


def precedes(doc_a: Column, a: Column, doc_b: Column, b: Column) -> Column:
    """Document order; documents in the order of their ids."""
    return (doc_a < doc_b) | ((doc_a == doc_b) & (a < b))


def random_number(seed: int, *by: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the values alone, so retries and repartitioning do not change it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11).cast("double") / float(1 << 53)


PROPERTIES = {"version": "4.0", "vendor": "lamina", "supports-streaming": "yes", "supports-serialization": "yes", "supports-higher-order-functions": "yes"}


def system_property(name: str) -> Column:
    return F.lit(PROPERTIES.get(name, ""))


def available_properties() -> list[str]:
    """available-system-properties."""
    return sorted(PROPERTIES)


def function_available(spark: SparkSession, name: str, functions=None, arity: int | None = None) -> bool:
    """Whether a function of this engine's registry (of an arity, if given) or of Spark has the name."""
    own = functions is not None and any(n == name and arity in (None, a) for n, a in functions.names())
    return own or spark.catalog.functionExists(name.replace("-", "_"))


def type_available(name: str) -> bool:
    """Whether a name is a type that values can be cast to."""
    try:
        T._parse_datatype_string(f"c {name}")
    except Exception:  # the parser's own error
        return False
    return True


def element_available(name: str) -> bool:
    """Whether an instruction of the language has an operator here."""
    return name in INSTRUCTIONS


#: Instructions with an operator, by their names in the language.
INSTRUCTIONS = frozenset(
    "accumulator analyze-string apply-imports apply-templates array assert attribute attribute-set call-template catch character-map choose comment copy copy-of element evaluate for-each for-each-group for-each-member "
    "fork function if iterate key map map-entry merge message mode next-match number on-empty on-non-empty output package param perform-sort processing-instruction record result-document sequence sort source-document strip-space switch template "
    "text try use-package value-of variable where-populated".split()
)


def path_pattern(pattern: str) -> str:
    """A path glob to a regular expression over paths like /a/b or /a/@x: names, * for one step, ** for any steps; a leading / anchors it."""
    anchored, steps = pattern.startswith("/"), pattern.strip("/").split("/")
    out = "" if anchored else "(?:/[^/]+)*"
    for s in steps:
        out += "(?:/[^/]+)*" if s == "**" else "/[^/@]+" if s == "*" else "/" + re.escape(s)
    return f"^{out}$"


def path_matches(path: Column, pattern: str) -> Column:
    return path.rlike(path_pattern(pattern))
