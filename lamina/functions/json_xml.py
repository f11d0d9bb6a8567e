"""JSON as XML elements and back.

A JSON value becomes an element map, array, string, number, boolean or null of the functions namespace; a member's name is its ``key``.  Values
nest to any depth, which no expression can follow, so both directions are vectorised functions over Arrow batches.
"""

from __future__ import annotations

import json
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "http://www.w3.org/2005/xpath-functions"


class _Number(str):
    """A number as it was written."""


def _element(value, key: str | None, root: bool) -> str:
    head = (f' xmlns="{NAMESPACE}"' if root else "") + (f" key={quoteattr(key)}" if key is not None else "")
    if isinstance(value, list) and value and value[0] is dict:
        kind, body = "map", "".join(_element(v, k, False) for k, v in value[1])
    elif isinstance(value, list):
        kind, body = "array", "".join(_element(v, None, False) for v in value[1:])
    elif isinstance(value, _Number):
        kind, body = "number", str(value)
    elif isinstance(value, bool):
        kind, body = "boolean", str(value).lower()
    elif value is None:
        kind, body = "null", ""
    else:
        kind, body = "string", escape(value)
    return f"<{kind}{head}>{body}</{kind}>" if body else f"<{kind}{head}/>"


def _tagged(value):
    """Arrays and maps told apart by a first item; a map's members as pairs, the first of a repeated name."""
    if isinstance(value, dict):
        return [dict, [(k, _tagged(v)) for k, v in value.items()]]
    if isinstance(value, list):
        return [list, *map(_tagged, value)]
    return value


def _first(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def to_xml_text(text: str) -> str:
    return _element(_tagged(json.loads(text, parse_int=_Number, parse_float=_Number, object_pairs_hook=_first)), None, True)


def _value(node: ElementTree.Element) -> str:
    space, _, kind = node.tag[1:].partition("}")
    if space != NAMESPACE:
        raise ValueError(f"an element of another namespace: {node.tag}")
    if kind == "map":
        keys = [c.get("key") for c in node]
        if None in keys or len(set(keys)) < len(keys):
            raise ValueError("members of a map need a key each, and no two the same")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_value(c)}" for k, c in zip(keys, node, strict=True)) + "}"
    if kind == "array":
        return "[" + ",".join(map(_value, node)) + "]"
    text = node.text or ""
    if kind == "string":
        return json.dumps(text, ensure_ascii=False)
    if kind == "null":
        return "null"
    if kind == "boolean" and text.strip() in ("true", "false", "1", "0"):
        return "true" if text.strip() in ("true", "1") else "false"
    if kind == "number":
        float(text)
        return text.strip()
    raise ValueError(f"no JSON: {kind} {text!r}")


def to_json_text(text: str) -> str:
    return _value(ElementTree.fromstring(text))


def _vectorised(one, lax: bool):
    def safe(text):
        if text is None:
            return None
        try:
            return one(text)
        except (ValueError, ElementTree.ParseError):
            if lax:
                return None
            raise

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe, na_action="ignore").astype(object)

    return run


def json_to_xml(c: Column, lax: bool = False) -> Column:
    """JSON text as XML text; null gives null.  Of members with one name the first counts.  No JSON raises, or gives null if lax."""
    return _vectorised(to_xml_text, lax)(c)


def xml_to_json(c: Column, lax: bool = False) -> Column:
    """The XML form as JSON text; null gives null.  Other XML raises, or gives null if lax."""
    return _vectorised(to_json_text, lax)(c)
