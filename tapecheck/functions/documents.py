"""JSON documents read as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def as_list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def whole_document(text: Column) -> Column:
    """The document as a variant, NULL unless the text is exactly one document.

    The parser stops after the first value, so text that follows it is only
    noticed when the document is parsed as the sole member of an array and of
    an object.
    """
    inside_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inside_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = (F.size(as_list(inside_list)) == 1) & (F.size(F.map_keys(as_object(inside_object))) == 1)
    return F.when(alone, F.try_variant_get(inside_object, "$.v", "variant"))
