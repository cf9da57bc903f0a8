"""Small JSON helpers on top of Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vtype(v: Column, path: str) -> Column:
    """JSON type name of the value at ``path`` of a variant: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN,
    OBJECT<..>, ARRAY<..>, VOID (JSON null); NULL if the path is absent."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def is_string_at(v: Column, path: str) -> Column:
    """The value at ``path`` is a JSON string (false when absent)."""
    return F.coalesce(vtype(v, path) == "STRING", F.lit(False))


def is_number_at(v: Column, path: str) -> Column:
    """The value at ``path`` is a JSON number (false when absent)."""
    t = vtype(v, path)
    return F.coalesce(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
                      F.lit(False))


def is_object_at(v: Column, path: str) -> Column:
    """The value at ``path`` is a JSON object (false when absent)."""
    return F.coalesce(vtype(v, path).startswith("OBJECT"), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    """The value at ``path`` if it is a JSON string, else NULL."""
    return F.when(is_string_at(v, path), F.variant_get(v, path, "string"))


def trimmed(text: Column) -> Column:
    """The text without blanks at its ends, as the chat client trims: all Unicode blanks and line ends, and U+FEFF."""
    return F.regexp_replace(text, r"(?U)\A[\s\uFEFF]+|[\s\uFEFF]+\z", "")
