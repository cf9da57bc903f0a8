"""Tool arguments, tool results and their envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ELLIPSIS, ENVELOPE_TYPE, ENVELOPE_VERSION, RESULT_PREVIEW_CHARS
from .json import is_number_at, is_object_at, is_string_at, string_at, trimmed


def log_preview(text: Column, n: int = RESULT_PREVIEW_CHARS) -> Column:
    """first n characters, plus an ellipsis when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ELLIPSIS))).otherwise(text)


def result_text(df, name: str) -> Column:
    """a tool result as text: strings as they are, anything else as its JSON text."""
    from pyspark.sql import types as T
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    return F.to_json(F.col(name).cast("variant"))


def parse_tool_args(text: Column) -> Column:
    """struct(args, is_json): '' -> '{}'; text that is not JSON is kept raw with is_json = false."""
    empty = F.coalesce(text, F.lit("")) == ""
    parsed_ok = F.try_parse_json(text).isNotNull()
    return F.struct(F.when(empty, F.lit("{}")).otherwise(text).alias("args"),
                    (empty | parsed_ok).alias("is_json"))


def call_arguments(args_text: Column) -> Column:
    """arguments that are already text get JSON-quoted once more."""
    return F.to_json(args_text.cast("variant"))


def parse_envelope(text: Column) -> Column:
    """struct(message, artifacts<id,type,row_count>, data_json) or NULL when not a valid envelope.

    Valid: a JSON object with type 'tool_result' and numeric version 1, holding a
    non-empty message, at least one artifact with a string id, or a data object.
    Artifact items without a string id and wrongly typed sub-fields are dropped.
    """
    v = F.try_parse_json(text)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    type_ok = string_at(v, "$.type") == ENVELOPE_TYPE
    version_ok = is_number_at(v, "$.version") & (F.variant_get(v, "$.version", "double") == float(ENVELOPE_VERSION))
    message = string_at(v, "$.message")
    items = F.when(F.coalesce(F.schema_of_variant(F.variant_get(v, "$.artifacts", "variant")).startswith("ARRAY"), F.lit(False)),
                   F.variant_get(v, "$.artifacts", "array<variant>"))
    kept = F.filter(items, lambda x: is_string_at(x, "$.id"))
    artifacts = F.transform(kept, lambda x: F.struct(
        F.variant_get(x, "$.id", "string").alias("id"),
        string_at(x, "$.type").alias("type"),
        F.when(is_number_at(x, "$.row_count"), F.variant_get(x, "$.row_count", "double")).alias("row_count")))
    data = F.when(is_object_at(v, "$.data"), F.get_json_object(text, "$.data"))
    has_content = (F.coalesce(message, F.lit("")) != "") | (F.coalesce(F.size(artifacts), F.lit(0)) > 0) | data.isNotNull()
    return F.when(is_obj & type_ok & version_ok & has_content,
                  F.struct(message.alias("message"), artifacts.alias("artifacts"), data.alias("data_json")))


def build_envelope(message: Column, artifacts: Column | None = None, data: Column | None = None) -> Column:
    """F8: envelope text; empty artifacts / data are left out (to_json drops NULL fields)."""
    fields = [F.lit(ENVELOPE_TYPE).alias("type"), F.lit(ENVELOPE_VERSION).alias("version"), message.alias("message")]
    if artifacts is not None:
        fields.append(F.when(F.size(artifacts) > 0, artifacts).alias("artifacts"))
    if data is not None:
        fields.append(F.when(F.size(F.map_keys(data)) > 0, data).alias("data"))
    return F.to_json(F.struct(*fields))


def artifact_ref(inp: Column) -> Column:
    """artifact id of a client tool input.

    From ``artifact_id`` / ``artifactId`` or one level under ``input``; a JSON
    text is decoded first; text that is not such an object is itself the id;
    blank -> NULL.
    """
    t = trimmed(inp)
    v = F.try_parse_json(t)
    # an empty id does not count: the next place is tried
    found = F.coalesce(*[F.nullif(string_at(v, p), F.lit("")) for p in
                         ("$.artifact_id", "$.artifactId", "$.input.artifact_id", "$.input.artifactId")])
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(found, t))
