"""Approval values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import APPROVED_KIND, DEFAULT_DENIAL, DENIED_KIND
from .json import string_at, trimmed


def normalize_approval(value: Column) -> Column:
    """a posted approval value (JSON text) -> struct(approved, kind, override_args, message).

    ``true``/``false`` stay as they are; ``{"kind":"tool-approved"}`` approves with
    optional override_args; ``{"kind":"tool-denied"}`` denies with its message
    (default text when the key is absent); anything else denies.
    """
    v = F.try_parse_json(value)
    t = trimmed(value)
    is_bool = t.isin("true", "false")
    kind = string_at(v, "$.kind")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    has_message = F.coalesce(F.array_contains(F.json_object_keys(value), F.lit("message")), F.lit(False))
    approved = (F.when(is_bool, t == "true")
                .when(is_obj & (kind == APPROVED_KIND), F.lit(True))
                .otherwise(F.lit(False)))
    kind_out = F.when(is_obj, kind)
    override = F.when(is_obj & (kind == APPROVED_KIND), F.get_json_object(value, "$.override_args"))
    message = F.when(is_obj & (kind == DENIED_KIND),
                     F.when(has_message, string_at(v, "$.message")).otherwise(F.lit(DEFAULT_DENIAL)))
    return F.struct(approved.alias("approved"), kind_out.alias("kind"), override.alias("override_args"),
                    message.alias("message"))


def approval_audit_fields(value: Column) -> Column:
    """what the decision log records: approved is NULL (row skipped) for unknown kinds; no default message."""
    v = F.try_parse_json(value)
    t = trimmed(value)
    kind = string_at(v, "$.kind")
    approved = (F.when(t.isin("true", "false"), t == "true")
                .when(kind == APPROVED_KIND, F.lit(True))
                .when(kind == DENIED_KIND, F.lit(False)))
    return F.struct(approved.alias("approved"),
                    F.when(~t.isin("true", "false"), kind).alias("kind"),
                    F.when(kind == DENIED_KIND, string_at(v, "$.message")).alias("denial_message"),
                    F.when(kind == APPROVED_KIND, F.get_json_object(value, "$.override_args")).alias("override_args"))


def approval_status(needs_approval: Column, approved: Column, pending: Column, state: Column) -> Column:
    """label of a tool-call part: approval-requested / approved / denied, else its own state."""
    has_request = F.coalesce(needs_approval, F.lit(False)) | F.coalesce(pending, F.lit(False))
    return (F.when(has_request & approved.isNull(), F.lit("approval-requested"))
            .when(has_request & approved, F.lit("approved"))
            .when(has_request, F.lit("denied"))
            .otherwise(state))

