"""Finish reasons and token usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import COMPLETION_ALIASES, FINISH_REASONS, PROMPT_ALIASES, TOTAL_ALIASES


def finish_reason(reason: Column) -> Column:
    """keep the four allowed reasons, everything else (NULL included) is 'stop'."""
    return F.when(reason.isin(*FINISH_REASONS), reason).otherwise(F.lit("stop"))


def _first(usage_json: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(usage_json, f"$.{n}").try_cast("long") for n in names])


def usage_struct(usage_json: Column) -> Column:
    """normalise raw usage (any alias style) to struct(promptTokens, completionTokens, totalTokens).

    NULL when prompt or completion is missing; total defaults to their sum.
    """
    p = _first(usage_json, PROMPT_ALIASES)
    c = _first(usage_json, COMPLETION_ALIASES)
    t = F.coalesce(_first(usage_json, TOTAL_ALIASES), p + c)
    return F.when(p.isNotNull() & c.isNotNull(),
                  F.struct(p.alias("promptTokens"), c.alias("completionTokens"), t.alias("totalTokens")))
