"""Filling ``{name}`` templates from a map, without ever re-reading the filled-in values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import bound

_PIECE = r"(?s)\{\{|\}\}|\{[^{}]*\}|[^{}]+"


def fill_template(template: Column, context: Column) -> Column:
    """The filled text, or NULL when a key is missing or a brace is unbalanced.

    The template is cut into literals and keys first and each piece is replaced on its own, so a value
    that itself contains braces is copied as it is. ``{{`` and ``}}`` stand for single braces.
    """
    pieces = F.regexp_extract_all(template, F.lit(_PIECE), F.lit(0))

    def piece(p: Column) -> Column:
        key = F.substring(p, F.lit(2), F.length(p) - 2)
        return (
            F.when(p == "{{", F.lit("{"))
            .when(p == "}}", F.lit("}"))
            .when(p.startswith("{"), F.try_element_at(context, key))
            .otherwise(p)
        )

    def joined(parts: Column) -> Column:
        sound = F.array_join(parts, "") == template
        whole = lambda filled: F.when(sound & ~F.exists(filled, lambda p: p.isNull()), F.array_join(filled, ""))
        return bound(F.transform(parts, piece), whole)

    return F.when(template == "", F.lit("")).otherwise(bound(pieces, joined))


def has_template(text: Column) -> Column:
    return text.rlike(r"\{[^{}]*\}")
