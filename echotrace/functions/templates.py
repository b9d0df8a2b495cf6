"""Templates as rows, filled in from a map of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubled braces, a named value, other text, a brace alone.
PIECES = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def spelled(value: Column) -> Column:
    """A value as templates write it: nothing known is None, truths have a capital."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def truth(value: Column) -> Column:
    return F.when(value, "True").when(~value, "False").otherwise("None")


def values(**named: Column) -> Column:
    """The map that ``filled`` takes."""
    return F.create_map(*(x for name, value in named.items() for x in (F.lit(name), spelled(value))))


def filled(template: Column, of: Column) -> Column:
    """The template with ``{name}`` replaced by that value, ``{{`` and ``}}`` by one brace.

    Null if a name isn't among the values, or a brace stands alone: the caller decides what to say instead.
    """
    pieces = F.regexp_extract_all(template, F.lit(PIECES), F.lit(0))

    def one(piece: Column) -> Column:
        name = F.substring(piece, 2, F.length(piece) - 2)
        return (
            F.when(piece == "{{", "{").when(piece == "}}", "}").when(piece.isin("{", "}"), F.lit(None).cast("string"))
            .when(F.startswith(piece, F.lit("{")), F.element_at(of, name)).otherwise(piece)
        )

    said = F.transform(pieces, one)
    return F.when(template.isNotNull() & ~F.exists(said, lambda x: x.isNull()), F.array_join(said, ""))


def filled_or(of: Column, *templates: Column) -> Column:
    """The first of the templates that is there, isn't empty and can be filled in."""
    return F.coalesce(*(filled(F.when(t != "", t), of) for t in templates))
