"""Policy as data: predicates that turn joined rows into recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(*cases: tuple[Column, str], otherwise: str) -> Column:
    """An ordered ladder: the first case that holds names the outcome."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out


def actions(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row for each flag that holds."""
    wanted = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in flags.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(wanted).alias("action"))


def karma_verdict(karma: Column, remove_at: int, flag_at: int) -> Column:
    return first_of((karma <= remove_at, "remove"), (karma <= flag_at, "review"), otherwise="keep")


def vote_verdict(total: Column, promote: int = 10, remove: int = -10) -> Column:
    return first_of((total >= promote, "promote"), (total <= remove, "remove"), otherwise="open")


def first_link_with(links: Column, domains: list[str]) -> Column:
    """The first link that contains any of the domains."""
    names = F.array(*(F.lit(d) for d in domains))
    return F.get(F.filter(links, lambda x: F.exists(names, lambda d: F.contains(x, d))), 0)
