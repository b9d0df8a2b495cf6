"""The chain of match filters as predicates over a candidate (prefix m_) and the post it is compared with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr


@dataclass(frozen=True)
class Settings:
    """Search knobs; 0 or None switches the age and title filters off."""

    target_title_match: int | None = None
    max_matches: int = 75
    same_sub: bool = False
    max_days_old: int | None = 190
    only_older_matches: bool = True
    filter_same_author: bool = True
    filter_crossposts: bool = True
    target_match_percent: float = 90.0
    target_distance: float = 0.077


def not_crosspost(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def not_same_author(a: Column, b: Column) -> Column:
    """Null and null are the same author."""
    return ~a.eqNullSafe(b)


def not_too_old(now: Column, created: Column, days: int | None) -> Column:
    return F.lit(True) if not days else expr.age_days(now, created) <= days


def no_keyword(title: Column, keywords: Column) -> Column:
    return ~expr.has_keyword(title, keywords)


def within_distance(distance: Column, target: Column | float) -> Column:
    return distance <= target


def text_alike(similarity: Column, threshold: Column | float) -> Column:
    return similarity >= threshold


def below(distance: Column, target: Column | float) -> Column:
    """An index's raw hits: the target itself is too far."""
    return distance < target


def has_hash(value: Column) -> Column:
    return value.isNotNull()


def alive(status: Column) -> Column:
    """Only what answered with 200; no answer counts as dead."""
    return F.coalesce(status == 200, F.lit(False))


def not_removed(removed: Column, matches: Column, most: int = 100) -> Column:
    """Removed matches go, unless a search has more than ``most``, which is not looked into."""
    return (matches > most) | ~F.coalesce(removed, F.lit(False))


def should_check(kind: Column, flags: dict[str, Column], *, ignored: Column, crosspost: Column, title: Column | None = None, keywords: Column | None = None) -> Column:
    """Whether a post is checked: its author is not ignored, its type has a flag that is on, it is no crosspost and its title holds no keyword."""
    on = F.lit(False)
    for name, flag in flags.items():
        on = F.when(kind == name, F.coalesce(flag, F.lit(False))).otherwise(on)
    keep = ~F.coalesce(ignored, F.lit(False)) & on & not_crosspost(crosspost)
    return keep if title is None else keep & (keywords.isNull() | (keywords == "") | no_keyword(title, keywords))


def alike_titles(similarity: Column, threshold: int | None) -> Column:
    return F.lit(True) if not threshold else similarity > threshold


def chain(s: Settings, now: Column, *, crosspost: Column, author: tuple[Column, Column], created: tuple[Column, Column], sub: tuple[Column, Column], ids: tuple[Column, Column], similarity: Column | None = None) -> Column:
    """All of them at once; each pair is (match's, post's)."""
    keep = ids[0] != ids[1]
    if s.filter_same_author:
        keep = keep & not_same_author(*author)
    if s.filter_crossposts:
        keep = keep & not_crosspost(crosspost)
    if s.only_older_matches:
        keep = keep & (created[0] < created[1])
    if s.same_sub:
        keep = keep & (sub[0] == sub[1])
    if similarity is not None:
        keep = keep & alike_titles(similarity, s.target_title_match)
    return keep & not_too_old(now, created[0], s.max_days_old)
