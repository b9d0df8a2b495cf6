"""Settings of communities from the text of a page: read by type, merged by revision, each change on record.

A page holds a JSON object. What can't be read is data: a text that is no object makes its revision invalid, a value of
another type than its setting's leaves the setting as it is and is named. A revision that is known already changes
nothing. Settings that a page lacks are listed, so that the page can be written anew from what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark types of settings and how a page's value of that type shows in ``schema_of_variant``.
SHOWN = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "BIGINT", "string": "STRING", "double": "(BIGINT|DOUBLE|DECIMAL.*)"}
#: Settings for which an empty text stands for none.
EMPTY_IS_NONE = ["title_ignore_keywords"]


@dataclass(frozen=True)
class Sync:
    """``communities`` after the sync; ``revisions`` to add to the log; ``audit``, a row for each setting that changed; ``outcomes``, a row for each community."""

    communities: DataFrame
    revisions: DataFrame
    audit: DataFrame
    outcomes: DataFrame


def _value(key: str) -> Column:
    return F.try_variant_get("_page", f"$.{key}", "variant")


def _fits(key: str, kind: str) -> Column:
    """A value that is there and is null or of the setting's type."""
    return _value(key).isNotNull() & (F.is_variant_null(_value(key)) | F.schema_of_variant(_value(key)).rlike(f"^{SHOWN[kind]}$"))


def _read(key: str, kind: str) -> Column:
    value = F.try_variant_get("_page", f"$.{key}", kind)
    return F.when(value != "", value) if key in EMPTY_IS_NONE else value


def as_page(exposed: dict[str, str]) -> Column:
    """What a page says that is written from the stored settings; unset ones are null."""
    return F.to_json(F.struct(*exposed), {"ignoreNullFields": "false"})


def missing(page: Column, exposed: dict[str, str]) -> Column:
    """The exposed settings that a page, as parsed, doesn't name."""
    return F.filter(F.array(*(F.when(F.try_variant_get(page, f"$.{k}", "variant").isNull(), F.lit(k)) for k in exposed)), lambda x: x.isNotNull())


def sync(communities: DataFrame, pages: DataFrame, revisions: DataFrame, exposed: dict[str, str]) -> Sync:
    """All communities against their pages.

    ``communities`` has name, active, is_mod, wiki_permission and the settings; ``pages`` name, revision_id and content;
    ``revisions`` is the log of revision_id. ``exposed`` maps settings that pages may change to their types; those that
    communities don't have are left aside. Outcomes: inactive, not_mod, no_permission, no_page, current, invalid, loaded.
    """
    exposed = {k: t for k, t in exposed.items() if k in communities.columns}
    known = revisions.select("revision_id").distinct().withColumn("_known", F.lit(True))
    rows = communities.join(pages.select("name", F.col("revision_id"), F.col("content")), "name", "left").join(known, "revision_id", "left").withColumn("_page", F.try_parse_json("content"))
    is_object = F.coalesce(F.schema_of_variant("_page").startswith("OBJECT"), F.lit(False))
    outcome = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive").when(~F.coalesce("is_mod", F.lit(False)), "not_mod").when(~F.coalesce("wiki_permission", F.lit(False)), "no_permission")
        .when(F.col("content").isNull(), "no_page").when(F.col("_known"), "current").when(is_object, "loaded").otherwise("invalid")
    )
    rows = rows.withColumn("outcome", outcome)
    loaded = F.col("outcome") == "loaded"
    wrong = F.filter(F.array(*(F.when(_value(k).isNotNull() & ~_fits(k, t), F.lit(k)) for k, t in exposed.items())), lambda x: x.isNotNull())
    read = is_object & F.col("outcome").isin("loaded", "current")
    outcomes = rows.select("name", "revision_id", "outcome", F.when(read, missing(F.col("_page"), exposed)).alias("missing"), F.when(loaded, wrong).alias("wrong_type"))
    changes = {k: loaded & _fits(k, t) & ~_read(k, t).eqNullSafe(F.col(k)) for k, t in exposed.items()}
    after = rows.select(*(F.when(changes[c], _read(c, exposed[c])).otherwise(F.col(c)).alias(c) if c in exposed else F.col(c) for c in communities.columns))
    each = F.array(*(F.when(changes[k], F.struct(F.lit(k).alias("config_key"), F.col(k).cast("string").alias("old_value"), _read(k, t).cast("string").alias("new_value"))) for k, t in exposed.items()))
    audit = rows.select("name", "revision_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("name", "revision_id", "c.*")
    log = rows.where(F.col("outcome").isin("loaded", "invalid")).select("revision_id", "name", "content", loaded.alias("is_valid"))
    return Sync(after, log, audit, outcomes)
