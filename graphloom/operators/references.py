"""References to records that do not exist, or not yet, or no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import spread_join

#: Into how many parts the references to one key are spread when the keys' standing is joined back.
SALTS = 16


def references(relationship: DataFrame, fields: tuple[str, ...] = ("source_id", "target_id")) -> DataFrame:
    """Columns rel_id, ref_field, key, seen_at of all references; null and empty ids are none."""
    one = [F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("key")) for f in fields]
    return relationship.select("rel_id", "seen_at", F.explode(F.array(*one)).alias("r")).select("rel_id", "r.ref_field", "r.key", "seen_at").filter("key IS NOT NULL AND key <> ''")


def parents(entity: DataFrame) -> DataFrame:
    """Columns key, first_at, removed_at of every id that the entity table has."""
    return entity.filter("id IS NOT NULL").groupBy(F.col("id").alias("key")).agg(F.min("scraped_at").alias("first_at"), F.max("removed_at").alias("removed_at"))


def orphans(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Columns rel_id, ref_field, kind, seen_at of the references that lead nowhere.

    missing: no row has the id. late: the id's earliest row came after the reference was seen. removed: the page had
    been taken down by then. The distinct keys are anti-joined with the parents; only keys with some orphan reference
    are joined back, each in SALTS copies, so that a key with very many references is spread. A reference with no
    seen_at can only be missing.
    """
    refs = references(relationship)
    keys = refs.groupBy("key").agg(F.min("seen_at").alias("low"), F.max("seen_at").alias("high"))
    known = parents(entity)
    nowhere = keys.join(known, "key", "left_anti").select("key", F.lit(True).alias("missing"), F.lit(None).cast("timestamp").alias("first_at"), F.lit(None).cast("timestamp").alias("removed_at"))
    at_times = keys.join(known, "key").filter("first_at > low OR removed_at <= high").select("key", F.lit(False).alias("missing"), "first_at", "removed_at")
    suspect = nowhere.unionByName(at_times)
    kind = F.when(F.col("missing"), "missing").when(F.col("first_at") > F.col("seen_at"), "late").when(F.col("removed_at") <= F.col("seen_at"), "removed")
    return spread_join(refs, suspect, ["key"], "rel_id", salts=SALTS).withColumn("kind", kind).filter("kind IS NOT NULL").select("rel_id", "ref_field", "kind", "seen_at")


def found(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Columns rel_id, ref_field, kind."""
    return orphans(relationship, entity).select("rel_id", "ref_field", "kind")


def report(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Per field and month of seen_at (null if unknown): references, and how many of them are missing, late, removed."""
    month = F.date_format("seen_at", "yyyy-MM").alias("month")
    total = references(relationship).groupBy("ref_field", month).agg(F.count("*").alias("refs"))
    bad = orphans(relationship, entity).groupBy("ref_field", month).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("missing", "late", "removed")])
    same = (total.ref_field == bad.ref_field) & total.month.eqNullSafe(bad.month)
    return total.join(bad, same, "left").select(total.ref_field, total.month, "refs", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("missing", "late", "removed")])
