"""Best representative of each duplicate group, value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What people and exports write where nothing is known (compared in lower case, without outer blanks).
NOTHING = (
    "n/a", "na", "n.a.", "n.a", "#n/a", "none", "null", "nil", "nan", "undefined", "unknown", "not known", "not available", "not applicable",
    "not specified", "unspecified", "missing", "empty", "blank", "(blank)", "(empty)", "(none)", "(unknown)", "no data", "no information", "no info",
    "tba", "tbd", "tbc", "t.b.d.", "t.b.a.", "to be announced", "to be decided", "to be confirmed", "to be determined", "to be updated",
    "will be updated soon", "will be updated", "coming soon", "under construction", "pending", "x", "xx", "xxx", "xxxx",
)
#: Addresses that lead nowhere.
NOWHERE = r"^(https?:/*|#.*|javascript:.*|about:blank)$"
#: Blanks and characters that print nothing.
BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}]+"


def usable_text(value: Column) -> Column:
    """Whether a value tells something: present, no placeholder, a letter or digit, no address of nothing, and not cut off."""
    bare = F.lower(F.regexp_replace(value, rf"^{BLANKS}|{BLANKS}$", ""))
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*NOTHING) & ~bare.rlike(NOWHERE) & ~bare.rlike(r"(\.\.\.|…)$"), F.lit(False))


def usable_url(value: Column) -> Column:
    """Whether an address leads somewhere: a scheme and a host with a dot, and not cut off."""
    bare = F.lower(F.regexp_replace(value, rf"^{BLANKS}|{BLANKS}$", ""))
    return F.coalesce(bare.rlike(r"^(https?|ftp)://[^\s/?#.]+(\.[^\s/?#.]+)+\.?([/?#]|$)") & ~bare.rlike(r"(\.\.\.|…)$"), F.lit(False))


def survivors(entity: DataFrame, trust: DataFrame) -> DataFrame:
    """Columns id, field_name, rec_id, value, rows: for each field of an id the row and value that survive.

    Fields are name, url and attributes.KEY. One aggregation takes, of the usable values, the largest struct of
    (trust of the feed, scraped_at, smallest rec_id). Feeds without a trust and rows without scraped_at come last; rows
    with a null or empty id belong to no group. rows: how many rows the id has. Fields without a usable value give none.
    """
    rows = entity.select("id", "name", "url", "attributes", "feed", "scraped_at", "rec_id").filter("id IS NOT NULL AND id <> ''")
    rows = rows.join(F.broadcast(trust.groupBy("feed").agg(F.max("trust").alias("trust"))), "feed", "left")
    usable = lambda name, value, ok: F.struct(name.alias("field_name"), F.when(ok, value).alias("value"))
    attributes = F.transform(F.map_entries("attributes"), lambda e: usable(F.concat(F.lit("attributes."), e.key), e.value, usable_text(e.value)))
    fields = F.concat(
        F.array(usable(F.lit("name"), F.col("name"), usable_text(F.col("name"))), usable(F.lit("url"), F.col("url"), usable_url(F.col("url")))),
        F.coalesce(attributes, F.array().cast("array<struct<field_name:string,value:string>>")),
    )
    each = rows.select("id", F.coalesce("trust", F.lit(-(2**31))).alias("trust"), "scraped_at", "rec_id", F.explode(fields).alias("f")).select("*", "f.*")
    order = F.struct("trust", F.col("scraped_at").isNotNull(), "scraped_at", (-F.col("rec_id")).alias("minus"), "value")
    # Every row has a field called name, so its count is the number of the id's rows.
    best = each.groupBy("id", "field_name").agg(F.max(F.when(F.col("value").isNotNull(), order)).alias("best"), F.count("*").alias("n"))
    counted = best.withColumn("rows", F.max(F.when(F.col("field_name") == "name", F.col("n"))).over(Window.partitionBy("id")))
    return counted.filter("best IS NOT NULL").select("id", "field_name", (-F.col("best.minus")).alias("rec_id"), F.col("best.value").alias("value"), "rows")


def found(entity: DataFrame, trust: DataFrame) -> DataFrame:
    """Columns entity_id, field_name, rec_id, for ids with two or more rows."""
    return survivors(entity, trust).filter("rows >= 2").select(F.col("id").alias("entity_id"), "field_name", "rec_id")


def records(entity: DataFrame, trust: DataFrame) -> DataFrame:
    """One surviving record per id: id, name, url, attributes (JSON with sorted keys), rows."""
    kept = survivors(entity, trust).groupBy("id").agg(
        F.max(F.when(F.col("field_name") == "name", F.col("value"))).alias("name"),
        F.max(F.when(F.col("field_name") == "url", F.col("value"))).alias("url"),
        F.sort_array(F.collect_list(F.when(F.col("field_name").startswith("attributes."), F.struct(F.substring("field_name", 12, 1000).alias("k"), F.col("value").alias("v"))))).alias("a"),
        F.max("rows").alias("rows"),
    )
    return kept.select("id", "name", "url", F.to_json(F.map_from_entries("a")).alias("attributes"), "rows")
