"""Joins that spread the rows of frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 16, hot: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has at most one row per key, where a key of many may hold any share of its rows.

    Each row of one is copied once per salt; rows of many take the salt that a hash of column `by` gives, so a key's
    rows go to `salts` tasks. Only inner, left, left_semi and left_anti joins keep their meaning this way. hot: the few keys
    that have very many rows; then only their rows are copied, and rows with these keys or none are spread. Copies are
    never broadcast: Spark's estimate of their size leaves the copying out.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    if hot is None:
        most = F.lit(salts - 1)
    else:
        few = F.broadcast(hot.select(*on, F.lit(True).alias("__hot")).distinct())
        many, one = many.join(few, on, "left"), one.join(few, on, "left")
        none = F.greatest(*[F.col(c).isNull() for c in on]) if len(on) > 1 else F.col(on[0]).isNull()
        salt, most = F.when(F.col("__hot") | none, salt).otherwise(0), F.when(F.col("__hot"), salts - 1).otherwise(0)
    many, copies = many.withColumn("__salt", salt).drop("__hot"), one.withColumn("__salt", F.explode(F.sequence(F.lit(0), most))).drop("__hot")
    return many.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")
