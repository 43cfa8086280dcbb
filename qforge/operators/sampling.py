"""Quotas and samples in a seeded hash order, so reruns and other engines draw alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(key: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(seed)), 256)


def scope_plan(items: DataFrame, item: str, n: int, seed: str = "plan") -> DataFrame:
    """(item, quota): n spread as evenly as can be over the items, in hash order; items without a quota are absent. items is the scope, a small table."""
    if n <= 0:
        return items.select(item, F.lit(0).cast("bigint").alias("quota")).limit(0)
    order = Window.orderBy(draw_key(F.col(item), seed), item)
    ranked = items.select(item).distinct().select(item, F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy()).alias("m"))
    quota = F.floor(F.lit(n) / F.col("m")) + F.when(F.col("r") <= F.lit(n) % F.col("m"), 1).otherwise(0)
    return ranked.select(item, quota.cast("bigint").alias("quota")).filter("quota > 0")


def filtered_scope(items: DataFrame, item: str, title: str, wanted: list[str]) -> DataFrame:
    """Items whose id or title is wanted, in any case; all if none is, or nothing is wanted."""
    low = [w.lower() for w in wanted]
    hit = items.filter(F.lower(item).isin(low) | F.lower(title).isin(low)) if low else items
    return items if low and hit.isEmpty() else hit


def with_stratum(pool: DataFrame, key: str, scope_id: Column, tags: Column, plan: DataFrame, item: str, name: str = "stratum") -> DataFrame:
    """Adds the scope id if planned, else the first planned tag, else null. ``key`` is unique; candidates are joined to the plan, whatever its size."""
    tried = F.concat(F.array(scope_id), F.coalesce(tags, F.array().cast("array<string>")))
    each = pool.select(F.col(key).alias("_key"), F.posexplode(tried).alias("_at", "_try")).join(plan.select(F.col(item).alias("_try")).distinct(), "_try")
    first = each.groupBy("_key").agg(F.min(F.struct("_at", "_try"))["_try"].alias(name))
    return pool.join(first, pool[key] == first["_key"], "left").drop("_key")


def stratified_sample(pool: DataFrame, key: str, strata: str, plan: DataFrame, item: str, n: int, seed: str = "sample") -> DataFrame:
    """At most n rows: each stratum's quota in hash order, then a top-up, rows without a stratum first.

    Only the first n rows of a stratum can be drawn, so each stratum is cut to n before the strata meet.
    """
    h = draw_key(F.col(key), seed)
    rows = pool.withColumn("_h", h).join(plan.select(F.col(item).alias("_item"), "quota"), F.col(strata) == F.col("_item"), "left")
    rank = F.row_number().over(Window.partitionBy(strata).orderBy("_h", key))
    rows = rows.withColumn("_r", rank).filter(F.col("_r") <= n)
    drawn = F.col("_r") <= F.coalesce("quota", F.lit(0))
    order = (F.when(drawn, 0).when(F.col("_item").isNull(), 1).otherwise(2), "_h", key)
    return rows.orderBy(*order).limit(n).drop("_h", "_item", "_r", "quota")
