"""Limits, quotas and caps over an ordered stream of documents.

All of them test "the total before this row is below the limit". Once false for a key it stays false, so the kept rows of a key are a prefix, and a
running sum of all candidate rows is exact. running_total() makes that sum without sorting a whole key in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.runtime import materialize

#: Least number of ranges of the order into which a key is cut; the session's shuffle partitions where they are more.
RANGES = 64


def place(borders: Column, x: Column, ranges: int) -> Column:
    """How many of the sorted borders are less than x, found in two steps of about the root of their number each."""
    step = max(1, math.isqrt(ranges))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(borders), F.lit(1)), F.lit(step)), lambda i: F.get(borders, i - 1))
    block = F.size(F.filter(heads, lambda h: h < x))
    inside = F.filter(F.slice(borders, F.greatest((block - 1) * step + 1, F.lit(1)), F.lit(step)), lambda h: h < x)
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(inside))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str = "before", ranges: int | None = None, tie: str | None = None) -> DataFrame:
    """df with the sum of value over the rows of its key that come before it.

    order: a numeric column; tie: a second one where order repeats. A key is cut into ranges of its order by approximate quantiles, sums are
    local to a range, and each range is shifted by the sums of the ranges before. Rows of a null order come first. keys may be empty: then the
    one key is cut all the same, and no step gathers it in one task. df is read for the borders, for the sums, and for its rows, which move with all
    their columns: give narrow rows (see narrow()).
    """
    by = keys or ["_one"]
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("_v", value)
    d = d if keys else d.withColumn("_one", F.lit(0))

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Null-safe broadcast join with a table of at most keys x ranges rows."""
        r = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
        cond = None
        for c in on:
            e = left[c].eqNullSafe(r[f"_r_{c}"])
            cond = e if cond is None else cond & e
        return left.join(F.broadcast(r), cond).drop(*(f"_r_{c}" for c in on))

    borders = d.groupBy(*by).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_b"))
    d = joined(d, borders, by).withColumn("_part", F.when(F.col(order).isNull() | F.col("_b").isNull(), 0).otherwise(place(F.col("_b"), F.col(order), ranges))).drop("_b")
    sums = d.groupBy(*by, "_part").agg(F.sum("_v").alias("_s"))
    shift = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    sort = [F.col(order).asc_nulls_first()] + ([F.col(tie).asc_nulls_first()] if tie else [])
    local = F.coalesce(F.sum("_v").over(Window.partitionBy(*by, "_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined(d.withColumn("_local", local), shift, [*by, "_part"]).withColumn(out, F.col("_shift") + F.col("_local")).drop("_v", "_part", "_shift", "_local", "_one")


def narrow(df: DataFrame, *columns: str | Column) -> DataFrame:
    """These columns of df as a table of their own, so that texts are read once and stay where they are."""
    return materialize(df.select(*columns))


def survivors(df: DataFrame, kept: DataFrame, order: str) -> DataFrame:
    """Rows of df whose order is in kept: the only step in which whole rows may move. order is unique; a null order is a value."""
    k = kept.select(F.col(order).alias("_kept"))
    return df.join(k, df[order].eqNullSafe(k["_kept"]), "left_semi")


def limit_documents(df: DataFrame, order: str, chars: Column, max_docs: int | None = None, max_chars: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The prefix of each key (of all, without keys) before which fewer than max_docs rows and max_chars characters stand: the last row may overshoot.
    order is unique."""
    d = narrow(df, order, *(keys or []), chars.alias("_chars"))
    if max_docs is not None:
        d = running_total(d, keys or [], order, F.lit(1), "_n").where(F.col("_n") < max_docs).drop("_n")
    if max_chars is not None:
        d = running_total(d, keys or [], order, F.col("_chars"), "_c").where(F.col("_c") < max_chars).drop("_c")
    return survivors(df, d, order)


def quotas_and_caps(df: DataFrame, order: str, chars: Column, quotas: dict[str, int], caps: dict[str, int], target: int | None, category: str = "category", source: str = "source_name") -> DataFrame:
    """Source caps, then category quotas over the survivors, then the global target: exact while a source has one category. Keys without a limit pass.
    order is unique."""
    d = narrow(df, order, category, source, chars.alias("_chars"))
    for key, limits in ((source, caps), (category, quotas)):
        if limits:
            limit = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))[F.col(key)]
            d = running_total(d, [key], order, F.col("_chars"), "_c").where(limit.isNull() | (F.col("_c") < limit)).drop("_c")
    if target is not None:
        d = running_total(d, [], order, F.col("_chars"), "_c").where(F.col("_c") < target)
    return survivors(df, d, order)


def token_quota(df: DataFrame, order: str, tokens: str, quotas: dict[str, int], mode: str = "hard", overflow: tuple[str, ...] = (), category: str = "category") -> DataFrame:
    """df with written: the tokens of each row that its category still takes, the last row cut short; rows that get none are left out.

    mode 'hard' and 'flexible' cut, 'flexible' exempts the overflow categories; 'soft' and 'off' never cut. Categories without a quota pass whole.
    """
    if mode in ("soft", "off"):
        return df.withColumn("written", F.col(tokens))
    if mode not in ("hard", "flexible"):
        raise ValueError(f"unsupported quota mode: {mode}")
    limit = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))[F.col(category)]
    d = running_total(df, [category], order, F.col(tokens), "_t")
    cut = F.least(F.col(tokens), F.greatest(limit - F.col("_t"), F.lit(0)))
    free = limit.isNull() | (F.col(category).isin(*overflow) if mode == "flexible" and overflow else F.lit(False))
    return d.withColumn("written", F.when(free, F.col(tokens)).otherwise(cut)).where("written > 0").drop("_t")


def apportion(weights: DataFrame, total: int, key: str = "category", weight: str = "weight") -> DataFrame:
    """(key, quota): shares of total in proportion to the weights by largest remainders; ties go to the larger weight, then to the smaller key.

    Weights that are null or not positive get nothing. One row per category: a small table.
    """
    w = weights.where(F.col(weight) > 0).groupBy(key).agg(F.sum(weight).alias("w"))
    every = Window.partitionBy()
    raw = w.withColumn("raw", F.lit(total) * F.col("w") / F.sum("w").over(every)).withColumn("base", F.floor("raw"))
    left = F.lit(total) - F.sum("base").over(every)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), F.desc("w"), F.asc(key)))
    return raw.withColumn("left", left).withColumn("quota", F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).select(key, F.col("quota").cast("bigint").alias("quota"))


def actual_against_target(actual: DataFrame, target: DataFrame, key: str = "category") -> DataFrame:
    """actual (key, tokens) and target (key, quota): every key of either, missing sides 0, shares and their difference in percentage points."""
    j = actual.join(target, key, "full_outer").na.fill(0, ["tokens", "quota"])
    every = Window.partitionBy()
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0)), F.lit(0.0))
    return j.withColumn("share", share("tokens")).withColumn("target_share", share("quota")).withColumn("delta_points", F.round((F.col("share") - F.col("target_share")) * 100, 4)).withColumns({"share": F.round("share", 6), "target_share": F.round("target_share", 6)})


def split_by_hash(df: DataFrame, key: Column, order: str, tokens: str, val_tokens: int, total_tokens: int) -> DataFrame:
    """df with split: 'val' for rows whose unit hash is under p while val is not full, else 'train'; p = 2 val / total within [0.0001, 0.20]."""
    from textlake.functions.text import unit_hash

    p = min(0.20, max(0.0001, val_tokens / max(total_tokens, 1) * 2.0))
    d = df.withColumn("_hit", unit_hash(key) < p)
    before = running_total(d, [], order, F.when(F.col("_hit"), F.col(tokens)).otherwise(0), "_b")
    return before.withColumn("split", F.when(F.col("_hit") & (F.col("_b") < val_tokens), "val").otherwise("train")).drop("_hit", "_b")
