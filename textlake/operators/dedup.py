"""De-duplication on keys: the first row in ingest order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def first_wins(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order, with all its columns.

    Not a window: the smallest order is found per key by partial aggregation, so a key that a third of the rows share costs one row a partition, and
    only (key, order) is shuffled to find the winners; to the winners the rows come by key and order, so a hot key is spread. The order must be unique within a key; rows of a null order never win. A null key is a
    key like any other.
    """
    d = df.withColumn("_key", key).withColumn("_ord", F.struct(*order))
    win = d.groupBy("_key").agg(F.min("_ord").alias("_win"))
    b = win.select(F.col("_key").alias("_k"), "_win")
    return d.join(b, d["_key"].eqNullSafe(b["_k"]) & (d["_ord"] == b["_win"]), "left_semi").drop("_key", "_ord")


def mark_duplicates(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """df with is_duplicate: false for the first row of each key. Rows meet the winners by key and order, so the copies of a text that a third of all
    rows share are spread over the tasks."""
    d = df.withColumn("_key", key).withColumn("_ord", F.struct(*order))
    win = d.groupBy("_key").agg(F.min("_ord").alias("_win")).select(F.col("_key").alias("_k"), "_win", F.lit(True).alias("_first"))
    return d.join(win, d["_key"].eqNullSafe(win["_k"]) & d["_ord"].eqNullSafe(win["_win"]), "left").withColumn("is_duplicate", F.col("_first").isNull()).drop("_key", "_ord", "_k", "_win", "_first")


def not_seen(df: DataFrame, seen: DataFrame, key: Column, seen_key: Column) -> DataFrame:
    """Rows whose key is not among the keys of earlier output (left anti join on 20-byte digests)."""
    old = seen.select(seen_key.alias("_seen")).distinct()
    d = df.withColumn("_key", key)
    return d.join(old, d["_key"] == old["_seen"], "left_anti").drop("_key")


def union_sources(sources: list[DataFrame], order: str = "source_ord") -> DataFrame:
    """All rows in list order: every source gets its number; columns that one lacks are null there."""
    parts = [s.withColumn(order, F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distinct_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): the first place of every line of the corpus; blank lines are left out."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return lines.groupBy("line").agg(F.min(F.struct(key, "line_no")).alias("at")).select(F.col(f"at.{key}").alias(key), F.col("at.line_no").alias("line_no"), "line")


def file_digest(spark, path: str) -> DataFrame:
    """(path, digest) of files by content; equal digests are copies."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def flag_histogram(df: DataFrame, flags: str = "flags", decision: str = "decision", duplicate: Column | None = None) -> DataFrame:
    """(flag, n, share): flags of kept rows count as kept_with_<flag>, duplicates as duplicate_compact_hash; share of all rows."""
    kept = F.transform(flags, lambda x: F.when(F.col(decision) == "keep", F.concat(F.lit("kept_with_"), x)).otherwise(x))
    names = F.when(duplicate, F.array(F.lit("duplicate_compact_hash"))).otherwise(kept) if duplicate is not None else kept
    # The row count rides along as a flag of its own, so the input is read once.
    n = df.select(F.explode(F.concat(F.array(F.lit("")), names)).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("flag") == "", F.col("n"))).over(Window.partitionBy())
    return n.withColumn("share", F.round(F.col("n") / total, 6)).where("flag <> ''")
