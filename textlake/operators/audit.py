"""Reports over a corpus: grouped statistics, tops, samples, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def clean_totals(df: DataFrame, by: str, decision: str = "decision", duplicate: str = "is_duplicate", text: str = "text") -> DataFrame:
    """Totals per value of `by` and, where by is null and level 'all', over everything, in one pass: seen, kept, dropped, quarantined, duplicates,
    characters and rates (0 where nothing was seen)."""
    n, dec, dup = F.coalesce(F.length(text), F.lit(0)), F.col(decision), F.col(duplicate)
    kept = (dec == "keep") & ~dup
    g = df.rollup(by).agg(
        F.grouping(by).alias("_all"), F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"), F.count_if(dec == "drop").alias("dropped"), F.count_if(dec == "quarantine").alias("quarantined"),
        F.count_if((dec == "keep") & dup).alias("duplicates"), F.sum(n).alias("raw_chars"), F.sum(F.when(kept, n).otherwise(0)).alias("kept_chars"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return g.select(F.when(F.col("_all") == 1, "all").otherwise("one").alias("level"), by, "seen", "kept", "dropped", "quarantined", "duplicates", "raw_chars", "kept_chars", rate("kept", "seen").alias("keep_rate"), rate("kept_chars", "raw_chars").alias("char_keep_rate"))


def by_category_and_source(df: DataFrame, category: str, source: str, text: str = "text") -> DataFrame:
    """Documents, characters and share of characters per category, per source and in all, by grouping sets in one pass."""
    d = df.select(category, source, F.coalesce(F.length(text), F.lit(0)).alias("_n"))
    g = d.groupingSets([[category], [source], []], category, source).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("docs"), F.sum("_n").alias("chars"))
    total = F.max(F.when(F.col("_g") == 3, F.col("chars"))).over(Window.partitionBy())
    level = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "source").otherwise("all")
    return g.select(level.alias("level"), F.when(F.col("_g") == 1, F.col(category)).when(F.col("_g") == 2, F.col(source)).alias("name"), "docs", "chars", F.round(F.coalesce(F.col("chars") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("share"))


def length_stats(df: DataFrame, by: list[str], text: str = "text", thresholds: tuple[int, ...] = (512, 1024, 2048)) -> DataFrame:
    """Documents, shortest, mean, median, longest, how many pass each threshold, and the Han share weighted by length; null texts are left out."""
    n, t = F.length(text), F.col(text)
    return (
        df.where(t.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("docs"), F.min(n).alias("min_chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(F.percentile(n, 0.5), 4).alias("median_chars"), F.max(n).alias("max_chars"),
            *(F.count_if(n > k).alias(f"over_{k}") for k in thresholds),
            F.round(F.coalesce(F.sum(T.chinese_ratio(t) * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)), 6).alias("chinese_ratio"),
        )
    )


def top_with_ties(df: DataFrame, key: str, first: str, n: int = 10) -> DataFrame:
    """The n commonest values with their counts; ties keep the value seen first (smallest `first`)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("seen_at")).orderBy(F.desc("n"), F.asc("seen_at")).limit(n)


def first_per_group(df: DataFrame, group: str, order: str, n: int, keep: list[str]) -> DataFrame:
    """The first n rows of each group: per group a bounded array of the n smallest, filled by partial aggregation (min of arrays by rank), so a hot
    group never sits in one window. Rows of a null order are left out."""
    # Rows are salted by their order, each salt keeps n, then the group's n are taken from at most n x salts rows.
    d = df.where(F.col(order).isNotNull()).select(group, order, *[c for c in keep if c not in (group, order)]).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(32)))
    once = d.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order))).where(F.col("_r") <= n)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank") <= n).drop("_salt", "_r")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """A repeatable random sample of n rows per group: the n smallest digests of (seed, key)."""
    d = df.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return first_per_group(d, group, "_h", n, [key, *(keep or [])]).drop("_h", "rank")


def shuffled(df: DataFrame, key: str, seed: int = 0, out: str = "position") -> DataFrame:
    """df in a repeatable random order, numbered from 0: positions are running totals over hash ranges, so no task sorts everything."""
    from textlake.operators.mixture import running_total

    d = df.withColumn("_h", T.hash60(seed, F.col(key)))
    return running_total(d, [], "_h", F.lit(1), out, tie=key).drop("_h")


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """One page of an ordered table: size within 24 to 1000, number from 1 and at most the last page. Adds total and total_pages."""
    size = min(max(size, 24), 1000)
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    return df.orderBy(order).offset((number - 1) * size).limit(size).withColumns({"total": F.lit(total), "total_pages": F.lit(pages), "page": F.lit(number)})


def load_report(df: DataFrame, source: str, status: Column) -> DataFrame:
    """Rows loaded per source and how many of them are 'kept', 'empty', 'filtered', 'duplicate'."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("loaded"), *(F.count_if(status == s).alias(s) for s in ("kept", "empty", "filtered", "duplicate")))


def field_usage(df: DataFrame, field: Column) -> DataFrame:
    """(field, n, is_mode): how often each text field was used."""
    n = df.select(field.alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("is_mode", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("field"))) == 1)


def eval_metrics(df: DataFrame, prompt: str, generated: str, bad_markers: tuple[str, ...] = ("<unk>", "�", "<|")) -> DataFrame:
    """Mean length, empty answers, mean repetition and how many answers hold a bad marker."""
    body = F.substring(F.col(generated), F.length(prompt) + 1, F.length(generated))
    bad = F.lit(False)
    for m in bad_markers:
        bad = bad | F.contains(F.col(generated), F.lit(m))
    d = df.select(body.alias("c"), bad.alias("bad"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("c")), 4).alias("mean_length"), F.count_if(T.strip(F.col("c")) == "").alias("empty"), F.round(F.avg(T.repeated_char_ratio(F.col("c"))), 6).alias("repeated_char"), F.round(F.avg(T.repeated_ngram_ratio(F.col("c"))), 6).alias("repeated_ngram"), F.count_if("bad").alias("bad_markers"))
