"""Problem 3: mixing sources to target shares of the characters.

Weighted sampling without replacement by exponential keys (Efraimidis and Spirakis): each record gets -ln(u) / weight from a hash of its id, records
are put in key order within their source, and a running sum of characters fills the source's budget. Whole epochs of a source come first, at most
max_repeat of them; the rest of the budget is a prefix of the key order.
The texts are read once, for the characters and the weight of each record; all else is done on narrow rows. A source is cut into key ranges, so that
no task sorts a whole source; the running sum is local to a range and shifted by the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.text import hash60
from textlake.operators.mixture import running_total
from textlake.runtime import materialize, table

def unit_hash(*cols, seed: int = 0):
    """A number in (0, 1) from a 60-bit hash that any engine can compute."""
    return (hash60(seed, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 60))


def quality_weight(text):
    """Weight of a record: texts whose characters are mostly letters weigh 1, others less, never under 0.1."""
    n = F.greatest(F.length(text), F.lit(1))
    other = F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(2.0) * F.greatest(F.lit(0.0), other / n - F.lit(0.15)))


def key_order(records: DataFrame, targets: DataFrame, seed: int = 0, ranges: int | None = None) -> DataFrame:
    """(row_id, source_name, chars, key, running): the records of the targeted sources with their exponential keys and, within their source, the sum of
    characters up to and with each in key order.

    records: (row_id, source_name, chars, weight); null chars count as 0, null weights as 1; ties of the key are broken by row_id. The records are
    written once as narrow rows; a source that holds a third of them is cut into ranges of the key (see mixture.running_total).
    """
    known = targets.select(F.col("source_name").alias("_s")).where("_s is not null").distinct()
    weight = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6))
    r = records.select("row_id", "source_name", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), (-F.log(unit_hash("row_id", seed=seed)) / weight).alias("key"))
    # The targets are one row per source: a table that does not grow with the records.
    r = materialize(r.join(F.broadcast(known), F.col("source_name") == F.col("_s"), "left_semi"))
    ran = running_total(r, ["source_name"], "key", F.col("chars"), "_before", ranges, tie="row_id")
    return materialize(ran.select("row_id", "source_name", "chars", "key", (F.col("_before") + F.col("chars")).alias("running")))


def source_budgets(ordered: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: chars and records of its source (0 where it has none), total characters of all targeted sources, budget, reachable.

    A source has as many characters as its prefix sum ends with; it cannot reach its share where max_repeat whole epochs end before the budget does.
    target_share or max_repeat null counts as 0.
    """
    per = ordered.groupBy("source_name").agg(F.max("running").alias("chars"), F.count(F.lit(1)).alias("records"))
    t = targets.select("source_name", "source_type", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"))
    j = t.join(per, "source_name", "left").withColumn("chars", F.coalesce("chars", F.lit(0))).withColumn("records", F.coalesce("records", F.lit(0)))
    total = j.select("source_name", "chars").distinct().agg(F.sum("chars").alias("total_chars"))
    return (
        j.crossJoin(F.broadcast(total))
        .withColumn("wanted_chars", F.col("target_share") * F.col("total_chars"))
        .withColumn("reachable", F.col("max_repeat") * F.col("chars") >= F.col("wanted_chars"))
        .withColumn("budget", F.least(F.floor("wanted_chars"), F.col("max_repeat") * F.col("chars")))
        .withColumn("epochs", F.when(F.col("chars") > 0, F.floor(F.col("budget") / F.col("chars"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("chars"))
    )


def mix(ordered: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, source_name, chars, uses): how often each record of key_order() is used: all whole epochs, and once more the prefix of the key order that
    fits the rest of the budget. Records that are not used are left out. Null row ids are records like others."""
    b = source_budgets(ordered, targets).groupBy("source_name").agg(F.max("epochs").alias("epochs"), F.max("rest").alias("rest"))
    ran = ordered.join(F.broadcast(b), "source_name")
    return ran.withColumn("uses", (F.col("epochs") + F.when((F.col("running") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)).cast("int")).where("uses > 0").select("row_id", "source_name", "chars", "uses")


def report(ordered: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: what was wanted, what the mix holds, the real share, and whether the source can reach its share at all."""
    used = mix(ordered, targets).groupBy("source_name").agg(F.sum(F.col("chars") * F.col("uses")).alias("mixed_chars"), F.count(F.lit(1)).alias("records_used"), F.max("uses").alias("most_uses"))
    b = source_budgets(ordered, targets).join(used, "source_name", "left").na.fill(0, ["mixed_chars", "records_used", "most_uses"])
    total = used.agg(F.sum("mixed_chars").alias("all_chars"))
    return b.crossJoin(F.broadcast(total)).select(
        "source_name", "source_type", "target_share", "max_repeat", "records", "chars", "reachable", "mixed_chars", "records_used", "most_uses",
        F.round(F.coalesce(F.col("mixed_chars") / F.nullif("all_chars", F.lit(0)), F.lit(0.0)), 6).alias("real_share"),
    )


def _ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The records of adapted_document in key order, and the targets. Characters are counted from the texts, for char_count is not reliable."""
    t, targets = F.col("text"), table(spark, sf_dir, "mix_target")
    records = table(spark, sf_dir, "adapted_document").select("row_id", "source_name", F.coalesce(F.length(t), F.lit(0)).cast("bigint").alias("chars"), quality_weight(t).alias("weight"))
    return key_order(records, targets), targets


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose key order ends before their budget, however often it is repeated."""
    return report(*_ordered(spark, sf_dir)).where("not reachable").select("source_name").distinct()


def p3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_ordered(spark, sf_dir))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*_ordered(spark, sf_dir))


def p3_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sampling gives each source: whole epochs, and what is left for the fractional one."""
    return source_budgets(*_ordered(spark, sf_dir)).select("source_name", "records", F.col("chars").cast("bigint").alias("chars"), F.col("total_chars").cast("bigint").alias("total_chars"), "epochs", F.col("rest").cast("bigint").alias("rest"))


QUERIES = {"p3_found": p3_found, "p3_mix": p3_mix, "p3_shares": p3_shares, "p3_budgets": p3_budgets}

_MIX = r"""r as (select row_id, source_name, coalesce(length(text), 0)::bigint as chars, greatest(length(text), 1)::double as n, length(regexp_replace(text, '[\p{L}\s\x{0b}]', '', 'g'))::double as other,
        (('0x' || substr(md5('0:' || coalesce(row_id::varchar, '')), 1, 15))::bigint::double + 0.5) / 1152921504606846976.0 as u from adapted_document where source_name in (select source_name from mix_target)),
    k as (select *, -ln(u) / coalesce(greatest(0.1, 1.0 - 2.0 * greatest(0.0, other / n - 0.15)), 1.0) as key from r),
    o as (select *, sum(chars) over (partition by source_name order by key, row_id rows unbounded preceding) as running from k),
    s as (select m.*, coalesce(chars, 0) as chars, coalesce(records, 0) as records from mix_target m left join (select source_name, max(running) as chars, count(*) as records from o group by 1) using (source_name)),
    b as (select *, sum(chars) over () as total, least(floor(target_share * sum(chars) over ()), max_repeat * chars) as budget from s),
    e as (select *, case when chars > 0 then floor(budget / chars) else 0 end as epochs from b),
    x as (select o.row_id, o.source_name, o.chars, (epochs + case when running <= budget - epochs * e.chars and budget > epochs * e.chars then 1 else 0 end)::int as uses from o join e using (source_name))"""
SQL = {
    "p3_mix": f"with {_MIX} select row_id, source_name, chars, uses from x where uses > 0",
    "p3_shares": f"""with {_MIX}, u as (select source_name, sum(chars * uses) as mixed, count(*) as used, max(uses) as most from x where uses > 0 group by 1)
        select source_name, source_type, target_share, max_repeat, records::bigint as records, chars::bigint as chars, max_repeat * chars >= target_share * total as reachable, coalesce(mixed, 0)::bigint as mixed_chars, coalesce(used, 0)::bigint as records_used,
        coalesce(most, 0) as most_uses, round(coalesce(coalesce(mixed, 0)::double / nullif((select sum(mixed) from u), 0), 0), 6) as real_share from e left join u using (source_name)""",
    "p3_found": """
        with c as (select source_name, sum(length(text)) chars from adapted_document where source_name in (select source_name from mix_target) group by 1),
        t as (select sum(chars) total from c)
        select distinct m.source_name from mix_target m left join c using (source_name) cross join t
        where m.max_repeat * coalesce(c.chars, 0) < m.target_share * t.total""",
    "p3_budgets": """
        with c as (select source_name, sum(coalesce(length(text), 0)) chars, count(*) records from adapted_document group by 1), j as (select m.*, coalesce(c.chars, 0) chars, coalesce(c.records, 0) records from mix_target m left join c using (source_name)),
        b as (select *, sum(chars) over () total_chars, least(floor(target_share * sum(chars) over ()), max_repeat * chars) budget from j),
        e as (select *, case when chars > 0 then floor(budget / chars) else 0 end epochs from b)
        select source_name, records::bigint records, chars::bigint chars, total_chars::bigint total_chars, epochs::bigint epochs, (budget - epochs * chars)::bigint rest from e""",
}
