"""Problem 10: per-document statistics, outlier scores from exact ranks, and the documents that are no running prose.

The statistics of a document come from one pass over its text, unrounded. Their ranks are exact and per language: all values of all statistics are
sorted once by range partitions of (language, statistic, value), ranked inside each partition, and shifted by the counts of the partitions before it;
equal values that lie in several partitions are put together by the few values at the partitions' edges. Copies of a text have one vote together, so
that a page repeated often does not become what is usual; its score goes to every copy. A language of few texts is ranked among the texts of all
languages.
From the ranks comes the empirical tail probability of each value, on the side that speaks against prose (or on both); the outlier score of a document
is the mean of -log of its two smallest tails. Documents of a high score are looked at closely: the shapes of their lines decide (see shapes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.llm import shapes
from textlake.llm.forms import former
from textlake.runtime import materialize, table

#: Ranked statistics and the side of their distribution that speaks against running prose; 'both' doubles the smaller tail.
SIDES = {
    "symbol_share": "high", "digit_share": "high", "punct_line_share": "low", "common_word_share": "low", "mean_line_length": "low", "mean_word_length": "both", "char_variety": "both",
    "n_lines": "high", "word_count": "both", "n_chars": "both",
}
#: Those that make the score; the length of a text says little about its kind.
SCORED = tuple(SIDES)[:7]
#: So many of the smallest tails make the score.
TAILS = 2
#: A language of fewer distinct texts than this is ranked among those of all languages; where even they are fewer, no document is ranked.
LEAST_TEXTS = 100
#: Stands for all languages together in the ranks.
EVERY = "*"
#: A document whose outlier score is at least this is looked at closely: the score of texts that are alike and make up a third of their language.
MIN_SCORE = math.log(3) - 0.01
#: Share of the characters outside sentences beyond which a document is no running prose.
LIST_SHARE = 0.5
#: More common words than this are no list of common words.
MAX_COMMON = 100_000
LANGS = ("zh", "en", "fr", "de")
SENTENCE_MARKS = "。！？!?.;…”\"」』)"
NUMBERS = ("mean_word_length", "symbol_share", "digit_share", "punct_line_share", "common_word_share", "mean_line_length", "char_variety")
SCHEMA = "doc_id bigint, lang string, text_hash binary, n_chars bigint, n_lines bigint, word_count bigint, " + ", ".join(f"{c} double" for c in NUMBERS)


def common_words(common: DataFrame) -> dict[str, set[str]]:
    """Words by language; 'und' has those of all. common holds (lang, word); more than MAX_COMMON rows are an error."""
    rows = common.where("lang is not null and word is not null").limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    words: dict[str, set[str]] = {}
    for r in rows:
        words.setdefault(r.lang, set()).add(r.word.lower())
    words["und"] = set().union(*words.values())
    return words


def statistics(form: str, vocabulary: set[str]) -> tuple:
    """(n_lines, word_count, *NUMBERS) of a text in the consistent form; counts of 0 and nulls for one without a visible character.

    A word is a Han character or a run of letters of another script; char_variety is the number of different characters by the root of all.
    """
    n = shapes.visible(form)
    if not n:
        return (0, 0, *[None] * len(NUMBERS))
    han = shapes.count_han(form)
    other = shapes.WORD.findall(form)
    count = han + len(other)
    letters = han + sum(map(len, other))
    digits = len(shapes.DIGIT.findall(form))
    full = [x for x in map(str.rstrip, form.split("\n")) if x]
    known = sum(w.lower() in vocabulary for w in other)
    if han:
        known += sum(len(w) * form.count(w) for w in vocabulary if "㐀" <= w[0] <= "鿿")
    share = lambda x, y: x / y if y else 0.0
    return (
        len(full), count, share(letters, count), share(max(0, n - letters - digits), n), share(digits, n), share(sum(x[-1] in SENTENCE_MARKS for x in full), len(full)),
        share(known, count), n / len(full), len(set(form)) / math.sqrt(n),
    )


def list_share(form: str, raw: str) -> float | None:
    """Share of the visible characters that stand outside sentences, by the shapes of the lines; null without a visible character."""
    kinds = shapes.page([shapes.line_kind(a, b) for a, b in zip(form.split("\n"), raw.split("\n"))])
    n = sum(x for _, x, _ in kinds)
    return sum(x for _, _, x in kinds) / n if n else None


def document_stats(df: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document with SCHEMA's columns; text_hash has 128 bits. Null and blank texts have zero counts and null statistics; an unknown or
    null language becomes 'und', whose common words are those of all languages. Null keys are left out."""
    make, words = former(df.sparkSession), common_words(common)
    t = F.col(text).cast("string")
    src = df.select(F.col(key).cast("bigint").alias("doc_id"), F.when(F.col(lang).isin(*LANGS), F.col(lang)).otherwise("und").alias("lang"), F.unhex(F.md5(t.cast("binary"))).alias("h"), t.alias("t")).where("doc_id is not null")

    def run(batches):
        forms = make()
        for b in batches:
            texts = b.column(3).to_pylist()
            rows = [statistics(f or "", words.get(lg, words["und"])) for lg, f in zip(b.column(1).to_pylist(), forms(texts))]
            cols = list(zip(*rows)) if rows else [[]] * (2 + len(NUMBERS))
            kinds = [pa.int64()] * 2 + [pa.float64()] * len(NUMBERS)
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x or "") for x in texts], pa.int64()), *arrays], ["doc_id", "lang", "text_hash", "n_chars", "n_lines", "word_count", *NUMBERS])

    return src.mapInArrow(run, SCHEMA)


def list_shares(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, list_share) of every row with a visible character."""
    make = former(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t <> ''")

    def run(batches):
        forms = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list_share(f, t) for f, t in zip(forms(texts), texts)], pa.float64())], ["k", "list_share"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, list_share double").where("list_share is not null").withColumnRenamed("k", key)


def votes(stats: DataFrame) -> DataFrame:
    """One row of statistics for each distinct text of a language, blank ones left out. Copies are combined before the shuffle."""
    return stats.where("mean_word_length is not null").groupBy("lang", "text_hash").agg(*(F.first(c).cast("double").alias(c) for c in SIDES))


def _local_ranks(batches):
    """Ranks inside one sorted partition: lower counts the smaller values of the same group and statistic, ties the equal ones."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    t = t.combine_chunks()
    grp, stat, value = t["grp"].to_numpy(zero_copy_only=False).astype(str), t["stat"].to_numpy(), t["value"].to_numpy()
    new = np.ones(len(value), bool)
    new[1:] = (grp[1:] != grp[:-1]) | (stat[1:] != stat[:-1])
    step = new.copy()
    step[1:] |= value[1:] != value[:-1]
    at = np.arange(len(value))
    first = np.maximum.accumulate(np.where(step, at, 0))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    ends = np.append(np.flatnonzero(step)[1:], len(value))
    ties = (ends - np.flatnonzero(step))[np.cumsum(step) - 1]
    yield from t.append_column("lower", pa.array(first - begin, pa.int64())).append_column("ties", pa.array(ties, pa.int64())).to_batches()


def exact_ranks(values: DataFrame, ranges: int | None = None) -> DataFrame:
    """values (grp, stat, value, and what else they carry) with lower, ties and total: how many values of the same grp and stat are smaller, equal,
    and there. Null values are left out.

    One range-partitioned sort; a value that a third of all rows share is spread over partitions by the other columns. What is gathered are one row
    per partition, group and statistic in it, and the values at the edges of partitions: both are broadcast and as many as there are partitions.
    """
    spark = values.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "stat", "value"]
    rest = [c for c in values.columns if c not in order]
    d = values.where("value is not null").repartitionByRange(ranges, *order, *rest).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", lower bigint, ties bigint"
    local = materialize(d.mapInArrow(_local_ranks, schema))
    by = Window.partitionBy("grp", "stat")
    parts = local.groupBy("grp", "stat", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.min_by("ties", "value").alias("lo_ties"), F.max("value").alias("hi"), F.max_by("ties", "value").alias("hi_ties"))
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(by)})
    parts = materialize(parts)
    low = F.struct(F.col("lo").alias("value"), F.col("before").alias("under"), F.col("lo_ties").alias("t"))
    high = F.struct(F.col("hi").alias("value"), (F.col("before") + F.col("n") - F.col("hi_ties")).alias("under"), F.col("hi_ties").alias("t"))
    edges = parts.select("grp", "stat", F.explode(F.array_distinct(F.array(low, high))).alias("x")).groupBy("grp", "stat", F.col("x.value").alias("value")).agg(F.min("x.under").alias("under"), F.sum("x.t").alias("all_ties"))
    out = local.join(F.broadcast(parts.select("grp", "stat", "part", "before", "total")), ["grp", "stat", "part"]).join(F.broadcast(edges), order, "left")
    return out.select(*order, *rest, F.coalesce("under", F.col("before") + F.col("lower")).alias("lower"), F.coalesce("all_ties", "ties").alias("ties"), "total")


def surprise(side: Column, lower: Column, ties: Column, total: Column) -> Column:
    """-log of the tail probability of a value with the given counts."""
    up, down = (total - lower) / total, (lower + ties) / total
    return -F.log(F.when(side == "high", up).when(side == "low", down).otherwise(F.least(F.lit(1.0), 2 * F.least(up, down))))


def outlier_scores(stats: DataFrame, scored: tuple[str, ...] = SCORED, others: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """(lang, text_hash, outlier_score, tails) of every distinct text that could be ranked; tails maps the ranked statistics, those of others too, to
    their -log tail probabilities."""
    one = materialize(votes(stats))
    sizes = {r.lang: r["count"] for r in one.groupBy("lang").count().collect()}
    small = [lg for lg, n in sizes.items() if n < LEAST_TEXTS]
    names = [*scored, *others]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(names)))).alias("x")
    long = one.select(F.col("lang").alias("grp"), "lang", "text_hash", pairs).where(~F.col("lang").isin(small) if small else F.lit(True))
    if small and sum(sizes.values()) >= LEAST_TEXTS:
        long = long.unionByName(one.select(F.lit(EVERY).alias("grp"), "lang", "text_hash", pairs))
    ranked = exact_ranks(long.select("grp", "x.stat", "x.value", "lang", "text_hash"), ranges)
    # Texts of all languages stand in the ranks of EVERY, only those of small ones are judged by them.
    ranked = ranked.where((F.col("grp") != EVERY) | (F.col("lang").isin(small) if small else F.lit(False)))
    side = F.element_at(F.array(*(F.lit(SIDES[c]) for c in names)), F.col("stat") + 1)
    d = ranked.select("lang", "text_hash", "stat", surprise(side, F.col("lower"), F.col("ties"), F.col("total")).alias("s"))
    g = d.groupBy("lang", "text_hash").agg(F.collect_list(F.struct("stat", "s")).alias("x"))
    top = F.slice(F.sort_array(F.transform(F.filter("x", lambda v: v["stat"] < len(scored)), lambda v: v["s"]), asc=False), 1, TAILS)
    name = F.array(*map(F.lit, names))
    tails = F.map_from_entries(F.transform("x", lambda v: F.struct(F.element_at(name, v["stat"] + 1), v["s"])))
    return g.select("lang", "text_hash", F.aggregate(top, F.lit(0.0), lambda a, x: a + x / TAILS).alias("outlier_score"), tails.alias("tails"))


def candidates(stats: DataFrame, scores: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id of the documents to look at closely: those of a high score, and those with visible characters that could not be ranked."""
    d = stats.where("mean_word_length is not null").select("doc_id", "lang", "text_hash").join(scores.select("lang", "text_hash", "outlier_score"), ["lang", "text_hash"], "left")
    return d.where(F.col("outlier_score").isNull() | (F.col("outlier_score") >= min_score)).select("doc_id")


def not_prose(df: DataFrame, common: DataFrame, min_score: float = MIN_SCORE, share: float = LIST_SHARE) -> DataFrame:
    """doc_id of the outliers of which more than `share` of the characters stand outside sentences. Null, empty and blank texts are none. A doc_id that
    is stored twice is one document if either text is found."""
    stats = materialize(document_stats(df, common))
    close = candidates(stats, outlier_scores(stats), min_score)
    return list_shares(df.select("doc_id", "text").join(close, "doc_id", "left_semi")).where(F.col("list_share") > share).select("doc_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, share outside sentences, tails of all statistics and outlier score of every document; null scores where it is blank or not ranked."""
    docs = table(spark, sf_dir, "documents")
    stats = materialize(document_stats(docs, table(spark, sf_dir, "common_word")))
    scores = outlier_scores(stats, others=tuple(c for c in SIDES if c not in SCORED))
    out = stats.join(scores, ["lang", "text_hash"], "left").join(list_shares(docs).groupBy("doc_id").agg(F.max("list_share").alias("list_share")), "doc_id", "left")
    return out.select("doc_id", "lang", "n_chars", "n_lines", "word_count", *NUMBERS, "list_share", "outlier_score", "tails")


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats}
