"""Operators whose state is no prefix sum: ordered folds over narrow rows, part by part where the state allows it."""

from __future__ import annotations

import itertools
import math
import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.runtime import materialize


def _parts(df: DataFrame, *order: str) -> DataFrame:
    """df sorted into ranges of its order, each row with the number of its range, as a table of its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _folded(parts: DataFrame, fold, states: dict, schema: str) -> DataFrame:
    """fold(rows of a part in order, its state before) for every part at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf, states[int(pdf["part"].iloc[0])])[0]

    return parts.groupBy("part").applyInPandas(run, schema)


def _step(parts: DataFrame, number: int, fold, state):
    """The state after one part: its narrow rows are folded in one task, which sends back the state alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [pickle.dumps(fold(pdf, state)[1])]})

    return pickle.loads(parts.where(F.col("part") == number).groupBy("part").applyInPandas(run, "state binary").first().state)


def strict_cap(df: DataFrame, key: str, order: str, size: str, caps: dict[str, int]) -> DataFrame:
    """Rows of each key while the kept total stays within its cap: a row that would pass it is skipped, a later smaller one may still fit. order is unique.

    Narrow rows (key, order, size) of capped keys are cut into ranges of (key, order). A range that fits whole, or of which nothing fits, changes the
    state by its sums, which the driver adds; only a range in which some rows fit and others do not is folded to know its end. Then all ranges are folded
    at once, each from its own beginning, and the decisions join back.
    """
    narrow = df.where(F.col(key).isin(*caps)).select(F.col(key).alias("k"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    parts = _parts(narrow, "k", "o")

    def fold(pdf: pd.DataFrame, left: dict[str, int]):
        pdf = pdf.sort_values(["k", "o"], kind="stable")
        left, keep = dict(left), []
        for k, n in zip(pdf["k"], pdf["n"]):
            ok = n <= left[k]
            keep.append(ok)
            left[k] -= n if ok else 0
        return pdf.assign(keep=keep)[["o", "keep"]], left

    sums = parts.groupBy("part", "k").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least")).orderBy("part", "k").collect()
    state, states = dict(caps), {}
    for number, rows in itertools.groupby(sums, key=lambda r: r.part):
        rows = list(rows)
        states[number] = {r.k: state[r.k] for r in rows}
        if all(r.n <= state[r.k] or r.least > state[r.k] for r in rows):
            for r in rows:
                state[r.k] -= r.n if r.n <= state[r.k] else 0
        else:
            state.update(_step(parts, number, fold, states[number]))
    ok = _folded(parts, fold, states, f"o {df.schema[order].dataType.simpleString()}, keep boolean").where("keep").select(F.col("o").alias("_o"))
    return df.where(~F.coalesce(F.col(key).isin(*caps), F.lit(False))).unionByName(df.where(F.col(key).isin(*caps)).join(ok, F.col(order) == F.col("_o"), "left_semi"))


def evolving_share(df: DataFrame, order: str, size: str, special: Column, limit: float) -> DataFrame:
    """df with keep: special rows are rejected while kept special / kept other characters is at least limit; other rows always pass.

    One global sequence: its state depends on every row before, so narrow rows (order, size, special) pass through a single task. Other rows need
    not: the total of the others before each special row is a prefix sum, and only special rows are folded.
    """
    from textlake.operators.mixture import running_total

    d = running_total(df.withColumn("_special", special), [], order, F.when(special, 0).otherwise(F.col(size)), "_others")
    narrow = d.where("_special").select(order, F.col(size).cast("bigint").alias("size"), "_others", F.lit(0).alias("_one"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        kept, keep = 0, []
        for s, others in zip(pdf["size"].fillna(0), pdf["_others"]):
            ok = kept / max(others, 1) < limit
            keep.append(ok)
            kept += s if ok else 0
        return pdf.assign(keep=keep)[[order, "keep"]]

    kind = df.schema[order].dataType.simpleString()
    ok = narrow.groupBy("_one").applyInPandas(fold, f"{order} {kind}, keep boolean").select(F.col(order).alias("_o"), F.col("keep").alias("_k"))
    return d.join(ok, d[order] == ok["_o"], "left").withColumn("keep", F.when(F.col("_special"), F.col("_k")).otherwise(F.lit(True))).drop("_special", "_others", "_o", "_k")


def group_short(texts: Column, max_lines: int = 18, max_chars: int = 700, cut: int = 180) -> Column:
    """Consecutive short texts joined by line feeds: a group ends at max_lines or once it holds max_chars, counted before texts are cut. An
    aggregate over one row's array: the arrays are the groups a caller has made, such as the comments under one page."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("chars"))

    def step(a, t):
        lines, chars = F.concat(a["open"], F.array(F.substring(t, 1, cut))), a["chars"] + F.length(t)
        full = (F.size(lines) >= max_lines) | (chars >= max_chars)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(lines, "\n")))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(lines).alias("open"),
            F.when(full, 0).otherwise(chars).alias("chars"),
        )

    return F.aggregate(F.filter(texts, lambda t: t.isNotNull()), start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"]))


def chunk_text(text: Column, max_chars: int = 1600) -> Column:
    """A text cut at blank lines, and before the line with which a chunk would pass max_chars; blank chunks are left out."""
    from textlake.functions.text import strip

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("chars"))
    none = F.array().cast("array<string>")

    def step(a, raw):
        line = F.regexp_replace(raw, r"\s+$", "")
        blank, n, some = F.length(line) == 0, F.length(line), F.size(a["open"]) > 0
        flush = some & (blank | (a["chars"] + n > max_chars))
        kept = F.when(flush, none).otherwise(a["open"])
        return F.struct(
            F.when(flush, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"]).alias("done"),
            F.when(blank, none).otherwise(F.concat(kept, F.array(line))).alias("open"),
            F.when(blank, 0).otherwise(F.when(flush, 0).otherwise(a["chars"]) + n).alias("chars"),
        )

    end = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"])
    return F.filter(F.transform(F.aggregate(F.split(text, r"\r\n|\r|\n"), start, step, end), strip), lambda x: F.length(x) > 0)


def merge_short_chunks(chunks: Column, long: int = 50) -> Column:
    """Runs of chunks under `long` characters between longer ones become one chunk each."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))
    none = F.array().cast("array<string>")

    def step(a, c):
        is_long, some = F.length(c) >= long, F.size(a["open"]) > 0
        flushed = F.when(some, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"])
        return F.struct(F.when(is_long, F.concat(flushed, F.array(c))).otherwise(a["done"]).alias("done"), F.when(is_long, none).otherwise(F.concat(a["open"], F.array(c))).alias("open"))

    return F.aggregate(chunks, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"]))


def shard_exact(df: DataFrame, order: str, tokens: str, category: str, key_hit: str, quotas: dict[str, int], train_limit: int, val_limit: int, overflow: tuple[str, ...] = ()) -> DataFrame:
    """(order, split, written): the sharder with quotas and split limits at once, where a document cut by a split limit charges its category less.

    Decisions depend on each other across the whole sequence, but only where a limit is met: narrow rows (order, tokens, category, hash hit) are cut into
    ranges of the order, and a range that meets no limit changes the state by its sums, which the driver adds. Each limit is met once, so about as many
    ranges as there are limits are folded to know their ends. Then all ranges are folded at once, each from its own beginning.
    """
    narrow = df.select(F.col(order).alias("o"), F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"), F.col(category).alias("c"), F.coalesce(F.col(key_hit), F.lit(False)).alias("hit"))
    parts = _parts(narrow, "o")
    limit = {"train": train_limit, "val": val_limit}
    capped = {c: q for c, q in quotas.items() if c not in overflow}

    def fold(pdf: pd.DataFrame, state: tuple[dict[str, int], dict[str, int]]):
        pdf = pdf.sort_values("o", kind="stable")
        used, total = dict(state[0]), dict(state[1])
        out = []
        for o, n, c, hit in zip(pdf["o"], pdf["n"], pdf["c"], pdf["hit"]):
            if c in capped:
                n = min(n, capped[c] - used.get(c, 0))
            split = "val" if hit and total["val"] < val_limit else "train"
            written = min(n, limit[split] - total[split])
            if written > 0:
                total[split] += written
                if c in capped:
                    used[c] = used.get(c, 0) + written
                out.append((o, split, written))
        return pd.DataFrame(out, columns=["o", "split", "written"]), (used, total)

    sums = parts.groupBy("part", "c", "hit").agg(F.sum("n").alias("n")).orderBy("part").collect()
    state, states = ({}, {"train": 0, "val": 0}), {}
    for number, rows in itertools.groupby(sums, key=lambda r: r.part):
        states[number] = state
        used, total = dict(state[0]), dict(state[1])
        # As if no limit were met: categories and splits that are full add nothing.
        for r in rows:
            split = "val" if r.hit and state[1]["val"] < val_limit else "train"
            if r.n and state[1][split] < limit[split] and state[0].get(r.c, 0) < capped.get(r.c, math.inf):
                total[split] += r.n
                if r.c in capped:
                    used[r.c] = used.get(r.c, 0) + r.n
        met = total["train"] > train_limit or total["val"] >= val_limit > state[1]["val"] or any(v > capped[c] for c, v in used.items())
        state = _step(parts, number, fold, state) if met else (used, total)
    kind = df.schema[order].dataType.simpleString()
    return _folded(parts, fold, states, f"o {kind}, split string, written bigint").withColumnRenamed("o", order)
