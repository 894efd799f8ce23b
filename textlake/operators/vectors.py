"""Embeddings and logits: cosine neighbours, softmax, entropy, nuclei, attention."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v by its length, which is at least FLOOR. Null gives null."""
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(n, F.size(v)).alias("n")), lambda x: x["v"].cast("double") / x["n"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, distance, rank): the k nearest of each query by cosine, itself excluded; ties by key. k from 1 to 100.

    A stated query set against all rows, in blocks: the queries are gathered into blocks of at most BLOCK unit vectors and every partition of the
    vectors is compared with each block by one matrix product, keeping k a query; only those leave the partition.
    """
    k = min(max(k, 1), 100)
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("qv"))
    blocks = q.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // BLOCK))))).groupBy("b").agg(F.collect_list(F.struct("q", "qv")).alias("qs"))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("i"), F.col(vector).alias("v"))
    parts = v.withColumn("p", F.spark_partition_id()).groupBy("p", F.pmod(F.xxhash64("i"), F.lit(8)).alias("s")).agg(F.collect_list(F.struct("i", "v")).alias("vs"))

    def compare(batches):
        import pandas as pd

        for pdf in batches:
            for qs, vs in zip(pdf["qs"], pdf["vs"]):
                a, b = (np.array([r[n] for r in rows], np.float64) for n, rows in (("qv", qs), ("v", vs)))
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), FLOOR)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), FLOOR)
                qi, vi = np.array([r["q"] for r in qs]), np.array([r["i"] for r in vs])
                sim = a @ b.T
                sim[qi[:, None] == vi[None, :]] = -np.inf
                n = min(k, len(vi))
                top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                # Ties at the border are all kept here; the final rank decides.
                edge = np.take_along_axis(sim, top, 1).min(axis=1)
                r, c = np.nonzero((sim >= edge[:, None]) & (sim > -np.inf))
                yield pd.DataFrame({"query": qi[r], key: vi[c], "similarity": sim[r, c]})

    near = parts.crossJoin(blocks).select("qs", "vs").mapInPandas(compare, f"query bigint, {key} bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), F.asc(key))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("distance", 1 - F.col("similarity"))


#: Query vectors compared at once.
BLOCK = 512


def layout(points: np.ndarray) -> np.ndarray:
    """Two principal axes of at most 41 points, scaled to [-1, 1]; the sign of an axis is arbitrary."""
    x = points - points.mean(axis=0, keepdims=True)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    out = np.zeros((len(points), 2))
    out[:, : min(2, len(axes))] = x @ axes[:2].T
    return out / max(np.abs(out).max(), FLOOR)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the temperature is at least 1e-6."""
    t = max(temperature, 1e-6)
    top = F.array_max(logits).cast("double")
    shifted = F.transform(F.arrays_zip(logits.alias("x"), F.array_repeat(top, F.size(logits)).alias("m")), lambda p: F.exp((p["x"].cast("double") - p["m"]) / t))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.arrays_zip(shifted.alias("e"), F.array_repeat(total, F.size(logits)).alias("s")), lambda p: p["e"] / p["s"])


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def distribution(df: DataFrame, key: str, logits: str, temperatures: tuple[float, ...] = (0.5, 0.8, 1.0, 1.5)) -> DataFrame:
    """(key, temperature, entropy, normalized_entropy, top_probability) of each row at each temperature."""
    n = F.size(logits)
    out = None
    for t in temperatures:
        d = df.select(key, F.lit(float(t)).alias("temperature"), softmax(F.col(logits), t).alias("_p"), n.alias("_n"))
        d = d.select(key, "temperature", entropy(F.col("_p")).alias("entropy"), (entropy(F.col("_p")) / F.greatest(F.log(F.col("_n").cast("double")), F.lit(FLOOR))).alias("normalized_entropy"), F.array_max("_p").alias("top_probability"))
        out = d if out is None else out.unionByName(d)
    return out


def candidates(df: DataFrame, key: str, logits: str, k: int, temperature: float = 1.0) -> DataFrame:
    """(key, token, logit, probability, rank): the k likeliest places of each row; ties by place."""
    d = df.select(key, F.col(logits).alias("_l"), softmax(F.col(logits), temperature).alias("_p"))
    e = d.select(key, F.posexplode(F.arrays_zip(F.col("_l").alias("l"), F.col("_p").alias("p"))).alias("token", "x")).select(key, "token", F.col("x.l").cast("double").alias("logit"), F.col("x.p").alias("probability"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("logit"), F.asc("token")))
    return e.withColumn("rank", r).where(F.col("rank") <= k)


def rank_of(logits: Column, token: Column) -> Column:
    """1 + how many logits are larger than the token's."""
    x = F.element_at(logits, token + 1)
    return F.size(F.filter(F.transform(F.arrays_zip(logits.alias("l"), F.array_repeat(x, F.size(logits)).alias("x")), lambda p: p["l"] > p["x"]), lambda b: b)) + 1


def nucleus(df: DataFrame, key: str, logits: str, top_p: float, include_crossing: bool = True, temperature: float = 1.0) -> DataFrame:
    """(key, token, probability): the likeliest tokens up to top_p. With include_crossing the one that crosses is in; without, those whose running sum
    stays within top_p and always the first. Probabilities are scaled to sum to 1."""
    d = candidates(df, key, logits, 1 << 30, temperature)
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_c", F.sum("probability").over(w))
    keep = (F.col("_c") - F.col("probability") < top_p) if include_crossing else ((F.col("_c") <= top_p) | (F.col("rank") == 1))
    kept = d.where(keep)
    return kept.withColumn("probability", F.col("probability") / F.sum("probability").over(Window.partitionBy(key))).select(key, "token", "probability")


def sample_token(df: DataFrame, key: str, logits: str, top_k: int | None = None, top_p: float | None = None, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, token): a repeatable draw from each row: greedy where temperature is 0, else from the top k, the nucleus, or all."""
    if temperature == 0:
        return candidates(df, key, logits, 1).select(key, "token")
    d = nucleus(df, key, logits, top_p, temperature=temperature) if top_p else candidates(df, key, logits, top_k or 1 << 30, temperature).select(key, "token", "probability")
    u = (F.pmod(T.hash60(seed, F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    w = Window.partitionBy(key).orderBy(F.desc("probability"), F.asc("token"))
    total = F.sum("probability").over(Window.partitionBy(key))
    d = d.withColumn("_c", F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).where(F.col("_c") >= u)
    return d.groupBy(key).agg(F.min_by("token", "_c").alias("token"))


def causal_attention(scores: DataFrame) -> DataFrame:
    """(head, query, key, weight): softmax over keys not behind the query. scores: (head, query, key, score)."""
    w = Window.partitionBy("head", "query")
    d = scores.where(F.col("key") <= F.col("query")).withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return d.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e", "score")


def attention_entropy(weights: DataFrame, top: int = 8) -> DataFrame:
    """(head, query, entropy, top_keys): entropy of each row of weights and its strongest keys."""
    t = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("key").alias("key")))), 1, top)
    return weights.groupBy("head", "query").agg(F.sum(F.when(F.col("weight") > 0, -F.col("weight") * F.log("weight")).otherwise(0.0)).alias("entropy"), F.transform(t, lambda x: x["key"]).alias("top_keys"))


def context_repetition(ids: Column, window: int = 128) -> Column:
    """1 - distinct / all of the last `window` ids; 0 for none."""
    last = F.slice(ids, F.greatest(F.size(ids) - window + 1, F.lit(1)), F.lit(window))
    return F.when(F.size(ids) > 0, 1 - F.size(F.array_distinct(last)) / F.size(last)).otherwise(F.lit(0.0))


def resolve_targets(query: str, vocab: DataFrame, limit: int = 8) -> DataFrame:
    """Rows (id, token) that a query names: 'id:7' or '#7' an id, else the characters of the query in order, at most `limit`."""
    q = query.strip()
    number = q.removeprefix("id:").removeprefix("#")
    if q != number and number.isdigit():
        return vocab.where(F.col("id") == int(number))
    order = {c: i for i, c in reversed(list(enumerate(q)))}
    wanted = sorted(order, key=order.get)[: max(1, min(limit, 8))]
    place = F.create_map(*(x for c in wanted for x in (F.lit(c), F.lit(order[c]))))[F.col("token")] if wanted else F.lit(0)
    return vocab.where(F.col("token").isin(*wanted)).orderBy(place) if wanted else vocab.limit(0)
