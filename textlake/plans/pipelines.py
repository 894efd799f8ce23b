"""Whole pipelines: clean, mix, shard; and the look-ups of a dashboard as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import audit, dedup, mixture, rules, runs, tokens, vectors
from textlake.runtime import materialize, spread


#: Categories of a mixture, and checkpoints that are compared, at most.
MAX_CATEGORIES, MAX_CHECKPOINTS = 100_000, 4


def clean(docs: DataFrame, order: str, text: str = "text", source_name: str = "source_name", source_type: str = "source_type", profile: rules.Profile = rules.ZH) -> DataFrame:
    """docs with normalised text, source_kind, flags, decision and is_duplicate (of kept texts, by compact key, first in order wins)."""
    # Some five hundred expressions of the rules read the normalised text, so it is a table of its own.
    d = rules.classify(materialize(spread(docs).withColumn(text, T.normalize_clean(F.col(text)))), text, source_name, source_type, profile)
    d = materialize(d)
    # Only kept rows compete: the others get keys of their own.
    key = F.when(F.col("decision") == "keep", T.compact_key(F.col(text))).otherwise(F.concat(F.lit("#"), F.col(order).cast("string")))
    return dedup.mark_duplicates(d, key, F.col(order))


def mix(cleaned: DataFrame, order: str, weights: DataFrame, target_chars: int, caps: dict[str, int], category: str = "source_type", source: str = "source_name") -> DataFrame:
    """Kept, first copies under source caps, category quotas by largest remainder, and the global target."""
    kept = cleaned.where("decision = 'keep' and not is_duplicate")
    rows = mixture.apportion(weights, target_chars, category).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    quotas = {r[category]: r["quota"] for r in rows}
    return mixture.quotas_and_caps(kept, order, F.length("text"), quotas, caps, target_chars, category, source)


def shards(docs: DataFrame, order: str, ids: str, path: str, shard_tokens: int) -> DataFrame:
    return tokens.write_shards(docs, path, order, ids, shard_tokens)


# The dashboard's questions, with its clamps.


def vocabulary_page(vocab: DataFrame, query: str = "", page: int = 1, page_size: int = 100) -> DataFrame:
    """Tokens whose id, text or display holds the query, one page of them by id."""
    d = vocab.withColumn("display", T.visible(F.col("token"))).withColumn("special", T.has(F.col("token"), r"^<[^>]+>$"))
    if query:
        q = F.lit(query)
        d = d.where(F.contains(F.col("id").cast("string"), q) | F.contains("token", q) | F.contains("display", q))
    return audit.page(d, "id", page, page_size)


def list_runs(summary: DataFrame, state: str = "state", updated: str = "updated_at") -> DataFrame:
    """Running, then stale, then other runs; the latest first."""
    return summary.orderBy(F.when(F.col(state) == "running", 0).when(F.col(state) == "stale", 1).otherwise(2), F.desc(updated))


def training_log(log: DataFrame, run_id: str, points: int | None = None, tail: int | None = None) -> DataFrame:
    """One run's log, a row a step; heartbeats thinned to `points` even places, or the last `tail` rows."""
    d = runs.latest_per_step(log.where(F.col("run_id") == run_id))
    if points is not None:
        hb = d.where("status_source = 'heartbeat'")
        return d.where("status_source is distinct from 'heartbeat'").unionByName(runs.downsample(hb, min(points, 5000))).orderBy("step")
    return (runs.tail(d, tail) if tail else d).orderBy("step")


def dataset_samples(docs: DataFrame, group: str, key: str, n: int = 8, seed: int = 0) -> DataFrame:
    d = audit.sample_per_group(docs, group, key, min(max(n, 1), 50), seed, ["text"])
    return d.withColumn("text", T.shorten(F.col("text"), 1600, squeeze=False))


def token_neighborhood(table: DataFrame, query: int, k: int = 12) -> DataFrame:
    return vectors.nearest(table.where(F.col("vec_id") == query), table, k)


def next_token(logits: DataFrame, key: str, column: str, k: int = 10, temperature: float = 1.0) -> DataFrame:
    return vectors.candidates(logits, key, column, min(max(k, 1), 100), temperature)


def compare_checkpoints(logits: dict[str, DataFrame], key: str, column: str, k: int = 10) -> DataFrame:
    """Candidates of up to MAX_CHECKPOINTS checkpoints below each other; more are an error."""
    if len(logits) > MAX_CHECKPOINTS:
        raise ValueError(f"more than {MAX_CHECKPOINTS} checkpoints")
    out = None
    for name, d in logits.items():
        c = next_token(d, key, column, k).withColumn("checkpoint", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out
