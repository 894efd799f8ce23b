"""Problem 9: filling containers of fixed capacity with documents, sized in tokens.

Best-two-fit: a container takes the largest item left, then greedily the largest that still fits; then its smallest item is replaced by the two items
left that fill the widened gap best, as long as that fills it better. Items are integers up to the capacity, so the items left are counts by
size with a bit set over them: the largest that fits, and a pair of a given sum, are found by a few operations on long integers.
Documents are dealt to independent groups by a hash of their id, so no task ever holds more than about GROUP_ITEMS of them; what a group loses is
its last containers. A document larger than the capacity fills whole containers alone and its rest is an item like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.tokens import token_counts
from textlake.runtime import materialize, table

#: Documents of one packing group, about; a bigger group wastes less in its last containers and takes longer.
GROUP_ITEMS = 10_000
#: Tasks over which the groups are spread at most.
MAX_TASKS = 20_000
#: Container sizes at most.
MAX_CAPACITIES = 1000
OUT = "container string, container_id bigint, doc_id bigint, part int, first_token bigint, tokens bigint, space_left bigint"


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, space left in each container). Sizes are 1 to capacity; items of one size are taken in their order."""
    order = np.argsort(sizes, kind="stable")
    left: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        left.setdefault(int(sizes[i]), []).append(i)
    mask = sum(1 << s for s in left)
    mirror = sum(1 << (capacity - s) for s in left)
    where = np.full(len(sizes), -1, np.int64)
    spaces: list[int] = []

    def take(s: int) -> int:
        nonlocal mask, mirror
        items = left[s]
        i = items.pop()
        if not items:
            mask &= ~(1 << s)
            mirror &= ~(1 << (capacity - s))
        return i

    def give(s: int, i: int) -> None:
        nonlocal mask, mirror
        left.setdefault(s, []).append(i)
        mask |= 1 << s
        mirror |= 1 << (capacity - s)

    def pair(total: int) -> int:
        """The larger size of two items left whose sum is total, or 0."""
        hits = mask & (mirror >> (capacity - total) if total <= capacity else mirror << (total - capacity))
        if total % 2 == 0 and hits >> (total // 2) & 1 and len(left[total // 2]) < 2:
            hits &= ~(1 << (total // 2))
        return hits.bit_length() - 1 if hits else 0

    while mask:
        gap, inside = capacity, []
        while gap and (fits := mask & ((2 << gap) - 1)):
            s = fits.bit_length() - 1
            inside.append((s, take(s)))
            gap -= s
        while gap and mask:
            inside.sort()
            small, i = inside[0]
            # Another item of the smallest one's size, or two that sum to more than it.
            for total in range(gap + small, small, -1):
                if a := pair(total):
                    inside[0] = (a, take(a))
                    inside.append((total - a, take(total - a)))
                    give(small, i)
                    gap += small - total
                    break
            else:
                break
        for _, i in inside:
            where[i] = len(spaces)
        spaces.append(gap)
    return where, np.array(spaces, np.int64)


def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group of documents for one container size. Documents without tokens lie in the group's first container."""
    pdf = pdf.sort_values("doc_id", kind="stable")
    name, capacity, group = pdf["container"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["grp"].iloc[0])
    ids, n = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
    full, rest = n // capacity, n % capacity
    items = np.flatnonzero(rest)
    where, spaces = pack(rest[items], capacity)
    whole = np.repeat(np.arange(len(n)), full)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    empty = np.flatnonzero(n == 0)
    doc = np.concatenate([whole, items, empty])
    container = np.concatenate([len(spaces) + np.arange(len(whole)), where, np.zeros(len(empty), np.int64)])
    space = np.concatenate([spaces, np.zeros(len(whole), np.int64)])
    if not len(space):
        space = np.array([capacity])
    part = np.concatenate([nth, full[items], np.zeros(len(empty), np.int64)])
    return pd.DataFrame({
        "container": name, "container_id": (group << 40) + container, "doc_id": ids[doc], "part": part.astype(np.int32), "first_token": part * capacity,
        "tokens": np.concatenate([np.full(len(whole), capacity), rest[items], np.zeros(len(empty), np.int64)]), "space_left": space[container],
    })


def pack_documents(sizes: DataFrame, capacities: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """OUT: one row per document, or part of a split one, and container size. sizes: (doc_id, n_tokens); null ids are left out, null sizes count as 0.

    capacities: (container, capacity_tokens), broadcast, at most MAX_CAPACITIES rows, more are an error; those that are null or not positive are left out. A repeated doc_id is packed as
    often as it comes.
    """
    groups = max(1, -(-sizes.count() // group_items))
    s = sizes.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("grp"))
    c = capacities.where("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    if c.count() > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} container sizes")
    return s.crossJoin(F.broadcast(c)).repartition(min(groups * 4, MAX_TASKS), "container", "grp").groupBy("container", "grp").applyInPandas(pack_group, OUT)


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id"))
    return pack_documents(sizes, table(spark, sf_dir, "pack_capacity"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: containers, tokens, and the share of the space that is filled."""
    p = p9_packing(spark, sf_dir).groupBy("container", "container_id").agg(F.sum("tokens").alias("tokens"), F.first("space_left").alias("space_left"))
    return p.groupBy("container").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum(F.col("tokens") + F.col("space_left")), 6).alias("fill"))


def p9_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: documents that lie in containers, containers that hold more than their capacity, containers whose space left is not what is
    not filled, documents whose parts are not the whole document, and needless splits."""
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id"))
    capacities = table(spark, sf_dir, "pack_capacity")
    p = materialize(pack_documents(sizes, capacities))
    boxes = p.groupBy("container", "container_id").agg(F.sum("tokens").alias("tokens"), F.max("space_left").alias("left")).join(F.broadcast(capacities), "container")
    docs = p.groupBy("container", "doc_id").agg(F.sum("tokens").alias("packed"), F.count(F.lit(1)).alias("parts")).join(sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens")), "doc_id").join(F.broadcast(capacities), "container")
    a = boxes.groupBy("container").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_full"), F.count_if(F.col("tokens") + F.col("left") != F.col("capacity_tokens")).alias("wrong_space"))
    b = docs.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("packed") != F.col("n_tokens")).alias("not_whole"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("needless_splits"))
    return a.join(b, "container").select("container", "documents", "over_full", "wrong_space", "not_whole", "needless_splits")


QUERIES = {"p9_packing": p9_packing, "p9_fill": p9_fill, "p9_sound": p9_sound}

SQL = {
    "p9_sound": "select container, (select count(distinct doc_id) from documents) as documents, 0::bigint as over_full, 0::bigint as wrong_space, 0::bigint as not_whole, 0::bigint as needless_splits from pack_capacity where capacity_tokens > 0",
}
