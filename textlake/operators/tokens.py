"""Vocabularies, token streams, shards and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.mixture import running_total
from textlake.runtime import materialize

SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def char_vocabulary(df: DataFrame, text: str = "text", specials: tuple[str, ...] = ()) -> DataFrame:
    """(id, token): distinct characters in code point order behind the specials. At most as many rows as Unicode has characters."""
    c = df.select(F.explode(F.array_distinct(chars(F.col(text)))).alias("token")).distinct()
    n = len(specials)
    out = c.select((F.row_number().over(Window.orderBy("token")) - 1 + n).cast("int").alias("id"), "token")
    if not n:
        return out
    s = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(specials)], "id int, token string")
    return s.unionByName(out)


def _by_code_point(vocab: DataFrame) -> DataFrame:
    """(_from, _ids): an array of ids by code point, -1 where there is none. One row, at most as long as Unicode."""
    v = vocab.where(F.length("token") == 1).select(F.ascii("token").alias("_c"), "id")
    m = v.agg(F.max("_c").alias("_top"), F.collect_list(F.struct("_c", "id")).alias("_pairs"))
    # Pairs are placed by sorting them together with every code point of the range: no map is searched.
    every = m.select(F.explode(F.sequence(F.lit(0), F.coalesce("_top", F.lit(0)))).alias("_c")).join(F.broadcast(v), "_c", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("_ids"))


def encode_chars(df: DataFrame, vocab: DataFrame, text: str = "text", out: str = "ids", unknown: int | None = None) -> DataFrame:
    """df with the ids of its characters. Unknown characters become `unknown`, or null where none is given. The vocabulary is broadcast as one array
    over code points, so each character is one array access."""
    d = df.crossJoin(F.broadcast(_by_code_point(vocab)))

    def look(table: Column) -> Column:
        return F.transform(chars(F.col(text)), lambda c: F.coalesce(F.nullif(F.get(table, F.ascii(c)), F.lit(-1)), F.lit(unknown).cast("int")))

    return d.withColumn(out, look(F.col("_ids"))).drop("_ids")


def decode_chars(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "decoded", skip: tuple[int, ...] = ()) -> DataFrame:
    """df with the text of its ids; unknown ids and those in skip give nothing. Vocabulary ids are dense from 0, so each is one array access."""
    m = vocab.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["token"]).alias("_tokens"))
    keep = F.filter(ids, lambda i: ~i.isin(*skip)) if skip else F.col(ids)
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.array_join(F.transform(keep, lambda i: F.coalesce(F.get("_tokens", i), F.lit(""))), "")).drop("_tokens")


def words(text: Column) -> Column:
    """Word tokens: runs of Latin letters or digits, and single Han characters."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[0-9]+|[\x{4e00}-\x{9fff}])"), 1)


def token_histogram(df: DataFrame, tokens: Column, top: int | None = 80) -> DataFrame:
    """(token, n, share): the commonest tokens, ties by token. Counts are combined per partition before the shuffle."""
    n = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    d = n.crossJoin(F.broadcast(total)).select("token", "n", F.round(F.col("n") / F.col("_t"), 8).alias("share"))
    return d.orderBy(F.desc("n"), F.asc("token")).limit(top) if top else d


def longest_tokens(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """(token, chars, n): the longest tokens of a corpus with their counts, ties by token."""
    d = token_histogram(df, tokens, None)
    return d.select("token", F.length("token").alias("chars"), "n").orderBy(F.desc("chars"), F.asc("token")).limit(n)


def unknown_ratio(df: DataFrame, vocab: DataFrame, tokens: Column, token: str = "token") -> DataFrame:
    """(tokens, unknown, ratio) of a corpus against a vocabulary."""
    n = df.select(F.explode(tokens).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    known = vocab.select(F.col(token).alias("_t"), F.lit(1).alias("_known")).distinct()
    j = n.join(known, n["_w"] == known["_t"], "left")
    return j.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("unknown")).withColumn("ratio", F.round(F.coalesce(F.col("unknown") / F.nullif("tokens", F.lit(0)), F.lit(0.0)), 8))


def unknown_examples(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", around: int = 30, n: int = 20) -> DataFrame:
    """The n commonest unknown characters with a piece of text around their first place."""
    p = df.select(key, text, F.posexplode(chars(F.col(text))).alias("pos", "token"))
    miss = p.join(F.broadcast(vocab.select(F.col("token").alias("_t"))), p["token"] == F.col("_t"), "left_anti")
    first = miss.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring(text, F.greatest(F.col("pos") + 1 - around // 2, F.lit(1)), F.lit(around)), F.struct(key, "pos")).alias("example"))
    return first.orderBy(F.desc("n"), F.asc("token")).limit(n)


def bigrams(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, next, n): neighbours inside documents; no document is exploded twice and no window is needed."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("token"), b.alias("next"))))
    return df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).groupBy(F.col("p.token").alias("token"), F.col("p.next").alias("next")).agg(F.count(F.lit(1)).alias("n"))


def line_tokens(df: DataFrame, key: str, text: str = "text", bos: str = "<bos>", eos: str = "<eos>") -> DataFrame:
    """(key, tokens): the word tokens of every line that is not blank between bos and eos."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(T.strip(x)) > 0)
    return df.select(key, F.flatten(F.transform(lines, lambda x: F.concat(F.array(F.lit(bos)), words(x), F.array(F.lit(eos))))).alias("tokens"))


def positions(df: DataFrame, order: str, count: str) -> DataFrame:
    """df with start: where each document's tokens begin in the stream of all documents."""
    return running_total(df, [], order, F.coalesce(F.col(count), F.lit(0)).cast("bigint"), "start")


def stream_split(df: DataFrame, order: str, count: str, val_ratio: float, least: int = 1) -> DataFrame:
    """df (with start) cut into train and val where floor(n (1 - r)) tokens, kept within [least, n - least], have passed: train_tokens, val_tokens."""
    d = positions(df, order, count)
    total = df.agg(F.sum(count).alias("_n"))
    cut = F.least(F.greatest(F.floor(F.col("_n") * (1 - val_ratio)), F.lit(least)), F.greatest(F.col("_n") - least, F.lit(0)))
    train = F.greatest(F.least(F.col(count), cut - F.col("start")), F.lit(0)).cast("bigint")
    return d.crossJoin(F.broadcast(total)).withColumn("train_tokens", train).withColumn("val_tokens", (F.col(count) - F.col("train_tokens")).cast("bigint")).drop("_n")


def small_split(length: int, val_ratio: float, least: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(train, val) ranges of a stream; a val part shorter than least is replaced by the tail of the whole stream, which then overlaps train."""
    cut = max(1, int(length * (1 - val_ratio)))
    return (0, cut), ((cut, length) if length - cut >= least else (max(0, length - least), length))


def shard_pieces(df: DataFrame, shard_tokens: int, start: str = "start", count: str = "n_tokens") -> DataFrame:
    """One row per document and shard: shard, first (offset in the document), position (offset in the shard), taken."""
    s, n = F.col(start), F.col(count)
    last = F.floor((s + n - 1) / shard_tokens)
    d = df.where(n > 0).withColumn("shard", F.explode(F.sequence(F.floor(s / shard_tokens), last)))
    lo = F.greatest(s, F.col("shard") * shard_tokens)
    hi = F.least(s + n, (F.col("shard") + 1) * shard_tokens)
    return d.withColumns({"first": (lo - s).cast("bigint"), "position": (lo - F.col("shard") * shard_tokens).cast("bigint"), "taken": (hi - lo).cast("bigint")})


def write_shards(df: DataFrame, path: str, order: str, ids: str, shard_tokens: int) -> DataFrame:
    """Writes (shard, position, ids) as Parquet, one directory a shard, pieces in order; returns (shard, tokens)."""
    d = shard_pieces(positions(df.withColumn("n_tokens", F.size(ids)), order, "n_tokens"), shard_tokens)
    out = d.select("shard", "position", F.slice(ids, F.col("first").cast("int") + 1, F.col("taken").cast("int")).alias("ids"))
    out.repartition("shard").sortWithinPartitions("shard", "position").write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("shard").agg(F.sum(F.size("ids")).alias("tokens"))


def latest_shards(shards: DataFrame) -> DataFrame:
    """One row per (split, shard_index): the last written; ties by larger tokens, then path."""
    return shards.groupBy("split", "shard_index").agg(F.max_by(F.struct("tokens", "bytes", "path", "written_at"), F.struct("written_at", "tokens", "path")).alias("x")).select("split", "shard_index", "x.*")


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards with before: tokens of the shards before it in its split."""
    return running_total(shards, ["split"], "shard_index", F.coalesce("tokens", F.lit(0)), "before")


def repair_plan(shards: DataFrame, targets: dict[str, int]) -> DataFrame:
    """action and kept_tokens of each shard: whole shards are kept up to the target, the one that crosses it is trimmed, later ones move."""
    target = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(v))))[F.col("split")]
    n = F.coalesce("tokens", F.lit(0))
    d = shard_offsets(shards)
    action = F.when(F.col("before") >= target, "move").when(F.col("before") + n <= target, "keep").otherwise("trim")
    return d.withColumn("action", action).withColumn("kept_tokens", F.when(action == "keep", n).when(action == "trim", target - F.col("before")).otherwise(0).cast("bigint"))


def block_index(shards: DataFrame, block_size: int) -> DataFrame:
    """shards with n_blocks = floor((tokens - 1) / block_size), never negative, and block_offset within the split."""
    b = shards.withColumn("n_blocks", F.greatest(F.floor((F.coalesce("tokens", F.lit(0)) - 1) / block_size), F.lit(0)))
    return running_total(b, ["split"], "shard_index", F.col("n_blocks"), "block_offset")


def locate_blocks(blocks: DataFrame, index: DataFrame, block_size: int, split: str = "split", block: str = "block_id") -> DataFrame:
    """Where each block id lies: shard_index and the token it begins with. A range join on the offsets; the index is one row a shard."""
    i = index.where("n_blocks > 0").select(F.col("split").alias("_s"), "shard_index", "block_offset", "n_blocks")
    on = (blocks[split] == F.col("_s")) & (blocks[block] >= F.col("block_offset")) & (blocks[block] < F.col("block_offset") + F.col("n_blocks"))
    # Equal buckets of block ids make the range an equi-join as well, so no side is paired with every row of the other.
    width = 256
    left = blocks.withColumn("_bucket", F.floor(F.col(block) / width))
    right = i.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("block_offset") / width), F.floor((F.col("block_offset") + F.col("n_blocks") - 1) / width))))
    on = (left[split] == right["_s"]) & (left["_bucket"] == right["_bucket"]) & (left[block] >= right["block_offset"]) & (left[block] < right["block_offset"] + right["n_blocks"])
    return left.join(right, on).withColumn("first_token", (F.col(block) - F.col("block_offset")) * block_size).drop("_s", "_bucket", "n_blocks", "block_offset")


def next_token_pairs(df: DataFrame, ids: str, block_size: int) -> DataFrame:
    """(…, block, x, y): blocks that do not overlap, y shifted by one; a rest without a next token is left out."""
    n = F.greatest(F.floor((F.size(ids) - 1) / block_size), F.lit(0)).cast("int")
    d = df.withColumn("_n", n).where("_n > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.col("block") * block_size
    return d.withColumns({"x": F.slice(ids, at + 1, F.lit(block_size)), "y": F.slice(ids, at + 2, F.lit(block_size))}).drop("_n")


def epoch_order(blocks: DataFrame, block: str, seed: int, epoch: int) -> DataFrame:
    """A repeatable permutation of one epoch: blocks with rank; a cursor is a filter on it."""
    d = blocks.withColumn("_h", T.hash60(seed, epoch, F.col(block)))
    return running_total(d, [], "_h", F.lit(1), "rank", tie=block).drop("_h")


def random_windows(df: DataFrame, ids: str, block_size: int, n: int, seed: int) -> DataFrame:
    """n windows of each row, with replacement, at hashed starts: x and y shifted by one."""
    d = df.where(F.size(ids) > block_size).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = (F.pmod(T.hash60(seed, F.col("_i"), F.array_join(ids, " ")), F.size(ids) - block_size) + 1).cast("int")
    return d.withColumn("_at", at).withColumns({"x": F.slice(ids, F.col("_at"), F.lit(block_size)), "y": F.slice(ids, F.col("_at") + 1, F.lit(block_size))}).drop("_i", "_at")


def compression(df: DataFrame, text: str, n_tokens: str) -> DataFrame:
    """Characters, tokens, characters per token."""
    return df.agg(F.sum(F.length(text)).alias("chars"), F.sum(n_tokens).alias("tokens")).withColumn("chars_per_token", F.round(F.coalesce(F.col("chars") / F.nullif("tokens", F.lit(0)), F.lit(0.0)), 6))


def train_bpe(df: DataFrame, text: str, merges: int, min_frequency: int = 2) -> DataFrame:
    """(rank, left, right, n): byte-free pair merges learned from word counts.

    The counts of the distinct words stay a distributed table. Each round sums the pairs of all words in Spark; only the best pair comes to the driver.
    """
    d = df.select(F.explode(words(F.lower(F.col(text)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_frequency) & (F.length("w") > 1))
    # Parts lie between marks that no word holds, so that a merge is one replacement, from left to right and without overlaps.
    d = materialize(d.select(F.regexp_replace("w", "(.)", f"{OPEN}$1{CLOSE}").alias("w"), "n"))
    out = []
    for rank in range(merges):
        parts = F.split(F.substring("w", F.lit(2), F.length("w") - 2), CLOSE + OPEN)
        pairs = d.select("n", parts.alias("p")).select("n", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("left"), F.slice("p", F.lit(2), F.size("p") - 1).alias("right"))).alias("x"))
        best = pairs.groupBy("x.left", "x.right").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "left", "right").first()
        if best is None or best.n < min_frequency:
            break
        out.append((rank, best.left, best.right, best.n))
        joined = F.replace("w", F.lit(f"{OPEN}{best.left}{CLOSE}{OPEN}{best.right}{CLOSE}"), F.lit(f"{OPEN}{best.left}{best.right}{CLOSE}"))
        # Words of one part have no pairs left.
        d = d.select(joined.alias("w"), "n").where(F.instr("w", CLOSE + OPEN) > 0)
        if rank % CUT_ROUNDS == CUT_ROUNDS - 1 and rank + 1 < merges:
            d = materialize(d)
    return df.sparkSession.createDataFrame(out, "rank int, left string, right string, n bigint")


#: Marks around the parts of a word in BPE training.
OPEN, CLOSE = "\x01", "\x02"
#: Rounds of BPE training after which the words as merged so far are written anew.
CUT_ROUNDS = 10


def weighted_windows(shards: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """(split, sample, shard_index, first_token, taken): n windows of each split, a shard chosen in proportion to its tokens. size within 16 to 512.

    A draw is a place in the split's stream; its shard is found by a range join on the running totals.
    """
    size = min(max(size, 16), 512)
    d = shard_offsets(shards).withColumn("_n", F.coalesce("tokens", F.lit(0))).where("_n > 0").select(F.col("split").alias("_s"), "shard_index", "before", "_n")
    total = d.groupBy("_s").agg(F.sum("_n").alias("_t"))
    draws = total.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_at", F.pmod(T.hash60(seed, F.col("_s"), F.col("sample")), F.col("_t"))).select(F.col("_s").alias("split"), "sample", "_at")
    j = draws.join(F.broadcast(d), (F.col("split") == F.col("_s")) & (F.col("_at") >= F.col("before")) & (F.col("_at") < F.col("before") + F.col("_n")))
    first = F.least(F.col("_at") - F.col("before"), F.greatest(F.col("_n") - size, F.lit(0)))
    return j.select("split", "sample", "shard_index", first.alias("first_token"), F.least(F.col("_n"), F.lit(size)).cast("bigint").alias("taken"))


def round_trips(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(texts, same): how many texts come back unchanged from encoding and decoding."""
    e = decode_chars(encode_chars(df.where(F.col(text).isNotNull()), vocab, text), vocab)
    return e.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("decoded") == F.col(text)).alias("same"))
