"""Byte-level BPE: training over distributed word counts, encoding, decoding, token previews, streams with separators.

Tokens are byte strings, written in hexadecimal while they are in Spark. Ids are the specials in their order, then the 256 bytes in the order of
their printable stand-ins, then the merges in theirs; so every text can be encoded and no id is unknown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.runtime import materialize

#: The special tokens, and the pattern by which a text is cut before pairs are merged.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\x{85}\x{a0}\p{Z}\p{L}\p{N}]+|[\s\x{85}\x{a0}\p{Z}]+(?![^\s\x{85}\x{a0}\p{Z}])|[\s\x{85}\x{a0}\p{Z}]+"
#: Marks around the parts of a word; rounds after which the words as merged so far are written anew.
OPEN, CLOSE = "\x01", "\x02"
CUT_ROUNDS = 10


def byte_order() -> list[int]:
    """The bytes in the order of their stand-ins: printable Latin-1 characters stand for themselves, the others for characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return plain + [b for b in range(256) if b not in set(plain)]


def pieces(text: Column) -> Column:
    """The slices of a text, within which pairs are merged; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


@dataclass(frozen=True)
class Vocabulary:
    """Specials and merges. Both are of the size that was asked for, whatever the corpus."""

    merges: tuple[tuple[bytes, bytes], ...]
    specials: tuple[str, ...] = SPECIALS

    def tokens(self) -> list[bytes]:
        return [*(s.encode() for s in self.specials), *(bytes([b]) for b in byte_order()), *(a + b for a, b in self.merges)]

    def ids(self) -> dict[bytes, int]:
        n = len(self.specials)
        return {t: i for i, t in enumerate(self.tokens()) if i >= n}


def train(df: DataFrame, text: str, vocab_size: int, specials: tuple[str, ...] = SPECIALS, min_frequency: int = 2) -> Vocabulary:
    """Merges learned from all slices of all texts, in normal form KC; ties go to the pair of the smaller ids. Null and empty texts count for nothing.

    The counts of the distinct slices stay a distributed table. Each round sums the pairs of all slices in Spark; only the best pair comes to the driver.
    """
    spark = df.sparkSession
    d = df.select(F.explode(pieces(T.nfkc(F.col(text)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    d = materialize(d.select(F.regexp_replace(F.hex(F.encode("w", "UTF-8")), "(..)", f"{OPEN}$1{CLOSE}").alias("w"), "n").where(F.instr("w", CLOSE + OPEN) > 0))
    merges: list[tuple[bytes, bytes]] = []
    ids = {k.hex().upper(): i for k, i in Vocabulary((), specials).ids().items()}
    for rank in range(max(0, vocab_size - len(specials) - 256)):
        parts = F.split(F.substring("w", F.lit(2), F.length("w") - 2), CLOSE + OPEN)
        pairs = d.select("n", parts.alias("p")).select("n", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("left"), F.slice("p", F.lit(2), F.size("p") - 1).alias("right"))).alias("x"))
        counts = pairs.groupBy("x.left", "x.right").agg(F.sum("n").alias("n"))
        names = spark.createDataFrame(list(ids.items()), "token string, id int")
        a, b = names.select(F.col("token").alias("left"), F.col("id").alias("a")), names.select(F.col("token").alias("right"), F.col("id").alias("b"))
        best = counts.join(F.broadcast(a), "left").join(F.broadcast(b), "right").orderBy(F.desc("n"), "a", "b").first()
        if best is None or best.n < min_frequency:
            break
        merges.append((bytes.fromhex(best.left), bytes.fromhex(best.right)))
        ids.setdefault(best.left + best.right, len(specials) + 256 + rank)
        joined = F.replace("w", F.lit(f"{OPEN}{best.left}{CLOSE}{OPEN}{best.right}{CLOSE}"), F.lit(f"{OPEN}{best.left}{best.right}{CLOSE}"))
        d = d.select(joined.alias("w"), "n").where(F.instr("w", CLOSE + OPEN) > 0)
        if rank % CUT_ROUNDS == CUT_ROUNDS - 1:
            d = materialize(d)
    return Vocabulary(tuple(merges), specials)


class Encoder:
    """Pair merging of slices with a cache that is emptied when it is full."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 200_000):
        self.ids, self.rank = vocabulary.ids(), {p: i for i, p in reversed(list(enumerate(vocabulary.merges)))}
        self.known: dict[str, list[int]] = {}
        self.cache = cache

    def __call__(self, piece: str) -> list[int]:
        if (out := self.known.get(piece)) is None:
            parts = [bytes([b]) for b in piece.encode("utf-8", "surrogatepass")]
            while len(parts) > 1:
                best = min((self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])))
                if best == 1 << 60:
                    break
                merged, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and self.rank.get((parts[i], parts[i + 1])) == best:
                        merged.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        merged.append(parts[i])
                        i += 1
                parts = merged
            if len(self.known) >= self.cache:
                self.known.clear()
            out = self.known[piece] = [self.ids[p] for p in parts]
        return out


@lru_cache(4)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", separator: str | None = None) -> DataFrame:
    """df with the ids of its text; with separator the id of that special follows the text, so that encoded texts can stand one behind the other in a
    stream. A null text gives null, an empty one nothing but the separator. Slices are cut in the JVM."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        e = _encoder(vocabulary)
        return pa.array([None if p is None else [i for w in p for i in e(w)] for p in x.to_pylist()], pa.list_(pa.int32()))

    ids = run(pieces(F.col(text)))
    return df.withColumn(out, F.concat(ids, F.array(F.lit(vocabulary.specials.index(separator)))) if separator else ids)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids without specials; bytes that are no whole character become U+FFFD, ids that are not there nothing."""
    n = len(vocabulary.specials)

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        tokens = vocabulary.tokens()
        return pa.array([None if v is None else b"".join(tokens[i] for i in v if n <= i < len(tokens)).decode("utf-8", "replace") for v in x.to_pylist()], pa.string())

    return df.withColumn(out, run(F.col(ids)))


#: Kinds of tokens in a preview, by what they hold: the first that fits.
KINDS = (("blank", re.compile(r"\s+")), ("number", re.compile(r"\s?\d+")), ("han", re.compile("\\s?[\u3400-\u9fff]+")), ("word", re.compile(r"\s?[^\W\d_]+")), ("mark", re.compile(r"\s?[^\w\s]+")))


def preview(df: DataFrame, vocabulary: Vocabulary, key: str, ids: str = "ids") -> DataFrame:
    """(key, position, id, token, start, end, kind) of every token: its text, where its bytes begin and end in the text, and whether it is special,
    bytes of a part of a character, blank, number, han, word, mark or mixed."""
    tokens, n = vocabulary.tokens(), len(vocabulary.specials)
    rows = []
    for i, t in enumerate(tokens):
        shown = t.decode("utf-8", "replace")
        kind = "special" if i < n else "bytes" if "\ufffd" in shown else next((k for k, p in KINDS if p.fullmatch(shown)), "mixed")
        rows.append((i, shown, 0 if i < n else len(t), kind))
    table = df.sparkSession.createDataFrame(rows, "id int, token string, _n int, kind string")

    @F.arrow_udf("array<int>")
    def ends(x: pa.Array) -> pa.Array:
        sizes = np.array([r[2] for r in rows])
        return pa.array([None if v is None else sizes[v].cumsum().tolist() for v in x.to_pylist()], pa.list_(pa.int32()))

    e = df.where(F.size(ids) > 0).select(key, F.posexplode(F.arrays_zip(F.col(ids).alias("id"), ends(F.col(ids)).alias("end"))).alias("position", "x")).select(key, "position", F.col("x.id").alias("id"), F.col("x.end").alias("end"))
    return e.join(F.broadcast(table), "id").select(key, "position", "id", "token", (F.col("end") - F.col("_n")).alias("start"), "end", "kind")
