"""Problems 6 and 8: encoding and counting with a public byte-level BPE tokenizer.

Pre-tokenisation uses no regular expression. All texts of a batch are one array of code points; a table gives each its class (letter, number,
blank, other); the state that the pattern's automaton carries from character to character is only where the current run of one class began, and
those transition functions (set to here, or keep) compose associatively, so one running maximum over the array finds every run at once. A few
array rules then move boundaries for the blank before a run, blank runs and contractions.
Slices go to pair merging through a cache of bounded size; tokens come out as one flat array per batch with offsets.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.runtime import materialize, ship_file, shipped, table

#: Folder of the public vocabularies, and the one that the queries use.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices kept in a worker's cache; a full cache is emptied. Code points encoded at once.
CACHE_SLICES = 300_000
CHUNK_CHARS = 1_000_000
#: Slices of more bytes than this are merged with a heap instead of the library's scan.
LONG_SLICE = 400

LETTER, NUMBER, BLANK, OTHER = range(4)
#: The blanks of Unicode's White_Space property, and the contractions of the pattern.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for o in range(0x110000):
        c = unicodedata.category(chr(o))[0]
        if c == "L":
            kinds[o] = LETTER
        elif c == "N":
            kinds[o] = NUMBER
    kinds[list(WHITE_SPACE)] = BLANK
    return kinds


def boundaries(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Sorted starts of the slices of all documents. points: the code points one after another; doc_starts: where each non-empty document begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    ends_run = np.append(change[1:], True)
    ends_doc = np.append(first[1:], True)
    # The last blank of a run before a visible character stands alone or leads the next slice; the blanks before it are one slice.
    last = np.flatnonzero((kind == BLANK) & ends_run & ~ends_doc)
    start[last] = True
    leads = last[points[last] == 32]
    start[leads + 1] = False
    # Contractions: an apostrophe that is a run of its own and begins a slice.
    a = np.flatnonzero((points == 39) & start & ends_run & ~ends_doc)
    if len(a):
        # The scan: begin[i] is where the run of i began.
        begin = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        for c in CONTRACTIONS:
            m = len(c)
            at = a[a + m < n]
            ok = begin[at + m] == at + 1
            for j, ch in enumerate(c):
                ok &= points[at + 1 + j] == ord(ch)
            at = at[ok]
            start[at + 1] = False
            after = at + m + 1
            start[after[after < n]] = True
    return np.flatnonzero(start)


def merge_slice(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merging of one slice: always the adjacent pair of lowest rank, the leftmost of equals; a heap keeps long slices cheap."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        alive[j] = False
        end[i], right[i] = e, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:e])) is not None:
            heapq.heappush(heap, (r, k, e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """One vocabulary with its cache. ids of a slice are kept once in a flat store; a batch is gathered from it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int32)
        self.bytes_of = {}
        for token, r in self.ranks.items():
            self.lengths[r] = len(token)
            self.bytes_of[r] = token
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.store: list[int] = []
        self.begin: list[int] = []
        self.size: list[int] = []
        self._arrays = None

    def _add(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = merge_slice(raw, self.ranks) if len(raw) > LONG_SLICE else self.library._encode_single_piece(raw)
        k = self.slot[piece] = len(self.begin)
        self.begin.append(len(self.store))
        self.size.append(len(ids))
        self.store += ids
        return k

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each slice, number of slices of each text)."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = boundaries(points, offsets[:-1][sizes > 0])
        per_text = np.diff(np.searchsorted(starts, offsets))
        cuts = starts.tolist()
        cuts.append(len(joined))
        if len(self.slot) > CACHE_SLICES:
            self._reset()
        get, add, before = self.slot.get, self._add, len(self.begin)
        out = np.empty(len(cuts) - 1, np.int64)
        a = cuts[0]
        for i in range(1, len(cuts)):
            b = cuts[i]
            piece = joined[a:b]
            k = get(piece)
            out[i - 1] = add(piece) if k is None else k
            a = b
        if self._arrays is None or len(self.begin) > before:
            self._arrays = np.array(self.store, np.int32), np.array(self.begin, np.int64), np.array(self.size, np.int64)
        return out, per_text

    def counts(self, texts: list[str]) -> np.ndarray:
        slots, per_text = self.slots(texts)
        sums = np.concatenate([[0], np.cumsum(self._arrays[2][slots])])
        at = np.concatenate([[0], np.cumsum(per_text)])
        return sums[at[1:]] - sums[at[:-1]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, number of ids of each)."""
        slots, per_text = self.slots(texts)
        store, begin, size = self._arrays
        n = size[slots]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = store[np.repeat(begin[slots] - total[:-1], n) + np.arange(total[-1])]
        at = np.concatenate([[0], np.cumsum(per_text)])
        return flat, total[at[1:]] - total[at[:-1]]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the text that the ids decode to."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])[:-1]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(texts: list[str]):
    """Runs of whole texts of about CHUNK_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, ids) of every row, without special tokens: marker strings in a text are ordinary text. Null and empty texts give an empty list."""
    ship_file(df.sparkSession, path)
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches):
        e = encoder(shipped(path))
        for b in batches:
            # A batch of the result holds the ids of about CHUNK_CHARS characters, so that its offsets stay far from 32 bits however long the texts are.
            first = 0
            for part in chunks(b.column(1).to_pylist()):
                flat, sizes = e.encode(part)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["k", "ids"])
                first += len(part)

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str, text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""
    ship_file(df.sparkSession, path)
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches):
        e = encoder(shipped(path))
        for b in batches:
            n = [np.zeros(0, np.int64), *map(e.counts, chunks(b.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n))], ["k", "n_tokens"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, text, offsets): the text of the ids and where each token begins in its bytes. A null list gives null."""
    ship_file(df.sparkSession, path)
    src = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))

    def run(batches):
        e = encoder(shipped(path))
        for b in batches:
            lists = b.column(1).to_pylist()
            texts = [None if x is None else e.decode(x) for x in lists]
            offsets = [None if x is None else e.offsets(np.array(x, np.int64)).tolist() for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(offsets, pa.list_(pa.int64()))], ["k", "text", "offsets"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string, offsets array<bigint>").withColumnRenamed("k", key)


#: The ways in which the language is written in metadata.
LANGUAGE_NAMES = {
    "zh": ("zh", "zh-cn", "zh-hans", "zh-hant", "zh-tw", "zho", "chi", "cmn", "chinese", "中文", "汉语", "简体中文"),
    "en": ("en", "eng", "en-us", "en-gb", "english", "英文", "英语"),
    "fr": ("fr", "fra", "fre", "fr-fr", "french", "français", "法语"),
    "de": ("de", "deu", "ger", "de-de", "german", "deutsch", "德语"),
}


def language(metadata: Column, text: Column) -> Column:
    """The language in metadata where it is known by some name, else by script: zh where Han characters make a tenth of the letters, en for other
    Latin text, und for the rest."""
    lang = F.lower(F.trim(metadata["lang"]))
    known = F.lit(None)
    for code, names in LANGUAGE_NAMES.items():
        known = F.when(lang.isin(*names), code).otherwise(known)
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    return F.coalesce(known, F.when(han * 9 > latin, "zh").when(latin > 0, "en").otherwise("und"))


def token_budget(df: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(source_name, language, domain, documents, distinct_documents, tokens, distinct_tokens) of adapted_document's columns.

    Whole texts are hashed and counted by (hash, source, language, domain) before anything else moves; each distinct text is tokenized once and its
    count joined back by hash. Null source_name or source_type form groups of their own; null and empty texts count with 0 tokens.
    distinct_documents and distinct_tokens count a text once in each group.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select("source_name", language(F.col("metadata"), F.col("text")).alias("language"), F.col("source_type").alias("domain"), t.alias("t"), F.unhex(F.md5(t)).alias("h"))
    groups = rows.groupBy("h", "source_name", "language", "domain").agg(F.count(F.lit(1)).alias("copies"))
    texts = rows.groupBy("h").agg(F.first("t").alias("text"))
    sizes = materialize(token_counts(texts, "h", path=path))
    j = groups.join(sizes, "h")
    return j.groupBy("source_name", "language", "domain").agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("distinct_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("n_tokens").alias("distinct_tokens"))


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "adapted_document"))


def p6_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of the budget with their documents, without tokens."""
    return p6_tokens(spark, sf_dir).select("source_name", "language", "domain", "documents", "distinct_documents")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of each document decode to, as a hash."""
    return decode(p8_ids(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.size("offsets").alias("n"), F.length("text").cast("bigint").alias("chars")).drop("n")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p6_tokens": p6_tokens, "p6_slices": p6_slices, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip}

_KNOWN = " ".join(f"when lg in ({', '.join(repr(n) for n in names)}) then '{code}'" for code, names in LANGUAGE_NAMES.items())
SQL = {
    "p6_slices": rf"""
        with d as (select source_name, source_type as domain, text, coalesce(text, '') as t, lower(trim(metadata['lang'])) as lg from adapted_document),
        n as (select *, len(regexp_extract_all(text, '\p{{Han}}')) as han, len(regexp_extract_all(text, '\p{{Latin}}')) as latin from d)
        select source_name, case {_KNOWN} when han * 9 > latin then 'zh' when latin > 0 then 'en' else 'und' end as language, domain, count(*) as documents, count(distinct md5(t)) as distinct_documents from n group by 1, 2, 3""",
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) as h, length(coalesce(text, '')) as chars from documents",
}
