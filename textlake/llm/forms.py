"""Problem 5: one consistent form for texts that look the same.

The form is a confusables skeleton: canonical decomposition, replacement of every character by its prototype, decomposition again.
Prototypes come from the Unicode confusables data inside the ICU library that ships with Spark, read once on the driver; the table has a few
thousand entries whatever the corpus, so it travels with the function.
Some replacements of that data are left out, because here they are visible differences: letter case and digits against letters
(I, l, 1 / O, 0), accents, raised or circled digits, digits of other scripts, and the marks, kana, ideographs and
syllables of East Asian scripts against each other.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.runtime import materialize, table

#: Compatibility decompositions that only change width, font or breaking; the rest is left to the confusables data.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>")
VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Rows of one text that meet the rows of another in one task, about.
BLOCK_ROWS = 10_000


def _ignorable(c: str) -> bool:
    o = ord(c)
    return (
        unicodedata.category(c) == "Cf"
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
        or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
    )


def _unified(o: int) -> bool:
    return 0x3001 <= o <= 0x30FF or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0x20000 <= o <= 0x2A6DF or 0xAC00 <= o <= 0xD7A3


def build_prototypes(skeletons: dict[str, str]) -> dict[int, str | None]:
    """Character to prototype, given the plain confusables skeleton of each character."""
    ascii_of: dict[str, list[str]] = {}
    for o in range(33, 127):
        ascii_of.setdefault(skeletons.get(chr(o), chr(o)), []).append(chr(o))
    out: dict[int, str | None] = {}
    for c, sk in skeletons.items():
        o, cat = ord(c), unicodedata.category(c)
        if o < 128:
            continue
        if _ignorable(c):
            out[o] = None
            continue
        if cat == "Zs":
            out[o] = " "
            continue
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if cat[0] == "M" or _unified(o) or tag in VISIBLE_TAGS or cat == "No":
            continue
        compat = unicodedata.normalize("NFKC", c)
        if tag in SAME_LOOK_TAGS:
            out[o] = skeletons.get(compat, compat) if len(compat) == 1 and ord(compat) > 127 and not _unified(ord(compat)) else compat
            continue
        if len(compat) == 1 and compat != c and _unified(ord(compat)):
            out[o] = compat
            continue
        if cat == "Nd" or sk == c:
            continue
        if compat != c and compat.isascii() and compat.strip():
            out[o] = compat
        elif near := ascii_of.get(sk):
            kind = [a for a in near if (a.isupper() if cat == "Lu" else a.islower() if cat[0] == "L" else not a.isalnum())]
            out[o] = (kind or near)[0]
        else:
            out[o] = sk
    for c in "\t\x0b\x0c":
        out[ord(c)] = " "
    out[ord("\r")] = None
    return out


@lru_cache(maxsize=4)
def prototypes(spark: SparkSession) -> dict[int, str | None]:
    """Reads the confusables data through the JVM in one call."""
    chars = [
        chr(o)
        for a, b in ((33, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x10000), (0x10000, 0x18000), (0x1B000, 0x20000), (0x2F800, 0x2FA20), (0xE0100, 0xE01F0))
        for o in range(a, b)
        if unicodedata.category(chr(o)) not in ("Cn", "Cc", "Co", "Cs", "Zl", "Zp")
    ]
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    plain = checker.getSkeleton("\n".join(chars)).split("\n")
    assert len(plain) == len(chars), "the confusables data changed a line feed"
    return build_prototypes(dict(zip(chars, plain)))


def skeleton(text: str, table: dict[int, str | None]) -> str:
    """The form. Blanks keep their number; a line end is a line feed whatever it was written as."""
    if text.isascii():
        return text.translate(table) if any(c in text for c in "\r\t\x0b\x0c") else text
    t = unicodedata.normalize("NFD", text).translate(table)
    return t if t.isascii() else unicodedata.normalize("NFD", t)


def composed(text: str, table: dict[int, str | None]) -> str:
    """The skeleton with letters and their marks composed, for code that looks at words."""
    s = skeleton(text, table)
    return s if s.isascii() else unicodedata.normalize("NFC", s)


#: Marks in the tables of single(): the character goes away; what becomes of it depends on its neighbours or is more than one character.
GONE, OPEN = 0xFFFFFFFE, 0xFFFFFFFF
#: Code points that are looked up at once.
CHUNK_CHARS = 1_000_000


@lru_cache(1)
def entangled() -> frozenset[int]:
    """Characters that may join or change places with a neighbour in a normal form: marks, second parts of composed characters, and Hangul parts."""
    out = set(range(0x1100, 0x1200))
    for o in range(0x80, 0x32000):
        c = chr(o)
        d = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            out.add(o)
        elif d and d[0] != "<":
            parts = [int(x, 16) for x in d.split()]
            out.update(parts[1:])
            out.update(ord(x) for x in unicodedata.normalize("NFD", c)[1:])
    return frozenset(out)


def single(table: dict[int, str | None], whole) -> tuple[np.ndarray, np.ndarray]:
    """(code points, what each becomes): only those that whole() changes or that need their neighbours. whole is skeleton or composed."""
    loose = entangled()
    codes = set(table) | loose | {o for o in range(0x80, 0x32000) if (d := unicodedata.decomposition(chr(o))) and d[0] != "<"} | set(range(0xAC00, 0xD7A4))
    at, to = [], []
    for o in sorted(codes):
        if 0xD800 <= o < 0xE000:
            continue
        r = whole(chr(o), table)
        if o in loose or len(r) > 1 or r and ord(r) in loose:
            v = OPEN
        else:
            v = ord(r) if r else GONE
        if v != o:
            at.append(o)
            to.append(v)
    return np.array(at, np.uint32), np.array(to, np.uint32)


class Former:
    """skeleton() or composed() of many texts at once: one array look-up for all characters that become one or none whatever stands beside them;
    texts with any other character take the function itself."""

    def __init__(self, table: dict[int, str | None], singles: tuple[np.ndarray, np.ndarray], whole):
        self.table, self.whole = table, whole
        self.to = np.arange(0x110000, dtype=np.uint32)
        self.to[singles[0]] = singles[1]

    def some(self, texts: list[str]) -> list[str]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        new = self.to[points]
        slow = np.flatnonzero(new == OPEN)
        keep = new != GONE
        after = np.concatenate([[0], np.cumsum(keep)])
        new[slow] = 63
        form = new[keep].tobytes().decode("utf-32-le", "surrogatepass")
        cuts = after[np.concatenate([[0], ends])].tolist()
        out = [form[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.unique(np.searchsorted(ends, slow, "right")).tolist():
            out[i] = self.whole(texts[i], self.table)
        return out

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        out: list[str | None] = [None] * len(texts)
        part: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t is None:
                continue
            part.append(i)
            size += len(t)
            if size >= CHUNK_CHARS:
                for j, f in zip(part, self.some([texts[j] for j in part])):
                    out[j] = f
                part, size = [], 0
        for j, f in zip(part, self.some([texts[j] for j in part]) if part else ()):
            out[j] = f
        return out


@lru_cache(maxsize=4)
def _singles(spark: SparkSession, whole) -> tuple[np.ndarray, np.ndarray]:
    return single(prototypes(spark), whole)


def former(spark: SparkSession, whole=None):
    """A function without arguments that makes the Former of skeleton or composed on a worker; what it carries is a few hundred kilobytes."""
    whole = whole or composed
    table, singles = prototypes(spark), _singles(spark, whole)
    return lambda: Former(table, singles, whole)


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def normalise_forms(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """df with the form of its text in one more column; null stays null. A column named like out is replaced."""
    make = former(df.sparkSession)

    @F.arrow_udf("string")
    def form(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forms = make()
        for a in x:
            yield pa.array(forms(a.to_pylist()), pa.string())

    return df.withColumn(out, form(F.col(text)))


def form_keys(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, form_hash, text_hash) of every row whose form holds a visible character: 128-bit hashes, so texts are never shuffled.

    Null, empty and blank texts, and those of invisible characters only, have no look and so no row.
    """
    make = former(df.sparkSession, skeleton)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t <> ''")
    kind = src.schema["k"].dataType.simpleString()

    def run(batches):
        skeletons = make()
        for b in batches:
            ids, forms, raws = [], [], []
            texts = b.column(1).to_pylist()
            for k, t, s in zip(b.column(0).to_pylist(), texts, skeletons(texts)):
                if s and not s.isspace():
                    ids.append(k)
                    forms.append(digest(s))
                    raws.append(digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], ["k", "form_hash", "text_hash"])

    return src.mapInArrow(run, f"k {kind}, form_hash binary, text_hash binary").withColumnRenamed("k", key)


def lookalike_texts(keys: DataFrame, key: str = "row_id") -> DataFrame:
    """(form_hash, text_hash, class_id, n_texts, copies): the distinct texts of the forms that have more than one, with the smallest key of the form.

    Copies are counted before the shuffle, so a text that a third of all rows share is one row here.
    """
    texts = keys.groupBy("form_hash", "text_hash").agg(F.min(key).alias("lo"), F.count(F.lit(1)).alias("copies"))
    forms = texts.groupBy("form_hash").agg(F.min("lo").alias("class_id"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    return texts.join(forms, "form_hash").select("form_hash", "text_hash", "class_id", "n_texts", "copies")


def lookalike_classes(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row per row that has a look-alike: (key, class_id, n_texts, links), class_id the smallest key of the rows of one form, links the number
    of rows that look the same and are unequal as stored. This is the form of the result for corpora in which pairs of rows are too many.

    Copies of one text do not make a class. Null, empty and blank texts have none; repeated keys are treated as rows of their own.
    """
    keys = materialize(form_keys(df, key, text))
    texts = materialize(lookalike_texts(keys, key))
    rows = texts.groupBy("form_hash").agg(F.sum("copies").alias("rows"))
    return keys.join(texts, ["form_hash", "text_hash"]).join(rows, "form_hash").select(key, "class_id", "n_texts", (F.col("rows") - F.col("copies")).alias("links"))


def lookalike_pairs(df: DataFrame, key: str = "row_id", text: str = "text", block: int = BLOCK_ROWS) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all rows that look the same and are unequal as stored.

    Distinct texts of a form are paired first, copies never meet each other. The members of a text are dealt to blocks of about `block` rows by a
    hash, and each pair of blocks of two paired texts is a cell of its own: a text with a third of all rows becomes many cells of bounded size, and
    a row moves once for each cell, of which each gives pairs of it.
    """
    keys = materialize(form_keys(df, key, text))
    texts = lookalike_texts(keys, key).select("form_hash", "text_hash", F.ceil(F.col("copies") / block).cast("int").alias("blocks"))
    texts = materialize(texts)
    a = texts.select("form_hash", F.col("text_hash").alias("ta"), F.col("blocks").alias("na"))
    b = texts.select("form_hash", F.col("text_hash").alias("tb"), F.col("blocks").alias("nb"))
    cells = a.join(b, "form_hash").where("ta < tb").withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = keys.join(texts, ["form_hash", "text_hash"]).select(F.col(key).alias("k"), "text_hash", F.pmod(F.xxhash64(F.col(key)), F.col("blocks")).cast("int").alias("block"))
    left = cells.join(rows, (cells.ta == rows.text_hash) & (cells.ba == rows.block)).select("ta", "tb", "ba", "bb", F.col("k").alias("x"))
    right = cells.join(rows, (cells.tb == rows.text_hash) & (cells.bb == rows.block)).select("ta", "tb", "ba", "bb", F.col("k").alias("y"))
    return left.join(right, ["ta", "tb", "ba", "bb"]).where("x <> y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same and are unequal as stored. A row_id that is stored twice gives its pairs once."""
    return lookalike_pairs(table(spark, sf_dir, "adapted_document")).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a look-alike with its class and number of links."""
    return lookalike_classes(table(spark, sf_dir, "adapted_document"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its text in the one form."""
    return normalise_forms(table(spark, sf_dir, "adapted_document").select("row_id", "text")).select("row_id", "form")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_forms": p5_forms}
