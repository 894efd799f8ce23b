"""Problem 7: lines repeated across the documents of one source, kept as incremental count tables.

A line's key is its form (see forms) without digits and blanks, hashed to 128 bits. Per source a table holds in how many rows each key stands.
New rows come as a delta: their lines are counted alone, merged into the table, and only where a key's count crosses the threshold by this delta are
earlier documents looked up and rebuilt. The tables lie in a folder, so a later session goes on where an earlier one stopped.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import shapes
from textlake.llm.forms import digest, former
from textlake.runtime import materialize, shared_dir, table

#: A line is repeated once it stands in so many rows of its source.
THRESHOLD = 10
#: Repeated keys are broadcast up to this number (24 bytes each); beyond it they are joined by shuffle, each key dealt to SALTS tasks.
BROADCAST_KEYS = 500_000
SALTS = 16
#: Blanks, and digits of any kind, raised and circled ones too.
DIGITS_BLANKS = re.compile(r"[^\S\n]+|[\d\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089\u2460-\u2473]+")
ALNUM = re.compile(r"[^\W_]")
ROWS = "row_id bigint, source_name string, late boolean, keys array<binary>, chars array<int>, spam array<int>, shapes array<bigint>"


def line_keys(form: str) -> list[bytes | None]:
    """One key for each line of a form; None for lines without a letter or digit."""
    bare = DIGITS_BLANKS.sub("", form).split("\n")
    out: list[bytes | None] = []
    lines = None
    for i, k in enumerate(bare):
        if not ALNUM.search(k):
            lines = form.split("\n") if lines is None else lines
            if not ALNUM.search(lines[i]):
                out.append(None)
                continue
        out.append(digest(k))
    return out


def profile_lines(df: DataFrame, key: str = "row_id", source: str = "source_name", text: str = "text", late=None, with_shapes: bool = False) -> DataFrame:
    """One narrow row per text: for each line its key, and with_shapes its characters without blanks, how many of them stand in keyword or link
    shapes, and the code of its shape (otherwise all are 0). late: a condition that is kept with the row.

    Null texts and null keys give no row; an empty text gives one line without a key.
    """
    make = former(df.sparkSession)
    late = F.lit(False) if late is None else F.coalesce(late, F.lit(False))
    src = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(source).cast("string").alias("source_name"), late.alias("late"), F.col(text).cast("string").alias("t")).where("row_id is not null and t is not null")

    def run(batches):
        forms = make()
        for b in batches:
            keys, chars, spam, codes, at = [], [], [], [], [0]
            for form in forms(b.column(3).to_pylist()):
                keys += line_keys(form)
                at.append(len(keys))
                if with_shapes:
                    measured = [shapes.measure(line) for line in form.split("\n")]
                    for (shape, _, _), (kind, n, x) in zip(measured, shapes.page([shapes.judged(m) for m in measured])):
                        chars.append(n)
                        spam.append(x if kind in shapes.SPAM or kind == shapes.SENTENCE else 0)
                        codes.append(shapes.shape_code(shape))
            if not with_shapes:
                chars = spam = codes = [0] * len(keys)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in ((keys, pa.binary()), (chars, pa.int32()), (spam, pa.int32()), (codes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], ["row_id", "source_name", "late", "keys", "chars", "spam", "shapes"])

    return src.mapInArrow(run, ROWS)


def count_lines(rows: DataFrame) -> DataFrame:
    """(source_name, key, n_rows): in how many rows of each named source a key stands. A key counts once a row; partial counts come before the shuffle."""
    return rows.where("source_name is not null").select("source_name", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key")).groupBy("source_name", "key").agg(F.count(F.lit(1)).alias("n_rows"))


def merge_counts(state: DataFrame, delta: DataFrame) -> DataFrame:
    """(source_name, key, before, n_rows) of every key of either table."""
    d = delta.withColumnRenamed("n_rows", "added")
    return state.join(d, ["source_name", "key"], "full_outer").select("source_name", "key", F.coalesce("n_rows", F.lit(0)).alias("before"), (F.coalesce("n_rows", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("n_rows"))


def places(rows: DataFrame, repeated: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(row_id, line_no, chars, spam, shape) of every line of rows whose key is in repeated.

    The keys are counted first. Up to broadcast_keys of them go to every task and no line moves; more are joined by shuffle, and a key that stands
    in a third of all rows is dealt to SALTS tasks by row.
    """
    lines = rows.where("source_name is not null").select("row_id", "source_name", F.posexplode(F.arrays_zip("keys", "chars", "spam", "shapes")).alias("line_no", "x")).select("row_id", "source_name", "line_no", F.col("x.keys").alias("key"), F.col("x.chars").alias("chars"), F.col("x.spam").alias("spam"), F.col("x.shapes").alias("shape")).where("key is not null")
    keys = repeated.select("source_name", "key")
    if keys.count() <= broadcast_keys:
        found = lines.join(F.broadcast(keys), ["source_name", "key"])
    else:
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
        found = salted.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source_name", "key", "salt"])
    return found.select("row_id", "line_no", "chars", "spam", "shape")


class SiteLines:
    """The count tables of a corpus that grows by deltas, in a folder that all executors share.

    ingest() returns the places that a delta made known, in old rows as well as in its own. Each delta writes its profile and the merged counts as
    new tables, then a record that names them; a delta that breaks off leaves no record and so no trace, and an object opened on the folder later
    goes on from the last record.
    """

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, folder: str | None = None):
        self.spark, self.threshold = spark, threshold
        self.folder = (folder or f"{shared_dir(spark)}/sitelines-{uuid.uuid4().hex}").rstrip("/")
        self.deltas = self._recorded() if folder else 0

    def _recorded(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/records/*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(f.getPath().getName()) for f in found or []), default=0)

    def _rows(self, n: int) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows/{n}")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("source_name string, key binary, before bigint, n_rows bigint").parquet(f"{self.folder}/counts/{self.deltas}")

    def repeated(self) -> DataFrame:
        """(source_name, key) of all lines that are repeated by now."""
        return self.counts.where(F.col("n_rows") >= self.threshold).select("source_name", "key")

    def ingest(self, rows: DataFrame, keep: bool = True) -> DataFrame:
        """rows: profile_lines() of the new documents. Their row ids must be new: a row given twice counts twice. keep: whether a later delta may
        cross a threshold in these rows; they are then written beside the counts."""
        n = self.deltas + 1
        if keep:
            rows.write.mode("overwrite").parquet(f"{self.folder}/rows/{n}")
            rows = self._rows(n)
        delta = count_lines(rows)
        merged = merge_counts(self.counts, delta) if self.deltas else delta.select("source_name", "key", F.lit(0).cast("bigint").alias("before"), "n_rows")
        merged.write.mode("overwrite").parquet(f"{self.folder}/counts/{n}")
        earlier = range(1, n)
        self.deltas = n
        found = places(rows, self.repeated())
        crossed = self.counts.where((F.col("n_rows") >= self.threshold) & (F.col("before") < self.threshold) & (F.col("before") > 0))
        if earlier and not crossed.isEmpty():
            for old in earlier:
                found = found.unionByName(places(self._rows(old), crossed))
        if keep:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/records/{n}")
        return found


def strip_lines(df: DataFrame, found: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """df with the found lines cut out of its text; rows without finds pass unchanged. The lists of line numbers join the text by key: where they are
    too many to broadcast, the texts move."""
    cut = found.groupBy(F.col("row_id").alias(key)).agg(F.collect_set("line_no").alias("_cut"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: F.coalesce(~F.array_contains("_cut", i), F.lit(True))), "\n")
    return df.join(cut, key, "left").withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept)).drop("_cut")


def strip_repeated(df: DataFrame, repeated: DataFrame, broadcast_keys: int = BROADCAST_KEYS, source: str = "source_name", text: str = "text") -> DataFrame | None:
    """df without the lines whose key its source repeats, in one pass over the texts, which do not move; None where the repeated keys are more than
    broadcast_keys, so that strip_lines() has to be taken."""
    keys = repeated.select("source_name", "key").limit(broadcast_keys + 1).collect()
    if len(keys) > broadcast_keys:
        return None
    by_source: dict[str, set[bytes]] = {}
    for r in keys:
        by_source.setdefault(r.source_name, set()).add(bytes(r.key))
    known = df.sparkSession.sparkContext.broadcast(by_source)
    make = former(df.sparkSession)

    @F.arrow_udf("string")
    def strip(name: pa.Array, x: pa.Array) -> pa.Array:
        forms, out = make(), x.to_pylist()
        of = [known.value.get(n) for n in name.to_pylist()]
        some = [i for i, (t, k) in enumerate(zip(out, of)) if t and k]
        for i, form in zip(some, forms([out[i] for i in some])):
            cut = [k in of[i] for k in line_keys(form)]
            if any(cut):
                out[i] = "\n".join(line for line, c in zip(out[i].split("\n"), cut) if not c)
        return pa.array(out, pa.string())

    return df.withColumn(text, strip(F.col(source).cast("string"), F.col(text).cast("string")))


def site_lines(spark: SparkSession, sf_dir: str, with_shapes: bool = False) -> tuple[DataFrame, DataFrame, SiteLines]:
    """(rows, places, state) of adapted_document, taken in as two deltas: the rows that came in time, then the late ones. Texts are read once."""
    docs = table(spark, sf_dir, "adapted_document")
    rows = materialize(profile_lines(docs, late=F.col("ingested_at") > F.col("fetched_at") + F.expr("interval 1 day"), with_shapes=with_shapes))
    site = SiteLines(spark)
    # The deltas are parts of one profile that is a table already, so they are not written again.
    first = site.ingest(rows.where("not late"), keep=False)
    site._rows = lambda n: rows.where("not late")
    return rows, first.unionByName(site.ingest(rows.where("late"), keep=False)), site


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a repeated line. A row_id that is stored twice gives its places once."""
    return site_lines(spark, sf_dir)[1].select("row_id", "line_no").distinct()


def p7_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the lines its site repeats."""
    _, found, site = site_lines(spark, sf_dir)
    docs = table(spark, sf_dir, "adapted_document").select("row_id", "source_name", "text")
    out = strip_repeated(docs, site.repeated())
    return strip_lines(docs, found) if out is None else out


QUERIES = {"p7_found": p7_found, "p7_stripped": p7_stripped}
