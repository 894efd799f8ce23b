"""Problem 1: pages of keywords, tags or links instead of writing.

Every line is reduced to a shape (see shapes); lines of the site itself (see sitelines) are set aside; the other lines of a page are grouped by shape,
and a page of which a few keyword, tag, menu or link shapes hold more than half of the characters is flagged. Only counts travel, never text.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import shapes
from textlake.llm.forms import former
from textlake.llm.sitelines import site_lines
from textlake.runtime import table

#: Share of the characters beyond which a page is spam.
SPAM_SHARE = 0.5
#: Shapes that may dominate a page together; a page of more different lines is a mixture. On sf0.1 no page of keywords or links needs more than three.
FEW_SHAPES = 4


def spam_pages(rows: DataFrame, site_lines: DataFrame, share: float = SPAM_SHARE, few: int = FEW_SHAPES) -> DataFrame:
    """(row_id, chars, spam_chars, shapes, is_spam) of each row: its characters outside site lines, how many of them stand in the `few` commonest
    non-sentence shapes of the page, and those shapes, the commonest first.

    Lines are grouped by (row, shape); site lines are taken away as negative counts of the same groups. Rows of a shape are few and narrow, and
    both groupings share one shuffle by row. Texts without a character outside site lines are no spam.
    """
    every = F.array(F.struct(F.lit(-1).cast("bigint").alias("shape"), F.expr("aggregate(chars, 0L, (a, x) -> a + x)").alias("n")))
    spam = F.transform(F.filter(F.arrays_zip("shapes", "spam"), lambda x: x.spam > 0), lambda x: F.struct(x.shapes.alias("shape"), x.spam.cast("bigint").alias("n")))
    total = rows.select("row_id", F.explode(F.concat(every, spam)).alias("x")).select("row_id", "x.shape", "x.n")
    less = F.array(F.struct(F.lit(-1).cast("bigint").alias("shape"), (-F.col("chars")).cast("bigint").alias("n")), F.struct("shape", (-F.col("spam")).cast("bigint").alias("n")))
    site = site_lines.select("row_id", F.explode(less).alias("x")).select("row_id", "x.shape", "x.n").where("n < 0")
    groups = total.unionByName(site).repartition("row_id").groupBy("row_id", "shape").agg(F.sum("n").alias("n"))
    # A page holds at most as many shapes as there are; their counts are sorted in one small array.
    spam_groups = F.array_sort(F.collect_list(F.when((F.col("shape") >= 0) & (F.col("n") > 0), F.struct((-F.col("n")).alias("n"), "shape"))))
    t = groups.groupBy("row_id").agg(F.sum(F.when(F.col("shape") < 0, F.col("n")).otherwise(0)).alias("chars"), F.slice(spam_groups, 1, few).alias("_top"))
    t = t.select("row_id", "chars", F.expr("aggregate(_top, 0L, (a, x) -> a - x.n)").alias("spam_chars"), F.transform("_top", lambda x: x["shape"]).alias("shapes"))
    return t.withColumn("is_spam", (F.col("chars") > 0) & (F.col("spam_chars") > share * F.col("chars")))


def shape_report(df: DataFrame, text: str = "text") -> DataFrame:
    """(shape, kind, lines, chars, pages) of every shape of the corpus, shape as 'name=class' of its numbers that are not 0. Counts are combined per
    batch before the shuffle."""
    make = former(df.sparkSession)

    def run(batches):
        forms = make()
        for b in batches:
            lines, chars, pages = Counter(), Counter(), Counter()
            for form in forms(b.column(0).to_pylist()):
                codes = set()
                for line in form.split("\n"):
                    shape, n, _ = shapes.measure(line)
                    if n:
                        codes.add(shape)
                        lines[shape] += 1
                        chars[shape] += n
                pages.update(codes)
            names = [" ".join(f"{k}={v}" for k, v in s._asdict().items() if v) for s in lines]
            kinds = [shapes.KIND_NAMES[shapes.kind_of(s)] for s in lines]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string()), *(pa.array([c[s] for s in lines], pa.int64()) for c in (lines, chars, pages))], ["shape", "kind", "lines", "chars", "pages"])

    src = df.select(F.col(text).cast("string").alias("t")).where("t is not null")
    return src.mapInArrow(run, "shape string, kind string, lines bigint, chars bigint, pages bigint").groupBy("shape", "kind").agg(*(F.sum(c).alias(c) for c in ("lines", "chars", "pages")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, _ = site_lines(spark, sf_dir, with_shapes=True)
    return spam_pages(rows, found).where("is_spam").select("row_id")


def p1_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_report(table(spark, sf_dir, "adapted_document"))


QUERIES = {"p1_found": p1_found, "p1_shapes": p1_shapes}
