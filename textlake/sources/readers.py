"""Scans: files of several shapes into documents of one schema, and the writers beside them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textlake.functions import text as T

DOCUMENT = S.StructType([
    S.StructField("text", S.StringType()), S.StructField("source_name", S.StringType()), S.StructField("source_type", S.StringType()), S.StructField("source_group", S.StringType()),
    S.StructField("source_id", S.StringType()), S.StructField("metadata", S.MapType(S.StringType(), S.StringType())), S.StructField("char_count", S.LongType()),
])

#: Text fields that are looked for first, in order.
TEXT_FIELDS = ("text", "content", "article", "body", "passage", "sentence", "output", "answer")


@dataclass(frozen=True)
class SourceConfig:
    source_name: str
    source_type: str
    source_group: str = ""
    path: str | None = None
    enabled: bool = True
    max_docs: int | None = None
    max_chars: int | None = None
    field_map: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)


def read_lines(spark: SparkSession, path: str, bad: str = "fail") -> DataFrame:
    """JSON lines (gzip too) as (line, value): value is a VARIANT. Blank lines are skipped.

    bad: 'fail' raises on lines that are no JSON, 'count' keeps them with a null value, 'drop' leaves them out, 'keep' gives them as
    {"_line", "_parse_error", "text"}.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    v = F.try_parse_json("line")
    if bad == "fail":
        return lines.select("line", F.parse_json("line").alias("value"))
    if bad == "drop":
        return lines.select("line", v.alias("value")).where("value is not null")
    if bad == "count":
        return lines.select("line", v.alias("value"))
    if bad == "keep":
        wrapped = F.parse_json(F.to_json(F.struct(F.col("line").alias("_line"), F.lit("json_decode_error").alias("_parse_error"), F.col("line").alias("text"))))
        return lines.select("line", F.coalesce(v, wrapped).alias("value"))
    raise ValueError(f"unsupported mode for bad lines: {bad}")


def numbered_lines(spark: SparkSession, path: str, start: int = 1, limit: int | None = None) -> DataFrame:
    """(line_no, line) of one text file from line `start` (1-based), at most `limit` of them.

    A file's lines are in order across its partitions; numbers are offsets of partitions plus places in them, so nothing is sorted.
    """
    d = spark.read.text(path).select(F.col("value").alias("line"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_first"))
    from pyspark.sql import Window

    base = sizes.select("_p", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = d.join(F.broadcast(base), "_p").select((F.col("_base") + F.col("_m") - F.col("_first") + 1).alias("line_no"), "line").where(F.col("line_no") >= start)
    return out.where(F.col("line_no") < start + limit) if limit is not None else out


def tail_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines that are JSON, in order."""
    d = numbered_lines(spark, path)
    return d.select("line_no", F.try_parse_json("line").alias("value")).where("value is not null").orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def read_separated(spark: SparkSession, path: str, separator: str = f"\n\n{T.DOC_SEPARATOR}\n\n") -> DataFrame:
    """(text): documents between separators, trimmed, blank ones left out. Files are cut while they are read, so a large one is still split."""
    d = spark.read.option("lineSep", separator).text(path).select(T.strip(F.col("value")).alias("text"))
    return d.where("text <> ''")


def read_dialogue_files(spark: SparkSession, path: str, key: str = "dialogues") -> DataFrame:
    """(dialogue): the elements of the array `key` in JSON files of one object each, as VARIANTs."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return whole.select(F.explode(F.try_variant_get("v", f"$.{key}", "array<variant>")).alias("dialogue"))


def read_map_values(spark: SparkSession, path: str) -> DataFrame:
    """(value): a JSON file holding a list gives its elements; one holding an object gives the object's values."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    as_map, as_list = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
    return whole.select(F.explode(F.coalesce(as_list, F.map_values(as_map))).alias("value"))


def field_of(value: Column, name: str, type_: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", type_)


def record_text(value: Column, field_map: dict[str, str] | None = None) -> Column:
    """The text of a raw record (VARIANT): the first shape that fits of text, question and answer, instruction and response, conversations, dialogue,
    and the fallback fields. field_map names the fields that differ."""
    m = field_map or {}
    s = lambda k: F.nullif(T.strip(field_of(value, m.get(k, k))), F.lit(""))
    q, a = s("question"), s("answer")
    ins, out = s("instruction"), F.coalesce(s("response"), s("output"))
    turns = F.transform(field_of(value, m.get("conversations", "conversations"), "array<variant>"), lambda t: F.struct(F.coalesce(field_of(t, "from"), field_of(t, "role")).alias("role"), F.coalesce(field_of(t, "value"), field_of(t, "content")).alias("text")))
    dialogue = field_of(value, m.get("dialogue", "dialogue"), "array<string>")
    return F.coalesce(
        s("text"),
        F.when(q.isNotNull() & a.isNotNull(), T.question_answer(q, a, s("context"))),
        F.when(ins.isNotNull() & out.isNotNull(), T.instruction(ins, out, s("input"))),
        F.nullif(T.conversation(turns), F.lit("")),
        F.nullif(T.dialogue(dialogue), F.lit("")),
        *(s(k) for k in TEXT_FIELDS[1:]),
    )


def strings_in(value: Column, depth: int = 3) -> Column:
    """All strings of a VARIANT, objects before lists, down to `depth` levels."""
    out = F.array(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
    if depth:
        inner = F.concat(F.coalesce(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<variant>")), F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")))
        out = F.concat(out, F.flatten(F.transform(inner, lambda v: strings_in(v, depth - 1))))
    return F.filter(out, lambda x: x.isNotNull())


def discover_text(value: Column, names: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """The first named field that holds text, else the longest string anywhere; ties keep the first."""
    longest = F.aggregate(strings_in(value), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.coalesce(*(F.nullif(T.strip(field_of(value, n)), F.lit("")) for n in names), F.nullif(longest, F.lit("")))


def as_documents(df: DataFrame, config: SourceConfig, text: Column, source_id: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Rows of DOCUMENT's columns; blank texts are left out."""
    d = df.select(text.alias("text"), F.lit(config.source_name).alias("source_name"), F.lit(config.source_type).alias("source_type"), F.lit(config.source_group).alias("source_group"), (source_id if source_id is not None else F.lit(None)).cast("string").alias("source_id"), (metadata if metadata is not None else F.lit(None)).cast("map<string,string>").alias("metadata"))
    return d.withColumn("char_count", F.length("text").cast("bigint")).where(F.length(T.strip(F.col("text"))) > 0)


def read_source(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """The adapter of a source: the option 'adapter', else the suffix of its path: .jsonl, .json, .txt, .parquet (and .gz of these)."""
    path = config.path or ""
    kind = config.options.get("adapter") or next((s for s in ("jsonl", "json", "txt", "parquet") if path.removesuffix(".gz").endswith("." + s)), None)
    if kind == "jsonl":
        d = read_lines(spark, path, config.options.get("bad", "fail"))
        return as_documents(d, config, record_text(F.col("value"), config.field_map), field_of(F.col("value"), config.field_map.get("id", "id")))
    if kind == "json":
        d = read_map_values(spark, path)
        return as_documents(d, config, record_text(F.col("value"), config.field_map))
    if kind == "txt":
        return as_documents(read_separated(spark, path), config, F.col("text"))
    if kind == "parquet":
        d = spark.read.parquet(path)
        return as_documents(d, config, F.col(config.field_map.get("text", "text")))
    raise ValueError(f"no adapter for {path!r}")


def largest_per_family(files: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, size) of the largest file of each family; empty files are left out and size ties go to the first path. The family is a known prefix of the
    file name, else the name without a trailing number."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    family = F.coalesce(*(F.when(F.startswith(name, F.lit(p)), p) for p in prefixes), F.regexp_replace(name, r"[_\-.]?\d+$", ""))
    d = files.where("size > 0").withColumn("family", family)
    return d.groupBy("family").agg(F.min_by(F.struct("path", "size"), F.struct((-F.col("size")).alias("s"), "path")).alias("x")).select("family", "x.path", "x.size")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"))


def synthetic(spark: SparkSession, templates: list[str], n: int) -> DataFrame:
    """(id, text): template i modulo their number, with its number in place of {}."""
    t = F.element_at(F.array(*map(F.lit, templates)), (F.col("id") % len(templates) + 1).cast("int"))
    return spark.range(n).select("id", F.replace(t, F.lit("{}"), F.col("id").cast("string")).alias("text"))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, name, value): the JSON side files of run directories, one row a file."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("value"))
    return d.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), "value")


def samples_of_report(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """(n, text): the fenced or quoted samples below a heading of a Markdown report."""
    whole = spark.read.text(path, wholetext=True)
    section = F.regexp_extract("value", rf"(?s)^.*?#+ *{heading}[^\n]*\n(.*?)(?:\n#|\z)", 1)
    return whole.select(F.posexplode(F.regexp_extract_all(section, F.lit(r"(?s)```[a-z]*\n(.*?)\n```"), 1)).alias("n", "text"))


# Writers.


def guard(path: str, mode: str) -> str:
    """The save mode of 'new' (fails where something is), 'force' or 'append'."""
    return {"new": "errorifexists", "force": "overwrite", "append": "append"}[mode]


def write_jsonl(df: DataFrame, path: str, mode: str = "new") -> None:
    df.select(*sorted(df.columns)).write.mode(guard(path, mode)).json(path)


def write_corpus(df: DataFrame, path: str, text: str = "text", mode: str = "new") -> None:
    """One text file a partition, a separator behind every document."""
    df.select(text).write.mode(guard(path, mode)).option("lineSep", f"\n\n{T.DOC_SEPARATOR}\n\n").text(path)


def write_decisions(df: DataFrame, path: str, decision: str = "decision", mode: str = "new") -> None:
    """Kept, quarantined and dropped rows side by side, one folder a decision, in one pass."""
    df.write.mode(guard(path, mode)).partitionBy(decision).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "new") -> None:
    df.select(*columns).write.mode(guard(path, mode)).option("header", True).option("emptyValue", "").csv(path)


def write_json(path: str, payload: object) -> None:
    """A driver-side file, whole or not at all."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    t = p.with_name(p.name + ".tmp")
    t.write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    t.replace(p)


def signature(payload: object, n: int = 12) -> str:
    """Key of a configuration: SHA-1 of its JSON with sorted keys."""
    return hashlib.sha1(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:n]


def markdown(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A small report table as Markdown."""
    body = df.limit(rows).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in body]) + "\n"


def paragraphs(text: Column) -> Column:
    """The pieces between blank lines; the lines where there is no blank line. Blank pieces are left out."""
    trim = lambda a: F.filter(F.transform(a, T.strip), lambda x: F.length(x) > 0)
    blocks = trim(F.split(text, rf"\n{T.WS}*\n"))
    return F.when(F.size(blocks) > 1, blocks).otherwise(trim(F.split(text, "\n")))


def first_available(*candidates: DataFrame | None) -> DataFrame | None:
    """The first table that has rows: documents, else a corpus, else shards, else a preview."""
    return next((d for d in candidates if d is not None and d.head(1)), None)


def plan_rows(manifest: DataFrame, value: str = "value") -> DataFrame:
    """(source_name, group, category, rows, max_rows, max_docs, max_chars) of a manifest's sources (VARIANT); rows are the clean ones, else the raw."""
    s = manifest.select(F.explode(F.try_variant_get(value, "$.sources", "array<variant>")).alias("s"))
    g = lambda p, t="string": F.try_variant_get("s", f"$.{p}", t)
    return s.select(
        F.coalesce(g("source_name"), g("name")).alias("source_name"), g("group").alias("group"), g("category").alias("category"),
        F.coalesce(g("reported_by_chatlm.clean_rows", "bigint"), g("reported_by_chatlm.raw_rows", "bigint")).alias("rows"),
        *(g(f"sampling_plan.{c}", "bigint").alias(c) for c in ("max_rows", "max_docs", "max_chars")),
    )
