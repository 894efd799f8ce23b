"""Text functions against plain Python versions of what they should do."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    alphabet = "你好世界，。！？ab c1 2\n\t\r　\xa0~…·<br>http://x.y $P$"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, ""), (901, None), (902, "é é ​﻿\x07x")]
    return spark.createDataFrame(rows, "i int, t string").cache()


def check(df, column, plain):
    for r in df.select("i", "t", column.alias("o")).collect():
        assert r.o == plain(r.t), (r.i, r.t)


def squeeze(t):
    return re.sub(r"\s+", "", t)


def test_compact_and_keys(texts):
    check(texts.where("t is not null"), T.compact(F.col("t")), squeeze)
    assert texts.where("t is not null").where(T.compact_key(F.col("t")) != F.sha1(T.compact(F.col("t")))).count() == 0


def training(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n").strip()
    t = re.sub("[ \t]+", " ", t)
    t = re.sub(r"([，。！？；：、）】》」』])\s+", r"\1", t)
    t = re.sub(r"\s+([，。！？；：、（【《「『])", r"\1", t)
    t = re.sub(r"([一-鿿])\s+([A-Za-z0-9])", r"\1\2", t)
    t = re.sub(r"([A-Za-z0-9])\s+([一-鿿])", r"\1\2", t)
    return re.sub("\n{3,}", "\n\n", t).strip()


def test_normalize_training(texts):
    check(texts.where("t is not null"), T.normalize_training(F.col("t")), training)


def test_normalize_clean(texts):
    def plain(t):
        t = unicodedata.normalize("NFC", t or "").replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"(?:\$\s*P\s*\$)+", "\n", t)
        t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
        return training("".join(c for c in t if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf", "Co")))

    check(texts, T.normalize_clean(F.col("t")), plain)


def test_shares(texts):
    check(texts.where("t is not null"), T.visible_chars(F.col("t")), lambda t: len(squeeze(t)))
    check(texts.where("t is not null"), F.round(T.chinese_ratio(F.col("t")), 9), lambda t: round(len(re.findall("[一-鿿]", t)) / len(squeeze(t)), 9) if squeeze(t) else 0.0)


def test_repetition(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "a"), (3, ""), (4, "aaaa"), (5, "abcabc")], "i int, t string")
    got = {r.i: (r.c, round(r.g, 6)) for r in df.select("i", T.repeated_char_ratio(F.col("t")).alias("c"), T.repeated_ngram_ratio(F.col("t")).alias("g")).collect()}
    assert got == {1: (0.5, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 0.5), 5: (0.0, 0.25)}


def test_diversity_and_spans(spark):
    df = spark.createDataFrame([(1, "ab" * 400), (2, "".join(chr(0x4E00 + i) for i in range(800))), (3, "ab"), (4, "".join(chr(0x4E00 + i) for i in range(40)) * 12), (5, None)], "i int, t string")
    t = F.col("t")
    got = {r.i: (r.d, r.s, r.r) for r in df.select("i", T.low_diversity(t).alias("d"), T.repeated_spans(t).alias("s"), T.too_repetitive(t).alias("r")).collect()}
    assert got[1][0] and not got[2][0] and not got[3][0]
    assert got[1][1] >= 2 and got[2][1] == 0 and got[3][1] == 0 and got[4][1] >= 2
    assert got[1][2] and not got[2][2]


def test_dialogue(spark):
    df = spark.createDataFrame([(1, ["你好", " ", "乙：嗯", None, "走"]), (2, []), (3, None)], "i int, d array<string>")
    got = {r.i: r.o for r in df.select("i", T.dialogue(F.col("d")).alias("o")).collect()}
    assert got == {1: "甲：你好\n乙：嗯\n甲：走", 2: "", 3: ""}


def test_conversation(spark):
    df = spark.createDataFrame([([("Human", " hi "), ("gpt", ""), ("", "x"), ("critic", "y")],)], "c array<struct<role:string,text:string>>")
    assert df.select(T.conversation(F.col("c")).alias("o")).first().o == "用户：hi\n文本：x\ncritic：y"


def test_records(spark):
    q = spark.createDataFrame([("问", "答", "问"), ("问", "答", "补"), (None, None, None)], "q string, a string, c string")
    out = [r.o for r in q.select(T.question_answer(F.col("q"), F.col("a"), F.col("c")).alias("o")).collect()]
    assert out == ["问题：问\n回答：答", "问题：问\n补充：补\n回答：答", "问题：\n回答："]


def test_wiki_and_spacing(spark):
    w = "{|table|}{{模板}}'''加粗'''[[链接|文字]]和[[目标]]\n== 标题 ==\n[[分类:甲]]\n* 短条目\n<ref>r</ref>正文内容"
    row = spark.createDataFrame([(w, "题名", "他 去 海边 ， 带 GPS 走 ok go")], "w string, t string, s string").select(T.clean_wiki(F.col("w"), F.col("t")).alias("w"), T.chinese_spacing(F.col("s")).alias("s"), T.repair_utterance(F.lit("嗯， 他 们 ~ ~ ~ &amp; x")).alias("u")).first()
    assert row.w.startswith("题名\n") and "加粗文字和目标" in row.w and "标题" in row.w and "短条目" not in row.w and "分类" not in row.w
    assert row.s == "他去海边，带GPS走ok go"
    assert row.u == "嗯，他们~~~ & x"


def test_small_functions(spark):
    row = spark.range(1).select(
        T.slug(F.lit("a/b c__")).alias("slug"), T.shorten(F.lit("a  b\nc"), 3).alias("short"), T.cut_at_newline(F.lit("ab\ncd"), 4).alias("cut"), T.cut_at_stops(F.lit("promptxxENDyySTOP"), F.lit("prompt"), ["STOP", "END"]).alias("stop"), T.visible(F.lit(" \n")).alias("vis"), T.occurrences(F.lit("aaaa"), F.lit("aa")).alias("occ"), T.dedupe_key(F.lit("x"), "clean_hash", F.create_map(F.lit("clean_text_hash"), F.lit(" "))).alias("key"),
    ).first()
    assert (row.slug, row.short, row.cut, row.stop, row.vis, row.occ, row.key) == ("a_b_c", "a b...", "ab", "promptxx", "␠␊", 2, "11f6ad8ec52a2984abaafd7c3b516503785c2072")
