"""Problems 1, 5 and 7: forms, site lines, shapes."""

import collections
import re
import unicodedata

import pytest

from textlake.llm import forms, shapes, sitelines, spam

SCHEMA = "row_id bigint, text string, source_name string"


@pytest.mark.parametrize(
    "a, b",
    [("ａｂｃ，１２", "abc,12"), ("Сорe", "Cope"), ("山水", "⼭⽔"), ("ﬁne oﬃce", "fine office"), ("a​b­d", "abd"), ("a b　c d", "a b c d"), ("é", "é"), ("。", "｡"), ("x\r\ny", "x\ny"), ("不里", "不里")],
)
def test_same_look(spark, a, b):
    p = forms.prototypes(spark)
    assert forms.skeleton(a, p) == forms.skeleton(b, p)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("2", "²"), ("2", "②"), ("1", "l"), ("0", "O"), ("I", "l"), ("。", "."), ("一", "二"), ("a b", "a  b"), ("己", "已"), ("١", "1")])
def test_different_look(spark, a, b):
    p = forms.prototypes(spark)
    assert forms.skeleton(a, p) != forms.skeleton(b, p)


def test_form_is_stable(spark):
    p = forms.prototypes(spark)
    for t in ("Ｈéllо wörld ﬁ ⼭ ²", "нeллo"):
        assert forms.skeleton(forms.skeleton(t, p), p) == forms.skeleton(t, p)


def test_lookalike_pairs_against_brute_force(spark, data):
    rows = [(r.row_id, r.text) for r in spark.read.parquet(f"{data}/adapted_document.parquet").collect() if r.text and r.row_id is not None]
    p = forms.prototypes(spark)
    groups = collections.defaultdict(list)
    for i, t in rows:
        if (s := forms.skeleton(t, p)) and not s.isspace():
            groups[s].append((i, t))
    want = {(a, b) for g in groups.values() for a, x in g for b, y in g if a < b and x != y}
    got = [tuple(r) for r in forms.p5_found(spark, data).collect()]
    assert set(got) == want and len(got) == len(want)


def test_classes_with_nulls_empties_ties_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "abc", "s"), (2, "ａbc", "s"), (3, "abc", None), (4, "", "s"), (5, None, "s"), (None, "abc", "s"), (6, "​", "s")], SCHEMA).selectExpr("*", "'x' as form_hash", "'y' as k", "1 as t")
    got = {r.row_id: (r.class_id, r.n_texts) for r in forms.lookalike_classes(d).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2)}
    assert {r.row_id: r.links for r in forms.lookalike_classes(d).collect()} == {1: 1, 2: 2, 3: 1}
    assert forms.lookalike_classes(d.limit(0)).count() == 0
    out = {r.row_id: r.form for r in forms.normalise_forms(d).where("row_id is not null").collect()}
    assert out[2] == "abc" and out[5] is None and out[6] == ""


def test_blank_texts_have_no_look(spark):
    d = spark.createDataFrame([(1, " ", "s"), (2, "\u3000", "s"), (3, "\n", "s"), (4, "\u00a0\t", "s"), (5, "a b", "s"), (6, "a\u3000b", "s")], SCHEMA)
    assert [tuple(r) for r in forms.lookalike_pairs(d).collect()] == [(5, 6)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_of_hot_texts_in_blocks(spark, block):
    d = spark.createDataFrame([(i, "ａb" if i % 3 == 0 else "ab" if i % 3 == 1 else "аb" if i % 2 else f"z{i}", "s") for i in range(40)], SCHEMA)
    rows = [(r.row_id, r.text) for r in d.collect() if r.text[0] != "z"]
    got = [tuple(r) for r in forms.lookalike_pairs(d, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, x in rows for b, y in rows if a < b and x != y}


def brute_lines(rows, threshold):
    key = lambda s: re.sub(r"[\s\d]", "", unicodedata.normalize("NFKC", s))
    where = collections.defaultdict(set)
    at = []
    for i, t, src in rows:
        for n, line in enumerate((t or "").split("\n")):
            if src is not None and t is not None and re.search(r"[^\W_]", line):
                where[src, key(line)].add(i)
                at.append((i, n, (src, key(line))))
    return {(i, n) for i, n, k in at if len(where[k]) >= threshold}


def test_repeated_lines_against_brute_force_in_any_deltas(spark):
    rows = [(i, f"head {i}\nＦooter ２{i}" if i % 2 else f"footer {i}\n\n---\nbody{i % 3}", "a" if i < 14 else "b") for i in range(20)] + [(90, None, "a"), (91, "", "a"), (92, "footer 1", None), (93, "12\n345", "b")]
    rows = [(i, (t or None) and t.replace("Ｆ", "f"), s) for i, t, s in rows]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as keys", "0 as chars")
    want = brute_lines(rows, 5)
    for cut in (100, 10, 3):
        site = sitelines.SiteLines(spark, 5)
        found = [site.ingest(sitelines.profile_lines(d)) for d in (df.where(f"row_id < {cut}"), df.where(f"row_id >= {cut}"))]
        got = [(r.row_id, r.line_no) for f in found for r in f.collect()]
        assert set(got) == want and len(got) == len(want)


def test_strip_lines(spark):
    df = spark.createDataFrame([(1, "x\ny\nz", "s"), (2, "q", "s"), (3, None, "s")], SCHEMA)
    found = spark.createDataFrame([(1, 1)], "row_id bigint, line_no int")
    assert {r.row_id: r.text for r in sitelines.strip_lines(df, found).collect()} == {1: "x\nz", 2: "q", 3: None}


@pytest.mark.parametrize(
    "line, kind",
    [
        ("说到底,新型烤箱能去掉腥味,霞水的做法并不有用。", "sentence"), ("It took the tester 80 days to see why the cache layer timed out under heavy load.", "sentence"),
        ("https://a.example/p/1 货架价格", "link"), ("- [标题](https://a.example/p/1)", "link"), ("床垫型号;雨棚推荐;烘干机定制;货架价格;水泵厂家;电缆报价", "list"),
        ("尺码:叉车95 尺码:水泵96 材质:板材68 风格:电缆48 适用:印章44", "attribute"), ("| a | b | c |", "table"), ("2004-11-12 67:23 INFO [quill-58] code=231 ms=1934", "log"),
        ("651 18 177 111 6010 59792 9663 8 82647", "number"), ("☆☆☆☆☆★★★★★■■■■", "symbol"), ("哈" * 60, "symbol"), ("ndblzwd bf jgsp fjlzhwhoku pu wnoqzgc nzrchd itgwmhdj dnhxe zjblrlecfi", "random"),
        ("å…³äºŽæ—©æœŸåˆ†å­", "broken"), ("def patch(limit=2): return limit * 2", "code"), ("3. 终点线 8921", "bullet"),
    ],
)
def test_line_kinds(line, kind):
    assert shapes.KIND_NAMES[shapes.line_kind(line)[0]] == kind


@pytest.mark.parametrize(
    "line, kind",
    [
        ("wholesale手机壳 " * 20, "stuffed"), ("手机壳的批发,手机壳的价格,手机壳的厂家," * 4 + "手机壳的报价。", "stuffed"), ("我的表格在这里。\t他们的名字是什么\t我们的价格在这里。", "table"),
        ("我们的表格在这里<a href=x>,他们的名字也在这里。", "link"), ("我们的网站在这里,他们的名字也在这里。\ue000\ue001\ue002", "broken"), ("我们的网站在这里,他们的名字也在这里。", "sentence"),
    ],
)
def test_sentence_marks_hide_no_other_shape(line, kind):
    assert shapes.KIND_NAMES[shapes.line_kind(line)[0]] == kind


def test_spam_pages(spark):
    words = ";".join(f"床垫{x}" for x in ("型号", "推荐", "定制", "价格", "厂家", "报价", "直销", "安装"))
    prose = "说到底,新型烤箱能去掉腥味,霞水的做法并不有用。"
    df = spark.createDataFrame([(1, words, "a"), (2, prose * 3 + "\n" + words, "a"), (3, None, "a"), (4, "", None), (5, prose + "\nhttps://x.example/a/b", "b")], SCHEMA)
    rows = sitelines.profile_lines(df, with_shapes=True)
    none = spark.createDataFrame([], "row_id bigint, line_no int, chars int, spam int, shape bigint")
    assert {r.row_id for r in spam.spam_pages(rows, none).where("is_spam").collect()} == {1}
    assert spam.shape_report(df.limit(0)).count() == 0


def test_a_page_of_many_shapes_is_no_group(spark):
    """Removing the grouping changes the rows: the page's spam lines hold nearly all characters, but in more shapes than may dominate a page."""
    words = ("床垫型号", "雨棚推荐", "烘干机定制", "货架价格", "水泵厂家", "电缆报价", "印章直销", "板材安装")
    lines = [";".join(words), "|".join(words) + " |", "https://x.example/a/b", "尺码:叉车95 尺码:水泵96 材质:板材68 风格:电缆48 适用:印章44", "- 床垫型号", "- 雨棚推荐", "- 货架价格", "- 电缆报价", "床垫 cheap;雨棚 Sale;货架 top;水泵 buy;电缆 now;印章 x", "wholesale手机壳 " * 4]
    df = spark.createDataFrame([(1, "\n".join(lines), "a"), (2, "\n".join(lines[:1] * 9), "a")], SCHEMA)
    rows = sitelines.profile_lines(df, with_shapes=True)
    none = spark.createDataFrame([], "row_id bigint, line_no int, chars int, spam int, shape bigint")
    flagged = lambda few: {r.row_id for r in spam.spam_pages(rows, none, few=few).where("is_spam").collect()}
    assert flagged(100) == {1, 2} and flagged(1) == {2}


def test_site_lines_are_taken_from_their_group(spark):
    words = ";".join(f"床垫{x}" for x in ("型号", "推荐", "定制", "价格", "厂家", "报价", "直销", "安装"))
    df = spark.createDataFrame([(i, words + "\n说到底,新型烤箱能去掉腥味,霞水的做法并不有用。" * (i % 2), "a") for i in range(4)], SCHEMA)
    rows = sitelines.profile_lines(df, with_shapes=True)
    site = sitelines.SiteLines(spark, 3)
    assert spam.spam_pages(rows, site.ingest(rows)).where("is_spam").count() == 0


def test_shapes_come_back_from_their_codes():
    for line in ("", "说到底,新型烤箱能去掉腥味。", "Cheap Red Shoes | Blue Bags | Watches", "651 18 177 111 6010 59792", "https://a.example/p/1 货架价格"):
        shape = shapes.measure(line)[0]
        assert shapes.shape_of(shapes.shape_code(shape)) == shape
    assert shapes.measure("Cheap Red Shoes")[0].capitals == 2 and shapes.measure("cheap red Shoes")[0].capitals == 1


def test_site_lines_go_on_in_a_later_session(spark, tmp_path):
    rows = sitelines.profile_lines(spark.createDataFrame([(i, f"head {i}\nbody{i}x{'abcdefghijkl'[i]}", "a") for i in range(12)], SCHEMA))
    at = f"file://{tmp_path}/state"
    first = sitelines.SiteLines(spark, 10, at).ingest(rows.where("row_id < 8"))
    again = sitelines.SiteLines(spark, 10, at)
    assert first.count() == 0 and again.deltas == 1
    assert {(r.row_id, r.line_no) for r in again.ingest(rows.where("row_id >= 8")).collect()} == {(i, 0) for i in range(12)}
    assert sitelines.SiteLines(spark, 10, at).repeated().count() == 1


def test_places_by_broadcast_and_by_shuffle(spark):
    rows = sitelines.profile_lines(spark.createDataFrame([(i, f"head {i}\nx{i % 3}y{'abc'[i % 3]}", "a") for i in range(30)], SCHEMA))
    keys = sitelines.count_lines(rows).where("n_rows >= 10")
    one, two = (sorted((r.row_id, r.line_no) for r in sitelines.places(rows, keys, n).collect()) for n in (100, 0))
    assert one == two and len(one) == 60


def test_strip_repeated_is_strip_lines(spark):
    df = spark.createDataFrame([(i, f"Head {i}\r\nbody {'abcdefghijkl'[i]}\n\nＨead {i}", "a") for i in range(12)] + [(20, "Head 1", None), (21, None, "a"), (22, "", "a"), (23, "Head 1", "b")], SCHEMA)
    site = sitelines.SiteLines(spark, 10)
    found = site.ingest(sitelines.profile_lines(df))
    one, two = ({r.row_id: r.text for r in d.collect()} for d in (sitelines.strip_lines(df, found), sitelines.strip_repeated(df, site.repeated())))
    assert one == two and one[0] == "body a\n" and one[20] == "Head 1"
    assert sitelines.strip_repeated(df, site.repeated(), broadcast_keys=0) is None


def test_queries_run(spark, data):
    for q in (spam.p1_found, spam.p1_shapes, forms.p5_forms, sitelines.p7_found, sitelines.p7_stripped):
        assert q(spark, data).count() > 0
