"""The registry against golden cases of our own wording."""

import pytest

from textlake.operators import rules

PAD = "这是一段普通的说明文字，用来让文本达到需要的长度，内容平平淡淡。"
CASES = [
    ("short dialogue", "今天下雨了，记得带伞", "silver/lccc/a.gz", "lccc_social_dialogue", "keep", {"short_social_dialogue"}, {"too_short"}),
    ("short wiki", "某河位于某省北部。", "Chinese Wikipedia", "encyclopedia", "keep", set(), {"too_short"}),
    ("too short web", "太短了", "x", "general_web_backbone", "drop", {"too_short"}, set()),
    ("latin", "just an english sentence that has no han at all", "x", "general_web_backbone", "drop", {"low_chinese_ratio_hard"}, set()),
    ("url", PAD + "见 https://a.example/b", "x", "general_web_backbone", "keep", {"url"}, set()),
    ("broken", PAD + "�" * 25, "x", "comment", "quarantine", {"broken_encoding"}, set()),
    ("markup", PAD + "<p>一</p><b>二", "x", "comment", "quarantine", {"markup_noise"}, set()),
    ("repeated char", PAD + "啊" * 12, "x", "comment", "keep", {"long_repeated_char"}, set()),
    ("repeated span", PAD * 12, "x", "comment", "quarantine", {"repeated_span"}, set()),
    ("gambling", PAD + "天天彩票平台注册就送彩金", "x", "comment", "quarantine", {"gambling_spam"}, set()),
    ("seo", PAD + "上一篇 下一篇 返回首页", "x", "general_web_backbone", "quarantine", {"seo_boilerplate_dense"}, set()),
    ("seo out of scope", PAD + "上一篇 下一篇 返回首页", "x", "comment", "keep", set(), {"seo_boilerplate_dense"}),
    ("promo", PAD + "招商加盟火热进行，欢迎领取资料", "x", "general_web_backbone", "quarantine", {"commercial_promo_template"}, set()),
    ("negated promo", PAD + "本文没有招商加盟之类的内容", "x", "general_web_backbone", "keep", set(), {"commercial_promo_template"}),
    ("contact", PAD + "加微信 abc123 即可报名培训课程，限时优惠", "x", "comment", "keep", {"ad_contact_template"}, set()),
    ("medical", PAD + "本医院是规模最大的专科，治疗各种疾病", "x", "general_web_backbone", "quarantine", {"medical_promo_template"}, set()),
    ("cracked", PAD + "密码暴力破解器下载，安装使用步骤如下", "x", "qa", "quarantine", {"cracked_software_template"}, set()),
    ("cracked negated", PAD + "请勿使用破解工具下载软件", "x", "qa", "keep", set(), {"cracked_software_template"}),
    ("download", PAD + "软件大小 更新时间 运行环境 下载地址 安装教程", "x", "general_web_backbone", "quarantine", {"download_site_template"}, set()),
    ("court", "某省人民法院民事判决书 " + PAD, "x", "general_web_backbone", "quarantine", {"legal_template_dense"}, set()),
    ("law lesson", PAD + "第一条讲的是合同", "x", "general_web_backbone", "keep", set(), {"legal_template_dense"}),
    ("links with giveaway", PAD + "转发抽奖 http://t.cn/a1 http://t.cn/b2", "x", "comment", "quarantine", {"dense_social_shortlinks"}, set()),
    ("links of a notice", PAD + "考试报名通知 http://t.cn/a1 http://t.cn/b2", "x", "comment", "keep", set(), {"dense_social_shortlinks"}),
    ("negated giveaway", PAD + "这并非抽奖 http://t.cn/a1 http://t.cn/b2 公告", "x", "comment", "keep", set(), {"dense_social_shortlinks"}),
    ("media", PAD + " a.jpg b.png c.gif d.mp4 e.webp", "x", "comment", "quarantine", {"many_media_filenames"}, set()),
    ("separators", PAD + "<|doc_sep|>" * 8, "x", "comment", "drop", {"many_short_docs_structural"}, set()),
    ("punctuation", "好的呀。！，" * 30, "x", "comment", "quarantine", {"punctuation_dense"}, set()),
    ("morse question", "摩斯电码怎么写好。！？，、；：" * 20, "x", "qa", "quarantine", {"repeated_span"}, {"punctuation_dense"}),
    ("null", None, None, None, "drop", {"too_short"}, set()),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(c[0], c[1], c[2], c[3]) for c in CASES], "case string, text string, source_name string, source_type string").selectExpr("*", "'old' as flags", "'old' as decision", "1 as length")
    return {r.case: r for r in rules.classify(df).collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_golden(classified, case):
    name, _, _, _, decision, must, must_not = case
    r = classified[name]
    assert must <= set(r.flags) and not must_not & set(r.flags), r.flags
    assert r.decision == decision, r.flags


def test_registry():
    names = [r["name"] for r in rules.registry()]
    assert len(names) == len(set(names)) == 27 and names[0] == "too_short"


@pytest.mark.parametrize("pattern, words", [("(?:甲乙|丙丁.{0,3})", {"甲乙", "丙丁"}), ("(?d)没有.{0,2}广告", {"没有"}), ("(?i)abc", set()), (".*甲", set()), ("(?:甲|乙)?丙", set()), ("甲乙?丙|丁", {"甲", "丁"})])
def test_needed_words(pattern, words):
    assert set(rules.needed_words(pattern)) == words


def test_other_predicates(spark):
    df = spark.createDataFrame([(1, PAD), (2, "短"), (3, PAD + "�"), (4, None)], "i int, text string")
    keep = {r.i: r.k for r in df.select("i", rules.should_keep(rules.F.col("text"), 20).alias("k")).collect()}
    assert keep == {1: True, 2: False, 3: False, 4: False}
    cat = spark.createDataFrame([("法院作出判决，原告和被告到庭",), ("我觉得还行",), ("随便写点东西",), ("什么是光合作用",)], "text string").select(rules.category(rules.F.col("text")).alias("c"))
    assert [r.c for r in cat.collect()] == ["legal", "natural_dialogish", "natural_web", "encyclopedia"]


def test_quality_gate(spark):
    body = "这一段是足够长的正文。" * 10
    rows = [("natural_web", body + "\n相关阅读：某某"), ("natural_web", "短"), ("acg_wiki", body + "\n{{模板|thumb}}"), ("bilibili_comment", "价格私聊接单\n" + body), ("other", "民 事 判 决 书 " + body), ("other", body + ""), ("other", body)]
    got = [(r.gate_reason, r.removed_lines) for r in rules.quality_gate(spark.createDataFrame(rows, "category string, text string")).collect()]
    assert got == [(None, 1), ("seo_empty", 0), (None, 1), (None, 1), ("cjk_spaced", 0), ("encoding_damaged", 0), (None, 0)]
