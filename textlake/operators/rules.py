"""The rule registry: named conditions on a document, with a severity and the kinds of sources they hold for.

A rule is a function from Facts to a boolean Column. Facts holds the columns that several rules read, so each is written once in the plan and Catalyst
shares it. All rules that apply are evaluated; a drop beats a quarantine beats keep, and flags never change the decision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import lexicons as L
from textlake.operators.lexicons import any_of


@dataclass(frozen=True)
class Profile:
    """What differs between corpora. script: the class of characters whose share the two ratio rules look at."""

    script: str = T.HAN_BMP
    hard_ratio: float = 0.15
    soft_ratio: float = 0.35
    min_chars: int = 20
    short_min_chars: int = 8
    repeated_char: int = 10


ZH = Profile()
LATIN = Profile(script=r"\p{IsLatin}")
#: Corpora of both scripts.
MIXED = Profile(script=r"[\x{4e00}-\x{9fff}\p{IsLatin}]")


def needed_words(pattern: str) -> list[str]:
    """Plain words of which every match of the pattern holds at least one, or none where that cannot be told: the leading literals of its top-level
    alternatives, or of those of the group they begin with. A plain search is some hundred times faster than a long alternation."""
    if pattern.startswith("(?d)"):
        pattern = pattern[4:]
    if pattern.startswith("(?i)") or "(?<" in pattern:
        return []
    words: set[str] = set()

    def split(p: str) -> list[str]:
        depth, at, out, in_class = 0, 0, [], False
        for i, c in enumerate(p):
            if in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "|" and not depth:
                out.append(p[at:i])
                at = i + 1
        return [*out, p[at:]]

    def first_group(p: str) -> str | None:
        depth = 0
        for i, c in enumerate(p):
            depth += (c == "(") - (c == ")")
            if not depth:
                rest = p[i + 1 : i + 2]
                return None if rest in ("?", "*", "{") else p[3:i]
        return None

    def walk(p: str) -> bool:
        for alternative in split(p):
            if alternative.startswith("(?:"):
                inner = first_group(alternative)
                if inner is None or not walk(inner):
                    return False
                continue
            word = ""
            for i, c in enumerate(alternative):
                if not ("\u3400" <= c <= "\u9fff" or c.isascii() and c.isalnum()):
                    if c in "?*{":
                        word = word[:-1]
                    break
                word += c
            if not word:
                return False
            words.add(word)
        return True

    if not walk(pattern):
        return []
    return sorted(w for w in words if not any(v != w and v in w for v in words))


@dataclass(frozen=True)
class Facts:
    text: Column
    kind: Column
    source_key: Column
    profile: Profile
    length: Column = field(init=False)
    ratio: Column = field(init=False)

    def __post_init__(self):
        # Both are columns of their own (see classify), so that no rule counts them again.
        object.__setattr__(self, "length", F.col("_length"))
        object.__setattr__(self, "ratio", F.col("_ratio"))

    def any_word(self, words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(self.text, F.lit(w)) for w in words))

    def has(self, pattern: str) -> Column:
        """Whether the pattern matches; behind a plain search for the words without which it cannot."""
        words = needed_words(pattern)
        c = T.has(self.text, pattern)
        return F.when(self.any_word(words), c).otherwise(False) if words else c

    def count(self, pattern: str) -> Column:
        words = needed_words(pattern)
        c = T.count(self.text, pattern)
        return F.when(self.any_word(words), c).otherwise(0) if words else c

    def share(self, cls: str) -> Column:
        return T.ratio(T.count_chars(self.text, cls), self.length)

    def matches(self, pattern: str) -> Column:
        """All matches in order; bind them with T.let where they are read more than once."""
        words = needed_words(pattern)
        c = F.regexp_extract_all(self.text, F.lit(f"({pattern})"), 1)
        return F.when(self.any_word(words), c).otherwise(F.array().cast("array<string>")) if words else c

    def times(self, words: list[str]) -> Column:
        """Sum over the words of their occurrences; a word inside another counts for both."""
        return reduce(lambda a, b: a + b, (T.count(self.text, w) for w in words))

    def kind_in(self, *kinds: str) -> Column:
        return self.kind.isin(*kinds)


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    test: Callable[[Facts], Column]
    scope: tuple[str, ...] = ()

    def hits(self, f: Facts) -> Column:
        c = self.test(f)
        return F.coalesce(f.kind_in(*self.scope) & c if self.scope else c, F.lit(False))


def source_key(name: Column, type_: Column) -> Column:
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(type_, F.lit(""))))


def source_kind(key: Column) -> Column:
    out = F
    for kind, marks in L.SOURCE_KINDS:
        out = out.when(T.has(key, any_of(marks)), kind)
    return out.otherwise("unknown")


def _min_length(f: Facts) -> Column:
    p = f.profile
    return F.when(f.kind_in("dialogue_short", "dialogue", "qa", "wiki"), p.short_min_chars).otherwise(p.min_chars)


def _broken_encoding(f: Facts) -> Column:
    bad = T.count_chars(f.text, r"\x{fffd}")
    return (bad >= 20) | ((bad >= 5) & (T.ratio(bad, f.length) > 0.03)) | (f.share(r"\p{Co}") > 0.03)


def _social_links(f: Facts) -> Column:
    links, mentions, n = f.count(L.SHORT_LINK), f.count(L.MENTION), F.length(f.text)
    # A giveaway counts unless a negation stands in the twelve characters before it.
    giveaway = f.has(rf"(?d)(?<!{any_of(L.GIVEAWAY_NEGATION)}[^\n]{{0,11}}){any_of(L.GIVEAWAY)}")
    commerce = f.has("(?d)" + any_of(L.SOCIAL_COMMERCE))
    notice = ~giveaway & ~commerce & (mentions == 0) & f.has(any_of(L.PUBLIC_NOTICE))
    dense = giveaway | commerce | ((links >= 3) & (mentions >= 2) & (n < 1200)) | ((links >= 5) & (n < 800))
    return (links >= 2) & ~notice & dense


def _exam(f: Facts) -> Column:
    first = F.regexp_extract(f.text, r"(?d)^(.{4,40}?[？?。]|.{4,40}?（）)", 1)
    question = T.compact(first)
    return f.has(f"(?d){L.EXAM_TEMPLATE}") | ((F.length(question) >= 6) & f.has(L.EXAM_MARKS) & (T.occurrences(T.compact(f.text), question) >= 3))


def _topic_soup(f: Facts) -> Column:
    topics = reduce(lambda a, b: a + b, (f.has(any_of(w)).cast("int") for w in L.TOPICS.values()))
    many = (f.count("[。！？!?]") >= 8) | (f.count("[，,]") >= 30)
    return F.contains(f.source_key, F.lit("cci3")) & F.when(F.length(f.text) >= 700, (topics >= 5) & many).otherwise(False)


def _promo_negated(f: Facts) -> Column:
    return f.has(f"(?d){L.PROMO_NEGATED}")


def _direct_contact(f: Facts) -> Column:
    return f.has("(?i)" + any_of(L.DIRECT_CONTACT))


def _commercial(f: Facts) -> Column:
    plain = f.has("(?d)" + any_of(L.COMMERCIAL)) | f.has(f"(?d){L.ENROLMENT}")

    def services(m: Column) -> Column:
        n, trades = F.size(m), F.size(F.array_distinct(m))
        return ((n >= 5) & (trades >= 3)) | ((n >= 3) & (trades >= 2) & f.has(L.BUSINESS_CUE))

    def sales(m: Column) -> Column:
        def of(words: list[str]) -> Column:
            return F.size(F.array_intersect(m, F.array(*map(F.lit, words))))

        contact = _direct_contact(f) | f.has(L.PURCHASE_CUE)
        strong = (F.size(m) >= 7) & (F.size(F.array_distinct(m)) >= 3) & contact
        return F.when((F.size(m) >= 6) & (of(L.PRODUCT_PROMO) >= 2), strong | ((of(L.PRODUCT_SALES) >= 1) & f.has(f"(?d){L.PRODUCT_PAIR}"))).otherwise(False)

    return (plain & ~_promo_negated(f)) | T.let(f.matches(any_of(L.BUSINESS)), services) | T.let(f.matches(any_of(L.PRODUCT)), sales)


def _download(f: Facts) -> Column:
    n = f.count(any_of(L.DOWNLOAD))
    return (n >= 5) | ((n >= 3) & f.has(L.DOWNLOAD_CUE)) | ((n >= 3) & f.has("下载|游戏") & (f.count("可以帮助") >= 4))


def _ad_contact(f: Facts) -> Column:
    # Both are columns of their own (see classify).
    context = (f.has("(?i)" + any_of(L.PROMO_CONTEXT)) & ~_promo_negated(f)) | F.col("_commercial") | F.col("_download")
    call = f.has(L.PHONE) & f.has("(?i)" + any_of(L.PHONE_CALL))
    contact = f.count("(?i)" + any_of(L.CONTACT))
    weak = (f.count(any_of(L.WEAK_CONTACT)) >= 2) & (f.count(any_of(L.SEO)) >= 2)
    return context & (_direct_contact(f) | call | ((contact >= 2) & (call | f.has(L.URL))) | weak)


def _medical(f: Facts) -> Column:
    # Only the first match of a provider with praise is looked at.
    window = F.regexp_extract(f.text, f"(?d)({L.MEDICAL_PROVIDER})", 1)
    terms = F.size(F.array_distinct(F.regexp_extract_all(window, F.lit(f"({L.MEDICAL_TERM})"), 1)))
    provider = (window != "") & f.has(L.MEDICAL_CUE) & (T.has(window, L.MEDICAL_STRONG) | (terms >= 2))
    return ~f.has(f"(?d){L.MEDICAL_NEGATED}") & (provider | f.has(f"(?d){L.MEDICAL_PRODUCT}") | f.has(f"(?d){L.MEDICAL_SERVICE}"))


def _helper_phrases(f: Facts) -> Column:
    n = f.count(any_of(L.HELPER))
    return (n >= 14) & (n / F.greatest(F.length(f.text) / 1000.0, F.lit(1.0)) >= 3.0)


def _legal(f: Facts) -> Column:
    head = F.substring(f.text, 1, 260)
    title = F.regexp_extract(head, f"(?d)({L.COURT_TITLE})", 1)
    titled = (title != "") & (F.contains(head, F.lit("人民法院")) | T.has(title, r"民\s*事|刑\s*事|行\s*政"))
    roles, marks, context = f.times(L.COURT_ROLES), f.times(L.COURT_MARKS), f.has(L.COURT_CONTEXT)
    formal = (marks >= 3) & (roles >= 6)
    charged = (f.count("被告") >= 5) & f.has("公诉|检察")
    articles = (f.count(L.LEGAL_ARTICLE) >= 16) & (marks >= 2)
    return ~f.has(f"(?d){L.COURT_NEGATED}") & (titled | (context & (formal | charged | articles)))


def _punctuation(f: Facts) -> Column:
    dense = (f.length >= 80) & (f.share(r"\p{P}") > 0.35)
    plain = T.sub(T.sub(f.text, L.RULE_LINE, " "), L.RULE_RUN, " ")
    n = T.visible_chars(plain)
    still = (n >= 80) & (T.ratio(T.count_chars(plain, r"\p{P}"), n) > 0.35)
    return F.when(dense, ~(f.kind_in("qa", "dialogue") & f.has(L.PUNCT_EXCUSES)) & still).otherwise(False)


_WEB = ("general_web", "unknown")
RULES = (
    Rule("too_short", "drop", lambda f: f.length < _min_length(f)),
    Rule("short_social_dialogue", "flag", lambda f: f.length < 80, ("dialogue_short",)),
    Rule("low_chinese_ratio_hard", "drop", lambda f: f.ratio < f.profile.hard_ratio),
    Rule("low_chinese_ratio_soft", "flag", lambda f: (f.ratio >= f.profile.hard_ratio) & (f.ratio < f.profile.soft_ratio)),
    Rule("broken_encoding", "quarantine", _broken_encoding),
    Rule("mojibake_pattern", "quarantine", lambda f: f.has(L.MOJIBAKE)),
    Rule("url", "flag", lambda f: f.has(L.URL)),
    Rule("dense_social_shortlinks", "quarantine", _social_links),
    Rule("exam_keyword_stuffing", "quarantine", _exam, ("general_web", "qa", "unknown")),
    Rule("many_media_filenames", "quarantine", lambda f: f.count(L.MEDIA) >= 5),
    Rule("markup_noise", "quarantine", lambda f: f.count(L.TAG) >= 3),
    Rule("long_repeated_char", "flag", lambda f: f.has(rf"(?d)(.)\1{{{f.profile.repeated_char - 1},}}")),
    Rule("repeated_span", "quarantine", lambda f: T.repeated_spans(f.text) >= 2),
    Rule("low_char_diversity", "quarantine", lambda f: T.low_diversity(f.text)),
    Rule("gambling_spam", "quarantine", lambda f: f.has("(?d)" + any_of(L.GAMBLING))),
    Rule("mixed_topic_soup", "quarantine", _topic_soup, ("general_web",)),
    Rule("ad_contact_template", "flag", _ad_contact),
    Rule("seo_boilerplate_dense", "quarantine", lambda f: f.count(any_of(L.SEO)) >= 3, ("general_web", "qa", "wiki", "unknown")),
    Rule("commercial_promo_template", "quarantine", lambda f: F.col("_commercial"), ("general_web", "qa", "comment", "unknown")),
    Rule("medical_promo_template", "quarantine", _medical, _WEB),
    Rule("download_site_template", "quarantine", lambda f: F.col("_download"), _WEB),
    Rule("cracked_software_template", "quarantine", lambda f: f.has(f"(?d){L.CRACKED}") & ~f.has(f"(?d){L.CRACKED_NEGATED}"), ("general_web", "qa", "unknown")),
    Rule("content_farm_footer", "quarantine", lambda f: f.has(any_of(L.FARM_FOOTER)), ("general_web", "wiki", "unknown")),
    Rule("machine_translation_phrase_repetition", "quarantine", _helper_phrases, ("general_web", "qa", "wiki", "unknown")),
    Rule("legal_template_dense", "quarantine", _legal, _WEB),
    Rule("punctuation_dense", "quarantine", _punctuation),
    Rule("many_short_docs_structural", "drop", lambda f: f.count(r"<\|doc_sep\|>") >= 8),
)


def registry() -> list[dict[str, object]]:
    """Name, severity and scope of every rule, in order."""
    return [{"name": r.name, "severity": r.severity, "scope": list(r.scope) or ["all"]} for r in RULES]


def classify(df: DataFrame, text: str = "text", source_name: str = "source_name", source_type: str = "source_type", profile: Profile = ZH, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with source_kind, flags (names in registry order) and decision ('keep', 'quarantine', 'drop').

    Columns of these names are replaced. A null text counts as empty; null sources are of kind 'unknown'.
    """
    d = df.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_key": source_key(F.col(source_name), F.col(source_type))})
    d = d.withColumns({"source_kind": source_kind(F.col("_key")), "_length": T.visible_chars(F.col("_text")), "_han": T.count_chars(F.col("_text"), profile.script)})
    d = d.withColumn("_ratio", T.ratio(F.col("_han"), F.col("_length")))
    f = Facts(F.col("_text"), F.col("source_kind"), F.col("_key"), profile)
    # Two tests that other rules read as well.
    d = d.withColumns({"_commercial": _commercial(f), "_download": _download(f)})
    hits = F.filter(F.array(*(F.when(r.hits(f), F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules)), lambda x: x.isNotNull())
    of = lambda s: F.exists("_hits", lambda x: x.severity == s)
    return d.withColumn("_hits", hits).withColumns({"flags": F.transform("_hits", lambda x: x["name"]), "decision": F.when(of("drop"), "drop").when(of("quarantine"), "quarantine").otherwise("keep")}).drop("_text", "_key", "_hits", "_length", "_han", "_ratio", "_commercial", "_download")


# Other predicates.

#: Furniture, news, law and search-engine marks of the short flag lists.
NEWS_WIRE = "(?d)据.+?报道|来源[:：]|新华社|中新网|央视新闻|记者从"
LAW_CONTEXT = "规定|办法|条例|人民法院|合同|赔偿|清算|债务|责任"


def _array_of(flags: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())


def noise_flags(text: Column, script: str = T.HAN_BMP, repeated: int = 9) -> Column:
    """Names of up to twelve kinds of noise, in order."""
    t = F.coalesce(text, F.lit(""))
    return _array_of({
        "too_short": F.length(t) < 10,
        "low_chinese_ratio": T.ratio(T.count_chars(t, script), T.visible_chars(t)) < 0.2,
        "url": T.has(t, r"https?://|www\."),
        "web_boilerplate": T.has(t, "版权所有|ICP备案|责任编辑|网站地图|联系我们"),
        "news_wire_style": T.has(t, NEWS_WIRE),
        "legal_template": T.has(t, L.LEGAL_ARTICLE) & T.has(t, LAW_CONTEXT),
        "seo_boilerplate": T.has(t, "免责声明|相关阅读|点击查看|更多相关|本文链接|未经授权"),
        "markup_noise": T.has(t, r"<[^>]{1,80}>|\{\||\|\}|class=|style="),
        "many_media_filenames": T.count(t, r"(?i)\.(?:jpg|jpeg|png|gif|webp)(?U:\b)") >= 5,
        "repeated_char": T.has(t, rf"(?d)(.)\1{{{repeated - 1},}}"),
        "repeated_span": T.repeated_spans(t, squeeze_first=False, least=50) >= 1,
        "replacement_char": T.has(t, r"\x{fffd}"),
    })


HARD_DROP = ("below_min_chars", "low_chinese_ratio_hard_drop", "replacement_char", "legal_template", "seo_boilerplate", "markup_noise", "many_media_filenames", "repeated_span")


def keep_flags(text: Column, min_chars: int, script: str = T.HAN_BMP) -> Column:
    t = F.coalesce(text, F.lit(""))
    extra = _array_of({"below_min_chars": F.length(t) < min_chars, "low_chinese_ratio_hard_drop": T.ratio(T.count_chars(t, script), T.visible_chars(t)) < 0.15})
    return F.concat(noise_flags(t, script), extra)


def should_keep(text: Column, min_chars: int, script: str = T.HAN_BMP) -> Column:
    return ~F.arrays_overlap(keep_flags(text, min_chars, script), F.array(*map(F.lit, HARD_DROP)))


def audit_flags(text: Column) -> Column:
    """The seven flags of the audit."""
    t = F.coalesce(text, F.lit(""))
    return _array_of({
        "replacement_char": T.has(t, r"\x{fffd}"),
        "url": T.has(t, r"https?://|www\."),
        "news_wire_style": T.has(t, NEWS_WIRE),
        "punctuation_space": T.has(t, rf"[，。！？；：、,.!?;:]{T.WS}+[\x{{3400}}-\x{{9fff}}A-Za-z0-9~～…]"),
        "many_media_filenames": T.count(t, r"(?i)\.(?:jpg|jpeg|png|gif|webp)(?U:\b)") >= 5,
        "long_repeated_char": T.has(t, r"(?d)(.)\1{10,}"),
        "repeated_span": T.repeated_spans(t, squeeze_first=False, least=50) >= 1,
    })


def length_ratio_reason(text: Column, min_len: int, max_len: int, min_ratio: float, truncate: bool = False, script: str = T.HAN_BMP) -> Column:
    """'too_short', 'too_long' (unless long texts are cut) or 'low_ratio'; null where the text passes."""
    n = F.length(text)
    low = T.ratio(T.count_chars(text, script), T.visible_chars(text)) < min_ratio
    return F.when(F.coalesce(n, F.lit(0)) < min_len, "too_short").when(F.lit(not truncate) & (n > max_len), "too_long").when(low, "low_ratio")


def line_reason(line: Column, min_len: int = 5, max_len: int = 400, min_ratio: float = 0.3, script: str = T.HAN_BMP) -> Column:
    """The first reason to reject a corpus line, or null."""
    n = F.length(line)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(n < min_len, "too_short")
        .when(n > max_len, "too_long")
        .when(T.ratio(T.count_chars(line, script), T.visible_chars(line)) < min_ratio, "low_ratio")
        .when(T.has(line, r"(?d)(.)\1{9,}"), "repetitive")
    )


#: Words by which a text is scored for a category, in order of priority.
CATEGORIES = {
    "formal": ["通知", "意见", "办法", "规定", "部门", "单位", "工作", "实施", "管理", "会议"],
    "legal": ["法院", "判决", "合同", "原告", "被告", "法律", "诉讼", "条款", "仲裁", "赔偿"],
    "medical": ["医院", "患者", "治疗", "症状", "医生", "药物", "疾病", "手术", "复诊", "门诊"],
    "recruitment": ["招聘", "岗位", "简历", "面试", "薪资", "任职", "应聘"],
    "news": ["记者", "报道", "新华社", "中新网", "消息", "发布", "据"],
    "encyclopedia": ["是指", "位于", "属于", "又称", "定义", "简介", "起源"],
}
DIALOGISH = ["我觉得", "你觉得", "吗？", "怎么办", "哈哈", "老哥", "这波", "评论", "网友", "帖子", "回复", "楼主", "up主", "宝贝", "亲"]
NEWS_CONTEXT = "(?d)据.+报道|记者|新华社|中新网|当地时间|消息称|发布消息|红网时刻"
QUESTION_FORM = "什么是|如何|为什么|有哪些|怎么申请|怎么治疗|怎么分配|注意事项|具体步骤"


def category_scores(text: Column, categories: dict[str, list[str]] = CATEGORIES) -> Column:
    """STRUCT of how many words of each category the text holds, with the two adjustments."""
    t = F.coalesce(text, F.lit(""))
    s = {k: reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in words)) for k, words in categories.items()}
    if "news" in s:
        s["news"] = F.when(T.has(t, NEWS_CONTEXT), s["news"]).otherwise(F.greatest(s["news"] - 1, F.lit(0)))
    if "encyclopedia" in s:
        s["encyclopedia"] = s["encyclopedia"] + F.when(T.has(t, QUESTION_FORM), 2).otherwise(0)
    return F.struct(*(c.alias(k) for k, c in s.items()))


def category(text: Column, categories: dict[str, list[str]] = CATEGORIES, least: int = 2) -> Column:
    scores = category_scores(text, categories)
    out = F
    for k in categories:
        out = out.when(scores[k] >= least, k)
    return out.when(T.has(text, any_of(DIALOGISH)), "natural_dialogish").otherwise("natural_web")


#: Words of official style.
OFFICIAL = ["国务院", "人民政府", "各单位", "通知", "办法", "条例", "实施意见", "领导小组", "贯彻落实", "工作方案", "批复"]
FORMAL_STYLE = "特此通知|现将|有关规定|贯彻|落实|经研究决定"


def official_score(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    words = reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in OFFICIAL))
    return words * 2 + T.count(t, FORMAL_STYLE) + F.least(F.floor(T.count(t, "[，。；：、]") / 12), F.lit(3)).cast("int")


SEO_LINE = "免责声明|相关阅读|上一篇|下一篇|相关推荐|本文关键词|责任编辑|点击查看|相关链接"
WIKI_LINE = r"(?i)\{\{|\}\}|\{\||\|\}|thumb|\d{2,4}px\||File:|Image:|文件:|图片:|\.(?:jpg|jpeg|png|gif)\||https?://|www\.|</?references|\[\[|\]\]|外部链接|参考资料|参考来源"
AD_LINE = "代肝|代练|价格私聊|接单私聊|陪玩接单|有需要私我|推广兼职|兼职.{0,20}私我|私聊.{0,20}接单"
DAMAGED = r"[\x{e000}-\x{f8ff}\x{fffd}\x{7f}]"
SPACED_RUN = r"(?:[\x{3400}-\x{9fff}][\t \x{a0}\x{3000}]+){3,}[\x{3400}-\x{9fff}]"
RESIDUE = r"(?i)!\[|<table|</td>|rowspan|colspan|\{\{|\}\}|\bimage:|\|\s*[A-Za-z_][\w -]{0,24}\s*=|(?:autostart|loop|leftbg|rightbg|track|border)\s*="
FORMAL_DOC = "有限公司|公司简介|经营范围|营业执照|增值税|发票|国家税务总局|本办法|本条例|记者|新华社|中新网|公开招聘|法律依据|律师|法院"


def quality_gate(df: DataFrame, text: str = "text", category_: str = "category") -> DataFrame:
    """df with gated (the text after the line filters of its category, null where dropped), gate_reason and removed_lines.

    Line filters: wiki residue for 'acg_wiki', advertisements for 'bilibili_comment', page furniture for the two 'natural_' categories.
    """
    c = F.col(category_)
    t = T.repair_spacing(F.coalesce(F.col(text), F.lit("")))
    d = df.withColumn("_t", t)
    filtered = c.isin("acg_wiki", "bilibili_comment", "natural_web", "natural_dialogish")
    parts = F.filter(F.transform(F.split("_t", r"\r\n|\r|\n"), T.strip), lambda x: F.length(x) > 0)
    bad = lambda x: F.when(c == "acg_wiki", T.has(x, WIKI_LINE) | T.has(x, DAMAGED)).when(c == "bilibili_comment", T.has(x, AD_LINE)).otherwise(T.has(x, SEO_LINE))
    d = d.withColumn("_lines", parts).withColumn("_kept", F.filter("_lines", lambda x: ~bad(x)))
    d = d.withColumn("removed_lines", F.when(filtered, F.size("_lines") - F.size("_kept")).otherwise(0)).withColumn("_g", F.when(filtered, F.array_join("_kept", "\n")).otherwise(F.col("_t")))
    g = F.col("_g")
    ratio = T.chinese_ratio(g, "all")
    reason = (
        F.when(T.has(F.col("_t"), DAMAGED), "encoding_damaged")
        .when((c == "acg_wiki") & ((F.length(g) < 80) | (ratio < 0.25)), "acg_wiki")
        .when((c == "bilibili_comment") & ((F.length(g) < 20) | (ratio < 0.18)), "bilibili")
        .when(c.isin("natural_web", "natural_dialogish") & (F.length(g) < 80), "seo_empty")
        .when(c.isin("natural_web", "natural_dialogish") & T.has(g, FORMAL_DOC), "formal")
        .when(T.has(g, SPACED_RUN), "cjk_spaced")
        .when(T.has(g, RESIDUE), "structured_residue")
    )
    return d.withColumn("gate_reason", reason).withColumn("gated", F.when(F.col("gate_reason").isNull(), g)).drop("_t", "_lines", "_kept", "_g")
