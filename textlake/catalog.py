"""Every core query by name, with the SQL that checks it. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import audit, bytebpe, dedup, folds, mixture, rules, runs, tokens, vectors
from textlake.operators import lexicons as L
from textlake.plans import pipelines
from textlake.runtime import materialize, shared_dir, spread, table
from textlake.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several checks share.

WS = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
COMPACT = rf"regexp_replace(t, '{WS}+', '', 'g')"
LEN = f"length({COMPACT})"


def _chars(cls: str, of: str = "t") -> str:
    return f"(length({of}) - length(regexp_replace({of}, '{cls}', '', 'g')))"


def _share(cls: str) -> str:
    return f"case when n > 0 then {_chars(cls)}::double / n else 0.0 end"


def _from(source: str) -> str:
    return f"d as (select *, coalesce(text, '') as t from {source}), e as (select *, {LEN} as n from d)"


ADAPTED = _from("adapted_document")
HAN, LETTERS = r"[\x{4e00}-\x{9fff}]", r"[\x{4e00}-\x{9fff}\p{Latin}]"


def _kind_sql() -> str:
    cases = " ".join(f"when regexp_matches(k, '{'|'.join(marks)}') then '{kind}'" for kind, marks in L.SOURCE_KINDS)
    return f"case {cases} else 'unknown' end"


WINDOWS = "list_filter(list_transform(range(1, greatest(length(c) - 79, 1), 40), lambda i: c[i:i+79]), lambda x: length(x) >= 60)"
#: A word border as Java's patterns see it, for the one word that needs it.
_LINE = r"(?:^|[^\p{L}\p{N}_])LINE(?:$|[^\p{L}\p{N}_])"


def _re(p: list[str] | str) -> str:
    return L.any_of(p).replace(r"\bLINE\b", _LINE).replace("'", "''")


def _has(p: list[str] | str, of: str = "t", flags: str = "") -> str:
    return f"regexp_matches({of}, '{flags}{_re(p)}')"


def _count(p: list[str] | str, of: str = "t", flags: str = "") -> str:
    return f"len(regexp_extract_all({of}, '{flags}{_re(p)}'))"


def _times(words: list[str]) -> str:
    return "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")"


def _kinds(*names: str) -> str:
    return "kind in (" + ", ".join(f"'{n}'" for n in names) + ")"


def _among(m: str, words: list[str]) -> str:
    return f"len(list_intersect({m}, [" + ", ".join(f"'{w}'" for w in words) + "]))"


def _runs(n: int) -> str:
    """Whether one character other than a line feed stands n times in a row; l holds the characters. Few places pass the first test."""
    ends = f"list_filter(range(1, len(l) - {n - 2}), lambda i: l[i] = l[i + 1] and l[i] = l[i + {n - 1}])"
    return f"len(list_filter({ends}, lambda i: l[i] <> chr(10) and len(list_distinct(l[i:i + {n - 1}])) = 1)) > 0"


def _rule_tests() -> dict[str, str]:
    """Every rule of the registry as a condition on the columns of FLAGS."""
    plain = f"regexp_replace(regexp_replace(t, '{L.RULE_LINE}', ' ', 'g'), '{L.RULE_RUN}', ' ', 'g')"
    punct = r"\p{P}"
    topics = " + ".join(f"{_has(w)}::int" for w in L.TOPICS.values())
    giveaway = f"len(list_filter(range(1, length(t) + 1), lambda i: regexp_matches(t[i:i + 60], '^{_re(L.GIVEAWAY)}') and not regexp_matches(case when i > 1 then t[greatest(i - 13, 1):i - 1] else '' end, '{_re(L.GIVEAWAY_NEGATION)}[^\\n]{{0,11}}$'))) > 0"
    services = f"(len(business) >= 5 and len(list_distinct(business)) >= 3 or len(business) >= 3 and len(list_distinct(business)) >= 2 and {_has(L.BUSINESS_CUE)})"
    strong = f"(len(product) >= 7 and len(list_distinct(product)) >= 3 and (direct or {_has(L.PURCHASE_CUE.removeprefix('(?i)'), flags='(?i)')}))"
    sales = f"(len(product) >= 6 and {_among('product', L.PRODUCT_PROMO)} >= 2 and ({strong} or {_among('product', L.PRODUCT_SALES)} >= 1 and {_has(L.PRODUCT_PAIR)}))"
    commercial = f"((({_has(L.COMMERCIAL)} or {_has(L.ENROLMENT)}) and not negated) or {services} or {sales})"
    n = _count(L.DOWNLOAD)
    download = f"({n} >= 5 or {n} >= 3 and {_has(L.DOWNLOAD_CUE.removeprefix('(?i)'), flags='(?i)')} or {n} >= 3 and {_has('下载|游戏')} and {_count('可以帮助')} >= 4)"
    call = f"({_has(L.PHONE)} and {_has(L.PHONE_CALL, flags='(?i)')})"
    weak = f"({_count(L.WEAK_CONTACT)} >= 2 and {_count(L.SEO)} >= 2)"
    contact = f"(direct or {call} or {_count(L.CONTACT, flags='(?i)')} >= 2 and ({call} or {_has(L.URL.removeprefix('(?i)'), flags='(?i)')}) or {weak})"
    window = f"regexp_extract(t, '{_re(L.MEDICAL_PROVIDER)}')"
    provider = f"({window} <> '' and {_has(L.MEDICAL_CUE)} and ({_has(L.MEDICAL_STRONG, window)} or len(list_distinct(regexp_extract_all({window}, '{_re(L.MEDICAL_TERM)}'))) >= 2))"
    title = f"regexp_extract(t[1:260], '{_re(L.COURT_TITLE)}')"
    helper = _count(L.HELPER)
    top = "list_max(map_values(list_histogram(string_split(c, ''))))"
    kinds = "len(list_distinct(string_split(c, '')))::double / length(c)"
    return {
        "too_short": "n < case when kind in ('dialogue_short', 'dialogue', 'qa', 'wiki') then 8 else 20 end",
        "short_social_dialogue": f"{_kinds('dialogue_short')} and n < 80",
        "low_chinese_ratio_hard": "r < 0.15",
        "low_chinese_ratio_soft": "r >= 0.15 and r < 0.35",
        "broken_encoding": rf"bad >= 20 or bad >= 5 and bad::double / nullif(n, 0) > 0.03 or {_chars(chr(92) + 'p{Co}')}::double / nullif(n, 0) > 0.03",
        "mojibake_pattern": _has(L.MOJIBAKE),
        "url": r"regexp_matches(t, '(?i)https?://|www\.')",
        "dense_social_shortlinks": f"case when {_count(L.SHORT_LINK.removeprefix('(?i)'), flags='(?i)')} < 2 then false else (not (not ({giveaway}) and not {_has(L.SOCIAL_COMMERCE)} and {_count(L.MENTION)} = 0 and {_has(L.PUBLIC_NOTICE)})) and (({giveaway}) or {_has(L.SOCIAL_COMMERCE)} or {_count(L.SHORT_LINK.removeprefix('(?i)'), flags='(?i)')} >= 3 and {_count(L.MENTION)} >= 2 and length(t) < 1200 or {_count(L.SHORT_LINK.removeprefix('(?i)'), flags='(?i)')} >= 5 and length(t) < 800) end",
        "exam_keyword_stuffing": f"{_kinds('general_web', 'qa', 'unknown')} and ({_has(L.EXAM_TEMPLATE)} or length(q) >= 6 and {_has(L.EXAM_MARKS)} and (length(c) - length(replace(c, q, ''))) // nullif(length(q), 0) >= 3)",
        "many_media_filenames": r"len(regexp_extract_all(t, '(?i)\.(?:jpg|jpeg|png|gif|webp|mp4|avi|mov)(?:[^\p{L}\p{N}_]|$)')) >= 5",
        "markup_noise": r"len(regexp_extract_all(t, '<[^>\n]{1,120}>')) >= 3",
        "long_repeated_char": _runs(10),
        "repeated_span": f"length(c) >= 240 and len({WINDOWS}) - len(list_distinct({WINDOWS})) >= 2",
        "low_char_diversity": f"case when length(c) < 500 then false when {kinds} < 0.03 then true else {kinds} < 0.05 and {top}::double / length(c) > 0.18 end",
        "gambling_spam": _has(L.GAMBLING),
        "mixed_topic_soup": f"{_kinds('general_web')} and contains(k, 'cci3') and length(t) >= 700 and ({topics}) >= 5 and ({_count('[。！？!?]')} >= 8 or {_count('[，,]')} >= 30)",
        "ad_contact_template": f"(({_has(L.PROMO_CONTEXT, flags='(?i)')} and not negated) or {commercial} or {download}) and {contact}",
        "seo_boilerplate_dense": f"{_kinds('general_web', 'qa', 'wiki', 'unknown')} and {_count(L.SEO)} >= 3",
        "commercial_promo_template": f"{_kinds('general_web', 'qa', 'comment', 'unknown')} and {commercial}",
        "medical_promo_template": f"{_kinds('general_web', 'unknown')} and not {_has(L.MEDICAL_NEGATED)} and ({provider} or {_has(L.MEDICAL_PRODUCT)} or {_has(L.MEDICAL_SERVICE)})",
        "download_site_template": f"{_kinds('general_web', 'unknown')} and {download}",
        "cracked_software_template": f"{_kinds('general_web', 'qa', 'unknown')} and {_has(L.CRACKED)} and not {_has(L.CRACKED_NEGATED)}",
        "content_farm_footer": f"{_kinds('general_web', 'wiki', 'unknown')} and {_has(L.FARM_FOOTER)}",
        "machine_translation_phrase_repetition": f"{_kinds('general_web', 'qa', 'wiki', 'unknown')} and {helper} >= 14 and {helper} / greatest(length(t) / 1000.0, 1.0) >= 3.0",
        "legal_template_dense": f"{_kinds('general_web', 'unknown')} and not {_has(L.COURT_NEGATED)} and ({title} <> '' and (contains(t[1:260], '人民法院') or regexp_matches({title}, '民\\s*事|刑\\s*事|行\\s*政')) or {_has(L.COURT_CONTEXT)} and ({_times(L.COURT_MARKS)} >= 3 and {_times(L.COURT_ROLES)} >= 6 or {_count('被告')} >= 5 and {_has('公诉|检察')} or {_count(L.LEGAL_ARTICLE)} >= 16 and {_times(L.COURT_MARKS)} >= 2))",
        "punctuation_dense": f"n >= 80 and {_chars(punct)}::double / n > 0.35 and not ({_kinds('qa', 'dialogue')} and {_has(L.PUNCT_EXCUSES)}) and (select length(regexp_replace(p, '{WS}+', '', 'g')) >= 80 and {_chars(punct, 'p')}::double / length(regexp_replace(p, '{WS}+', '', 'g')) > 0.35 from (select {plain} as p))",
        "many_short_docs_structural": r"len(regexp_extract_all(t, '<\|doc_sep\|>')) >= 8",
    }


def _flags(source: str = "adapted_document") -> str:
    """CTEs that end in h: the rows of source with kind, flags and decision by all rules."""
    tests = _rule_tests()
    severity = {r.name: r.severity for r in rules.RULES}
    named = lambda s: ", ".join(f"'{k}'" for k in tests if severity[k] == s)
    cases = ",\n   ".join(f"case when {tests[r.name]} then '{r.name}' end" for r in rules.RULES)
    question = r"regexp_extract(t, '^(?:.{4,40}?[？?。]|.{4,40}?（）)')"
    return f"""{_from(source)},
 k as (select *, lower(coalesce(source_name, '') || ' ' || coalesce(source_type, '')) as k, {COMPACT} as c, {_share(LETTERS)} as r, {_chars(chr(0xFFFD))} as bad, string_split(t, '') as l, regexp_replace({question}, '{WS}+', '', 'g') as q,
   regexp_extract_all(t, '{_re(L.BUSINESS)}') as business, regexp_extract_all(t, '{_re(L.PRODUCT)}') as product, {_has(L.DIRECT_CONTACT, flags='(?i)')} as direct, {_has(L.PROMO_NEGATED)} as negated from e),
 f as (select *, {_kind_sql()} as kind from k),
 g as (select *, list_filter([{cases}], lambda x: x is not null) as flags from f),
 h as (select *, case when len(list_intersect(flags, [{named('drop')}])) > 0 then 'drop' when len(list_intersect(flags, [{named('quarantine')}])) > 0 then 'quarantine' else 'keep' end as decision from g)"""


FLAGS = _flags()


def adapted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "adapted_document")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return rules.classify(spread(adapted(spark, sf)), profile=rules.MIXED)


# Statistics and text.


@query(f"""with {ADAPTED} select row_id, n::int as length, round({_share(HAN)}, 9) as chinese_ratio, round({_share(chr(92) + 'p{P}')}, 9) as punct_ratio,
    round({_share('[A-Za-z]')}, 9) as latin_ratio, round({_share(chr(92) + 'p{Nd}')}, 9) as digit_ratio from e""")
def char_stats(spark, sf):
    d = adapted(spark, sf).select("row_id", T.char_stats(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("row_id", "s.length", *(F.round(f"s.{c}", 9).alias(c) for c in ("chinese_ratio", "punct_ratio", "latin_ratio", "digit_ratio")))


@query(rf"""with d as (select *, coalesce(text, '') as t from documents), e as (select *, {LEN} as n, {_chars(HAN)} as h from d)
    select doc_id, round({_share(HAN)}, 9) as plane, round({_share(T.HAN_ALL)}, 9) as extended, round(h::double / greatest(h + {_chars('[A-Za-z0-9]')}, 1), 9) as letters from e""")
def script_ratios(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.round(T.chinese_ratio(t), 9).alias("plane"), F.round(T.chinese_ratio(t, "all"), 9).alias("extended"), F.round(T.chinese_ratio(t, "letters"), 9).alias("letters"))


def _training(t: str) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    x = strip(rf"regexp_replace({t}, '\r\n?', chr(10), 'g')")
    for p, r in ((r"[ \t]+", " "), (rf"([，。！？；：、）】》」』]){WS}+", r"\1"), (rf"{WS}+([，。！？；：、（【《「『])", r"\1"), (rf"({HAN}){WS}+([A-Za-z0-9])", r"\1\2"), (rf"([A-Za-z0-9]){WS}+({HAN})", r"\1\2")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"select doc_id, sha1({_training('text')}) as h, length({_training('text')}) as n from documents where text is not null")
def normalized_training_text(spark, sf):
    t = T.normalize_training(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(t).alias("h"), F.length(t).cast("bigint").alias("n"))


def _clean(t: str) -> str:
    x = rf"regexp_replace(nfc_normalize({t}), '\r\n?', chr(10), 'g')"
    for p, r in ((r"(?:\$\s*P\s*\$)+", "chr(10)"), (r"(?i)<br\s*/?>", "chr(10)"), (r"[\x{200b}\x{200c}\x{200d}\x{feff}]", "''"), (r"[\x{01}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\p{Cf}\p{Co}]", "''")):
        x = f"regexp_replace({x}, '{p}', {r}, 'g')"
    return _training(x)


@query(f"select doc_id, sha1({_clean("coalesce(text, '')")}) as h from documents")
def normalized_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.normalize_clean(F.col("text"))).alias("h"))


@query("select doc_id, nfc_normalize(text) = text as composed, length(nfc_normalize(text)) as n from documents where text is not null")
def composed_text(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (T.nfc(F.col("text")) == F.col("text")).alias("composed"), F.length(T.nfc(F.col("text"))).cast("bigint").alias("n"))


_trim = lambda c: rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _subs(x: str, *pairs: tuple[str, str]) -> str:
    for p, r in pairs:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


_B = r"[\t \x{a0}\x{3000}]+"
_HAN2 = r"\x{3400}-\x{9fff}"
#: A pattern between two characters is replaced twice where matches may share a character.
_EMPHASIS = (rf"([~～…!！?？]){_B}([~～…!！?？])", r"\1\2")


def _repair(x: str) -> str:
    x = _subs(x, (_B + r"([，。！？；：、,.!?;:~～…）】》])", r"\1"), (rf"([，。！？；：、]){_B}([{_HAN2}A-Za-z0-9~～…])", r"\1\2"), (rf"([,.!?;:]){_B}([{_HAN2}])", r"\1\2"), _EMPHASIS, _EMPHASIS, (r"[ ]{2,}", " "))
    return _trim(x)


def _corpus_sql(x: str) -> str:
    b, cjk = r"[ \t]+", T.CJK
    x = _subs(f"regexp_replace(nfc_normalize({x}), '\\r\\n?', chr(10), 'g')", (r"[ \t\f\x{0b}]+", " "), (b + r"([，。！？；：、,.!?;:])", r"\1"), (rf"([，。！？；：、]){b}([{cjk}A-Za-z0-9“‘\"（(《])", r"\1\2"))
    for p in (rf"([{cjk}])([,.!?;:]){b}([{cjk}])", rf"([{cjk}])(){b}([{cjk}A-Za-z0-9])", rf"([A-Za-z0-9])(){b}([{cjk}])", rf"([…⋯])(){b}([…⋯])", rf"([·・])(){b}([·・])"):
        x = _subs(x, (p, r"\1\2\3"), (p, r"\1\2\3"))
    return _trim(f"regexp_replace({_subs(x, (r'[ ' + chr(92) + 't]{2,}', ' '))}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _lines(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\r\n|\r|\n')"


def _chat_sql(x: str) -> str:
    both = lambda p: ((p, r"\1\2"), (p, r"\1\2"))
    one = _trim(_subs(_repair(_trim("x")), *both(rf"([{_HAN2}]){WS}+([{_HAN2}A-Za-z0-9])"), *both(rf"([A-Za-z0-9]){WS}+([{_HAN2}])")))
    return _trim(f"array_to_string(list_transform({_lines(x)}, lambda x: {one}), chr(10))")


def _wiki_sql(x: str) -> str:
    s = r"[\s\x{0b}]"
    x = _subs(x, (r"(?s)\{\|.*?\|\}", " "), (r"\{\{[^{}]{0,600}\}\}", " "), (r"(?i)\[\[(?:分类|Category|文件|File|Image|图片):[^\]]+\]\]", " "), (r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"\[https?://[^\]\s\x{0b}]+(?:[\s\x{0b}]+([^\]]+))?\]", r"\1"), (r"''{2,}", ""))
    x = f"regexp_replace({x}, '==+[ \\t]*(.*?)[ \\t]*==+', chr(10) || '\\1' || chr(10), 'g')"
    x = _subs(x, (r"(?s)<ref[^>]*>.*?</ref>", " "), (r"<[^>]+>", " "))
    one = _trim(_subs(_trim("x"), (r"\{\{[^{}\n]*(?:\}\})?", " "), (rf"{s}{{2,}}", " ")))
    keep = rf"length(x) > 0 and not regexp_matches(x, '^(?:\{{\{{|\}}\}})') and not regexp_matches(x, '(?i)\d{{2,4}}px\||thumb|缩略图|外部链接|参考资料|注释|导航|相关条目') and not regexp_matches(x, '(?i)^\[?{s}*(?:链接|link){s}*\]?$') and not (x[1:1] = '[' and length(x) < 40) and not (regexp_matches(x, '^[*#|!;:]') and length(x) < 80)"
    return _trim(f"regexp_replace(array_to_string(list_filter(list_transform({_lines(x)}, lambda x: {one}), lambda x: {keep}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"select doc_id, sha1({_corpus_sql('text')}) as corpus, sha1({_chat_sql('text')}) as chat from documents where text is not null")
def corpus_spacing(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(T.normalize_corpus(F.col("text"))).alias("corpus"), F.sha1(T.repair_chat(F.col("text"))).alias("chat"))


@query(f"select doc_id, sha1({_wiki_sql('text')}) as h from documents where text is not null")
def wiki_text(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(T.clean_wiki(F.col("text"))).alias("h"))


@query()
def wide_text(spark, sf):
    """Normal form KC has no equal in the check's SQL."""
    return table(spark, sf, "documents").select("doc_id", F.length(T.normalize_wide(F.col("text"))).alias("wide"))


@query("""with t as (select dialogue_id, list_transform(coalesce(dialog, []), lambda x, i: case when trim(coalesce(x, ''), ' \t\n\r　') = '' then null
    when regexp_matches(trim(x, ' \t\n\r　'), '^(?:甲：|乙：|用户：|助手：)') then trim(x, ' \t\n\r　') else (case when i % 2 = 1 then '甲：' else '乙：' end) || trim(x, ' \t\n\r　') end) as l from dialogue_row)
    select dialogue_id, coalesce(array_to_string(list_filter(l, lambda x: x is not null), chr(10)), '') as text from t""".replace("\\u3000", "　").replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r"))
def dialogue_text(spark, sf):
    return table(spark, sf, "dialogue_row").select("dialogue_id", T.dialogue(F.col("dialog")).alias("text"))


@query(rf"""with p as (select *, '指令：' || coalesce(instruction, '') || case when length(input) > 0 then chr(10) || '输入：' || input else '' end as a, '回答：' || coalesce(output, '') as b from instruction_row)
    select instruction_id, {_trim('a')} || chr(10) || {_trim('b')} as text from p""")
def instruction_text(spark, sf):
    return table(spark, sf, "instruction_row").select("instruction_id", T.instruction(F.col("instruction"), F.col("output"), F.col("input")).alias("text"))


@query(rf"""with p as (select *, {_trim("coalesce(instruction, '')")} as q, {_trim("coalesce(input, '')")} as c from instruction_row),
    r as (select *, '问题：' || q || case when length(c) > 0 and not contains(q, c) then chr(10) || '补充：' || c else '' end as a, '回答：' || coalesce(output, '') as b from p)
    select instruction_id, {_trim('a')} || chr(10) || {_trim('b')} as text from r""")
def question_answer_text(spark, sf):
    return table(spark, sf, "instruction_row").select("instruction_id", T.question_answer(F.col("instruction"), F.col("output"), F.col("input")).alias("text"))


@query(rf"""with s as (select doc_id, {_trim("regexp_replace(text, '" + WS + "+', ' ', 'g')")} as s, replace(text, chr(10), ' / ') as p from documents where text is not null)
    select doc_id, case when length(s) > 360 then left(s, 360) || '...' else s end as short, case when length(p) > 240 then left(p, 240) || '...' else p end as preview from s""")
def short_texts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.shorten(F.col("text"), 360).alias("short"), T.preview(F.col("text")).alias("preview"))


@query("""with s as (select doc_id, left(text, 1000) as h, text from documents where text is not null)
    select doc_id, case when length(text) <= 1000 then text when contains(h, chr(10)) then left(h, length(h) - instr(reverse(h), chr(10))) else h end as cut from s""")
def cut_texts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.cut_at_newline(F.col("text"), 1000).alias("cut"))


@query("""with s as (select distinct source_name as s from adapted_document where source_name is not null)
    select s as source_name, regexp_replace(regexp_replace(s, '[^\\p{L}\\p{N}_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from s""")
def source_slugs(spark, sf):
    return adapted(spark, sf).where("source_name is not null").select("source_name").distinct().withColumn("slug", T.slug(F.col("source_name")))


@query(r"""select doc_id, case when length(text) > 1 then round(len(list_filter(range(1, length(text)), lambda i: text[i] = text[i + 1]))::double / (length(text) - 1), 9) else 0.0 end as repeated_char,
    case when length(text) > 2 then round(1.0 - len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: text[i:i+2])))::double / (length(text) - 2), 9) else 0.0 end as repeated_ngram
    from documents where text is not null""")
def repetition(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.round(T.repeated_char_ratio(t), 9).alias("repeated_char"), F.round(T.repeated_ngram_ratio(t), 9).alias("repeated_ngram"))


@query(rf"""with recursive a as (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') as l from documents where text is not null),
    f as (select doc_id, l, 1::bigint as i, []::varchar[] as done, []::varchar[] as open, 0::bigint as chars from a union all
      select doc_id, l, i + 1, case when flush then list_append(done, array_to_string(open, chr(10))) else done end, case when blank then []::varchar[] else list_append(case when flush then []::varchar[] else open end, line) end, case when blank then 0 else length(line) + case when flush then 0 else chars end end
      from (select *, length(line) = 0 as blank, len(open) > 0 and (length(line) = 0 or chars + length(line) > 400) as flush from (select *, regexp_replace(l[i], '[\s\x{{0b}}]+$', '') as line from f where i <= len(l)))),
    z as (select doc_id, list_filter(list_transform(case when len(open) > 0 then list_append(done, array_to_string(open, chr(10))) else done end, lambda x: {_trim('x')}), lambda x: length(x) > 0) as c from f where i = len(l) + 1),
    g as (select doc_id, c, 1::bigint as i, []::varchar[] as done, []::varchar[] as open from z union all
      select doc_id, c, i + 1, case when length(c[i]) >= 50 then list_append(case when len(open) > 0 then list_append(done, array_to_string(open, chr(10))) else done end, c[i]) else done end, case when length(c[i]) >= 50 then []::varchar[] else list_append(open, c[i]) end from g where i <= len(c)),
    y as (select doc_id, case when len(open) > 0 then list_append(done, array_to_string(open, chr(10))) else done end as d from g where i = len(c) + 1)
    select doc_id, (generate_subscripts(d, 1) - 1)::int as n, unnest(d) as chunk from y""")
def text_chunks(spark, sf):
    """A fold over lines."""
    c = folds.chunk_text(F.col("text"), 400)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(folds.merge_short_chunks(c)).alias("n", "chunk"))


@query("""with recursive a as (select dialogue_id, list_filter(dialog, lambda x: x is not null) as l from dialogue_row), f as (select dialogue_id, l, 1::bigint as i, []::varchar[] as done, []::varchar[] as open, 0::bigint as chars from a union all
    select dialogue_id, l, i + 1, case when shut then list_append(done, array_to_string(lines, chr(10))) else done end, case when shut then []::varchar[] else lines end, case when shut then 0 else n end
      from (select *, len(lines) >= 3 or n >= 120 as shut from (select *, list_append(open, l[i][1:60]) as lines, chars + length(l[i]) as n from f where i <= len(l)))),
    z as (select dialogue_id, case when len(open) > 0 then list_append(done, array_to_string(open, chr(10))) else done end as d from f where i = len(l) + 1)
    select dialogue_id, (generate_subscripts(d, 1) - 1)::int as n, unnest(d) as text from z""")
def grouped_turns(spark, sf):
    """A fold over turns."""
    return table(spark, sf, "dialogue_row").select("dialogue_id", F.posexplode(folds.group_short(F.col("dialog"), 3, 120, 60)).alias("n", "text"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type from events")
def record_fields(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", readers.field_of(v, "k", "bigint").alias("k"), "event_type")


@query("""with p as (select *, '指令：' || instruction || case when length(trim(input)) > 0 then chr(10) || '输入：' || trim(input) else '' end as a, '回答：' || output as b from instruction_row where length(trim(instruction)) > 0 and length(trim(output)) > 0)
    select instruction_id, trim(a) || chr(10) || trim(b) as text from p""".replace("trim(a)", "trim(a, ' \t\n\r')").replace("'指令：' || instruction", "'指令：' || trim(instruction, ' \t\n\r')").replace("'回答：' || output", "'回答：' || trim(output, ' \t\n\r')").replace("trim(input)", "trim(input, ' \t\n\r　')"))
def record_texts(spark, sf):
    """Records as variants, their text by the first shape that fits."""
    d = table(spark, sf, "instruction_row")
    v = F.parse_json(F.to_json(F.struct("instruction", "input", "output")))
    return d.select("instruction_id", readers.record_text(v).alias("text")).where("text is not null").where(F.startswith("text", F.lit("指令")))


@query(rf"""with b as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n{WS}*\n'), lambda x: {_trim('x')}), lambda x: length(x) > 0) as b, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: length(x) > 0) as l from documents where text is not null)
    select doc_id, len(case when len(b) > 1 then b else l end)::int as n, sha1(array_to_string(case when len(b) > 1 then b else l end, '|')) as h from b""")
def paragraphs(spark, sf):
    p = readers.paragraphs(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(p).alias("n"), F.sha1(F.array_join(p, "|")).alias("h"))


# Rules.


@query(f"with {FLAGS} select row_id, kind as source_kind, array_to_string(flags, ',') as flags, decision from h")
def rule_flags(spark, sf):
    return _decided(spark, sf).select("row_id", "source_kind", F.array_join("flags", ",").alias("flags"), "decision")


@query(f"""with {FLAGS}, i as (select unnest(list_concat([''], case when decision = 'keep' then list_transform(flags, lambda x: 'kept_with_' || x) else flags end)) as flag from h), j as (select flag, count(*) as n from i group by 1)
    select flag, n, round(n::double / (select n from j where flag = ''), 6) as share from j where flag <> ''""")
def rule_flag_histogram(spark, sf):
    return dedup.flag_histogram(_decided(spark, sf))


@query(f"""with {FLAGS}, i as (select *, case when decision = 'keep' then sha1({COMPACT}) else '#' || row_id end as key from h),
    j as (select *, row_number() over (partition by key order by row_id) > 1 as dup from i)
    select case when grouping(source_type) = 1 then 'all' else 'one' end as level, source_type, count(*) as seen, count(*) filter (decision = 'keep' and not dup) as kept, count(*) filter (decision = 'drop') as dropped,
    count(*) filter (decision = 'quarantine') as quarantined, count(*) filter (decision = 'keep' and dup) as duplicates, sum(n_) ::bigint as raw_chars, sum(case when decision = 'keep' and not dup then n_ else 0 end)::bigint as kept_chars,
    round(count(*) filter (decision = 'keep' and not dup)::double / count(*), 6) as keep_rate, round(coalesce(sum(case when decision = 'keep' and not dup then n_ else 0 end)::double / nullif(sum(n_), 0), 0), 6) as char_keep_rate
    from (select *, coalesce(length(text), 0) as n_ from j) group by rollup (source_type)""")
def clean_decision_summary(spark, sf):
    d = _decided(spark, sf)
    key = F.when(F.col("decision") == "keep", T.compact_key(F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("#"), F.col("row_id").cast("string")))
    return audit.clean_totals(dedup.mark_duplicates(d, key, F.col("row_id")), "source_type")


@query(f"with {FLAGS} select row_id, source_kind, array_to_string(flags, ',') as flags, decision from h")
def rule_decisions(spark, sf):
    """All 27 rules."""
    return _decided(spark, sf).select("row_id", "source_kind", F.array_join("flags", ",").alias("flags"), "decision")


@query(f"""with c as (select * replace ({_clean("coalesce(text, '')")} as text) from adapted_document), {_flags("c")}
    select row_id, decision, decision = 'keep' and row_number() over (partition by case when decision = 'keep' then {COMPACT} else '#' || row_id end order by row_id) > 1 as is_duplicate, sha1(text) as h from h""")
def cleaned_documents(spark, sf):
    """The whole cleaning pipeline with all rules."""
    d = pipelines.clean(adapted(spark, sf), "row_id", profile=rules.MIXED)
    return d.select("row_id", "decision", "is_duplicate", F.sha1("text").alias("h"))


_SPANS = f"list_filter(list_transform(range(1, greatest(length(t) - 79, 1), 40), lambda i: regexp_replace(t[i:i + 79], '{WS}+', '', 'g')), lambda x: length(x) >= 50)"
_TWICE = f"length(t) >= 240 and len({_SPANS}) - len(list_distinct({_SPANS})) >= 1"
_MEDIA5 = r"len(regexp_extract_all(t, '(?i)\.(?:jpg|jpeg|png|gif|webp)(?:[^\p{L}\p{N}_]|$)')) >= 5"
_NEWS = rules.NEWS_WIRE.removeprefix("(?d)")
_NOISE = {
    "too_short": "length(t) < 10", "low_chinese_ratio": f"({_share(LETTERS)}) < 0.2", "url": r"regexp_matches(t, 'https?://|www\.')", "web_boilerplate": "regexp_matches(t, '版权所有|ICP备案|责任编辑|网站地图|联系我们')", "news_wire_style": f"regexp_matches(t, '{_NEWS}')",
    "legal_template": f"regexp_matches(t, '{L.LEGAL_ARTICLE}') and regexp_matches(t, '{rules.LAW_CONTEXT}')", "seo_boilerplate": "regexp_matches(t, '免责声明|相关阅读|点击查看|更多相关|本文链接|未经授权')", "markup_noise": r"regexp_matches(t, '<[^>]{1,80}>|\{\||\|\}|class=|style=')",
    "many_media_filenames": _MEDIA5, "repeated_char": _runs(9), "repeated_span": _TWICE, "replacement_char": "contains(t, chr(65533))",
}
_AUDIT = {k: _NOISE[k] for k in ("replacement_char", "url", "news_wire_style")} | {
    "punctuation_space": rf"regexp_matches(t, '[，。！？；：、,.!?;:]{WS}+[\x{{3400}}-\x{{9fff}}A-Za-z0-9~～…]')", "many_media_filenames": _MEDIA5, "long_repeated_char": _runs(11), "repeated_span": _TWICE,
}


def _listed(tests: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {t} then '{k}' end" for k, t in tests.items()) + "], lambda x: x is not null)"


@query(f"""with {ADAPTED}, m as (select *, string_split(t, '') as l from e), f as (select row_id, {_listed(_NOISE)} as flags, {_listed(_AUDIT)} as audit, {_listed({"below_min_chars": "length(t) < 20", "low_chinese_ratio_hard_drop": f"({_share(LETTERS)}) < 0.15"})} as extra from m)
    select row_id, array_to_string(flags, ',') as flags, array_to_string(audit, ',') as audit, not list_has_any(flags || extra, [{", ".join(f"'{x}'" for x in rules.HARD_DROP)}]) as keep from f""")
def noise_flags(spark, sf):
    return adapted(spark, sf).select("row_id", F.array_join(rules.noise_flags(F.col("text"), rules.MIXED.script), ",").alias("flags"), F.array_join(rules.audit_flags(F.col("text")), ",").alias("audit"), rules.should_keep(F.col("text"), 20, rules.MIXED.script).alias("keep"))


@query(rf"""with {ADAPTED} select row_id, case when length(t) < 80 then 'too_short' when length(t) > 2600 then 'too_long' when {_share(LETTERS)} < 0.3 then 'low_ratio' end as reason from e""")
def length_ratio_filter(spark, sf):
    return adapted(spark, sf).select("row_id", rules.length_ratio_reason(F.coalesce("text", F.lit("")), 80, 2600, 0.3, script=rules.MIXED.script).alias("reason"))


@query(rf"""with l0 as (select unnest(string_split(text, chr(10))) as s from documents where text is not null), m as (select {_trim('s')} as t from l0), e as (select *, {LEN} as n, string_split(t, '') as l from m)
    select case when length(t) = 0 then 'empty' when length(t) < 5 then 'too_short' when length(t) > 400 then 'too_long' when {_share(LETTERS)} < 0.3 then 'low_ratio' when {_runs(10)} then 'repetitive' else 'kept' end as reason, count(*) as lines from e group by 1""")
def line_reject_counts(spark, sf):
    lines = table(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("s")).select(T.strip(F.col("s")).alias("t"))
    r = F.coalesce(rules.line_reason(F.col("t"), script=rules.MIXED.script), F.lit("kept"))
    return lines.select(r.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def _category_sql() -> str:
    score = {k: " + ".join(f"contains(t, '{w}')::int" for w in words) for k, words in rules.CATEGORIES.items()}
    score["news"] = f"case when regexp_matches(t, '据.+报道|记者|新华社|中新网|当地时间|消息称|发布消息|红网时刻') then {score['news']} else greatest({score['news']} - 1, 0) end"
    score["encyclopedia"] = f"{score['encyclopedia']} + case when regexp_matches(t, '{rules.QUESTION_FORM}') then 2 else 0 end"
    cases = " ".join(f"when ({score[k]}) >= 2 then '{k}'" for k in rules.CATEGORIES)
    return f"case {cases} when regexp_matches(t, '{'|'.join(rules.DIALOGISH)}') then 'natural_dialogish' else 'natural_web' end"


@query(f"with d as (select *, coalesce(text, '') as t from documents) select doc_id, {_category_sql()} as category from d")
def document_category(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.category(F.coalesce("text", F.lit(""))).alias("category"))


_SPLIT = f"list_filter(list_transform({_lines('t')}, lambda x: {_trim('x')}), lambda x: length(x) > 0)"


@query(f"""with d as (select doc_id, coalesce(text, '') as t from documents), a as (select doc_id, {_category_sql()} as category, {_repair('t')} as t from d), b as (select *, category in ('natural_web', 'natural_dialogish') as nat, {_SPLIT} as l from a),
    c as (select *, list_filter(l, lambda x: not regexp_matches(x, '{rules.SEO_LINE}')) as k from b), g as (select *, case when nat then array_to_string(k, chr(10)) else t end as g, case when nat then len(l) - len(k) else 0 end as removed_lines from c),
    r as (select *, case when regexp_matches(t, '{rules.DAMAGED}') then 'encoding_damaged' when nat and length(g) < 80 then 'seo_empty' when nat and regexp_matches(g, '{rules.FORMAL_DOC}') then 'formal' when regexp_matches(g, '{rules.SPACED_RUN}') then 'cjk_spaced' when regexp_matches(g, '{rules.RESIDUE}') then 'structured_residue' end as gate_reason from g)
    select doc_id, category, gate_reason, removed_lines::int as removed_lines, case when gate_reason is null then length(g) end::int as n from r""")
def quality_gate(spark, sf):
    d = table(spark, sf, "documents").withColumn("category", rules.category(F.coalesce("text", F.lit(""))))
    return rules.quality_gate(d).select("doc_id", "category", "gate_reason", "removed_lines", F.length("gated").alias("n"))


@query("""with d as (select *, coalesce(text, '') as t from documents) select doc_id, (""" + " + ".join(f"contains(t, '{w}')::int" for w in rules.OFFICIAL) + f""") * 2 + len(regexp_extract_all(t, '{rules.FORMAL_STYLE}'))
    + least(len(regexp_extract_all(t, '[，。；：、]')) // 12, 3) as score from d""")
def official_style(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.official_score(F.col("text")).cast("bigint").alias("score"))


# De-duplication.


@query("select row_id, source_name from adapted_document where text is not null qualify row_number() over (partition by sha1(text) order by row_id) = 1")
def exact_dedup(spark, sf):
    return dedup.first_wins(adapted(spark, sf).where("text is not null"), T.exact_key(F.col("text")), F.col("row_id")).select("row_id", "source_name")


@query(f"with d as (select *, text as t from adapted_document where text is not null) select row_id, source_name from d qualify row_number() over (partition by sha1({COMPACT}) order by fetched_at, row_id) = 1")
def compact_dedup(spark, sf):
    return dedup.first_wins(adapted(spark, sf).where("text is not null"), T.compact_key(F.col("text")), F.col("fetched_at"), F.col("row_id")).select("row_id", "source_name")


@query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null), m as (select doc_id, line_no, {_trim('s')} as line from l)
    select doc_id, line_no::int as line_no, line from m where line <> '' qualify row_number() over (partition by line order by doc_id, line_no) = 1""")
def line_dedup(spark, sf):
    return dedup.distinct_lines(table(spark, sf, "documents").where("text is not null"), "doc_id")


@query("""with a as (select text from adapted_document where text is not null and date_diff('day', fetched_at, ingested_at) < 2)
    select row_id from adapted_document where text is not null and date_diff('day', fetched_at, ingested_at) >= 2 and sha1(text) not in (select sha1(text) from a)""")
def incremental_dedup(spark, sf):
    """Late rows whose text no earlier row has."""
    d = adapted(spark, sf).where("text is not null").withColumn("late", F.datediff("ingested_at", "fetched_at") >= 2)
    return dedup.not_seen(d.where("late"), d.where("not late"), T.exact_key(F.col("text")), T.exact_key(F.col("text"))).select("row_id")


@query("""select source_name, count(*) as loaded, count(*) filter (s = 'kept') as kept, count(*) filter (s = 'empty') as empty, count(*) filter (s = 'filtered') as filtered, count(*) filter (s = 'duplicate') as duplicate from (
    select source_name, case when coalesce(text, '') = '' then 'empty' when length(text) < 20 then 'filtered' when row_number() over (partition by coalesce(text, '') order by row_id) > 1 then 'duplicate' else 'kept' end as s from adapted_document) group by 1""")
def load_report(spark, sf):
    t = F.coalesce("text", F.lit(""))
    d = dedup.mark_duplicates(adapted(spark, sf), F.sha1(t), F.col("row_id"))
    status = F.when(t == "", "empty").when(F.length(t) < 20, "filtered").when(F.col("is_duplicate"), "duplicate").otherwise("kept")
    return audit.load_report(d, "source_name", status)


# Limits and mixtures.


def text_length():
    return F.coalesce(F.length("text"), F.lit(0)).cast("bigint")


_before = "coalesce(sum({v}) over (partition by {k} order by row_id rows between unbounded preceding and 1 preceding), 0)"


@query(f"""select row_id from (select row_id, {_before.format(v="coalesce(length(text), 0)", k="source_name")} as b, row_number() over (partition by source_name order by row_id) as r from adapted_document) where b < 20000 and r <= 60""")
def source_prefix_limit(spark, sf):
    """At most 60 rows and 20,000 characters of each source."""
    return mixture.limit_documents(adapted(spark, sf), "row_id", text_length(), 60, 20_000, ["source_name"]).select("row_id")


QUOTAS = {"general_web_backbone": 150_000, "wiki": 60_000, "qa": 40_000, "comment": 5_000}
CAPS = {"qingyan_web": 50_000, "zhuxi_wiki": 30_000}


def _case(limits: dict[str, int], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in limits.items()) + " end"


@query(f"""with a as (select *, coalesce(length(text), 0) as n from adapted_document where source_type is not null and source_name is not null),
    b as (select *, {_before.format(v='n', k='source_name')} as c, {_case(CAPS, 'source_name')} as cap from a), c2 as (select * exclude (c, cap) from b where cap is null or c < cap),
    d as (select *, {_before.format(v='n', k='source_type')} as c, {_case(QUOTAS, 'source_type')} as cap from c2), e as (select * exclude (c, cap) from d where cap is null or c < cap),
    f as (select row_id, source_type, n, coalesce(sum(n) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as c from e)
    select row_id, source_type from f where c < 300000""")
def quota_and_cap_mix(spark, sf):
    d = adapted(spark, sf).where("source_type is not null and source_name is not null")
    return mixture.quotas_and_caps(d, "row_id", text_length(), QUOTAS, CAPS, 300_000, "source_type").select("row_id", "source_type")


@query(f"""with a as (select *, coalesce(length(text), 0)::bigint as n, {_case(QUOTAS, 'source_type')} as q from adapted_document), b as (select *, {_before.format(v='n', k='source_type')} as c from a)
    select row_id, (case when q is null or source_type = 'comment' then n else least(n, greatest(q - c, 0)) end)::bigint as written from b where (case when q is null or source_type = 'comment' then n else least(n, greatest(q - c, 0)) end) > 0""")
def token_quota(spark, sf):
    """Characters stand for tokens; the comments may overflow."""
    return mixture.token_quota(adapted(spark, sf).withColumn("n", text_length()), "row_id", "n", QUOTAS, "flexible", ("comment",), "source_type").select("row_id", "written")


@query("""with w as (select source_type, sum(target_share) as w from mix_target where target_share > 0 group by 1), r as (select *, 100003 * w / (select sum(w) from w) as raw from w), f as (select *, floor(raw) as base from r)
    select source_type, (base + case when row_number() over (order by round(raw - base, 9) desc, w desc, source_type) <= 100003 - (select sum(base) from f) then 1 else 0 end)::bigint as quota from f""")
def largest_remainder(spark, sf):
    return mixture.apportion(table(spark, sf, "mix_target"), 100_003, "source_type", "target_share")


@query("""with a as (select source_type, sum(length(text))::bigint as tokens from adapted_document where text is not null and source_type is not null group by 1), t as (select source_type, (sum(target_share) * 1000000)::bigint as quota from mix_target group by 1),
    j as (select coalesce(a.source_type, t.source_type) as source_type, coalesce(tokens, 0) as tokens, coalesce(quota, 0) as quota from a full join t on a.source_type = t.source_type)
    select source_type, tokens, quota, round(tokens::double / (select sum(tokens) from j), 6) as share, round(quota::double / (select sum(quota) from j), 6) as target_share, round((tokens::double / (select sum(tokens) from j) - quota::double / (select sum(quota) from j)) * 100, 4) as delta_points from j""")
def actual_against_target(spark, sf):
    a = adapted(spark, sf).where("text is not null and source_type is not null").groupBy("source_type").agg(F.sum(F.length("text")).cast("bigint").alias("tokens"))
    t = table(spark, sf, "mix_target").groupBy("source_type").agg(F.round(F.sum("target_share") * 1_000_000).cast("bigint").alias("quota"))
    return mixture.actual_against_target(a, t, "source_type")


@query(f"""with recursive a as (select row_id, source_type, coalesce(length(text), 0) as n, {_case(QUOTAS, 'source_type')} as cap from adapted_document), b as (select *, row_number() over (partition by source_type order by row_id) as i from a where cap is not null),
    f as (select source_type, row_id, i, n <= cap as keep, case when n <= cap then cap - n else cap end as rest from b where i = 1 union all select b.source_type, b.row_id, b.i, b.n <= f.rest, case when b.n <= f.rest then f.rest - b.n else f.rest end from f join b on b.source_type = f.source_type and b.i = f.i + 1)
    select row_id, source_type from f where keep union all select row_id, source_type from a where cap is null""")
def strict_cap(spark, sf):
    """A fold: a row that does not fit is skipped and a later one may fit."""
    return folds.strict_cap(adapted(spark, sf).withColumn("n", text_length()), "source_type", "row_id", "n", QUOTAS).select("row_id", "source_type")


@query("""with recursive a as (select row_id, coalesce(length(text), 0) as n, coalesce(source_type = 'wiki', false) as w from adapted_document), o as (select *, coalesce(sum(case when w then 0 else n end) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as others from a),
    b as (select *, row_number() over (order by row_id) as i from o where w), f as (select row_id, i, true as keep, n::bigint as kept from b where i = 1 union all select b.row_id, b.i, f.kept / greatest(b.others, 1) < 0.05, f.kept + case when f.kept / greatest(b.others, 1) < 0.05 then b.n else 0 end from f join b on b.i = f.i + 1)
    select row_id, keep from f union all select row_id, true from a where not w""")
def evolving_share(spark, sf):
    """A fold: the share is that of the moment."""
    return folds.evolving_share(adapted(spark, sf).withColumn("n", text_length()), "row_id", "n", F.coalesce(F.col("source_type") == "wiki", F.lit(False)), 0.05).select("row_id", "keep")


@query("""with a as (select doc_id, length(text)::bigint as n, (('0x' || substr(sha1(text), 1, 16))::uhugeint::double / 18446744073709551615.0) < 0.04 as hit from documents where length(text) > 0),
    b as (select *, coalesce(sum(case when hit then n else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as c from a)
    select case when hit and c < 20000 then 'val' else 'train' end as split, count(*) as docs, sum(n)::bigint as tokens from b group by 1""")
def hash_split(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 0").withColumn("n", text_length())
    return mixture.split_by_hash(d, F.sha1("text"), "doc_id", "n", 20_000, 1_000_000).groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


@query(f"""with recursive a as (select row_id, source_type as c, coalesce(length(text), 0)::bigint as n, (('0x' || substr(sha1(coalesce(text, '')), 1, 16))::uhugeint::double / 18446744073709551615.0) < 0.1 as hit, {_case(QUOTAS, 'source_type')}::bigint as quota from adapted_document where source_type is not null),
    b as (select *, row_number() over (order by row_id) as i from a),
    f as (select 0::bigint as i, 0::bigint as row_id, '' as split, 0::bigint as written, 0::bigint as train, 0::bigint as val, map([''], [0::bigint]) as used union all
      select i, row_id, split, greatest(w, 0), train + case when split = 'train' then greatest(w, 0) else 0 end, val + case when split = 'val' then greatest(w, 0) else 0 end, case when quota is not null then map_concat(used, map([c], [coalesce(used[c], 0) + greatest(w, 0)])) else used end from (
        select *, least(m, case when split = 'val' then 20000 - val else 200000 - train end) as w from (
          select b.i, b.row_id, b.c, b.quota, case when b.hit and f.val < 20000 then 'val' else 'train' end as split, f.train, f.val, f.used, case when b.quota is not null then least(b.n, b.quota - coalesce(f.used[b.c], 0)) else b.n end as m from f join b on b.i = f.i + 1)))
    select row_id, split, written from f where written > 0""")
def exact_shard_decisions(spark, sf):
    """Quotas and split limits at once: one ordered fold over narrow rows."""
    d = adapted(spark, sf).where("source_type is not null").select("row_id", "source_type", text_length().alias("n"), (T.unit_hash(F.sha1(F.coalesce("text", F.lit("")))) < 0.1).alias("hit"))
    return folds.shard_exact(d, "row_id", "n", "source_type", "hit", QUOTAS, 200_000, 20_000)


# Audits.


@query("""with g as (select grouping(source_type) as a, grouping(source_name) as b, source_type, source_name, count(*) as docs, sum(coalesce(length(text), 0))::bigint as chars from adapted_document group by grouping sets ((source_type), (source_name), ()))
    select case when a = 0 then 'category' when b = 0 then 'source' else 'all' end as level, case when a = 0 then source_type when b = 0 then source_name end as name, docs, chars, round(chars::double / (select chars from g where a = 1 and b = 1), 6) as share from g""")
def audit_by_category_source(spark, sf):
    return audit.by_category_and_source(adapted(spark, sf), "source_type", "source_name")


@query(rf"""with d as (select *, text as t from documents where text is not null), e as (select *, {LEN} as n, length(t) as l from d)
    select lang, count(*) as docs, min(l)::int as min_chars, round(avg(l), 4) as mean_chars, round(median(l), 4) as median_chars, max(l)::int as max_chars, count(*) filter (l > 512) as over_512, count(*) filter (l > 1024) as over_1024, count(*) filter (l > 2048) as over_2048,
    round(coalesce(sum(({_share(HAN)}) * l) / nullif(sum(l), 0), 0), 6) as chinese_ratio from e group by lang""")
def length_distribution(spark, sf):
    return audit.length_stats(table(spark, sf, "documents"), ["lang"])


@query("select source_name, count(*) as n, min(row_id) as seen_at from adapted_document group by 1 order by n desc, seen_at limit 10")
def top_sources(spark, sf):
    """A top-10 report."""
    return audit.top_with_ties(adapted(spark, sf), "source_name", "row_id", 10)


@query("select source_type, row_id, r::int as rank from (select source_type, row_id, row_number() over (partition by source_type order by row_id) as r from adapted_document) where r <= 8")
def first_per_type(spark, sf):
    return audit.first_per_group(adapted(spark, sf), "source_type", "row_id", 8, ["row_id"]).select("source_type", "row_id", "rank")


@query("select source_type, row_id from (select source_type, row_id, row_number() over (partition by source_type order by sha1('7:' || row_id)) as r from adapted_document) where r <= 12")
def sample_per_type(spark, sf):
    """Twelve rows a type, repeatably."""
    return audit.sample_per_group(adapted(spark, sf), "source_type", "row_id", 12, 7).select("source_type", "row_id")


@query("select row_id, (row_number() over (order by ('0x' || substr(md5('3' || ':' || row_id), 1, 15))::bigint, row_id) - 1)::bigint as position from adapted_document")
def shuffled_rows(spark, sf):
    return audit.shuffled(adapted(spark, sf).select("row_id"), "row_id", 3)


@query("""with p as (select count(*)::int as total, greatest(1, ceil(count(*) / 100.0))::int as pages from adapted_document), q as (select total, pages, least(3, pages)::int as page from p)
    select row_id, source_name, total, pages as total_pages, page from (select *, row_number() over (order by row_id) as r from adapted_document), q where r > (page - 1) * 100 and r <= page * 100""")
def rows_page(spark, sf):
    """The third page of 100."""
    return audit.page(adapted(spark, sf).select("row_id", "source_name"), "row_id", 3, 100)


@query("""with u as (select case when length(output) > 0 then 'output' when length(input) > 0 then 'input' else 'instruction' end as field from instruction_row), n as (select field, count(*) as n from u group by 1)
    select field, n, row_number() over (order by n desc, field) = 1 as is_mode from n""")
def field_usage(spark, sf):
    f = F.when(F.length("output") > 0, "output").when(F.length("input") > 0, "input").otherwise("instruction")
    return audit.field_usage(table(spark, sf, "instruction_row"), f)


@query(r"""with d as (select coalesce(instruction, '') as p, coalesce(instruction, '') || coalesce(output, '') as g, coalesce(output, '') as c from instruction_row)
    select count(*) as n, round(avg(length(c)), 4) as mean_length, count(*) filter (trim(c, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) = '') as empty,
    round(avg(case when length(c) > 1 then len(list_filter(range(1, length(c)), lambda i: c[i] = c[i + 1]))::double / (length(c) - 1) else 0.0 end), 6) as repeated_char,
    round(avg(case when length(c) > 2 then 1.0 - len(list_distinct(list_transform(range(1, length(c) - 1), lambda i: c[i:i+2])))::double / (length(c) - 2) else 0.0 end), 6) as repeated_ngram,
    count(*) filter (contains(g, '<unk>') or contains(g, chr(65533)) or contains(g, '<|')) as bad_markers from d""")
def answer_metrics(spark, sf):
    d = table(spark, sf, "instruction_row").select(F.coalesce("instruction", F.lit("")).alias("p"), F.concat(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit(""))).alias("g"))
    return audit.eval_metrics(d, "p", "g")


# Tokens.


@query("select (row_number() over (order by c) - 1)::int as id, c as token from (select distinct unnest(string_split(text, '')) as c from documents) where length(c) > 0")
def char_vocabulary(spark, sf):
    return tokens.char_vocabulary(table(spark, sf, "documents"))


@query("select doc_id, length(text) as n, true as same from documents where text is not null")
def char_round_trip(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    v = tokens.char_vocabulary(d)
    e = tokens.decode_chars(tokens.encode_chars(d, v), v)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n"), (F.col("decoded") == F.col("text")).alias("same"))


WORDS = r"regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[\x{4e00}-\x{9fff}]')"


@query(f"""with w as (select unnest({WORDS}) as token from documents), n as (select token, count(*) as n from w group by 1) select token, n, round(n::double / (select sum(n) from n), 8) as share from n order by n desc, token limit 80""")
def token_histogram(spark, sf):
    """The 80 commonest word tokens."""
    return tokens.token_histogram(table(spark, sf, "documents"), tokens.words(F.col("text")))


@query(f"""with w as (select unnest({WORDS}) as t from documents), k as (select distinct unnest({WORDS.replace('text', 'description')}) as t from subject_area)
    select count(*) as tokens, count(*) filter (t not in (select t from k)) as unknown, round(count(*) filter (t not in (select t from k))::double / count(*), 8) as ratio from w""")
def unknown_ratio(spark, sf):
    known = table(spark, sf, "subject_area").select(F.explode(tokens.words(F.col("description"))).alias("token"))
    return tokens.unknown_ratio(table(spark, sf, "documents"), known, tokens.words(F.col("text")))


@query(f"""with w as (select {WORDS} as l from documents), p as (select unnest(list_transform(range(1, len(l)), lambda i: {{'a': l[i], 'b': l[i + 1]}})) as p from w where len(l) > 1) select p.a as token, p.b as next, count(*) as n from p group by 1, 2""")
def bigram_counts(spark, sf):
    return tokens.bigrams(table(spark, sf, "documents"), tokens.words(F.col("text")))


@query(f"""with t as (select doc_id, coalesce(len({WORDS}), 0)::bigint as n from documents) select doc_id, n as n_tokens, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from t""")
def token_positions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.size(tokens.words(F.coalesce("text", F.lit("")))), F.lit(0)).cast("bigint").alias("n_tokens"))
    return tokens.positions(d, "doc_id", "n_tokens")


_POS = f"""t as (select doc_id, coalesce(len({WORDS}), 0)::bigint as n from documents), p as (select *, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as s from t)"""


@query(f"""with {_POS}, q as (select *, unnest(range(s // 10000, (s + n - 1) // 10000 + 1)) as shard from p where n > 0)
    select doc_id, shard::bigint as shard, (greatest(s, shard * 10000) - s)::bigint as first, (greatest(s, shard * 10000) - shard * 10000)::bigint as position, (least(s + n, (shard + 1) * 10000) - greatest(s, shard * 10000))::bigint as taken from q""")
def shard_pieces(spark, sf):
    return tokens.shard_pieces(token_positions(spark, sf), 10_000).select("doc_id", "shard", "first", "position", "taken")


@query(f"""with {_POS}, c as (select least(greatest(floor(sum(n) * 0.9)::bigint, 2048), greatest(sum(n)::bigint - 2048, 0)) as cut from t)
    select doc_id, greatest(least(n, cut - s), 0)::bigint as train_tokens, (n - greatest(least(n, cut - s), 0))::bigint as val_tokens from p, c""")
def stream_split(spark, sf):
    d = token_positions(spark, sf).drop("start")
    return tokens.stream_split(d, "doc_id", "n_tokens", 0.1, 2048).select("doc_id", "train_tokens", "val_tokens")


_LATEST = "s as (select split, shard_index, tokens, bytes, path from shard qualify row_number() over (partition by split, shard_index order by written_at desc, tokens desc, path desc) = 1)"


@query(f"""with {_LATEST}, b as (select *, coalesce(sum(coalesce(tokens, 0)) over (partition by split order by shard_index rows between unbounded preceding and 1 preceding), 0) as before, case split when 'train' then 9500500 when 'val' then 2000100 end as target from s)
    select split, shard_index, case when before >= target then 'move' when before + coalesce(tokens, 0) <= target then 'keep' else 'trim' end as action,
    (case when before >= target then 0 when before + coalesce(tokens, 0) <= target then coalesce(tokens, 0) else target - before end)::bigint as kept_tokens from b""")
def shard_repair(spark, sf):
    p = tokens.repair_plan(tokens.latest_shards(table(spark, sf, "shard")), {"train": 9_500_500, "val": 2_000_100})
    return p.select("split", "shard_index", "action", "kept_tokens")


_INDEX = f"{_LATEST}, i as (select split, shard_index, greatest((coalesce(tokens, 0) - 1) // 1024, 0)::bigint as n_blocks from s), o as (select *, coalesce(sum(n_blocks) over (partition by split order by shard_index rows between unbounded preceding and 1 preceding), 0)::bigint as block_offset from i)"


@query(f"with {_INDEX} select split, shard_index, n_blocks, block_offset from o")
def block_index(spark, sf):
    return tokens.block_index(tokens.latest_shards(table(spark, sf, "shard")), 1024).select("split", "shard_index", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.col("block_offset").cast("bigint").alias("block_offset"))


@query(f"with {_INDEX}, b as (select 'train' as split, doc_id * 37 as block_id from documents) select b.split, b.block_id, o.shard_index, ((b.block_id - o.block_offset) * 1024)::bigint as first_token from b join o on o.split = b.split and b.block_id >= o.block_offset and b.block_id < o.block_offset + o.n_blocks")
def locate_blocks(spark, sf):
    b = table(spark, sf, "documents").select(F.lit("train").alias("split"), (F.col("doc_id") * 37).alias("block_id"))
    return tokens.locate_blocks(b, tokens.block_index(tokens.latest_shards(table(spark, sf, "shard")), 1024), 1024).select("split", "block_id", "shard_index", "first_token")


@query(f"""with t as (select doc_id, {WORDS} as l from documents where text is not null), q as (select doc_id, l, unnest(range(0, (len(l) - 1) // 16)) as b from t where len(l) > 16)
    select doc_id, b::int as block, array_to_string(l[b * 16 + 1 : b * 16 + 16], ' ') as x, array_to_string(l[b * 16 + 2 : b * 16 + 17], ' ') as y from q""")
def next_token_pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokens.words(F.col("text")).alias("ids"))
    return tokens.next_token_pairs(d, "ids", 16).select("doc_id", "block", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"""with {_LATEST}, b as (select *, coalesce(tokens, 0) as n, coalesce(sum(coalesce(tokens, 0)) over (partition by split order by shard_index rows between unbounded preceding and 1 preceding), 0) as before from s), t as (select split, sum(n) as t from b where n > 0 group by 1),
    d as (select split, sample, ('0x' || substr(md5('9' || ':' || split || ':' || sample), 1, 15))::bigint % t as pos from (select *, unnest(range(0, 20)) as sample from t))
    select d.split, sample::int as sample, shard_index, least(pos - before, greatest(n - 128, 0))::bigint as first_token, least(n, 128)::bigint as taken from d join b on b.split = d.split and n > 0 and pos >= before and pos < before + n""")
def weighted_windows(spark, sf):
    """Draws are hashes."""
    return tokens.weighted_windows(tokens.latest_shards(table(spark, sf, "shard")), 20, 128, 9)


@query("select count(text) as texts, count(text) as same from documents")
def round_trips(spark, sf):
    d = table(spark, sf, "documents")
    return tokens.round_trips(d, tokens.char_vocabulary(d))


@query("select doc_id, (row_number() over (order by ('0x' || substr(md5('5' || ':' || '2' || ':' || doc_id), 1, 15))::bigint, doc_id) - 1)::bigint as rank from documents")
def epoch_order(spark, sf):
    return tokens.epoch_order(table(spark, sf, "documents").select("doc_id"), "doc_id", 5, 2)


@query(f"""with w as (select doc_id, {WORDS} as l from documents), r as (select *, unnest([0, 1]) as i from w where len(l) > 16), a as (select *, ('0x' || substr(md5('11' || ':' || i || ':' || array_to_string(l, ' ')), 1, 15))::bigint % (len(l) - 16) + 1 as pos from r)
    select doc_id, array_to_string(l[pos:pos + 15], ' ') as x, array_to_string(l[pos + 1:pos + 16], ' ') as y from a""")
def random_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokens.words(F.col("text")).alias("ids"))
    return tokens.random_windows(d, "ids", 16, 2, 11).select("doc_id", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"select sum(length(text))::bigint as chars, sum(len({WORDS}))::bigint as tokens, round(sum(length(text))::double / sum(len({WORDS})), 6) as chars_per_token from documents where text is not null")
def compression(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("n", F.size(tokens.words(F.col("text"))))
    return tokens.compression(d, "text", "n")


@query("select doc_id, md5(text) as h, strlen(text)::bigint as bytes, 1::bigint as separators from documents where length(text) > 0")
def byte_round_trips(spark, sf):
    """Texts after byte-level encoding and decoding, where the last of their tokens ends, and the separators of the stream."""
    d = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", "text")
    v = bytebpe.train(d, "text", len(bytebpe.SPECIALS) + 256 + 12)
    e = materialize(bytebpe.decode(bytebpe.encode(d, v, separator="<eos>"), v))
    ends = bytebpe.preview(e, v, "doc_id").groupBy("doc_id").agg(F.max("end").cast("bigint").alias("bytes"), F.count_if(F.col("kind") == "special").alias("separators"))
    return e.select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("h")).join(ends, "doc_id")


@query(f"select token, length(token)::int as chars, n from (select token, count(*) as n from (select unnest({WORDS}) as token from documents) group by 1) order by chars desc, token limit 40")
def longest_tokens(spark, sf):
    """The 40 longest word tokens: a report."""
    return tokens.longest_tokens(table(spark, sf, "documents"), tokens.words(F.col("text")), 40)


@query()
def byte_bpe_merges(spark, sf):
    """Merges are an iteration; a test holds them against a public trainer."""
    v = bytebpe.train(table(spark, sf, "documents"), "text", len(bytebpe.SPECIALS) + 256 + 20)
    return spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(v.merges)], "rank int, left string, right string")


@query()
def bpe_merges(spark, sf):
    """Merges are an iteration."""
    return tokens.train_bpe(table(spark, sf, "documents"), "text", 60)


@query(rf"""select doc_id, list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: length({_trim('x')}) > 0), lambda x: len({WORDS.replace('text', 'x')}) + 2))::int as n from documents where text is not null and length({_trim('text')}) > 0
    union all select doc_id, 0 from documents where text is not null and length({_trim('text')}) = 0""")
def line_tokens(spark, sf):
    return tokens.line_tokens(table(spark, sf, "documents").where("text is not null"), "doc_id").select("doc_id", F.size("tokens").alias("n"))


@query(f"""with {_POS}, q as (select *, unnest(range(s // 10000, (s + n - 1) // 10000 + 1)) as shard from p where n > 0)
    select shard::bigint as shard, sum(least(s + n, (shard + 1) * 10000) - greatest(s, shard * 10000))::bigint as tokens from q group by 1""")
def written_shards(spark, sf):
    """Writes shards to the shared folder and reads their sizes back."""
    import uuid

    d = table(spark, sf, "documents").where("text is not null").select("doc_id", tokens.words(F.col("text")).alias("ids"))
    return pipelines.shards(d, "doc_id", "ids", f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", 10_000)


# Runs.


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_log")


FINITE = "case when not isnan({0}) and not isinf({0}) then {0} end"


@query("""select run_id, step, log_id, status_source from training_log where step is not null qualify row_number() over (partition by run_id, step order by (status_source = 'heartbeat') desc nulls last, log_id desc) = 1""")
def latest_log(spark, sf):
    return runs.latest_per_step(log(spark, sf)).select("run_id", "step", "log_id", "status_source")


@query("""with recursive p as (select run_id, lag(run_id) over (order by run_id) as parent_id from (select distinct run_id from training_log where run_id is not null)),
    up as (select run_id, parent_id as ancestor, 1 as depth from p where parent_id is not null union all select up.run_id, p.parent_id, up.depth + 1 from up join p on p.run_id = up.ancestor where p.parent_id is not null and up.depth < 16),
    l as (select *, coalesce(status_source = 'heartbeat', false) as hb from training_log where run_id is not null),
    e as (select run_id, step, log_id, status_source, case when hb then 0 else 1 end as a, 0 as b, -log_id as c from l union all
      select up.run_id, step, log_id, status_source, case when hb then 3 else 2 end, case when hb then depth else -depth end, case when hb then -log_id else log_id end from l join up on up.ancestor = l.run_id)
    select run_id, step, log_id, status_source from e where step is not null qualify row_number() over (partition by run_id, step order by a, b, c) = 1 union all select run_id, step, log_id, status_source from l where step is null""")
def merged_log(spark, sf):
    """Logs of a run with those of the up to 16 runs it came from; the parent of a run is the run before it by name."""
    d = log(spark, sf).where("run_id is not null")
    names = d.select("run_id").distinct()
    parent = names.select("run_id", F.lag("run_id").over(Window.orderBy("run_id")).alias("parent_id"))
    up = runs.lineage(parent, 16)
    a = d.join(F.broadcast(up.select(F.col("run_id").alias("_child"), F.col("ancestor").alias("run_id"), "depth")), "run_id").drop("run_id").withColumnRenamed("_child", "run_id")
    return runs.merge_logs(d, a).select("run_id", "step", "log_id", "status_source")


_W = "over (partition by run_id order by step, log_id rows between 20 preceding and 1 preceding)"


@query(f"""with l as (select *, {FINITE.format('train_loss')} as loss from training_log), d as (select *, avg(loss) {_W} as m, stddev_pop(loss) {_W} as s, count(loss) {_W} as n from l where loss is not null and step is not null)
    select log_id, run_id, step, round(loss, 6) as loss, round(m, 6) as rolling_mean from d where n = 20 and loss > m + greatest(0.5, 4.0 * s) and loss > m * 1.15""")
def loss_spikes(spark, sf):
    d = runs.loss_spikes(log(spark, sf).where("step is not null")).where("is_spike")
    return d.select("log_id", "run_id", "step", F.round("loss", 6).alias("loss"), F.round("rolling_mean", 6).alias("rolling_mean"))


@query(f"""with l as (select *, {FINITE.format('train_loss')} as loss from training_log), d as (select *, median(loss) {_W} as m, count(loss) {_W} as n from l where loss is not null and step is not null)
    select log_id, run_id, step, round(m, 6) as baseline from d where n >= 10 and m > 0 and loss > m * 1.5""")
def median_spikes(spark, sf):
    return runs.median_spikes(log(spark, sf).where("step is not null")).where("is_spike").select("log_id", "run_id", "step", F.round("baseline", 6).alias("baseline"))


@query(f"""with l as (select *, {FINITE.format('tokens_per_second')} as speed from training_log where step is not null), d as (select *, median(case when speed > 0 then speed end) {_W} as m from l)
    select log_id, run_id, step, round(m, 4) as recent_median from d where step > 1400 and speed < m * 0.55""")
def throughput_drops(spark, sf):
    return runs.throughput_drops(log(spark, sf).where("step is not null")).where("is_drop").select("log_id", "run_id", "step", F.round("recent_median", 4).alias("recent_median"))


@query("""with d as (select log_id, run_id, row_number() over (partition by run_id order by step, log_id) - 1 as i, count(*) over (partition by run_id) as n from training_log where step is not null and run_id is not null),
    p as (select distinct run_id, n, round_even(k * (n - 1) / 49.0, 0)::bigint as i from (select distinct run_id, n from d), range(0, 50) as r(k) where n > 50)
    select log_id, run_id from d where n <= 50 or exists (select 1 from p where p.run_id = d.run_id and p.i = d.i)""")
def downsampled_log(spark, sf):
    return runs.downsample(log(spark, sf).where("step is not null and run_id is not null"), 50).select("log_id", "run_id")


@query("select log_id, run_id, step from training_log where step is not null qualify row_number() over (partition by run_id order by step desc, log_id desc) <= 30")
def log_tail(spark, sf):
    return runs.tail(log(spark, sf).where("step is not null"), 30).select("log_id", "run_id", "step")


_L = f"l as (select *, {FINITE.format('train_loss')} as loss, {FINITE.format('val_loss')} as val, {FINITE.format('tokens_per_second')} as speed, {FINITE.format('elapsed_sec')} as sec from training_log where step is not null)"
_SUM = f"""{_L}, s as (select run_id, count(*) as rows, min(step) as first_step, max(step) as last_step, arg_min(loss, {{'a': step, 'b': log_id}}) filter (loss is not null) as first_loss, arg_max(loss, {{'a': step, 'b': log_id}}) filter (loss is not null) as last_loss,
    count(loss) as losses, min(val) as best_val_loss, arg_min(step, {{'a': val, 'b': step}}) filter (val is not null) as best_step, avg(speed) as mean_speed, max(tokens_seen) as tokens_seen, max(sec) as elapsed_sec from l group by 1)"""


@query(f"with {_SUM} select run_id, rows, first_step, last_step, round(first_loss, 6) as first_loss, round(last_loss, 6) as last_loss, losses, round(best_val_loss, 6) as best_val_loss, best_step, round(mean_speed, 3) as mean_tokens_per_second, tokens_seen, round(elapsed_sec, 3) as elapsed_sec, case when losses < 2 then 'not enough data' when last_loss - first_loss < -0.02 then 'improving' when last_loss - first_loss > 0.02 then 'worsening' else 'flat' end as diagnosis from s")
def run_summary(spark, sf):
    d = runs.diagnosis(runs.run_summary(log(spark, sf).where("step is not null")))
    r = {"first_loss": 6, "last_loss": 6, "best_val_loss": 6, "mean_tokens_per_second": 3, "elapsed_sec": 3}
    return d.select("run_id", "rows", "first_step", "last_step", "losses", "best_step", "tokens_seen", "diagnosis", *(F.round(c, n).alias(c) for c, n in r.items()))


@query(f"with {_SUM}, p as (select *, regexp_extract(run_id, '_([0-9]+)m_', 1) as m from s where run_id is not null) select run_id, round(6.0 * m::double * 1e6 * mean_speed / 1e12, 3) as tflops, round(tokens_seen / (m::double * 1e6), 6) as tokens_per_parameter from p where m <> ''")
def compute_estimates(spark, sf):
    s = runs.run_summary(log(spark, sf).where("step is not null and run_id is not null")).withColumn("m", F.regexp_extract("run_id", "_([0-9]+)m_", 1)).where("m <> ''")
    return runs.estimates(s, F.col("m").cast("double") * 1e6).select("run_id", F.round("tflops", 3).alias("tflops"), "tokens_per_parameter")


@query(f"with {_SUM}, n as (select * from s where run_id is not null) select arg_min(run_id, {{'v': best_val_loss, 'r': run_id}}) filter (best_val_loss is not null) as best_loss_run, arg_max(run_id, mean_speed) as fastest_run, arg_min(run_id, {{'v': best_val_loss / nullif(mean_speed, 0), 'r': run_id}}) filter (best_val_loss / nullif(mean_speed, 0) is not null) as best_ratio_run from n")
def best_runs(spark, sf):
    return runs.best_runs(runs.run_summary(log(spark, sf).where("step is not null and run_id is not null")))


@query("""select log_id, round(case when step < 100 then 0.0003 * least(greatest(step, 0), 100) / 100 else 0.00003 + 0.5 * (0.0003 - 0.00003) * (1 + cos(pi() * least(step - 100, 9900) / 9900)) end, 12) as lr,
    round(0.0003 + least(greatest(step, 0), 10000) * (0.00003 - 0.0003) / 10000, 12) as lr_linear from training_log where step is not null""")
def learning_rates(spark, sf):
    s = F.col("step")
    return log(spark, sf).where("step is not null").select("log_id", F.round(runs.learning_rate(s, "warmup_cosine", 3e-4, 3e-5, 100, 0.0, 10_000), 12).alias("lr"), F.round(runs.learning_rate(s, "linear", 3e-4, 3e-5, decay=10_000), 12).alias("lr_linear"))


def _status(spark: SparkSession, sf: str, share: float) -> DataFrame:
    """A status row per run, as of a share of its log's time."""
    d = log(spark, sf).where("run_id is not null and logged_at is not null")
    end = d.agg(F.max("logged_at").alias("end"), F.min("logged_at").alias("begin"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = d.crossJoin(F.broadcast(end)).withColumns({"_s": us("logged_at"), "_now": us("begin") + (F.lit(share) * (us("end") - us("begin"))).cast("bigint")})
    d = d.where(F.col("_s") <= F.col("_now"))
    at = F.struct("_s", "log_id")
    return d.groupBy("run_id").agg(
        ((F.max("_now") - F.max("_s")) / 1e6).alias("status_age"), ((F.max("_now") - F.max(F.when(F.col("status_source") == "heartbeat", F.col("_s")))) / 1e6).alias("heartbeat_age"), F.max("step").alias("step"), F.max("step").alias("local_step"),
        F.max(F.when(F.col("status_source") == "eval", F.col("step"))).alias("last_eval_step"), F.max_by("train_loss", at).alias("train_loss"), F.max_by("val_loss", at).alias("val_loss"), F.max_by("learning_rate", at).alias("learning_rate"),
    ).withColumns({"state": F.lit("running"), "heartbeat_interval": F.lit(25), "eval_interval": F.lit(250), "checkpoint_interval": F.lit(0), "checkpoint_step": F.lit(None).cast("bigint")})


def _alerts_sql(share: float) -> str:
    """The alerts of every run as of a share of the log's time."""
    tests = {
        "status_slow": ("warning", "age > 300 and age <= 900"), "status_stale": ("critical", "age > 900"), "heartbeat_missing": ("warning", "hb is null"), "heartbeat_stale": ("critical", "hb > 900"), "train_loss_missing_or_nonfinite": ("critical", f"({FINITE.format('train_loss')}) is null"),
        "val_loss_nonfinite": ("critical", f"val_loss is not null and ({FINITE.format('val_loss')}) is null"), "learning_rate_missing": ("warning", f"({FINITE.format('learning_rate')}) is null"), "eval_stale_by_step": ("warning", "step - last_eval_step > 500"), "eval_missing": ("warning", "step >= 0 and last_eval_step is null"),
    }
    each = " union all ".join(f"select run_id, '{k}' as key, '{s}' as severity from s where {t}" for k, (s, t) in tests.items())
    return f"""(with t as (select min(epoch_us(logged_at)) as a, max(epoch_us(logged_at)) as b from training_log where run_id is not null), l as (select *, epoch_us(logged_at) as secs, a + trunc({share}::double * (b - a))::bigint as now from training_log, t where run_id is not null and logged_at is not null),
      s as (select run_id, (max(now) - max(secs)) / 1e6 as age, (max(now) - max(case when status_source = 'heartbeat' then secs end)) / 1e6 as hb, max(step) as step, max(case when status_source = 'eval' then step end) as last_eval_step,
        arg_max({{'v': train_loss}}, {{'a': secs, 'b': log_id}})['v'] as train_loss, arg_max({{'v': val_loss}}, {{'a': secs, 'b': log_id}})['v'] as val_loss, arg_max({{'v': learning_rate}}, {{'a': secs, 'b': log_id}})['v'] as learning_rate from l where secs <= now group by 1) {each})"""


@query(f"select * from {_alerts_sql(1.0)}")
def run_alerts(spark, sf):
    return runs.alerts(_status(spark, sf, 1.0))


@query(f"""with a as {_alerts_sql(0.5)}, b as {_alerts_sql(1.0)} select run_id, key, 'opened' as change from b where not exists (select 1 from a where a.run_id = b.run_id and a.key = b.key)
    union all select run_id, key, 'resolved' from a where not exists (select 1 from b where a.run_id = b.run_id and a.key = b.key)""")
def alert_changes(spark, sf):
    return runs.alert_changes(runs.alerts(_status(spark, sf, 0.5)), runs.alerts(_status(spark, sf, 1.0)))


@query("""with recursive p as (select run_id, lag(run_id) over (order by run_id) as parent_id from (select distinct run_id from training_log where run_id is not null)),
    up as (select run_id, parent_id as ancestor, 1 as depth from p where parent_id is not null union all select up.run_id, p.parent_id, up.depth + 1 from up join p on p.run_id = up.ancestor where p.parent_id is not null and up.depth < 16)
    select run_id, ancestor, depth from up""")
def run_lineage(spark, sf):
    names = log(spark, sf).where("run_id is not null").select("run_id").distinct()
    return runs.lineage(names.select("run_id", F.lag("run_id").over(Window.orderBy("run_id")).alias("parent_id")), 16)


@query(f"with {_SUM} select run_id, round(best_val_loss - (select best_val_loss from s where run_id = 'lake_118m_base'), 6) as best_val_loss_delta, round(mean_speed - (select mean_speed from s where run_id = 'lake_118m_base'), 3) as mean_tokens_per_second_delta from s")
def baseline_deltas(spark, sf):
    d = runs.against_baseline(runs.run_summary(log(spark, sf).where("step is not null")), "run_id", "lake_118m_base", ["best_val_loss", "mean_tokens_per_second"])
    return d.select("run_id", F.round("best_val_loss_delta", 6).alias("best_val_loss_delta"), F.round("mean_tokens_per_second_delta", 3).alias("mean_tokens_per_second_delta"))


@query("select event_id, event_type, dense_rank() over (partition by event_type order by value) as r, round(value - avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), 6) as delta from events")
def event_deltas(spark, sf):
    """The rolling frame of the logs over another series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return table(spark, sf, "events").select("event_id", "event_type", F.dense_rank().over(Window.partitionBy("event_type").orderBy("value")).cast("bigint").alias("r"), F.round(F.col("value") - F.avg("value").over(w), 6).alias("delta"))


@query(f"with {_SUM} select run_id, round(best_val_loss - last_loss, 6) as overfit_gap, round(mean_speed * regexp_extract(run_id, '_([0-9]+)m_', 1)::double / 100, 3) as normalized_speed from s where regexp_extract(run_id, '_([0-9]+)m_', 1) <> ''")
def experiment_rows(spark, sf):
    s = runs.run_summary(log(spark, sf).where("step is not null")).withColumn("m", F.regexp_extract("run_id", "_([0-9]+)m_", 1)).where("m <> ''")
    d = runs.per_hundred_million(runs.experiments(s), F.col("m").cast("double") * 1e6)
    return d.select("run_id", F.round("overfit_gap", 6).alias("overfit_gap"), F.round("normalized_speed", 3).alias("normalized_speed"))


@query(f"""with {_L}, d as (select run_id, sec - lag(sec) over w as ds, step - lag(step) over w as dn, tokens_seen - lag(tokens_seen) over w as dt, row_number() over w as i from l where sec is not null window w as (partition by run_id order by step, log_id))
    select run_id, sum(dn)::bigint as steps, round(sum(ds), 3) as seconds, round(sum(dt)::double / sum(ds), 3) as tokens_per_second, round(avg(ds / dn), 6) as mean_step, round(min(ds / dn), 6) as min_step, round(max(ds / dn), 6) as max_step from d where i > 1 and ds > 0 and dn > 0 group by 1""")
def step_benchmark(spark, sf):
    d = runs.step_benchmark(log(spark, sf))
    return d.select("run_id", "steps", F.round("seconds", 3).alias("seconds"), F.round("tokens_per_second", 3).alias("tokens_per_second"), *(F.round(c, 6).alias(c) for c in ("mean_step", "min_step", "max_step")))


# Vectors.


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 1e-12), 6) as first from embeddings")
def unit_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(vectors.unit(F.col("embedding")), 1), 6).alias("first"))


@query("""with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id as query, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as sim from q, embeddings e where q.vec_id <> e.vec_id)
    select query, vec_id, round(sim, 6) as similarity, r::int as rank from (select *, row_number() over (partition by query order by round(sim, 9) desc, vec_id) as r from s) where r <= 8""")
def cosine_neighbours(spark, sf):
    """Every hundredth row as the stated query set, against all rows."""
    e = table(spark, sf, "embeddings")
    return vectors.nearest(e.where("vec_id % 100 = 0"), e, 8).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_P = "p as (select vec_id, t, list_transform(embedding, lambda x: exp((x::double - list_max(embedding)::double) / t)) as e from embeddings, (values (0.5), (0.8), (1.0), (1.5)) as v(t)), q as (select vec_id, t, list_transform(e, lambda x: x / list_sum(e)) as p from p)"


@query(f"""with {_P.replace('(0.5), (0.8), (1.0), (1.5)', '(0.5::double), (0.8::double), (1.0::double), (1.5::double)')} select vec_id, t as temperature, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) as entropy, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)), 6) as normalized_entropy, round(list_max(p), 6) as top_probability from q""")
def logit_distributions(spark, sf):
    d = vectors.distribution(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return d.select("vec_id", "temperature", *(F.round(c, 6).alias(c) for c in ("entropy", "normalized_entropy", "top_probability")))


_C = "c as (select vec_id, unnest(embedding)::double as logit, generate_subscripts(embedding, 1) - 1 as token from embeddings), r as (select *, row_number() over (partition by vec_id order by logit desc, token) as rank, exp(logit - max(logit) over (partition by vec_id)) / sum(exp(logit)) over (partition by vec_id) * exp(max(logit) over (partition by vec_id)) as p from c)"


@query(f"with {_C} select vec_id, token::int as token, round(logit, 6) as logit, round(p, 6) as probability, rank::int as rank from r where rank <= 5")
def top_candidates(spark, sf):
    d = vectors.candidates(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)
    return d.select("vec_id", "token", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"), "rank")


@query(f"with {_C}, u as (select *, sum(p) over (partition by vec_id order by rank) as s from r) select vec_id, count(*) as crossing, count(*) filter (s <= 0.5 or rank = 1) as inside from u where s - p < 0.5 group by 1")
def nucleus_sizes(spark, sf):
    e = table(spark, sf, "embeddings")
    a = vectors.nucleus(e, "vec_id", "embedding", 0.5).groupBy("vec_id").agg(F.count(F.lit(1)).alias("crossing"))
    b = vectors.nucleus(e, "vec_id", "embedding", 0.5, include_crossing=False).groupBy("vec_id").agg(F.count(F.lit(1)).alias("inside"))
    return a.join(b, "vec_id")


@query("select vec_id, len(list_filter(embedding, lambda x: x > embedding[label + 1])) + 1 as rank from embeddings")
def label_ranks(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vectors.rank_of(F.col("embedding"), F.col("label")).cast("bigint").alias("rank"))


@query(f"with {_C}, u as (select *, sum(p) over (partition by vec_id order by rank) as s from r), k as (select *, sum(p) over (partition by vec_id) as t from u where s - p < 0.6) select vec_id, token from k where s / t >= ((('0x' || substr(md5('4:' || vec_id), 1, 15))::bigint % 1073741824) + 0.5) / 1073741824.0 qualify row_number() over (partition by vec_id order by rank) = 1")
def sampled_tokens(spark, sf):
    return vectors.sample_token(table(spark, sf, "embeddings"), "vec_id", "embedding", top_p=0.6, seed=4)


@query("""with s as (select vec_id // 8 as head, vec_id % 8 as query, unnest(embedding[1:8])::double as score, generate_subscripts(embedding[1:8], 1) - 1 as key from embeddings), m as (select * from s where key <= query),
    w as (select *, exp(score) / sum(exp(score)) over (partition by head, query) as weight from m) select head, query, round(abs(sum(weight * ln(weight))), 6) as entropy from w group by 1, 2""")
def attention_entropy(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("head"), (F.col("vec_id") % 8).alias("query"), F.posexplode(F.slice("embedding", 1, 8)).alias("key", "score"))
    w = vectors.causal_attention(e.withColumn("score", F.col("score").cast("double")))
    return vectors.attention_entropy(w).select("head", "query", F.round("entropy", 6).alias("entropy"))


# Streams: the same tables read as streams of what is there.


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2")
def streamed_counts(spark, sf):
    """Hourly counts with a watermark wide enough that nothing is late."""
    import uuid

    from textlake.streaming import ingest

    name = f"counts_{uuid.uuid4().hex}"
    s = spark.readStream.schema(table(spark, sf, "events").schema).parquet(_as_folder(spark, sf, "events"))
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    d = ingest.run_once(ingest.windowed_status(s, "ts", "3650 days", "1 hour", "event_type"), name, f"{shared_dir(spark)}/{name}")
    return d.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _as_folder(spark: SparkSession, sf: str, name: str) -> str:
    """A table as a folder of files, which a stream needs."""
    import uuid

    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table(spark, sf, name).write.parquet(at)
    return at


@query(f"""with c as (select doc_id, source as source_name, source_type, {_clean("coalesce(text, '')")} as text from documents), {_flags("c")}
    select doc_id, sha1({COMPACT}) as dedupe_key from h where decision = 'keep' qualify row_number() over (partition by {COMPACT} order by doc_id) = 1""")
def streamed_ingest(spark, sf):
    """Documents taken in as a stream and de-duplicated against what the table holds."""
    import uuid

    from textlake.streaming import ingest

    run = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    src = ingest.stream(spark, _as_folder(spark, sf, "documents"), table(spark, sf, "documents").schema).withColumnRenamed("source", "source_name")
    ingest.ingest(src, f"{run}/out", f"{run}/checkpoint", "doc_id", profile=rules.MIXED).awaitTermination()
    return spark.read.parquet(f"{run}/out").select("doc_id", "dedupe_key")
