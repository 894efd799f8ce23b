"""Text functions as Column expressions: normalisers, statistics, keys and formatters.

All of it runs inside the JVM but for the three functions at the end, for which Spark has no expression (normal forms, HTML entities).
Patterns are written for Java; blanks are those of the Unicode White_Space property plus U+001C to U+001F.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
NOT_WS = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]"
HAN_BMP = r"[\x{4e00}-\x{9fff}]"
HAN_ALL = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2ceaf}\x{f900}-\x{faff}]"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]"
DOC_SEPARATOR = "<|doc_sep|>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, pattern, to)


def count(text: Column, pattern: str) -> Column:
    """Non-overlapping matches; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def count_chars(text: Column, cls: str) -> Column:
    """Characters of a class; 0 for null. Runs are removed and lengths compared, so no array of matches is built."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"(?:{cls})+", "")), F.lit(0))


def visible_chars(text: Column) -> Column:
    """Characters that are not blank."""
    return F.coalesce(F.length(F.regexp_replace(text, f"{WS}+", "")), F.lit(0))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle stands in text, without overlaps; 0 for an empty needle."""
    n = F.length(needle)
    return F.when(n > 0, (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).otherwise(0).cast("int")


def strip(text: Column) -> Column:
    return sub(text, rf"^{WS}+|{WS}+\z")


def lines_to_lf(text: Column) -> Column:
    return sub(text, r"\r\n?", "\n")


def compact(text: Column) -> Column:
    return sub(text, rf"{WS}+")


# Normalisers. Each is an ordered list of rewrites.


def normalize_training(text: Column) -> Column:
    """Line ends, blanks beside Chinese punctuation, blanks between Han and Latin, at most one empty line."""
    t = strip(lines_to_lf(text))
    t = sub(t, r"[ \t]+", " ")
    t = sub(t, rf"([，。！？；：、）】》」』]){WS}+", "$1")
    t = sub(t, rf"{WS}+([，。！？；：、（【《「『])", "$1")
    t = sub(t, rf"({HAN_BMP}){WS}+([A-Za-z0-9])", "$1$2")
    t = sub(t, rf"([A-Za-z0-9]){WS}+({HAN_BMP})", "$1$2")
    return strip(sub(t, r"\n{3,}", "\n\n"))


def normalize_clean(text: Column, composed: bool = False) -> Column:
    """Normal form C, paragraph marks and breaks as line feeds, no invisible characters, then normalize_training. Null becomes empty.

    composed: the text is in normal form C already, so the one step outside the JVM is left out.
    """
    t = F.coalesce(text, F.lit(""))
    t = t if composed else nfc(t)
    t = lines_to_lf(t)
    t = sub(t, r"(?:\$\s*P\s*\$)+", "\n")
    t = sub(t, r"(?i)<br\s*/?>", "\n")
    t = sub(t, ZERO_WIDTH)
    t = sub(t, r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\t]]")
    return normalize_training(t)


def chinese_spacing(text: Column) -> Column:
    """Blanks that word segmentation left between Han characters, around punctuation and beside Latin letters; inside Latin text they stay."""
    b = r"[ \t]+"
    t = sub(text, b + r"([，。！？；：、,.!?;:])", "$1")
    t = sub(t, r"([，。！？；：、])" + b + rf"(?=[{CJK}A-Za-z0-9“‘\"（(《])", "$1")
    t = sub(t, rf"(?<=[{CJK}])([,.!?;:])" + b + rf"(?=[{CJK}])", "$1")
    t = sub(t, rf"(?<=[{CJK}])" + b + rf"(?=[{CJK}A-Za-z0-9])")
    t = sub(t, r"(?<=[A-Za-z0-9])" + b + rf"(?=[{CJK}])")
    t = sub(t, r"(?<=[…⋯])" + b + r"(?=[…⋯])")
    t = sub(t, r"(?<=[·・])" + b + r"(?=[·・])")
    return sub(t, r"[ \t]{2,}", " ")


def normalize_corpus(text: Column) -> Column:
    """Normal form C, chinese_spacing, at most one empty line."""
    t = sub(lines_to_lf(nfc(text)), r"[ \t\f\x0b]+", " ")
    return strip(sub(chinese_spacing(t), r"\n{3,}", "\n\n"))


def normalize_wide(text: Column) -> Column:
    """Normal form KC, ideographic blanks as blanks, control characters removed but for line feeds."""
    t = sub(sub(lines_to_lf(nfkc(text)), r"\x{3000}", " "), r"[\p{C}&&[^\n]]")
    return strip(sub(t, r"[ \t]+", " "))


#: Page furniture that is blanked out of web text.
BOILERPLATE = ("免责声明", "版权所有", "未经授权", "点击查看更多", "返回顶部", "扫一扫", "分享到", "责任编辑")


def preserve_punctuation(text: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Entities resolved, links and tags and page furniture blanked, blanks collapsed; Chinese punctuation stays as it is."""
    t = lines_to_lf(unescape(text))
    t = sub(sub(t, rf"https?://{NOT_WS}+", " "), r"<[^>]+>", " ")
    if boilerplate:
        t = sub(t, "|".join(boilerplate), " ")
    t = sub(sub(t, r"[\t\f\x0b]+", " "), r"[ ]{2,}", " ")
    return strip(sub(t, r"\n{3,}", "\n\n"))


def repair_spacing(text: Column) -> Column:
    """Blanks before punctuation, after Chinese punctuation, and between repeated tone marks."""
    b = r"[\t \x{a0}\x{3000}]+"
    t = sub(text, b + r"([，。！？；：、,.!?;:~～…）】》])", "$1")
    t = sub(t, r"([，。！？；：、])" + b + r"(?=[\x{3400}-\x{9fff}A-Za-z0-9~～…])", "$1")
    t = sub(t, r"([,.!?;:])" + b + r"(?=[\x{3400}-\x{9fff}])", "$1")
    t = sub(t, r"(?<=[~～…!！?？])" + b + r"(?=[~～…!！?？])")
    return strip(sub(t, r"[ ]{2,}", " "))


def repair_utterance(text: Column) -> Column:
    """One turn of a segmented dialogue as ordinary text."""
    t = repair_spacing(preserve_punctuation(text))
    t = sub(t, rf"(?<=[\x{{3400}}-\x{{9fff}}]){WS}+(?=[\x{{3400}}-\x{{9fff}}A-Za-z0-9])")
    t = sub(t, rf"(?<=[A-Za-z0-9]){WS}+(?=[\x{{3400}}-\x{{9fff}}])")
    t = sub(t, rf"([（【《]){WS}+", "$1")
    return strip(sub(t, r"[ ]{2,}", " "))


def repair_chat(text: Column) -> Column:
    """The spacing part of repair_utterance on every line."""

    def line(x: Column) -> Column:
        t = repair_spacing(strip(x))
        t = sub(t, rf"(?<=[\x{{3400}}-\x{{9fff}}]){WS}+(?=[\x{{3400}}-\x{{9fff}}A-Za-z0-9])")
        return strip(sub(t, rf"(?<=[A-Za-z0-9]){WS}+(?=[\x{{3400}}-\x{{9fff}}])"))

    return strip(F.array_join(F.transform(F.split(text, r"\r\n|\r|\n"), line), "\n"))


def clean_wiki(text: Column, title: Column | None = None) -> Column:
    """Wiki markup to text: tables, templates, categories, files, links, headings, references; then a filter on lines. The title leads where the
    first 80 characters lack it."""
    t = sub(text, r"(?s)\{\|.*?\|\}", " ")
    t = sub(t, r"\{\{[^{}]{0,600}\}\}", " ")
    t = sub(t, r"(?i)\[\[(?:分类|Category|文件|File|Image|图片):[^\]]+\]\]", " ")
    t = sub(t, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2")
    t = sub(t, r"\[\[([^\]]+)\]\]", "$1")
    t = sub(t, r"\[https?://[^\]\s]+(?:\s+([^\]]+))?\]", "$1")
    t = sub(t, r"'{2,}")
    t = sub(t, r"==+[ \t]*(.*?)[ \t]*==+", "\n$1\n")
    t = sub(t, r"(?s)<ref[^>]*>.*?</ref>", " ")
    t = sub(t, r"<[^>]+>", " ")
    clean = F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: strip(sub(sub(strip(x), r"\{\{[^{}\n]*(?:\}\})?", " "), r"\s{2,}", " ")))

    def keep(x: Column) -> Column:
        n = F.length(x)
        return (
            (n > 0)
            & ~has(x, r"^(?:\{\{|\}\})")
            & ~has(x, r"(?i)\d{2,4}px\|thumb|thumb\|right|thumb\|left|缩略图|外部链接|参考资料|注释|导航|相关条目")
            & ~has(x, r"(?i)^\[?\s*(?:链接|link)\s*\]?$")
            & ~(F.startswith(x, F.lit("[")) & (n < 40))
            & ~(has(x, r"^[*#|!;:]") & (n < 80))
        )

    out = strip(sub(F.array_join(F.filter(clean, keep), "\n"), r"\n{3,}", "\n\n"))
    if title is None:
        return out
    return F.when((F.length(title) > 0) & ~F.contains(F.substring(out, 1, 80), title), F.concat(title, F.lit("\n"), out)).otherwise(out)


# Statistics.


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def chinese_ratio(text: Column, kind: str = "plane") -> Column:
    """Share of Han characters: of all visible ones with basic-plane Han ('plane') or with extensions ('all'), or of Han, letters and digits
    ('letters')."""
    if kind == "letters":
        h = count_chars(text, HAN_BMP)
        return h / F.greatest(h + count_chars(text, "[A-Za-z0-9]"), F.lit(1))
    return ratio(count_chars(text, HAN_BMP if kind == "plane" else HAN_ALL), visible_chars(text))


def char_stats(text: Column) -> Column:
    """STRUCT of the length without blanks and six shares of it."""
    n = visible_chars(text)
    share = lambda p: ratio(count_chars(text, p), n)
    return F.struct(
        n.alias("length"), share(HAN_BMP).alias("chinese_ratio"), share(r"\p{P}").alias("punct_ratio"), share(r"\p{Co}").alias("private_ratio"),
        share(r"\x{fffd}").alias("replacement_ratio"), share(r"\p{Nd}").alias("digit_ratio"), share("[A-Za-z]").alias("latin_ratio"),
    )


def spans(text: Column, size: int = 80, step: int = 40, least: int = 0) -> Column:
    """Windows of size characters at every step while a whole window lies ahead; those of at least `least` characters."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        starts = F.when(n > size, F.sequence(F.lit(1), n - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
        out = F.transform(starts, lambda s: F.substring(t, s, F.lit(size)))
        return F.filter(out, lambda x: F.length(x) >= least) if least else out

    return let(text, cut)


def repeated_spans(text: Column, squeeze_first: bool = True, least: int = 60, floor: int = 240) -> Column:
    """How many windows are copies of another one: over the compact text, or over the text as it is with each window compacted."""

    def copies(t: Column) -> Column:
        w = spans(t, least=least) if squeeze_first else F.filter(F.transform(spans(t), compact), lambda x: F.length(x) >= least)
        return F.when(F.length(t) >= floor, let(w, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)

    return let(compact(text) if squeeze_first else text, copies)


def char_profile(text: Column, floor: int) -> Column:
    """STRUCT(n, distinct share, share of the commonest character) of a compact text; null below floor, so short texts are never taken apart.

    The characters are sorted and folded into runs: the work is n log n in one row, nothing is exploded.
    """
    t = compact(text)
    chars = F.array_sort(F.split(t, ""))
    n = F.length(t)
    fold = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("kinds")),
        lambda a, c: F.struct(
            c.alias("c"),
            F.when(c == a.c, a.run + 1).otherwise(1).alias("run"),
            F.greatest(a.best, F.when(c == a.c, a.run + 1).otherwise(1)).alias("best"),
            (a.kinds + F.when(c == a.c, 0).otherwise(1)).alias("kinds"),
        ),
    )
    s = F.struct(n.alias("n"), (fold.kinds / n).alias("distinct_share"), (fold.best / n).alias("top_share"))
    return F.when(n >= floor, s)


def low_diversity(text: Column) -> Column:
    """Under 3 % distinct characters in a text of at least 500, or under 5 % with one character in more than 18 %.

    The fold that finds the commonest character runs only for the few texts between the two shares.
    """
    top = lambda t: char_profile(t, 500).top_share > 0.18
    share = lambda t: F.size(F.array_distinct(F.split(t, ""))) / F.length(t)
    few = lambda t: let(share(t), lambda d: F.when(d < 0.03, True).when(d < 0.05, top(t)).otherwise(False))
    return let(compact(text), lambda t: F.when(F.length(t) >= 500, few(t)).otherwise(False))


def too_repetitive(text: Column, top: float = 0.24, chunk: int = 20, share: float = 0.45) -> Column:
    """One character in more than `top` of a text of at least 120, or more than 8 chunks of which under `share` are distinct."""

    def test(t: Column) -> Column:
        few = let(spans(t, chunk, chunk), lambda c: (F.size(c) > 8) & (F.size(F.array_distinct(c)) < share * F.size(c)))
        return F.when(F.length(t) >= 120, few | F.coalesce(char_profile(t, 120).top_share > top, F.lit(False))).otherwise(False)

    return let(compact(text), test)


def repeated_char_ratio(text: Column) -> Column:
    """Share of neighbouring pairs that are equal; 0 below two characters."""
    n = F.length(text)
    pairs = n - F.length(F.regexp_replace(text, r"(?s)(.)(?=\1)", ""))
    return F.when(n > 1, pairs / (n - 1)).otherwise(F.lit(0.0))


def repeated_ngram_ratio(text: Column, n: int = 3) -> Column:
    """1 - distinct / all n-grams of characters; 0 where there is none."""

    def grams(c: Column) -> Column:
        # Over the array of characters: a substring would count its way from the start of the text each time.
        size = F.size(c) - (n - 1)
        return F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))

    chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
    return let(let(chars, grams), lambda g: F.when(F.size(g) > 0, F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0)))


# Keys.


def exact_key(text: Column) -> Column:
    return F.sha1(text)


def compact_key(text: Column) -> Column:
    """SHA-1 of the text without blanks."""
    return F.sha1(compact(text))


def dedupe_key(text: Column, mode: str, metadata: Column | None = None) -> Column:
    """'exact', 'compact', or 'clean_hash': the hash in metadata where it is not blank, else the exact one."""
    if mode == "exact":
        return exact_key(text)
    if mode == "compact":
        return compact_key(text)
    if mode == "clean_hash":
        kept = F.nullif(F.trim(metadata["clean_text_hash"]), F.lit(""))
        return F.coalesce(kept, exact_key(text))
    raise ValueError(f"unsupported dedupe mode: {mode}")


def unit_hash(key: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a number from 0 to 1."""
    return F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def hash60(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^60 - 1 that any engine can compute: the first 15 hexadecimal digits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts)).cast("binary")), 1, 15), 16, 10).cast("bigint")


# Formatters.


def dialogue(turns: Column, speakers: tuple[str, ...] = ("甲", "乙"), labels: tuple[str, ...] = ("甲：", "乙：", "用户：", "助手：")) -> Column:
    """Turns under alternating speakers. Blank turns are skipped and still take their place; turns that carry a label keep it. Null gives ''."""
    known = "|".join(labels)
    named = F.transform(
        turns,
        lambda t, i: F.when(has(strip(t), f"^(?:{known})"), strip(t)).otherwise(F.concat(F.element_at(F.array(*(F.lit(s + "：") for s in speakers)), (i % len(speakers)) + 1), strip(t))),
    )
    both = F.zip_with(named, turns, lambda a, t: F.when(F.length(strip(F.coalesce(t, F.lit("")))) > 0, a))
    return F.coalesce(F.array_join(F.filter(both, lambda x: x.isNotNull()), "\n"), F.lit(""))


def join_nonempty(*parts: Column, sep: str = "\n") -> Column:
    """The trimmed parts that are not blank."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: F.length(p) > 0), sep)


def question_answer(question: Column, answer: Column, context: Column | None = None, labels: tuple[str, str] = ("问题", "回答")) -> Column:
    """The context follows the question unless it is part of it."""
    q = strip(F.coalesce(question, F.lit("")))
    if context is not None:
        c = strip(F.coalesce(context, F.lit("")))
        q = F.when((F.length(c) > 0) & ~F.contains(q, c), F.concat(q, F.lit("\n补充："), c)).otherwise(q)
    return join_nonempty(F.concat(F.lit(labels[0] + "："), q), F.concat(F.lit(labels[1] + "："), F.coalesce(answer, F.lit(""))))


def instruction(instruction_: Column, response: Column, input_: Column | None = None) -> Column:
    p = F.coalesce(instruction_, F.lit(""))
    if input_ is not None:
        p = F.when(F.length(input_) > 0, F.concat(p, F.lit("\n输入："), input_)).otherwise(p)
    return join_nonempty(F.concat(F.lit("指令："), p), F.concat(F.lit("回答："), F.coalesce(response, F.lit(""))))


#: Labels of conversation roles.
ROLES = {"human": "用户", "user": "用户", "assistant": "助手", "gpt": "助手", "bot": "助手"}


def conversation(turns: Column) -> Column:
    """ARRAY<STRUCT<role, text>> as labelled lines; blank texts are dropped, unknown roles name themselves, no role is 文本."""

    def line(t: Column) -> Column:
        role = strip(F.coalesce(t["role"], F.lit("")))
        label = F.coalesce(*(F.when(F.lower(role) == k, v) for k, v in ROLES.items()), F.when(role == "", "文本").otherwise(role))
        return F.concat(label, F.lit("："), strip(t["text"]))

    full = F.filter(turns, lambda t: F.length(strip(F.coalesce(t["text"], F.lit("")))) > 0)
    return F.coalesce(F.array_join(F.transform(full, line), "\n"), F.lit(""))


def labelled_fields(fields: dict[str, Column]) -> Column:
    """'label：value' lines of the fields that are not blank."""
    return join_nonempty(*(F.when(F.length(strip(c)) > 0, F.concat(F.lit(k + "："), strip(c))) for k, c in fields.items()))


def shorten(text: Column, limit: int, squeeze: bool = True) -> Column:
    """At most limit characters and '...'; squeeze first makes every run of blanks one blank."""
    t = strip(sub(text, rf"{WS}+", " ")) if squeeze else text
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def preview(text: Column, limit: int = 240) -> Column:
    return shorten(F.replace(text, F.lit("\n"), F.lit(" / ")), limit, squeeze=False)


def slug(text: Column, limit: int | None = None) -> Column:
    """Letters, digits, dots, hyphens and underscores; runs of others are one underscore; none at either end."""
    s = sub(sub(text, r"[^\p{L}\p{N}_.\-]+", "_"), r"^_+|_+$")
    return F.substring(s, 1, limit) if limit else s


def visible(token: Column) -> Column:
    """A token for display: blanks, line feeds, tabs and returns as symbols; '<empty>', '<bytes>' for fragments, '<control>' for unprintables."""
    t = F.translate(token, " \n\t\r", "␠␊␉␍")
    return F.when(token == "", "<empty>").when(F.contains(token, F.lit("�")), "<bytes>").when(has(token, r"^[\p{Cc}&&[^\n\t\r]]+$"), "<control>").otherwise(t)


def cut_at_newline(text: Column, limit: int) -> Column:
    """The text up to the last line feed before limit characters; limit characters where there is none."""
    head = F.substring(text, 1, limit)
    back = F.locate("\n", F.reverse(head))
    return F.when(F.length(text) <= limit, text).when(back > 0, F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head)


def cut_at_stops(text: Column, prompt: Column, stops: list[str]) -> Column:
    """The text up to the earliest stop string behind the prompt."""
    body = F.substring(text, F.length(prompt) + 1, F.length(text))
    at = F.array_min(F.filter(F.array(*(F.instr(body, s) for s in stops)), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), F.length(prompt) + at - 1))


# Functions Spark has no expression for: Arrow batches, and only for rows that can change.


def _arrow(f):
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in x.to_pylist()], pa.string())

    return run


def _normal(form: str):
    return _arrow(lambda t: t if t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))


def nfc(text: Column) -> Column:
    return _normal("NFC")(text)


def nfkc(text: Column) -> Column:
    return _normal("NFKC")(text)


def unescape(text: Column) -> Column:
    return _arrow(lambda t: html.unescape(t) if "&" in t else t)(text)
