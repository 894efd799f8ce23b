"""Problem 4: personal information in free text.

Regular expressions propose spans; a proposal starts with the score of its pattern, a checksum or calendar check confirms or refutes it, and words near
it raise or lower the score (of names they make nearly all of it); spans of a final score of at least MIN_SCORE are finds, the best of overlapping ones first.
Matching runs on a width- and look-alike-free copy of the text of which each character knows its place, so a find is given exactly as it stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.forms import prototypes
from textlake.runtime import table

MIN_SCORE = 0.7
TYPES = ("email", "phone", "id_number", "address", "name")
H = "㐀-鿿"

#: Common Chinese family names, those of two characters first.
FAMILY_NAMES = (
    "欧阳 司徒 司马 令狐 宇文 上官 诸葛 慕容 尉迟 长孙 夏侯 皇甫 东方 公孙 端木 南宫 独孤 "
    "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 林 罗 高 郑 梁 谢 宋 唐 许 韩 邓 冯 曹 彭 曾 肖 萧 田 董 袁 潘 于 蒋 蔡 余 杜 叶 程 苏 魏 吕 丁 任 沈 姚 "
    "卢 姜 崔 钟 谭 陆 汪 范 金 石 廖 贾 夏 韦 付 傅 方 白 邹 孟 熊 秦 邱 江 尹 薛 闫 阎 段 雷 侯 龙 史 陶 黎 贺 顾 毛 郝 龚 邵 万 钱 严 覃 武 戴 莫 孔 向 汤 "
    "岑 宓 闵 蔺 骆 裴 简 霍 庞 阮 焦 冉 晏 祁 仇 邬 柯 褚 郁 纪 温 康 施 文 牛 樊 葛 邢 安 齐 易 乔 伍 章 鲁 倪 殷 詹 申 耿 关 兰 左 柳 甘 祝 鲍 凌 辛 翟 卫 "
    "聂 尚 舒 游 滕 路 阳 娄 卞 桂 管 谷 盛 翁 费 童 颜 梅 単 查 车 岳 沙 苗 屈"
).split()
#: Words by which organisations and streets end, and titles and pronouns that begin no full name.
ORGANISATIONS = frozenset("Guild Club Trust Desk Forum Group Centre Center Society Institute Workshop Collective Office Courier Board University College Street Road Lane Avenue Company Press Ltd Inc Union Team".split())
NOT_GIVEN = frozenset("The A An From After Then On In At Of To For And But Mr Mrs Ms Miss Dr Sir Compared According Anyone Order Parcel Notes Seen".split())

_fam = "(?:" + "|".join(n for n in FAMILY_NAMES if len(n) > 1) + "|[" + "".join(n for n in FAMILY_NAMES if len(n) == 1) + "])"
_mobile = r"1[3-9]\d(?:[ \-]?\d{4}){2}"
_edge = r"(?<![A-Za-z0-9@_./\-+])"
_end = r"(?![A-Za-z0-9@_])(?![\-./]\d)"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    score: float
    #: Takes the text without blanks and hyphens; true adds confirm, false adds deny.
    check: str | None = None
    confirm: float = 0.0
    deny: float = 0.0
    #: Words in the 24 characters before, or 12 after, that add to the score or take from it.
    near: re.Pattern | None = None
    bonus: float = 0.3
    hint: str = "digits"


def iso_mod_11_2(s: str) -> bool:
    """Check character of 18-place resident numbers."""
    if not re.fullmatch(r"\d{17}[\dXx]", s) or not birthday(s[6:14]):
        return False
    return "10X98765432"[sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(s[:17])) % 11] == s[17].upper()


def birthday(s: str) -> bool:
    y, m, d = (int(s[:4]), int(s[4:6]), int(s[6:])) if len(s) == 8 else (1900 + int(s[:2]), int(s[2:4]), int(s[4:]))
    return 1880 <= y <= 2035 and 1 <= m <= 12 and 1 <= d <= 31


def short_resident(s: str) -> bool:
    return bool(re.fullmatch(r"\d{15}", s)) and birthday(s[6:12])


def luhn(s: str) -> bool:
    if not s.isdigit():
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def mod_97(s: str) -> bool:
    """International account numbers: the first four places go to the end, letters count from 10."""
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


CHECKS = {"iso_mod_11_2": iso_mod_11_2, "short_resident": short_resident, "luhn": luhn, "mod_97": mod_97}

_id_words = re.compile(r"身份|证件|证号|登记表|护照|\b(?:ID|SSN|passport|identity|number|file|Ausweis|carte)\b", re.I)
_no_id = re.compile(r"订单|运单|总额|批次|书号|编号|单号|\b(?:order|parcel|book|batch|invoice|total|tracking)\b", re.I)
_phone_words = re.compile(r"电话|手机|致电|请拨|联系|热线|传真|\b(?:call|phone|tel|reach|mobile|contact|fax)\b|打", re.I)

RULES = (
    Rule("email", re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9\-])"), 0.9, hint="mail"),
    Rule("email", re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]* ?[\[(<{] ?at ?[\])>}] ?[A-Za-z0-9\-]+(?:(?: ?[\[(<{] ?dot ?[\])>}] ?|\.)[A-Za-z0-9\-]+)+", re.I), 0.9, hint="mail"),
    Rule("id_number", re.compile(rf"{_edge}\d{{6}}[ \-]?\d{{8}}[ \-]?\d{{3}}[\dXx]{_end}"), 0.3, "iso_mod_11_2", 0.5, -0.1, _id_words, 0.5),
    Rule("id_number", re.compile(rf"{_edge}\d{{15}}{_end}"), 0.1, "short_resident", 0.3, -0.2, _id_words, 0.5),
    Rule("id_number", re.compile(rf"{_edge}\d{{3}}-\d{{2}}-\d{{4}}{_end}"), 0.5, None, 0, 0, _id_words, 0.3),
    Rule("id_number", re.compile(rf"{_edge}[A-Z]{{1,2}}\d{{6,9}}{_end}"), 0.2, None, 0, 0, _id_words, 0.6),
    Rule("id_number", re.compile(rf"{_edge}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_end}"), 0.2, "mod_97", 0.6, -0.2),
    Rule("id_number", re.compile(rf"{_edge}\d{{4}}(?:[ \-]?\d{{4}}){{3}}{_end}"), 0.1, "luhn", 0.2, -0.3, re.compile(r"卡号|银行卡|\bcard\b", re.I), 0.5),
    Rule("phone", re.compile(rf"{_edge}(?:\(\+86\)|\+86)[ \-]?{_mobile}{_end}|(?<!\d){_edge}{_mobile}{_end}"), 0.75, None, 0, 0, _phone_words, 0.2),
    Rule("phone", re.compile(rf"{_edge}(?:\(0\d{{2,3}}\) ?|0\d{{2,3}}[ \-]?)\d{{7,8}}{_end}"), 0.7, None, 0, 0, _phone_words, 0.2),
    Rule("phone", re.compile(r"(?<![一二三四五六七八九零〇])一[三-九三四五六七八九][一二三四五六七八九零〇]{9}(?![一二三四五六七八九零〇十百千万])"), 0.8, None, 0, 0, _phone_words, 0.1, "numerals"),
    Rule("phone", re.compile(rf"{_edge}(?:\+1[ .\-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .\-])\d{{3}}[ .\-]\d{{4}}{_end}"), 0.75, None, 0, 0, _phone_words, 0.2),
    Rule("phone", re.compile(rf"{_edge}(?:\+44 ?\(?0?\)?7\d{{3}}|07\d{{3}}) ?\d{{3}} ?\d{{3}}{_end}"), 0.75, None, 0, 0, _phone_words, 0.2),
    Rule("phone", re.compile(rf"{_edge}\+\d{{1,3}}(?:[ .\-]?\(?\d{{1,4}}\)?){{2,5}}{_end}"), 0.55, None, 0, 0, _phone_words, 0.3),
    Rule("phone", re.compile(rf"{_edge}0[1-9](?:[ .]\d{{2}}){{4}}{_end}"), 0.7, None, 0, 0, _phone_words, 0.2),
    Rule(
        "address",
        re.compile(
            rf"(?:[{H}]{{2,3}}?(?:省|自治区))?(?:[{H}]{{2,3}}?市)?(?:[{H}]{{2,3}}?[区县])?(?:[{H}]{{2,3}}?[镇乡])?"
            rf"(?:[{H}]{{2,3}}?村(?:\d{{1,4}}组)?|[{H}]{{2,4}}?(?:大道|路|街|巷|道|胡同|弄)(?:\d{{1,4}}弄)?)"
            r"\d{1,5}号(?:院)?(?:\d{1,4}(?:栋|幢|号楼|座))?(?:\d{1,3}单元)?(?:\d{1,5}(?:室|房)?)?(?![\d年月日线])"
        ),
        0.8,
        hint="house",
    ),
    Rule(
        "address",
        re.compile(
            r"(?<![A-Za-z0-9])(?:(?:Flat|Unit|Apt|Suite) \d{1,4}[A-Za-z]?, )?\d{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}"
            r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Row|Close|Court|Ct|Place|Pl|Terrace|Square|Boulevard|Blvd)\b"
            r"(?:,? (?:Apt|Flat|Unit|Suite) \d{1,4}[A-Za-z]?)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?:,? [A-Z]{2})?(?: \d{5}\b)?)?"
        ),
        0.8,
        hint="street",
    ),
)

#: Cheap searches; a rule runs only on texts in which its hint is found. A hint is a part that every match of its rules has, in each alternative.
HINTS = {
    "digits": re.compile(r"\+\d|\d{6}|\d(?:[ \-.()]{0,2}[\dA-Za-z]){6}"),
    "mail": re.compile(r"@|[\[(<{] ?at ?[\])>}]", re.I),
    "numerals": re.compile(r"一[三-九三四五六七八九][一二三四五六七八九零〇]{9}"),
    "house": re.compile(r"\d号"),
    "street": re.compile(r"\d[A-Za-z]? [A-Z][a-z]"),
}
_TRIM = ("收货地址", "联系地址", "地址", "住址", "现住", "我家住", "家住", "居住", "请寄到", "寄到", "送到", "寄往", "位于", "搬到", *"住址到寄往于在是为")


@dataclass(frozen=True)
class Names:
    """Full names of one script: where one may begin, how long it may be, and what the words next to it say.

    Every proposal has the score base, which is too little; the best of the words before and the best of those behind it add theirs.
    """

    #: Finds the place where a name may begin; group 1 is what it begins with.
    start: re.Pattern
    #: Ends of the name that begins at a match, the likelier first.
    ends: Callable[[str, re.Match], list[int]]
    base: float
    before: tuple[tuple[re.Pattern, float], ...]
    after: tuple[tuple[re.Pattern, float], ...]
    #: Whether the name cannot be one.
    refuted: Callable[[str, int, int], bool]

    def propose(self, text: str):
        for m in self.start.finditer(text):
            a = m.start()
            lead = text[max(0, a - 16) : a]
            first = max((x for p, x in self.before if p.search(lead)), default=0.0)
            for b in self.ends(text, m):
                score = self.base + first + max((x for p, x in self.after if p.match(text, b)), default=0.0)
                if score >= MIN_SCORE and not self.refuted(text, a, b):
                    yield score, a, b


def _han_ends(text: str, m: re.Match) -> list[int]:
    family = m.end(1)
    given = re.compile(rf"[{H}]{{0,2}}").match(text, family).end() - family
    return [family + n for n in (2, 1) if n <= given]


def _latin_refuted(text: str, a: int, b: int) -> bool:
    first, *_, last = text[a:b].split()
    return first in NOT_GIVEN or last in ORGANISATIONS


#: The words beside names, and how much each kind of them says.
NAMES = (
    Names(
        re.compile(rf"(?<![^,。;:!?\s()\"“”、据的人名叫])(?=({_fam})[{H}])"),
        _han_ends,
        0.2,
        (
            # A label ends where the name begins; what follows has to end the name.
            (re.compile(r"(?:姓名|联系人|收件人|寄件人|申请人|负责人|经办人|我叫|名叫|署名)[: ]{0,2}$"), 0.5),
            (re.compile(r"(?:^|[^证])据$"), 0.35),
            (re.compile(r"的$"), 0.2),
            (re.compile(r"(?:^|[,。;:!?\s()\"“”、])$"), 0.1),
        ),
        (
            (re.compile(r"就行|即可|联系|处领"), 0.5),
            (re.compile(rf"把[{H}]{{1,4}}[停放忘落借]|托[{H}]{{2,14}}转告|\(?[^,。]{{0,24}}\)?托[{H}]{{2,14}}转告|在[{H}]{{2,8}}的留言"), 0.5),
            (re.compile(r",(?:身份证|电话|手机|证件|现住|住址|家住)|\(\(?[+\d一]"), 0.5),
            (re.compile(r"回忆|介绍|透露|称|讲述|描述"), 0.35),
            (re.compile(r"[\s,。;:、()]|\Z|邮箱|电话"), 0.25),
        ),
        lambda text, a, b: False,
    ),
    Names(
        re.compile(r"(?<![A-Za-zà-ÿ])(?=([A-Z][a-zà-ÿ]+)(?: [A-Z]\.)? [A-Z][a-zà-ÿ])"),
        lambda text, m: [_LATIN_NAME.match(text, m.start()).end()],
        0.2,
        (
            (re.compile(r"(?:[Mm]y name is|[Cc]ontact|Applicant|ask for|[Nn]ame:|[Ss]igned by|Signed,) $"), 0.4),
            (re.compile(r"(?:[.!?:\"”] |^|\n)$"), 0.1),
        ),
        (
            (re.compile(r" of (?:Flat|Unit|Apt|\d)| (?:said|recalled|remembered|wrote|told) |, (?:ID|number|phone|born|aged) "), 0.5),
            (re.compile(r"(?! [A-Z][a-z])"), 0.3),
        ),
        _latin_refuted,
    ),
)
_LATIN_NAME = re.compile(r"[A-Z][a-zà-ÿ]+(?: [A-Z]\.)? [A-Z][a-zà-ÿ]+")


def _without_overlaps(hits: list[tuple[float, int, int, int, str]]) -> list[tuple[int, int, str]]:
    """The best hits first, then the longer ones; a hit that overlaps a taken one goes. Taken spans are kept sorted, so each hit meets two of them."""
    taken: list[tuple[int, int, str]] = []
    for _, _, a, b, kind in sorted(hits):
        i = bisect_left(taken, (a,))
        if (i == len(taken) or taken[i][0] >= b) and (not i or taken[i - 1][1] <= a):
            taken.insert(i, (a, b, kind))
    return taken


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the finds in a text that is free of look-alikes, in their order, without overlaps."""
    hits = []
    hinted = {k for k, p in HINTS.items() if p.search(text)}
    for rule in RULES:
        if rule.hint not in hinted:
            continue
        for m in rule.pattern.finditer(text):
            a, b = m.span()
            score = rule.score
            if rule.check:
                score += rule.confirm if CHECKS[rule.check](re.sub(r"[ \-]", "", m.group())) else rule.deny
            around = text[max(0, a - 24) : a] + "\0" + text[b : b + 12]
            if rule.near and rule.near.search(around):
                score += rule.bonus
            if rule.kind in ("id_number", "phone") and _no_id.search(re.split(r"[。.!?;\n]", text[max(0, a - 12) : a])[-1]):
                score -= 0.6
            if rule.kind == "address":
                for word in _TRIM:
                    if text.startswith(word, a) and rule.pattern.fullmatch(text, a + len(word), b):
                        a += len(word)
                        break
            if score >= MIN_SCORE:
                hits.append((-score, a - b, a, b, rule.kind))
    for names in NAMES:
        hits += [(-score, a - b, a, b, "name") for score, a, b in names.propose(text)]
    return _without_overlaps(hits)


class Finder:
    """find() on texts as stored: the copy's characters are mapped back to their places."""

    def __init__(self, proto: dict[int, str | None]):
        # No decomposition here: letters with accents stay whole.
        self.table = proto
        odd = [o for o, v in proto.items() if v is None or len(v) != 1]
        self.odd = re.compile("[" + "".join(re.escape(chr(o)) for o in sorted(odd)) + "]")

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        if text.isascii() or not self.odd.search(text):
            return find(text.translate(self.table) if not text.isascii() else text)
        copy, at = [], []
        for i, c in enumerate(text):
            r = self.table.get(ord(c), c)
            if r:
                copy.append(r)
                at += [i] * len(r)
        return [(at[a], at[b - 1] + 1, kind) for a, b, kind in find("".join(copy))]


def find_pii(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, pii_type, pii_text, start, end) of every find, start and end in characters of the text. Null keys, null and empty texts give none."""
    proto = prototypes(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t <> ''")

    def run(batches):
        finder = Finder(proto)
        for b in batches:
            k, kind, found, start, end = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e, x in finder(t):
                    k.append(i)
                    kind.append(x)
                    found.append(t[s:e])
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(k, b.column(0).type), pa.array(kind, pa.string()), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["k", "pii_type", "pii_text", "start", "end"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, pii_type string, pii_text string, start int, end int").withColumnRenamed("k", key)


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every find in its text replaced by its type in brackets, as [EMAIL]; null stays null."""
    proto = prototypes(df.sparkSession)

    @F.arrow_udf("string")
    def mask(x: pa.Array) -> pa.Array:
        finder, out = Finder(proto), []
        for t in x.to_pylist():
            if t:
                parts, at = [], 0
                for a, b, kind in finder(t):
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return df.withColumn(text, mask(F.col(text)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "adapted_document")).select("row_id", "pii_type", "pii_text").distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_pii(table(spark, sf_dir, "adapted_document").select("row_id", "text"))


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
