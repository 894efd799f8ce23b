"""Line shapes: what a line of a page looks like once its words are reduced to counts.

A line becomes a Shape, a tuple of small classes of counts (Han characters, words, capitals, digits, separated parts, links, fields, function words,
sentence ends); the shape alone decides whether a line is written as a sentence or is one of some kinds of non-sentences. Pages are judged by the
groups of equal shapes they hold. Problems 1 and 10 share the shapes.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

#: Kinds of lines. Those in SPAM make keyword-stuffed and link-list pages (problem 1); every kind but the first three is no running prose (problem 10).
SENTENCE, NEUTRAL, CODE, LINK, LIST, ATTR, STUFFED, BARE, BULLET, TABLE, LOG, NUMBER, SYMBOL, RANDOM, BROKEN = range(15)
KIND_NAMES = ["sentence", "neutral", "code", "link", "list", "attribute", "stuffed", "bare", "bullet", "table", "log", "number", "symbol", "random", "broken"]
#: Kinds of lines that are no list: their characters count only as far as they are links.
PLAIN = frozenset((SENTENCE, NEUTRAL, CODE))
SPAM = frozenset((LINK, LIST, ATTR, STUFFED, BARE, BULLET))

FUNCTION_CHARS = re.compile("[的了在是也不就都而与把被从到这那它很更没让给]")
FUNCTION_ZH = re.compile("[的了在是也不就都而与把被从到这那它很更没让给]|因为|如果|不过|可以|应当|需要|已经|以后|他们|我们|什么")
#: Function words of English, French and German.
FUNCTION_LATIN = frozenset(
    "the of and to in a is was that for it with as on at by from not are this but had has have which will would one all they be or an who when were "
    "le la les de des et à un une que pour être dans sur du en est qui pas plus par ont elle il ce se au aux même déjà dont on "
    "der die das und ist war für aus ein eine nicht zu mit dass von auf wurde den dem des im sich auch als über was eher".split()
)
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]，。；、|]+", re.I)
TAG = re.compile(r"<[^<>]{0,300}>")
HAN = re.compile("[\u3400-\u9fff\U00020000-\U0002fa1f]+")
WORD = re.compile(r"[^\W\d_\u2e80-\u9fff\uac00-\ud7af]+")
END = re.compile(r"[。！？!?;；…]|[.](?=\s|$|[\"”»])")
SEPARATORS = re.compile(r"\s*(?:[,，、;；|/#_>»·•\t＞｜]|\s-\s|\s{2,})\s*")
FIELD = re.compile(r"[^\s:：,，。;；]{1,16}[:：]\s?[^\s:：]{1,24}")
LOGLINE = re.compile(r"\b(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b|^\W*\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
BULLETED = re.compile(r"^\s*(?:[-*+•·◆●○■□▪‣–—★☆>]|\(?\d{1,3}[.)、．）])\s*\S")
CODELINE = re.compile(r"^\s*(?:def |const |let |var |import |class |function |return |\$ |#include)|=>|\w\(\w*=?\w*\)\s*[:{;]")
BLOB = re.compile(r"[A-Za-z0-9+/=]{48,}")
RUN = re.compile(r"(.)\1{11,}")
MOJIBAKE = re.compile("[\u00c2\u00c3\u00e2-\u00ef][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122\ufffd]")
#: What marks of a wrong decoding begin with.
ODD = re.compile("[\u0080-\u009f\u00c2\u00c3\u00e2-\u00ef\ue000-\uf8ff\ufffd]")
DIGIT = re.compile(r"\d")
SYMBOLS = re.compile(r"[^\w\s]")
#: Letters of scripts for which there are no function words here: text in them is taken for prose unless its separators make it a list.
FOREIGN = re.compile("[\u0370-\u1fff\u3040-\u30ff\uac00-\ud7af]")
PATHS = re.compile(r"\s[>»/|]\s")
LONE_FIELD = re.compile(r"\s*[^\s:：]{1,16}(?: [^\s:：]{1,12})?\s?[:：]\s?.{1,24}")
VOWELS = "aeiouyàâäéèêëîïôöùûü"
#: A line of at most so many Han characters, or words, and no function word is bare; so many such lines in one text are a list.
BARE_HAN, BARE_WORDS, BARE_LINES = 18, 10, 4


def count_han(text: str) -> int:
    return sum(map(len, HAN.findall(text)))


def visible(text: str) -> int:
    """Characters without blanks."""
    return sum(map(len, text.split()))


def is_broken(raw: str, n: int) -> bool:
    """Marks of a wrong decoding are over 5 % of n characters, and at least three."""
    if raw.isascii() or n < 4 or not ODD.search(raw):
        return False
    broken = 2 * len(MOJIBAKE.findall(raw)) + raw.count("\ufffd") + sum(0xE000 <= ord(c) <= 0xF8FF or 0x80 <= ord(c) < 0xA0 for c in raw if c > "\x7f" and not "\u3000" <= c <= "\u9fff")
    return broken > 0.05 * n and broken >= 3


def is_stuffed(text: str, han: int) -> bool:
    """The commonest pair of neighbouring Han characters covers over 16 % of the Han characters and stands at least five times."""
    # Both characters of such a pair are themselves that common, so most texts are decided without counting pairs.
    least = max(5, 0.08 * han)
    counts = Counter(text)
    if max(counts.values()) < least:
        return False
    often = [c for c, k in counts.items() if k >= least and HAN.match(c)]
    if not often or len(often) == 1 and often[0] * 2 not in text:
        return False
    pairs = Counter(p for run in HAN.findall(text) for p in zip(run, run[1:]))
    top = max(pairs.values(), default=0)
    return 2 * top > 0.16 * han and top >= 5


def plain_sentence(line: str, raw: str, n: int, han: int) -> bool:
    """Enough to know that line_kind ends in SENTENCE: none of its other tests can succeed."""
    if not (han >= 12 and han * 2 > n and "://" not in line and "www." not in line and "<a " not in line and END.search(line)):
        return False
    f = len(FUNCTION_CHARS.findall(line))
    # There are at most as many segments as other characters and one; fewer than 16 others make fewer than 16 words.
    if f < 0.06 * han or f <= (1 + len(line) - han) // 6 or han < 40 and n - han >= 16:
        return False
    if line.count("|") >= 2 or line.count("\t") >= 2 or BULLETED.match(line) or n >= 16 and len(set(line)) < 0.25 * n:
        return False
    return not is_broken(raw, n) and not (han >= 40 and is_stuffed(line, han))


class Shape(NamedTuple):
    """What is left of a line once its words are counted: small classes of counts, so that a corpus has a few hundred shapes and a page a handful."""

    #: Characters without blanks: 0 none, 1 under 12, 2 up to 40, 3 up to 72, 4 more.
    size: int = 0
    #: Han characters: 0 none, 1 up to BARE_HAN, 2 up to 39, 3 more.
    han: int = 0
    #: Words of other scripts: 0 none, 1 up to 4, 2 up to BARE_WORDS, 3 more.
    words: int = 0
    #: Of these words a capital begins 0 none, 1 some, 2 most.
    capitals: int = 0
    #: Digits: 0 none, 1 up to a quarter of the characters, 2 more.
    digits: int = 0
    #: Digits and symbols together: 0 up to 35 %, 1 up to 55 %, 2 under 70 %, 3 more.
    figures: int = 0
    #: Parts between separators: 0 few, 1 three or four short ones, 2 five or more long ones, 3 five or more short ones.
    parts: int = 0
    #: Links: 0 none, 1 cited in a sentence, 2 the line itself.
    links: int = 0
    #: Fields (name: value): 0 none, 1 one, 2 more, 3 a line full of them.
    fields: int = 0
    #: Function words, bits: PROSE enough for prose, SOME one or more, SEVERAL two or more, SPARSE at most one in six parts, DENSE many for Han.
    function: int = 0
    #: Whether a sentence ends in the line.
    ends: int = 0
    #: Bits of what single tests saw.
    signs: int = 0


PROSE, SOME, SEVERAL, SPARSE, DENSE = (1 << i for i in range(5))
GARBLED, PROGRAM, SAME, ENCODED, GRID, LOGGED, STUFF, MARKED, PATH, SPACED, BAG, HARD, PAIR, MORE_DIGITS, MARKS = (1 << i for i in range(15))
#: Places of each number of a shape in its code.
_BASE = (5, 4, 4, 3, 3, 4, 4, 3, 4, 32, 2, 1 << 15)


@lru_cache(1 << 16)
def shape_code(s: Shape) -> int:
    code = 0
    for v, base in zip(s, _BASE):
        code = code * base + v
    return code


def shape_of(code: int) -> Shape:
    out = []
    for base in reversed(_BASE):
        code, v = divmod(code, base)
        out.append(v)
    return Shape(*reversed(out))


@lru_cache(1 << 16)
def kind_of(s: Shape) -> int:
    """The kind of a shape: all that is decided about a line is decided here, from its shape alone."""
    if not s.size:
        return NEUTRAL
    for sign, kind in ((GARBLED, BROKEN), (PROGRAM, CODE)):
        if s.signs & sign:
            return kind
    if s.links:
        return SENTENCE if s.links == 1 else LINK
    prose, ends = bool(s.function & PROSE), bool(s.ends)
    if s.signs & SAME:
        return SYMBOL
    if s.signs & ENCODED and not prose:
        return RANDOM
    if s.signs & GRID:
        return TABLE
    if s.signs & LOGGED and not (prose and ends):
        return LOG
    if s.size > 1:
        if s.signs & MARKS:
            return SYMBOL
        if s.figures >= 2 and not (prose and s.function & SEVERAL and s.figures == 2):
            return NUMBER if s.signs & MORE_DIGITS else SYMBOL
    if s.signs & STUFF:
        return STUFFED
    if s.fields == 3 and not (prose and ends and s.function & DENSE):
        return ATTR
    if not prose or s.function & SPARSE:
        short = s.han <= 1 and s.words <= 2
        if s.parts == 3 or s.parts == 1 and s.signs & PATH and not ends or s.signs & SPACED and not ends:
            return LIST
        if s.signs & BAG:
            # A row of names in capitals is a list, however hard to say.
            return RANDOM if s.signs & HARD and s.capitals < 2 else LIST
        if not ends:
            if s.signs & MARKED and (short or s.digits == 2):
                return BULLET
            if s.digits and s.figures:
                return NUMBER
            if s.signs & PAIR and s.size <= 2 and not s.function & SOME:
                return ATTR
            if short and s.size <= 3 and not s.function & SOME:
                return BARE
    return SENTENCE if prose or ends else NEUTRAL


def _class(n: int, *upto: int) -> int:
    """0 for none, else in which of the ranges n lies."""
    return 0 if not n else 1 + sum(n > x for x in upto)


def measure(line: str, raw: str | None = None) -> tuple[Shape, int, int]:
    """(shape, characters without blanks, how many of them are links) of one line in the consistent form; raw is the line as stored.

    Counting stops where what is known decides whatever the rest may be: numbers that are not counted are 0 in the shape.
    """
    n = visible(line)
    if not n:
        return Shape(), 0, 0
    han = count_han(line)
    raw = line if raw is None else raw
    size, han_class = 1 + (n >= 12) + (n > 40) + (n > 72), _class(han, BARE_HAN, 39)
    if plain_sentence(line, raw, n, han):
        return Shape(size, han_class, function=PROSE | SOME | SEVERAL, ends=1), n, 0
    if is_broken(raw, n):
        return Shape(size, han_class, signs=GARBLED), n, 0
    if han * 4 < n and CODELINE.search(line):
        return Shape(size, han_class, signs=PROGRAM), n, 0
    linked = 0
    rest = line
    if "www." in line or "://" in line:
        linked = sum(map(len, URL.findall(line)))
        rest = TAG.sub(" ", URL.sub(" ", line))
    elif "<a " in line:
        return Shape(size, han_class, links=2), n, n
    if linked:
        han = count_han(rest)
        han_class = _class(han, BARE_HAN, 39)
    words = WORD.findall(rest)
    low = [w.lower() for w in words]
    capitals = sum(w[0].isupper() for w in words)
    word_class, capital_class = _class(len(words), 4, BARE_WORDS), (capitals > 0) + (capitals * 2 > len(words))
    f_zh = len(FUNCTION_ZH.findall(rest)) if han else 0
    f_la = sum(w in FUNCTION_LATIN for w in low)
    if marker := BULLETED.match(line):
        rest = rest[marker.end() - 1 :]
    ends = min(1, len(END.findall(rest)))
    prose = (han >= 8 and f_zh >= 0.03 * han) or (len(words) >= 4 and f_la >= 0.12 * len(words) and f_la >= 1)
    foreign = not raw.isascii() and 3 * len(FOREIGN.findall(raw)) > n
    prose = prose or foreign and n >= 8
    function = PROSE * prose | SOME * (f_zh + f_la > 0 or foreign) | SEVERAL * (f_zh + f_la > 1) | DENSE * (f_zh > 0.05 * han)
    base = Shape(size, han_class, word_class, capital_class, function=function, ends=ends, signs=MARKED * bool(marker))
    if linked:
        kept = visible(rest)
        cited = prose and ends and kept >= 20 and kept > 0.3 * linked
        return base._replace(links=1 if cited else 2), n, min(n, linked) if cited else n
    if RUN.search(line) and n >= 16 and len(set(line)) < 0.25 * n:
        return base._replace(signs=SAME), n, 0
    if BLOB.search(line) and not prose:
        return base._replace(signs=ENCODED), n, 0
    digits = len(DIGIT.findall(line))
    symbols = len(SYMBOLS.findall(line)) + line.count("_")
    share = (digits + symbols) / n
    figures = (share > 0.35) + (share > 0.55) + (share >= 0.7)
    signs = base.signs | MORE_DIGITS * (digits > symbols) | MARKS * (symbols > 0.6 * n)
    if line.count("|") >= 2 and (line.lstrip()[0] == "|" or "|-" in line) or line.count("\t") >= 2:
        signs |= GRID
    if LOGLINE.search(line):
        signs |= LOGGED
    base = base._replace(digits=(digits > 0) + (digits * 4 > n), figures=figures, signs=signs)
    if signs & (GRID | LOGGED) or size > 1 and figures >= 2:
        if kind_of(base) in (TABLE, LOG, SYMBOL, NUMBER):
            return base, n, 0
    if han >= 40:
        if is_stuffed(rest, han):
            signs |= STUFF
    elif len(words) >= 16 and len(words) * 4 > han:
        top, times = next(iter(Counter(w for w in low if len(w) > 2 and w not in FUNCTION_LATIN).most_common(1)), ("", 0))
        if times > 0.14 * len(words) and times >= 5:
            signs |= STUFF
    fields = len(FIELD.findall(rest))
    field_class = 3 if fields >= 4 and fields * 24 > n else _class(fields, 1)
    segments = len([s for s in SEPARATORS.split(rest) if s.strip(" #*-+()[]<>:。.")])
    letters = n - digits - symbols
    mean = letters / max(1, segments)
    if segments >= 5:
        parts = 3 if mean <= 10 or len(words) * 4 > han and len(words) <= 5 * segments else 2
    else:
        parts = 1 if segments >= 3 and mean <= 10 else 0
    if f_zh + f_la <= segments // 6:
        function |= SPARSE
    if not prose or function & SPARSE:
        tokens = len(rest.split())
        if parts == 1 and PATHS.search(rest):
            signs |= PATH
        if han and tokens >= 5 and letters <= 10 * tokens:
            signs |= SPACED
        if not foreign and len(words) >= 8 and f_la <= 0.05 * len(words) and han < len(words):
            vowels = sum(any(v in w for v in VOWELS) for w in low)
            signs |= BAG | HARD * (vowels < 0.9 * len(low) or max(map(len, low)) > 18)
        if fields and size <= 2 and LONE_FIELD.fullmatch(rest):
            signs |= PAIR
    return base._replace(parts=parts, fields=field_class, function=function, signs=signs), n, 0


def judged(measured: tuple[Shape, int, int]) -> tuple[int, int, int]:
    """(kind, characters without blanks, how many of them stand in a non-sentence) of a measured line."""
    shape, n, linked = measured
    kind = kind_of(shape)
    return kind, n, n if kind not in PLAIN else linked


def line_kind(line: str, raw: str | None = None) -> tuple[int, int, int]:
    return judged(measure(line, raw))


def page(lines: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Short bare, bulleted or single-field lines are part of a list only where there are several of them; elsewhere they are headings."""
    few = sum(k in (BARE, BULLET, ATTR, NUMBER) for k, _, _ in lines)
    if few and few < BARE_LINES:
        return [(NEUTRAL, n, 0) if k in (BARE, BULLET) or k in (ATTR, NUMBER) and n < 24 else (k, n, x) for k, n, x in lines]
    return lines
