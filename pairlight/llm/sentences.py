"""Sentence units of texts in any language, with positions.

Boundaries are disambiguated within the document first: a word that stands
before a period in the middle of a sentence somewhere is an abbreviation
everywhere in that document, a word that it uses without a period is none even
if a list below has it, a word that is written small elsewhere is no proper name.
Where the document says nothing, counts over the whole corpus decide, and last
the fixed lists, which also tell what kind of abbreviation a word is. Terminators,
quotation marks and the meaning of a space depend on the script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import cut, spread

#: Words of the corpus table up to which it is broadcast (some 60 MB); a larger one is joined to the words of each document.
CORPUS_WORDS = 500_000
#: Occurrences without a period from which the corpus alone takes a listed word for no abbreviation.
SURE = 50
#: Words a task counts before it passes them on.
HELD_WORDS = 200_000

# ---- fixed values ----

#: Abbreviations before a name.
TITLES = frozenset("mr mrs ms dr prof st sgt rev gen col capt lt hon fr sr sra srta dra lic ing dipl m mme mlle mm me mgr hr fr frl проф акад д-р г-н г-жа им ул пр डॉ श्री श्रीमती د أ م".split())
#: Abbreviations before a number or a reference.
REFERENCES = frozenset("no nos nr fig figs p pp pg pag pág págs sec sect ch chap vol art arts abs ziff bd anm eq tab n núm num стр рис см гл табл п пп ст s § ص".split())
#: Abbreviations that stand inside a sentence.
INNER = frozenset("approx ca circa cf esp est e.g i.e eg ie vs viz resp min max incl excl env aprox p.ex p.ej z.b d.h u.a o.ä bzw vgl ggf sog c.-à-d т.е т.к т.н ок напр ср al jan feb mar apr jun jul aug sep sept oct nov dec op dept ext tel ex ej lat gr u.s u.k av apdo pdo z d".split())
#: Abbreviations that may end a sentence.
ENDING = frozenset("etc usw a.m p.m am pm inc ltd co corp jr sen bros u.ä usf ff г гг др т.д т.п d.c ph.d b.c a.d no.s ee.uu".split())
LISTED = TITLES | REFERENCES | INNER | ENDING
MONTHS_DE = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Words of speaking that follow a quotation without white space or letter case to show it.
SPEECH = regex.compile(r"(?:[^。！？!?，,：:\n]{0,14}(?:问道?|說道?|说道?|答道?|回答|喊道?|叫道?|寫道|写道|表示|道)(?=[。！？，,：:\n]|$))|(?:と|って)|(?:\s*(?:قال|قالت|سأل|سألت|أجاب|أجابت|أضاف))|(?:\s+(?:said|asked|replied|answered|wrote|says|sagte|fragte|antwortete|rief|schrieb|dit|demanda|répondit|dijo|preguntó|respondió)\b)|(?:\s+\p{Lu}\w+\s+(?:said|asked|replied|answered|wrote|ने (?:पूछा|कहा))\b)")
#: Words that a heading or any complete line does not end with.
OPEN_WORDS = frozenset("a an the of in on at by for from to with and or but that than as is are was were be been has have had not no its their his her this these those if when which who der die das dem den des ein eine einen einem einer und oder aber dass in im am an auf von vom zu zum zur für mit bei als ist sind war le la les l un une des du de d au aux et ou mais que qui en dans par pour sur avec est el los las una unos del al y o pero con por para se es lo и в на с по к о от до из для что".split())

#: Nouns that a single letter labels.
LABELLED = frozenset("side part group item section option type class plan model team version level grade point vitamin hepatitis figure table answer variant run system seite teil gruppe typ klasse côté partie groupe lado parte grupo tipo сторона группа часть".split())

OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "”": "”", '"': '"', "‟": "”", "《": "》"}
TERMINATORS = ".!?…。！？｡؟۔।॥⁇⁈⁉‼"
_OPENER = re.compile("[" + "".join(OPENERS) + "]")
_PAIR = {o: re.compile(f"[{o}{c}]") for o, c in OPENERS.items()}
_MARKS = re.compile(rf"([{TERMINATORS}]+)|\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_CLOSERS = "\"”’»›)]}」』）】》〉“"
_EMOTICON = regex.compile(r"[ \t]*(?:(?:[:;=][-o^']?[)(DPp/\\|*\]\[]+|\^_?\^|<3)(?![\p{L}\p{N}])|(?:[\U0001F1E6-\U0001F1FF]{2}|[\U0001F300-\U0001FAFF\u2600-\u27BF][\uFE0F\U0001F3FB-\U0001F3FF]*(?:\u200d[\U0001F300-\U0001FAFF\u2600-\u27BF][\uFE0F\U0001F3FB-\U0001F3FF]*)*))")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")
_ITEM = regex.compile(r"\s*(?:[-*•‣▪·–—]|\(?\p{N}{1,3}[.)、]|\(?\p{L}\))\s+(?=\S)")
_CONCLUSION = regex.compile(r"\s*[*_\"'“”]*conclusion\s*[:：]\s*(?:yes|no)\W*\s*$", regex.I)
_THAI_SPACE = regex.compile(r"(?<=[\p{Thai}--[฿๐-๙]])[^\S\n\r]+(?=[\p{Thai}--[฿๐-๙]])", regex.V1)
_THAI = re.compile("[\u0e01-\u0e3a\u0e40-\u0e5b]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_NEXT = regex.compile(r"[\s\p{Ps}\p{Pi}\"'„¿¡]*(?:(\p{Ll}[\p{L}\p{M}'’-]*)|(\p{Lu}[\p{L}\p{M}'’-]*)|(\p{N})|(\p{L}))?")
_BEFORE = regex.compile(r"(?:(?<=^|[\s(\[«“„\"'’‘/—–-])|(?<=\b))((?:\p{L}\p{M}*\.[ \xa0\u202f]?)+\p{L}\p{M}*|[\p{L}\p{M}-]+)$")
_INITIALS = regex.compile(r"(?:\p{Lu}\.\s)+\p{Lu}")
_THIN = str.maketrans("", "", " \xa0\u202f")
_BLANKS = re.compile(r"[ \t\xa0\u202f]*")
_SPACES = re.compile(r"\s*")
_NUMBER = regex.compile(r"[\p{N}.,:]+$")
_LAST_WORD = regex.compile(r"(\p{L}+)$")
_NOUN = regex.compile(r"(\p{L}+)\s+$")
_DASH_ON = regex.compile(r"[—–-]+[\s\p{Ll}]")
_LOWER_START = regex.compile(r"\p{Ll}")
_ON = regex.compile(r"\p{Ll}|[,;.)]")
_UPPER_LINE = regex.compile(r"[\p{Lu}\p{N}\p{Lo}«“„\"¿¡(]")
_UNCLOSED = regex.compile(r"[\"“„«][^\"”“»]*$")
_CASED = regex.compile(r"[\p{Lu}\p{N}\p{Ll}]")
_TAIL = re.compile(rf"[{re.escape(_CLOSERS)}\s]+$")
_LINKED = regex.compile(r"[\p{L}\p{N}_-]*(?:[.@/][\p{L}\p{N}]|@)")


# ---- counts ----


def _ranges(*kinds: str) -> str:
    """The characters of some Unicode categories as the body of a character class."""
    out, begin = [], None
    for c in range(0x30000):
        if (unicodedata.category(chr(c)) in kinds) != (begin is not None):
            if begin is None:
                begin = c
            else:
                out.append((begin, c - 1))
                begin = None
    return "".join(re.escape(chr(a)) + ("" if a == b else "-" + re.escape(chr(b))) for a, b in out)


_MARK, _LOWER, _UPPER = _ranges("Mn", "Mc", "Me"), _ranges("Ll"), _ranges("Lu", "Lt")
_LETTER = r"[^\W\d_]"
_W = rf"{_LETTER}(?:{_LETTER}|[{_MARK}'’-])*"
#: All words; in the reversed text, those before a period; those inside a sentence; those that begin a paragraph.
_ALL = re.compile(_W)
_POINT = re.compile(rf"\.((?:{_LETTER}|[{_MARK}'’-])*{_LETTER})")
_INSIDE = re.compile(rf"(?<=[\w{_MARK},)][ \xa0 ]){_W}")
_FIRST_WORD = re.compile(rf"(?:\A\s*|(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*)([{_LOWER}](?:{_LETTER}|[{_MARK}'’-])*)")

#: columns of the counts: written small inside a sentence, written large inside one,
#: before a period inside a sentence, without a period, small at the start of a paragraph,
#: before a period that a large letter follows
SMALL, LARGE, DOTTED, PLAIN, SMALL_START, DOT_LARGE = KINDS = range(6)


def occurrences(text: str) -> Counter:
    """(word, kind) counts of the unambiguous occurrences in one text, words in small letters."""
    out: Counter = Counter()
    plain = Counter(_ALL.findall(text))
    end = len(text)
    for m in _POINT.finditer(text[::-1]):
        w = m.group(1)[::-1]
        plain[w] -= 1
        at = end - m.start()
        after = text[at : at + 3]
        if after[:1] and after[0] in ",;:" or after[:1].isspace() and after[1:2].islower():
            out[w.lower(), DOTTED] += 1
        elif after.lstrip()[:1].isupper():
            out[w.lower(), DOT_LARGE] += 1
    for w, n in plain.items():
        if n > 0:
            out[w.lower(), PLAIN] += n
    for w, n in Counter(_INSIDE.findall(text)).items():
        out[w.lower(), SMALL if w[0].islower() else LARGE] += n
    for w in _FIRST_WORD.findall(text):
        out[w, SMALL_START] += 1
    return out


def _corpus_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[int]] = {}

    def rows() -> pd.DataFrame:
        n = np.array(list(held.values()), dtype=np.int64).reshape(-1, len(KINDS))
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object)} | {f"n{k}": n[:, k] for k in KINDS})

    for b in batches:
        # texts one after the other, a blank line between any two
        for (w, kind), n in occurrences("\n\n".join(t for t in b["text"] if t)).items():
            held.setdefault(w, [0] * len(KINDS))[kind] += n
        if len(held) > HELD_WORDS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def corpus_counts(documents: DataFrame) -> DataFrame:
    """``word`` and its counts over all documents, of all words whose counts can decide anything.

    That takes a word more than twice, and once small or before a period; names
    are none. No word is left out for being rare among these, or long.
    """
    total = sum((F.col(f"n{k}") for k in KINDS[1:]), F.col("n0"))
    return (
        spread(documents.select("text")).mapInPandas(_corpus_counts, "word string, " + ", ".join(f"n{k} bigint" for k in KINDS))
        .groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in KINDS])
        .where((F.col(f"n{SMALL}") + F.col(f"n{SMALL_START}") + F.col(f"n{DOTTED}") > 0) & (total > 2))
    )


class Evidence:
    """Answers about words: the document's own occurrences first, then the corpus.

    The document is searched when a word is asked for, and only for that word.
    """

    def __init__(self, text: str, corpus: dict[str, tuple[int, ...]] | None):
        self.text, self.corpus = text, corpus
        self.low = low if len(low := text.lower()) == len(text) else text
        self.kept: dict[str, tuple[int, int, int]] = {}
        self.smalls: dict[str, bool] = {}
        self.starts: Counter | None = None

    def _of(self, w: str) -> tuple[int, ...] | None:
        return self.corpus.get(w) if self.corpus else None

    def _places(self, w: str) -> Iterator[int]:
        """Where the document has the word, in any case."""
        at = self.low.find(w) if w else -1
        while at >= 0:
            end = at + len(w)
            if not (at and _inner(self.low[at - 1])) and not (end < len(self.low) and _inner(self.low[end])):
                yield at
            at = self.low.find(w, end)

    def own(self, w: str) -> tuple[int, int, int]:
        """Times before a period inside a sentence, as a word of its own, and before a period and a large letter.

        A word of its own is followed by a small word or a mark; before a large word
        or a number it may be an abbreviation without its period.
        """
        if w not in self.kept:
            dotted = plain = large = 0
            for at in self._places(w):
                after = self.text[at + len(w) : at + len(w) + 4]
                if after[:1] == ".":
                    if after[1:2] and after[1] in ",;:" or after[1:2].isspace() and after[2:3].islower():
                        dotted += 1
                    elif after[1:].lstrip()[:1].isupper():
                        large += 1
                elif not after.strip() or after[0] in ",;:!?)”»\"" or after[0].isspace() and after[1:2].islower():
                    plain += 1
            self.kept[w] = dotted, plain, large
        return self.kept[w]

    def abbreviation(self, w: str) -> bool:
        """A word that stands before a period inside sentences, by the document or by the corpus."""
        dotted, plain, large = self.own(w)
        if plain or large > dotted:
            return False
        if dotted > 1:
            return True
        c = self._of(w)
        if c is None or c[DOT_LARGE] > c[DOTTED] or c[PLAIN] > c[DOTTED]:
            return False
        return c[DOTTED] >= 3

    def word(self, w: str) -> bool:
        """No abbreviation although a list has it: the document uses it as a word and never inside a sentence before a period.

        Where the document says neither, the corpus decides if nearly all its occurrences are of one kind.
        """
        dotted, plain, _ = self.own(w)
        if dotted or plain:
            return not dotted
        c = self._of(w)
        return c is not None and c[DOTTED] == 0 and c[PLAIN] >= SURE

    def common(self, w: str) -> bool:
        """A word that is written small elsewhere, so no proper name."""
        if w not in self.smalls:
            self.smalls[w] = any(self.text[at : at + len(w)] == w for at in self._places(w))
        if self.smalls[w]:
            return True
        c = self._of(w)
        return c is not None and c[SMALL] + c[SMALL_START] > 0 and c[SMALL] + c[SMALL_START] >= c[LARGE]

    def starts_small(self, w: str) -> bool:
        """A word that begins paragraphs although it is written small."""
        if self.starts is None:
            self.starts = Counter(_FIRST_WORD.findall(self.text))
        if self.starts[w]:
            return True
        c = self._of(w)
        return c is not None and c[SMALL_START] >= 3 and 4 * c[SMALL_START] >= c[SMALL]


def _inner(c: str) -> bool:
    return c.isalpha() or c in "'’-" or unicodedata.category(c)[0] == "M"


# ---- units ----


def _quotes(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations: positions of the opening and the closing mark."""
    out, i = [], begin
    while m := _OPENER.search(text, i, end):
        i = m.start()
        close = OPENERS[text[i]]
        # a mark after a letter closes (or is stray), one that nothing follows opens nothing
        if not (text[i] in '"”' and i > begin and not text[i - 1].isspace() and text[i - 1] not in "([—–-«“„:：,，。！？"):
            depth, j = 1, i + 1
            both = _PAIR[text[i]]
            while depth and (n := both.search(text, j, end)):
                j = n.start() + 1
                depth += -1 if n.group() in close else 1
            if not depth and j > i + 2:
                out.append((i, j - 1))
                i = j
                continue
        i += 1
    return out


def _period_ends(text: str, at: int, after: int, begin: int, know: Evidence, glued: bool) -> bool:
    """Whether the period at ``at`` ends a sentence; ``after`` is behind its closers."""
    nxt = _NEXT.match(text, after)
    small, large, digit, letter = nxt.groups()
    head, word = _before(text, begin, at)
    plain = word.translate(_THIN).lower()
    last = plain.rsplit(".", 1)[-1]
    closed = after > at + 1
    if glued:
        if not word and not text[at - 1 : at].isalnum():
            return bool(large) and not _LINKED.match(text, after)
        if digit or text[at - 1 : at].isdigit() and not large:
            return False
        if large and len(plain) == 1 and _labelled(text, head, word):
            return not _LINKED.match(text, after)
        if large:
            return not _LINKED.match(text, after) and len(last) > 1 and not (word[:1].isupper() and len(word) <= 3 and plain in TITLES) or (not word and text[at - 1 : at].isdigit() and not _LINKED.match(text, after)) or closed
        if small:
            return closed and know.starts_small(small.lower())
        return bool(letter) and not plain.isascii()
    if closed and not word:
        return not small or know.starts_small(small.lower())
    if "." in word and _INITIALS.fullmatch(word):  # initials before a name
        return False
    single = len(plain) == 1 and word.isupper()
    if large and plain in LISTED and len(plain) > 1 and know.word(plain):
        return True
    if single and large and _labelled(text, head, word):
        return True
    if plain in TITLES and not (plain == "m" and not word.isupper()):
        if small and not single:
            return False
        if not (single and _after_word(head, word)):
            return False
    if plain in INNER or last in INNER and "." in plain:
        return False
    if plain in REFERENCES and (digit or small or not large):
        return False
    if plain in REFERENCES and large and (len(plain) <= 3) and plain not in ("no", "s", "art"):
        return False
    if single:
        follows = _after_word(head, word)
        if digit:
            return follows
        if large:
            return follows and (know.common(large.lower()) or len(large) > 1 and large.lower() in TITLES | REFERENCES | INNER)
        return bool(small) and follows and know.starts_small(small.lower())
    if plain in ENDING or "." in plain:
        if small:
            return know.starts_small(small.lower())
        if "." in plain and plain not in ENDING:
            return bool(large) and know.common(large.lower())
        return True
    if word == "" and text[at - 1 : at].isdigit():
        number = _NUMBER.search(head)
        if large and number and len(number.group()) <= 2 and large.lower() in MONTHS_DE:
            return False
        return not small or know.starts_small(small.lower())
    if small:
        return not know.abbreviation(plain) and (know.starts_small(small.lower()) or len(plain) > 6)
    if know.abbreviation(plain):
        if digit:
            return False
        return bool(large) and know.common(large.lower()) and len(plain) > 3
    return True


def _after_word(head: str, word: str) -> bool:
    """Whether a small word stands before the single letter (side B., not E. N.)."""
    before = head[: len(head) - len(word)].rstrip()
    m = _LAST_WORD.search(before)
    return bool(m) and m.group(1)[0].islower() and len(m.group(1)) > 1 and m.group(1) not in OPEN_WORDS


def _labelled(text: str, head: str, word: str) -> bool:
    """Whether the letter is the label of the noun before it, by this document or the fixed list."""
    m = _NOUN.search(head[: len(head) - len(word)])
    if not m or not m.group(1)[0].islower() or m.group(1) in OPEN_WORDS:
        return False
    return m.group(1) in LABELLED or regex.search(rf"\b{m.group(1)}\s+{word}\b(?!\.)", text) is not None


def _goes_on(text: str, after: int, end: int, know: Evidence) -> bool:
    """Whether the sentence continues behind a terminator other than a period."""
    at = _SPACES.match(text, after, end).end()
    if at >= end:
        return False
    if text[at] in ",;:)，；：、،؛" or _DASH_ON.match(text, at, end):
        return True
    m = _NEXT.match(text, after)
    if m.group(1):
        return not know.starts_small(m.group(1).lower()) and text[at] not in "¿¡„“«\""
    return False


def _line_ends(text: str, start: int, brk: int, nxt: int, end: int, quoted: bool) -> bool:
    """Whether the single line break at ``brk`` ends the unit that begins at ``start``."""
    before, at = text[start:brk].rstrip(), _SPACES.match(text, nxt, end).end()
    if not before or at >= end:
        return True
    after = text[at]
    line_end = _BREAK.search(text, nxt)
    line = text[nxt : line_end.start() if line_end and line_end.start() < end else end]
    if _CONCLUSION.match(line) or _ITEM.match(line):
        return True
    if _ITEM.match(before) and not _BREAK.search(before.strip()):
        return True
    if _CONCLUSION.match(before):
        return True
    if quoted:
        return False
    if _THAI.match(before[-1]) or _THAI.match(after[0]):
        return True
    tail = _TAIL.sub("", before)
    if tail[-1:] and tail[-1] in TERMINATORS and (tail[-1] != "." or tail != before):
        return after not in ",;)" and not _LOWER_START.match(after)
    if _ON.match(after):
        return False
    words = before.split()
    if _CJK.search(before[-1]):
        return len(before) <= 16 or not _CJK.match(after[0])
    if _BREAK.search(before) or len(before) > 60 or len(words) > 8:
        return False
    last = "".join(c for c in words[-1] if c.isalnum() or c == "_").lower()
    return before[-1] not in ",;-–—" and last not in OPEN_WORDS and _UPPER_LINE.match(before) is not None and after not in "“„«\"(" and not _UNCLOSED.search(before)


def units(text: str | None, corpus: dict[str, tuple[int, ...]] | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in code points; none for null and blank."""
    if not text or not text.strip():
        return []
    know = Evidence(text, corpus)
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        _paragraph(text, at, end, know, out)
        at = m.end() if m else end
    return out


def _paragraph(text: str, begin: int, end: int, know: Evidence, out: list[tuple[int, int]]) -> None:
    quotes = _quotes(text, begin, end)
    # a quotation hides the marks inside it; its end counts as one where a mark stands before it
    marks: list[tuple[int, int, str]] = []
    pos = begin
    for o, c in [*quotes, (end, end)]:
        marks += [(m.start(), m.end(), "mark" if m.group(1) else "break") for m in _MARKS.finditer(text, pos, o)]
        inner = text[o + 1 : c].rstrip()
        if inner and inner[-1] in TERMINATORS:
            marks.append((o, c, "quote"))
        marks += [(m.start(), m.end(), "qbreak") for m in _BREAK.finditer(text, o, c)]
        pos = c + 1
    for m in _THAI_SPACE.finditer(text, begin, end) if _THAI.search(text, begin, end) else ():
        if not any(o < m.start() < c for o, c in quotes):
            marks.append((m.start(), m.end(), "space"))
    marks.sort()
    start = line = begin
    opening = {o for o, _ in quotes}
    item_of, item = -1, None

    def close_unit(stop: int) -> None:
        nonlocal start
        s, e = start, stop
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))
        start = stop

    for s, e, kind in marks:
        if kind in ("break", "qbreak") and text[e - 1] in "\r\n":
            line = e
        if e <= start:
            continue
        if kind in ("break", "qbreak"):
            if _line_ends(text, start, s, e, end, kind == "qbreak"):
                close_unit(s)
            continue
        if kind == "space":
            close_unit(s)
            continue
        if kind == "quote":
            stop = e + 1
            stop = _closers(text, stop, end, opening)
            unit_start = start
            while unit_start < s and text[unit_start].isspace():
                unit_start += 1
            opened = unit_start >= s
            rest = _BLANKS.match(text, stop, end).end()
            if rest < end and text[rest] in TERMINATORS:
                continue
            if _goes_on(text, _emoticon(text, stop, end), end, know):
                continue
            if (opened or text[stop : stop + 1] in ("と", "っ")) and SPEECH.match(text, stop, end):
                continue
            close_unit(_emoticon(text, stop, end))
            continue
        mark = text[s:e]
        # the mark of a list item or numbered heading ends nothing
        if item_of != line:
            item_of, item = line, _ITEM.match(text, line, end)
        if item and s < item.end():
            continue
        stop = _closers(text, e, end, opening)
        glued = stop < end and not text[stop].isspace()
        if mark[-1] == "." and len(mark) == 1:
            after = _emoticon(text, stop, end)
            rest = _BLANKS.match(text, after, end).end()
            if rest < end and text[rest] in ",;:":
                continue
            if stop >= end:
                close_unit(stop)
                continue
            if _BREAK.match(text, stop):
                if not _abbreviated(text, s, begin, know):
                    close_unit(stop)
                elif not _CASED.match(text, _SPACES.match(text, stop, end).end(), end):
                    close_unit(stop)
                elif _period_ends(text, s, stop, begin, know, False):
                    close_unit(stop)
                continue
            if _period_ends(text, s, stop, begin, know, glued):
                close_unit(after)
            continue
        if mark[0] in "….":  # dots of omission
            if glued and _CJK.match(text[stop]) or glued and mark[0] == "…" and text[stop].isalnum() and not text[stop].isupper():
                continue
            m = _NEXT.match(text, stop)
            if m.group(1) and (not know.starts_small(m.group(1).lower()) or text[s - 1 : s].isspace()):
                continue
            if s == start or not text[start:s].strip():
                continue
            rest = _SPACES.match(text, stop, end).end()
            if rest >= end or text[rest] in ",;:)":
                if rest < end:
                    continue
            close_unit(_emoticon(text, stop, end))
            continue
        if _goes_on(text, _emoticon(text, stop, end), end, know):
            continue
        if glued and mark[-1] in "!?" and _LINKED.match(text, stop) and text[stop].islower():
            continue
        close_unit(_emoticon(text, stop, end))
    close_unit(end)


def _abbreviated(text: str, at: int, begin: int, know: Evidence) -> bool:
    w = _before(text, begin, at)[1].translate(_THIN).lower()
    return w in TITLES or w in REFERENCES or w in INNER or (len(w) == 1 and w.isalpha()) or (bool(w) and know.abbreviation(w))


def _before(text: str, begin: int, at: int) -> tuple[str, str]:
    """What stands before the period, from where its word begins at the latest, and that word."""
    far = 24
    while True:
        low = max(begin, at - far)
        head = text[low:at]
        m = _BEFORE.search(head)
        if low == begin or not m or m.start(1) > 1:
            return head, m.group(1) if m else ""
        far *= 4


def _closers(text: str, at: int, end: int, opening: set[int]) -> int:
    """Behind the closing quotes and brackets at ``at``; an opening mark is none."""
    while at < end and text[at] in _CLOSERS and at not in opening:
        at += 1
    return at


def _emoticon(text: str, at: int, end: int) -> int:
    while (k := _BLANKS.match(text, at, end).end()) < end and (text[k] in ":;=^<" or text[k] >= "\u2600"):
        if not (m := _EMOTICON.match(text, at, end)):
            break
        at = m.end()
    return at


def sentence_units(documents: DataFrame, broadcast_words: int = CORPUS_WORDS) -> DataFrame:
    """``doc_id``, ``sent_start``, ``sent_end`` of every unit of every document.

    Null and blank texts have none. One row a unit; repeated doc ids give their
    units each. Other columns are not read. Words are counted over all documents
    in a first pass. A table of up to ``broadcast_words`` words is broadcast; of a
    larger one each document gets the counts of the words beside its periods, the
    only ones that are asked for, by a join, with the same result.
    """
    counts = cut(corpus_counts(documents))
    schema = "doc_id bigint, sent_start int, sent_end int"
    rows = documents.select("doc_id", "text")
    if counts.count() <= broadcast_words:
        table = documents.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in counts.collect()})

        def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            corpus = table.value
            for b in batches:
                yield _unit_rows(b["doc_id"], [units(t, corpus) for t in b["text"]])

        return spread(rows).mapInPandas(cut_up, schema)

    @F.pandas_udf("array<string>")
    def asked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(questions(t)) if t else [])

    placed = cut(spread(rows).withColumn("row", F.monotonically_increasing_id()))
    words = placed.select("row", F.explode(asked("text")).alias("word"))
    known = words.join(counts, "word").groupBy("row").agg(F.collect_list(F.struct("word", F.array(*[f"n{k}" for k in KINDS]).alias("n"))).alias("known"))

    def cut_up_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [units(t, {x["word"]: tuple(x["n"]) for x in k} if k is not None else {}) for t, k in zip(b["text"], b["known"])]
            yield _unit_rows(b["doc_id"], found)

    return placed.join(known, "row", "left").select("doc_id", "text", "known").mapInPandas(cut_up_joined, schema)


def questions(text: str) -> set[str]:
    """All words that the corpus may be asked about for this text: those before a period and those behind a mark."""
    out = {w.translate(_THIN).lower() for m in _DOT.finditer(text) for w in (_before(text, max(0, text.rfind("\n", 0, m.start())), m.start())[1], _before(text, 0, m.start())[1]) if w}
    for m in _AFTER_MARK.finditer(text):
        out.add(m.group(2).lower())
    return out


_DOT = re.compile(r"\.")
_AFTER_MARK = re.compile(rf"[{re.escape(TERMINATORS + _CLOSERS)}](?=([^\w]*)({_W}))")


def _unit_rows(ids: pd.Series, found: list[list[tuple[int, int]]]) -> pd.DataFrame:
    flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
    n = np.array([len(f) for f in found])
    return pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").repeat(n).reset_index(drop=True), "sent_start": flat[:, 0], "sent_end": flat[:, 1]})
