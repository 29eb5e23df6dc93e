"""Sentence boundaries across languages and scripts.

The rules follow the character-property sentence-break rules of the Unicode standard: terminators of all scripts end a
sentence together with the closing marks behind them; a full stop is ambiguous and ends nothing before a lower-case
letter, within numbers, or after an abbreviation.  Beyond them:

* abbreviations are suppressed by language: some never end a sentence, some end none before a number, single letters are
  initials.  The languages of a block are those of its script whose function words are frequent in it; where it has none,
  those of the whole text, else the language of its tag, else all of the script;
* quotations and brackets are matched first; marks inside one end nothing, except that the last mark before the closing
  sign ends a sentence of which the quotation is the end.  What follows decides: a comma, a lower-case letter or a joined
  particle goes on; in scripts without case a quotation goes on unless a colon introduced it;
* an ellipsis ends a sentence unless a lower-case letter follows;
* a blank line always ends a unit, a single line break does not;
* in scripts without sentence marks (Thai, Lao, Khmer, Burmese) white space ends a sentence.

Offsets count code points, begin inclusive, end exclusive, without outer white space.  Defined cases: null, empty and
blank texts have no sentences; units without a letter or digit are none; a mark that is doubled ends one sentence; an
opening sign without its closing one counts as none; long texts are taken whole, in time proportional to their length; a
language tag that is null, wrong or unknown does no harm where the text has function words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: abbreviations by language

#: no sentence ends after these; those with a capital are no abbreviations in lower case
NEVER_LAST = {
    "en": "mr mrs ms dr prof St lt Col Gen sgt capt Rev Hon e.g i.e i.a cf vs viz approx messrs Mt",
    "de": "hr fr dr prof fa bzw ca z.b u.a d.h i.d.r vgl evtl ggf inkl zzgl sog gem geb nr abs bspw",
    "fr": "M MM mme mlle dr mgr env cf p.ex art éd chap",
    "es": "sr sra srta dr dra d dña ee aprox p.ej núm pág págs art cf ud uds",
    "pt": "sr sra dr dra aprox p.ex art cf núm pág av",
    "ru": "см тыс млн млрд т.е ул просп им акад проф гр руб напр",
    "hi": "डॉ श्री प्रो सं",
}
#: no sentence ends after these if a number follows
NOT_BEFORE_NUMBER = {
    "en": "no nos fig figs art arts sec secs p pp vol vols para paras ver rev ed ch min max jan feb mar apr jun jul aug sep sept oct nov dec temp eq tab",
    "de": "nr abs art ziff kap s abb tab bd anl",
    "fr": "n fig vol éd rév art p pp chap al",
    "es": "núm n fig cap pág págs art vol tel",
    "pt": "n fig cap pág págs art vol tel núm",
    "ru": "п пп ст рис табл с стр гл ч т №",
}
#: German words before an ordinal number, and the names of its months
ORDINAL_BEFORE = frozenset("am zum vom im bis ab der die das den dem des beim seit nach vor jeder jeden ihr sein".split())
ORDINAL_AFTER = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Abschnitt".split())

#: frequent function words by language
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with be by on not are or an at from this have which all must shall if when than then each its has were those near since no longer as said these will been who where there they only into",
    "de": "der die das und ist von zu den mit für im auf nicht eine ein einer einen wird muss sind bei oder werden dem des nach aus an als auch durch wenn vor am zur zum dass sich wurde wurden hat haben es sie er jeder jede nur noch über unter gemäß gilt sowie siehe",
    "fr": "le la les des et est une du dans pour que qui sur par doit au aux ou avec ne pas un il sont ce cette être en à sans si chaque ont été ceux de dit elle ils leur ces nous vous mais plus se son sa ses",
    "es": "el la los las de del en un una por con se su no será que y al es para como debe o son más lo si sin cada este esta han fue sus pero dijo pidió ha ser está entre desde hasta sobre",
    "pt": "o a os as do da dos das em um uma não com deve que e para por se no na é ao ou são mais como sem cada este esta foi foram disse pediu sua seu pelo pela até entre sobre nos nas",
}
_NEVER = {k: frozenset(ws.split()) for k, ws in NEVER_LAST.items()}
_NUMBER = {k: frozenset(ws.split()) for k, ws in NOT_BEFORE_NUMBER.items()}
_ABBREVIATED = frozenset().union(*_NEVER.values(), *_NUMBER.values())
_FUNCTION = {k: frozenset(ws.split()) for k, ws in FUNCTION_WORDS.items()}
_OWNERS: dict[str, tuple[str, ...]] = {w: tuple(k for k in _FUNCTION if w in _FUNCTION[k]) for w in frozenset().union(*_FUNCTION.values())}
_LETTERS = regex.compile(r"\p{L}+")
_SCRIPTS = {"ru": regex.compile(r"\p{Cyrillic}"), "hi": regex.compile(r"\p{Devanagari}")}

_BLANK = regex.compile(r"(?:\r\n|[\n\r\u0085 ])[^\S\n\r\u0085  ]*(?:\r\n|[\n\r\u0085 ])\s*| \s*")
#: Sentence_Terminal without the ambiguous full stops (the property of the standard), and the ellipsis
_EVENT = regex.compile(r"[.․﹒．…\p{Sentence_Terminal}]+|[\"“”„‟«»‹›「」『』《》()（）\[\]【】{}]")
_PAIRS = {"«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "„": "“”‟", "“": "”", "»": "«"}
_OPENED_BY = {c: tuple(o for o, cs in _PAIRS.items() if c in cs) for c in set("".join(_PAIRS.values()))}
_CLOSERS = frozenset("»›」』》)）]】}”“\"'’‟")
_OPEN_SKIP = frozenset("\"“”„‟«»‹›「『《(（[【{¿¡—–―-•*·’‘' \t\r\n  　 ")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_MARKLESS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_MARKLESS_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{M}][^\s\p{L}]{0,12})\s+(?=[^\s\p{Ll}])")
_WORD_SIGN = regex.compile(r"[\p{M}\p{N}№]")
_NUMBERED = regex.compile(r"(?m)^[ \t]*\d{1,3}\. ")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_BRACKETS = frozenset("(（[【{")
_GO_ON = frozenset(",;:、，；：،؛")


def _intervals(text: str, beg: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets, as (position of opening, of closing sign)."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each opening sign, in the stack
    found: list[tuple[int, int]] = []

    def close(k: int, at: int) -> None:
        found.append((stack[k][1], at))
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def open_(ch: str, at: int) -> None:
        places.setdefault(ch, []).append(len(stack))
        stack.append((ch, at))

    for m in _EVENT.finditer(text, beg, end):
        ch, at = m.group(), m.start()
        if ch == '"':
            before = text[at - 1] if at > beg else " "
            after = text[at + 1] if at + 1 < end else " "
            k = places['"'][-1] if places.get('"') else -1
            if k >= 0 and not (before.isspace() and not after.isspace()):
                close(k, at)
            elif not after.isspace() and not (before.isalnum() and before < "\u0600"):
                open_('"', at)
            continue
        k = max((places[o][-1] for o in _OPENED_BY.get(ch, ()) if places.get(o)), default=-1)
        if k >= 0:
            close(k, at)
        elif ch in _PAIRS and ch != "»":
            open_(ch, at)
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _languages(text: str, beg: int, end: int) -> frozenset[str]:
    """The languages whose function words are frequent in a stretch of text."""
    counts = dict.fromkeys(_FUNCTION, 0)
    for m in _LETTERS.finditer(text, beg, end):
        owners = _OWNERS.get(m.group().lower(), ())
        for k in owners:
            counts[k] += 12 // len(owners)
    # a sentence in another language may stand among many
    most = max(counts.values())
    return frozenset(k for k, n in counts.items() if n and 8 * n >= most)


class _Text:
    """A text with its tag, and what is known of all of it."""

    def __init__(self, text: str, tag: str | None):
        self.text = text
        tag = (tag or "").strip().lower()[:2]
        self.tag = frozenset([tag]) & _FUNCTION.keys()
        self._all: frozenset[str] | None = None

    def languages(self) -> frozenset[str]:
        if self._all is None:
            self._all = _languages(self.text, 0, len(self.text)) or self.tag or frozenset(_FUNCTION)
        return self._all


class _Block:
    """A stretch of text between blank lines."""

    def __init__(self, whole: _Text, beg: int, end: int):
        self.whole, self.text, self.beg, self.end = whole, whole.text, beg, end
        self.inner = _intervals(self.text, beg, end)
        self.opens = {o for o, _ in self.inner}
        self._languages: frozenset[str] | None = None
        self._numbers: int | None = None
        self._run = (-1, -1)

    def languages(self) -> frozenset[str]:
        if self._languages is None:
            self._languages = _languages(self.text, self.beg, self.end) or self.whole.languages()
        return self._languages

    def numbers(self) -> int:
        """Lines that begin with a number."""
        if self._numbers is None:
            self._numbers = sum(1 for _ in _NUMBERED.finditer(self.text, self.beg, self.end))
        return self._numbers

    def word(self, dot: int) -> int:
        """Where the run of words joined by full stops before ``dot`` begins."""
        text, i = self.text, dot
        while i > self.beg:
            if i == self._run[1] and text[i - 1 : i + 1] != "..":  # goes on from the run before
                i = self._run[0]
                break
            c = text[i - 1]
            if c.isalnum() or _WORD_SIGN.match(c):
                i -= 1
            elif c == "." and i < dot and i - 1 > self.beg and (text[i - 2].isalnum() or _WORD_SIGN.match(text[i - 2])):
                i -= 1
            else:
                break
        self._run = (i, dot)
        return i

    def before(self, i: int) -> str:
        """The last stretch without white space before position i."""
        text = self.text
        while i > self.beg and text[i - 1].isspace():
            i -= 1
        e = i
        while i > self.beg and not text[i - 1].isspace():
            i -= 1
        return text[i:e]

    def stands(self, table: dict[str, frozenset[str]], word: str) -> bool:
        """Whether the word is in the table of a language of this block."""
        low = word.lower()
        if low not in _ABBREVIATED and word.capitalize() not in _ABBREVIATED and word.upper() not in _ABBREVIATED:
            return False
        forms = {low} if word.islower() or "." in word else {low, low.capitalize(), low.upper()}
        own = [k for k, p in _SCRIPTS.items() if p.match(word)] or self.languages()
        return any(not forms.isdisjoint(table.get(k, ())) for k in own)


def _is_abbreviation(block: _Block, dot: int, nxt: str) -> bool:
    """Whether the word before the full stop at ``dot`` goes on with a word that begins with ``nxt``."""
    text = block.text
    at = block.word(dot)
    if at == dot:
        return False
    word = text[at:dot]
    low = word.lower()
    if nxt.isdigit():
        return block.stands(_NUMBER, word) or block.stands(_NEVER, word)
    if block.stands(_NEVER, word):
        return True
    if len(word) == 1 and word.isalpha():
        last = block.before(at)
        if text[at - 1 : at] in ("/", "-", "·"):
            return False  # a unit
        if low in "дп" and last.lower() in ("т.", "т"):
            return False  # "and so on" may end a sentence
        if low == "г":
            return not last[-4:].isdigit()  # a year, else a town
        if low == "с" and last[-1:].isdigit():
            return False
        return word.isupper() or low not in "аяиео"  # an initial
    if "." in word:
        parts = word.split(".")
        if all(len(p) == 1 for p in parts):
            return low not in ("a.m", "p.m", "т.д", "т.п", "н.э") and word.isupper()
        return False
    if word.isdigit() and len(word) <= 2:
        return block.before(at).lower() in ORDINAL_BEFORE
    return False


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of every sentence of a text."""
    spans: list[tuple[int, int]] = []
    if not text:
        return spans
    whole = _Text(text, lang)
    at = 0
    for m in _BLANK.finditer(text):
        _block(whole, at, m.start(), spans)
        at = m.end()
    _block(whole, at, len(text), spans)
    return spans


def _block(whole: _Text, beg: int, end: int, spans: list[tuple[int, int]]) -> None:
    if beg >= end:
        return
    text, block = whole.text, _Block(whole, beg, end)
    cuts = _cuts(block)
    if _MARKLESS.search(text, beg, end):
        k = 0
        for m in _MARKLESS_GAP.finditer(text, beg, end):
            while k < len(block.inner) and block.inner[k][1] <= m.start():
                k += 1
            if k == len(block.inner) or not block.inner[k][0] < m.start():
                cuts.append(m.start())
        cuts = sorted(set(cuts))
    at = beg
    for cut in [*cuts, end]:
        b, e = at, cut
        while b < e and text[b].isspace():
            b += 1
        while e > b and text[e - 1].isspace():
            e -= 1
        if b < e and _ALNUM.search(text, b, e):
            spans.append((b, e))
        at = cut


def _cuts(block: _Block) -> list[int]:
    text, beg, end, inner = block.text, block.beg, block.end, block.inner
    cuts: list[int] = []
    k, start = 0, beg
    for m in _EVENT.finditer(text, beg, end):
        marks, at, stop = m.group(), m.start(), m.end()
        if marks[0] in _PAIRS or marks[0] in _CLOSERS:
            continue
        if at < start:
            continue
        while k < len(inner) and inner[k][1] < at:
            k += 1
        opened = -1
        if k < len(inner) and inner[k][0] < at:
            o, c = inner[k]
            # only the last mark before the closing sign can end the sentence
            n = stop
            while n < c and (text[n].isspace() or text[n] in _CLOSERS):
                n += 1
            if n < c:
                continue
            opened, stop = o, c + 1
        while stop < end and text[stop] in _CLOSERS and not (text[stop] in '"“' and stop + 1 < end and not text[stop + 1].isspace() and opened >= 0 and text[stop + 1].isalnum()):
            if stop in block.opens:
                break
            stop += 1
        if _ends(block, start, marks, at, stop, opened):
            cuts.append(stop)
            start = stop
    return cuts


def _ends(block: _Block, start: int, marks: str, at: int, stop: int, opened: int) -> bool:
    text, beg, end = block.text, block.beg, block.end
    if stop >= end:
        return True
    joined = not text[stop].isspace()
    if text[stop] in _GO_ON:
        return False
    n = stop
    while n < end and text[n] in _OPEN_SKIP:
        n += 1
    nxt = text[n] if n < end else ""
    if not nxt:
        return True
    if nxt.islower() and n + 1 < end and text[n + 1].isupper():
        nxt = nxt.upper()  # such as "pH": a name, not the middle of a sentence
    skipped = text[stop:n]
    prev = text[at - 1] if at > beg else " "
    full_stop = marks in (".", "․", "﹒")
    wide = all(c in "。｡．！？।॥｡．" for c in marks.lstrip(".…")) and marks.lstrip(".…") != ""
    if opened >= 0:  # the mark stands before the closing sign of a quotation or bracket
        i = opened
        while i > start and text[i - 1].isspace():
            i -= 1
        before = text[i - 1] if i > start else ""
        if text[opened] in _BRACKETS:
            return not before and not (joined and nxt.islower())
        if nxt.islower():
            return False
        if joined and _CASELESS.match(nxt):
            return before in (":", "：") if not skipped else True
        if joined and nxt.isalnum():
            return nxt.isupper()
        return True
    if wide:
        return True
    if full_stop:
        if joined and not skipped:
            if prev.isdigit() or nxt.isdigit():
                return False
            begin = block.word(at)
            dot = text.rfind(".", begin, at)
            word = text[max(begin, dot + 1) : at]
            if nxt.isupper() and len(word) >= 3 and word[-2:].islower() and dot < begin:
                after = text[n + 1] if n + 1 < end else " "
                return after.islower() or after.isspace()
            if prev in ")]”»\"" and nxt.isupper():
                return True
            long = at - begin >= 2 and not (word.isascii() and text[begin:at].isascii())
            caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower() and long
            return bool(caseless and not _MARKLESS.match(nxt))
        if nxt.islower():
            return False
        if not _ALNUM.match(text[at - 1 : at] or " ") and prev in ")]”»\"":
            return True
        if prev.isdigit():
            line = at
            while line > beg and text[line - 1].isdigit():
                line -= 1
            while line > beg and text[line - 1] in " \t":
                line -= 1
            if line == beg or text[line - 1] in "\r\n":
                if block.numbers() > 1 or line == beg and at - line <= 4 and not any(c in "\r\n" for c in skipped):
                    return False  # the number of a list item
        if prev.isdigit() and nxt.isupper():
            word = _LETTERS.match(text, n)
            if word and word.group() in ORDINAL_AFTER:
                return False
        return not _is_abbreviation(block, at, nxt)
    if set(marks) <= {".", "…"}:  # an ellipsis
        return not nxt.islower() and not (joined and not skipped and nxt.isalnum() and not _CASELESS.match(nxt) and not nxt.isupper())
    # question and exclamation marks
    if nxt.islower():
        return not joined and not skipped.strip()
    return True


FIELDS = "src_field string, rec_id long, beg_off int, end_off int"


def sentences(records: DataFrame, with_text: bool = False) -> DataFrame:
    """(src_field, rec_id, beg_off, end_off[, sentence]) of records (src_field, rec_id, text[, lang])."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, key, text, lang in zip(pdf["src_field"], pdf["rec_id"], pdf["text"], pdf["lang"], strict=True):
                for b, e in sentence_spans(text, lang):
                    rows.append((field, key, b, e, text[b:e]) if with_text else (field, key, b, e))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["src_field", "rec_id", "beg_off", "end_off", *["sentence"] * with_text]
    schema = FIELDS + ", sentence string" * with_text
    lang = F.col("lang") if "lang" in records.columns else F.lit(None)
    rows = records.select("src_field", F.col("rec_id").cast("long").alias("rec_id"), "text", lang.cast("string").alias("lang")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(split, schema)
