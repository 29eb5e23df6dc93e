"""Text garbled by a wrong character encoding, found and restored by minimum description length.

A text that was stored as bytes of encoding R but read with encoding W is undone by encoding with W and decoding with R.
Candidates are chains of such steps: UTF-8 read as one of several single-byte encodings, up to three times over; one
single-byte encoding read as another; double-byte text read as Latin-1.  A candidate must be plausible as text (no control
or unassigned characters, no words of mixed scripts, no symbols inside words).

The description length of a piece is its size, compressed with a zstandard dictionary of a language, the smallest over the
languages of its script, plus some bytes for each letter that the language does not have; a chain is added at
``STEP_COST`` bytes a step.  The chain of least length wins; leaving the piece unchanged costs nothing and wins all ties.  Dictionaries are trained on at most ``sample_rows``
labelled rows a language, taken in hash order, from rows whose letters all belong to the language's alphabet.

A further candidate describes a piece that lost a part: without its replacement characters and the remains of broken
sequences, at the cost of a step.  If that is the shortest, the piece is garbled but can't be restored.

Pieces are sentences or lines of a cell; what is around a garbled piece does not matter.  A candidate is left out of the
compression only where its lower bound - its escapes, flaws and steps and the smallest size of a compressed piece -
exceeds the best length so far, so every chain has its say.  Equal pieces of a task are described once.

Defined cases: null, empty and ASCII texts (without escaped characters) are not garbled; equal rows get equal results; texts of any length are read
whole; without labelled rows of a script its texts are described by an untrained compressor; further columns are ignored.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: encodings as which UTF-8 is read, and pairs (read as, really)
UTF8_READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250")
SINGLE_BYTE = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1256"), ("cp1252", "cp874"),
)
DOUBLE_BYTE = ("cp949", "gb18030", "cp932", "euc_jp", "big5")
#: letters beyond ASCII of the alphabets of languages, for choosing rows to train on; scripts by their own names
ALPHABET = {
    "en": "",
    "de": "äöüßÄÖÜ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíóúüñÁÉÍÓÚÜÑªº",
    "pt": "áâãàçéêíóôõúüÁÂÃÀÇÉÊÍÓÔÕÚªº",
    "ru": "а-яёА-ЯЁ",
    "ar": r"\p{Arabic}",
    "hi": r"\p{Devanagari}",
    "th": r"\p{Thai}",
    "ko": r"\p{Hangul}",
    "ja": r"\p{Hiragana}\p{Katakana}\p{Han}ー々",
    "zh": r"\p{Han}",
}
LANGUAGES = {
    "Latin": ("en", "de", "fr", "es", "pt"), "Cyrillic": ("ru",), "Arabic": ("ar",), "Devanagari": ("hi",), "Thai": ("th",), "Hangul": ("ko",),
    "Hiragana": ("ja",), "Katakana": ("ja",), "Han": ("zh", "ja"),
}
STEP_COST = {"utf-8": 1, "other": 4, "lost": 1}
#: no piece is described in fewer bytes
LEAST_BYTES = 8
LOST = "lost"
#: bytes for a letter that is not of the language's alphabet, and for any other unusual sign
ESCAPE_LETTER, ESCAPE_SIGN = 3, 1
#: bytes for each place where a text is implausible
FLAW_COST = 3
#: bytes for each remain of a broken sequence: where it stands, and where it is described as a lost character
BROKEN_COST, LOST_COST = 5, 4
#: bytes for each kind of sign in a result that the language does not have: an encoding without check sums turns anything
#: into anything, so what it makes must be spelt right; the check of UTF-8 is weak for a single short sequence
UNSPELT_COST = {"utf-8": 3, "other": 8}
_SCRIPT_OF = {k: regex.compile(rf"\p{{{k}}}") for k in LANGUAGES}
_PIECE = regex.compile(r"(?<=[.!?…。！？।؟｡．][\"”»“’)\]]*)\s+|[\r\n]+")
_USUAL = frozenset("«»“”„‚‘’–—…§°¿¡·，。！？：；（）「」『』、।؟،؛٫｡．  €£±×")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]*[^\x00-\x7F«»“”„’–—…§°¿¡\s][^\x00-\x7F«»“”„’–—…§°¿¡\s]*[\p{L}\p{M}\p{N}]*")
#: what no plausible text holds: controls, unassigned, private and replacement characters, signs inside or before words,
#: words of mixed scripts
_IMPLAUSIBLE = regex.compile(
    r"[\x80-\x9F\p{Cn}\p{Co}\p{Cs}\uFFFD]|(?<=\p{L})[\p{S}\p{Pi}„‚¿¡§¶•†‡‰](?=\p{L})|(?<![\p{L}\p{N}])[\p{S}\p{No}--[©®°]](?=\p{L})"
    r"|(?<=\p{Latin})(?=[\p{L}--\p{Latin}--\p{Han}--\p{Hangul}--\p{Hiragana}--\p{Katakana}--\p{Lm}])"
    r"|(?<=[\p{L}--\p{Latin}--\p{Han}--\p{Hangul}--\p{Hiragana}--\p{Katakana}--\p{Lm}])(?=\p{Latin})|(?<=\p{Ll})[ªº](?=\p{Ll})",
    regex.V1,
)
#: remains of sequences that lost a part
_BROKEN = regex.compile(r"\uFFFD|â€|ï¿½|[\x80-\x9F]{2}|(?<!\p{L})â(?=\p{Lu})|(?<=\p{Ll})â(?!\p{L})")
_ESCAPES = regex.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_HIGH_BYTES = bytes(range(128, 256))
_WIDE = regex.compile(r"[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}、-〟！-～]")


@lru_cache(maxsize=None)
def _chars(encoding: str) -> dict[int, str]:
    """The character of each byte from 128; bytes without one are kept as controls, as lenient readers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _bytes(encoding: str) -> dict[str, int]:
    table = {c: b for b, c in _chars(encoding).items()}
    if encoding == "cp1252":  # Latin-1 reads the same bytes as controls
        table = {chr(b): b for b in range(128, 256)} | table
    return table


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> tuple[regex.Pattern, frozenset[str]]:
    """Well-formed UTF-8 sequences as they look when read with the encoding, and the characters that begin them."""
    table = _bytes(encoding)

    def of(low: int, high: int) -> str:
        return "[" + "".join(regex.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    more = of(0x80, 0xBF)
    begin = frozenset(c for c, b in table.items() if 0xC2 <= b <= 0xF4)
    return regex.compile(f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}"), begin


def _undo_utf8(text: str, encoding: str) -> str:
    table = _bytes(encoding)

    def one(m: regex.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _sequences(encoding)[0].sub(one, text)


@lru_cache(maxsize=None)
def _translation(read_as: str, really: str) -> tuple[dict[int, str], frozenset[str]]:
    """Character for character, and the characters that can be translated."""
    out: dict[int, str] = {}
    for c, b in _bytes(read_as).items():
        try:
            out[ord(c)] = bytes([b]).decode(really)
        except UnicodeDecodeError:
            pass
    return out, frozenset(map(chr, out))


_TO_LATIN1 = {ord(c): b for c, b in _bytes("cp1252").items()}


def _high(text: str) -> set[str]:
    return {c for c in set(text) if c > "\x7f"}


def candidates(piece: str, high: set[str] | None = None) -> Iterator[tuple[str, int, str]]:
    """(chain, cost of its steps, text) of the ways to undo a wrong reading of a piece, or to describe what is left of it.

    Those by a table of one character for another are ``translations``.
    """
    high = _high(piece) if high is None else high
    for encoding in UTF8_READ_AS:
        if not high & _sequences(encoding)[1]:
            continue
        text, steps = piece, 0
        while steps < 3:
            after = _undo_utf8(text, encoding)
            if after == text:
                break
            text, steps = after, steps + 1
            yield ">".join([f"{encoding}:utf-8"] * steps), steps * STEP_COST["utf-8"], text
    if len(high) > 1 and high <= _bytes("cp1252").keys():
        raw = piece.translate(_TO_LATIN1).encode("latin-1")
        n = len(raw) - len(raw.translate(None, _HIGH_BYTES))
        for really in DOUBLE_BYTE if n >= 4 else ():
            text = raw.decode(really, "replace")
            wide = len(_WIDE.findall(text))
            if wide >= 2 and 3 * wide > n and text.count("\ufffd") * 12 <= wide and not _NO_TEXT.search(text):
                yield f"latin-1:{really}", STEP_COST["other"], text
    if _BROKEN.search(piece):
        text, n = _BROKEN.subn("", piece)
        yield LOST, STEP_COST["lost"] + LOST_COST * n, text


def translations(high: set[str]) -> Iterator[tuple[str, dict[int, str], set[str]]]:
    """(chain, table, what becomes of the characters beyond ASCII) of the single-byte encodings that can read a piece."""
    for read_as, really in SINGLE_BYTE:
        table, known = _translation(read_as, really)
        if high <= known:
            after = {x for c in high for x in table[ord(c)] if x > "\x7f"}
            if any(table[ord(c)] != c for c in high):
                yield f"{read_as}:{really}", table, after


_NO_TEXT = regex.compile(r"[\p{Co}\p{Cn}\x80-\x9F]")


class Describer:
    """Description lengths in bytes, with a dictionary per language."""

    def __init__(self, models: dict[str, tuple[bytes, frozenset[str], frozenset[str]]], level: int = 3):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        self.plain = z.ZstdCompressor(compression_params=params)
        self.by_language = {}
        for k, (d, _, _) in models.items():
            known = z.ZstdCompressionDict(d)
            known.precompute_compress(compression_params=params)
            self.by_language[k] = z.ZstdCompressor(compression_params=params, dict_data=known)
        self.words = frozenset().union(*[w for _, w, _ in models.values()])
        self.seen = {k: c for k, (_, _, c) in models.items()}
        self.letters = {k: regex.compile(f"[{v}]") if v else None for k, v in ALPHABET.items()}
        self.escapes: dict[tuple[str, str], int] = {}
        self.scripts: dict[str, frozenset[str]] = {}
        self.pieces: dict[str, tuple[str | None, str]] = {}
        self.tables: dict[frozenset[str], list[tuple]] = {}

    def languages(self, high: set[str]) -> set[str]:
        found: set[str] = set()
        for c in high:
            own = self.scripts.get(c)
            if own is None:
                script = next((k for k, p in _SCRIPT_OF.items() if p.match(c)), None)
                own = self.scripts[c] = frozenset(LANGUAGES[script]) & self.by_language.keys() if script else frozenset()
            found |= own
        return found or set(LANGUAGES["Latin"]) & self.by_language.keys()

    def _escape(self, language: str, c: str) -> int:
        cost = self.escapes.get((language, c))
        if cost is None:
            letters = self.letters.get(language)
            if c in _USUAL or (letters is not None and letters.match(c)):
                # signs of large scripts are letters of the language only as far as the training rows show them
                cost = 0 if language not in ("zh", "ja", "ko") or c in self.seen[language] or c in _USUAL else 2
            elif regex.match(r"[\p{L}\p{Cc}\p{Cn}\p{Co}]", c):
                cost = ESCAPE_LETTER
            else:
                cost = 0 if regex.match(r"\p{M}", c) and language in ("hi", "th", "ar") else ESCAPE_SIGN
            self.escapes[(language, c)] = cost
        return cost

    def bound(self, high: set[str], languages: set[str]) -> int:
        """No text with these characters beyond ASCII has a shorter description."""
        return LEAST_BYTES + min((sum(self._escape(k, c) for c in high) for k in languages), default=0)

    def translations(self, high: set[str], own: set[str]) -> list[tuple]:
        """(bound with cost, cost, chain, table, characters beyond ASCII, languages), kept per set of characters."""
        key = frozenset(high)
        kept = self.tables.get(key)
        if kept is None:
            if len(self.tables) > 50_000:
                self.tables.clear()
            kept = self.tables[key] = []
            for chain, table, after in translations(high):
                languages = own | self.languages(after)
                cost = STEP_COST["other"] + UNSPELT_COST["other"] * self.unspelt(after, languages)
                kept.append((self.bound(after, languages) + cost, cost, chain, table, after, languages))
        return kept

    def unspelt(self, high: set[str], languages: set[str]) -> int:
        """How many of these signs the language that has most of them does not have."""
        return min((sum(1 for c in high if self._escape(k, c)) for k in languages), default=0)

    def length(self, text: str, high: set[str], languages: set[str]) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        lower = text.lower().encode("utf-8", "surrogatepass") if sum(map(str.isupper, text)) > 0.4 * len(text) else None
        best: int | None = None
        counts = [(c, text.count(c)) for c in high]
        # a language with so many more escapes than the best total so far can't be shorter: no piece takes under 8 bytes
        spelling = sorted((sum(self._escape(k, c) * n for c, n in counts), k) for k in languages)
        for escapes, k in spelling:
            if best is not None and escapes + LEAST_BYTES >= best:
                break
            n = len(self.by_language[k].compress(raw))
            if lower is not None:
                n = min(n, len(self.by_language[k].compress(lower)) + 2)
            if best is None or n + escapes < best:
                best = n + escapes
        return len(self.plain.compress(raw)) if best is None else best



def _flaws(text: str) -> int:
    return FLAW_COST * len(_IMPLAUSIBLE.findall(text)) + BROKEN_COST * len(_BROKEN.findall(text))


def restore_piece(piece: str, describer: Describer) -> tuple[str | None, str]:
    """(chain or None, text): the chain of least description length; ``LOST`` leaves the piece as it is."""
    kept = describer.pieces.get(piece)
    if kept is None:
        if len(describer.pieces) > 50_000:
            describer.pieces.clear()
        kept = describer.pieces[piece] = _restore_piece(piece, describer)
    return kept


def _restore_piece(piece: str, describer: Describer) -> tuple[str | None, str]:
    high = _high(piece)
    own = describer.languages(high)
    tried: list[tuple] = []
    for chain, cost, text in candidates(piece, high):
        after = _high(text)
        languages = own | describer.languages(after)
        if chain != LOST:
            cost += UNSPELT_COST["utf-8" if chain.endswith("utf-8") else "other"] * describer.unspelt(after, languages)
        tried.append((describer.bound(after, languages) + cost, cost, chain, text, after, languages))
    tried += describer.translations(high, own)
    if not tried:
        return None, piece
    best_length = describer.length(piece, high, own) + _flaws(piece)
    best: tuple[str, str] | None = None
    for least, cost, chain, text, after, languages in sorted(tried, key=lambda x: x[:2]):
        if least >= best_length:
            break  # nor can any that follows be shorter
        text = piece.translate(text) if isinstance(text, dict) else text
        length = describer.length(text, after, languages) + cost
        if length < best_length:
            length += _flaws(text)
            if length < best_length:
                best_length, best = length, (chain, text)
    if best is None:
        return None, piece
    return best[0], piece if best[0] == LOST else best[1]


def restore(text: str, describer: Describer) -> tuple[bool, str | None, str]:
    """(garbled, chains, restored text) of a cell.

    Garbled text may have been escaped for markup since; escapes of right text are no wrong decoding and stay.
    """
    if "&" in text and _ESCAPES.search(text):
        plain = html.unescape(text)
        garbled, chain, better = restore(plain, describer) if plain != text and not _ESCAPES.search(plain) else (False, None, text)
        if chain is not None:
            return True, f"html>{chain}", better
    if text.isascii():
        return False, None, text
    chains: list[str] = []
    garbled = False
    out: list[str] = []
    at = 0
    for end in [*(m.start() for m in _PIECE.finditer(text)), len(text)]:
        piece = text[at:end]
        at = end
        if piece.isascii():
            out.append(piece)
            continue
        chain, better = restore_piece(piece, describer)
        if chain is not None:
            garbled = True
            if chain != LOST and chain not in chains:
                chains.append(chain)
        out.append(better)
    return garbled, "; ".join(chains) or None, "".join(out)


def is_clean(text: str, language: str) -> bool:
    """Whether a labelled text may be trained on: letters of the language's alphabet, and some of its own script."""
    full, own = _clean(language)
    if not full.fullmatch(text) or (own is not None and not own.search(text)) or _CAPITALS.search(text) or _IMPLAUSIBLE.search(text):
        return False
    return not any(_sequences(e)[0].search(text) for e in ("cp1252", "mac_roman", "cp1251"))


_CAPITALS = regex.compile(r"\p{Ll}(?=[^\x00-\x7F])\p{Lu}|\p{Ll}\p{Lu}\p{L}*\p{Lu}|[а-яё][А-ЯЁ]|(?<!\p{L})[а-яё](?:\s+[А-ЯЁ]{3,}){2}|[А-ЯЁ]{4,}")


@lru_cache(maxsize=None)
def _clean(language: str) -> tuple[regex.Pattern, regex.Pattern | None]:
    letters = ALPHABET[language]
    own = regex.compile(f"[{letters}]") if language not in LANGUAGES["Latin"] else None
    return regex.compile(rf"[\x00-\x7F\p{{M}}\p{{Nd}}{letters}{regex.escape(''.join(sorted(_USUAL)))}]*"), own


def training_rows(rows: DataFrame, sample_rows: int) -> dict[str, list[str]]:
    """At most sample_rows labelled rows a language, in hash order, of which the clean ones are kept."""
    lang = F.lower(F.trim("lang"))
    base = rows.select("row_uid", lang.alias("lang"), "text").filter(F.col("lang").isin(*ALPHABET) & F.col("text").isNotNull())
    # ranked by keys alone; the texts of the picked rows, at most sample_rows a language, come by a second scan
    w = Window.partitionBy("lang").orderBy("h", "row_uid")
    keys = base.select("row_uid", "lang", F.xxhash64("row_uid").alias("h"))
    keys = keys.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample_rows).select("row_uid", "lang")
    picked = base.join(F.broadcast(keys), ["row_uid", "lang"])
    out: dict[str, list[str]] = {}
    for k, text in picked.select("lang", "text").collect():  # bounded by sample_rows a language
        if is_clean(text, k):
            out.setdefault(k, []).append(text)
    return out


def train(samples: dict[str, list[str]], size: int = 24_576, word_count: int = 3) -> dict[str, tuple[bytes, frozenset[str], frozenset[str]]]:
    """Per language a zstandard dictionary (of few samples, the samples themselves), the words with letters beyond ASCII
    that occur word_count times, and the signs that occur."""
    import zstandard as z

    out = {}
    for k, texts in sorted(samples.items()):
        counts = Counter(w for t in texts for w in _WORDS.findall(t))
        words = frozenset(w for w, n in counts.items() if n >= word_count and regex.fullmatch(rf"[A-Za-z\p{{M}}{ALPHABET[k]}]+", w))
        signs = frozenset("".join(counts))
        raw = sorted({p.encode() for t in texts for p in (x.strip() for x in _PIECE.split(t)) if len(p) > 7})
        if not raw:
            continue
        total = sum(map(len, raw))
        try:
            if total < 4 * size or len(raw) < 50:
                raise z.ZstdError("few samples")
            out[k] = z.train_dictionary(size, raw).as_bytes(), words, signs
        except z.ZstdError:
            out[k] = b"\n".join(raw)[-4 * size :], words, signs
    return out


SCHEMA = "row_uid long, garbled boolean, chain string, restored string"


def restored(rows: DataFrame, sample_rows: int = 1500) -> DataFrame:
    """(row_uid, garbled, chain, restored) of the garbled rows of (row_uid, lang, text)."""
    models = train(training_rows(rows, sample_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = Describer(models)
        for pdf in batches:
            out = []
            for key, text in zip(pdf["row_uid"], pdf["text"], strict=True):
                garbled, chain, better = restore(text, describer)
                if garbled:
                    out.append((key, True, chain, better))
            yield pd.DataFrame(out, columns=["row_uid", "garbled", "chain", "restored"])

    # a text of ASCII alone, without escapes, is never garbled: it does not leave the JVM
    suspects = rows.select(F.col("row_uid").cast("long").alias("row_uid"), "text").filter(F.col("text").rlike(r"[^\x00-\x7F]|&[A-Za-z#][A-Za-z0-9]*;"))
    return suspects.mapInPandas(run, SCHEMA)
