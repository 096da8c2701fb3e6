"""Garbled text from wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, and a byte-structure automaton (the well-formed
UTF-8 sequences, as a regular expression over the encoding's characters) finds the maximal multibyte spans;
only those spans are decoded, and only if they decode to assigned letters, marks, numbers and symbols and the
span itself does not read as text; for rare characters more counts as such. This repeats until nothing
changes, so text garbled several times is restored as well. Double-byte encodings (Shift-JIS, EUC-JP, GB 2312)
read as Windows text are found the same way, by their own structure. Single-byte mix-ups (a Cyrillic or a
Windows text read with another single-byte encoding) have no multibyte structure; their spans are found by the
shape of their bytes. Replacement characters mark a passage whose bytes are lost: found, but not restorable.
The column ``ways`` tells these apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Double-byte encodings that are looked for under Windows text.
DOUBLE_BYTE = frozenset(("cp932", "euc_jp", "gb2312"))
#: Legacy encodings that UTF-8 is taken for; the first one of equally long spans wins.
LEGACY = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1254", "iso8859-15")


def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte; bytes a Windows code page leaves undefined stand for themselves, as browsers read them."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _automaton(chars: dict[str, int]) -> re.Pattern:
    by = {b: re.escape(c) for c, b in chars.items()}
    cls = lambda lo, hi: "[" + "".join(by[b] for b in range(lo, hi + 1) if b in by) + "]"
    tail = cls(0x80, 0xBF)
    three = f"{by[0xE0]}{cls(0xA0, 0xBF)}{tail}|{cls(0xE1, 0xEC)}{tail}{tail}|{by[0xED]}{cls(0x80, 0x9F)}{tail}|{cls(0xEE, 0xEF)}{tail}{tail}"
    four = f"{by[0xF0]}{cls(0x90, 0xBF)}{tail}{tail}|{cls(0xF1, 0xF3)}{tail}{tail}{tail}|{by[0xF4]}{cls(0x80, 0x8F)}{tail}{tail}"
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{three}|{four})+")


_CHARS = {c: _bytes_of(c) for c in LEGACY}
_AUTOMATA = {c: _automaton(m) for c, m in _CHARS.items()}
#: Runs that can hold a span: characters that stand for a high byte in any of the encodings.
_RUN = re.compile("[" + "".join(re.escape(c) for c in sorted(set().union(*_CHARS.values()))) + "]{2,}")
#: What decoded text often holds: Latin-1, common Latin letters, Cyrillic, general punctuation and symbols,
#: box drawing, kana, unified ideographs, full-width forms, emoji.
_USED = re.compile(r"[\t\n -ÿŒœŠšŸŽžƒˆ˜Ѐ-џ‐-›€№™←-⇿∀-⋿─-➿　-ヿ一-鿿＀-￯﻿​-‍️\U0001f000-\U0001faff]+")
#: Further scripts that count as often held for longer spans of the Latin code pages, where pairs of capitals and signs are no text by themselves.
_WIDE = re.compile(r"[\t\n -ÿĀ-ɏˀ-ͯͰ-ϿЀ-ԯ֐-ۿऀ-ॿ฀-๿Ḁ-ỿ‌-⁯₠-➿　-鿿ﬀ-ﬆ＀-￯﻿️\U0001d400-\U0001d7ff\U0001f000-\U0001faff\U00020000-\U0002ffff]+")
_LATIN = frozenset(("cp1252", "latin-1", "cp1250", "cp1254", "iso8859-15"))
_BOX = re.compile(r"[─-▟]+")
_CYRILLIC = re.compile(r"[Ѐ-џ]+")
_ANY = re.compile(r"[\u0080-\U0010ffff]")


#: Marks that close a word or a sentence, and may stand behind a capital or an accented letter.
_CLOSING = frozenset("“”‘’…–—»«‹›\u00a0")
_OPENS = {"»": "«", "”": "“„"}


def _assigned(decoded: str) -> bool:
    """Every character is an assigned letter, mark, number or symbol, or one that texts use anyway."""
    return all(_WIDE.fullmatch(c) or unicodedata.category(c)[0] in "LMNS" for c in decoded)


def _reads_as_rare(text: str, a: int, b: int, decoded: str) -> bool:
    """For spans that decode to characters not all texts use: the span is a capital or an accented letter with
    what follows it in any text, a quotation with its first letter, or a letter of another script in a word."""
    span, before, after = text[a:b], text[a - 1 : a], text[b : b + 1]
    if all(c in _CLOSING for c in span[1:]) and len(decoded) == 1 and span[0].isalpha():
        if len(span) == 2 and not before.isalpha() and span[1] in _OPENS:  # nothing was opened that it could close
            return any(text.count(c, 0, a) > text.count(span[1], 0, a) for c in _OPENS[span[1]])
        torn = before.islower() and span[0].isupper()  # a capital within a word
        return ord(decoded) >= 0x480 or not torn and not (after.isalpha() and span[-1] in "“”‘…›" and len(span) == 2)
    if len(decoded) > 1 or len(span) > 2:
        return span.isalpha() and _CYRILLIC.fullmatch(span) is not None
    if unicodedata.category(span[0])[0] in "PZ" or before.isupper() and span[0].isupper() and not after.islower():
        return True
    if ord(decoded) >= 0x480 and (before.isalpha() or after.isalpha()):
        return True
    if _BOX.match(span) and (_BOX.match(before or " ") or not (before.isalpha() or after.isalpha() or _BOX.fullmatch(span))):
        return True
    if _CYRILLIC.match(span) and (_CYRILLIC.match(span[1]) or span[1] in "°§©®"):
        return not (before.isascii() and before.isalpha() or after.isascii() and after.isalpha())
    if span.isalpha() and span[0] != "ƒ" and span[1] not in "ªº":  # a word's own letters, unless a capital stands within it
        return not (before.islower() and span[0].isupper()) and not (span.isupper() and after.islower() and not before.isalpha())
    return unicodedata.category(decoded)[0] == "M" and not before.isalpha()


def _reads_as_text(text: str, a: int, b: int, decoded: str) -> bool:
    """The span is better left alone: a drawing among drawings, an alphabet's own letters, capitals in a capital word."""
    span = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    if _BOX.fullmatch(span) and not _CYRILLIC.fullmatch(decoded):
        lines_only = all("─" <= c <= "╬" for c in span)
        return bool(_BOX.match(before or " ") or _BOX.match(after or " ")) or (lines_only and not (before.isalpha() or after.isalpha()))
    if _CYRILLIC.fullmatch(span) and not any(c in "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЁЄЇІіґєјЅѕї" for c in span):
        return True
    if len(decoded) == 1 and decoded.islower() and before.isupper() and span[0].isupper() and not after.islower():
        return True
    return len(decoded) == 1 and span[0].islower() and "一" <= decoded <= "鿿" and span.isalpha() and (before.isalpha() or after.isalpha())


def _multibyte(text: str) -> tuple[str, set[str]]:
    """The text with the spans decoded, and the encodings they were read in."""
    out, at, used = [], 0, set()
    for run in _RUN.finditer(text):
        found: dict[tuple[int, int], tuple[str, str]] = {}
        for codec in LEGACY:
            chars = _CHARS[codec]
            for m in _AUTOMATA[codec].finditer(text, *run.span()):
                decoded = bytes(chars[c] for c in m.group()).decode("utf-8", "replace")
                again = any(_AUTOMATA[k].search(decoded) for k in ("cp1252", "latin-1"))
                wide = codec in _LATIN and len(m.group()) > 2 and _WIDE.fullmatch(decoded)
                usual = _USED.fullmatch(decoded) or wide or again
                rare = not usual and _assigned(decoded) and not _reads_as_rare(text, m.start(), m.end(), decoded)
                if (usual or rare) and not _reads_as_text(text, m.start(), m.end(), decoded):
                    found.setdefault(m.span(), (decoded, codec))
        for (a, b), (decoded, codec) in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):  # maximal spans, left to right
            if a >= at:
                out += [text[at:a], decoded]
                used.add(codec)
                at = b
    return "".join(out) + text[at:], used


# Single-byte mix-ups: span shape, the bytes' encoding as it was read, and as it was meant.
_C1 = re.compile(r"[\u0080-\u009f]+")
_HIGH_RUN = re.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜‐-›€™]{6,}")
_SJIS_LINE = re.compile(r"[\t -~\u0080-ÿŒœŠšŸŽžƒˆ˜‐-›€™]{4,}")
_SJIS_SIGN = re.compile(r"‚[Ÿ -ñ]|ƒ[@-~€‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–]|\u0081[A-Z@-~]")
_LATIN_WORD = re.compile("[À-ÿ¨¸]{3,}")
_KANA = re.compile(r"[ぁ-ヿ]")
_EAST = re.compile(r"[一-鿿ぁ-ヿ　-〟！-～·—…‘’“”]+")
_LATIN_RUN = re.compile("[À-ÿ¨¸]+(?:[ ,.:;!?-]*[À-ÿ¨¸]+)*")
_DOS = "а-я -¿ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈҐЁЄЇІіґєјЅѕї№"
_CP866_RUN = re.compile(f"[{_DOS}]+(?:[ ,.:;!?0-9-]+[{_DOS}]+)*")
_CP866_WORD = re.compile(f"[{_DOS}]{{3,}}")
_CP866_SIGN = re.compile("[^\\W\\d_][ ¤-¯][^\\W\\d_]|[¤-¯][¤-¯]")
_CYR_WORDS = re.compile(r"[А-яЁё]+(?:[ ,.:;!?\-\d]+[А-яЁё]+)*")
#: Russian letters by falling frequency, in natural order of a frequency table.
_FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: i for i, c in enumerate(_FREQUENT)}


def _russian(word: str) -> float:
    """Mean frequency rank of the letters, lower is more like Russian; 40 where there are none."""
    ranks = [_RANK[c] for c in word.lower() if c in _RANK]
    return sum(ranks) / len(ranks) if ranks else 40.0


def _single_byte(text: str, early: bool) -> tuple[str, set[str]]:
    used: set[str] = set()

    def c1(m: re.Match) -> str:
        span = m.group()
        if set(span) == {"\x85"} and not text[m.start() - 1 : m.start()].isalnum():
            return span  # NEXT LINE as a line end
        try:
            out = span.encode("latin-1").decode("cp1252")
        except UnicodeDecodeError:
            return span
        used.add("latin-1>cp1252")
        return out

    def latin(m: re.Match) -> str:
        span = m.group()
        words = re.findall("[À-ÿ¨¸]+", span)
        if not any(len(w) >= (3 if _CYRILLIC.search(text) else 4) for w in words):
            return span
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before > "\x7f" or after > "\x7f":
            return span
        for read, meant in (("cp1252", "cp1251"), ("cp1252", "koi8-r")):
            try:
                out = span.encode(read).decode(meant)
            except UnicodeError:
                continue
            letters = [c for c in out if c.isalpha()]
            small = sum(c.islower() for c in letters)
            if letters and all(c.lower() in _RANK for c in letters) and small * 2 > len(letters) and _russian(out) < 20 and not (before.isalpha() and before.isascii()) and not (after.isalpha() and after.isascii()):
                used.add(f"{read}>{meant}")
                return out
        return span

    def east(m: re.Match) -> str:
        span = m.group()
        if any(_AUTOMATA[c].fullmatch(span) for c in ("cp1252", "latin-1")):
            return span  # well-formed UTF-8; the automaton takes it
        raw = bytes(b for c in span for b in [_CHARS["cp1252"].get(c, _CHARS["latin-1"].get(c))] if b is not None)
        kana = raw.count(0xA4) * 6 > len(raw)
        meant, frequent = ("euc_jp", True) if kana else ("gb2312", sum(0xA1 <= x <= 0xD7 for x in raw[::2]) * 10 >= 9 * len(raw[::2]))
        for cut in (len(raw), len(raw) - 1) if frequent and len(raw) >= len(span) else ():
            try:
                out = raw[:cut].decode(meant)
            except UnicodeDecodeError:
                continue
            if len(out) >= 3 and _EAST.fullmatch(out):
                used.add(f"cp1252>{meant}")
                return out + span[cut:]
        return span

    def sjis(m: re.Match) -> str:
        span = m.group()
        if len(_SJIS_SIGN.findall(span)) < 3:
            return span
        try:
            out = bytes(ord(c) if c < "\x80" else _CHARS["cp1252"].get(c) or _CHARS["latin-1"][c] for c in span).decode("cp932")
        except (UnicodeDecodeError, KeyError):
            return span
        if len(_KANA.findall(out)) < 3 or not all(c < "\x80" or _EAST.fullmatch(c) or _USED.fullmatch(c) for c in out):
            return span
        used.add("cp1252>cp932")
        return out

    def dos_text(span: str) -> str | None:
        try:
            out = span.encode("cp1251").decode("cp866")
        except UnicodeError:
            return None
        letters = [c for c in out if c.isalpha()]
        return out if len(letters) >= 3 and all(c.lower() in _RANK for c in letters) and not _BOX.search(out) else None

    def dos(m: re.Match) -> str:
        span = m.group()
        if not _CP866_SIGN.search(span) or not re.search("[а-я]", span):
            return span
        words = [w for w in re.split("[ ,.:;!?0-9-]+", span) if len(w) >= 3]
        if sum(bool(re.search("[\u00a0-\u00bfЂ-Џѓѐ-џ†‡€‰‹›™•Ўў]", w)) for w in words) * 2 >= len(words) and (out := dos_text(span)) and _russian(out) < _russian(span) + 3:
            used.add("cp1251>cp866")
            return out

        def word(w: re.Match) -> str:
            new = dos_text(w.group()) if _CP866_SIGN.search(w.group()) and re.search("[а-я]", w.group()) else None
            if new:
                used.add("cp1251>cp866")
            return new or w.group()

        return _CP866_WORD.sub(word, span)

    def koi(m: re.Match) -> str:
        span = m.group()
        letters = [c for c in span if c.isalpha()]
        if len(letters) < 8 or sum(c.isupper() for c in letters) * 10 < 6 * len(letters) or not any(c.islower() for c in letters):
            return span
        try:
            out = span.encode("cp1251").decode("koi8-r")
        except UnicodeError:
            return span
        if _russian(out) + 1.5 < _russian(span) and sum(c.islower() for c in out) * 2 > len(letters):
            used.add("cp1251>koi8-r")
            return out
        return span

    if early:  # before the automaton can mistake parts of them
        if len(_SJIS_SIGN.findall(text)) >= 3:
            text = _SJIS_LINE.sub(sjis, text)
        if _LATIN_WORD.search(text):
            text = _LATIN_RUN.sub(latin, text)
        text = _HIGH_RUN.sub(east, text)
        return _CP866_RUN.sub(dos, text) if _CYRILLIC.search(text) and _CP866_SIGN.search(text) else text, used
    text = _C1.sub(c1, text)
    return _CYR_WORDS.sub(koi, text) if _CYRILLIC.search(text) else text, used


def repair(text: str | None) -> tuple[bool, str | None, bool, list[str]]:
    """``(garbled, text with the spans restored, wholly restored, encodings)``; None and ASCII are left alone."""
    garbled, text, whole, used, _ = examine(text)
    return garbled, text, whole, used


def examine(text: str | None) -> tuple[bool, str | None, bool, list[str], list[str]]:
    """Like :func:`repair`, with the ways a passage was found: ``multibyte`` for well-formed spans of UTF-8 or of a
    double-byte encoding, ``single-byte`` for the shape of single bytes, ``lost`` for replacement characters."""
    if not text or not _ANY.search(text):
        return False, text, True, [], []
    lost = "�" in text
    text, used = _single_byte(text, True)
    ways = {"multibyte" if x.rpartition(">")[2] in DOUBLE_BYTE else "single-byte" for x in used}
    while True:  # a span has fewer characters once it is decoded, so this ends
        new, by = _multibyte(text)
        if new == text:
            break
        text, used = new, used | by
        ways.add("multibyte")
    text, by = _single_byte(text, False)
    ways |= {"single-byte"} if by else set()
    ways |= {"lost"} if lost else set()
    return bool(used | by) or lost, text, not lost, sorted(used | by), sorted(ways)


def repair_corpus(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The garbled records: key, ``restored`` text, ``whole`` (nothing was lost), ``encodings`` and ``ways``, how its
    passages were found (see :func:`examine`).

    NULL, empty and ASCII texts are no cases and never leave the JVM. One row per garbled input row, repeated
    rows included; extra columns are ignored. No shuffle.
    """
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, *got) for k, t in zip(p.k, p.t) for bad, *got in [examine(t)] if bad]
            yield pd.DataFrame(rows, columns=["k", "restored", "whole", "encodings", "ways"])

    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7F]"))
    return some.mapInPandas(run, f"k {kind}, restored string, whole boolean, encodings array<string>, ways array<string>").withColumnRenamed("k", key)
