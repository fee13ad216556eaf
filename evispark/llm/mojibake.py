"""Problem 5: text read in the wrong character encoding, found and restored span by span.

Characters are mapped back to the bytes of the legacy encoding that was used by mistake. A byte-structure automaton finds
the maximal spans that are well-formed multibyte sequences, and only those are decoded; the step is repeated, as text may
be damaged twice. Single-byte encodings taken for each other leave no byte structure: there the letters that a pair of
encodings makes of Swedish letters are judged by their place in the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that multibyte text is mistaken for, the likeliest first.
MISTAKEN_FOR = ("cp1252", "iso8859_15", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
#: Fixed values: (encoding of the bytes, encoding they were read in) of single-byte mistakes.
SINGLE_BYTE = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "latin_1"), ("cp850", "latin_1"), ("cp1252", "cp1250"), ("cp1252", "cp1251"))
#: Letters that single-byte restoration may bring back, and the signs restored beside them.
LETTERS, SIGNS = "åäöÅÄÖéÉüÜ", "–·»«•©§…’”°"
#: Text with none of the other characters can't be damaged. Also used as a filter in the JVM.
PLAIN = "\t\n\f\r -~åäöÅÄÖ–·»•"


def _table(codec: str) -> dict[int, int]:
    """Code point -> byte of a legacy encoding. Bytes that the encoding leaves open map to the C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    if codec == "cp1252":  # decoders that fall back byte by byte leave C1 controls beside cp1252's characters
        table.update({b: b for b in range(0x80, 0xA0) if b not in table})
    return table


@lru_cache(maxsize=None)
def _multibyte(codec: str):
    """The automaton over well-formed UTF-8 as it looks in the encoding, and the way back to bytes."""
    table = _table(codec)
    chars: dict[int, list[str]] = {}
    for c, b in table.items():
        chars.setdefault(b, []).append(chr(c))

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in chars.get(b, [])) + "]"

    t = cls(0x80, 0xBF)
    unit = f"{cls(0xC2, 0xDF)}{t}|{cls(0xE0, 0xE0)}{cls(0xA0, 0xBF)}{t}|{cls(0xE1, 0xEC)}{t}{{2}}|{cls(0xED, 0xED)}{cls(0x80, 0x9F)}{t}|{cls(0xEE, 0xEF)}{t}{{2}}|{cls(0xF0, 0xF0)}{cls(0x90, 0xBF)}{t}{{2}}|{cls(0xF1, 0xF3)}{t}{{3}}|{cls(0xF4, 0xF4)}{cls(0x80, 0x8F)}{t}{{2}}"
    leads = frozenset(c for b in range(0xC2, 0xF5) for c in chars.get(b, []))
    trails = frozenset(c for b in range(0x80, 0xC0) for c in chars.get(b, []))
    return re.compile(f"(?:{unit})+"), table, leads, trails, {c: chr(b) for c, b in table.items()}


def _plausible(decoded: str) -> bool:
    """Whether decoding a span gives something that people write: no controls, no rarities in place of ordinary text.

    Two characters that happen to form one Greek or Cyrillic letter prove nothing; a word of them does.
    """
    if any("\x80" <= c < "\xa0" for c in decoded):
        # controls may stand between two mistakes: they must go with the next steps
        inner, spans, _ = _multibyte_spans(decoded)
        while spans:
            inner, spans, _ = _multibyte_spans(inner)
        return not any("\x80" <= c < "\xa0" for c in inner)
    other = 0
    for c in decoded:
        o = ord(c)
        if o < 0xA0 or 0x180 <= o < 0x300 or 0x30D <= o < 0x370 or 0x530 <= o < 0x1E00 or 0x1F00 <= o < 0x2010 or 0xE000 <= o <= 0xF8FF or c == "\ufffd":
            if o not in (0x192, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC):
                return False
        other += 0x370 <= o < 0x530 or 0x2E80 <= o < 0xFB00
    return other != 1 and other != 2


@lru_cache(maxsize=None)
def _pair(actual: str, read: str) -> dict[str, str]:
    """What a single-byte mistake made of each letter, the other way round."""
    out = {}
    for c in LETTERS + SIGNS:
        try:
            b = c.encode(actual)
        except UnicodeEncodeError:
            continue
        try:
            wrong = b.decode(read)
        except UnicodeDecodeError:
            wrong = chr(b[0])
        if wrong not in LETTERS[:6]:
            out[wrong] = c
    return out


_C1 = re.compile("[\x80-\x9f�]")
_LONE = re.compile(r"(?<!\S)Ã(?=\s)|Ã(?=\s[a-zåäö])")
#: The rest of a letter at which a window was cut. Dashes, quotes and dots, which other letters leave, begin right text too.
_TAIL = re.compile("^[\xa4\xa5\xb6](?=[a-zåäö])")


def _multibyte_spans(text: str) -> tuple[str, list[tuple[int, int]], str | None]:
    """``text`` with its multibyte spans decoded, their places in ``text``, and the encoding."""
    best, present = None, set(text)
    for codec in MISTAKEN_FOR:
        pattern, table, leads, trails, _ = _multibyte(codec)
        if present.isdisjoint(leads) or present.isdisjoint(trails):
            continue
        out, spans, at = [], [], 0
        for m in pattern.finditer(text):
            try:
                decoded = bytes(table[ord(c)] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _plausible(decoded):
                out += [text[at : m.start()], decoded]
                at = m.end()
                spans.append(m.span())
        if spans:
            out.append(text[at:])
            score = sum(1 if c in LETTERS or c in SIGNS else 0.5 for s in out[1::2] for c in s)
            if best is None or score > best[0]:
                best = (score, "".join(out), spans, codec)
    return (best[1], best[2], best[3]) if best else (text, [], None)


@lru_cache(maxsize=None)
def _dashes(letter: str) -> re.Pattern:
    return re.compile(rf"(?<=[ \d]){letter}(?=[ \d])|(?<=[a-zåäö]){letter}(?=[A-ZÅÄÖ])")


@lru_cache(maxsize=None)
def _pair_letters(actual: str, read: str) -> tuple[frozenset[str], re.Pattern]:
    pair = _pair(actual, read)
    wrong = "".join(w for w, c in pair.items() if c in LETTERS)
    return frozenset(w for w, c in pair.items() if c in LETTERS or c == "–" and w.isalpha()), re.compile("[" + re.escape(wrong) + "]")


def _strong_places(text: str, actual: str, read: str) -> list[int]:
    """Places where only a mistake explains the character: a sign within a word, a capital within small letters, a
    letter where a dash would stand."""
    dash = next((w for w, c in _pair(actual, read).items() if c == "–" and w.isalpha()), None)
    found = [m.start() for m in _dashes(dash).finditer(text)] if dash and dash in text else []
    for m in _pair_letters(actual, read)[1].finditer(text):
        k, c = m.start(), m.group()
        before, after = text[k - 1 : k], text[k + 1 : k + 2]
        if "\x80" <= c <= "\x9f":
            found.append(k)
        elif not c.isalpha() or c in "ˆƒªº":
            inside = before.isalpha() and after.isalpha() and (after.islower() or before.islower())
            heads = after.islower() and after.isalpha() and not before.isalpha() and c in "‰≈™€÷ˆƒ┼─╓†" and not before.isdigit()
            if inside or heads:
                found.append(k)
        elif c.isupper():
            if (before.islower() and before.isalpha()) or (before.isalpha() and after.islower()):
                found.append(k)
        elif c in "õšžêùîûσ" and (before.isalpha() or after.isalpha()):
            # a small letter that is rare here: only where its sentence has none of the letters that it stands for
            lo = max(text.rfind("\n", 0, k), text.rfind(". ", 0, k)) + 1
            hi = min(x for x in (text.find("\n", k), text.find(". ", k), len(text)) if x >= 0)
            if not set(text[lo:hi]) & set("åäöÅÄÖ"):
                found.append(k)
    return sorted(set(found))


def _weight(text: str, places: list[int], pair: dict[str, str]) -> float:
    """How well a pair of encodings explains the places: Swedish letters, in the case of their neighbours, count fully."""
    total = 0.0
    for k in places:
        to, before, after = pair[text[k]], text[k - 1 : k], text[k + 1 : k + 2]
        case = to.isupper() == (not before.isalpha() or before.isupper() and not after.islower())
        total += (1.0 if to in "åäöÅÄÖ–" else 0.3) * (1.0 if case else 0.6)
    return total


def repair(text: str | None) -> tuple[str | None, list[tuple[int, int]], str | None]:
    """``(restored text, damaged places in the given text, what was found)``; the text itself where nothing was.

    What was found: the encodings in the order undone, e.g. ``utf-8<cp1252``; ``lost`` where characters can't be had back.
    """
    if not text:
        return text, [], None
    how: list[str] = []
    now = text
    starts, ends = None, None  # where each character of ``now`` stands in ``text``; none: at its own place
    places: list[tuple[int, int]] = []

    def given(a: int, b: int) -> tuple[int, int]:
        return (a, b) if starts is None else (starts[a], ends[b - 1])

    while True:  # every step makes the text shorter
        fixed, spans, codec = _multibyte_spans(now)
        if not spans:
            break
        places += [given(a, b) for a, b in spans]
        how.append(f"utf-8<{codec}")
        starts, ends = _follow(len(now), spans, [len(now[a:b].translate(_multibyte(codec)[4]).encode("latin-1").decode("utf-8")) for a, b in spans], starts, ends)
        now = fixed
    best, present = None, set(now)
    for actual, read in SINGLE_BYTE:
        if present.isdisjoint(_pair_letters(actual, read)[0]):
            continue
        strong = _strong_places(now, actual, read)
        weight = _weight(now, strong, _pair(actual, read))
        if strong and (best is None or weight > best[0]):
            best = (weight, actual, read, strong)
    if best:
        _, actual, read, strong = best
        places += [given(k, k + 1) for k in strong]
        how.append(f"{actual}<{read}")
        now = _restore(now, _pair(actual, read), strong)
    lost = [m.span() for p in (_C1, _LONE, _TAIL) for m in p.finditer(now)]
    if lost:
        places += [given(a, b) for a, b in lost]
        how.append("lost")
    return (now, _merged(places), "+".join(how)) if how else (text, [], None)


def _follow(n: int, spans: list[tuple[int, int]], sizes: list[int], starts: list[int] | None, ends: list[int] | None) -> tuple[list[int], list[int]]:
    """The places in the given text after spans have been replaced by so many characters each."""
    starts, ends = starts or list(range(n)), ends or list(range(1, n + 1))
    new_starts, new_ends, at = [], [], 0
    for (a, b), size in zip(spans, sizes):
        new_starts += starts[at:a] + [starts[a]] * size
        new_ends += ends[at:a] + [ends[b - 1]] * size
        at = b
    return new_starts + starts[at:], new_ends + ends[at:]


def _merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _restore(text: str, pair: dict[str, str], strong: list[int]) -> str:
    """Restore by lines: in a line with a sure place all characters of the pair, elsewhere none.

    A sign that stands between spaces is restored only to a sign, so that a dagger or per mille sign of its own stays.
    """
    lines, at, k = text.split("\n"), 0, 0
    surely = set(strong)
    out = []
    for line in lines:
        end = at + len(line)
        sure = False
        while k < len(strong) and strong[k] < end:
            sure, k = True, k + 1
        if sure:
            chars = list(line)
            for i, c in enumerate(line):
                to = pair.get(c)
                if to is None:
                    continue
                beside = line[i - 1 : i].isalpha() or line[i + 1 : i + 2].isalpha()
                if at + i in surely or to in LETTERS and (beside or c.isalpha()) or to in SIGNS and not beside:
                    chars[i] = to
            line = "".join(chars)
        out.append(line)
        at = end + 1
    return "\n".join(out)


def damaged(text: str | None) -> bool:
    """Whether :func:`repair` finds anything; the first find is enough."""
    if not text:
        return False
    if _C1.search(text) or _multibyte_spans(text)[1] or _LONE.search(text) or _TAIL.search(text):
        return True
    present = set(text)
    return any(not present.isdisjoint(_pair_letters(*pair)[0]) and _strong_places(text, *pair) for pair in SINGLE_BYTE)


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([damaged(t) for t in batch["text"].to_pylist()], pa.bool_())
        yield batch.select(["record_kind", "record_id"]).filter(keep)


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, i, t in zip(*(c.to_pylist() for c in batch.columns)):
            fixed, spans, how = repair(t)
            if how:
                rows.append((kind, i, t, fixed, how, [{"start": a, "end": b} for a, b in spans]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 5 + [span])], names=["record_kind", "record_id", "text", "restored", "found", "spans"])


def _rare(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    return df.select(F.lit(kind).alias("record_kind"), F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(f"[^{PLAIN}]"))


def find_damaged(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Damaged rows, as of :func:`repair_text`: ``record_kind, record_id``; nothing is restored and no text comes back."""
    return _rare(df, id_col, text_col, kind).mapInArrow(_find_batches, "record_kind string, record_id string")


def repair_text(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Damaged rows: ``record_kind, record_id, text, restored, found, spans``.

    Texts of plain characters only are passed over in the JVM. Null and empty texts are never damaged. Repeated rows give
    repeated results; extra columns are not read. ``restored`` still holds U+FFFD where a character was lost.
    """
    return _rare(df, id_col, text_col, kind).mapInArrow(_repair_batches, "record_kind string, record_id string, text string, restored string, found string, spans array<struct<start:int,end:int>>")
