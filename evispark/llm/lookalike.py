"""Problem 4: one consistent form for texts that look the same and differ in their characters.

Compatibility forms that look like their plain ones are replaced, ignorable characters deleted; then every token is a
lattice of look-alike letters, searched with Viterbi for the path of the best character-bigram score in which changes of
script cost more than any bigram can give. The result depends on the look alone, so what looks the same becomes equal.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts, or of phonetic writing, that look like the Latin letter (after decomposition). Letters
#: that differ to the eye, such as one without its dot or of another height, are other letters.
TWINS = {
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
#: Hyphens and dashes of the same look.
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-", "－": "-"}
SCRIPT_CHANGE = 1000.0

_CLASS = {c: (latin, *twins) for latin, twins in TWINS.items() for c in (latin, *twins)}
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_PLAIN = re.compile(r"[\t\n\f\r -~åäöÅÄÖéüÉÜ–·»•§°“”’…]*")


def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    o = ord(c)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    return "Cyrillic" if 0x400 <= o < 0x530 else "Latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else unicodedata.name(c, "?").split()[0]


def fold(text: str) -> str:
    """Compatibility forms replaced where they look like the plain form, ignorables deleted, accents decomposed."""
    if text.isascii():
        return text
    out = []
    for c in _IGNORABLE.sub("", text):
        if c in HYPHENS:
            out.append(HYPHENS[c])
        elif c >= "\x80" and (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>", "<noBreak>", "<compat>")) and (c.isspace() or not d.split(None, 1)[1].startswith("0020")) and c not in _CLASS and c != "ſ":
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFD", "".join(out))


class Lattice:
    """Viterbi over look-alike lattices. ``bigrams``: log scores of pairs of characters; pairs not listed get ``unseen``."""

    def __init__(self, bigrams: dict[str, float], unseen: float = -12.0):
        self.bigrams, self.unseen, self.seen = bigrams, unseen, {}

    def token(self, token: str) -> str:
        """The consistent form of one token (decomposed)."""
        form = self.seen.get(token)
        if form is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            form = self.seen[token] = self._search(token)
        return form

    def _search(self, token: str) -> str:
        if token.isascii() and any(c.isalpha() and c not in _CLASS for c in token):
            return token  # a letter without twins: any other path changes script
        if not any(c in _CLASS for c in token):
            return token
        # state: (last letter chosen, script of the last letter) -> (score, path)
        states: dict[tuple[str, str], tuple[float, str]] = {("^", ""): (0.0, "")}
        for c in token:
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for k, option in enumerate(_CLASS.get(c, (c,))):
                script = _script(option)
                for (last, was), (score, path) in states.items():
                    s = score + self.bigrams.get(last + option, self.unseen) - (SCRIPT_CHANGE if script and was and script != was else 0.0)
                    s -= 0.001 * k  # ties go to the letter that is listed first, the Latin one
                    key = (option if script else last, script or was)
                    if key not in step or (s, path + option) > step[key]:
                        step[key] = (s, path + option)
            states = step
        return max(states.values())[1]

    def form(self, text: str | None) -> str | None:
        """The consistent form of a text; white space of all kinds is kept as plain spaces, tabs and line feeds."""
        if text is None:
            return None
        folded = fold(text)
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.token(m.group()), folded))


def count_bigrams(df: DataFrame, text_col: str) -> dict[str, float]:
    """Log scores of the character bigrams within words, over all rows of ``df``.

    Only pairs of letters of the Latin, Greek and Cyrillic alphabets (and a word's start) are kept: fewer than 1000
    letters, so fewer than a million pairs whatever the size of the data; a few thousand occur. Counted in the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            words: Counter[str] = Counter()
            for t in batch[0].to_pylist():
                words.update(_TOKEN.findall(fold(t)))
            for w, n in words.items():
                w = "^" + w
                for k in range(len(w) - 1):
                    total[w[k : k + 2]] += n
        kept = {p: n for p, n in total.items() if all(c == "^" or _script(c) in ("Latin", "Greek", "Cyrillic") for c in p)}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["pair", "n"])

    rows = df.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    firsts: Counter[str] = Counter()
    for r in rows:
        firsts[r["pair"][0]] += r["n"]
    return {r["pair"]: math.log(r["n"] / firsts[r["pair"][0]]) for r in rows}


_WS = re.compile(r"\s+")


def looks_same(a: str, b: str, lattice: Lattice) -> bool:
    """Whether two texts differ in more than spaces, tabs and line feeds, yet look the same."""
    if a.translate(_NO_SPACE) == b.translate(_NO_SPACE) or _PLAIN.fullmatch(a) and _PLAIN.fullmatch(b):
        return False
    return _WS.sub(" ", lattice.form(a)).strip() == _WS.sub(" ", lattice.form(b)).strip()


def find_lookalikes(units: DataFrame, bigrams: dict[str, float], id_col: str = "unit_id", quote_col: str = "quote", locations_col: str = "locations") -> DataFrame:
    """``unit_id, occurrence`` of the rows of :func:`normalize_locations` with ``same_look``; forms are only made where texts differ."""
    places = units.select(F.col(id_col).alias("unit_id"), F.col(quote_col).alias("quote"), F.posexplode(F.transform(locations_col, lambda x: x["matched_text"])))
    # equal texts, and texts that differ in plain white space only, are settled in the JVM
    bare = [F.translate(c, " \t\n", "") for c in ("quote", "col")]
    places = places.where(F.col("quote").isNotNull() & F.col("col").isNotNull() & (bare[0] != bare[1])).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(bigrams)
        for batch in batches:
            same = pa.array([looks_same(a, b, lattice) for a, b in zip(batch["quote"].to_pylist(), batch["col"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["unit_id"].filter(same), batch["pos"].filter(same)], names=["unit_id", "occurrence"])

    return places.mapInArrow(run, f"unit_id {units.schema[id_col].dataType.simpleString()}, occurrence int")


_NO_SPACE = {32: None, 9: None, 10: None}


def normalize_locations(units: DataFrame, bigrams: dict[str, float], id_col: str = "unit_id", quote_col: str = "quote", locations_col: str = "locations") -> DataFrame:
    """Every location: ``unit_id, occurrence, quote_form, matched_form, same_look``.

    ``occurrence`` is the zero-based position in the array. ``same_look``: the location's text differs from the quote in
    more than plain white space, yet looks the same. Null quotes and texts have null forms and never look the same; rows
    with empty or null locations have no location. Repeated rows count once. Extra columns are not read.
    """
    places = units.select(F.col(id_col).alias("unit_id"), F.col(quote_col).alias("quote"), F.posexplode(F.transform(locations_col, lambda x: x["matched_text"]))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(bigrams)
        for batch in batches:
            q, m = batch["quote"].to_pylist(), batch["col"].to_pylist()
            same = [a is not None and b is not None and a != b and looks_same(a, b, lattice) for a, b in zip(q, m)]
            yield pa.RecordBatch.from_arrays(
                [batch["unit_id"], batch["pos"], pa.array([lattice.form(x) for x in q], pa.string()), pa.array([lattice.form(x) for x in m], pa.string()), pa.array(same, pa.bool_())],
                names=["unit_id", "occurrence", "quote_form", "matched_form", "same_look"],
            )

    return places.mapInArrow(run, f"unit_id {units.schema[id_col].dataType.simpleString()}, occurrence int, quote_form string, matched_form string, same_look boolean")
