"""The classifier of problem 3: how much a line of a page speaks for furniture, fitted to the pages themselves.

There are no hand-set weights and no phrases. A line is described by its words, its shape, its place on the page and by
how many different pages of its site hold a line of the same template (names and numbers left open). Pages of one site
label each other: a template that many of them hold outside their prose is furniture, prose that no other page holds is
body. A logistic regression over those features is fitted to a bounded sample of lines labelled that way, and gives the
log-odds of every line, of any wording; how often neighbouring labelled lines agree gives the edges.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash

from evispark.llm.lookalike import TWINS
from evispark.llm.residue import covered_length, find_residue

#: Size of the hashed feature space, rounds, rows of a step, rate and decay of the fit.
DIMENSIONS, EPOCHS, STEP, RATE, DECAY = 1 << 15, 12, 256, 0.05, 1e-4
#: A template of so many different pages of a site is repeated; below, a line counts as the page's own.
REPEATED, OWN = 5, 2
#: Lines of one template with names or numbers that make a table.
ROWS = 4
#: Words that open a public announcement, which is body whatever its shape.
ANNOUNCEMENTS = frozenset("kungrelse kungorelse kallelse tillknnagivande tillkannagivande anslag kuulutus announcement bekendtgrelse kunngjring bekanntmachung".split())
#: Code points from which on a line with a full stop is prose.
PROSE, PARAGRAPH = 60, 180

_TO_LATIN = str.maketrans({c: latin for latin, twins in TWINS.items() for c in twins} | {0xFF01 + k: 0x21 + k for k in range(94)} | {"»": ">", "›": ">", "·": "|", "–": "-", "—": "-", "•": "*", "©": "@"})
_RARE = re.compile(r"[^\x00-\x7f]+")
_ODD = re.compile("[^\x00-\x7fåäöÅÄÖ–»·•©]")
_WORD = re.compile(r"[A-Za-z]+(?:\d[\w./:-]*)?|\d[\w./:-]*|[^\w\s]")
_OPEN = re.compile(r" 0(?: [-/.,()+0])* ")
_STOPS = (".", "!", "?")
_MARK = re.compile(r"^\s*[*>|-]\s*|^[^:]{1,24}:\s+")
_BULLET = re.compile(r"\s*(?:[*>|-]|\d+[.)])\s")


def fold(line: str) -> str:
    """A line without letters outside ASCII, look-alike letters folded before: damaged characters don't matter."""
    if line.isascii():
        return line
    if _ODD.search(line):
        return _RARE.sub("", line.translate(_TO_LATIN))
    return _RARE.sub("", line.replace("–", "-").replace("»", ">").replace("·", "|").replace("•", "*").replace("©", "@"))


def words(folded: str) -> list[str]:
    """Words and signs: anything with a digit is ``0``, a capitalised word after the first is ``X``."""
    found = _WORD.findall(folded)
    out = list(map(_CODES.__getitem__, found))
    if found and out[0] == "X":
        out[0] = found[0].lower()
    return out


class _Codes(dict):
    """What stands for a word; worked out once."""

    def __missing__(self, w: str) -> str:
        if w.isalpha():
            code = "X" if w[0].isupper() and not w.isupper() else w.lower()
        else:
            code = w if len(w) == 1 and not w.isdigit() else "0"
        if len(self) > 200_000:
            self.clear()
        self[w] = code
        return code


_CODES = _Codes()


def template(ws: list[str]) -> int:
    """A hash of the words in which a run of names and numbers is one open place."""
    joined = " " + " ".join(ws).replace("X", "0") + " "
    return xxhash.xxh3_64_intdigest(_OPEN.sub(" 0 ", joined)) >> 1


def beginning(ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("begin " + " ".join(ws[:2])) >> 1 if len(ws) > 2 else 0


def plain_key(line: str) -> str:
    return " ".join(fold(line).lower().split())


@dataclass(slots=True)
class Line:
    """A non-blank line: what can be said of it alone."""

    text: str
    template: int
    core: int  # the template without a list mark or a label before a colon
    begin: int  # the first two words of that
    words: list[str]
    length: str
    stops: int
    prose: bool
    size: int
    tabbed: bool
    open: int  # names and numbers
    bullet: bool
    key: str
    residue: bool  # short, and mostly residue of problem 2
    score: float | None = None  # by the model that was asked last


def _id(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % (DIMENSIONS - 1) + 1


def is_residue(line: str) -> bool:
    """Whether residue of problem 2, fields apart, covers at least 70 % of a line: it is neither furniture nor evidence."""
    return 10 * covered_length([x for x in find_residue(line) if x[0] != "field"]) >= 7 * max(len(line), 1)


class Reader:
    """Describes lines; remembers short ones, as a site repeats them, and the ids of features.

    What is remembered is long-lived and free of cycles, so the collector of cycles is told to look at it more rarely.
    """

    def __init__(self, wants_residue: bool = True):
        self.wants_residue = wants_residue
        gc.set_threshold(50_000, 20, 50)
        self.lines: dict[str, Line] = {}
        self.ids: dict[str, int] = {}

    def id(self, name: str) -> int:
        got = self.ids.get(name)
        if got is None:
            if len(self.ids) > 500_000:
                self.ids.clear()
            got = self.ids[name] = _id(name)
        return got

    def line(self, text: str) -> Line:
        got = self.lines.get(text)
        if got is None:
            got = self._line(text)
            if len(text) < 200:
                if len(self.lines) > 50_000:
                    self.lines.clear()
                self.lines[text] = got
        return got

    def _line(self, text: str) -> Line:
        folded = fold(text)
        ws = words(folded)
        bare = text.strip()
        size = len(bare)
        stops = folded.count(". ") + folded.count("? ") + folded.count("! ") + (bare[-1:] in _STOPS)
        marked = _MARK.match(folded)
        core = words(folded[marked.end() :]) if marked else ws
        full = template(ws)
        return Line(
            text, full, (template(core) if marked else full) if len(core) > 2 else 0, beginning(core), ws, f"length {min(size.bit_length(), 10)}", stops,
            size >= PROSE and stops > 0, size, "\t" in bare, ws.count("0") + ws.count("X"), bool(_BULLET.match(folded)), " ".join(folded.lower().split()) if size < 400 else "",
            self.wants_residue and (size < PROSE or not stops) and is_residue(bare),
        )

    def shape(self, line: Line) -> tuple[str, ...]:
        bare, ws, n = line.text.strip(), line.words, len(line.words) or 1
        separators = ws.count(">") + ws.count("|") + ws.count("/")
        return (
            line.length,
            f"stops {min(line.stops, 3)}",
            f"end {'stop' if bare[-1:] in _STOPS else 'colon' if bare[-1:] in (':', ';', ',') else 'dots' if bare[-1:] == '…' else 'word'}",
            f"separators {min(separators, 4)}",
            f"open {round(4 * line.open / n)}",
            f"digits {round(5 * ws.count('0') / n)}",
            f"tabs {min(bare.count(chr(9)), 2)}",
        )

    def name_ids(self, line: Line) -> list[int]:
        """Ids of the features of a line's words."""
        return [self.id(n) for n in word_features(line)]


def word_features(line: Line) -> list[str]:
    """A line's words, each once, the first and last of them, and the first and last two."""
    ws = line.words
    some = list(set(ws))
    if ws:
        some += [f"first {ws[0]}", f"last {ws[-1]}", "begin " + " ".join(ws[:2]), "end " + " ".join(ws[-2:])]
    return some


@dataclass(slots=True)
class Page:
    """A page's non-blank lines with everything that is known before the fit."""

    numbers: list[int]
    lines: list[Line]
    counts: list[int]  # different pages of the site that hold the line's template
    everywhere: list[int]  # pages of all sites that hold it
    titles: list[bool]  # whether it has the template of a page's title
    begins: list[bool]  # whether it begins as titles do, and names or counts something
    outside: list[float]  # share of them that hold it before or after their prose
    pages: int  # different pages of the site
    first: int = 0  # first and last line of the page's own prose
    last: int = 0
    heading: int | None = None
    gaps: list[bool] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)  # of the edge to the line before
    linked: list[bool] = field(default_factory=list)  # in a list of titles of other pages
    own: list[bool] = field(default_factory=list)  # prose and tables that other pages don't hold
    again: Counter = field(default_factory=Counter)  # lines of the page by template


def read(text: str, reader: Reader) -> tuple[list[int], list[Line]]:
    """Numbers and descriptions of the non-blank lines."""
    numbers, lines = [], []
    for n, raw in enumerate(text.split("\n"), 1):
        if raw and not raw.isspace():
            numbers.append(n)
            lines.append(reader.line(raw))
    return numbers, lines


def find_heading(lines: list[Line], title: str | None) -> int | None:
    """The line that says the page's title, the first of them that follows no prose."""
    wanted = plain_key(title) if title else ""
    return next((i for i, x in enumerate(lines) if x.key == wanted), None) if wanted else None


def _with_lists(lines: list[Line], last: int) -> int:
    """The end of the list that follows line ``last`` directly."""
    while last >= 0 and last + 1 < len(lines) and lines[last + 1].bullet:
        last += 1
    return last


def outside_prose(lines: list[Line], title: str | None) -> list[bool]:
    """Whether each line stands before or after everything that looks like paragraphs, tables or the heading."""
    inner = [i for i, x in enumerate(lines) if x.prose and x.size >= PARAGRAPH or x.tabbed]
    heading = find_heading(lines, title)
    if heading is not None:
        inner.append(heading)
    lo, hi = (min(inner), _with_lists(lines, max(inner))) if inner else (len(lines), -1)
    return [not lo <= i <= hi for i in range(len(lines))]


#: Pages of the site and of all sites that hold a template, those where it stands outside prose, and titles that have it.
Stats = tuple[int, int, int, int]
_NEW: Stats = (1, 1, 0, 0)


def arrange(text: str, title: str | None, site: dict[int, Stats], pages: int, reader: Reader) -> Page:
    numbers, lines = read(text, reader)
    stats = [site.get(x.template, _NEW) for x in lines]
    counts = [s[0] for s in stats]
    titles = [(s[3] or x.core and site.get(x.core, _NEW)[3]) > 1 for x, s in zip(lines, stats)]
    page = Page(numbers, lines, counts, [s[1] for s in stats], titles, [x.open > 0 and x.begin != 0 and site.get(x.begin, _NEW)[3] >= REPEATED for x in lines], [s[2] / s[1] for s in stats], max(pages, 1))
    page.again = again = Counter(x.template for x in lines)
    page.own = [
        not is_title and ((x.prose or x.tabbed) and c <= OWN or x.open >= 2 and again[x.template] >= ROWS or _announces(x)) for x, c, is_title in zip(lines, counts, titles)
    ]
    own = [i for i, is_own in enumerate(page.own) if is_own]
    page.heading = find_heading(lines, title)
    if page.heading is None:  # no title, or it stands nowhere: the last line like a title before the page's own prose
        above = [i for i in range(own[0] if own else len(lines)) if titles[i] and not lines[i].bullet]
        page.heading = (above[-1] if own else above[0]) if above else None
    inner = own + ([page.heading] if page.heading is not None else [])
    page.first, page.last = (min(inner), _with_lists(lines, max(inner))) if inner else (len(lines), -1)
    page.gaps = [bool(i) and numbers[i] - numbers[i - 1] > 1 for i in range(len(lines))]
    page.kinds = [edge_kind(page, i) if i else -1 for i in range(len(lines))]
    page.linked = _lists_of_titles(page)
    return page


def _announces(x: Line) -> bool:
    return x.key.split(" ", 1)[0].rstrip(":") in ANNOUNCEMENTS


def context(page: Page, i: int) -> tuple:
    """What can be said of a line from its page and site, in few values."""
    x, c, n = page.lines[i], page.counts[i], len(page.lines)
    share = c / page.pages
    has_next = i + 1 < n
    return (
        "only" if page.last < 0 else "above" if i < page.first else "below" if i > page.last else "within",
        "once" if c <= 1 else "twice" if c < REPEATED else "rare" if share < 0.01 else "some" if share < 0.05 else "much" if share < 0.2 else "most",
        round(page.outside[i] * 10) if page.everywhere[i] >= REPEATED else -1,
        x.length,
        min(i.bit_length(), 5),
        min((n - 1 - i).bit_length(), 5),
        x.size < PROSE,
        has_next and page.own[i + 1],
        i > 0 and page.own[i - 1],
        page.gaps[i],
        has_next and page.gaps[i + 1],
        x.bullet,
        page.linked[i],
        x.prose,
        min(page.again[x.template].bit_length(), 4),
        "heading" if i == page.heading else "title" if page.titles[i] else "begins" if page.begins[i] else "",
    )


def context_features(values: tuple) -> list[str]:
    place, often, outside, length, top, bottom, short, own_next, own_prev, gap, gap_next, bullet, linked, prose, again, title = values
    out = [
        f"place {place}",
        f"often {often}",
        f"often {often} {place}",
        f"outside {outside} {place}",
        f"outside {outside} {length}",
        f"often {often} {length}",
        f"{place} {length}",
        f"top {top}",
        f"bottom {bottom}",
        f"next {own_next} {place} {short}",
        f"prev {own_prev} {place} {short}",
        f"gap {gap} {gap_next} {place}",
        f"bullet {bullet} {linked} {place}",
        f"prose {prose} {often} {place}",
        f"again {again} {place}",
    ]
    if title == "heading":
        out.append("heading")
    elif title == "title":
        out.append(f"title of another page {place}")
    elif title == "begins":
        out.append(f"begins like a title {prose} {bullet} {place}")
    return out


def _lists_of_titles(page: Page) -> list[bool]:
    """Whether each line belongs to a run of like lines of which at least half are titles of other pages: the others lead to pages too."""
    out = [False] * len(page.lines)
    start = 0
    for i in range(1, len(page.lines) + 1):
        if i == len(page.lines) or page.kinds[i] not in (2, 4):
            n_titles = sum((page.titles[k] or page.begins[k]) and k != page.heading and not page.own[k] for k in range(start, i))
            if i - start > 1 and 2 * n_titles >= i - start:
                out[start:i] = [True] * (i - start)
            start = i
    return out


def weak_label(page: Page, i: int) -> int:
    """1 furniture, -1 body, 0 not known, from the repetition within the site, the heading and the page's own prose."""
    x, c = page.lines[i], page.counts[i]
    if page.lines[i].residue:
        return 0
    if i == page.heading:
        return -1
    within = page.first < i < page.last
    if page.titles[i]:
        return 1 if page.heading is None or x.key != page.lines[page.heading].key else 0
    if page.own[i]:
        return -1
    if page.begins[i] or page.linked[i]:
        return 1
    if within and page.outside[i] < 0.15 and x.size < PROSE and (x.bullet and not page.linked[i] or page.own[i + 1]):
        return -1
    return 1 if c >= REPEATED and page.outside[i] >= 0.4 or page.everywhere[i] >= REPEATED and page.outside[i] >= 0.6 and not within else 0


EDGE_KINDS = ("near", "apart", "alike", "beside prose", "list", "list heading")
#: Capacity of a line of residue towards body, and of the edge to the next line of its block: a message goes on there.
RESIDUE, RESIDUE_EDGE = -50.0, 4.0
#: Scale of log-odds as capacities, as the evidence of a line and of its neighbours is not independent; bound of a line's.
SCALE, BOUND = 0.5, 6.0


def edge_kind(page: Page, i: int) -> int:
    """The kind of the edge between line ``i - 1`` and line ``i``: of two blocks, or within one by
    what the lines are; the page's heading is a block of its own, and a line before
    own prose opens one."""
    a, b = page.lines[i - 1], page.lines[i]
    opens = not (page.own[i] or b.bullet) and i + 1 < len(page.lines) and page.own[i + 1]
    if page.gaps[i] or opens or page.heading in (i - 1, i):
        return 1
    if a.bullet and b.bullet and a.key[:1] == b.key[:1]:
        return 4
    if b.bullet and not a.bullet and not a.prose:
        return 5
    if page.own[i - 1] != page.own[i]:
        return 3
    return 2 if a.bullet == b.bullet and a.length == b.length and a.prose == b.prose else 0


class Features:
    def __init__(self, reader: Reader):
        self.reader = reader

    def of(self, page: Page, i: int) -> tuple[np.ndarray, int]:
        """Feature ids, those of the words first, and how many those are."""
        x, get = page.lines[i], self.reader.id
        ids = self.reader.name_ids(x)
        return np.array([*ids, *(get(n) for n in self.reader.shape(x)), *(get(n) for n in context_features(context(page, i)))], np.int32), len(ids)


@dataclass
class Model:
    weights: np.ndarray
    edges: tuple[float, ...] = (0.0,) * len(EDGE_KINDS)

    def score(self, ids: np.ndarray, n_words: int) -> float:
        w = self.weights[ids]
        s = float(w[n_words:].sum()) + float(self.weights[0])
        return s + float(w[:n_words].sum()) / math.sqrt(n_words) if n_words else s


class _Weights(dict):
    """Weights of features by name; worked out once."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.all = weights.tolist()

    def __missing__(self, name: str) -> float:
        if len(self) > 500_000:
            self.clear()
        got = self[name] = self.all[_id(name)]
        return got


class Scorer:
    """Scores of lines by a model; what is known of a line alone and of a context is scored once."""

    def __init__(self, model: Model, reader: Reader):
        self.model, self.reader = model, reader
        self.weight = _Weights(model.weights).__getitem__
        self.bias = float(model.weights[0])
        self.contexts: dict[tuple, float] = {}

    def _alone(self, line: Line) -> float:
        if line.score is None:
            names = word_features(line)
            line.score = sum(map(self.weight, self.reader.shape(line))) + self.bias + (sum(map(self.weight, names)) / math.sqrt(len(names)) if names else 0.0)
        return line.score

    def score(self, page: Page, i: int) -> float:
        values = context(page, i)
        got = self.contexts.get(values)
        if got is None:
            if len(self.contexts) > 200_000:
                self.contexts.clear()
            got = self.contexts[values] = sum(map(self.weight, context_features(values)))
        return got + self._alone(page.lines[i])


def capacities(page: Page, scorer: Scorer) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities of a page's lines and the edges between neighbours."""
    unary, edges = [], []
    for i in range(len(page.lines)):
        unary.append(RESIDUE if page.lines[i].residue else max(-BOUND, min(BOUND, SCALE * scorer.score(page, i))))
        if i:
            goes_on = page.lines[i - 1].residue and not page.gaps[i] and page.counts[i] < REPEATED
            edges.append((i - 1, i, RESIDUE_EDGE if goes_on else scorer.model.edges[page.kinds[i]]))
    return unary, edges


@dataclass
class SamplePage:
    """What the fit needs of a page: by line the feature ids, how many are of words, the label, the edge to the line before."""

    ids: list[list[int]]
    n_words: list[int]
    labels: list[int]
    kinds: list[int]


def sample_page(page: Page, features: Features) -> SamplePage:
    described = [features.of(page, i) for i in range(len(page.lines))]
    return SamplePage(
        [f.tolist() for f, _ in described],
        [n for _, n in described],
        [weak_label(page, i) for i in range(len(page.lines))],
        [-1 if i == 0 or page.lines[i].residue or page.lines[i - 1].residue else page.kinds[i] for i in range(len(page.lines))],
    )


def edge_weights(pairs: np.ndarray) -> tuple[float, ...]:
    """What more than other neighbours those of a kind agree, in log-odds; nothing where they agree less."""
    base = math.log((pairs[:, 0].sum() + 1) / (pairs[:, 1].sum() + 1))
    return tuple(SCALE * min(4.0, max(0.0, math.log((same + 1) / (differ + 1)) - base)) for same, differ in pairs)


def fit(pages: list[SamplePage]) -> Model:
    """Fit the classifier to the labelled lines, both labels with the same total weight, then the edges to
    how often neighbours agree, by their labels or, where those aren't known, by the sure decisions of the classifier.

    Without lines of both labels nothing can be said: every line stays undecided, which is body.
    """
    rows = [(np.array(f, np.int32), k, y) for p in pages for f, k, y in zip(p.ids, p.n_words, p.labels) if y]
    model = Model(_regression(rows))
    pairs = np.zeros((len(EDGE_KINDS), 2))
    for p in pages:
        scores = [model.score(np.array(f, np.int32), k) for f, k in zip(p.ids, p.n_words)]
        known = [y or (int(math.copysign(1, s)) if abs(s) > 1 else 0) for y, s in zip(p.labels, scores)]
        for i, kind in enumerate(p.kinds):
            if kind >= 0 and known[i] and known[i - 1]:
                pairs[kind, int(known[i] != known[i - 1])] += 1
    model.edges = edge_weights(pairs)
    return model


def _regression(rows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """Weights of a logistic regression by adaptive gradient steps; the words of a line share a weight of the root of their number."""
    labels = np.array([r[2] for r in rows], np.float64)
    w, square = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    if not (labels > 0).any() or not (labels < 0).any():
        return w
    lengths = np.array([len(r[0]) for r in rows])
    ids = np.concatenate([r[0] for r in rows])
    values = np.concatenate([np.concatenate([np.full(k, 1 / math.sqrt(k) if k else 0.0), np.ones(len(f) - k)]) for f, k, _ in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    balance = np.where(labels > 0, 0.5 / (labels > 0).sum(), 0.5 / (labels < 0).sum()) * len(labels)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            take = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in some])
            row = np.repeat(np.arange(len(some)), lengths[some])
            f, v = ids[take], values[take]
            s = np.bincount(row, w[f] * v, len(some)) + w[0]
            g = -balance[some] * labels[some] / (1 + np.exp(np.clip(labels[some] * s, -30, 30)))
            grad = np.bincount(f, g[row] * v, DIMENSIONS)
            grad[0] += g.sum()
            grad = grad / len(some) + DECAY * w
            square += grad * grad
            w -= RATE * grad / np.sqrt(square)
    return w
