"""Problem 2: template residue, filler text, error messages and script notices standing in the place of content.

One Aho-Corasick automaton over all phrases, filler words and marks of fields, of all languages, is run over a text once;
everything is decided on its hits. A phrase counts where phrases cover much of its sentence, filler where its words follow
each other, a field where its opening mark meets its closing one around a name or a request to fill in, unless its
sentence speaks of templates and fields. A record is left out by the share of it that is covered.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evispark.llm.assemble import documents, sorted_windows

# Phrases, in lower case, by kind: what browsers, servers and content systems say in these languages.
ERROR_PHRASES = (
    # Swedish
    "ett oväntat fel har inträffat", "ett fel har inträffat", "ett fel uppstod", "fel uppstod", "något gick fel", "något har gått fel", "ett tekniskt fel", "tekniskt fel har uppstått", "har uppstått", "prova att ladda om", "försök igen senare", "försök igen om en stund",
    "sidan kunde inte hittas", "sidan saknas", "sidan finns inte", "sidan hittades inte", "kunde inte hitta sidan", "kan inte hitta sidan", "sidan du söker finns inte", "sidan du söker kan inte hittas", "sidan har flyttats", "finns inte längre", "sidan kan inte visas", "sidan kunde inte visas", "dokumentet är borttaget eller flyttat", "länken är trasig",
    "sessionen har gått ut", "din session har gått ut", "för många anrop", "för många förfrågningar", "från din adress", "från din ip-adress", "vänta", "logga in på nytt", "du saknar behörighet", "du har inte behörighet", "åtkomst nekad", "tjänsten är tillfälligt stängd", "tillfälligt otillgänglig",
    "tjänsten är inte tillgänglig", "servern svarar inte", "ingen kontakt med servern", "begäran kunde inte behandlas", "underhåll pågår", "sidan är under uppbyggnad", "hoppsan", "här var det tomt", "adressen", "felkod", "felmeddelande", "serverfel", "internt serverfel", "det gick inte att ladda", "det gick inte att hämta", "inga träffar kunde visas",
    # English
    "page not found", "page cannot be found", "page can't be found", "page could not be found", "page does not exist", "page doesn't exist", "page is missing", "page you requested", "page you are looking for", "not found", "error", "internal server error", "server error", "service unavailable", "bad gateway", "gateway timeout", "gateway time-out", "did not answer", "did not respond",
    "bad request", "forbidden", "access denied", "permission denied", "unauthorized", "something went wrong", "an error occurred", "an error has occurred", "an unexpected error occurred", "unexpected error", "please try again later", "the request", "could not be completed", "could not be processed", "connection timed out", "request timed out",
    "try again later", "session expired", "your session has expired", "session has timed out", "we looked for", "but it has moved", "under maintenance", "under construction", "temporarily unavailable", "too many requests", "from your address", "from your ip address", "fatal error", "stack trace", "database error", "error establishing a database connection",
    # Finnish
    "sivua ei löytynyt", "sivua ei löydy", "etsimääsi sivua ei", "tapahtui virhe", "on tapahtunut virhe", "odottamaton virhe", "yritä myöhemmin uudelleen", "yritä uudelleen myöhemmin", "palvelu ei ole käytettävissä", "palvelinvirhe", "istunto on vanhentunut", "pääsy estetty", "ei käyttöoikeutta", "huoltokatko",
    # German, French, Spanish, Norwegian and Danish
    "seite nicht gefunden", "seite wurde nicht gefunden", "seite konnte nicht gefunden werden", "seite existiert nicht", "interner serverfehler", "ein fehler ist aufgetreten", "zugriff verweigert", "versuchen sie es später", "nicht verfügbar", "sitzung ist abgelaufen",
    "page introuvable", "page non trouvée", "erreur interne", "une erreur est survenue", "une erreur s'est produite", "accès refusé", "service indisponible", "página no encontrada", "ha ocurrido un error", "acceso denegado", "error interno",
    "siden ble ikke funnet", "siden finnes ikke", "siden blev ikke fundet", "siden findes ikke", "det oppstod en feil", "der opstod en fejl", "ingen tilgang", "adgang nægtet", "prøv igen senere", "prøv igjen senere",
)
SCRIPT_PHRASES = (
    "aktivera javascript", "aktivera skript", "slå på skript", "tillåt javascript", "javascript är avstängt", "javascript är inaktiverat", "javascript är inte aktiverat", "din webbläsare stöds inte", "stöder inte javascript", "saknar stöd för javascript", "din läsare", "din webbläsare",
    "ladda om vyn", "ladda om sidan", "kräver skript", "kräver javascript", "kräver att javascript", "behöver javascript", "för att visas", "med skript påslaget", "visas bara med", "för att se innehållet", "för att kunna visa", "för att använda", "noscript", "laddar …", "laddar...", "laddar innehåll",
    "enable javascript", "enable scripts", "enable scripts and cookies", "enable cookies", "turn on javascript", "turn javascript on", "activate javascript", "you need to enable", "you must enable", "javascript is required", "javascript required", "javascript is disabled", "javascript is turned off", "javascript is not enabled", "requires javascript", "needs javascript", "without javascript", "your browser does not support", "your browser is not supported", "checking your browser", "just a moment", "verifying you are human",
    "to view", "to run", "to continue", "to use", "on this site", "this site", "this page", "this app", "loading…", "loading...", "please wait",
    "ota javascript käyttöön", "salli javascript", "kytke javascript", "javascript on poistettu käytöstä", "javascript ei ole käytössä", "vaatii javascriptin", "tämä sivu", "tämä sivusto", "selaintasi ei tueta", "selaimesi ei tue", "ladataan…", "ladataan...",
    "aktivieren sie javascript", "javascript ist deaktiviert", "javascript ist nicht aktiviert", "benötigt javascript", "erfordert javascript", "muss javascript aktiviert", "diese seite", "diese website", "um diese seite", "ihrem browser", "ihr browser unterstützt kein",
    "activer javascript", "javascript est désactivé", "nécessite javascript", "cette page", "ce site", "votre navigateur", "habilite javascript", "activar javascript", "requiere javascript", "javascript está desactivado", "esta página", "su navegador", "aktiver javascript", "slå på javascript", "krever javascript", "kræver javascript", "denne siden", "denne side",
)
SAMPLE_PHRASES = (
    "exempeltext", "platshållartext", "dummytext", "dummy copy", "dummy text", "placeholder text", "ska ersättas", "här kommer brödtext", "här kommer text", "skriv text här", "skriv din text här", "din text här", "infoga text här", "text kommer", "rubrik 1", "rubrik 2", "rubrik 3", "exempelrubrik", "blindtext", "brödtext",
    "your text here", "add text here", "text goes here", "content goes here", "sample heading", "your heading here", "your title here", "heading 1", "heading 2", "sample text", "sample page", "just another wordpress site", "hello world", "coming soon", "esimerkkiteksti", "kirjoita teksti tähän", "täytetekstiä", "otsikko 1", "otsikko 2", "hier steht ihr text", "beispieltext", "texte d'exemple", "texto de ejemplo",
    # pangrams and nonsense that stand where text should
    "the quick brown fox jumps over the lazy dog", "flygande bäckasiner söka hwila på mjuka tuvor", "törkylempijävongahdus", "franz jagt im komplett verwahrlosten taxi quer durch bayern", "portez ce vieux whisky au juge blond qui fume", "asdf asdf", "qwerty qwerty", "bla bla bla", "blah blah blah", "text text text", "test test test", "xxx xxx xxx",
)
#: Phrases that say nothing alone: they only add to the coverage that others reach.
WEAK_PHRASES = frozenset((
    "adressen", "från din adress", "från din ip-adress", "vänta", "from your address", "from your ip address", "finns inte längre", "sidan har flyttats", "har uppstått", "the request", "page you requested", "page you are looking for", "försök igen senare", "försök igen om en stund", "logga in på nytt", "not found", "did not answer", "did not respond", "we looked for", "but it has moved", "try again later", "prova att ladda om", "nicht verfügbar", "brödtext", "ska ersättas", "text kommer",
    "to view", "to run", "to continue", "to use", "on this site", "this site", "this page", "this app", "without javascript", "please wait", "din läsare", "din webbläsare", "ladda om vyn", "ladda om sidan", "för att visas", "för att se innehållet", "för att kunna visa", "för att använda", "visas bara med", "tämä sivu", "tämä sivusto", "diese seite", "diese website", "um diese seite", "ihrem browser", "cette page", "ce site", "votre navigateur", "esta página", "su navegador", "denne siden", "denne side",
    "rubrik 1", "rubrik 2", "rubrik 3", "heading 1", "heading 2", "otsikko 1", "otsikko 2",
))
#: The common filler text and its usual continuations.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip "
    "commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum "
    "vitae eget arcu porta tortor lacus cursus lectus viverra pharetra mauris sapien massa feugiat ornare blandit "
    "aenean aliquam aliquet ante auctor augue bibendum condimentum congue convallis cras curabitur dapibus diam dictum dictumst dignissim egestas eleifend elementum erat eros euismod facilisis faucibus fermentum "
    "fringilla fusce gravida habitasse hendrerit iaculis imperdiet interdum justo laoreet leo libero ligula lobortis luctus maecenas malesuada mattis metus molestie morbi nibh nunc odio orci pellentesque phasellus "
    "placerat platea posuere praesent pretium primis proin pulvinar purus quam quisque rhoncus risus rutrum sagittis scelerisque semper sodales sollicitudin suscipit suspendisse tellus tempus tincidunt tristique "
    "turpis ultrices ultricies urna varius vehicula vestibulum vivamus volutpat vulputate"
).split()
#: Short words that may stand between them.
FILLER_LINKS = frozenset("a ac ad at aut est et eu ex hac id in ipsa leo nec neque nisl non ne per qui sem si te ut vel".split())
#: Codes of error pages as entries of their breadcrumbs.
CODES = tuple(f"{mark} {code}" for mark in "/»>|" for code in (403, 404, 500, 503))
#: Names of fields that may stand between marks which are ordinary punctuation as well.
FIELD_NAMES = frozenset(
    "kommun_namn kommun gatuadress kontaktperson rubrik avtalsnr belopp datum enhet namn adress titel förnamn efternamn telefon telefonnummer epost personnummer diarienummer handläggare postnummer ort "
    "name title date address amount unit firstname lastname first_name last_name first last phone email company city signature recipient sender client customer "
    "nimi osoite otsikko etunimi sukunimi puhelin päivämäärä vorname nachname anschrift betrag nom prénom adresse nombre apellido dirección fornavn etternavn efternavn beløp dato".split()
)
#: Requests to fill something in, with which a field in brackets begins.
REQUESTS = ("ange", "infoga", "fyll i", "skriv", "lägg in", "välj", "insert", "enter", "type", "fill in", "add your", "your", "syötä", "kirjoita", "lisää", "täytä", "bitte", "hier", "saisir", "insérez", "inserte", "sett inn", "indsæt", "ange ditt", "ditt", "din")
#: Opening and closing marks of fields, and what must stand between: anything, a name, or a known name or request.
MARKS = (
    ("{{", "}}", "any"), ("{%", "%}", "any"), ("<%", "%>", "any"), ("[%", "%]", "any"), ("[todo", "]", "any"), ("[[", "]]", "name"), ("${", "}", "name"), ("%%", "%%", "name"), ("@@", "@@", "name"), ("<<", ">>", "name"), ("xxxx-", "-xxxx", "name"),
    ("#", "#", "small"), ("{", "}", "small"), ("[", "]", "known"), ("<", ">", "known"), ("«", "»", "only"), ("%", "%", "capitals"),
)
#: Broken output of templates.
BROKEN = ("undefined", "[object object]", "mergefield")
#: Beginnings of words that speak of templates and fields, without letters outside ASCII, which may be damaged.
SPEAKS_OF_FIELDS = re.compile(
    r"(?<![a-z])(?:[a-z]*mall(?:en|ens|ar|arna)?(?![a-z])|template|vorlage|plantilla|f[^\s,]{0,4}lt(?:et|en|ets|namn)?(?![a-z])|fields?(?![a-z])|felder|champs?(?![a-z])|campos?(?![a-z])|kentt|placeholder|platsh[a-z]*llar|platzhalter|mark[^\s,]{0,4}r(?:en|er|ing)?(?![a-z])|marker"
    r"|ers[^\s,]{0,4}tt?[eas]|automati[sc]|automaatt|byt(?:a|er|s|t)? ut|bytas ut|ta ut m|replace|ersetz|remplac|korvata|variab|syntax)"
)

_CONTENT = {
    "any": re.compile(r"(?=.*\S)", re.S),
    "name": re.compile(r"\s*[^\W\d][\w.\-]*\s*$"),
    "small": re.compile(r"[a-zåäö_][\wåäö]+$"),
    "capitals": re.compile(r"[A-ZÅÄÖ][A-ZÅÄÖ_]+$"),
}
_REQUEST = re.compile(r"(?:" + "|".join(sorted((re.escape(r) for r in REQUESTS), key=len, reverse=True)) + r")\s+\S")
_BETWEEN = frozenset("på av för till och of the for de och".split())
_TAGS = frozenset("title address date name".split())  # elements of markup are no fields
_BLANK = re.compile(r"\n\s*\n")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of other scripts that look Latin: folded before the context is judged.
_FOLD = str.maketrans("аесорхуіѕјԁοαΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aecopxyisjdoaABEZHIKMNOPTYXABEKMHOPCTX")
#: Letters that a pattern without regard to case takes for another one, and that small letters keep apart.
_CASE = str.maketrans("ſıİ", "sii")
_IDS = re.compile(r"https?://\S+|\b[\w-]*[0-9a-f]*\d[\w./:-]*|[()–\-,.:;!?*•»>/|]")
_BREAK = re.compile(r"\n|\f|[.!?…:]\s|\s[/»>|·]\s")
#: Least share of its sentence that phrases must cover, ids, numbers and punctuation left out.
COVERAGE = 0.4
#: Share of a document from which on it is left out.
MOSTLY = 0.5


def automaton() -> ahocorasick.Automaton:
    kinds: dict[str, set[str]] = {}
    for kind, phrases in (
        ("error", ERROR_PHRASES), ("script", SCRIPT_PHRASES), ("sample", SAMPLE_PHRASES), ("code", CODES), ("filler", FILLER_WORDS), ("broken", BROKEN), ("mark", {m for o, c, _ in MARKS for m in (o, c)}),
    ):
        for p in phrases:
            kinds.setdefault(p, set()).add(kind)
    a = ahocorasick.Automaton()
    for p, of in kinds.items():
        a.add_word(p, (p, sorted(of)[0] if len(of) == 1 else "error"))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def _hits(low: str) -> list[tuple[int, str, str]]:
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    return [(end + 1 - len(p), kind, p) for end, (p, kind) in _AUTOMATON[0].iter(low)]


class Sentences:
    """The sentences, or entries of a line of entries, of a text, found when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.ends: list[int] | None = None

    def around(self, at: int) -> tuple[int, int]:
        if self.ends is None:
            breaks = list(_BREAK.finditer(self.text))
            self.ends, self.starts = [m.start() + (self.text[m.start()] in ".!?…:") for m in breaks], [m.end() for m in breaks]
        k = bisect_right(self.starts, at)
        j = bisect_left(self.ends, at + 1)
        return self.starts[k - 1] if k else 0, self.ends[j] if j < len(self.ends) else len(self.text)


def _word_edge(low: str, start: int, end: int) -> bool:
    return not (start and low[start - 1].isalnum() and low[start].isalnum()) and not (end < len(low) and low[end].isalnum() and low[end - 1].isalnum())


def _known(content: str, rule: str) -> bool:
    names = [w for w in content.replace("-", "").split() if w not in _BETWEEN]
    if rule == "only":
        return len(names) == 1 and names[0] in FIELD_NAMES
    return bool(names) and all(w in FIELD_NAMES for w in names)


def _fields(text: str, low: str, marks: dict[str, list[int]]) -> list[tuple[int, int]]:
    """Places of fields: every opening mark with the next closing one, what stands between being right for them."""
    found: list[tuple[int, int]] = []
    for opens, closes, rule in MARKS:
        starts = marks.get(opens)
        ends = marks.get(closes)
        if not starts or not ends:
            continue
        single = len(opens) == 1
        if rule == "known":
            starts = [s for s in starts if _REQUEST.match(low, s + 1) or low[s + 1 : s + 2].isalpha()]
            asking = [s for s in starts if _REQUEST.match(low, s + 1)]
        taken = -1
        for n, s in enumerate(starts):
            if s < taken:
                continue
            if single and (low[s - 1 : s] in tuple("{$[<%#") or low[s + 1 : s + 2] in tuple("{[<%#")):
                continue
            if single and low[s - 1 : s].isalnum() and opens in "#%{":
                continue
            at = s + len(opens)
            k = bisect_left(ends, at)
            if k == len(ends):
                break
            e = ends[k]
            if single and opens == "{" and low[e + 1 : e + 2] == "}":
                continue
            request = rule == "known" and bool(_REQUEST.match(low, at))
            others = asking if request else starts
            j = bisect_right(others, s)
            if opens != closes and j < len(others) and others[j] < e:
                continue
            if _BLANK.search(text, s, e):
                continue
            content = text[at:e]
            if rule in ("known", "only"):
                right = request or _known(low[at:e], rule) and not (opens == "<" and low[at:e] in _TAGS)
            else:
                right = bool(_CONTENT[rule].match(content))
            if right and opens == "#" and low[e + 1 : e + 2] and (low[e + 1].isalnum() or low[e + 1] == "#"):
                right = False
            if right:
                taken = e + len(closes)
                found.append((s, taken))
    return found


def _runs(low: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of filler words that follow each other, short linking words between: ``(start, end, words)``."""
    runs: list[tuple[int, int, int]] = []
    for a, b in words:
        if runs:
            start, end, n = runs[-1]
            between = low[end:a]
            if all(w in FILLER_LINKS for w in _LETTERS.findall(between)) and not any(c.isdigit() for c in between):
                runs[-1] = (start, b, n + 1)
                continue
        runs.append((a, b, 1))
    return runs


def find_residue(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the places where residue stands in earnest; kinds: field, filler, sample, error, script."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length: leave them as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if "ſ" in low or "ı" in low or "İ" in low:  # the patterns take them for s and i
        low = low.translate(_CASE)
    hits = _hits(low)
    if not hits:
        return []
    found: list[tuple[str, int, int]] = []
    sentences = Sentences(text)
    marks: dict[str, list[int]] = {}
    filler: list[tuple[int, int]] = []
    fields: list[tuple[int, int]] = []
    by_sentence: dict[tuple[int, int], list[tuple[int, int, str, str]]] = {}
    for at, kind, p in hits:
        end = at + len(p)
        if kind == "mark":
            marks.setdefault(p, []).append(at)
        elif kind == "code":
            if not text[end:].split("\n", 1)[0].strip():  # an error page as the last entry of its breadcrumbs
                found.append(("error", at + 2, end))
        elif not _word_edge(low, at, end):
            continue
        elif kind == "filler":
            filler.append((at, end))
        elif kind == "broken":
            if p != "undefined" or low[end : end + 1] in (",", ".", ";", ":", " "):
                fields.append((at, end))
        else:
            by_sentence.setdefault(sentences.around(at), []).append((at, end, kind, p))
    if marks:
        fields += _fields(text, low, marks)
    for a, b in fields:
        left = max(text.rfind("\n", 0, a), text.rfind(". ", 0, a)) + 1
        right = min([k for k in (text.find("\n", b), text.find(". ", b)) if k >= 0], default=len(text))
        if not SPEAKS_OF_FIELDS.search(f"{low[left:a]} {low[b:right]}".translate(_FOLD)):
            found.append(("field", a, b))
    for a, b, n in _runs(low, filler):
        b += low[b : b + 1] in (".", "!", "?", "…")
        if n >= 4:
            found.append(("filler", a, b))
        elif n >= 2:
            lo, hi = sentences.around(a)
            rest = _LETTERS.findall(low[lo:a]) + _LETTERS.findall(low[b:hi])
            if all(w in FILLER_LINKS for w in rest):
                found.append(("filler", a, b))
    for (a, b), spans in by_sentence.items():
        names = {p for *_, p in spans}
        if {"rubrik 1", "rubrik 2"} <= names or "skriv text här" in names:
            found.append(("sample", min(s[0] for s in spans), max(s[1] for s in spans)))
            continue
        if names <= WEAK_PHRASES:
            continue
        covered = set()
        for s, e, *_ in spans:
            covered.update(range(s, e))
        rest = _IDS.sub("", "".join(c for k, c in enumerate(text[a:b], a) if k not in covered))
        n, left = sum(not text[k].isspace() for k in covered), len(re.sub(r"\s", "", rest))
        if n / (n + left) >= COVERAGE and not (names == {"error"} and left):
            strong = next(s for s in spans if s[3] not in WEAK_PHRASES)
            found.append((strong[2], strong[0], strong[1]))
    return found


def covered_length(found: list[tuple[str, int, int]]) -> int:
    """How many characters the places cover, each counted once."""
    total, done = 0, 0
    for _, a, b in sorted(found, key=lambda x: x[1:]):
        total += max(0, b - max(a, done))
        done = max(done, b)
    return total


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, spans, shares = [], [], [], []
        for i, t in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            found = find_residue(t)
            if found:
                covered = covered_length(found)
                ids.append(i)
                kinds.append(sorted({k for k, _, _ in found}))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda x: x[1:])])
                shares.append(covered / len(t))
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(spans, pa.list_(span)), pa.array(shares, pa.float64())], names=["id", "kinds", "spans", "share"])


def residue(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows whose text holds residue: ``id, kinds, spans, share`` (of the text that the spans cover).

    Null and empty texts have none. Every input row is judged by itself and whole; repeated rows give repeated results;
    extra columns are not read.
    """
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''").mapInArrow(_detect, "id string, kinds array<string>, spans array<struct<kind:string,start:int,end:int>>, share double")


@F.pandas_udf(DoubleType())
def residue_share(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The share of a text that residue covers; 0 for null and empty texts."""
    for s in texts:
        yield s.map(lambda t: covered_length(find_residue(t)) / len(t) if isinstance(t, str) and t else 0.0).astype(float)


def without_residue(df: DataFrame, text_col: str = "text", least_share: float = 0.0) -> DataFrame:
    """The rows of ``df`` (all columns, repeated rows included) without those of which residue covers more than ``least_share``.

    Every row is judged by its own text, without a shuffle; null and empty texts stay.
    """
    return df.where(residue_share(F.col(text_col)) <= least_share)


def _documents(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(6)]
        types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        names = ["document_id", "n_chars", "covered", "share", "kinds", "excluded"]
        for doc, _, text in documents(batches):
            found = find_residue(text)
            covered = sum(len(text[a:b].strip()) for a, b in _whole_sentences(text, found))
            n = len(text.replace("\n", "").strip())
            share = min(1.0, covered / n) if n else 0.0
            for c, v in zip(cols, (doc, len(text), covered, round(share, 6), sorted({k for k, _, _ in found}), share >= most)):
                c.append(v)
            if len(cols[0]) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                cols = [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _whole_sentences(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The sentences that hold residue, fields by themselves, merged where they touch."""
    sentences = Sentences(text)
    spans = sorted((a, b) if kind == "field" else (min(a, sentences.around(a)[0]), max(b, sentences.around(b - 1)[1])) for kind, a, b in found)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def document_residue(chunks: DataFrame, sources: DataFrame, most: float = MOSTLY) -> DataFrame:
    """Every document with a text: ``document_id, n_chars, covered, share, kinds, excluded``.

    ``covered``: characters of its whole text in sentences that are residue; a document is ``excluded`` where they are at
    least ``most`` of it. Documents without metadata are judged too; null and empty texts have no row.
    """
    schema = "document_id string, n_chars int, covered int, share double, kinds array<string>, excluded boolean"
    return sorted_windows(chunks, sources).mapInArrow(_documents(most), schema)
