"""Operator 9: personal data, found through disguises with offsets into the source text.

Plain identifiers follow the base patterns. Besides, a chain of transducers rewrites a text while it keeps, for every
character it writes, the source span that it came from: look-alike letters and digits of other scripts become ASCII,
names of digits beside figures or each other become digits, and disguised "at" and "dot", bracketed or bare in any mix,
become their signs. The base patterns then run on the rewritten text, and what they find is mapped back to source spans.
A span wholly inside a plain one of its kind is not added; one that goes beyond it is, beside the plain one.

Contract: a null or empty text has no spans; offsets count code points, ends are exclusive; equal texts give equal spans;
rows of one key are searched each; an empty table gives no rows; other columns don't matter, whatever their names. A long
text takes time in proportion to its length, and memory for its characters and for the edits that disguises call for.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: Starts at a run's first digit and gives no digit back, so that long runs take one pass; a match can't begin within a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches: each sign takes the local part before it that no earlier match holds."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the base patterns."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


#: Look-alikes of ASCII letters in Cyrillic and Greek, and of signs.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠﹫．｡。․＋－‐‑–",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSaovpABEZHIKMNOPTYX@@....+----",
        strict=True,
    )
)
#: Full-width ASCII, and decimal digits of other scripts by their first code point.
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(z + d): str(d) for z in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10) for d in range(10)}
#: Names of digits in the languages of the corpus.
SPELLED = {w: str(d) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())} | {"oh": "0"}

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_NAME = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Names of digits count beside figures or other names; a name by itself is a word.
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_NAME}|[0-9]++)(?:(?:[\x20,().-]{{1,3}}|\x20dot\x20)(?:{_NAME}|[0-9]++))+(?![^\W_])", re.IGNORECASE)
#: What goes between two names; other signs between parts of a number stay.
_GAP = re.compile(r"[\x20,-]{1,2}")
#: Letters that a pattern without case takes for i and s.
_FOLDED = str.maketrans("ıİſ", "iis")
_ONE_NAME = re.compile(_NAME, re.IGNORECASE)
_AT = re.compile(r"(?<=[A-Za-z0-9_])\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT = re.compile(r"(?<=[A-Za-z0-9])\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?(?=[A-Za-z0-9])", re.IGNORECASE)
#: A bare "dot" counts in a host after a sign, or after a bare "at"; that counts where some dot of the host is disguised.
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\x20at\x20|@)([A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)+)", re.IGNORECASE)
#: Before a bare "at", a name begins with a letter and is none of these; the host after it doesn't begin with an article.
NO_NAMES = frozenset("look looks looked looking see seen us me him her them it here there is are was were be been available found hosted online live now out stay visit and or".split())
ARTICLES = frozenset("the a an der die das ein eine el la los las un una le les une".split())
_BARE_DOT = re.compile(r"\x20dot\x20", re.IGNORECASE)
#: Besides, a bare "dot" counts between figures.
_DIGIT_DOT = re.compile(r"(?<=[0-9])\x20dot\x20(?=[0-9])", re.IGNORECASE)
_SIGN = re.compile(r"[\[({<]\x20?(?:at|@|dot|\.)\x20?[\])}>]|\x20dot\x20", re.IGNORECASE)


class Rewritten:
    """A text under rewriting. Only the edits of each step are kept, so memory grows with them, not with the text; spans are mapped back step by step."""

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[tuple[int, int, int]]]] = []  # of each step: where its strings begin now; spans replaced, and their strings' ends

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts strings in place of spans, which rise; each new character stands for the whole span it replaces, or for its own character when lengths agree."""
        if not edits:
            return
        text, at, begins, spans, n = [], 0, [], [], 0
        for lo, hi, new in edits:
            text += (self.text[at:lo], new)
            n += lo - at
            begins.append(n)
            n += len(new)
            spans.append((lo, hi, n))
            at = hi
        text.append(self.text[at:])
        self.text = "".join(text)
        self.steps.append((begins, spans))

    def source(self, span: Span) -> Span:
        first, last = (span[0], span[0] + 1), (span[1] - 1, span[1])
        for begins, spans in reversed(self.steps):
            first, last = (_before(begins, spans, first[0])[0], first[1]), (last[0], _before(begins, spans, last[1] - 1)[1])
        return first[0], last[1]


def _before(begins: list[int], spans: list[tuple[int, int, int]], at: int) -> Span:
    """The span that a step's character at `at` came from."""
    k = bisect_right(begins, at) - 1
    if k < 0:
        return at, at + 1
    lo, hi, end = spans[k]
    if at < end and end - begins[k] != hi - lo:
        return lo, hi
    place = at - end + hi
    return place, place + 1


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    """Each name becomes its digit; spaces, commas and hyphens between two names go."""
    names = list(_ONE_NAME.finditer(m.string, m.start(), m.end()))
    return [(a.start(), b.start() if b and _GAP.fullmatch(m.string, a.end(), b.start()) else a.end(), SPELLED[a[0].translate(_FOLDED).lower()]) for a, b in zip(names, [*names[1:], None], strict=False)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    return [e for m in _SPELLED.finditer(text) for e in _digits(m)]


def _bare(own: Rewritten, text: str) -> list[tuple[int, int, str]]:
    """Bare signs of the addresses in a text whose bracketed signs are rewritten."""
    out = []
    for m in _BARE.finditer(own.text):
        dots = [(*d.span(), ".") for d in _BARE_DOT.finditer(own.text, *m.span(2))]
        if m[1] != "@":
            if not dots and all(text[slice(*own.source((i, i + 1)))] == "." for i in range(*m.span(2)) if own.text[i] == "."):
                continue
            name, host = m[0][: m.start(1) - m.start()].lower(), re.match("[a-z0-9-]+", m[2], re.IGNORECASE)[0].lower()
            if not name[0].isalpha() or name in NO_NAMES or host in ARTICLES:
                continue
            out.append((*m.span(1), "@"))
        out += dots
    return out


def disguised_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only rewriting shows, in source offsets."""
    odd, spelled, sign = (not text.isascii()) and _ODD.search(text), _spelled(text), _SIGN.search(text)
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not (odd or spelled or sign):
        return out
    own = Rewritten(text)
    if odd:
        own.replace([(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _ODD.finditer(own.text)])
    own.replace([(m.start(), m.end(), "@") for m in _AT.finditer(own.text)])
    own.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(own.text)])
    own.replace(_spelled(own.text))
    own.replace(_bare(own, text))
    own.replace([(*m.span(), ".") for m in _DIGIT_DOT.finditer(own.text)])
    if own.text == text:
        return out
    for kind, spans in base_spans(own.text).items():
        taken = plain[kind]  # in order, and apart from each other
        for lo, hi in map(own.source, spans):
            k = bisect_right(taken, lo, key=lambda s: s[0]) - 1
            if k < 0 or hi > taken[k][1]:
                out[kind].append((lo, hi))
    return out


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain and disguised spans by kind."""
    text = text or ""
    plain = base_spans(text)
    return plain, disguised_spans(text, plain)


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str | None) -> str | None:
    """The text with every span, merged where they overlap, replaced by its kind in brackets."""
    if not text:
        return text
    plain, more = find(text)
    spans = sorted((a, b, k) for k in KINDS for a, b in (*plain[k], *more[k]))
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += (text[at:a], f"[{k.upper()}]")
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the plain spans, and all spans as text."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for x in batch.column(text):
                plain, more = find(x.as_py())
                both = {k: sorted(plain[k] + more[k]) for k in KINDS}
                values = (*(len(plain[k]) for k in KINDS), hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(both), sum(map(len, more.values())))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[f.name for f in schema])

    return frame.select(key, text).mapInArrow(run, schema)


def redact_column(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame with personal data in its text column replaced; all rows and columns stay, nulls too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type))

    return frame.mapInArrow(run, frame.schema)
