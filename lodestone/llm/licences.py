"""Operator 1: licence scans. Normalised text is compared with templates by Dice's coefficient over word bigrams.

A unit is a line, a paragraph (lines with words in a row, more than one), or a document (of more than one paragraph), so
notices within other text are found as well as whole licence files. Besides, runs of consecutive paragraphs (unit
`paragraphs`) are compared: of those that overlap, the one that shares most bigrams with its template counts, then the one
most alike, then the shortest, then the first; and none that overlaps a line, paragraph or document at least as like the
same template. Normalising drops case and punctuation and keeps runs of ASCII letters, digits and other scripts'
characters. Dice's coefficient is at least t only if the numbers of distinct bigrams differ by a factor of at most
(2 - t) / t; templates are sorted by size, so a binary search picks the few within these bounds, most often none, and the
hits among a unit's bigrams in all templates' are counted before any set is built.

Contract: null and empty texts have no units; a unit of one word has no bigrams and matches nothing; equal texts give
equal rows; rows with one key are scanned each; ties between templates go to the smaller identifier; an empty table gives
no rows; other columns don't matter. A long text takes about 100 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.licence_texts import TEMPLATES
from lodestone.llm.words import WORD_BASE, Words, buffers, slices, spans_hash

LEAST = 0.8

_PLAIN = np.full(256, 32, dtype=np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[10] = 10


def _bigrams(words: list[bytes]) -> frozenset[bytes]:
    return frozenset(a + b" " + b for a, b in zip(words[:-1], words[1:], strict=True))


def normalised(text: str) -> list[bytes]:
    return _PLAIN[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().split()


class Templates:
    """Templates with their bigrams, and the hashes of all of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.own = sorted((name, _bigrams(normalised(text))) for name, text in templates)
        sizes = [len(b) for _, b in self.own]
        self.by_size = sorted(range(len(sizes)), key=lambda k: sizes[k])
        self.sizes = sorted(sizes)
        self.smallest = min((self.lower(n) for n in sizes), default=1)
        joined = b"\n".join(b for _, bigrams in self.own for b in bigrams)
        data = np.frombuffer(joined, dtype=np.uint8)
        bounds = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data)]))
        w = Words(data, bounds)
        self.largest = max((n * (2 - least) / least + 1e-9 for n in sizes), default=0)
        self.hashes = np.unique(spans_hash(w.hash, w.first[:-1], w.first[1:], WORD_BASE)) if len(joined) else np.zeros(0, dtype=np.uint64)

    def lower(self, n: int) -> float:
        """Fewest bigrams of a text that can reach the least coefficient with n of a template."""
        return self.least * n / (2 - self.least) - 1e-9

    def score(self, bigrams: frozenset[bytes]) -> tuple[int, int, float] | None:
        """Number of the template that is most alike, bigrams shared with it, coefficient."""
        n, found = len(bigrams), None
        upper = (2 - self.least) / self.least
        within = self.by_size[bisect_left(self.sizes, (n - 1e-9) / upper) : bisect_right(self.sizes, (n + 1e-9) * upper)]
        for k in sorted(within):
            own = self.own[k][1]
            shared = len(bigrams & own)
            dice = 2 * shared / (n + len(own))
            if dice >= self.least and (found is None or dice > found[2]):
                found = (k, shared, dice)
        return found


def _runs(own: Templates, para: np.ndarray, doc: np.ndarray, pairs: np.ndarray, hit: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first word, end) of runs of paragraphs that may count: each that can be like a template, but for those that do without their first or last paragraph as well.

    An end paragraph must add a hit of its own, and the first must keep one that doesn't come again; so at any word, no
    more runs are open than templates have bigrams.
    """
    share = own.least / (2 - own.least)
    most = own.largest * (1 - share)
    bounds, of, last = para.tolist(), doc[para[:-1]].tolist(), len(pairs)
    for k in np.flatnonzero(hits[np.minimum(para[1:], last)] > hits[para[:-1]]).tolist():
        at, after = bounds[k], bounds[k + 1]
        have: set[int] = set()
        missed: set[int] = set()
        later: set[int] = set()
        first: set[int] = set()
        for e in range(k, len(of)):
            if of[e] != of[k]:
                break
            stop, before = bounds[e + 1] - 1, len(have)
            while at < stop and len(missed) <= most:  # no more at a time than tells that a run is too long
                to = min(stop, at + 256) if at >= after else min(stop, at + 256, after)
                found, kind = pairs[at:to].tolist(), hit[at:to].tolist()
                hit_here = {h for h, x in zip(found, kind, strict=True) if x}
                missed.update(h for h, x in zip(found, kind, strict=True) if not x)
                have |= hit_here
                if at >= after:
                    later |= hit_here
                else:
                    first |= hit_here
                at = to
            if len(missed) > most or len(have) + len(missed) > own.largest or (e > k and first <= later):
                break
            if e > k and len(have) > before and len(have) >= share * (len(have) + len(missed)) - 1e-9:
                yield bounds[k], bounds[e + 1]


def _best_runs(runs: list[tuple], units: list[tuple]) -> Iterator[tuple[int, int, int, float]]:
    """(first word, end, template, coefficient) of the runs that count; runs and units are (kind, first word, end, template, shared bigrams, coefficient)."""
    whole = {(a, b) for kind, a, b, *_ in units if kind == "document"}
    lo = sorted((a, b, t, d) for _, a, b, t, _, d in units)
    taken: list[tuple[int, int]] = []
    for _, a, b, t, _, dice in sorted({*runs, *(u for u in units if u[0] == "document")}, key=lambda r: (-r[4], -r[5], r[2] - r[1], r[1])):
        at = bisect_left(taken, (a, a))
        if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
            continue
        if (a, b) in whole:
            insort(taken, (a, b))
        elif not any(x < b and a < y and u == t and d >= dice for x, y, u, d in lo[: bisect_left(lo, (b,))]):
            insort(taken, (a, b))
            yield a, b, t, dice


def _paragraphs(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """First words of all paragraphs, and the number of words."""
    n = len(line)
    breaks = np.ones(n + 1, dtype=bool)
    breaks[1:n] = (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])
    return np.flatnonzero(breaks)


def _units(first: np.ndarray, line: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, first words, ends) of all units, of words whose documents begin at first and whose line numbers are given."""
    n = len(line)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(edge)
    yield "line", at[:-1], at[1:]
    para = _paragraphs(doc, line)
    lo, hi = para[:-1], para[1:]
    many = line[hi - 1] > line[lo]
    yield "paragraph", lo[many], hi[many]
    lo, hi = first[:-1], first[1:]
    parts = np.searchsorted(para, hi) - np.searchsorted(para, lo)
    yield "document", lo[parts > 1], hi[parts > 1]


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each unit that is like a template: key, unit, first_word, end_word (of normalised words, exclusive), license_id, dice."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("unit string, first_word long, end_word long, license_id string, dice double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates, least)
        for batch in batches:
            keys = batch.column(0)
            data, offsets = buffers(batch.column(1))
            rows: list[tuple] = []
            for lo, hi in slices(offsets, 1 << 20):
                base = offsets[lo]
                plain = _PLAIN[data[base : offsets[hi]]]
                w = Words(plain, offsets[lo : hi + 1] - base)
                if len(w.start) < 2:
                    continue
                line = np.cumsum(plain == 10)[w.start]
                at = np.arange(len(w.start) - 1)
                with np.errstate(over="ignore"):
                    pairs = spans_hash(w.hash, at, at + 2, WORD_BASE)
                place = np.minimum(np.searchsorted(own.hashes, pairs), len(own.hashes) - 1) if len(own.hashes) else 0
                hit = own.hashes[place] == pairs if len(own.hashes) else np.zeros(len(pairs), dtype=bool)
                hits = np.concatenate(([0], np.cumsum(hit)))
                score = lambda i, j: own.score(_bigrams(plain[w.start[i] : w.end[j - 1]].tobytes().split()))  # noqa: B023, E731
                units: dict[int, list[tuple]] = {}
                for kind, a, b in _units(w.first, line):
                    likely = (b - a - 1 >= own.smallest) & (hits[np.maximum(b - 1, a)] - hits[a] >= own.smallest)
                    for i, j in zip(a[likely].tolist(), b[likely].tolist(), strict=True):
                        found = score(i, j)
                        if found:
                            units.setdefault(int(w.doc[i]), []).append((kind, i, j, *found))
                runs: dict[int, list[tuple]] = {}
                for i, j in _runs(own, _paragraphs(w.doc, line), w.doc, pairs, hit, hits):
                    found = score(i, j)
                    if found:
                        runs.setdefault(int(w.doc[i]), []).append(("paragraphs", i, j, *found))
                for doc, some in runs.items():
                    units.setdefault(doc, []).extend([("paragraphs", i, j, k, 0, dice) for i, j, k, dice in _best_runs(some, units.get(doc, []))])
                for doc, some in units.items():
                    rows.extend((lo + doc, kind, i - int(w.first[doc]), j - int(w.first[doc]), own.own[k][0], dice) for kind, i, j, k, _, dice in some)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True))], names=[f.name for f in schema])

    return frame.select(key, text).mapInArrow(run, schema)


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """The same result for DuckDB, comparing every unit with every template within the bounds."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = lambda x: f"list_filter(string_split_regex(translate({x}, '{upper}', '{lower}'), '[\x01-/:-`{{-\x7f]+'), lambda w: w <> '')"
    bigrams = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    values = ", ".join("('" + a + "', '" + b.replace("'", "''").replace("\n", " ") + "')" for a, b in templates)
    return f"""
    WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, o, {split("ls[o]")} AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS o FROM split)),
    marked AS (SELECT *, sum(CAST(len(t) = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY o) AS p,
        coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM lines),
    worded AS MATERIALIZED (SELECT * FROM marked WHERE len(t) > 0),
    units AS (SELECT doc_id, 'line' AS unit, f, t FROM worded
        UNION ALL SELECT doc_id, 'paragraph', min(f), flatten(list(t ORDER BY o)) FROM worded GROUP BY doc_id, p HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'document', min(f), flatten(list(t ORDER BY o)) FROM worded GROUP BY doc_id HAVING count(DISTINCT p) > 1),
    sets AS (SELECT doc_id, unit, f, len(t) AS n, {bigrams("t")} AS b FROM units WHERE len(t) > 1),
    templates AS (SELECT name, {bigrams("t")} AS b FROM (SELECT name, {split("body")} AS t FROM (VALUES {values}) v(name, body))),
    scored AS (SELECT doc_id, unit, f, n, name, 2.0::DOUBLE * len(list_intersect(s.b, x.b)) / (len(s.b) + len(x.b)) AS dice FROM sets s JOIN templates x
        ON len(s.b) >= {least} * len(x.b) / (2 - {least}) - 1e-9 AND len(s.b) <= len(x.b) * (2 - {least}) / {least} + 1e-9),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, f ORDER BY dice DESC, name) AS r FROM scored WHERE dice >= {least})
    SELECT doc_id, unit, CAST(f AS BIGINT) AS first_word, CAST(f + n AS BIGINT) AS end_word, name AS license_id, dice FROM ranked WHERE r = 1"""
