"""Operator 12: runs (maximal stretches with a smallest period) of words, by Lyndon arrays in linear time, without suffix structures or hashes.

The words of a text are its letters, ranked within the text. For an order of the letters and for its reverse, every
position gets the end of the longest Lyndon word that begins there: the next smaller suffix, found on a stack from left to
right. What two suffixes share is reused: of all pairs compared so far, the one whose match reaches furthest to the right
makes a zone that repeats an earlier stretch. A pair in the zone has the extension of its image in that stretch if that
one ends within the zone; otherwise it shares all up to the zone's end, and letters are compared only beyond it. So the
compared letters move to the right only, and the work is linear.

A run has a Lyndon word of its period's length as a root, in one of the two orders, and it is the longest that begins
there; so each run shows as a pair (position, next smaller suffix) with its extension to the right. Only roots whose
extension admits the asked exponent are extended to the left, by less than a period.

Contract: a null or empty text, or one without words, has no runs (four nulls, hashes of nothing); a null key is allowed;
each row is judged by itself, so ties and repeated rows give equal rows; a long text is one unit of work, of some 150
bytes a word; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.words import give_back

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Bytes of text that are split at a time, and words that are joined at a time.
PIECE, JOINED = 1 << 20, 1 << 16
_SPACES = b" \t\n\x0b\x0c\r"
Run = tuple[int, int, int]


def words_of(data: bytes) -> list[bytes]:
    """Maximal stretches without the six spaces of ASCII; equal words of a long text are one object."""
    if len(data) <= PIECE:
        return data.split()
    own: dict[bytes, bytes] = {}
    out: list[bytes] = []
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data) and data[hi] not in _SPACES:
            hi += 1
        out += [own.setdefault(w, w) for w in data[lo:hi].split()]
        lo = hi
    return out


def ranks(words: list[bytes]) -> list[int]:
    """Each word's place in the order of the text's words."""
    place = {w: i for i, w in enumerate(sorted(set(words)))}
    return [place[w] for w in words]


def roots(s: list[int], slack: int, looked: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(first, next smaller suffix, extension) of positions whose suffix shares more than slack periods with the next smaller one.

    The extension is how many letters both suffixes share, the period the distance between them. `looked`, if given, gets
    the number of letters that were compared beyond what was known.
    """
    n = len(s)
    follow, before = [n] * n, [-1] * n  # next and previous smaller suffix
    shared, behind = [0] * n, [0] * n  # letters shared with either
    end = shift = origin = steps = 0  # s[origin:end] repeats s[origin - shift:end - shift]
    out = []
    for r in range(1, n):
        y, left = s[r], r - 1
        while left >= 0:
            x = s[left]
            if x < y:
                break
            if x > y:
                follow[left] = r
                left = before[left]
                continue
            k = 1
            if r < end:
                image = r - shift
                mate = left - shift if left >= origin else left
                known = behind[image] if before[image] == mate else shared[mate] if mate >= 0 and follow[mate] == image else -1
                if 0 <= known < end - r:
                    k = known
                elif known >= 0 and end - r > k:
                    k = end - r
            if r + k >= end or k == 1:
                a, b = left + k, r + k
                while b < n and s[a] == s[b]:
                    a += 1
                    b += 1
                steps += b - r - k + 1
                k = b - r
                if b >= end:
                    end, shift, origin = b, r - left, r
            if r + k < n and s[left + k] < s[r + k]:
                behind[r] = k
                break
            follow[left], shared[left] = r, k
            if k > slack * (r - left):
                out.append((left, r, k))
            left = before[left]
        before[r] = left
    if looked is not None:
        looked.append(steps)
    return out


def runs(s: list[int], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[Run]:
    """(start, length, period) of all runs of at least so many words and so many (two or more) periods, in order of start and period."""
    out = set()
    top = max(s, default=0)
    for order in (s, [top - x for x in s]):
        found = {(first, until - first): k for first, until, k in roots(order, least_exponent - 2)}
        for (first, period), k in found.items():
            if found.get((first - period, period), 0) >= period:
                continue  # not the run's first root
            back = 0
            while back < period and back < first and s[first - 1 - back] == s[first + period - 1 - back]:
                back += 1
            length = back + period + k
            if back < period and length >= max(least_words, least_exponent * period):
                out.add((first - back, length, period))
    return sorted(out, key=lambda x: (x[0], x[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest exponent; of equal ones that of the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeated_words(found: list[Run], n: int) -> bytearray:
    """1 for each word that some run contains after its first period, else 0."""
    gone = bytearray(n)
    for start, length, period in found:
        gone[start + period : start + length] = b"\1" * (length - period)
    return gone


def joined_sha256(words: list[bytes], gone: bytearray) -> str:
    """Of the kept words, joined by one space."""
    out, first = hashlib.sha256(), True
    for lo in range(0, len(words), JOINED):
        kept = [w for w, g in zip(words[lo : lo + JOINED], gone[lo : lo + JOINED], strict=True) if not g]
        if kept:
            out.update((b"" if first else b" ") + b" ".join(kept))
            first = False
    return out.hexdigest()


def with_loop(words: list[bytes], key: int | None) -> list[bytes]:
    """Damage that the contract asks for: of one key in ten, the words from some place on repeat a stretch of theirs. A null key has none."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _each(frame: DataFrame, key: str, text: str, schema: T.StructType, row: Callable[[object, list[bytes]], list[tuple]]) -> DataFrame:
    """Rows that a function makes of each document's key and words."""
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    columns = [arrow[f.dataType] for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at: list[int] = []
            for i, data in enumerate(batch.column(1)):
                made = row(batch.column(0)[i].as_py(), words_of(data.as_py() or b""))
                out += made
                at += [i] * len(made)
            own = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *own], names=schema.names)
        give_back()

    return frame.select(F.col(key), F.encode(F.col(text), "UTF-8")).toDF("key", "data").mapInArrow(run, schema)


def _schema(frame: DataFrame, key: str, columns: str) -> T.StructType:
    return T.StructType([frame.schema[key], *T._parse_datatype_string(columns)])


def find(frame: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """A row for each run of each text: key, start, length, period (in words), and the words of one period."""

    def row(_: object, words: list[bytes]) -> list[tuple]:
        return [(a, n, p, b" ".join(words[a : a + p]).decode()) for a, n, p in runs(ranks(words), least_words, least_exponent)]

    return _each(frame, key, text, _schema(frame, key, "start long, length long, period long, words string"), row)


def digests(frame: DataFrame, key: str = "doc_id", text: str = "text", damage: Callable[[list[bytes], object], list[bytes]] = with_loop) -> DataFrame:
    """One row per document, as contracted; besides, how many words it has and how many are dropped."""

    def row(id_: object, words: list[bytes]) -> list[tuple]:
        words = damage(words, id_)
        found = runs(ranks(words))
        best = strongest(found)
        gone = repeated_words(found, len(words))
        listed = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest()
        own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return [(len(found), *own, listed, joined_sha256(words, gone), len(words), sum(gone))]

    return _each(frame, key, text, _schema(frame, key, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"), row)
