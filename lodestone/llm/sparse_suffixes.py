"""Operator 7: repeated passages across documents by a sparse suffix array over words.

Suffixes are kept only at minimisers: of each window of `width` words, the start of its `seed`-word run with the smallest
hash, the leftmost on ties. Equal windows choose equal places, so every repeat of `width` words holds a kept suffix at
the same offset in each of its occurrences. Suffixes whose seed occurs once are dropped, then those whose seed occurs
once together with as many words before it, or behind it, as each of its windows has at least at one side. The rest meet
by seed, first within a part, then across parts: they are sorted by the words that follow, compared with their neighbours
(common prefix lengths), and extended to the left. A window that starts earlier elsewhere is a repetition; consecutive
ones with one source make up a passage. Only what is the first of its kind in a part goes on to the others, and, where
there are very many parts, only what is the first in a block of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import exchange as X
from lodestone.llm.repeats import GROUP_WORDS, prefixes
from lodestone.llm.store import cut
from lodestone.llm.words import U64, lean, mix

WIDTH, SEED = 50, 10


def minimisers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Of each place, the leftmost smallest of the next `span` hashes (fewer at the end), by doubling."""
    n = len(hashes)
    value, place = hashes.copy(), np.arange(n)

    def best(av, ap, by):
        bv, bp = np.full(n, np.iinfo(np.uint64).max, dtype=U64), np.full(n, n)
        bv[: n - by], bp[: n - by] = av[by:], ap[by:]
        return bv, bp

    size = 1
    while size < span:
        step = min(size, span - size)
        bv, bp = best(value, place, step)
        take = bv < value
        value, place = np.where(take, bv, value), np.where(take, bp, place)
        size += step
    return place


class Sparse:
    """The sparse suffix array of a part: kept suffixes, the windows that chose each (bits, by distance from their starts), and what the part itself repeats."""

    def __init__(self, words: X.Part, width: int, seed: int):
        self.words, self.width, self.seed = words, width, seed
        at = words.windows(width)
        runs = words.windows(seed)
        own = np.full(len(words.hash), np.iinfo(np.uint64).max, dtype=U64)
        own[runs] = prefixes(words.hash, runs, seed)
        self.place, of = np.unique(minimisers(own, width - seed + 1)[at], return_inverse=True)
        self.hash = own[self.place]
        self.offsets = np.zeros(len(self.place), dtype=U64)
        np.bitwise_or.at(self.offsets, of, U64(1) << (self.place[of] - at).astype(U64))

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the part itself repeats, as compare gives it; the windows' bits of these go."""
        _, group, many = np.unique(self.hash, return_inverse=True, return_counts=True)
        twins = np.flatnonzero(many[group] > 1)
        later, distance, first = compare(self.rows(twins), self.width, self.seed)
        later, first = twins[later], twins[first]
        np.bitwise_and.at(self.offsets, later, ~(U64(1) << distance.astype(U64)))
        return later, distance, first

    def head(self, index: np.ndarray) -> np.ndarray:
        """Windows' bits, key and first word of some suffixes."""
        words, place = self.words, self.place[index]
        doc = words.doc[place]
        return np.stack([self.offsets[index], words.ids()[doc].view(U64), (place - words.first[doc]).astype(U64)], axis=1) if len(index) else np.zeros((0, 3), dtype=U64)

    def rows(self, index: np.ndarray) -> np.ndarray:
        """The same, the `width` words from there on, and the words before."""
        words, place = self.words, self.place[index]
        doc = words.doc[place]
        grid = np.append(words.hash, U64(0))
        right = place[:, None] + np.arange(self.width)
        right = grid[np.where(right < words.first[doc + 1][:, None], right, len(words.hash))]
        left = place[:, None] - 1 - np.arange(self.width - self.seed)
        left = grid[np.where(left >= words.first[doc][:, None], left, len(words.hash))]
        return np.concatenate([self.head(index), right, left], axis=1)

    def seeds(self, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds and their groups, in the order they are sent; and each suffix' seed among them."""
        return _distinct(self.hash, groups)

    def sides(self, seed_shared: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """What is asked for in the second round: distinct hashes of seeds with the words before, or behind, that some window holds; their groups; each question's place among them.

        Also the suffixes that ask, which of them ask for the words before and for those behind, and the windows' bits that depend on either.
        """
        reach = (self.width - self.seed) // 2
        index = np.flatnonzero(seed_shared & (self.offsets > 0))
        far = U64(((1 << self.width) - 1) ^ ((1 << reach) - 1))  # windows that begin so many words before the seed, or more
        before, behind = self.offsets[index] & far, self.offsets[index] & ~far
        a, b = np.flatnonzero(before), np.flatnonzero(behind)
        left = prefixes(self.words.hash, self.place[index[a]] - reach, self.seed + reach)
        right = prefixes(self.words.hash, self.place[index[b]], self.width - reach) ^ U64(0x5851F42D4C957F2D)
        own, group, of = _distinct(np.concatenate([left, right]), groups)
        return own, group, of, (index, a, b, before, behind)


def _distinct(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, of = np.unique(hashes, return_inverse=True)
    group = X.bucket_of(own, groups)
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return own[order], group[order], rank[of] if len(of) else of


def compare(rows: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a sparse suffix array, in order of place: each window that isn't the first of its words, as its suffix, its distance before that, and the suffix of the first.

    Sorts suffixes by the words that follow, takes common prefix lengths of neighbours, and extends to the left a word at
    a time: a window is its suffix' node at the depth that lies behind the seed, and the words before it.
    """
    offsets, right, left = rows[:, 0], rows[:, 3 : 3 + width], rows[:, 3 + width :]
    n, reach = len(rows), width - seed
    order = np.argsort(np.ascontiguousarray(right.astype(">u8")).view(f"V{8 * width}").ravel(), kind="stable")
    common = np.zeros(n, dtype=np.int64)  # words in common with the neighbour before
    same = right[order][1:] == right[order][:-1]
    common[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    extended = np.zeros(n, dtype=U64)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for distance in range(reach + 1):
        live = np.flatnonzero((offsets >> U64(distance)) & U64(1))
        if len(live) > 1:
            node = np.empty(n, dtype=np.int64)
            node[order] = np.cumsum(common < width - distance)
            by = np.lexsort((extended[live], node[live]))  # stable: earlier places first
            group = X.group_ids(by, node[live], extended[live])
            first = live[by[np.flatnonzero(np.diff(group, prepend=-1))]][group]
            later = live[by]
            m = later != first
            found.append(np.stack([later[m], np.full(m.sum(), distance), first[m]], axis=1))
        if distance < reach:
            with np.errstate(over="ignore"):
                extended = mix(extended * U64(0x9E3779B97F4A7C15) + left[:, distance])
    later, distance, first = np.concatenate(found).T
    return later, distance, first


def _islands(doc, start, source_doc, source_start) -> tuple[np.ndarray, np.ndarray]:
    """First rows, and lengths, of runs in which both sides step on by one word; rows are in order of doc, start."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (source_doc[1:] != source_doc[:-1]) | (start[1:] != start[:-1] + 1) | (source_start[1:] != source_start[:-1] + 1)
    lo = np.flatnonzero(new)
    return lo, np.diff(np.append(lo, len(doc)))


def passages(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, part_bytes: int = X.PART_BYTES, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row for each repeated passage: key, first_word, end_word (exclusive), source_<key>, source_first_word.

    Every run of `width` words whose words also start earlier (smaller key, or earlier in the document) lies in a
    passage of its document, and each passage's words stand in its source, which is earlier, one for one. Documents
    without repetitions have no rows. A null text has no words; a null key counts as the smallest; repeated rows repeat
    one another; an empty table gives no rows; other columns don't matter. A long text is one part, of about 100 bytes a
    word; `width` - `seed` is at most 62.
    """
    parts = X.ranged_parts(frame, key, text, part_bytes)
    groups = max(16, parts.size // (6 * group_words))
    fine = X.per_bucket(groups)
    source = f"source_{key}"
    kind = frame.schema[key].dataType
    columns = 3 + 2 * width - seed
    rows = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("first_word long, n long"), T.StructField("source", kind), *T._parse_datatype_string("source_first_word long, bucket long, part long, list binary")])
    integer = pa.int64() if isinstance(kind, T.LongType) else pa.int32()

    def out(keys, start, source_keys, source_start, sent: pa.Table | None = None) -> pa.Table:
        """Windows of later suffixes as passages, and lists to be sent on."""
        by = np.lexsort((start, source_start - start, source_keys, keys))
        keys, start, source_keys, source_start = keys[by], start[by], source_keys[by], source_start[by]
        lo, n = _islands(keys, start, source_keys, source_start)
        ids = lambda x: pa.array(np.where(x[lo] == X.NONE, 0, x[lo]), integer, mask=x[lo] == X.NONE)
        more = len(sent) if sent is not None else 0
        columns = [ids(keys), pa.array(start[lo]), pa.array(n), ids(source_keys), pa.array(source_start[lo])]
        columns = [pa.concat_arrays([c, pa.nulls(more, c.type)]) for c in columns]
        lists = [pa.concat_arrays([pa.nulls(len(lo), t), *([sent[name].combine_chunks()] if more else [])]) for name, t in (("bucket", pa.int64()), ("part", pa.int64()), ("list", pa.binary()))]
        return pa.table([*columns, *lists], names=[f.name for f in rows])

    def passages_of(grid: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        later, distance, first = found
        doc, place = grid[:, 1].view(np.int64), grid[:, 2].view(np.int64)
        return doc[later], place[later] - distance, doc[first], place[first] - distance

    def ask_seeds(_: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own, group, _ = Sparse(X.Part(docs, key, text), width, seed).seeds(groups)
        return group, X.fingerprints(own)

    def seed_shared(own: Sparse, got: pa.Table) -> np.ndarray:
        _, group, of = own.seeds(groups)
        return (by_seed.of(got, group, fine) > 0)[of] if len(of) else np.zeros(0, dtype=bool)

    def ask_sides(_: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = Sparse(X.Part(docs, key, text), width, seed)
        own.repeated()
        hashes, group, _, _ = own.sides(seed_shared(own, got), groups)
        return group, X.fingerprints(hashes)

    by_seed, by_side = X.shared("seed", ask_seeds), X.shared("side", ask_sides)

    def ask_suffixes(_: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that other parts may hold too."""
        own = Sparse(X.Part(docs, key, text), width, seed)
        own.repeated()
        _, group, of, (index, a, b, before, behind) = own.sides(seed_shared(own, got), groups)
        shared = (by_side.of(got, group, fine) > 0)[of] if len(of) else np.zeros(0, dtype=bool)
        left, right = np.zeros(len(index), dtype=bool), np.zeros(len(index), dtype=bool)
        left[a], right[b] = shared[: len(a)], shared[len(a) :]
        own.offsets[:] = 0
        own.offsets[index] = np.where(left, before, U64(0)) | np.where(right, behind, U64(0))
        sent = np.flatnonzero(own.offsets)
        group = X.bucket_of(own.hash[sent], groups)
        order = np.argsort(group, kind="stable")
        return group[order], own.rows(sent[order]).astype("<u8").view(np.uint8).reshape(-1, 8 * columns)

    @lean
    def within(key_, docs, got):
        """Passages that the part itself holds earlier."""
        own = Sparse(X.Part(docs, key, text), width, seed)
        found = own.repeated()
        return out(*passages_of(own.head(np.arange(len(own.place))), found))

    def meeting(table: pa.Table, lead: int, last: bool, bucket: int, block: int) -> pa.Table:
        """Compares the suffixes of a group, or of a bucket's groups from one block of parts, and sends on what is first of its kind."""
        _, records, sender, _ = X.gathered(table, 8 * columns + lead)
        group = X.unpack(records[:, :lead]).astype(np.int64) if lead else np.zeros(len(records), dtype=np.int64)
        grid = np.ascontiguousarray(records[:, lead:]).view("<u8").astype(U64)
        order = np.lexsort((sender, grid[:, 1].view(np.int64)))  # stable: by key, part, place
        grid, group = grid[order], group[order]
        found = compare(grid, width, seed)
        if last:
            return out(*passages_of(grid, found))
        np.bitwise_and.at(grid[:, 0], found[0], ~(U64(1) << found[1].astype(U64)))
        left = np.flatnonzero(grid[:, 0])
        left = left[np.argsort(group[left], kind="stable")]
        sent = X.lists(block, bucket * fine + group[left], grid[left].astype("<u8").view(np.uint8).reshape(-1, 8 * columns))
        return out(*passages_of(grid, found), sent)

    @lean
    def comparing(key_, table):
        return meeting(table, 0, True, 0, 0)

    @lean
    def passing(key_, table):
        return meeting(table, 2 if fine > 1 else 0, False, key_[0].as_py(), key_[1].as_py())

    seeds = X.ask(parts, X.no_replies(frame), by_seed, groups)
    messages = seeds.unionByName(X.ask(parts, seeds, by_side, groups))
    windows = parts.frame.groupBy("part").cogroup(X.no_replies(frame).groupBy("part")).applyInArrow(within, rows)
    lists = X.sent_lists(parts, messages, ask_suffixes, groups)
    if parts.n > X.FAN or fine > 1:
        passed = cut(lists.withColumn("block", F.floor(F.col("part") / X.FAN)).groupBy("bucket", "block").applyInArrow(passing, rows))
        windows, lists = windows.union(passed.where("list is null")), passed.where("list is not null").select("bucket", "part", "list")
    windows = windows.union(lists.groupBy("bucket").applyInArrow(comparing, rows))
    joined = windows.select("key", "first_word", "n", "source", "source_first_word").withColumn("step", F.col("first_word") - F.col("source_first_word"))
    by = Window.partitionBy("key", "source", "step").orderBy("first_word")
    joined = joined.withColumn("new", (F.lag(F.col("first_word") + F.col("n"), 1, -1).over(by) < F.col("first_word")).cast("int")).withColumn("run", F.sum("new").over(by))
    return (
        joined.groupBy("key", "source", "step", "run")
        .agg(F.min("first_word").alias("first_word"), F.max(F.col("first_word") + F.col("n")).alias("end"))
        .select(F.col("key").alias(key), "first_word", (F.col("end") + width - 1).alias("end_word"), F.col("source").alias(source), (F.col("first_word") - F.col("step")).alias("source_first_word"))
    )
