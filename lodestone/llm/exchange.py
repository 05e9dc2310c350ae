"""Packed exchange of fingerprints between parts of a corpus and groups of equal fingerprints.

Documents are dealt into parts of a few MB of text. Every part sends each group one packed list of records (a few bytes
each, instead of a row each), with its own repetitions summed up beforehand, so that however often something occurs, a
group gets it at most once from each part. A group answers each list with a packed list of the same order. Both sides
derive the order of a list from the part's contents alone, so a task that is run anew sends the same.

Where there are more than FAN parts, lists would shrink to single records, and what occurs in every part would fill a
group. There records travel in two steps: lists go to a bucket of many groups and a block of FAN parts, which merges
equal records of its parts and sends what is left on to the groups; answers come back the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import cut
from lodestone.llm.words import U64, Words, buffers, lean, mix, slices

PART_BYTES = 4 << 20
#: Ranges of keys whose edges every task gets, at most; and by how many times a range may outgrow a part before it is split.
RANGES, OUTGROWN = 1 << 16, 4
#: Lists that a part sends, and parts that send lists to a group, at most.
FAN = 1 << 14
#: Stands for a null key, before all others.
NONE = -(1 << 63)
LISTS = "bucket long, part long, list binary"
REPLIES = "part long, kind string, bucket long, reply binary"
_REPLY_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("reply", pa.binary())])
_LIST_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("list", pa.binary())])


@dataclass
class Parts:
    """Rows (part, key, text); how many parts there are; bytes of text; and whether the order of parts isn't that of keys alone."""

    frame: DataFrame
    n: int
    size: int
    mixed: bool


def ranged_parts(frame: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> Parts:
    """Parts that are ranges of the key, in rising order; null keys come first.

    Quantiles of the key cut it into at most RANGES ranges, so that tasks get a bounded list of edges. A range whose texts
    have outgrown a part, for whatever reason (a huge corpus, long texts, one key with many rows, null keys), is split
    into parts by rows; then records carry their keys, and the dealt rows are written to the shared folder once, so that
    each row stays in its part.
    """
    at = F.coalesce(F.col(key).cast("long"), F.lit(NONE))
    sizes = cut(frame.select(at.alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n")))
    got = sizes.agg(F.sum("n").alias("n"), F.min(F.when(F.col("k") != NONE, F.col("k"))).alias("lo"), F.max("k").alias("hi")).first()
    size = got["n"] or 0
    ranges = min(max(1, -(-size // part_bytes)), RANGES)
    edges = np.array([NONE], dtype=np.int64)  # a range ends with its edge
    if got["lo"] is not None:
        cuts = sizes.where(F.col("k") != NONE).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], min(20 * ranges, 1_000_000)).alias("e")).first()["e"] if ranges > 1 else []
        edges = np.unique(np.array([NONE, *cuts, got["hi"]], dtype=np.int64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(r, len(edges) - 1)), batch.column(1)], names=["r", "n"])

    within = np.ones(len(edges), dtype=np.int64)
    if len(edges) > 1 or size > part_bytes:
        held = sizes.mapInArrow(find, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()  # one row for each range
        for row in held:
            if row["n"] > OUTGROWN * part_bytes:
                within[row["r"]] = -(-row["n"] // part_bytes)
    mixed = bool((within > 1).any())
    base = np.cumsum(within) - within
    own = frame.select(F.col(key), F.col(text), at.alias("k"), (F.xxhash64(F.monotonically_increasing_id()) if mixed else F.lit(0).cast("long")).alias("salt")).toDF("key", "text", "k", "salt")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.minimum(np.searchsorted(edges, batch.column(2).to_numpy(zero_copy_only=False), side="left"), len(edges) - 1)
            part = base[r] + (batch.column(3).to_numpy(zero_copy_only=False).view(U64) % within[r].astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch.column(0), batch.column(1)], names=["part", key, text])

    dealt = own.mapInArrow(deal, T.StructType([T.StructField("part", T.LongType()), frame.schema[key], frame.schema[text]]))
    return Parts(cut(dealt) if mixed else dealt, int(within.sum()), size, mixed)


class Part:
    """The documents of one part in order of key, then text: word counts, and hashes of all words in a row."""

    def __init__(self, table: pa.Table, key: str, text: str, lower: bool = False):
        order = sorted(range(len(table)), key=lambda i: (ids[i] is not None, ids[i] or 0)) if (ids := table[key].to_pylist()) else []
        if len(set(ids)) < len(ids):  # equal keys: by text, so that the order doesn't depend on how rows came
            texts = table[text].to_pylist()
            order = sorted(order, key=lambda i: (ids[i] is not None, ids[i] or 0, (texts[i] or "").encode()))
        self.table = table.take(pa.array(order, pa.int64())) if order else table
        self.keys = self.table[key].combine_chunks() if len(table) else pa.array([], table.schema.field(key).type)
        column = pa.chunked_array([self.table[text].cast(pa.large_string()).combine_chunks()], pa.large_string()) if len(table) else self.table[text]
        self.data, offsets = buffers(column)
        counts, hashes, starts, ends = [], [], [], []
        for lo, hi in slices(offsets):
            base = offsets[lo]
            w = Words(self.data[base : offsets[hi]], offsets[lo : hi + 1] - base, lower)
            counts.append(np.diff(w.first))
            hashes.append(w.hash)
            starts.append(w.start + base)
            ends.append(w.end + base)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
        self.count = join(counts, np.int64)
        self.hash = join(hashes, U64)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def ids(self) -> np.ndarray:
        """Keys as numbers, NONE for null."""
        return self.keys.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)

    def windows(self, width: int) -> np.ndarray:
        """First words of all windows of width words within a document."""
        n = len(self.doc)
        at = np.arange(max(0, n - width + 1))
        return at[self.doc[at] == self.doc[at + width - 1]] if len(at) else at


def pack(values: np.ndarray, size: int = 6) -> np.ndarray:
    """The low bytes of 64-bit values, in rows."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def unpack(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel().astype(U64)


def lists(part: int, bucket: np.ndarray, records: np.ndarray) -> pa.Table:
    """One row for each run of equal buckets, with its records; both are in order of bucket."""
    edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, dtype=int)
    own = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    records = np.ascontiguousarray(records)
    return pa.table([pa.array(bucket[edges[:-1]], pa.int64()), pa.array([part] * len(own), pa.int64()), pa.array([records[a:b].tobytes() for a, b in own], pa.binary())], schema=_LIST_ARROW)


def gathered(table: pa.Table, width: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Senders in order, the records of all their lists, each record's sender, and where each list begins and ends."""
    rows = sorted(zip(table["part"].to_pylist(), table["list"].to_pylist(), strict=True))
    sizes = np.array([len(x) // width for _, x in rows], dtype=np.int64)
    records = np.frombuffer(b"".join(x for _, x in rows), dtype=np.uint8).reshape(-1, width)
    senders = [p for p, _ in rows]
    return senders, records, np.repeat(np.array(senders, dtype=np.int64), sizes), np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Question:
    """What parts ask groups.

    send(part, documents, answers so far) gives groups, in order, and records in rows of `width` bytes; answer(records,
    senders) gives each record's value, of `reply` bytes, or of one bit where that is 0; merge(records, senders) gives, of
    equal records, the one to send on: merged records, the index among them of each record, and of each merged record the
    index of the one that it stands for. Where only that one may have the group's answer, the others have the value `rest`.
    """

    kind: str
    width: int
    send: Callable[[int, pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]]
    answer: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    reply: int = 0
    rest: int | None = None

    def packed(self, values: np.ndarray) -> bytes:
        return values.astype(f"<u{self.reply}").tobytes() if self.reply else np.packbits(values.astype(bool)).tobytes()

    def unpacked(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, dtype=f"<u{self.reply}") if self.reply else np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n)

    def of(self, got: pa.Table, groups: np.ndarray, fine: int) -> np.ndarray:
        """The answers in the order of the records that were sent to the given groups, in order, of which a bucket has `fine`; 0 where none came."""
        bucket = groups // fine
        out = np.zeros(len(bucket), dtype=f"u{self.reply or 1}")
        table = got.filter(pa.compute.equal(got["kind"], self.kind)) if len(got) else got
        for b, data in zip(table["bucket"].to_pylist(), table["reply"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            out[lo:hi] = self.unpacked(data, hi - lo)
        return out


def per_bucket(groups: int) -> int:
    """Groups of a bucket."""
    return -(-groups // FAN)


def no_replies(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame([], REPLIES)


def sent_lists(parts: Parts, messages: DataFrame, send: Callable[[int, pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], groups: int) -> DataFrame:
    """What all parts send, by bucket; where a bucket has several groups, records begin with 2 bytes for the group within it."""
    fine = per_bucket(groups)

    @lean
    def sending(key, docs, got):
        group, records = send(key[0].as_py(), docs, got)
        if fine > 1:
            records = np.concatenate([pack((group % fine).astype(U64), 2), records], axis=1)
        return lists(key[0].as_py(), group // fine, records)

    return parts.frame.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(sending, LISTS)


def ask(parts: Parts, messages: DataFrame, q: Question, groups: int) -> DataFrame:
    """One round: every part sends lists, in the light of what it was answered before, and every group answers them."""
    fine = per_bucket(groups)
    lead = 2 if fine > 1 else 0

    def replies(senders: list[int], bucket: int, data: list[bytes]) -> pa.Table:
        n = len(senders)
        return pa.table([pa.array(senders, pa.int64()), pa.array([q.kind] * n, pa.string()), pa.array([bucket] * n, pa.int64()), pa.array(data, pa.binary())], schema=_REPLY_ARROW)

    @lean
    def answering(key, table):
        senders, records, sender, edges = gathered(table, q.width)
        values = q.answer(records, sender)
        return replies(senders, key[0].as_py(), [q.packed(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    sent = sent_lists(parts, messages, q.send, groups)
    if parts.n <= FAN and fine == 1:
        return sent.groupBy("bucket").applyInArrow(answering, REPLIES)
    sent = sent.withColumn("block", F.floor(F.col("part") / FAN))

    def merged(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Senders, edges of their lists, each record's merged one, the groups (in order) and bytes of merged ones, the records that they stand for."""
        senders, records, sender, edges = gathered(table, q.width + lead)
        group = unpack(records[:, :lead]).astype(np.int64) if lead else np.zeros(len(records), dtype=np.int64)
        of = np.zeros(len(records), dtype=np.int64)
        kept, owner, stand, n = [np.zeros((0, q.width), dtype=np.uint8)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        order = np.argsort(group, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            left, index, first = q.merge(records[some][:, lead:], sender[some])
            of[some] = index + n
            kept.append(left)
            owner.append(np.full(len(left), group[some[0]]))
            stand.append(some[first])
            n += len(left)
        return senders, edges, of, np.concatenate(owner), np.concatenate(kept), np.concatenate(stand)

    @lean
    def passing(key, table):
        _, _, _, owner, left, _ = merged(table)
        return lists(key[1].as_py(), key[0].as_py() * fine + owner, left)

    @lean
    def returning(key, table, answers):
        if not len(table):
            return replies([], 0, [])
        senders, edges, of, owner, left, stand = merged(table)
        back = np.zeros(len(left), dtype=f"u{q.reply or 1}")
        bucket = key[0].as_py()
        for g, data in zip(answers["bucket"].to_pylist(), answers["reply"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(owner, [g - bucket * fine, g - bucket * fine + 1])
            back[lo:hi] = q.unpacked(data, hi - lo)
        values = back[of]
        if q.rest is not None:
            other = np.ones(len(of), dtype=bool)
            other[stand] = False
            values[other] = q.rest
        return replies(senders, bucket, [q.packed(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    answered = sent.groupBy("bucket", "block").applyInArrow(passing, LISTS).groupBy("bucket").applyInArrow(answering, REPLIES)
    answered = answered.withColumn("home", F.floor(F.col("bucket") / fine))
    return sent.groupBy("bucket", "block").cogroup(answered.groupBy("home", "part")).applyInArrow(returning, REPLIES)


#: The bit of a five-byte fingerprint that says that it came more than once.
_OFTEN = U64(1 << 39)


def shared(kind: str, send: Callable) -> Question:
    """Which fingerprints, of 39 bits, came from more than one part; a part sends each of its own once."""

    def merge(records: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = unpack(records)
        own, first, of, many = np.unique(values & ~_OFTEN, return_index=True, return_inverse=True, return_counts=True)
        often = many > 1
        often[of[values >= _OFTEN]] = True
        return pack(np.where(often, own | _OFTEN, own), 5), of, first

    def answer(records: np.ndarray, senders: np.ndarray) -> np.ndarray:
        merged, of, _ = merge(records, senders)
        return (merged[:, 4] >> 7)[of]

    return Question(kind, 5, send, answer, merge)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Records of a question for shared fingerprints."""
    return pack(hashes & (_OFTEN - U64(1)), 5)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes ^ U64(0xA0761D6478BD642F)) % U64(n)).astype(np.int64)


def group_ids(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys along the order."""
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return np.cumsum(new)
