"""Operator 13: near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets.

A register holds the least of the exponentially distributed values that its hash gives the members of a set, as a power
of BASE, rounded down and truncated to 16 bits. Registers of a union are the maxima of its parts' registers, and two sets
agree in a register about as often as their Jaccard similarity says.

Equal sets are one class. Bands of registers are hashed to buckets; each task first ties its own
sets, so that a bucket gets a row or two from each block of HELD sets, however many share it. A bucket of two gives a pair: with the sizes of both
sets, which are known, the counts of larger, smaller and equal registers give the likelihood of each similarity, and a
pair whose likeliest similarity is SIGMAS standard errors below the threshold goes. Larger buckets tie their members to
the smallest one, as there a member may link to any other. What is tied makes families, within which all links are
confirmed on full sets, with the joins that operator 5 uses for its families (chunks, leaders, lists; no all pairs).

A pair at the very threshold shares no bucket with a probability of (1 - 0.8**4)**40 = 7e-10, and is dropped by its
estimate with one of 1e-9; pairs above it with less. Nothing is capped.

Contract: a null or empty text, or one without words, has size 0, its own key as component and is kept; rows with one key
count as one document; repeated rows are in one component; a null key joins the component of an equal set that has a key
(and is not kept), else its component is null (and it is kept); a long text is one unit of work, of some 60 bytes a word;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.graph import components
from lodestone.llm.set_join import _dealt, _links, _marks, shingle_sets
from lodestone.llm.store import cut
from lodestone.llm.words import U64, Words, buffers, give_back, mix, slices

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Rate of the exponential values, base of the registers' scale, and the largest register.
RATE, BASE, TOP = 20.0, 1.001, (1 << 16) - 1
SIGMAS = 6
#: Sets of which a task ties those that share a band before it sends anything.
HELD = 50_000
_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_ODD = mix(_SALTS ^ U64(0x5851F42D4C957F2D)) | U64(1)


def sketch(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (one row a set) of sets of 64-bit hashes in a row; an empty set has none set."""
    out = np.zeros((len(sizes), REGISTERS), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    heads = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            x = (sets ^ _SALTS[i]) * _ODD[i]
            x ^= x >> U64(32)
            x *= U64(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(x, heads)
            value = -np.log1p(-((least >> U64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of unions."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The similarities that registers of pairs of sets of known sizes make likeliest, by ternary search; the likelihood has one top."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)  # noqa: E731  of registers that only the one set decides

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(u - v * j), share(v - u * j)
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0)
        return log(more, p) + log(less, q) + log(same, 1 - p - q)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def least_estimate(percent: int) -> float:
    """Below this a pair of at least the given similarity is not estimated, but for SIGMAS standard errors."""
    j = percent / 100
    return j - SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5


def describe(frame: DataFrame, key: str, text: str, width: int = SHINGLE) -> DataFrame:
    """(key, salt, n, x, y, registers): a hash of each row's key and text, its set's size, 128 bits that stand for the set, its registers as 16-bit numbers."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("salt long, n long, x long, y long, registers binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                w = Words(data[base : offsets[hi]], offsets[lo : hi + 1] - base, lower=True)
                own, sizes = shingle_sets(w.hash, np.diff(w.first), width)
                x, y = _marks(own, sizes)
                registers = sketch(own, sizes).astype("<u2")
                arrays = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(x), pa.array(y), pa.array([r.tobytes() for r in registers], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "salt", "n", "x", "y", "registers"])
        give_back()

    return frame.select(key, F.xxhash64(key, text).alias("salt"), text).mapInArrow(run, schema)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _bands(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each row's registers."""
    own = registers.reshape(-1, BANDS, ROWS).astype(U64)
    with np.errstate(over="ignore"):
        return mix((own[:, :, 0] | own[:, :, 1] << U64(16) | own[:, :, 2] << U64(32) | own[:, :, 3] << U64(48)) ^ _SALTS[:BANDS]).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, a, b, c): of up to HELD sets at a time, the c that share a band, the smallest, and one more; beyond two, ties (band null) of the others to the smallest."""
    names = ["band", "a", "b", "c"]

    def combined(ids: np.ndarray, bands: np.ndarray) -> pa.RecordBatch:
        band, id_ = bands.ravel(), np.repeat(ids, BANDS)
        order = np.lexsort((id_, band))
        band, id_ = band[order], id_[order]
        heads = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        count = np.diff(np.concatenate((heads, [len(band)])))
        second = np.where(count > 1, id_[np.minimum(heads + 1, len(id_) - 1)], id_[heads])
        rest = np.arange(len(band)) - np.repeat(heads, count) > 0
        rest &= np.repeat(count > 2, count)
        pairs = np.unique(np.stack([np.repeat(id_[heads], count)[rest], id_[rest]], axis=1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        columns = [(band[heads], none), (id_[heads], pairs[:, 0]), (second, pairs[:, 1]), (count, np.zeros(len(pairs), dtype=np.int64))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()), y if isinstance(y, pa.Array) else pa.array(y, pa.int64())]) for x, y in columns], names=names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), _bands(_registers(batch.column(1)))))
            n += batch.num_rows
        if n >= HELD:
            yield combined(np.concatenate([i for i, _ in held]), np.concatenate([b for _, b in held]))
            held, n = [], 0
    if n:
        yield combined(np.concatenate([i for i, _ in held]), np.concatenate([b for _, b in held]))
    give_back()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, pair) of sorted buckets as they stream by: ties to a bucket's first set, or the one pair of a bucket of two."""
    last = None  # band, first set, how many sets, the last tie: held back until the bucket has ended or grown
    out: list[tuple[int, int, bool]] = []

    def close() -> None:
        if last and last[2] == 2 and last[3] is not None:
            out.append((last[1], last[3], True))

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "pair"])
        out.clear()
        return made

    for batch in batches:
        band, a, b, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        same = np.concatenate(([last is not None and last[0] == band[0]], band[1:] == band[:-1])) if len(band) else np.zeros(0, dtype=bool)
        busy = same | (c > 1)
        busy[:-1] |= same[1:]
        busy[-1:] = True  # may go on in the next batch
        for x, p, q, n in zip(band[busy].tolist(), a[busy].tolist(), b[busy].tolist(), c[busy].tolist(), strict=True):
            if last is None or last[0] != x:
                close()
                last = [x, p, 0, None]
            mine = [y for y in dict.fromkeys((p, q)) if y != last[1]]
            last[2] += n
            if last[2] > 2:
                out += [(min(last[1], y), max(last[1], y), False) for y in ([last[3]] if last[3] is not None else []) + mine]
                last[3] = None
            elif mine:
                last[3] = mine[0]
        if len(out) >= 1000:
            yield flush()
    close()
    out[:] = [(min(x, y), max(x, y), z) for x, y, z in out]
    yield flush()


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
                keep = likeliest(_registers(batch.column(4)), _registers(batch.column(5)), *size) >= least_estimate(percent)
                batch = batch.filter(pa.array(keep))
            yield batch.select([0, 1])

    return run


def ties(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of classes (id, n, registers) that may be in one family."""
    bands = cut(classes.select("id", "registers").mapInArrow(_banded, "band long, a long, b long, c long"))
    met = cut(bands.where("band is not null").repartition("band").sortWithinPartitions("band", "a").mapInArrow(_met, "a long, b long, pair boolean").distinct())
    large = met.where("NOT pair").select("a", "b").union(bands.where("band is null").select("a", "b"))
    pairs = met.where("pair").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = classes.select("id", "n", "registers")
    both = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    fits = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return large.union(fits.mapInArrow(_likely(percent), "a long, b long"))


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                w = Words(data[base : offsets[hi]], offsets[lo : hi + 1] - base, lower=True)
                own, sizes = shingle_sets(w.hash, np.diff(w.first), width)
                ends = np.cumsum(sizes)
                packed = [own[b - n : b].astype("<u8").tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes.astype(np.int32), pa.int32()), pa.array(packed, pa.binary())], names=["id", "n", "data"])
        give_back()

    return run


def near_duplicates(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key that links reach), kept (whether it is that one)."""
    own = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    described = cut(describe(own, "key", "text", width))
    classes = described.where("n > 0").groupBy("n", "x", "y").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "salt"))).alias("rep"), F.first("registers").alias("registers"))
    classes = cut(classes.withColumn("id", F.col("rep.key").cast("long")))
    families = components(ties(classes.where("id is not null").select("id", "n", "registers"), percent))
    members = classes.select("id", F.col("rep.salt").alias("salt")).join(families.select("id"), "id", "left_semi").distinct()
    texts = _dealt(own, "key", "text", 1).withColumn("salt", F.xxhash64("key", "text")).withColumn("id", F.col("key").cast("long"))
    sets = cut(texts.join(members, ["id", "salt"]).select("id", "text").mapInArrow(_full_sets(width), "id long, n int, data binary"))
    linked = components(_links(sets, families, percent, ordered=False))
    labels = classes.join(linked, "id", "left").select("n", "x", "y", F.coalesce("component", "id").alias("component"))
    reached = described.drop("registers").join(labels, ["n", "x", "y"], "left")
    component = F.coalesce("component", F.col("key").cast("long"))
    return reached.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key").cast("long") == component, component.isNull()).alias("kept"))
