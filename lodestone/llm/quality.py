"""Operator 10: a quality classifier of supervised subword embeddings.

Words, pairs of neighbouring words (all pairs of equal ones alike), and character runs of 3 to 5 within words (with one space at either side) are hashed
into buckets, each with a learned vector. A document is the mean of its features' vectors; a softmax layer scores the
two labels. Vectors and layer are learned together by stochastic gradient descent in numpy, on a bounded sample of the
labelled rows (the `sample` with the smallest hashes of their keys), whose whole texts are used. Scoring runs on the
executors over every whole text: what a bucket adds to the logits is a single number by then.

Contract: a null or empty text scores as a document without features, that is by the bias alone; equal texts get equal
scores; without labels, or with one label only, the bias decides; a null key counts as held out; other columns don't
matter; an empty table gives no rows. Long texts are scored in pieces, with sums carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.words import _SPACE, U64, WORD_BASE, Words, buffers, give_back, mix, slices, spans_hash

BUCKETS, DIMENSIONS = 1 << 17, 12
#: Rows to learn from, and bytes of the longest text among them.
SAMPLE, LONGEST = 3000, 1 << 16
EPOCHS, RATE = 5, 0.6
CUT = 0.3
#: Bytes of text that are scored at a time.
PIECE = 1 << 20


def _bucket(hashes: np.ndarray) -> np.ndarray:
    """Buckets but the first, which repeated words have to themselves."""
    return (hashes % U64(BUCKETS - 1)).astype(np.int64) + 1


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) arrays of all features of the texts data[bounds[i]:bounds[i+1]]."""
    with np.errstate(over="ignore"):
        words = Words(data, bounds)
        yield words.doc, _bucket(mix(words.hash))
        at = np.arange(max(0, len(words.doc) - 1))
        at = at[words.doc[at] == words.doc[at + 1]] if len(at) else at
        pair = _bucket(spans_hash(words.hash, at, at + 2, WORD_BASE))
        pair[words.hash[at] == words.hash[at + 1]] = 0  # a word twice in a row, whichever it is
        yield words.doc[at], pair
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(U64)
        starts = (data & 0xC0) != 0x80
        offsets = np.concatenate(([0], np.cumsum(starts)))[bounds]
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
        space = (points == 32) | ((points >= 9) & (points <= 13))
        points[space] = 32
        total = points * U64(0x9E3779B97F4A7C15)
        inner = np.zeros(len(points), dtype=bool)  # whether a space stands behind the first and before the last
        for n in range(2, 6):
            m = len(points) - n + 1
            if m <= 0:
                break
            total = (total[:m] ^ (total[:m] >> U64(29))) * U64(0xBF58476D1CE4E5B9) + points[n - 1 :]
            if n > 2:
                inner = inner[:m] | space[n - 2 : n - 2 + m]
                good = ~inner & (doc[:m] == doc[n - 1 :])
                yield doc[:m][good], _bucket(mix(total[good] + U64(n)))
            else:
                inner = inner[:m]


class Model:
    """Learned vectors, softmax layer and bias."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.vectors = rnd.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.layer = rnd.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
        bags = []
        for text in texts:
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            own = np.concatenate([b for _, b in features(data, np.array([0, len(data)]))])
            bucket, many = np.unique(own, return_counts=True)
            bags.append((bucket.astype(np.int32), (many / max(1, len(own))).astype(np.float32)))
        rnd = np.random.default_rng(seed)
        steps, step = max(1, epochs * len(bags)), 0
        scale = np.float32(40)  # vectors move by their share of the document, which is small
        for _ in range(epochs):
            for i in rnd.permutation(len(bags)):
                bucket, share = bags[i]
                now = np.float32(rate * (1 - step / steps))
                step += 1
                hidden = share @ self.vectors[bucket]
                logits = hidden @ self.layer + self.bias
                logits -= logits.max()
                p = np.exp(logits)
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.layer @ p
                self.layer -= now * np.outer(hidden, p)
                self.bias -= now * np.float32(0.05) * p
                self.vectors[bucket] -= (now * scale) * np.outer(share, back)
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the logits of labels 1 and 0, and the bias' part."""
        turn = (self.layer[:, 1] - self.layer[:, 0]).astype(np.float64)
        return (self.vectors @ turn).astype(np.float32), float(self.bias[1] - self.bias[0])


def held_out(key: str) -> Column:
    """Whether the remainder of crc32(key as text) by 5 is 0; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Learns from at most `sample` labelled rows that aren't held out, of texts of at most `longest` bytes: those whose keys have the smallest hashes. Their texts are the only ones that reach the driver."""
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("label")).orderBy(F.xxhash64(key), key).limit(sample)
    own = frame.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    joined = own.join(F.broadcast(known.select(F.col(key).alias("key"), "label")), "key")
    rows = joined.groupBy("key").agg(F.max("text").alias("text"), F.first("label").alias("label")).orderBy(F.xxhash64("key"), "key").collect()  # at most sample rows
    return Model().fit([r["text"] for r in rows], [int(r["label"]) for r in rows])


def _logits(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the features' weights, and numbers of features, of some texts."""
    n = len(bounds) - 1
    total, many = np.zeros(n), np.zeros(n)
    for doc, bucket in features(data, bounds):
        total += np.bincount(doc, weights=weights[bucket], minlength=n)
        many += np.bincount(doc, minlength=n)
    return total, many


def _long_logits(data: np.ndarray, weights: np.ndarray, limit: int) -> tuple[float, float]:
    """The same of one long text, a piece at a time. Each piece but the first begins with the last two words of the one before, and what these two have by themselves counts once."""
    total = many = 0.0
    at, again = 0, 0
    while at < len(data):
        spaces = np.flatnonzero(_SPACE[data[at + limit :]][: 1 << 16]) if at + limit < len(data) else np.zeros(0, dtype=np.int64)
        stop = at + limit + int(spaces[0]) + 1 if len(spaces) else min(len(data), at + limit + (1 << 16))
        piece = data[again:stop]
        t, m = _logits(piece, np.array([0, len(piece)]), weights)
        if again < at:
            shared = data[again:at]
            a, b = _logits(shared, np.array([0, len(shared)]), weights)
            t, m = t - a, m - b
        total, many = total + t[0], many + m[0]
        words = Words(piece, np.array([0, len(piece)]))
        again = stop - len(piece) + int(words.start[-2]) - 1 if len(words.start) > 2 and words.end[-1] < len(piece) else stop
        again, at = max(again, 0), stop
    return total, many


def _scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = buffers(texts)
    sums = [np.zeros((2, 0))]
    for lo, hi in slices(offsets, PIECE):
        own = data[offsets[lo] : offsets[hi]]
        sums.append(np.reshape(_long_logits(own, weights, PIECE), (2, 1)) if hi == lo + 1 and len(own) > 2 * PIECE else np.stack(_logits(own, offsets[lo : hi + 1] - offsets[lo], weights)))
    total, many = np.concatenate(sums, axis=1)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(many, 1) + bias, -500, 500)))


def score(frame: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """key, score, predicted."""
    weights, bias = model.weights()
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("score double, predicted int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _scores(batch.column(1), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64()), pa.array((own >= cut).astype(np.int32))], names=[key, "score", "predicted"])
        give_back()

    return frame.select(key, text).mapInArrow(run, schema)


def classify(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns, then scores every document: key, held_out, score, predicted."""
    model = train(frame, labels, key, text)
    return score(frame, model, key, text).select(key, held_out(key).alias("held_out"), "score", "predicted")


def keep_good(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows that aren't rejected, with all their columns, whatever their names."""
    weights, bias = train(frame, labels, key, text).weights()
    at = frame.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), weights, bias) >= cut))
        give_back()

    return frame.mapInArrow(run, frame.schema)
