"""Operator 4: media columns in FLAC. Bytes are 8-bit mono samples; blocks hold Rice-coded residuals of fixed or linear predictors.

Many frames are worked on side by side: numpy steps through the samples of a block, and each step serves every frame of
the batch, so both directions run at a few array operations per sample. Frames carry their CRC-8 and CRC-16, files a
STREAMINFO block (with MD5) and a SEEKTABLE with one point per frame; decoding starts at any point, checks every
checksum, and raises ValueError on damage.

Contract: a null or empty text is one padded payload of 64 zero bytes; equal texts give equal values; other columns do
not matter; an empty table gives an empty result. Long texts are coded and decoded some thousand frames at a time; whole
are held only their bytes and those of their files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.words import buffers, give_back, slices

BLOCK, RATE, PAD = 1024, 8000, 64
ORDER, PRECISION = 4, 10
#: Frames that are worked on side by side; long files take several passes.
PIECE = 3072
#: Fixed values of the format: coefficients of the fixed predictors by order, the newest sample first.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], dtype=np.int64)


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out & (1 << (bits - 1)), (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many byte ranges, in step; the longest ranges come first so that each step takes a shrinking head."""
    table = CRC8 if bits == 8 else CRC16
    order = np.argsort(-size, kind="stable")
    at, left = start[order].copy(), size[order]
    crc = np.zeros(len(at), dtype=np.uint32)
    live = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")
    for n in live:
        head = crc[:n]
        crc[:n] = ((head << 8) & 0xFFFF if bits == 16 else 0) ^ table[(head >> (bits - 8)) ^ data[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _linear(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each row of samples by Levinson's recursion: coefficients and shift."""
    y = x.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", y[:, lag:], y[:, : y.shape[1] - lag]) for lag in range(ORDER + 1)], axis=1).astype(np.float64)
    error = auto[:, 0] + 1e-3
    coef = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = auto[:, i + 1] - sum(coef[:, j] * auto[:, i - j] for j in range(i))
        k = k / error
        new = coef.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = coef[:, j] - k * coef[:, i - 1 - j]
        coef, error = new, np.maximum(error * (1 - k * k), 1e-3)
    largest = np.abs(coef).max(axis=1, initial=0)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(largest, 1e-6))).astype(int), 0, 15)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -top - 1, top).astype(np.int64), shift


def _residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    guess = np.zeros(x.shape, dtype=np.int32)
    c = coef.astype(np.int32)
    for i in range(ORDER):
        if c[:, i].any():
            guess[:, i + 1 :] += c[:, i : i + 1] * x[:, : -i - 1]
    return x - (guess >> shift[:, None].astype(np.int32))


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 form: bytes in a row of 4, and how many."""
    size = np.select([n < 0x80, n < 0x800, n < 0x10000], [1, 2, 3], 4)
    out = np.zeros((len(n), 4), dtype=np.uint8)
    for s, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        m = size == s
        for j in range(s):
            part = n[m] >> (6 * (s - 1 - j))
            out[m, j] = (lead | part) if j == 0 else (0x80 | (part & 63))
    return out, size


class _Bits:
    """Bytes being put together from bit fields that do not overlap."""

    def __init__(self, n: int):
        self.bytes = np.zeros(n + 3, dtype=np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width) -> None:
        """Fields of at most 16 bits at the bits at, which rise."""
        if not len(at):
            return
        at = at.astype(np.int32)
        shifted = value.astype(np.int32) << (24 - (at & 7) - width).astype(np.int32)
        byte = at >> 3
        if len(at) * 4 > len(self.bytes):  # nearly every byte: no need to look for which
            total = np.bincount(byte, weights=shifted, minlength=len(self.bytes)).astype(np.int32)
            self.bytes += (total >> 16).astype(np.uint8)
            self.bytes[1:] += (total[:-1] >> 8).astype(np.uint8)
            self.bytes[2:] += total[:-2].astype(np.uint8)
            return
        heads = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        places = byte[heads]
        total = np.add.reduceat(shifted, heads)  # fields don't overlap, so sums are unions
        for j in range(3):
            self.bytes[places + j] += ((total >> (16 - 8 * j)) & 255).astype(np.uint8)


def encode(data: np.ndarray, first: np.ndarray, fixed: tuple[int, ...] = (0,), linear: bool = True) -> list[bytes]:
    """A FLAC file for each payload data[first[i]:first[i+1]]; payload sizes are positive multiples of 64.

    Of the fixed predictors named and the linear one, each frame takes that with the smallest residuals.
    """
    length = np.diff(first)
    frames = -(-length // BLOCK)
    owner = np.repeat(np.arange(len(length)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    size = np.minimum(BLOCK, length[owner] - number * BLOCK)
    at = first[owner] + number * BLOCK
    raw, frame_bytes = [], []
    for f in range(0, len(owner), PIECE):
        some = slice(f, f + PIECE)
        own, many = _frames(data, at[some], number[some], size[some], fixed, linear)
        raw.append(own.tobytes())
        frame_bytes.append(many)
    raw, frame_bytes = b"".join(raw), np.concatenate(frame_bytes) if frame_bytes else np.zeros(0, dtype=np.int64)
    start = np.cumsum(frame_bytes) - frame_bytes
    files, f = [], 0
    for i in range(len(length)):
        g = f + int(frames[i])
        lo, hi = int(start[f]), int(start[g - 1] + frame_bytes[g - 1])
        signed = data[first[i] : first[i + 1]] ^ np.uint8(128)
        info = b"".join((BLOCK.to_bytes(2), BLOCK.to_bytes(2), int(frame_bytes[f:g].min()).to_bytes(3), int(frame_bytes[f:g].max()).to_bytes(3), (RATE << 44 | 7 << 36 | int(length[i])).to_bytes(8), hashlib.md5(signed).digest()))
        points = np.zeros((g - f, 18), dtype=np.uint8)
        points[:, 0:8] = (number[f:g] * BLOCK).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 8:16] = (start[f:g] - lo).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 16:18] = size[f:g].astype(">u2").view(np.uint8).reshape(-1, 2)
        files.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + points.size.to_bytes(3) + points.tobytes() + raw[lo:hi])
        f = g
    return files


def _frames(data: np.ndarray, at: np.ndarray, number: np.ndarray, size: np.ndarray, fixed: tuple[int, ...], linear: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some frames in a row, and how many each has; a frame holds the samples data[at:at+size]."""
    n = len(at)
    col = np.arange(BLOCK)
    inside = col < size[:, None]
    x = np.where(inside, data[np.minimum(at[:, None] + col, len(data) - 1)].astype(np.int32) - 128, 0)
    best = kind = coef = shift = res = None
    options = [(o, np.repeat(FIXED[o : o + 1], n, 0), np.zeros(n, dtype=np.int64)) for o in fixed] + ([(ORDER, *_linear(x, size))] if linear else [])
    for k, (order, c, s) in enumerate(options):
        r = _residual(x, c, s)
        cost = (np.abs(r) * (inside & (col >= order))).sum(axis=1)
        if best is None:
            best, kind, coef, shift, res = cost, np.zeros(n, dtype=np.int64), c.copy(), s.copy(), r.copy()
        else:
            better = cost < best
            best[better], kind[better], coef[better], shift[better], res[better] = cost[better], k, c[better], s[better], r[better]
    order = np.array([o for o, _, _ in options])[kind]
    lpc = kind == (len(fixed) if linear else -1)
    part = size // 4
    row = np.arange(n)
    use = inside & (col >= order[:, None])
    folded = ((res << 1) ^ (res >> 31)) * use
    sums = np.cumsum(folded, axis=1, dtype=np.int32)
    marks = np.stack([sums[row, g * part - 1] for g in (1, 2, 3, 4)], axis=1)
    mean = np.diff(marks, axis=1, prepend=0) / np.maximum(1, part[:, None] - (order[:, None] * (np.arange(4) == 0)))
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int32), 2, 14)
    peak = folded.max(axis=1)
    rice = np.where(((peak[:, None] >> rice) + 1 + rice) > 40, np.maximum(rice, np.ceil(np.log2(np.maximum(peak, 1) / 20)).astype(np.int32)[:, None]), rice)
    group = (col >= part[:, None]).astype(np.int8)
    group += col >= 2 * part[:, None]
    group += col >= 3 * part[:, None]
    k = np.take_along_axis(rice, group, axis=1)
    opens = np.zeros((n, BLOCK), dtype=bool)
    opens[row, order] = True
    for g in (1, 2, 3):
        opens[row, g * part] = True
    width = ((folded >> k) + 1 + k) * use + 4 * opens
    number_bytes, number_size = _utf8_number(number)
    head = 4 + number_size + 2 + 1  # 16-bit block size always
    fixed_bits = 8 + 8 * order + np.where(lpc, 9 + PRECISION * ORDER, 0) + 6
    body = fixed_bits + width.sum(axis=1)
    frame_bytes = head + -(-body // 8) + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    out = _Bits(int(frame_bytes.sum()))
    bit = (start + head) * 8
    out.put(bit, np.where(lpc, (32 | (ORDER - 1)) << 1, (8 | order) << 1), 8)
    bit = bit + 8
    for j in range(ORDER):
        m = order > j
        out.put(bit[m], x[m, j] & 255, 8)
        bit = bit + 8 * m
    if lpc.any():
        b = bit[lpc]
        out.put(b, np.full(len(b), PRECISION - 1), 4)
        out.put(b + 4, shift[lpc], 5)
        for j in range(ORDER):
            out.put(b + 9 + PRECISION * j, coef[lpc, j] & ((1 << PRECISION) - 1), PRECISION)
        bit = bit + lpc * (9 + PRECISION * ORDER)
    out.put(bit, np.full(n, 2), 6)  # 4-bit parameters, 4 partitions
    bit = bit + 6
    ends = (np.cumsum(width, axis=1, dtype=np.int32) + bit[:, None])[use]
    value, kk = folded[use], k[use]
    out.put(ends - kk - 1, (1 << kk) | (value & ((1 << kk) - 1)), kk + 1)
    o = opens[use]
    out.put(ends[o] - width[use][o], kk[o], 4)
    raw = out.bytes[:-3]
    raw[start], raw[start + 1] = 0xFF, 0xF8
    raw[start + 2] = 0x70  # block size follows in 16 bits; sample rate as in STREAMINFO
    raw[start + 3] = 0x02  # one channel, 8 bits
    for j in range(4):
        m = number_size > j
        raw[(start + 4 + j)[m]] = number_bytes[m, j]
    b = start + 4 + number_size
    raw[b], raw[b + 1] = (size - 1) >> 8, (size - 1) & 255
    raw[b + 2] = _crc(raw, start, head - 1, 8)
    tail = start + frame_bytes - 2
    crc = _crc(raw, start, frame_bytes - 2, 16)
    raw[tail], raw[tail + 1] = crc >> 8, crc & 255
    return raw, frame_bytes


def _metadata(file: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO fields, seek points (sample, byte offset, samples), and where frames begin."""
    if file[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info, points = 4, {}, np.zeros((0, 3), dtype=np.int64)
    while True:
        kind, n = file[at], int.from_bytes(file[at + 1 : at + 4])
        block = file[at + 4 : at + 4 + n]
        if kind & 127 == 0:
            packed = int.from_bytes(block[10:18])
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind & 127 == 3:
            p = np.frombuffer(block, dtype=np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            points = np.stack([p["s"].astype(np.int64), p["o"].astype(np.int64), p["n"].astype(np.int64)], axis=1)
        at += 4 + n
        if kind & 128:
            return info, points, at


def decode(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes read back, their bounds by file, and each file's seek points. Every frame's checksums, number and end, and every file's MD5 are verified."""
    parsed = [_metadata(x) for x in files]
    lengths = np.array([p[0]["samples"] for p in parsed], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer(b"".join([x[p[2] :] for x, p in zip(files, parsed, strict=True)]) + bytes(16), dtype=np.uint8)
    sizes = np.array([len(x) - p[2] for x, p in zip(files, parsed, strict=True)], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    counts = np.array([len(p[1]) for p in parsed], dtype=np.int64)
    points = np.concatenate([p[1] for p in parsed]) if parsed else np.zeros((0, 3), dtype=np.int64)
    start = np.repeat(base, counts) + points[:, 1]
    ends = np.append(start[1:], sizes.sum())
    if (ends <= start).any() or (np.repeat(np.cumsum(counts) - counts, counts) == np.arange(len(start)))[points[:, 1] != 0].any():
        raise ValueError("seek points don't rise")
    got = []
    for f in range(0, len(start), PIECE):
        lo, hi = int(start[f]), int(ends[min(f + PIECE, len(ends)) - 1])
        some = slice(f, f + PIECE)
        got.append(_samples(np.append(raw[lo:hi], np.zeros(16, dtype=np.uint8)), start[some] - lo, ends[some] - lo, points[some]))
    data = np.concatenate(got) if got else np.zeros(0, dtype=np.uint8)
    if len(data) != first[-1]:
        raise ValueError("the number of samples is wrong")
    for i, p in enumerate(parsed):
        if hashlib.md5(data[first[i] : first[i + 1]] ^ np.uint8(128)).digest() != p[0]["md5"]:
            raise ValueError("the samples' digest is wrong")
    return data, first, [p[1] for p in parsed]


def _samples(raw: np.ndarray, start: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The samples of frames that begin and end at the given bytes, in a row; 16 bytes follow the last."""
    if (raw[start] != 0xFF).any() or (raw[start + 1] != 0xF8).any() or (raw[start + 2] != 0x70).any() or (raw[start + 3] != 0x02).any():
        raise ValueError("no frame at a seek point")
    lead = raw[start + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, lead & 31, lead & 15], lead & 7).astype(np.int64)
    for j in range(1, 4):
        number = np.where(number_size > j, number << 6 | (raw[start + 4 + j] & 63), number)
    b = start + 4 + number_size
    size = (raw[b].astype(np.int64) << 8 | raw[b + 1]) + 1
    if (_crc(raw, start, b + 2 - start, 8) != raw[b + 2]).any() or (size != points[:, 2]).any() or (number * BLOCK != points[:, 0]).any():
        raise ValueError("a frame header is damaged")
    window = np.zeros(len(raw), dtype=np.uint64)  # at each byte, it and the seven that follow
    for j in range(8):
        window[: len(raw) - j] |= raw[j:].astype(np.uint64) << np.uint64(56 - 8 * j)

    def take(at: np.ndarray, width: int) -> np.ndarray:
        return ((window[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    rank = np.argsort(-size, kind="stable")  # the longest first: each step takes a head of the frames
    start, size = start[rank], size[rank]
    n = len(start)
    bit = (b[rank] + 3) * 8
    kind = take(bit, 8).astype(np.int64) >> 1
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    if ((order < 0) | (order > ORDER)).any():
        raise ValueError("a subframe of an unknown type")
    bit += 8
    steps = int(size.max())
    out = np.zeros((n, steps + ORDER), dtype=np.int32)  # sample j stands at column j + ORDER
    for j in range(ORDER):
        m = order > j
        got = take(bit[m], 8).astype(np.int32)
        out[m, j + ORDER] = got - 256 * (got > 127)
        bit += 8 * m
    coef, shift = FIXED[np.where(lpc, 0, order)].astype(np.int32), np.zeros(n, dtype=np.int32)
    if lpc.any():
        at = bit[lpc]
        precision = int(take(at, 4)[0]) + 1
        if (take(at, 4) + 1 != precision).any():
            raise ValueError("mixed precisions")
        shift[lpc] = take(at + 4, 5)
        at = at + 9
        for j in range(ORDER):
            got = take(at + precision * j, precision).astype(np.int32)
            coef[lpc, j] = got - (got >> (precision - 1) << precision)
        bit[lpc] = at + precision * order[lpc]
    if (take(bit, 6) != 2).any():
        raise ValueError("residuals of an unknown form")
    bit += 6
    part = size // 4
    k = np.zeros(n, dtype=np.int64)
    live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    edges = np.zeros((steps, n), dtype=bool)
    edges[order, np.arange(n)] = True
    for g in (1, 2, 3):
        edges[g * part, np.arange(n)] = True
    anywhere = edges.any(axis=1)
    history = [np.ascontiguousarray(coef[:, j]) for j in range(ORDER)]
    done = np.ascontiguousarray(out.T)  # by step
    seven, one64, eleven = np.int64(7), np.uint64(1), np.uint64(11)
    rest = (64 - k).astype(np.uint64)
    for j in range(steps):
        m = int(live[j])
        at = bit[:m]
        if anywhere[j]:
            e = edges[j, :m]
            k[:m][e] = take(at[e], 4)
            rest = (64 - k).astype(np.uint64)
            at = at + 4 * e
        kk = k[:m]
        w = window[at >> 3] << (at & seven).astype(np.uint64)
        zeros = 1075 - ((w >> eleven).astype(np.float64).view(np.int64) >> 52)  # the unary part; 53 bits are exact
        zeros = np.minimum(zeros, 63) if j < ORDER else zeros
        low = ((w << zeros.astype(np.uint64)) << one64) >> rest[:m]
        if j >= ORDER and int(zeros.max()) > 52:
            raise ValueError("a residual is too long")
        folded = (zeros << kk) | low.astype(np.int64) * (kk > 0)
        res = (folded >> 1) ^ -(folded & 1)
        guess = history[0][:m] * done[j + ORDER - 1, :m]
        for i in range(1, ORDER):
            guess += history[i][:m] * done[j + ORDER - 1 - i, :m]
        guess >>= shift[:m]
        value = res + guess
        if j < ORDER:
            ready = order[:m] <= j
            done[j + ORDER, :m] = np.where(ready, value, done[j + ORDER, :m])
            bit[:m] = np.where(ready, at + zeros + 1 + kk, bit[:m])
        else:
            done[j + ORDER, :m] = value
            at = at + zeros
            at += kk
            at += 1
            bit[:m] = at
    end = -(-bit // 8)
    crc = _crc(raw, start, end - start, 16)
    if (crc != (raw[end].astype(np.uint32) << 8 | raw[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    if (end + 2 != ends[rank]).any():
        raise ValueError("a frame doesn't end where the next begins")
    back = np.empty(n, dtype=np.int64)
    back[rank] = np.arange(n)
    grid = (done[ORDER:].T + 128).astype(np.uint8)[back]
    return grid[np.arange(steps) < size[back][:, None]]


def payloads(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of documents: from, to, padded bytes, their bounds, unpadded sizes."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets, 3 << 20):
        n = np.diff(offsets[lo : hi + 1])
        padded = np.maximum(PAD, -(-n // PAD) * PAD)
        first = np.concatenate(([0], np.cumsum(padded)))
        out = np.zeros(int(first[-1]), dtype=np.uint8)
        own = np.arange(int(n.sum())) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
        out[own] = data[offsets[lo] : offsets[hi]]
        yield lo, hi, out, first, n


def _stay(frame: DataFrame, new: T.StructType) -> list[str]:
    names = {x.name.lower() for x in new}
    return [x.name for x in frame.schema if x.name.lower() not in names]


def encode_column(frame: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replaces the text column by a FLAC file of its padded UTF-8 bytes; other columns stay."""
    new = T._parse_datatype_string(f"`{media}` binary")
    stay = [c for c in _stay(frame, new) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, first, _ in payloads(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), pa.array(encode(data, first), pa.binary())], names=[*stay, media])

    return frame.mapInArrow(run, T.StructType([*(frame.schema[c] for c in stay), *new]))


def blocks(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all frames of some files in a row: file, first sample, byte offset behind the metadata, samples; and the samples of all."""
    data, _, points = decode(files)
    owner = np.repeat(np.arange(len(files)), [len(p) for p in points])
    table = np.concatenate(points) if points else np.zeros((0, 3), dtype=np.int64)
    return owner, table[:, 0], table[:, 1], table[:, 2], data


def pcm_blocks(frame: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per frame of each file: key, block, first_sample, byte_offset (of the frame behind the metadata), pcm (unsigned samples). A null file has no rows."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("block int, first_sample long, byte_offset long, pcm binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for i in range(len(batch)):
                _, sample, offset, size, data = blocks([batch.column(1)[i].as_py()])
                for lo in range(0, len(sample), 4096):
                    some = slice(lo, lo + 4096)
                    pcm = [data[s : s + c].tobytes() for s, c in zip(sample[some].tolist(), size[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(pcm), batch.schema.field(0).type), pa.array(range(lo, lo + len(pcm)), pa.int32()), pa.array(sample[some], pa.int64()), pa.array(offset[some], pa.int64()), pa.array(pcm, pa.binary())], names=[key, "block", "first_sample", "byte_offset", "pcm"])

    return frame.select(key, media).mapInArrow(run, schema)


def digests(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each whole text as a FLAC file, reads it back as PCM blocks by sample offset, and describes both: see the query's contract."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, first, n in payloads(batch.column(text)):
                files = encode(data, first)
                owner, sample, _, many, back = blocks(files)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=many, minlength=len(files)).astype(np.int64))))
                frames = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(files)))))
                if (bounds[owner] + sample != np.cumsum(many) - many).any():
                    raise ValueError("blocks don't follow one another")
                signed = back.astype(np.int16) - 128
                total = np.add.reduceat(signed, bounds[:-1], dtype=np.int64)
                energy = np.add.reduceat(signed.astype(np.int32) ** 2, bounds[:-1], dtype=np.int64)
                turns = np.concatenate(([0], np.cumsum(np.concatenate(([False], (signed[1:] < 0) != (signed[:-1] < 0))))))
                rows: list[list] = [[] for _ in range(6)]
                for i, file in enumerate(files):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    own = back[a:b].tobytes()
                    for column, value in zip(rows, (b - a, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-PAD:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={frames[i + 1] - frames[i]};sum={total[i]};energy={energy[i]};crossings={turns[b] - turns[a + 1]}"), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4]), pa.array(rows[5])], schema=_arrow(schema, batch.schema.field(key).type))
        give_back()

    return frame.select(key, text).mapInArrow(run, schema)


def _arrow(schema: T.StructType, key: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(f.name, key if i == 0 else kinds[f.dataType.simpleString()]) for i, f in enumerate(schema)])
