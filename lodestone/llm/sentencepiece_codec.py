"""Operator 3: SentencePiece (merge type) encoding and decoding by a prefix table.

For every prefix of a text there is exactly one token that can end its encoding. The table holds that token: among the
vocabulary's entries that end at a position (found by an automaton over the text), it is the one that the table's token
before it may stand beside, that is, whose pair with it, merged from characters, gives just the pair. Ids are then
recovered backwards from the end. No merge loop runs over the text itself.

Text is first cut where no vocabulary entry can lie across (between two characters that no entry holds side by side);
each piece is encoded on its own and remembered in a bounded table of each worker.

Contract of every function: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated
rows get equal values; a row's other columns are carried unless an output has the same name, which then wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.words import give_back

SPACE = "▁"
#: Pieces and pairs that a worker remembers at most; beyond that it starts anew. Results do not depend on it.
MEMO_PIECES, MEMO_PAIRS = 150_000, 400_000
_BYTE = re.compile(r"^<0x([0-9A-F]{2})>$")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def load_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(text, score, type) of every piece, and whether a space is put before the text. Only plain models (identity normaliser) are read."""
    import struct

    pieces, dummy = [], True
    with open(path, "rb") as file:
        content = file.read()
    for number, value in _fields(content):
        if number == 1:
            got = dict(_fields(value))
            pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, 1)))
        elif number == 2:
            if dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a merge-type model")
        elif number == 3:
            got = dict(_fields(value))
            if got.get(2) or got.get(4, 1):
                raise ValueError("a model that normalises text or drops spaces isn't supported")
            dummy = bool(got.get(3, 1))
    return pieces, dummy


class Codec:
    """Encoder and decoder of one model file; text in, ids out, and back."""

    def __init__(self, path: str):
        pieces, self.dummy = load_model(path)
        self.texts = [x for x, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.byte_id = {int(m[1], 16): i for i, (x, _, k) in enumerate(pieces) if k == 6 and (m := _BYTE.match(x))}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == 2)
        self.normal = {x: i for i, (x, _, k) in enumerate(pieces) if k == 1}
        self.score = {x: s for x, s, k in pieces if k == 1}
        self.beside = {x[i : i + 2] for x in self.normal for i in range(len(x) - 1)}
        self.longest = max(map(len, self.normal))
        #: Of each token, whether it may stand behind others; n_pairs of them in all.
        self.behind: list[dict[str, bool]] = []
        self.n_pairs = 0
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        self.old_spaced: dict[str, tuple[int, ...]] = {}
        self.old_bare: dict[str, tuple[int, ...]] = {}
        self.letters = {c for x in self.normal for c in x}
        #: Whether no entry goes on with a space mark after another character, nor holds a line end.
        self.plain = all(x[0] == SPACE or x[1] != SPACE for x in self.beside) and "\n" not in self.letters
        self.surface = [x.replace(SPACE, " ") if k == 1 else " ⁇ " if k == 2 else chr(self.byte_of[i]) if i in self.byte_of else "" for i, (x, _, k) in enumerate(pieces)]
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x in self.normal:
            if self.merged(x) == [x]:  # others can never come out of merging
                self.behind.append({})
                self.automaton.add_word(x, (x, len(x), self.behind[-1]))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """What merging the best pair, leftmost first, makes of a short text: the definition that pairs are tested by."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str, behind: dict[str, bool]) -> bool:
        """Whether two tokens may stand side by side; remembered with the right one."""
        if self.n_pairs >= MEMO_PAIRS:
            for x in self.behind:
                x.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = behind[left] = left[-1] + right[0] not in self.beside or self.merged(left + right) == [left, right]
        return known

    def tokens(self, piece: str) -> list[str]:
        """Tokens of a piece by the prefix table; a character outside the vocabulary is a token of its own."""
        n, fits = len(piece), self.fits
        last: list[str] = [""] * (n + 1)
        known = self.letters.issuperset(piece)
        filled = 0
        for stop, (x, size, behind) in self.automaton.iter(piece):  # by end, the longest first
            end = stop + 1
            if last[end]:
                continue
            if not known:
                for i in range(filled + 1, end):
                    if not last[i]:
                        last[i] = piece[i - 1]
                filled = end - 1
            before = end - size
            if not before:
                last[end] = x
            elif left := last[before]:
                fit = behind.get(left)
                if fits(left, x, behind) if fit is None else fit:
                    last[end] = x
        out, at = [], n
        while at:
            x = last[at] or piece[at - 1]
            out.append(x)
            at -= len(x)
        return out[::-1]

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece, whose spaces are spaces still."""
        normal, out = self.normal, []
        for part in _LINES.findall(piece) if self.plain and "\n" in piece else (piece,):
            if part == "\n" and self.plain:
                out.append(self.byte_id[10]) if self.byte_id else out.append(self.unknown)
                continue
            for x in self.tokens(part.replace(" ", SPACE)):
                i = normal.get(x)
                if i is not None:
                    out.append(i)
                elif self.byte_id:
                    out.extend([self.byte_id[b] for b in x.encode()])
                else:
                    out.append(self.unknown)
        return tuple(out)

    def _learn(self, word: str, spaced: bool) -> tuple[int, ...]:
        """Ids of a word that the newer table lacks. When that is full, it becomes the older one, and frequent words come back."""
        new, old = (self.spaced, self.old_spaced) if spaced else (self.bare, self.old_bare)
        got = old.get(word)
        if got is None:
            got = self.ids_of(" " + word if spaced else word)
        if len(word) <= 40:
            if len(self.spaced) + len(self.bare) >= MEMO_PIECES:
                self.old_spaced, self.old_bare, self.spaced, self.bare = self.spaced, self.bare, {}, {}
                new = self.spaced if spaced else self.bare
            new[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        text = text.replace(SPACE, " ")
        if not self.plain:
            return list(self.ids_of((" " if self.dummy else "") + text))
        extend, learn = out.extend, self._learn
        if "  " in text or text[0] == " " or "\n " in text or text[-1] == " " or " \n" in text:  # runs of spaces are pieces with what follows
            for piece in _CUTS.findall((" " if self.dummy else "") + text):
                extend(learn(piece, False))
            return out
        first = self.dummy
        for k, line in enumerate(text.split("\n")):
            if k:
                extend(learn("\n", False))
            words = line.split(" ")
            get = self.spaced.get
            if words[0] or first:
                extend(learn(words[0], first))
            for word in words[1:]:
                got = get(word)
                if got is None:
                    got = learn(word, True)
                    get = self.spaced.get
                extend(got)
            first = False
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space that encoding put there goes; runs of byte tokens are read as UTF-8, each wrong byte as U+FFFD."""
        surface, kinds = self.surface, self.kinds
        if self.high.isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            out: list[str] = []
            pending: list[int] = []
            for i in ids:
                if kinds[i] == 6:
                    pending.append(self.byte_of[i])
                    continue
                if pending:
                    out.append(_utf8(bytes(pending)))
                    pending = []
                out.append(surface[i])
            out.append(_utf8(bytes(pending)))
            text = "".join(out)
        if not self.dummy or text[:1] != " ":
            return text
        return text[1:] if kinds[next(i for i in ids if kinds[i] != 3)] == 1 else text  # control tokens write nothing


_CUTS = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_LINES = re.compile(r"\n|[^\n]+")


def _utf8(data: bytes) -> str:
    """Each byte that belongs to no whole character gives one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


@cache
def codec(path: str) -> Codec:
    """One codec for each worker and model."""
    return Codec(path)


def _with(frame: DataFrame, fields: str) -> tuple[T.StructType, list[str]]:
    """Schema of the frame's columns and the new fields, which win over columns of the same name; the columns that stay."""
    new = T._parse_datatype_string(fields)
    names = {x.name.lower() for x in new}
    stay = [x for x in frame.schema if x.name.lower() not in names]
    return T.StructType([*stay, *new]), [x.name for x in stay]


def encode(frame: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each row's whole text as an array of int; rows stay as they are, in place (no shuffle)."""
    schema, stay = _with(frame, f"`{ids}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            got = [own.encode(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), pa.array(got, pa.list_(pa.int32()))], names=[*stay, ids])

    return frame.mapInArrow(run, schema)


def decode(frame: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that each row's ids stand for; null ids count as none."""
    schema, stay = _with(frame, f"`{text}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            got = [own.decode(x.as_py() or []) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), pa.array(got, pa.string())], names=[*stay, text])

    return frame.mapInArrow(run, schema)


def digests(frame: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text in one pass: key, n_tokens, SHA-256 of the ids and of the decoded text, and the ids if asked for."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        digits = [str(i) for i in range(len(own.texts))]
        for batch in batches:
            n, a, b, all_ids = [], [], [], []
            for x in batch.column(text):
                ids = own.encode(x.as_py())
                n.append(len(ids))
                if with_ids:
                    all_ids.append(np.array(ids, dtype=np.int32))
                a.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(key), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names=[f.name for f in schema])
        give_back()

    return frame.select(key, text).mapInArrow(run, schema)
