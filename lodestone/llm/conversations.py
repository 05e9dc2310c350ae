"""Operator 11: cheapest repair of a conversation's structure, by composition of weighted finite-state machines.

The rows of a conversation are a chain (input acceptor); a transducer keeps, reroles, deletes and inserts rows at a cost;
an acceptor knows the legal orders of roles, `(s?(ua)+)?`. Their composition isn't built: its states are (rows read,
state of the grammar), visited in topological order, with insertions closed within a row's layer. A weight is (cost,
labels of the edits), least cost first and then the least label string; paths multiply by adding costs and joining labels.

Rows are dealt by ranges of (conversation, order), so that a conversation of any size is spread over many pieces, and sorted
once. A conversation inside a piece is solved there. One that begins or ends a piece may go on in another: each piece
sends its rows' codes (a letter each) and fingerprints; first occurrences are settled by an aggregate, every piece gives
the matrix of its weights between the grammar's states, and the matrices are multiplied in order. Texts of such a
conversation stream once more through one task that applies the edits, as the contract's hash of them has one order; it
holds a letter for each row, not the rows.

Order of rows: turn (nulls first), role, the first 64 characters, then a hash of the text; equal rows are repeated rows,
of which all but the first are duplicates. A null conversation is one of its own; null roles and texts are one space, and
so illegal and blank. An empty table gives no rows; other columns don't matter; long texts are one value each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import cut
from lodestone.llm.words import give_back

#: States of the grammar: nothing yet, after s, after u, after a; and those that may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: Costs of edits; keeping a row is free. A row that was cut off costs more unless it is deleted.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a chain whose weights are found at a time; longer ones multiply matrices.
BLOCK = 256
#: Rows and bytes of a conversation that are held to be solved at once; larger ones go by codes, as those of several pieces.
HELD_ROWS, HELD_BYTES = 50_000, 32 << 20
_SPACES = b" \t\n\x0b\x0c\r"
Weight = tuple[int, str]
Weights = dict[int, Weight]


def _arcs(code: str) -> list[tuple[int, str, str]]:
    """Edits of a row: (cost, label, role's initial or nothing). Codes: b blank and d duplicate, which must go; else the role's initial or `-`, in capitals (`_`) for a row that was cut off."""
    if code in "bd":
        return [(DELETE, "D", "")]
    more = CUT_OFF if code in "SUA_" else 0
    own = code.lower()
    kept = [(more, "K", own)] if own in "sua" else []
    return [*kept, (REROLE + more, "R", "u"), (REROLE + more, "R", "a"), (DELETE, "D", "")]


_ARCS = {c: _arcs(c) for c in "bdsua-SUA_"}


def _closed(now: Weights) -> Weights:
    """With insertions of empty rows."""
    while True:
        more = dict(now)
        for state, (cost, label) in now.items():
            for initial in "ua":
                to = STEP.get((state, initial))
                if to is not None and (to not in more or (cost + INSERT, label + "I") < more[to]):
                    more[to] = (cost + INSERT, label + "I")
        if more == now:
            return now
        now = more


def _through(codes: str, start: int) -> Weights:
    """Weights from one state of the grammar to all, over a short chain of rows."""
    now = _closed({start: (0, "")})
    for code in codes:
        after: Weights = {}
        for state, (cost, label) in now.items():
            for more, letter, initial in _ARCS[code]:
                to = STEP.get((state, initial)) if initial else state
                if to is not None and (to not in after or (cost + more, label + letter) < after[to]):
                    after[to] = (cost + more, label + letter)
        now = _closed(after)
    return now


@lru_cache(maxsize=1 << 16)
def _known(codes: str, start: int) -> Weights:
    return _through(codes, start)


def _times(left: Weights, right: dict[int, Weights]) -> Weights:
    out: Weights = {}
    for middle, (cost, label) in left.items():
        for to, (more, rest) in right[middle].items():
            if to not in out or (cost + more, label + rest) < out[to]:
                out[to] = (cost + more, label + rest)
    return out


def weights(codes: str, starts: Iterable[int]) -> dict[int, Weights]:
    """Least weights from the given states to all, over a chain of any length: blocks' matrices, multiplied by pairs."""
    if len(codes) <= BLOCK:
        own = _known if len(codes) <= 64 else _through
        return {s: own(codes, s) for s in starts}
    middle = len(codes) // 2 // BLOCK * BLOCK or BLOCK
    right = weights(codes[middle:], range(4))
    return {s: _times(w, right) for s, w in weights(codes[:middle], starts).items()}


def best(reached: Weights) -> Weight:
    return min(w for state, w in reached.items() if state in FINAL)


def edited(audit: Iterable[str], rows: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, str, bytes]]:
    """(label, role, text) of the rows that are left; where a role is free, the grammar has only one."""
    state, rows = START, iter(rows)
    for label in audit:
        role, text = ("", b"") if label == "I" else next(rows)
        if label == "D":
            continue
        if label != "K":
            role = ROLES["a" if state == USER else "u"]
        state = STEP[state, role[:1]]
        yield label, role, text


def code_of(role: str, data: bytes) -> str:
    """A row's code, but for duplicates."""
    data = data.rstrip(_SPACES)
    if not data:
        return "b"
    own = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return own if data[-1] in b".!?" else {"-": "_"}.get(own, own.upper())


def _fingerprint(role: str, data: bytes) -> bytes:
    return hashlib.blake2b(b"%d:" % len(role) + role.encode() + data, digest_size=16).digest()


def with_faults(frame: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage that the contract asks for, by a hash of conversation and turn; dropped rows stay, marked, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    return frame.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(h == 4, "user").otherwise(space(role)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text)).alias("text"),
        (h == 0).alias("gone"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def unharmed(frame: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return frame.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(False).alias("gone"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in pieces, sorted; seq rises with the order of all rows, and its upper bits are the piece."""
    order = ["conv", "turn", "role", "head", "mark"]
    keyed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("mark", F.xxhash64("text")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    sorted_ = keyed.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "text")
    return cut(sorted_.select("conv", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("seq")))


class _Piece:
    """The rows of one conversation in one piece, as they come."""

    def __init__(self, conv: object, piece: int):
        self.conv, self.piece = conv, piece
        self.rows: list[tuple[str, bytes]] = []
        self.bytes, self.held = 0, True
        self.codes: list[str] = []
        self.initials: list[str] = []
        self.marks: list[bytes] = []
        self.seen: set[bytes] = set()
        self.turns: list[int] = []  # least, most, how many

    def add(self, turn: int | None, role: str, data: bytes) -> None:
        code, mark = code_of(role, data), _fingerprint(role, data)
        if mark in self.seen and code != "b":
            code = "d"
        self.seen.add(mark)
        self.codes.append(code)
        self.marks.append(mark)
        self.initials.append(role[:1] if role[:1] in ("s", "u", "a") else "-")
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        self.bytes += len(data)
        if self.held:
            self.rows.append((role, data))
            if len(self.rows) > HELD_ROWS or self.bytes > HELD_BYTES:
                self.rows, self.held = [], False


def _counts(codes: str, initials: str, turns: list[int]) -> tuple[int, int, int, int, int]:
    """Gaps, blank, duplicate, truncated and illegal."""
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    return gaps, codes.count("b"), codes.count("d"), sum(codes.count(c) for c in "SUA_"), illegal


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_DONE = ", ".join(f"{c} long" for c in _NUMBERS) + ", audit string, repaired_sha256 string"
_OPEN = "piece long, codes string, initials string, turns array<long>, marks binary"


def _scan(conv_type: T.DataType, conv_arrow: pa.DataType, emit: str):
    """Of sorted pieces: solved conversations, and what is known of those that may go on in another piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first, now = True, None

        def close(own: _Piece, open_: bool) -> None:
            codes, initials = "".join(own.codes), "".join(own.initials)
            if open_ or not own.held:
                out.append((own.conv, *[None] * 8, own.piece, codes, initials, own.turns, b"".join(own.marks), None))
                return
            cost, audit = best(weights(codes, [START])[START])
            left = list(edited(audit, own.rows))
            sha = hashlib.sha256(b"\n".join(r.encode() + b":" + d for _, r, d in left)).hexdigest()
            rows = [{"edit": a, "role": r, "text": d.decode()} for a, r, d in left] if emit == "rows" else None
            out.append((own.conv, *_counts(codes, initials, own.turns), cost, audit, sha, None, None, None, None, None, rows))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            conv, turn, role, text, gone, seq = (batch.column(i) for i in range(6))
            for c, t, r, d, g, q in zip(conv.to_pylist(), turn.to_pylist(), role.to_pylist(), text, gone.to_pylist(), seq.to_pylist(), strict=True):
                if now is None or c != now.conv:
                    if now is not None:
                        close(now, first)
                        first = False
                    now = _Piece(c, q >> 33)
                if not g:
                    now.add(t, r, d.as_py())
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            close(now, True)
        yield flush()
        give_back()

    types = [conv_arrow, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))]
    names = ["conv", *_NUMBERS, "audit", "repaired_sha256", "piece", "codes", "initials", "turns", "marks", "rows"]
    schema = T.StructType([T.StructField("conv", conv_type), *T._parse_datatype_string(f"{_DONE}, {_OPEN}, rows array<struct<edit:string,role:string,text:string>>")])
    return run, schema


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct fingerprints of each piece."""
    for batch in batches:
        own = [(i, m) for i, data in enumerate(batch.column(2).to_pylist()) for m in sorted({data[a : a + 16] for a in range(0, len(data), 16)})]
        at = pa.array([i for i, _ in own], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([m for _, m in own], pa.binary())], names=["conv", "piece", "mark"])


def _matrix(key, pieces, seen):
    """A piece's codes in the light of what came before, and its matrix of weights."""
    names = ["conv", "piece", "codes", "initials", "turns", "start", "state", "cost", "label"]
    out: list[tuple] = []
    if len(pieces):
        before = set(seen["mark"].to_pylist())
        row = pieces.to_pylist()[0]
        codes = "".join("d" if c not in "bd" and row["marks"][16 * i : 16 * i + 16] in before else c for i, c in enumerate(row["codes"]))
        for start, reached in weights(codes, range(4)).items():
            for state, (cost, label) in reached.items():
                lead = not out  # what there is but once goes with the first
                out.append((row["conv"], row["piece"], codes if lead else None, row["initials"] if lead else None, row["turns"] if lead else None, start, state, cost, label))
    types = [pieces.schema.field("conv").type if len(pieces) else key[0].type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _multiplied(key, table):
    """One conversation: the product of its pieces' matrices in order, and its counts."""
    by: dict[int, list[dict]] = {}
    for row in sorted(table.to_pylist(), key=lambda r: (r["piece"], r["codes"] is None)):
        by.setdefault(row["piece"], []).append(row)
    reached: Weights = {START: (0, "")}
    total, last, turns = [0] * 5, "", []
    for rows in by.values():
        matrix: dict[int, Weights] = {}
        for r in rows:
            matrix.setdefault(r["start"], {})[r["state"]] = (r["cost"], r["label"])
        reached = _times(reached, matrix)
        head = rows[0]
        own = _counts(head["codes"], last + head["initials"], [])
        total = [a + b for a, b in zip(total, own, strict=True)]
        last = head["initials"][-1:] or last
        if head["turns"]:
            low, high, many = head["turns"]
            turns = [turns[0], high, turns[2] + many - (low == turns[1])] if turns else [low, high, many]
    total[0] = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    cost, audit = best(reached)
    return pa.table([pa.array([key[0].as_py()], table.schema.field("conv").type), *[pa.array([x], pa.int64()) for x in (*total, cost)], pa.array([audit], pa.string())], names=["conv", *_NUMBERS, "audit"])


def _applied(conv_arrow: pa.DataType, emit: str):
    """Streams each conversation: its edits come first, then its rows in order; holds one letter for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: dict = {}

        def put(label: str, role: str, data: bytes) -> None:
            if emit == "rows":
                out.append((now["conv"], now["n"], label, role, data.decode(), None))
            else:
                now["sha"].update((b"\n" if now["n"] else b"") + role.encode() + b":" + data)
            now["n"] += 1

        def inserted() -> None:
            audit = now["audit"]
            while now["at"] < len(audit) and audit[now["at"]] == "I":
                initial = "a" if now["state"] == USER else "u"
                now["state"] = STEP[now["state"], initial]
                now["at"] += 1
                put("I", ROLES[initial], b"")

        def close() -> None:
            if now and emit != "rows":
                out.append((now["conv"], None, None, None, None, now["sha"].hexdigest()))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate((conv_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv", "position", "edit", "role", "text", "repaired_sha256"])

        for batch in batches:
            conv, seq, audit, role, text = (batch.column(i) for i in range(5))
            for c, q, a, r, d in zip(conv.to_pylist(), seq.to_pylist(), audit, role.to_pylist(), text, strict=True):
                if q < 0:
                    close()
                    now.update(conv=c, n=0, at=0, state=START, audit=a.as_py(), sha=hashlib.sha256())
                    inserted()
                    continue
                label, data = now["audit"][now["at"]], d.as_py()
                now["at"] += 1
                if label != "D":
                    own = r[:1] if label == "K" else "a" if now["state"] == USER else "u"
                    now["state"] = STEP[now["state"], own]
                    put(label, r if label == "K" else ROLES[own], data)
                inserted()
            if len(out) >= 1000:
                yield flush()
        close()
        yield flush()
        give_back()

    return run


def _open_ones(dealt: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations that may lie in several pieces: counts and edits; and their edits and rows in order, to be streamed."""
    open_ = found.where("piece is not null").select("conv", "piece", "codes", "initials", "turns", "marks")
    conv = found.schema["conv"]
    each = cut(open_.select("conv", "piece", "marks").mapInArrow(_unpacked, T.StructType([conv, *T._parse_datatype_string("piece long, mark binary")])))
    firsts = each.groupBy("conv", "mark").agg(F.min("piece").alias("first"))
    later = each.alias("e").join(firsts.alias("f"), F.col("e.conv").eqNullSafe(F.col("f.conv")) & (F.col("e.mark") == F.col("f.mark"))).where("piece > first").select("e.conv", "piece", "e.mark")
    matrix = T.StructType([conv, *T._parse_datatype_string("piece long, codes string, initials string, turns array<long>, start long, state long, cost long, label string")])
    matrices = open_.groupBy("conv", "piece").cogroup(later.groupBy("conv", "piece")).applyInArrow(_matrix, matrix)
    solved = cut(matrices.groupBy("conv").applyInArrow(_multiplied, T.StructType([conv, *T._parse_datatype_string(", ".join(f"{c} long" for c in _NUMBERS) + ", audit string")])))
    rows = dealt.where("NOT gone").alias("r").join(solved.select("conv").alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")), "left_semi")
    both = solved.select("conv", F.lit(-1).cast("long").alias("seq"), "audit", F.lit("").alias("role"), F.lit(b"").alias("text")).union(rows.select("conv", "seq", F.lit("").alias("audit"), "role", "text"))
    return solved, both.repartition("conv").sortWithinPartitions("conv", "seq")


def _prepared(rows: DataFrame, emit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    dealt = _dealt(rows.withColumn("text", F.encode("text", "UTF-8")))
    run, schema = _scan(dealt.schema["conv"].dataType, _arrow(dealt), emit)
    found = cut(dealt.mapInArrow(run, schema))
    return (found, *_open_ones(dealt, found))


def _arrow(frame: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema["conv"].dataType)


def digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv, turn, role, text, gone), as contracted."""
    found, solved, stream = _prepared(rows, "digest")
    schema = T.StructType([found.schema["conv"], *T._parse_datatype_string("position long, edit string, role string, text string, repaired_sha256 string")])
    hashed = stream.mapInArrow(_applied(_arrow(found), "digest"), schema).select(F.col("conv").alias("c"), "repaired_sha256")
    columns = [F.col("conv").alias("conv_id"), *_NUMBERS, "audit", "repaired_sha256"]
    whole = found.where("piece is null").select(*columns)
    return whole.union(solved.join(hashed, F.col("conv").eqNullSafe(F.col("c"))).select(*columns))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of all repaired conversations."""
    found, _, stream = _prepared(rows, "rows")
    schema = T.StructType([found.schema["conv"], *T._parse_datatype_string("position long, edit string, role string, text string, repaired_sha256 string")])
    columns = [F.col("conv").alias("conv_id"), F.col("position").cast("long"), "edit", "role", "text"]
    streamed = stream.mapInArrow(_applied(_arrow(found), "rows"), schema).select(*columns)
    return found.where("piece is null").select("conv", F.posexplode("rows").alias("position", "row")).select("conv", "position", "row.*").select(*columns).union(streamed)


def repair(frame: DataFrame) -> DataFrame:
    """The contract's query: conversations, damaged, then repaired."""
    return digests(with_faults(frame))

