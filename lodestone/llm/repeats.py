"""Operator 2: substring de-duplication by prefix-partitioned suffix trees over words.

The suffixes of at least `width` words of all documents are split by variable-length prefixes: the shortest prefix that
is not frequent, so that groups of prefixes fit a task's memory. A suffix whose first `width` words occur once can lie
under no deep node; one packed round prunes these. Of the rest each group builds the subtrees of its prefixes: leaves are
sorted by the words that follow, common prefix lengths of neighbours give the internal nodes, and a node's first leaf is
its earliest occurrence. Nodes of `width` words or more are deep: each of their leaves but the first repeats an earlier
one, and the words of the unions of such windows are removed.

What is removed is decided at depth `width`, so trees are cut there (`remove`); `repeats` builds them down to `depth` words
and returns the maximal repeats of their left-diverse deep nodes. Edges carry a byte for each word, or eight where trees
go deeper, and 64 bits for the first `width` words; leaves of one part, or of one block of parts, with equal words are
one leaf, so that no node gathers all copies of a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import exchange as X
from lodestone.llm.store import cut
from lodestone.llm.words import U64, WORD_BASE, Words, buffers, give_back, lean, slices, spans_hash

WIDTH = 20
#: A prefix is lengthened if it begins more than this share of all suffixes, or more than a quarter of a group's, whichever is more.
LEAST_SHARE = 1 / 2000
#: Words of a group of prefixes, on average.
GROUP_WORDS = 1 << 20


def prefixes(hashes: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return spans_hash(hashes, at, at + length, WORD_BASE)


class Prefixes:
    """The frequent prefixes: by length, hashes of those that begin too many suffixes, and by how many words more the others are lengthened.

    At most 2 / share hashes of a length are held, so the share has a least value; beyond it, where a group's share is
    less, prefixes are lengthened by a word for each factor of 16 that is missing.
    """

    def __init__(self, known: list[np.ndarray], more: int, width: int):
        self.known, self.more, self.width = known, more, width

    def lengths(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words of the prefix of each suffix: the shortest that isn't frequent, and some more."""
        out = np.full(len(at), self.width)
        left = np.arange(len(at))
        for length, known in enumerate(self.known, 1):
            if not len(left):
                break
            own = prefixes(hashes, at[left], length)
            often = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), dtype=bool)
            out[left[~often]] = length
            left = left[often]
        return np.minimum(out + self.more, self.width)

    def groups(self, hashes: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
        return X.bucket_of(prefixes(hashes, at, self.lengths(hashes, at)), groups)


def frequent_prefixes(frame: DataFrame, text: str, width: int, size: int, group_words: int = GROUP_WORDS) -> Prefixes:
    """Each batch counts all its prefixes and reports those that are frequent in it; a prefix that is frequent overall is so in some batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                w = Words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                at = _windows(w.doc, width)
                rows = [(0, 0, len(at))]
                least = max(2, share / 2 * len(at))
                for length in range(1, width):
                    if not len(at):
                        break
                    own, back, many = np.unique(prefixes(w.hash, at, length), return_inverse=True, return_counts=True)
                    often = many >= least
                    rows += [(length, int(h), int(c)) for h, c in zip(own[often].view(np.int64), many[often], strict=True)]
                    at = at[often[back]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["length", "hash", "n"])
        give_back()

    wanted = group_words / (4 * max(1, size // 6))
    share = min(1 / 20, max(LEAST_SHARE, wanted))
    counted = cut(frame.select(text).mapInArrow(count, "length long, hash long, n long").groupBy("length", "hash").agg(F.sum("n").alias("n")))
    total = counted.where("length = 0").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("length") > 0) & (F.col("n") > max(1, total * share / 2))).collect()  # at most 2 / share rows of a length
    known = [np.sort(np.array([r["hash"] for r in rows if r["length"] == k], dtype=np.int64).view(U64)) for k in range(1, width)]
    return Prefixes(known, int(np.ceil(np.log(max(1, share / wanted)) / np.log(16))), width)


def _windows(doc: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(max(0, len(doc) - width + 1))
    return at[doc[at] == doc[at + width - 1]] if len(at) else at


class Suffixes:
    """Suffixes of at least `width` words of a part, one for each distinct path of so many words, and which come again in the part."""

    def __init__(self, part: X.Part, width: int):
        self.at = part.windows(width)
        whole = prefixes(part.hash, self.at, width)
        self.path, first, self.of = np.unique(whole, return_index=True, return_inverse=True)
        self.kept = self.at[first]
        self.again = np.ones(len(self.at), dtype=bool)  # all but the first of a path
        self.again[first] = False

    def leaves(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which paths are asked for, and their groups, whatever their prefixes."""
        group = X.bucket_of(self.path, groups)
        order = np.argsort(group, kind="stable")
        return order, group[order]


def _columns(edges: np.ndarray) -> list[np.ndarray]:
    """Numbers that sort as the rows of bytes do, the first column first."""
    padded = np.zeros((len(edges), -(-edges.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : edges.shape[1]] = edges
    return list(padded.view(">u8").astype(U64).T)


class Subtree:
    """The suffix tree of a group, down to the depth that its leaves' edges reach.

    edges: of each leaf, the words' labels in a row, of `size` bytes each, all zero beyond the end of its document; check:
    64 bits for its first `width` words. Leaves are sorted by edges; common[i] is the number of words that leaf i of that
    order has in common with the one before. Internal nodes are the intervals that no smaller common[i] cuts.
    """

    def __init__(self, edges: np.ndarray, check: np.ndarray, size: int, width: int):
        n, self.width, self.depth = len(edges), width, edges.shape[1] // size
        head, rest = (_columns(x) for x in (edges[:, : width * size], edges[:, width * size :]))
        self.order = np.lexsort((*rest[::-1], check, *head[::-1]))
        own = edges[self.order]
        own = own if size == 1 else own.view(f"<u{size}")
        differ = (own[1:] != own[:-1]) | (own[1:] == 0)
        self.common = np.zeros(n, dtype=np.int64)
        self.common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.depth)
        unlike = check[self.order][1:] != check[self.order][:-1]
        self.common[1:][unlike] = np.minimum(self.common[1:][unlike], width - 1)  # equal labels of words that differ

    def under(self, depth: int) -> np.ndarray:
        """Of each leaf in order, the number of the tallest node of at least that depth above it (or of itself, alone)."""
        return np.cumsum(self.common < depth) - 1

    def later(self, *order: np.ndarray) -> np.ndarray:
        """Of each leaf, whether it isn't the first under its tallest deep node, by the given keys, the last first, then as given."""
        node = np.empty(len(self.order), dtype=np.int64)
        node[self.order] = self.under(self.width)
        rank = np.lexsort((*order, node))
        out = np.zeros(len(node), dtype=bool)
        out[rank[1:]] = node[rank][1:] == node[rank][:-1]
        return out

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By rising depth: the depth, first leaves and ends of the deep internal nodes."""
        n = len(self.order)
        for depth in range(self.width, self.depth + 1):
            lo = np.flatnonzero(self.common < depth)
            hi = np.append(lo[1:], n)
            lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
            if not len(lo):
                return
            inner = np.minimum.reduceat(np.append(self.common, 0), np.stack([lo + 1, hi], axis=1).ravel())[::2]
            yield depth, lo[inner == depth], hi[inner == depth]


def _labels(part: X.Part, at: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Edges of the suffixes at the given words: of each word some bytes of its hash, never all zero; zero beyond a document's end."""
    own = X.pack(part.hash >> U64(64 - 8 * size), size).copy()
    own[~own.any(axis=1), 0] = 1
    own = np.append(own, np.zeros((1, size), dtype=np.uint8), axis=0)
    place = at[:, None] + np.arange(depth)
    end = part.first[part.doc[at] + 1]
    return own[np.where(place < end[:, None], place, len(own) - 1)].reshape(len(at), depth * size)


class Plan:
    """What parts and groups do in the two rounds; no data of its own, so that it can be sent to tasks.

    With a depth, trees go that deep and answers tell the depths of left-diverse nodes, else whether a leaf is later.
    """

    def __init__(self, key: str, text: str, width: int, depth: int, mixed: bool, groups: int, prefixes_: Prefixes):
        self.key, self.text, self.width, self.depth = key, text, width, depth or width
        self.size = 8 if depth else 1
        self.groups, self.fine, self.prefixes = groups, X.per_bucket(groups), prefixes_
        self.own = 8 if mixed and not depth else 0  # bytes of a key, where the order of parts doesn't tell
        self.leaf = X.shared("leaf", self.ask_leaves)
        edges = self.depth * self.size
        if depth:
            self.node = X.Question("node", 16 + edges, self.ask_nodes, self.maximal, self.merge_two, reply=8)
        else:
            self.node = X.Question("node", 8 + edges + self.own, self.ask_nodes, self.later, self.merge_first, rest=1)

    def read(self, docs: pa.Table) -> tuple[X.Part, Suffixes]:
        part = X.Part(docs, self.key, self.text)
        return part, Suffixes(part, self.width)

    def ask_leaves(self, _: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, own = self.read(docs)
        order, group = own.leaves(self.groups)
        return group, X.fingerprints(own.path[order])

    def alive(self, own: Suffixes, got: pa.Table) -> np.ndarray:
        """Which paths came from other parts too."""
        order, group = own.leaves(self.groups)
        out = np.zeros(len(order), dtype=bool)
        out[order] = self.leaf.of(got, group, self.fine) > 0
        return out

    def ask_nodes(self, _: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        part, own = self.read(docs)
        at, group, records, _ = self.leaves(part, own, got)
        return group, records

    def leaves(self, part: X.Part, own: Suffixes, got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that are sent on, in order, with their groups and records; and of all windows (of all paths, without a depth) the index of theirs, or -1."""
        alive = self.alive(own, got)
        if self.depth > self.width:
            at, path, sent, of = self._contexts(part, own, alive)
        else:
            at, path, of = own.kept[alive], own.path[alive], np.where(alive, np.cumsum(alive) - 1, -1)
            sent = np.arange(len(at))
        at, path = at[sent], path[sent]
        group = self.prefixes.groups(part.hash, at, self.groups)
        order = np.lexsort((path, group))
        place = np.empty(len(order) + 1, dtype=np.int64)
        place[order], place[-1] = np.arange(len(order)), -1
        at, path = at[order], path[order]
        columns = [X.pack(path, 8)]
        if self.depth > self.width:
            left = np.where(at > part.first[part.doc[at]], part.hash[at - 1] | U64(1), U64(0)) if len(at) else path
            columns.append(X.pack(left, 8))
        columns.append(_labels(part, at, self.depth, self.size))
        if self.own:
            columns.append(X.pack(part.ids()[part.doc[at]].view(U64), 8))
        return at, group[order], np.concatenate(columns, axis=1), place[of]

    def _contexts(self, part: X.Part, own: Suffixes, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that are repeated anywhere: at most two of those with the same words around them are sent; and each window's."""
        many = np.bincount(own.of, minlength=len(own.path)) > 1
        live = np.flatnonzero((alive | many)[own.of])
        at = own.at[live]
        begin = at - (at > part.first[part.doc[at]])
        end = np.minimum(at + self.depth, part.first[part.doc[at] + 1])
        context = prefixes(part.hash, begin, end - begin) + (at - begin).astype(U64)
        _, first, of = np.unique(context, return_index=True, return_inverse=True)
        rest = np.ones(len(at), dtype=bool)
        rest[first] = False
        _, second = np.unique(of[rest], return_index=True)
        sent = np.concatenate([first, np.flatnonzero(rest)[second]])
        index = np.full(len(own.at), -1)
        index[live] = of
        return at, own.path[own.of[live]], sent, index

    def tree(self, records: np.ndarray, skip: int) -> Subtree:
        return Subtree(records[:, skip : skip + self.depth * self.size], X.unpack(records[:, :8]), self.size, self.width)

    def later(self, records: np.ndarray, senders: np.ndarray) -> np.ndarray:
        keys = (senders, X.unpack(records[:, -8:]).view(np.int64)) if self.own else (senders,)
        return self.tree(records, 8).later(*keys)

    def merge_first(self, records: np.ndarray, senders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of leaves with equal words, the first by key and sender."""
        tree = self.tree(records, 8)
        node = np.empty(len(records), dtype=np.int64)
        node[tree.order] = tree.under(self.width)
        first = np.flatnonzero(~self.later(records, senders))
        first = first[np.argsort(node[first])]
        return records[first], node, first

    def maximal(self, records: np.ndarray, senders: np.ndarray) -> np.ndarray:
        """Bit d - width of a leaf's answer: whether a left-diverse node of depth d is above it; the highest bit: whether any node of the trees' full depth is."""
        tree = self.tree(records, 16)
        left = X.unpack(records[:, 8:16])[tree.order]
        change = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] == 0)))) if len(left) else left
        bits = np.zeros(len(left), dtype=U64)
        for depth, lo, hi in tree.nodes():
            diverse = change[hi - 1] > change[lo]
            for a, b, flag in ((lo[diverse], hi[diverse], depth - self.width), *(((lo, hi, 63),) if depth == self.depth else ())):
                mark = np.zeros(len(left) + 1, dtype=np.int64)
                mark[a] += 1
                mark[b] -= 1
                bits[np.cumsum(mark)[:-1] > 0] |= U64(1) << U64(flag)
        out = np.empty_like(bits)
        out[tree.order] = bits
        return out

    def merge_two(self, records: np.ndarray, senders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of leaves with equal words around them, two at most."""
        flat = np.ascontiguousarray(records).view(f"V{records.shape[1]}").ravel()
        _, first, of = np.unique(flat, return_index=True, return_inverse=True)
        rest = np.ones(len(records), dtype=bool)
        rest[first] = False
        _, second = np.unique(of[rest], return_index=True)
        stand = np.concatenate([first, np.flatnonzero(rest)[second]])
        return records[stand], of, stand


def _rounds(frame: DataFrame, key: str, text: str, width: int, part_bytes: int, group_words: int, depth: int = 0) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the parts, and all that groups answered."""
    parts = X.ranged_parts(frame, key, text, part_bytes)
    groups = max(16, parts.size // (6 * group_words))
    plan = Plan(key, text, width, depth, parts.mixed, groups, frequent_prefixes(frame, text, width, parts.size, group_words))
    leaf = X.ask(parts, X.no_replies(frame), plan.leaf, groups)
    return plan, parts.frame, leaf.unionByName(X.ask(parts, leaf, plan.node, groups))


def _covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:n] > 0


def _later(plan: Plan, docs: pa.Table, got: pa.Table) -> tuple[X.Part, np.ndarray]:
    """The part, and which of its words are covered by windows that start earlier somewhere."""
    part, own = plan.read(docs)
    _, group, _, of = plan.leaves(part, own, got)
    answers = plan.node.of(got, group, plan.fine) > 0
    later = np.append(answers, False)[of]
    return part, _covered(len(part.doc), own.at[own.again | later[own.of]] if len(own.at) else own.at, plan.width)


def remove(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, texts: bool = False, part_bytes: int = X.PART_BYTES, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256, and the kept text if asked for.

    Removes each word covered by a window of `width` words whose words also start earlier: in a smaller key, or earlier
    in the same document. A null text has no words; a null key counts as the smallest; rows of equal keys are taken in
    an order of their own (that of their texts, where they fit a part); texts shorter than `width` words stay; an empty
    table gives no rows; other columns don't matter. A long text is one part, of about 60 bytes a word.
    """
    plan, parts, messages = _rounds(frame, key, text, width, part_bytes, group_words)
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)])

    @lean
    def finish(_, docs, got):
        names = [f.name for f in schema]
        kinds = [docs.schema.field(key).type, pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
        if not len(docs):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        words, gone = _later(plan, docs, got)
        kept = ~gone
        start, size = words.start[kept], words.end[kept] - words.start[kept] + 1
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(start - (ends - size), size)
        flat = np.append(words.data, np.uint8(32))[np.minimum(index, len(words.data))]
        flat[ends - 1] = 32
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.bincount(words.doc[kept], minlength=len(words.count)))))]
        view = memoryview(flat.tobytes())
        own = [view[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        removed = np.bincount(words.doc[gone], minlength=len(words.count))
        columns = [words.keys, pa.array(words.count), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())]
        if texts:
            columns.append(pa.array([bytes(x).decode() for x in own], pa.string()))
        return pa.table(columns, names=names)

    return parts.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(finish, schema)


def spans(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, part_bytes: int = X.PART_BYTES, group_words: int = GROUP_WORDS) -> DataFrame:
    """What remove takes: key, first_word, end_word (exclusive), one row for each run of overlapping repeated windows. Same rules as remove."""
    plan, parts, messages = _rounds(frame, key, text, width, part_bytes, group_words)
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("first_word long, end_word long")])

    @lean
    def finish(_, docs, got):
        names = [f.name for f in schema]
        if not len(docs):
            return pa.table([pa.array([], docs.schema.field(key).type), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        words, covered = _later(plan, docs, got)
        doc = np.where(covered, words.doc, -1)
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], doc, [-1]))))
        lo = edge[:-1][doc[edge[:-1]] >= 0] if len(edge) else edge
        hi = edge[np.searchsorted(edge, lo, side="right")]
        base = words.first[doc[lo]]
        return pa.table([words.keys.take(pa.array(doc[lo], pa.int64())), pa.array(lo - base), pa.array(hi - base)], names=names)

    return parts.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(finish, schema)


def repeats(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, depth: int = 64, part_bytes: int = X.PART_BYTES, group_words: int = GROUP_WORDS) -> DataFrame:
    """The occurrences of maximal repeats: key, first_word, end_word (exclusive), one row for each left-diverse deep node above a suffix.

    A maximal repeat is a run of `width` words or more that occurs more than once and can't be lengthened to either side
    without losing an occurrence. Trees end at `depth` words (at most `width` + 62): a repeat of so many words or more goes
    on while each next word begins one too. Null keys, ties and short texts as for remove; rows of one key are told apart
    by nothing in the result.
    """
    if not width < depth <= width + 62:
        raise ValueError("the depth must be more than the width, by 62 at most")
    plan, parts, messages = _rounds(frame, key, text, width, part_bytes, group_words, depth)
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("first_word long, end_word long")])

    @lean
    def finish(_, docs, got):
        names = [f.name for f in schema]
        if not len(docs):
            return pa.table([pa.array([], docs.schema.field(key).type), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        part, own = plan.read(docs)
        _, group, _, of = plan.leaves(part, own, got)
        bits = np.append(plan.node.of(got, group, plan.fine), U64(0))[of]
        full = np.zeros(len(part.doc) + 1, dtype=bool)
        full[own.at[bits >= U64(1 << 63)]] = True
        stop = np.flatnonzero(~full)  # the end of a run of suffixes under nodes of full depth
        found = []
        for d in range(width, depth + 1):
            at = own.at[(bits >> U64(d - width)) & U64(1) > 0]
            end = at + d if d < depth else stop[np.searchsorted(stop, at)] - 1 + depth
            found.append(np.stack([at, end], axis=1))
        at, end = np.concatenate(found).T
        base = part.first[part.doc[at]]
        return pa.table([part.keys.take(pa.array(part.doc[at], pa.int64())), pa.array(at - base), pa.array(end - base)], names=names)

    return parts.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(finish, schema)
