"""Operator 5: n-gram Jaccard self join by inverted lists with set-relation skipping, exact, as connected components.

Equal sets are one class with one representative. Shingles are ordered by how many sets hold them, rarest first (counts
by packed exchange, over all sets); two sets that link share a shingle among their first few, their prefixes. Lists of
prefix shingles give families of sets that may link: each list only ties its members to its smallest, never all pairs.

Within a family, lists are indexed anew and read in blocks by size and position: a block that can't reach the overlap is
skipped whole. A set that is found to link to a component's leader takes over what is known of that component, so that
its other members aren't looked at; where it doesn't, its overlap with the leader and the members' known overlaps with
it bound, and mostly settle, the answers for the members. What remains is compared in full.

Families too large for a task are split into chunks; components' leaders are then compared on further levels. What may
still link is members of different components. Where few are outside a family's largest component, those are compared
with all its chunks, at a cost in proportion to the family; in a family without such a component, members meet only in
those prefix lists that still hold more than one component. No pair that could link is left out.

Contract: a null or empty text, or one without words, has size 0 and component_id = its own key; repeated rows are in one
component; rows with one key count as one document; a null key joins the component of an equal set that has a key, and
else has a null component; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import exchange as X
from lodestone.llm.graph import components
from lodestone.llm.repeats import GROUP_WORDS
from lodestone.llm.store import cut
from lodestone.llm.words import U64, WORD_BASE, Words, buffers, give_back, lean, mix, slices, spans_hash

SHINGLE, PERCENT = 3, 90
#: Sets, and shingles in all of them, of a chunk of a family that is joined within itself; of one that others' members are compared with; and of a chunk of a prefix list.
CHUNK_SETS, CHUNK_SHINGLES = 100, 500_000
ACROSS_SETS, ACROSS_SHINGLES = 1000, 1_000_000
LIST_SETS, LIST_SHINGLES = 1000, 2_000_000
#: Copies of its members that a family may send to its chunks, as a multiple of their number; beyond that they meet by prefix lists.
SPREAD = 16
#: Members of other sets that are looked up at a time, and cells and holders that are counted at a time.
SOUGHT, OVERLAPS = 1 << 18, 1 << 21
#: Rows that a task remembers, to pass on equal ones once.
SEEN = 200_000
_NODE = "id long, part long, n int, data binary"


def shingle_sets(hashes: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents in a row, sorted within each, and how many each has; short documents have their whole sequence as one."""
    first = np.concatenate(([0], np.cumsum(count)))
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), many)
    begin = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    end = np.minimum(begin + width, first[doc + 1])
    with np.errstate(over="ignore"):
        own = spans_hash(hashes, begin, end, WORD_BASE)
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    return own[keep], np.bincount(doc[keep], minlength=len(count))


def _marks(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, whatever the order of its members."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(own ^ U64(salt)), dtype=U64)))
        ends = np.cumsum(sizes)
        out.append(mix(sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def describe(frame: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, salt, n, x, y): a hash of each row's key and text, the size of its set, and 128 bits that stand for the set."""
    schema = T.StructType([frame.schema[key], *T._parse_datatype_string("salt long, n long, x long, y long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                w = Words(data[base : offsets[hi]], offsets[lo : hi + 1] - base, lower=True)
                own, sizes = shingle_sets(w.hash, np.diff(w.first), width)
                x, y = _marks(own, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(x), pa.array(y)], names=[key, "salt", "n", "x", "y"])
        give_back()

    return frame.select(key, F.xxhash64(key, text).alias("salt"), text).mapInArrow(run, schema)


def _dealt(frame: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(part, key, text) of all rows with a key, by a hash of both, so that a key with many rows fills no part; of equal rows a task passes one on."""
    schema = T.StructType([T.StructField("part", T.LongType()), frame.schema[key], frame.schema[text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for salt in batch.column(0).to_pylist():
                new.append(salt not in seen)
                if len(seen) < SEEN:
                    seen.add(salt)
            batch = batch.filter(pa.array(new, pa.bool_()))
            part = batch.column(0).to_numpy(zero_copy_only=False) % n  # as pmod
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(1), batch.column(2)], names=["part", key, text])

    return frame.where(F.col(key).isNotNull()).select(F.xxhash64(key, text), key, text).mapInArrow(run, schema)


def _code(many: np.ndarray) -> np.ndarray:
    """Counts of sets as bytes: eight times their logarithm to base 2; 0 is one set."""
    return np.minimum(np.rint(8 * np.log2(np.maximum(many, 1))), 255).astype(np.uint8)


def least_overlap(a, b, percent: int):
    """Members that sets of sizes a and b must share to link: i * 100 >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


class Family:
    """Sets that may link, joined one after the other in order of size; finds components."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        own, back, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(own), dtype=np.int64)
        rank[np.lexsort((own, many))] = np.arange(len(own))  # rarest first
        ends = np.cumsum(self.size)
        shared = many[np.argsort(rank)] > 1
        self.prefix = []
        for a, n in zip(ends - self.size, self.size, strict=True):
            got = np.partition(rank[back[a : a + n]], p - 1)[:p] if (p := int(prefix_length(n, percent))) < n else rank[back[a : a + n]]
            self.prefix.append(np.sort(got))
        self.shared = shared
        self.parent = list(range(len(ids)))
        self.leader: dict[int, int] = {}  # of a component's root
        self.members: dict[int, list[int]] = {}
        self.known: dict[int, int] = {}  # a member's overlap with its component's leader

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def overlap(self, i: int, j: int) -> int:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        return int((b[place] == a).sum())

    def links(self, i: int, j: int, overlap: int) -> bool:
        return overlap * (100 + self.percent) >= self.percent * int(self.size[i] + self.size[j])

    def _join(self, i: int, root: int, overlap: int | None) -> None:
        """Takes i's component into that of root, whose leader i overlaps by the given number if that is known."""
        mine = self.root(i)
        big, small = (root, mine) if len(self.members[root]) >= len(self.members[mine]) else (mine, root)
        lead = self.leader[big]
        for j in self.members[small]:
            self.known[j] = overlap if j == i and big == root and overlap is not None else self.overlap(j, lead)
        self.parent[small] = big
        self.members[big] += self.members.pop(small)
        self.leader.pop(small)

    def add(self, i: int, candidates: np.ndarray) -> None:
        """Joins i with the components of those candidates that it links to."""
        self.members.setdefault(i, [i])
        self.leader.setdefault(i, i)
        self.known.setdefault(i, int(self.size[i]))
        groups: dict[int, list[int]] = {}
        for j in candidates.tolist():
            groups.setdefault(self.root(j), []).append(j)
        for root, some in groups.items():
            root = self.root(root)
            if root == self.root(i):
                continue
            lead = self.leader[root]
            with_lead = self.overlap(i, lead)
            if self.links(i, lead, with_lead):  # its answers are the component's
                self._join(i, root, with_lead)
                continue
            mine = int(self.size[i])
            for j in some:
                n, known = int(self.size[j]), self.known[j]
                if j != lead and min(with_lead, known) + min(mine - with_lead, n - known) >= least_overlap(mine, n, self.percent) and self.links(i, j, self.overlap(i, j)):
                    self._join(i, root, with_lead)
                    break

    def run(self) -> None:
        """Index lists grow in order of size, so the sets too small for the next one are a block at their heads."""
        lists: dict[int, list[np.ndarray]] = {}
        order = np.lexsort((np.array(self.ids), self.size))
        sizes, places, sets, used = {}, {}, {}, {}
        for i in order.tolist():
            n = int(self.size[i])
            found = []
            smallest = -(-self.percent * n // 100)
            own = self.prefix[i]
            own_places = np.arange(len(own))
            for place, token in zip(own_places[self.shared[own]].tolist(), own[self.shared[own]].tolist(), strict=True):
                m = used.get(token, 0)
                if m:
                    s = sizes[token]
                    skip = int(np.searchsorted(s[:m], smallest))
                    if skip < m:
                        size, at = s[skip:m], places[token][skip:m]
                        fits = np.minimum(n - place, size - at) >= least_overlap(n, size, self.percent)
                        found.append(sets[token][skip:m][fits])
                else:
                    sizes[token], places[token], sets[token] = (np.empty(8, dtype=np.int64) for _ in range(3))
                if m == len(sizes[token]):
                    for d in (sizes, places, sets):
                        d[token] = np.concatenate((d[token], np.empty_like(d[token])))
                sizes[token][m], places[token][m], sets[token][m] = n, place, i
                used[token] = m + 1
            self.add(i, np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64))
        del lists

    def result(self) -> list[tuple[int, int]]:
        """(index, index of its component's leader)."""
        return [(i, self.leader[self.root(i)]) for i in range(len(self.ids))]


def _sets(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Sets by rising id; rows with one id are one set."""
    own: dict[int, np.ndarray] = {}
    for i, data in sorted(zip(table["id"].to_pylist(), table["data"].to_pylist(), strict=True)):
        got = np.sort(np.frombuffer(data, dtype="<u8").astype(U64))  # they come rarest first
        own[i] = np.union1d(own[i], got) if i in own else got
    return list(own), list(own.values())


def _cluster(percent: int):
    @lean
    def run(key, table):
        ids, sets = _sets(table)
        family = Family(ids, sets, percent)
        family.run()
        got = family.result()
        return pa.table([pa.array([key[0].as_py()] * len(ids), pa.int64()), pa.array([key[1].as_py()] * len(ids), pa.int64()), pa.array([ids[i] for i, _ in got], pa.int64()), pa.array([ids[j] for _, j in got], pa.int64())], names=["family", "chunk", "a", "b"])

    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The overlaps of others with all sets, a block of rows at a time, with the index of its first row.

    Members that at least an eighth of the sets hold are counted by a product of matrices (of at most eight cells for each
    member of a set), the rest by their holders; no pair is intersected.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    own, first, many = np.unique(token[order], return_index=True, return_counts=True)
    common = (8 * many > len(sets)) & (len(sets) >= 16)
    common &= common.sum() < 1 << 24  # counts stay exact
    slot = np.cumsum(common) - 1
    held = np.zeros((int(common.sum()), len(sets)), dtype=np.float32)
    cell = common[np.repeat(np.arange(len(own)), many)]
    held[np.repeat(slot, many)[cell], holder[cell]] = 1
    length = np.array([len(o) for o in others], dtype=np.int64)
    ends = np.cumsum(length)
    lo = 0
    while lo < len(others):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - length[lo] + SOUGHT, side="right")))
        sought = np.concatenate(others[lo:hi])
        place = np.minimum(np.searchsorted(own, sought), len(own) - 1)
        hit = own[place] == sought
        row, place = np.repeat(np.arange(hi - lo), length[lo:hi])[hit], place[hit]
        cost = np.cumsum(np.bincount(row, np.where(common[place], 0, many[place]), hi - lo) + len(sets) + len(held))
        at = 0
        while at < hi - lo:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + OVERLAPS, side="right")))
            here = slice(*np.searchsorted(row, [at, end]))
            r, x = row[here] - at, place[here]
            dense = common[x]
            has = np.zeros((end - at, len(held)), dtype=np.float32)
            has[r[dense], slot[x[dense]]] = 1
            r, begin, n = r[~dense], first[x[~dense]], many[x[~dense]]
            listed = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rare = np.bincount(np.repeat(r * len(sets), n) + holder[listed], minlength=(end - at) * len(sets)).reshape(end - at, len(sets))
            yield lo + at, rare + (has @ held).astype(np.int64)
            at = end
        lo = hi


def _across(percent: int):
    """Links of a chunk's sets with sets of other chunks, one for each other set and component, except where both are in one component already.

    With a column `token`, sets meet only under the same one: members are told apart by it, so that many short lists are
    one piece of work.
    """

    def salted(table: pa.Table) -> list[np.ndarray]:
        tokens = table["token"].to_numpy().view(U64) if "token" in table.column_names else np.zeros(len(table), dtype=U64)
        return [np.frombuffer(d, dtype="<u8").astype(U64) ^ t for d, t in zip(table["data"].to_pylist(), mix(tokens), strict=True)]

    @lean
    def run(_, chunk, others):
        found = [np.zeros((0, 2), dtype=np.int64)]
        if len(chunk) and len(others):
            tokens = chunk["token"].to_pylist() if "token" in chunk.column_names else [0] * len(chunk)
            held: dict[tuple[int, int], np.ndarray] = {}  # rows with one id are one set
            for key, own in zip(zip(tokens, chunk["id"].to_pylist(), strict=True), salted(chunk), strict=True):
                held[key] = np.union1d(held[key], own) if key in held else own
            of = dict(zip(chunk["id"].to_pylist(), chunk["component"].to_pylist(), strict=True))
            ids = np.array([i for _, i in held], dtype=np.int64)
            part = np.array([of[i] for _, i in held], dtype=np.int64)
            sets, own = list(held.values()), salted(others)
            size = np.array([len(s) for s in sets])
            other, component = (others[c].to_numpy() for c in ("id", "component"))
            for at, both in overlaps(sets, own):
                n = np.array([len(o) for o in own[at : at + len(both)]])
                i, j = np.nonzero(both)
                linked = (both[i, j] >= least_overlap(size[j], n[i], percent)) & (part[j] != component[at + i])
                i, j = i[linked], j[linked]
                _, one = np.unique(np.stack([i, part[j]], axis=1), axis=0, return_index=True)
                found.append(np.stack([other[at + i[one]], ids[j[one]]], axis=1))
        got = np.concatenate(found)
        return pa.table([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], names=["a", "b"])

    return run


def _chunked(sets: DataFrame) -> DataFrame:
    """Adds to (family, id, n, data) the chunk, by a hash of the id, and how many chunks its family has."""
    many = sets.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    return sets.join(many, "family").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))


def _by_chunks(known: DataFrame, percent: int) -> DataFrame:
    """Links of members outside a family's largest component with all its chunks."""
    minor = known.where("component != main").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("chunk"), "id", "data", "component")
    chunks = known.select("family", F.pmod(F.xxhash64("id"), F.col("across")).alias("chunk"), "id", "data", "component").repartition("family", "chunk")
    return chunks.groupBy("family", "chunk").cogroup(minor.groupBy("family", "chunk")).applyInArrow(_across(percent), "a long, b long")


def _rarest(known: DataFrame, percent: int) -> DataFrame:
    """(token, id, component, n) of sets in any order: the rarest members of each, as many as its prefix has and are in more than one set; tokens stand for a member and a family."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(d.as_buffer()) // 8 for d in batch.column(4)], dtype=np.int64)
            data = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(data)] + [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in range(4)], names=["token", "family", "id", "component", "n"])

    spread = known.select("family", "id", "component", F.col("n").cast("long").alias("n"), "data").mapInArrow(members, "token long, family long, id long, component long, n long")
    spread = spread.select(F.xxhash64("family", "token").alias("token"), "id", "component", "n")
    many = spread.groupBy("token").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("many > 1")
    place = spread.join(many, "token").withColumn("place", F.dense_rank().over(Window.partitionBy("id").orderBy("many", "token")))
    place = place.withColumn("shared", F.max("place").over(Window.partitionBy("id")))
    prefix = F.col("shared") + 1 - F.ceil(percent * F.col("n") / 100)  # members that only this set has come first
    return place.where((F.col("place") <= prefix) & (F.col("lo") != F.col("hi"))).select("token", "id", "component", "n").distinct()


def _by_lists(known: DataFrame, percent: int, ordered: bool) -> DataFrame:
    """Links of members of different components that share a prefix shingle; a list that holds one component only is passed over, a long one is split.

    Where sets aren't ordered by how many hold their shingles, they are ordered so first: lists of shingles of any order
    hold what many sets share.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            many = prefix_length(n, percent)
            tokens = [np.frombuffer(d.as_py(), dtype="<i8", count=m) for d, m in zip(batch.column(3), many.tolist(), strict=True)]
            spread = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)), spread(0), spread(1), pa.array(np.repeat(n, many))], names=["token", "id", "component", "n"])

    tokens = cut(_rarest(known, percent)) if not ordered else known.select("id", "component", "n", "data").mapInArrow(prefixes, "token long, id long, component long, n long")
    alive = tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    members = cut(tokens.join(alive, "token"))
    each = members.groupBy("token", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    lists = each.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    lists = lists.withColumn("chunks", F.greatest(F.ceil(F.col("c") / LIST_SETS), F.ceil(F.col("s") / LIST_SHINGLES)))
    short = lists.where("chunks = 1").agg(F.greatest(F.ceil(F.sum("c") / LIST_SETS), F.ceil(F.sum("s") / LIST_SHINGLES)).alias("n")).first()["n"] or 1
    own = members.join(lists, "token").select("token", "id", "component", "main", "chunks", F.when(F.col("chunks") > 1, F.col("token")).otherwise(F.pmod("token", F.lit(short))).alias("list"))
    data = known.select("id", "data")
    place = lambda c: F.when(F.col("chunks") > 1, c).otherwise(F.lit(-1)).cast("long").alias("chunk")  # noqa: E731  short lists are put together
    chunks = own.select("list", place(F.pmod(F.xxhash64("id"), F.col("chunks"))), "token", "id", "component").join(data, "id").select("list", "chunk", "token", "id", "data", "component")
    minor = own.where("component != main").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("list", place(F.col("at")), "token", "id", "component")
    minor = minor.join(data, "id").select("list", "chunk", "token", "id", "data", "component")
    minor = minor.toDF(*minor.columns)  # columns of its own, for both sides come from one frame
    return chunks.groupBy("list", "chunk").cogroup(minor.groupBy("list", "chunk")).applyInArrow(_across(percent), "a long, b long")


def _links(sets: DataFrame, families: DataFrame, percent: int, ordered: bool = True) -> DataFrame:
    """Links (a, b) within families, enough to connect all that links connect; ordered says whether sets are, rarest first."""
    level = _chunked(sets.join(families.withColumnRenamed("component", "family"), "id"))
    schema = "family long, chunk long, a long, b long"
    cluster = lambda x: cut(x.select("family", "chunk", "id", "data").repartition("family", "chunk").groupBy("family", "chunk").applyInArrow(_cluster(percent), schema))
    first = cluster(level)
    large = cut(level.where("chunks > 1"))
    if large.isEmpty():
        return first.select("a", "b")
    links, now = first.select("a", "b"), first.join(large.select("family").distinct(), "family", "left_semi")
    count = None
    while True:  # leaders of chunks' components meet on further levels
        leaders = now.select(F.col("b").alias("id")).distinct()
        nodes = large.select("family", "id", "n", "data").join(leaders, "id", "left_semi")
        level = cut(_chunked(nodes))
        left = level.where("chunks > 1").count()
        now = cluster(level)
        links = links.union(now.select("a", "b"))
        if not left or (count is not None and left > 0.8 * count):
            break
        count = left
        now = now.join(level.where("chunks > 1").select("family").distinct(), "family", "left_semi")
    known = large.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = known.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    across = F.greatest(F.ceil(F.sum("c") / ACROSS_SETS), F.ceil(F.sum("s") / ACROSS_SHINGLES))
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("components"), F.sum("c").alias("members"), F.max("c").alias("largest"), across.alias("across")).where("components > 1")
    known = cut(known.join(main, "family").withColumn("few", (F.col("members") - F.col("largest")) * F.col("across") <= SPREAD * F.col("members")))
    few, many = known.where("few"), known.where("NOT few")
    links = links.union(_by_chunks(few, percent))
    return links if many.isEmpty() else links.union(_by_lists(many, percent, ordered))


def join(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, part_bytes: int = X.PART_BYTES, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key that links reach)."""
    described = cut(describe(frame.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", width))
    own = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    classes = described.where("n > 0").groupBy("n", "x", "y").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "salt"))).alias("rep"))
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_parts = max(1, -(-size // part_bytes))
    parts = X.Parts(_dealt(own, "key", "text", n_parts), n_parts, size, True)
    groups = max(16, size // (6 * group_words))
    fine = X.per_bucket(groups)
    reps = classes.where("rep is not null").select(F.pmod("rep.salt", F.lit(n_parts)).alias("part"), F.lit("rep").alias("kind"), F.col("rep.key").cast("long").alias("bucket"), F.unhex(F.hex("x")).alias("reply"))

    def chosen(docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, sets in a row, and sizes, of the part's representatives."""
        words = X.Part(docs, "key", "text", lower=True)
        sets, sizes = shingle_sets(words.hash, words.count, width)
        x, _ = _marks(sets, sizes)
        wanted = got.filter(pa.compute.equal(got["kind"], "rep"))
        wanted = {(b, int.from_bytes(r, "big", signed=False) & (1 << 64) - 1) for b, r in zip(wanted["bucket"].to_pylist(), wanted["reply"].to_pylist(), strict=True)}
        keys = words.keys.to_pylist()
        marks = [(k, int(m) & (1 << 64) - 1) for k, m in zip(keys, x, strict=True)]
        take = np.array([m in wanted for m in marks], dtype=bool)
        seen = set()
        for i in np.flatnonzero(take).tolist():  # equal rows of one key
            take[i] = marks[i] not in seen
            seen.add(marks[i])
        return np.array(keys, dtype=np.int64)[take], sets[np.repeat(take, sizes)], sizes[take]

    def entries(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles in the order they are asked for, their groups, and how many of the part's sets hold them."""
        own, many = np.unique(sets, return_counts=True)
        group = X.bucket_of(own, groups)
        order = np.argsort(group, kind="stable")
        return own[order], group[order], many[order]

    def send(_: int, docs: pa.Table, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not len(docs):
            return np.zeros(0, dtype=np.int64), np.zeros((0, 7), dtype=np.uint8)
        _, sets, _ = chosen(docs, got)
        own, group, many = entries(sets)
        return group, np.concatenate([X.pack(own, 6), _code(many)[:, None]], axis=1)

    def merge(records: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, first, of = np.unique(X.unpack(records[:, :6]), return_index=True, return_inverse=True)
        total = _code(np.bincount(of, weights=np.exp2(records[:, 6] / 8), minlength=len(values)))
        return np.concatenate([X.pack(values, 6), total[:, None]], axis=1), of, first

    def count(records: np.ndarray, senders: np.ndarray) -> np.ndarray:
        merged, of, _ = merge(records, senders)
        return merged[of, 6]

    counts = X.Question("count", 7, send, count, merge, reply=1)

    @lean
    def nodes(key_, docs, got):
        """Sets whose prefix holds a shingle of another set (kind by n: at least 0), local ties (n = -1), and lists for buckets (n = -2)."""
        part = key_[0].as_py()
        out: list[tuple[int, int, int, bytes]] = []
        if len(docs):
            keys, sets, sizes = chosen(docs, got)
            own, group, _ = entries(sets)
            by = np.argsort(own, kind="stable")
            often = counts.of(got, group, fine)[by][np.searchsorted(own[by], sets)] if len(sets) else np.zeros(0, dtype=np.uint8)
            doc = np.repeat(np.arange(len(keys)), sizes)
            rank = np.lexsort((sets, often, doc))  # rarest first within each set
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(sets)) - first[doc]
            use = (place < prefix_length(sizes, percent)[doc]) & (often[rank] > 0)
            token, holder = sets[rank][use], keys[doc[use]]
            token, holder, ties = _tied(token, holder)
            if len(ties):
                out.append((0, part, -1, ties.astype("<i8").tobytes()))
            bucket = X.bucket_of(token, groups) // fine
            order = np.argsort(bucket, kind="stable")
            listed = X.lists(part, bucket[order], np.stack([token[order], holder[order].view(U64)], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16))
            out += [(k, part, -2, d) for k, d in zip(listed["bucket"].to_pylist(), listed["list"].to_pylist(), strict=True)]
            for i in np.unique(doc[use]).tolist():
                out.append((int(keys[i]), part, int(sizes[i]), sets[rank[first[i] : first[i] + sizes[i]]].astype("<u8").tobytes()))  # rarest first
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "part", "n", "data"])

    def tie(last: bool):
        """Of each shingle's holders, one from each part, ties all to the smallest; that goes on from a block of parts to where all blocks meet."""

        @lean
        def run(key_, table):
            data = np.frombuffer(b"".join(table["data"].to_pylist()), dtype="<u8").reshape(-1, 2).astype(U64)
            token, holder, ties = _tied(data[:, 0], data[:, 1].view(np.int64))
            id_ = key_[0].as_py()
            out = [(id_, -1, ties.astype("<i8").tobytes())]
            if not last:
                bucket = X.bucket_of(token, groups)
                order = np.argsort(bucket, kind="stable")
                listed = X.lists(0, bucket[order], np.stack([token[order], holder[order].view(U64)], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16))
                out += [(k, -2, d) for k, d in zip(listed["bucket"].to_pylist(), listed["list"].to_pylist(), strict=True)]
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["id", "n", "data"])

        return run

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column(0):
                got = np.frombuffer(d.as_py(), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], names=["a", "b"])

    counted = X.ask(parts, reps, counts, groups)
    got = cut(parts.frame.groupBy("part").cogroup(reps.unionByName(counted).groupBy("part")).applyInArrow(nodes, _NODE))
    ties = got.where("n = -1").select("data")
    holders = got.where("n = -2").select("id", F.floor(F.col("part") / X.FAN).alias("block"), "data")
    if n_parts > X.FAN or fine > 1:
        met = cut(holders.groupBy("id", "block").applyInArrow(tie(False), "id long, n int, data binary"))
        ties, holders = ties.union(met.where("n = -1").select("data")), met.where("n = -2").select("id", "data")
    ties = ties.union(holders.groupBy("id").applyInArrow(tie(True), "id long, n int, data binary").where("n = -1").select("data")).mapInArrow(spread, "a long, b long")
    linked = components(_links(got.where("n >= 0").select("id", "n", "data"), components(ties), percent))
    reached = classes.select("n", "x", "y", F.col("rep.key").cast("long").alias("rep")).join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    labels = reached.select("n", "x", "y", F.coalesce("component", "rep").alias("component"))
    return (
        described.join(labels, ["n", "x", "y"], "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", F.col("key").cast("long")).alias("component_id"))
    )


def _tied(token: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the smallest holder of each, and pairs that tie the other holders to it."""
    by = np.lexsort((holder, token))
    token, holder = token[by], holder[by]
    group = X.group_ids(np.arange(len(token)), token)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    lead = holder[heads][group] if len(heads) else holder
    return token[heads], holder[heads], np.unique(np.stack([holder, lead], axis=1)[holder != lead], axis=0)
