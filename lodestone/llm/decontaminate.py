"""Operator 6: benchmark decontamination by spaced seeds, in DataFrame functions only.

Tokens are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A mask names which of `SPAN`
tokens from a position count; a seed is the hash of those. Seeds of all positions of all documents are joined with the
benchmark's; a hit gives an alignment (document, item, offset). Each alignment is then verified token by token: it is a
leak if, somewhere along it, a window of `window` tokens (or the whole item, if shorter) agrees in at least `percent` of
its tokens. So substituted tokens are tolerated around hits, and between the tokens that a mask looks at.

Items shorter than a window are judged whole, and may hide from all masks, or be shorter than these. They have an exact way
besides: such an item may differ in s tokens at most, so of s + 1 runs that it is cut into, one stays as it is. Runs are
joined with the documents' runs of those lengths, which are only made where the benchmark has such items. An item that must
agree as a whole is its own run, and its first place in a document decides.

Contract: null and empty texts, and items without tokens, have no seeds, no runs and no leaks; every row of a repeated
key (of documents or of items) is judged, and the key has the best of their windows; a null key matches nothing; empty
tables give no rows; other columns don't matter. A document's tokens are one array, whose copies under the masks are made
a block of positions at a time: a text of 49 MB (7.6 million words) passes with a heap of 1800 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import cut

#: Positions that each mask looks at; between them lie the ones that it ignores.
MASKS = ((0, 1, 2, 4, 7), (0, 2, 3, 6, 7), (0, 1, 4, 5, 7))
SPAN = 8
WINDOW, PERCENT = 13, 80
#: Positions whose tokens are laid side by side at a time.
BLOCK = 4096
#: Rows of a side that may be broadcast; beyond that it is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_TOKENS = 2_000_000
#: Slots that seeds fall into: which of them a benchmark fills is broadcast, at most that many longs, where its seeds are too many to be.
SLOTS = 1 << 21
_SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def tokens(text: str) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SEPARATORS), lambda x: x != ""), lambda x: F.xxhash64(x))


def _spaced(frame: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, position, seed) of all positions of the arrays t: shifted copies side by side, so that all hashing is compiled. A seed's hash holds its mask's number."""
    blocks = F.transform(F.sequence(F.lit(0), F.size("t") - SPAN, F.lit(BLOCK)), lambda i: F.struct(i.alias("first"), F.slice("t", i + 1, F.lit(BLOCK + SPAN - 1)).alias("u")))
    some = frame.where(F.size("t") >= SPAN).select(*keys, F.explode(blocks).alias("block"))
    n = F.size("block.u") - (SPAN - 1)
    shifted = F.arrays_zip(*[F.slice("block.u", i + 1, n).alias(f"t{i}") for i in range(SPAN)])
    rows = some.select(*keys, "block.first", F.posexplode(shifted).alias("place", "s")).select(*keys, (F.col("first") + F.col("place")).alias(position), "s")
    seeds = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"s.t{i}") for i in mask]) for k, mask in enumerate(MASKS)])
    return rows.select(*keys, position, F.explode(seeds).alias("seed"))


def _runs(items: DataFrame, item: str, window: int, percent: int) -> DataFrame:
    """(item, b, item_at, width, exact, seed) of the runs that each item of fewer than `window` tokens is cut into: one more than the tokens that may differ."""
    parts = F.expr(f"size(t) * {100 - percent} div 100 + 1").cast("int")
    edge = lambda k: F.floor(k * F.size("t") / F.col("parts")).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(edge(k).alias("item_at"), (edge(k + 1) - edge(k)).alias("width")))
    cut_up = items.where(F.size("t").between(1, window - 1)).withColumn("parts", parts).select(item, "b", "t", (F.col("parts") == 1).alias("exact"), F.inline(ranges))
    return cut_up.select(item, "b", "item_at", "width", "exact", F.xxhash64("width", F.slice("t", F.col("item_at") + 1, F.col("width"))).alias("seed"))


def _run_seeds(frame: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """(keys, at, seed) of all runs of those widths in the arrays t, a block of positions at a time."""
    longest = max(widths)
    blocks = F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(BLOCK)), lambda i: F.struct(i.alias("first"), F.slice("t", i + 1, F.lit(BLOCK + longest - 1)).alias("u")))
    some = frame.where(F.size("t") > 0).select(*keys, F.explode(blocks).alias("block"))
    n = F.least(F.size("block.u"), F.lit(BLOCK))
    # the last block has fewer tokens beyond its positions: what is missing there is null, and so is a run that needs it
    shifted = F.arrays_zip(F.slice("block.u", 1, n).alias("t0"), *[F.slice("block.u", i + 1, n).alias(f"t{i}") for i in range(1, longest)])
    rows = some.select(*keys, "block.first", F.posexplode(shifted).alias("place", "s")).select(*keys, (F.col("first") + F.col("place")).alias("at"), "s")
    seeds = F.array(*[F.when(F.col(f"s.t{w - 1}").isNotNull(), F.xxhash64(F.lit(w), *[F.col(f"s.t{i}") for i in range(w)])) for w in widths])
    return rows.select(*keys, "at", F.explode(seeds).alias("seed")).where("seed IS NOT NULL")


def small(frame: DataFrame) -> DataFrame:
    """The frame, for broadcasting if it has few rows: that is counted, one row beyond the bound at most."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def _met(wanted: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The benchmark's seeds and the documents', ready to be joined."""
    if (few := small(wanted)) is wanted:  # a shuffle follows: seeds in slots that no item fills stay out of it
        slot = F.pmod("seed", F.lit(SLOTS))
        filled = F.broadcast(wanted.select(slot.alias("slot")).distinct())
        own = own.join(filled, slot == F.col("slot"), "left_semi")
    return few, own


def alignments(docs: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct (key, digest, item, b, offset) of seed hits; a document's position is an item's position plus the offset."""
    wanted = cut(_spaced(items, [item, "b"], "item_at").distinct())
    few, own = _met(wanted, _spaced(docs, [key, "digest"], "at"))
    # a hit of one mask is as good as another's; of a seed that an item holds many times, all places count
    hits = own.join(few, "seed")
    return hits.select(key, "digest", item, "b", (F.col("at") - F.col("item_at")).alias("offset")).distinct()


def _short_leaks(docs: DataFrame, items: DataFrame, key: str, item: str, window: int, percent: int) -> DataFrame | None:
    """(key, item, best) of items shorter than a window, by their runs; None where there are none."""
    wanted = cut(_runs(items, item, window, percent))
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # fewer than `window` numbers
    if not widths:
        return None
    few, own = _met(wanted, _run_seeds(docs, [key, "digest"], widths))
    hits = own.join(few, "seed").select(key, "digest", item, "b", "exact", "width", (F.col("at") - F.col("item_at")).alias("offset")).where("offset >= 0")
    whole = hits.where("exact").groupBy(key, item, "width").agg(F.min("offset").alias("at"))
    out = whole.select(key, item, F.struct(F.col("width").alias("n"), (-F.col("at")).alias("at"), (-F.col("width")).alias("w")).alias("best"))
    if percent == 100:
        return out
    # places in a document of an item are no more than its tokens, which are one array
    places = cut(hits.where("NOT exact").groupBy(key, "digest", item, "b").agg(F.collect_set("offset").alias("offsets")))
    texts = docs.join(small(places.select(key).distinct()), key, "left_semi").dropDuplicates([key, "digest"])
    pairs = places.join(items.withColumnRenamed("t", "item_t"), [item, "b"]).join(texts, [key, "digest"])
    w = F.size("item_t")
    inside = F.filter("offsets", lambda o: o + w <= F.size("t"))
    agree = lambda o: F.aggregate(F.zip_with(F.slice("t", o + 1, w), F.col("item_t"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    best = F.array_max(F.transform(inside, lambda o: F.struct(agree(o).alias("n"), (-o).alias("at"), (-w).alias("w"))))
    return out.union(pairs.select(key, item, best.alias("best")).where(F.col("best.n") * 100 >= F.lit(percent) * -F.col("best.w")))


def leaks(frame: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """One row per key and item that any of its rows leaks: key, item, n_matches (agreeing tokens in the best window), window_tokens, first_token (of the first best window)."""
    items = cut(benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("own_item"), tokens(item_text).alias("t")).distinct().withColumn("b", F.xxhash64("t")).withColumnRenamed("own_item", item))
    rows = frame.where(F.col(key).isNotNull()).select(F.col(key).alias("own_key"), tokens(text).alias("t")).withColumn("digest", F.xxhash64("t")).withColumnRenamed("own_key", key)
    short = _short_leaks(rows, items, key, item, window, percent)
    hits = cut(alignments(rows, items, key, item))
    hit_docs = hits.select(key).distinct()
    # only documents with hits are split into tokens again
    found = frame.select(key, text).join(small(hit_docs), key, "left_semi").select(key, tokens(text).alias("t")).withColumn("digest", F.xxhash64("t"))
    own = found.join(small(hits.select(key, "digest").distinct()), [key, "digest"], "left_semi").dropDuplicates([key, "digest"])
    known = items.withColumnRenamed("t", "item_t")
    held = items.agg(F.sum(F.size("t")).alias("n")).first()["n"] or 0
    pairs = hits.join(F.broadcast(known) if held <= BROADCAST_TOKENS else known, [item, "b"]).join(own, [key, "digest"])
    lo, hi = F.greatest(F.col("offset"), F.lit(0)), F.least(F.size("t"), F.col("offset") + F.size("item_t"))
    pairs = pairs.withColumn("lo", lo).withColumn("n", hi - lo).withColumn("w", F.least(F.lit(window), F.size("item_t")))
    agree = F.zip_with(F.slice("t", F.col("lo") + 1, F.col("n")), F.slice("item_t", F.col("lo") - F.col("offset") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    judged = pairs.where("n >= w").select(key, item, "lo", "w", agree.alias("m"))
    starts = F.sequence(F.lit(1), F.size("m") - F.col("w") + 1)
    sums = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice("m", i, F.col("w")), F.lit(0), lambda s, x: s + x).alias("n"), (-(F.col("lo") + i - 1)).alias("at"), (-F.col("w")).alias("w")))
    best = judged.select(key, item, "w", F.array_max(sums).alias("best")).where(F.col("best.n") * 100 >= F.lit(percent) * F.col("w"))
    best = best.select(key, item, "best")
    best = best if short is None else best.union(short)
    return best.groupBy(key, item).agg(F.max("best").alias("best")).select(key, item, F.col("best.n").cast("long").alias("n_matches"), (-F.col("best.w")).cast("long").alias("window_tokens"), (-F.col("best.at")).cast("long").alias("first_token"))


def remove(frame: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of documents that leak nothing, null keys among them, with all their columns."""
    found = cut(leaks(frame, benchmark, key, **options).select(key).distinct())
    return frame.join(small(found), key, "left_anti")


def oracle_sql(window: int = WINDOW, percent: int = PERCENT) -> str:
    """The same result for DuckDB: alignments by equality of the tokens under a mask, and all places of items shorter than a window."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '')"
    seed = "UNION ALL ".join(f"SELECT id, i AS at, {k} AS mask, concat_ws(' ', {', '.join(f't[i + {p}]' for p in mask)}) AS seed FROM {{0}} " for k, mask in enumerate(MASKS))
    places = "(SELECT id, t, unnest(range(1, len(t) - {span} + 2)) AS i FROM {table} WHERE len(t) >= {span})"
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT doc_id AS key, {split} AS t FROM documents WHERE doc_id IS NOT NULL)),
    items AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT item_id AS key, {split} AS t FROM benchmark WHERE item_id IS NOT NULL)),
    doc_seeds AS ({seed.format(places.format(span=SPAN, table="docs"))}),
    item_seeds AS ({seed.format(places.format(span=SPAN, table="items"))}),
    hits AS (SELECT DISTINCT d.id AS doc, i.id AS item, d.at - i.at AS shift FROM doc_seeds d JOIN item_seeds i USING (mask, seed)
        UNION SELECT d.id, i.id, unnest(range(0, len(d.t) - len(i.t) + 1)) FROM docs d JOIN items i ON len(i.t) BETWEEN 1 AND {window - 1} AND len(i.t) <= len(d.t)),
    placed AS (SELECT d.key AS doc_id, i.key AS item_id, d.t, i.t AS b, shift, greatest(shift, 0) AS lo, least(len(d.t), shift + len(i.t)) - greatest(shift, 0) AS n, least({window}, len(i.t)) AS w
        FROM hits h JOIN docs d ON d.id = h.doc JOIN items i ON i.id = h.item),
    starts AS (SELECT doc_id, item_id, t, b, shift, w, unnest(range(lo, lo + n - w + 1)) AS s FROM placed WHERE n >= w),
    counted AS (SELECT doc_id, item_id, w, s, len(list_filter(range(1, w + 1), lambda j: t[s + j] = b[s - shift + j])) AS m FROM starts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, s, w) AS r FROM counted WHERE m * 100 >= {percent} * w)
    SELECT doc_id, item_id, CAST(m AS BIGINT) AS n_matches, CAST(w AS BIGINT) AS window_tokens, CAST(s AS BIGINT) AS first_token FROM ranked WHERE r = 1"""
