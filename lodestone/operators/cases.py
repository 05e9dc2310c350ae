"""Cases as trees of files: hashes folded level by level, fingerprints, what changed, layout.

Files (case_id, path, digest): paths relative to the case, parts joined by /, digest the content's hash in hex. A folder's
hash is that of its sorted lines name:hash. Folders of more than FAN entries are folded through buckets of their names'
hashes first, so that no group grows with a folder; the shape depends on the folder's own entries only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import cut, stored
from lodestone.sources import variants

#: Entries that a folder's hash is made of at once, on average, before its names are dealt to 16 times as many buckets.
FAN = 256
#: Rows of a side that is sent to all tasks, at most.
SENT = 100_000


def _folded(entry: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256)


def _parent() -> Column:
    return F.substring("path", F.lit(1), F.length("path") - F.length(_name()) - 1)


def _name() -> Column:
    return F.substring_index("path", "/", -1)


def _sent(frame: DataFrame, n: int) -> DataFrame:
    return F.broadcast(frame) if n <= SENT else frame


def _folders(entries: DataFrame, deepest: int | None) -> DataFrame:
    """(case_id, folder, hash) of entries (case_id, folder, name, hash), by way of buckets of that many digits at most."""
    digits = F.ceil(F.log(F.col("n") / FAN) / F.log(F.lit(16.0))).cast("int")
    many = entries.groupBy("case_id", "folder").agg(F.count("*").alias("n")).where(F.col("n") > FAN)
    many = cut(many.select("case_id", "folder", (digits if deepest is None else F.least(digits, F.lit(deepest))).alias("digits")))
    got = many.agg(F.max("digits").alias("digits"), F.count("*").alias("n")).first()
    deepest = got["digits"] or 0
    own = entries.join(_sent(many, got["n"]), ["case_id", "folder"], "left") if deepest else entries.withColumn("digits", F.lit(0))
    own = own.withColumn("digits", F.coalesce("digits", F.lit(0))).withColumn("key", F.sha2("name", 256))
    for d in range(deepest, 0, -1):
        bucket = F.substring("key", 1, d)
        line = F.concat("name", F.lit(":"), "hash")
        folded = own.where(F.col("digits") >= d).groupBy("case_id", "folder", "digits", bucket.alias("key")).agg(_folded(line).alias("hash"))
        own = own.where(F.col("digits") < d).unionByName(folded.withColumn("name", F.col("key")))
    return own.groupBy("case_id", "folder").agg(_folded(F.concat("name", F.lit(":"), "hash")).alias("hash"))


def leaf_folders(files: DataFrame, *same: str) -> DataFrame:
    """(case_id, path, hash) of the folders of files (case_id, path, digest) that hold nothing but these; each is folded at once, however large.

    `same` names columns whose values all files of a folder share: where a join on them has put such rows together,
    nothing is shuffled for the folders. Repeated rows, nulls and a path with two digests are as in tree_hashes.
    """
    own = files.select("case_id", _parent().alias("path"), _name().alias("name"), F.col("digest").alias("hash"), *same).dropna(subset=["case_id", "path", "name", "hash"])
    held = own.groupBy("case_id", "path", *same).agg(F.collect_set(F.struct("name", "hash")).alias("held"))
    lines = F.array_sort(F.transform("held", lambda x: F.concat(x["name"], F.lit(":"), x["hash"])))
    twice = F.size(F.array_distinct(F.transform("held", lambda x: x["name"]))) < F.size("held")
    out = stored(held.select("case_id", "path", F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), twice.alias("twice")), "folders")
    if not out.where("twice").isEmpty():
        raise ValueError("a path of a case has more than one digest")
    return out.drop("twice")


def tree_hashes(files: DataFrame, deepest: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """(case_id, path, kind, hash) of all files and folders; a case's own folder has the path "".

    Buckets have as many digits as a folder needs, or `deepest` at most: then groups grow with folders of more than
    FAN * 16 ** deepest entries. Folders (case_id, path, hash) that were folded already may be given as `done`, with all
    that they hold; their files are not among `files` nor in the result.

    Repeated rows of one file count once; a path with two digests raises an error, as does one that is both file and folder.
    Rows with a null count for nothing. Rounds are as many as paths are deep.
    """
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    own = files.select("case_id", "path", F.col("digest").alias("hash")).dropna().distinct()
    own = cut(own.withColumn("depth", depth))
    twice = own.groupBy("case_id", "path").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a path of a case has more than one digest")
    out = own.select("case_id", "path", F.lit("file").alias("kind"), "hash")
    got = own.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    last, paths = got["depth"] or 0, _sent(own.select("case_id", "path"), got["n"])
    if done is not None:
        done = done.withColumn("depth", depth)
        last = max(last, done.agg(F.max("depth")).first()[0] or 0)
        below = own.withColumn("path", _parent()).select("case_id", "path").distinct()
        if not done.join(_sent(below.union(own.select("case_id", "path")), got["n"]), ["case_id", "path"], "left_semi").isEmpty():
            raise ValueError("a folder that is done is a file or holds another file")
        out = out.union(done.select("case_id", "path", F.lit("folder"), "hash"))
    folders = None
    for d in range(last, 0, -1):
        level = own.where(F.col("depth") == d).select("case_id", "path", "hash")
        level = level if done is None else level.union(done.where(F.col("depth") == d).select("case_id", "path", "hash"))
        level = level if folders is None else level.union(folders)
        if folders is not None and not folders.join(paths, ["case_id", "path"], "left_semi").isEmpty():
            raise ValueError("a path of a case is a file and a folder")
        folders = cut(_folders(level.select("case_id", _parent().alias("folder"), _name().alias("name"), "hash"), deepest).select("case_id", F.col("folder").alias("path"), "hash"))
        out = out.union(folders.select("case_id", "path", F.lit("folder"), "hash"))
    return out


def configuration_hashes(cases: DataFrame) -> DataFrame:
    """(case_id, config_hash) of JSON texts (case_id, config), whatever the order of their names. Null values count as absent."""
    found = variants.leaves(cases, "config", ["case_id"])
    own = found.groupBy("case_id").agg(_folded(F.concat("path", F.lit("="), "value")).alias("config_hash"))
    return cases.select("case_id").distinct().join(own, "case_id", "left").withColumn("config_hash", F.coalesce("config_hash", F.sha2(F.lit(""), 256)))


def fingerprints(nodes: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, root, config_hash, fingerprint) of cases (case_id, config, toolchain): one hash over all files, the configuration and the tools' digest."""
    root = nodes.where("path = '' AND kind = 'folder'").select("case_id", F.col("hash").alias("root"))
    own = cases.select("case_id", F.coalesce("toolchain", F.lit("")).alias("toolchain")).join(configuration_hashes(cases), "case_id").join(root, "case_id", "left")
    empty = F.sha2(F.lit(""), 256)
    own = own.withColumn("root", F.coalesce("root", empty))
    return own.select("case_id", "root", "config_hash", F.sha2(F.concat_ws("\n", "root", "config_hash", "toolchain"), 256).alias("fingerprint"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, path, kind, change) of nodes that were added, removed or changed."""
    keys = ["case_id", "path", "kind"]
    both = before.withColumnRenamed("hash", "old").join(after.withColumnRenamed("hash", "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def layout(files: DataFrame, required: tuple[str, ...] = ("oracle_case.json",), filled: tuple[str, ...] = ("fab/gerbers",), forbidden: tuple[str, ...] = (".env",), case_name: str = "^[A-Z0-9][A-Za-z0-9_-]*$", file_name: str = "^[A-Za-z0-9._-]+$", strict: bool = True) -> DataFrame:
    """(case_id, missing, empty_folders, n_forbidden, n_bad_names, valid): required files and filled folders that aren't there, forbidden files, names out of pattern.

    Bad file names don't make a case invalid, forbidden files only in strict form.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    has = [F.count_if(F.col("path") == p).alias(f"r{i}") for i, p in enumerate(required)] + [F.count_if(F.startswith("path", F.lit(p + "/"))).alias(f"f{i}") for i, p in enumerate(filled)]
    own = files.groupBy("case_id").agg(*has, F.count_if(name.isin(*forbidden)).alias("n_forbidden"), F.count_if(~name.rlike(file_name)).alias("n_bad_names"))
    lacking = lambda c, names: F.filter(F.array(*[F.when(F.col(f"{c}{i}") == 0, F.lit(n)) for i, n in enumerate(names)]).cast("array<string>"), lambda x: x.isNotNull())
    own = own.select("case_id", lacking("r", required).alias("missing"), lacking("f", filled).alias("empty_folders"), "n_forbidden", "n_bad_names")
    fine = (F.size("missing") == 0) & (F.size("empty_folders") == 0) & F.col("case_id").rlike(case_name)
    return own.withColumn("valid", fine & (F.col("n_forbidden") == 0) if strict else fine)
