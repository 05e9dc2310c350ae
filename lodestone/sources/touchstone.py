"""Touchstone files: a data source that reads them into long rows, and a writer of their text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stores import opened_store

SCALE = {"HZ": 1.0, "KHZ": 1e3, "MHZ": 1e6, "GHZ": 1e9}
SCHEMA = "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double, z0 double"


def ports_of(path: str) -> int:
    m = re.search(r"\.s(\d+)p$", path, re.IGNORECASE)
    if not m:
        raise ValueError(f"no port count in {path}")
    return int(m[1])


def parse(text: str, ports: int) -> Iterator[tuple[int, float, int, int, float, float, float]]:
    """(f_idx, freq_hz, i, j, re, im, z0). The last option line holds; without one: GHz, magnitude and angle, 50 ohms. Frequencies must rise."""
    unit, kind, z0 = "GHZ", "MA", 50.0
    numbers: list[float] = []
    for line in text.splitlines():
        line = line.split("!", 1)[0].strip()
        if not line:
            continue
        if line[0] == "#":
            unit, kind, z0 = "GHZ", "MA", 50.0
            words = line[1:].upper().split()
            for k, w in enumerate(words):
                if w in SCALE:
                    unit = w
                elif w in ("RI", "MA", "DB"):
                    kind = w
                elif w == "R" and k + 1 < len(words):
                    z0 = float(words[k + 1])
        else:
            numbers += map(float, line.split())
    width = 1 + 2 * ports * ports
    if len(numbers) % width:
        raise ValueError("incomplete data")
    cells = [(1, 1), (2, 1), (1, 2), (2, 2)] if ports == 2 else [(i, j) for i in range(1, ports + 1) for j in range(1, ports + 1)]
    before = -math.inf
    for k in range(0, len(numbers), width):
        freq = numbers[k] * SCALE[unit]
        if not (math.isfinite(freq) and freq > before):
            raise ValueError("frequencies must rise")
        before = freq
        for c, (i, j) in enumerate(cells):
            a, b = numbers[k + 1 + 2 * c : k + 3 + 2 * c]
            if kind != "RI":
                size = a if kind == "MA" else 10 ** (a / 20)
                a, b = size * math.cos(math.radians(b)), size * math.sin(math.radians(b))
            yield k // width + 1, freq, i, j, a, b, z0


def read(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of all files of a path or pattern; each file is a row of Spark's binary reader, so any store that Spark reads will do."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows += [(name.rsplit("/", 1)[-1].rsplit(".", 1)[0], *r) for r in parse(bytes(content).decode(), ports_of(name))]
            yield pd.DataFrame(rows, columns=["network_id", "f_idx", "freq_hz", "i", "j", "re", "im", "z0"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def lines(long: DataFrame, z0: float = 50.0) -> DataFrame:
    """(network_id, line_no, line) of files in hertz, real and imaginary parts, nine digits; 2-port order is S11, S21, S12, S22."""
    order = F.when(F.col("ports") == 2, F.col("j") * 2 + F.col("i")).otherwise(F.col("i") * F.col("ports") + F.col("j"))
    ports = long.groupBy("network_id").agg(F.max("i").alias("ports"))
    cell = F.struct(order.alias("o"), F.format_string("%.9e %.9e", "re", "im").alias("t"))
    own = long.join(ports, "network_id").groupBy("network_id", "f_idx", "freq_hz").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    data = own.select("network_id", F.col("f_idx").alias("line_no"), F.concat(F.format_string("%.9e ", "freq_hz"), F.array_join(F.transform("c", lambda x: x["t"]), " ")).alias("line"))
    return ports.select("network_id", F.lit(0).alias("line_no"), F.lit(f"# HZ S RI R {z0:g}").alias("line")).union(data)


def write(long: DataFrame, folder: str, z0: float = 50.0, impedances: DataFrame | None = None) -> DataFrame:
    """Writes one .sNp file for each network into the folder, a URI, and returns (network_id, file, points), lazily.

    impedances (network_id, port, z0) are told in comments, one for each port. A network is a file, so it fits a task.
    """
    ports = long.groupBy("network_id").agg(F.max("i").alias("ports"))
    own = lines(long, z0).join(ports, "network_id")
    if impedances is not None:
        told = impedances.select("network_id", (F.col("port") - 1000).alias("line_no"), F.concat(F.lit("! Port["), F.col("port").cast("string"), F.lit("] = "), F.col("z0").cast("double").cast("string")).alias("line"))
        own = own.union(told.join(ports, "network_id"))

    def run(key, rows):
        import uuid

        import pandas as pd

        store, path = opened_store(folder)
        store.create_dir(path, recursive=True)
        rows = rows.sort_values("line_no")
        name, temp = f"{key[0]}.s{rows['ports'].iloc[0]}p", f"{path}/_{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as file:
            file.write(("\n".join(rows["line"]) + "\n").encode())
        store.move(temp, f"{path}/{name}")
        return pd.DataFrame([(key[0], name, int((rows["line_no"] > 0).sum()))], columns=["network_id", "file", "points"])

    return own.groupBy("network_id").applyInPandas(run, "network_id string, file string, points bigint")
