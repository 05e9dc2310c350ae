"""Kernels on whole series that SQL can't express: transforms run on each network's group, which is bounded by its frequency points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def window(kind: str, k: Column, n: Column) -> Column:
    """Weight of sample k of n."""
    turn = 2 * F.pi() * k / F.greatest(n - 1, F.lit(1))
    if kind == "none":
        return F.lit(1.0)
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(turn)
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(turn)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)
    if kind == "tukey":  # cosine ends over half of the samples; the left one starts at 0, the right one ends a step above it
        ends = F.floor(n / 4)
        rise = lambda at: 0.5 * (1 - F.cos(F.pi() * at / F.greatest(ends, F.lit(1))))
        return F.when(k >= n - ends, rise(n - k)).when(k < ends, rise(k)).otherwise(F.lit(1.0))
    if kind == "kaiser":  # beta 14; the Bessel function by its series, whose terms fall below 1e-17 of the sum
        half = lambda x: sum((F.pow(x / 2, F.lit(float(m))) / float(math.factorial(m))) * (F.pow(x / 2, F.lit(float(m))) / float(math.factorial(m))) for m in range(1, 40)) + F.lit(1.0)
        x = 2 * k / F.greatest(n - 1, F.lit(1)) - 1
        return half(14.0 * F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))) / half(F.lit(14.0))
    raise ValueError(kind)


#: Largest loss between two bins, in dB.
SCALLOPING = {"none": 3.92, "hann": 1.42, "hamming": 1.75, "blackman": 1.10, "kaiser": 1.0, "tukey": 2.0}


def normalised_window(kind: str, k: Column, n: Column, by: WindowSpec) -> Column:
    """Weights divided by their mean over a series (the window's partition), so that a constant keeps its level."""
    own = window(kind, k, n)
    mean = F.avg(own).over(by)
    return F.when(mean > 0, own / mean).otherwise(own)


def window_metrics(samples: DataFrame, by: str, kind: str) -> DataFrame:
    """by, coherent_gain, noise_bandwidth (bins), processing_gain_db, scalloping_db of the window over each series (by, k, n)."""
    w = window(kind, F.col("k").cast("double"), F.col("n"))
    own = samples.groupBy(by).agg(F.avg(w).alias("coherent_gain"), F.sum(w * w).alias("_e"), F.count("*").alias("_n"))
    own = own.withColumn("noise_bandwidth", F.try_divide(F.col("_e"), F.col("coherent_gain") * F.col("coherent_gain") * F.col("_n")))
    return own.select(by, "coherent_gain", "noise_bandwidth", F.when(F.col("noise_bandwidth") > 0, 10 * F.log10(F.col("_n") / F.col("noise_bandwidth"))).otherwise(F.lit(0.0)).alias("processing_gain_db"), F.lit(SCALLOPING[kind]).alias("scalloping_db"))


def thru(grid: DataFrame, ports: int = 2) -> DataFrame:
    """A network without loss or reflection on a grid (network_id, freq_hz): every port passes to its neighbour."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0 if i != j and (i - 1) // 2 == (j - 1) // 2 else 0.0).alias("re"), F.lit(0.0).alias("im")) for i in range(1, ports + 1) for j in range(1, ports + 1)])
    return grid.select("network_id", "freq_hz", F.inline(cells))


def causality(long: DataFrame, tolerance: float = 1e-3, warn: float = 1e-2) -> DataFrame:
    """network_id, ratio of the energy before the response, status; from the transmission S21 by an inverse transform."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("freq_hz")
        f, s = own["freq_hz"].to_numpy(), own["re"].to_numpy() + 1j * own["im"].to_numpy()
        n = max(4 * len(f), 512)
        grid = np.arange(n // 2 + 1) * (2 * f[-1] / (n // 2))
        half = np.interp(grid, f, s.real) + 1j * np.interp(grid, f, s.imag)
        half[0], half[-1] = half[0].real, half[-1].real
        response = np.fft.irfft(half, n)
        total = float((response**2).sum())
        ratio = float((response[n // 2 :] ** 2).sum() / total) if total > 0 else 0.0
        return pd.DataFrame({"network_id": [key[0]], "ratio": [ratio], "status": ["PASS" if ratio <= tolerance else "WARN" if ratio <= warn else "FAIL"]})

    return long.where("i = 2 AND j = 1").select("network_id", "freq_hz", "re", "im").groupBy("network_id").applyInPandas(run, "network_id string, ratio double, status string")


def extract(signals: DataFrame, z0: float, grid_hz: list[float]) -> DataFrame:
    """S-parameters from port series (network_id, excite, port, k, t_s, v, i): waves, transforms, ratio to the excited port's incident wave, on a grid of frequencies."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["port", "k"])
        waves = {}
        for port, p in own.groupby("port"):
            v, i, t = p["v"].to_numpy(), p["i"].to_numpy(), p["t_s"].to_numpy()
            f = np.fft.rfftfreq(len(v), float(np.mean(np.diff(t))) if len(t) > 1 else 1.0)  # one sample: a constant
            waves[port] = (f, np.fft.rfft((v + z0 * i) / (2 * np.sqrt(z0))), np.fft.rfft((v - z0 * i) / (2 * np.sqrt(z0))))
        a = waves[key[1]][1]
        rows = []
        for port, (f, _, b) in waves.items():
            s = np.where(np.abs(a) > 1e-15, b / np.where(np.abs(a) > 1e-15, a, 1), 0)
            rows += [(key[0], n + 1, g, int(port), int(key[1]), float(np.interp(g, f, s.real)), float(np.interp(g, f, s.imag))) for n, g in enumerate(grid_hz)]
        return pd.DataFrame(rows, columns=["network_id", "f_idx", "freq_hz", "i", "j", "re", "im"])

    return signals.groupBy("network_id", "excite").applyInPandas(run, "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double")


def eigenvalues(long: DataFrame) -> DataFrame:
    """Largest eigenvalue of S times its conjugate transpose at each frequency, for any number of ports."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        n = int(own[["i", "j"]].to_numpy().max())
        s = np.zeros((n, n), dtype=complex)
        s[own["i"] - 1, own["j"] - 1] = own["re"] + 1j * own["im"]
        return pd.DataFrame({"network_id": [key[0]], "f_idx": [key[1]], "eig": [float(np.linalg.svd(s, compute_uv=False)[0] ** 2)]})

    return long.groupBy("network_id", "f_idx").applyInPandas(run, "network_id string, f_idx int, eig double")


def renormalise(long: DataFrame, old: float, new: float) -> DataFrame:
    """S-parameters at another reference impedance, by way of reflection matrices: S' = (S - r)(1 - r S)^-1 with r = (new - old) / (new + old)."""
    r = (new - old) / (new + old)

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        n = int(own[["i", "j"]].to_numpy().max())
        s = np.zeros((n, n), dtype=complex)
        s[own["i"] - 1, own["j"] - 1] = own["re"] + 1j * own["im"]
        out = (s - r * np.eye(n)) @ np.linalg.pinv(np.eye(n) - r * s)
        own = own.sort_values(["i", "j"])
        value = out[own["i"] - 1, own["j"] - 1]
        return own.assign(re=value.real, im=value.imag)

    return long.groupBy("network_id", "f_idx").applyInPandas(run, long.schema)
