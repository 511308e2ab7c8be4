"""Bootstrap intervals with numpy's own draws, so that a seed names the same resamples everywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Drawn places held at once. Drawing fewer resamples at a time gives the same stream.
PLACES = 4_000_000
#: The same where a place picks one of a few kinds: so many and the kinds they pick fit a core's cache.
PICKS = 1 << 16


def bootstrap(values: np.ndarray, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Mean and percentile interval of the mean; sums are taken around the first value, so constants stay exact."""
    values = np.asarray(values, dtype=float)
    if values.ndim != 1 or not values.size or not np.isfinite(values).all() or resamples < 1 or not 0 < confidence < 1:
        raise ValueError("finite differences, at least one resample and a confidence in (0, 1) are needed")
    around, draw, means = values - values[0], np.random.default_rng(seed), np.empty(resamples)
    step = max(1, PLACES // values.size)
    for at in range(0, resamples, step):
        rows = min(step, resamples - at)
        means[at : at + rows] = around[draw.integers(0, values.size, size=(rows, values.size))].mean(axis=1)
    tail = (1 - confidence) / 2
    low, high = np.quantile(means + values[0], [tail, 1 - tail])
    return float(values[0] + around.mean()), float(low), float(high)


def bootstrap_by(rows: DataFrame, key: str, problem: str, difference: str, resamples: int = 10_000, seed: int = 0, places: int = 5) -> DataFrame:
    """key, problems, mean, low, high, a section a task: its differences, eight bytes a problem, in the problems' order.

    Null differences are left out; a section of nothing else has null figures.
    """

    def figures(batch: pd.DataFrame) -> pd.DataFrame:
        read = batch.dropna(subset=["d"]).sort_values("p", kind="stable")["d"].to_numpy()
        found = [round(x, places) for x in bootstrap(read, resamples, seed=seed)] if len(read) else [None] * 3
        return pd.DataFrame([[batch["k"].iloc[0], len(read), *found]], columns=["k", "problems", "mean", "low", "high"])

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("k"), F.col(problem).alias("p"), F.col(difference).cast("double").alias("d"))
    return asked.groupBy("k").applyInPandas(figures, f"k {kind}, problems bigint, mean double, low double, high double").withColumnRenamed("k", key)


def numbers_kept(n: int, start: int, stop: int, seed: int) -> int:
    """Of the seed's 32-bit numbers from start to stop (both even), how many numpy takes for places below n; it passes over
    the others (Lemire), so a draw's place in the stream follows from this count of all numbers before it."""
    source, kept, bar = np.random.default_rng(seed).bit_generator, 0, np.uint32(2**32 % n)
    source.advance(start // 2)
    for at in range(start, stop, PICKS):
        numbers = source.random_raw(min(PICKS, stop - at) // 2).astype("<u8", copy=False).view("<u4")
        kept += np.count_nonzero(numbers * np.uint32(n) >= bar)
    return kept


def stream_from(n: int, place: int, before: np.ndarray, step: int, seed: int) -> np.random.Generator:
    """numpy's generator once it has drawn ``place`` places below n. before[i]: how many of the first i * step numbers it keeps."""
    at = int(np.searchsorted(before, place, side="right")) - 1
    draw = np.random.default_rng(seed)
    draw.bit_generator.advance(at * step // 2)
    for skipped in range(int(before[at]), place, PICKS):
        draw.integers(0, n, size=min(PICKS, place - skipped))
    return draw


def resampled_sums(kinds: np.ndarray, values: np.ndarray, rows: int, draw: np.random.Generator) -> np.ndarray:
    """Sums of the columns of values[kinds] over each of ``rows`` resamples. Kinds are counted, so memory is bounded by them."""
    n, k = len(kinds), len(values)
    sums, step = np.empty((rows, values.shape[1])), max(1, PICKS // n)
    finite, missing = np.nan_to_num(values), np.isnan(values)
    for at in range(0, rows, step):
        some = min(step, rows - at)
        if n <= PICKS:
            own = kinds.take(draw.integers(0, n, size=(some, n))) + k * np.arange(some)[:, None]
            counts = np.bincount(own.ravel(), minlength=some * k).reshape(some, k)
        else:  # one resample, in pieces
            counts, piece = np.zeros((1, k), np.int64), max(PICKS, k)
            for drawn in range(0, n, piece):
                counts[0] += np.bincount(kinds.take(draw.integers(0, n, size=min(piece, n - drawn))), minlength=k)
        sums[at : at + some] = counts @ finite
        if missing.any():
            sums[at : at + some][counts @ missing > 0] = np.nan
    return sums
