"""Terrain from a raster: tiles with halos, bare earth, quantised cells with identical shared edges.

A raster is rows (row, col, h). Its samples are dealt to square tiles once, each also to the tiles whose
halo holds it, so a filter is one task's work a tile, whatever the raster's size, and gives the
same value on both sides of a tile's edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import written
from geoloom.operators.spatial import bilinear, spread

TILE = 256


def halo_tiles(raster: DataFrame, tile: int, halo: int) -> DataFrame:
    """(tr, tc, row, col, h): each sample for its tile and for those whose halo holds it; no more than four while 2 * halo <= tile."""
    across = [F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))) for c in ("row", "col")]
    return raster.select("row", "col", "h", across[0].alias("tr")).select("*", across[1].alias("tc"))


class Extent:
    """Rows and columns of a raster, beyond which the samples of its edge count as repeated."""

    def __init__(self, low: tuple[int, int], high: tuple[int, int]):
        self.low, self.high = low, high

    def repeated(self, values: np.ndarray, first: list[int]) -> np.ndarray:
        """Values from row first[0] and column first[1] on, with what lies outside taken from the edge."""
        for axis in (0, 1):
            at = np.clip(np.arange(values.shape[axis]) + first[axis], self.low[axis], self.high[axis]) - first[axis]
            values = values.take(at, axis)
        return values


Step = tuple[int, int, Callable[[np.ndarray], np.ndarray]]


def moved(values: np.ndarray, axis: int, radius: int, reduce: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """``reduce`` of the values at offsets -radius .. radius along an axis; the result is 2 * radius shorter."""
    n = values.shape[axis] - 2 * radius
    return reduce([values.take(np.arange(k, k + n), axis) for k in range(2 * radius + 1)])


def _lowest(parts: list[np.ndarray]) -> np.ndarray:
    return np.fmin.reduce(parts)


def _highest(parts: list[np.ndarray]) -> np.ndarray:
    return np.fmax.reduce(parts)


def _weighted(weights: list[float]) -> Callable[[list[np.ndarray]], np.ndarray]:
    def mean(parts: list[np.ndarray]) -> np.ndarray:
        out = weights[0] * parts[0]
        for w, p in zip(weights[1:], parts[1:], strict=True):
            out = out + w * p
        return out

    return mean


def filtered(raster: DataFrame, steps: list[tuple[int, int, Callable]], tile: int = TILE) -> DataFrame:
    """The raster after ``steps`` of (axis, radius, reduce), each over edge samples repeated; one group a tile.

    A sample that is missing or null counts as absent: minima and maxima go without it, weighted means that need it
    are null, and it has no row in the result.
    """
    reach = [sum(r for axis, r, _ in steps if axis == a) for a in (0, 1)]
    halo = max(reach)
    ends = raster.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    if ends[0] is None:
        return raster.select("row", "col", F.col("h").cast("double").alias("h"))
    extent = Extent((ends[0], ends[1]), (ends[2], ends[3]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = [k.as_py() * tile - halo for k in key]
        size = tile + 2 * halo
        values = np.full((size, size), np.nan)
        row, col = (table[c].to_numpy() - f for c, f in zip(("row", "col"), first, strict=True))
        own = (row >= halo) & (row < halo + tile) & (col >= halo) & (col < halo + tile)
        if not own.any():  # beside the raster, in the halo alone
            return table.select(["row", "col", "h"]).slice(0, 0)
        values[row, col] = table["h"].to_numpy()
        begin = list(first)
        for axis, radius, reduce in steps:
            values = moved(extent.repeated(values, begin), axis, radius, reduce)
            begin[axis] += radius
        at = [x[own] + f for x, f in zip((row, col), first, strict=True)]
        found = values[at[0] - begin[0], at[1] - begin[1]]
        return pa.table([pa.array(at[0]), pa.array(at[1]), pa.array(found, mask=np.isnan(found))], ["row", "col", "h"])

    whole = raster.where("row IS NOT NULL AND col IS NOT NULL AND h IS NOT NULL").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("h").cast("double").alias("h"))
    found = halo_tiles(whole, tile, halo).groupBy("tr", "tc").applyInArrow(run, "row long, col long, h double")
    return found.select(*[F.col(c).cast(raster.schema[c].dataType).alias(c) for c in ("row", "col")], "h")


def opening_steps(radius: int) -> list[Step]:
    return [(axis, radius, reduce) for reduce in (_lowest, _highest) for axis in (1, 0)]


def gaussian_steps(weights: list[float]) -> list[Step]:
    return [(axis, len(weights) // 2, _weighted(weights)) for axis in (1, 0)]


def opening(raster: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Erosion then dilation of a raster by a square of half-width ``radius``; edges see edge samples repeated."""
    return filtered(raster, opening_steps(radius), tile)


def gaussian(raster: DataFrame, weights: list[float], tile: int = TILE) -> DataFrame:
    """Separable weighted mean of a raster, edge samples repeated; ``weights`` are those of offsets -r .. r and add up to 1."""
    return filtered(raster, gaussian_steps(weights), tile)


def gaussian_weights(sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    plain = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / math.fsum(plain) for w in plain]


def bare_earth(raster: DataFrame, radius: int, weights: list[float], tile: int = TILE) -> DataFrame:
    """The ground without what is narrower than the opening, smoothed; both filters in one pass over the tiles."""
    return filtered(raster, [*opening_steps(radius), *gaussian_steps(weights)], tile)


def sample_plan(cells: DataFrame, side: int) -> DataFrame:
    """(row, col): the samples of cells (cx, cy) of ``side`` by ``side`` samples, those on shared edges once."""
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    at = spread(cells.select("cx", "cy"), side * side, "cy", "cx").select("cx", "cy", F.explode(steps).alias("j")).select("*", F.explode(steps).alias("i"))
    return at.select((F.col("cy") * (side - 1) + F.col("j")).alias("row"), (F.col("cx") * (side - 1) + F.col("i")).alias("col")).distinct()


def in_cells(samples: DataFrame, cells: DataFrame, side: int) -> DataFrame:
    """Samples (row, col, ...) once for each cell that holds them, as (cx, cy, j, i, ...); an edge has the same values in both cells."""
    n = side - 1
    spread = lambda c: F.explode(F.when(F.col(c) % n == 0, F.array(F.floor(F.col(c) / n) - 1, F.floor(F.col(c) / n))).otherwise(F.array(F.floor(F.col(c) / n))))
    both = samples.withColumn("cy", spread("row")).withColumn("cx", spread("col"))
    known = cells.select(F.col("cx").alias("_x"), F.col("cy").alias("_y")).distinct()
    held = both.join(known, (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")), "left_semi")
    return held.withColumns({"j": F.col("row") - F.col("cy") * n, "i": F.col("col") - F.col("cx") * n}).drop("row", "col")


def quantised(samples: DataFrame, most_step: int = 100, bound: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Whole heights ``cm`` as steps q above the lowest, and one row: offset, step, max_error, fault.

    The step is the least whole one for which 16 bits hold the range. The offset is an aggregate of one row, joined back.
    """
    ends = samples.agg(F.min("cm").alias("low"), F.max("cm").alias("high"), F.count(F.lit(1)).alias("n"), F.count("cm").alias("known"))
    step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / 65535.0)).cast("long")
    bad = F.when(F.col("known") < F.col("n"), "missing support").when((F.abs("low") > bound) | (F.col("high") > bound) | (step > most_step), "height range")
    summary = ends.select(F.col("low").alias("offset"), step.alias("step"), (0.5 + step / 2).alias("max_error"), bad.alias("fault"))
    one = summary.where("fault IS NULL").select(F.col("offset").alias("_low"), F.col("step").alias("_step"))
    return samples.join(F.broadcast(one)).withColumn("q", F.bround((F.col("cm") - F.col("_low")) / F.col("_step"), 0).cast("long")).drop("_low", "_step"), summary


def terrain(grid: DataFrame, cells: DataFrame, side: int, spacing: float, radius: int, weights: list[float] | None, zero: Column, denominator: float = 1.0, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Cells of a map from a source grid (row, col, h in metres): (cx, cy, j, i, cm, q) and one row with offset, step, max_error and fault.

    Samples stand ``spacing`` grid steps apart, are interpolated, stripped to bare earth if there are weights, taken from the height ``zero``, scaled 1:denominator to
    whole centimetres (halves to even) and quantised with one step for the whole map. A sample without support is a fault, and
    then there are no cells.
    """
    plan = sample_plan(cells, side)
    at = plan.select(F.struct("row", "col").alias("id"), (F.col("col") * spacing).alias("x"), (F.col("row") * spacing).alias("y"))
    found = written(bilinear(at, grid, 0.0, 0.0, 1.0).select("id.row", "id.col", "h"))
    ground = found if weights is None else bare_earth(found, radius, weights, tile)
    lost = found.where("h IS NULL") if weights is not None else None
    heights = ground.unionByName(lost) if lost is not None else ground
    cm = written(heights.select("row", "col", F.bround((F.col("h") - zero) * 100 / denominator, 0).cast("long").alias("cm")))
    done, summary = quantised(cm)
    return in_cells(done, cells, side), summary
