"""Isotonic calibration as the lower convex hull of running sums.

Over ascending scores, let W count rows and S sum labels. The slopes of the lower convex hull of the points (W, S) are
the isotonic means. The hull is found in parts: every sorted partition keeps the vertices of its own hull. A line of a
given slope touches the whole hull where S - slope x W is least, which one aggregate finds for many slopes
at once. Such points cut the hull into stretches that are finished apart. Neither a task nor the driver holds
all of a hull; numbers are whole, so results are exact.

A calibrator is a table of blocks: scores from ``low`` to ``high`` have the mean ``value``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import cut_points, running_sums, with_slice
from ..session import ship_code, staged

LOOKUP_BLOCKS = 100_000  # calibrators up to this size are looked up in memory, larger ones by a join
SLOPES = 64  # touching lines per group at least
POINT = "g string, x double, next double, w long, s long"
NAMES = ["g", "x", "next", "w", "s"]


def lower_hull(w: list[int], s: list[int]) -> list[int]:
    """Positions of the vertices of the lower convex hull of points in ascending ``w``."""
    kept: list[int] = []
    for i in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (s[b] - s[a]) * (w[i] - w[b]) < (s[i] - s[b]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertices of the hull of each group's rows in a sorted partition; one group in memory at a time."""
    held: list[pa.RecordBatch] = []

    def reduced() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        w, s = table.column(3).to_pylist(), table.column(4).to_pylist()
        return table.take(pa.array(lower_hull(w, s)))

    for batch in batches:
        groups = batch.column(0)
        start = 0
        while start < batch.num_rows:
            name = groups[start].as_py()
            end = start + int(np.argmin(np.append(np.array(groups.slice(start).to_pylist(), object) == name, False)))
            if held and held[-1].column(0)[0].as_py() != name:
                yield reduced()
                held = []
            held.append(batch.slice(start, end - start))
            held = [reduced()]  # what came so far is at most its hull
            start = end
    if held:
        yield reduced()


def isotonic_blocks(scored: DataFrame, *, label: str = "y_true", score: str = "y_prob", group: str | None = None) -> DataFrame:
    """Blocks ``(low, high, value, rows)`` of the isotonic regression of 0/1 labels on scores, by ``group`` if named.

    Equal scores are one point. Rows without a score or label are left out; without any rows there are no blocks.
    """
    ship_code(scored.sparkSession)
    name = F.col(group).cast("string") if group else F.lit("")
    x = F.col(score).cast("double") + F.lit(0.0)
    rows = scored.select(name.alias("g"), F.nanvl(x, F.lit(None)).alias("x"), F.col(label).cast("long").alias("s")).dropna()
    points = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("w"), F.sum("s").alias("s"))
    ladder = running_sums(points, by=["g"], value="x", sums=["w", "s"], descending=False, lead=["x"])
    start = ladder.filter("cum_w = w").select("g", F.lit(None).cast("double").alias("x"), F.col("x").alias("next"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("s"))
    every = ladder.select("g", "x", F.col("next_x").alias("next"), F.col("cum_w").alias("w"), F.col("cum_s").alias("s")).unionByName(start)
    parts = staged(every.repartitionByRange("g", "w").sortWithinPartitions("g", "w").mapInArrow(_hulls, POINT), "hulls")

    ends = parts.groupBy("g", F.input_file_name().alias("part")).agg(F.max_by(F.struct("w", "s"), "w").alias("last"))
    lines: dict[str, list[tuple[int, int]]] = {}
    for g, found in _by_group(ends.select("g", "last.w", "last.s").collect()).items():  # one row per file and group
        found = sorted({(0, 0), *found})
        kept = [found[i] for i in lower_hull(*map(list, zip(*found)))]
        steps = [(b[1] - a[1], b[0] - a[0]) for a, b in zip(kept, kept[1:])]
        steps += [(i, SLOPES) for i in range(1, SLOPES)]
        lines[g] = steps

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row of each batch that each line touches first."""
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            for g in sorted(set(groups.tolist())):
                rows = batch.take(pa.array(np.flatnonzero(groups == g)))
                w, s = (np.array(rows.column(i).to_pylist(), object) for i in (3, 4))
                heights = [s * run - w * rise for rise, run in lines[g]]
                at = [int(np.argmin(h)) for h in heights]
                found = [rows.column(i).take(pa.array(at)) for i in range(5)]
                low = pa.array([str(h[i]) for h, i in zip(heights, at)], pa.string())
                yield pa.RecordBatch.from_arrays([*found, pa.array(range(len(at)), pa.int32()), low], names=[*NAMES, "line", "height"])

    touched = parts.mapInArrow(touch, POINT + ", line int, height string")
    height = F.col("height").cast("decimal(38,0)")
    cuts = touched.groupBy("g", "line").agg(F.min_by(F.struct("w", "x", "next", "s"), F.struct(height, "w")).alias("p"))
    stops: dict[str, list[tuple]] = {g: sorted(set(rows)) for g, rows in _by_group(cuts.select("g", "p.w", "p.s", "p.next").collect()).items()}

    def place(g: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(stops[a], (b,)) for a, b in zip(g, w)], dtype="int64")

    between = F.pandas_udf(place, "long")(F.col("g"), F.col("w"))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        g, at = rows["g"].iloc[0], int(rows["stretch"].iloc[0])
        w, s, x, following = ([*rows.sort_values("w")[c]] for c in ("w", "s", "x", "next"))
        if at > 0:
            begin = stops[g][at - 1]
            w, s, x, following = [begin[0], *w], [begin[1], *s], [None, *x], [begin[2], *following]
        kept = lower_hull([int(v) for v in w], [int(v) for v in s])
        pairs = list(zip(kept, kept[1:]))
        return pd.DataFrame({
            "g": pd.Series([g] * len(pairs), dtype=object), "low": [following[i] for i, _ in pairs], "high": [x[j] for _, j in pairs],
            "value": [(s[j] - s[i]) / (w[j] - w[i]) for i, j in pairs], "rows": [w[j] - w[i] for i, j in pairs],
        })

    blocks = parts.withColumn("stretch", between).groupBy("g", "stretch").applyInPandas(finish, "g string, low double, high double, value double, rows long")
    key = [F.col("g").cast(dict(scored.dtypes)[group]).alias(group)] if group else []
    return blocks.select(*key, "low", "high", "value", "rows")


def _by_group(rows: list) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for g, *rest in rows:
        out.setdefault(g, []).append(tuple(rest))
    return out


def calibrated(df: DataFrame, blocks: DataFrame, *, score: str = "y_prob", group: str | None = None, out: str = "y_prob_calibrated") -> DataFrame:
    """Add the calibrated score: the value of the block, a straight line between blocks, the end values outside.

    The distinct scores are laid in order beside the ends of blocks, in slices; what lies before and after a slice is
    added from the totals of the other slices. Rows without a score, or of a group without blocks, get NULL.
    """
    name = F.col(group).cast("string") if group else F.lit("")
    x = F.nanvl(F.col(score).cast("double") + F.lit(0.0), F.lit(None))
    asked = df.select(name.alias("g"), x.alias("x")).dropna().distinct()
    ends = F.array(F.struct(F.col("low").alias("x"), "value"), F.struct(F.col("high").alias("x"), "value"))
    points = blocks.select(name.alias("g"), F.inline(ends)).distinct()
    both = asked.withColumn("point", F.lit(None).cast("struct<x:double,value:double>")).unionByName(points.select("g", "x", F.struct("x", "value").alias("point")))
    ranked = with_slice(both, "x", descending=False, cuts=cut_points(both, "x"))
    totals = ranked.filter("point is not null").groupBy("g", "_slice").agg(F.max_by("point", "x").alias("last"), F.min_by("point", "x").alias("first"))
    slices = ranked.select("g", "_slice").distinct().join(totals, ["g", "_slice"], "left")
    over = Window.partitionBy("g").orderBy("_slice")
    slices = slices.select(
        "g", "_slice",
        F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    inside = Window.partitionBy("g", "_slice").orderBy("x", F.col("point").isNull())
    before = F.last("point", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("point", ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = ranked.select("g", "_slice", "x", "point", before.alias("before"), after.alias("after")).filter("point is null").join(slices, ["g", "_slice"])
    a, b = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    share = (F.col("x") - a["x"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["x"] == F.col("x")), a["value"]).otherwise(a["value"] + share * (b["value"] - a["value"]))
    found = near.select(F.col("g").alias("_g"), F.col("x").alias("_x"), value.alias(out))
    return df.join(found, (name == F.col("_g")) & (x == F.col("_x")), "left").drop("_g", "_x")


@dataclass
class Calibrator:
    """Blocks of an isotonic regression; small ones also as a model that is looked up in memory."""

    blocks: DataFrame = field(repr=False)
    model: IsotonicRegressionModel | None = None

    @classmethod
    def of(cls, blocks: DataFrame) -> Calibrator:
        """``blocks`` must be a written table. One count decides whether they are looked up or joined."""
        n = blocks.count()
        if not 0 < n <= LOOKUP_BLOCKS:
            return cls(blocks)
        ends = F.array(F.struct(F.col("low").alias("x"), "value"), F.struct(F.col("high").alias("x"), "value"))
        points = blocks.select(F.inline(ends)).distinct()
        fitter = IsotonicRegression(featuresCol="x", labelCol="value", predictionCol="y_prob_calibrated")
        return cls(blocks, fitter.fit(points))

    def apply(self, df: DataFrame, score: str = "y_prob") -> DataFrame:
        if self.model is None:
            return calibrated(df, self.blocks, score=score)
        return self.model.copy().setFeaturesCol(score).transform(df)


def fit_calibrator(scored: DataFrame, *, label: str = "y_true", score: str = "y_prob") -> Calibrator:
    """Monotone map from raw to calibrated probability, clipped outside the seen range."""
    return Calibrator.of(staged(isotonic_blocks(scored, label=label, score=score), "calibrator"))


def apply_calibrator(calibrator: Calibrator, df: DataFrame, *, score: str = "y_prob") -> DataFrame:
    return calibrator.apply(df, score)
