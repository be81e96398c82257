"""Statistics of each pixel's observations around many reference dates.

Sliding medians have no built-in form that sorts an observation fewer times than windows cover it, so this is one of
the few operators with a Python worker. Spark cuts time into stretches, deals rows by entity and stretch and sorts
them; the worker walks along the sorted rows and takes the windows of many pixels at once with array operations.
Where pixels only count towards a mean, it also adds them up by anchor, so a row per anchor comes back, not one per pixel.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .windows import day_number

BATCH_ROWS = 50_000  # sorted rows a worker looks at together, besides one unfinished pixel
CELLS = 2_000_000  # numbers that are gathered at once
STRETCH_SPANS = 4  # widest reaches in a stretch of time; only observations of one reach per stretch are moved twice
MEDIAN, SUM = "median", "sum"


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _medians(x: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Medians of the rows ``lo`` to ``lo + size`` by column, missing values apart; NaN without any."""
    out = np.full((len(lo), x.shape[1]), np.nan)
    for k in np.unique(size[size > 0]).tolist():
        some = np.flatnonzero(size == k)
        if k == 1:
            out[some] = x[lo[some]]
            continue
        step = max(1, CELLS // (k * x.shape[1]))
        for part in (some[i : i + step] for i in range(0, len(some), step)):
            v = np.sort(x[lo[part][:, None] + np.arange(k)], axis=1)  # missing ones last
            n = k - np.isnan(v).sum(1)
            pick = lambda at: np.take_along_axis(v, np.maximum(at, 0)[:, None], 1)[:, 0]
            out[part] = np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)
    return out


def _sums(x: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows ``lo`` to ``lo + size`` by column; missing values and empty windows count 0."""
    out = np.zeros((len(lo), x.shape[1]))
    x = np.nan_to_num(x)
    for k in np.unique(size[size > 0]).tolist():
        some = np.flatnonzero(size == k)
        step = max(1, CELLS // (k * x.shape[1]))
        for part in (some[i : i + step] for i in range(0, len(some), step)):
            out[part] = x[lo[part][:, None] + np.arange(k)].sum(1)
    return out


class Windows:
    """Rows of anchors and observations in the order (place, anchors first, pixel, day), and the windows among them."""

    def __init__(self, table: pa.RecordBatch, fields: Sequence[str]):
        of = lambda name: table.column(table.schema.get_field_index(name))
        self.table = table
        self.place = np.cumsum(_starts(*(_codes(of(c)) for c in ("entity", "_pair", "chunk"))))
        self.is_anchor = of("is_anchor").to_numpy(zero_copy_only=False)
        self.day = self.days(table)
        self.run = np.cumsum(_starts(self.place, self.is_anchor, _codes(of("pixel"))))
        self.fields = fields

    @staticmethod
    def days(table: pa.RecordBatch) -> np.ndarray:
        return table.column(table.schema.get_field_index("_day")).to_numpy(zero_copy_only=False).astype(np.int64)

    def unfinished(self) -> tuple[int, np.ndarray]:
        """First row of the last run, and the anchors before it that it still needs."""
        first = int(np.searchsorted(self.run, self.run[-1]))
        mine = np.flatnonzero(self.is_anchor[:first] & (self.place[:first] == self.place[-1]))
        return first, mine

    def take(self, spans: Sequence[tuple[int, int]], statistic: str) -> dict:
        anchors, rows = np.flatnonzero(self.is_anchor), np.flatnonzero(~self.is_anchor)
        x = np.column_stack([self.table.column(self.table.schema.get_field_index(f)).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(float) for f in self.fields])
        run, day = self.run[rows], self.day[rows]
        begin = np.flatnonzero(_starts(run)) if len(run) else run
        number = np.cumsum(_starts(run)) - 1 if len(run) else run
        place = self.place[rows[begin]]
        first = np.searchsorted(self.place[anchors], place, "left")
        asked = np.searchsorted(self.place[anchors], place, "right") - first
        of = np.repeat(np.arange(len(begin)), asked)
        at = anchors[np.arange(len(of)) + np.repeat(first - (np.cumsum(asked) - asked), asked)]
        low = int(day.min()) if len(day) else 0
        width = int(day.max()) - low + 2 if len(day) else 2
        order = number * width + day - low
        valid = np.maximum.accumulate(np.where(~np.isnan(x).all(1), np.arange(len(x)), -1)) if len(x) else number
        values, latest, any_row = [], np.full(len(of), -1, np.int64), np.zeros(len(of), bool)
        edges = []
        for a, z in spans:
            lo = np.searchsorted(order, of * width + np.clip(self.day[at] + a - low, 0, width - 1), "left")
            hi = np.searchsorted(order, of * width + np.clip(self.day[at] + z - low, -1, width - 1), "right")
            edges.append((lo, hi))
            any_row |= hi > lo
            last = valid[np.maximum(hi - 1, 0)] if len(valid) else hi
            latest = np.maximum(latest, np.where((hi > lo) & (last >= lo), last, -1))
            values.append((_medians if statistic == MEDIAN else _sums)(x, lo, hi - lo))
        keep = np.flatnonzero(any_row)
        return {
            "rows": rows[begin][of[keep]], "at": at[keep], "day": self.day[at[keep]], "values": np.concatenate(values, 1)[keep] if len(keep) else np.zeros((0, len(spans) * len(self.fields))),
            "seen": np.where(latest[keep] >= 0, day[np.maximum(latest[keep], 0)] if len(day) else 0, -1), "edges": [(lo[keep], hi[keep]) for lo, hi in edges], "x": x,
        }


def pixel_windows(
    anchors: DataFrame,
    observations: DataFrame,
    fields: Sequence[str],
    spans: Mapping[str, tuple[int, int]],
    *,
    statistic: str,
    entity: str = "patch_id",
    anchor: str = "reference_date",
    day: str = "obs_date",
    pixel: str = "pixel_id",
    dealt: bool = False,
) -> DataFrame:
    """A row per anchor and pixel that has observations in a span: ``(entity, anchor, pixel, chunk, chunks, <span>_<field>, seen)``.

    ``statistic`` is the median or the sum of the values in the span (days relative to the anchor, both included);
    missing values are left out. ``seen`` is the day of the latest value used.

    With ``dealt``, ``chunks`` of an observation says over how many chunks its pixel's rows are dealt, and ``chunks`` of an anchor
    the most of any of its pixels; then the sorted values come as arrays ``<span>_<field>_values`` instead, one row per chunk.
    """
    return _windows(anchors, observations, fields, spans, statistic=statistic, entity=entity, anchor=anchor, day=day, pixel=pixel, dealt=dealt, total=False)


def pixel_totals(
    anchors: DataFrame,
    observations: DataFrame,
    fields: Sequence[str],
    spans: Mapping[str, tuple[int, int]],
    *,
    statistic: str,
    entity: str = "patch_id",
    anchor: str = "reference_date",
    day: str = "obs_date",
    pixel: str = "pixel_id",
) -> DataFrame:
    """``pixel_windows`` added up over the pixels of an anchor: ``(entity, anchor, <span>_<field>, <span>_<field>_pixels, seen)``.

    The value is the sum of the pixels' medians, ``_pixels`` how many pixels have one. With ``SUM``, fields come in pairs, the
    values' sum and their number, and the value, named after the first, is the sum of the pixels' ratios. An anchor may have
    several rows, which callers add up: one for each batch of sorted rows that holds pixels of it.
    """
    return _windows(anchors, observations, fields, spans, statistic=statistic, entity=entity, anchor=anchor, day=day, pixel=pixel, dealt=False, total=True)


def _windows(
    anchors: DataFrame, observations: DataFrame, fields: Sequence[str], spans: Mapping[str, tuple[int, int]], *,
    statistic: str, entity: str, anchor: str, day: str, pixel: str, dealt: bool, total: bool,
) -> DataFrame:
    """Rows of ``pixel_windows``, or their totals.

    Time is cut into stretches of several times the widest reach. An anchor's spans begin in one stretch and may end in the next,
    so an observation is moved to its own stretch, and to the one before if a span that begins there may reach it.
    """
    ship_code(anchors.sparkSession)
    low, high = min(a for a, _ in spans.values()), max(z for _, z in spans.values())
    width = high - low + 1
    stretch = STRETCH_SPANS * width
    kinds = dict(observations.dtypes)
    numbers = [F.col(f).cast("double").alias(f) for f in fields]
    one = F.lit(1)
    more = [F.col("chunks").cast("int")] if dealt else []
    seen = observations.select(F.col(entity).alias("entity"), F.col(pixel).alias("pixel"), day_number(F.col(day)).alias("_day"), *more, *numbers)
    asked = anchors.select(F.col(entity).alias("entity"), day_number(F.col(anchor)).alias("_day"), *more).distinct()
    if dealt:
        seen = seen.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("_day", *fields), "chunks")).otherwise(0).cast("int"))
        asked = asked.select("entity", "_day", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    else:
        seen = seen.withColumn("chunks", one).withColumn("chunk", F.lit(0))
        asked = asked.withColumn("chunk", F.lit(0))
    own, before = F.floor(F.col("_day") / stretch), F.floor((F.col("_day") - (width - 1)) / stretch)
    seen = seen.withColumn("_pair", F.explode(F.sequence(before, own))).withColumn("is_anchor", F.lit(False))
    asked = asked.withColumn("_pair", F.floor((F.col("_day") + low) / stretch)).withColumn("is_anchor", F.lit(True))
    place = ["entity", "_pair", "chunk"]
    # a number first: places differ in it, and comparing it is cheaper than comparing names that begin alike
    order = [F.xxhash64(*place), *place, F.col("is_anchor").desc(), "pixel", "_day"]
    rows = seen.unionByName(asked, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*order)
    names = [f"{s}_{f}" for s in spans for f in fields]
    if total:
        return _totals(anchors, rows, fields, spans, statistic, entity, anchor)
    lists = [f"{n}_values" for n in names] if dealt else []
    schema = pa.schema([("chunk", pa.int32()), ("chunks", pa.int32()), ("_day", pa.int32()), ("seen", pa.int32()), *((n, pa.float64()) for n in names), *((n, pa.list_(pa.float64())) for n in lists)])

    def results(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = Windows(table, fields).take(list(spans.values()), statistic)
        if not len(got["rows"]):
            return
        at = pa.array(got["rows"])
        of = lambda name: table.column(table.schema.get_field_index(name)).take(at)
        chunks = of("chunks").cast(pa.int32())
        made = [of("chunk").cast(pa.int32()), chunks, pa.array(got["day"].astype("i4")), pa.array(got["seen"].astype("i4"), mask=got["seen"] < 0)]
        split = chunks.to_numpy(zero_copy_only=False) > 1
        for i in range(len(names)):
            value = got["values"][:, i]
            made.append(pa.array(value, mask=np.isnan(value) | split))
        for i in range(len(lists)):
            made.append(_listed(got, split, i, len(fields)))
        batch = pa.RecordBatch.from_arrays([of("entity"), of("pixel"), *made], names=["entity", "pixel", *schema.names])
        for lo in range(0, batch.num_rows, 20_000):
            yield batch.slice(lo, 20_000)

    out = rows.mapInArrow(
        _walk(fields, results),
        f"entity {dict(anchors.dtypes)[entity]}, pixel {kinds[pixel]}, chunk int, chunks int, _day int, seen int, "
        + ", ".join([*(f"`{n}` double" for n in names), *(f"`{n}` array<double>" for n in lists)]),
    )
    dated = [F.date_from_unix_date("_day").alias(anchor), F.col("pixel").alias(pixel), "chunk", "chunks", F.date_from_unix_date("seen").alias("seen")]
    return out.select(F.col("entity").alias(entity), *dated, *names, *lists)


def _walk(fields: Sequence[str], results):
    """A function over a partition's sorted batches that gives ``results`` whole pixels, with the anchors they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < BATCH_ROWS:
                continue
            table = joined()
            first, still = Windows(table, fields).unfinished()
            if first:
                yield from results(table.slice(0, first))
            held = [b for b in (table.take(pa.array(still)), table.slice(first)) if b.num_rows]
        if held:
            yield from results(joined())

    return run


def _totals(
    anchors: DataFrame, rows: DataFrame, fields: Sequence[str], spans: Mapping[str, tuple[int, int]], statistic: str, entity: str, anchor: str
) -> DataFrame:
    """The rows of ``pixel_totals`` from the sorted ones."""
    step = 2 if statistic == SUM else 1
    names = [f"{s}_{f}" for s in spans for f in fields][::step]
    counts = [f"{n}_pixels" for n in names]

    def results(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = Windows(table, fields).take(list(spans.values()), statistic)
        if not len(got["rows"]):
            return
        values = got["values"]
        if statistic == SUM:
            with np.errstate(divide="ignore", invalid="ignore"):
                values = np.where(values[:, 1::2] == 0, np.nan, values[:, 0::2] / values[:, 1::2])
        at, of = np.unique(got["at"], return_inverse=True)
        there = ~np.isnan(values)
        seen = np.full(len(at), -1, np.int64)
        np.maximum.at(seen, of, got["seen"])
        made = [np.bincount(of, weights=np.where(there[:, i], values[:, i], 0.0), minlength=len(at)) for i in range(len(names))]
        made += [np.bincount(of, weights=there[:, i], minlength=len(at)).astype(np.int64) for i in range(len(names))]
        entities = table.column(table.schema.get_field_index("entity")).take(pa.array(at))
        day = pa.array(Windows.days(table)[at].astype("i4"))
        yield pa.RecordBatch.from_arrays(
            [entities, day, pa.array(seen.astype("i4"), mask=seen < 0), *map(pa.array, made)], names=["entity", "_day", "seen", *names, *counts]
        )

    kinds = [f"entity {dict(anchors.dtypes)[entity]}", "_day int", "seen int", *(f"`{n}` double" for n in names), *(f"`{n}` long" for n in counts)]
    out = rows.mapInArrow(_walk(fields, results), ", ".join(kinds))
    return out.select(
        F.col("entity").alias(entity), F.date_from_unix_date("_day").alias(anchor), F.date_from_unix_date("seen").alias("seen"), *names, *counts
    )


def _listed(got: dict, split: np.ndarray, i: int, n_fields: int) -> pa.Array:
    """Sorted values of split pixels' windows, one list a row; other rows have none."""
    if not split.any():
        return pa.nulls(len(split), pa.list_(pa.float64()))
    lo, hi = got["edges"][i // n_fields]
    x = got["x"][:, i % n_fields]
    out = []
    for some, a, b in zip(split.tolist(), lo.tolist(), hi.tolist()):
        v = x[a:b]
        out.append(np.sort(v[~np.isnan(v)]) if some else None)
    return pa.array(out, pa.list_(pa.float64()))
