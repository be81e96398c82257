"""Running sums, ranks and exact quantiles over a global order, spread over many tasks.

A plain ``sum().over(partitionBy(model).orderBy(score))`` puts all rows of one
model in one task. Here the order is first cut into slices: approximate
quantiles (a bounded sketch on the driver) give literal cut points, each slice
is summed on its own, and the totals of the slices before it are added back.
The cut points only decide which task does the work; results are exact for any
cuts. A value that alone fills several slices is cut again by a digest of its
tie columns, so one hot score cannot fill a task either.
"""

from collections.abc import Sequence
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null

TIE_SLICES = 4096  # three hex digits of the tie digest


def tie_digest(columns: Sequence[str]) -> Column:
    """Hex digest that orders ties the same way on every engine and run."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def cut_points(df: DataFrame, value: str, slices: int | None = None) -> tuple[list[float], list[float]]:
    """(ascending cut points, values that fill at least a slice on their own)."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return [], []
    found = df.select(F.col(value).cast("double").alias("v")).approxQuantile(
        "v", [i / n for i in range(1, n)], 0.5 / n
    )
    found = [v + 0.0 for v in found]
    hot = sorted({a for a, b in zip(found, found[1:]) if a == b})
    return sorted(set(found)), hot


def with_slice(
    df: DataFrame,
    value: str,
    *,
    descending: bool,
    cuts: tuple[list[float], list[float]],
    digest: str | None = None,
) -> DataFrame:
    """Add ``_slice``: a long that grows along the order."""
    points, hot = cuts
    if not points:
        return df.withColumn("_slice", F.lit(0).cast("long"))
    splits = [float("-inf"), *points, float("inf")]
    lookup = Bucketizer(splits=splits, inputCol="_v", outputCol="_bucket", handleInvalid="keep")
    marked = lookup.transform(df.withColumn("_v", F.col(value).cast("double")))
    # never NULL, so that joins on it add no null filter below the aggregates they share
    bucket = F.coalesce(F.col("_bucket").cast("long"), F.lit(0).cast("long"))
    rank = -bucket if descending else bucket
    inner = F.lit(0)
    if digest and hot:
        # a hot value is the low end of its bucket: it comes last in descending order
        others = -1 if descending else TIE_SLICES
        inner = F.when(
            F.col("_v").isin(hot), F.coalesce(F.conv(F.substring(digest, 1, 3), 16, 10).cast("long"), F.lit(0))
        ).otherwise(F.lit(others))
    return marked.withColumn("_slice", rank * (2 * TIE_SLICES) + inner).drop("_v", "_bucket")


def running_sums(
    df: DataFrame,
    *,
    by: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = True,
    digest: str | None = None,
    lead: Sequence[str] = (),
    slices: int | None = None,
    cuts_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (up to and with the row) and ``total_<c>`` for each sum column.

    ``by`` columns must not be NULL. Rows must be unique in (by, value, digest).
    ``lead`` columns get ``next_<c>``: the value in the following row of the order.
    """
    by = list(by)
    cuts = cut_points(cuts_from if cuts_from is not None else df, value, slices)
    ranked = with_slice(df, value, descending=descending, cuts=cuts, digest=digest)
    key = [*by, "_slice"]
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    if digest:
        order.append(F.col(digest).asc())

    parts = [F.sum(c).alias(f"_t_{c}") for c in sums]
    if lead:
        pick = F.max_by if descending else F.min_by
        parts.append(pick(F.struct(*lead), F.col(value)).alias("_first"))
    totals = ranked.groupBy(*key).agg(*parts)

    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(group).alias(f"total_{c}") for c in sums],
        *([F.lead("_first").over(group.orderBy("_slice")).alias("_next")] if lead else []),
    )
    inside = Window.partitionBy(*key).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.join(offsets, key).select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
        *[F.coalesce(F.lead(c).over(inside), F.col(f"_next.{c}")).alias(f"next_{c}") for c in lead],
    )


TIE_DIGITS = 4  # hex digits of the digest that tied rows are counted by


def first_hits(rows: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Sum of ``hit`` over the first ``rest`` rows of each group in the order of ``digest``: ``(*by, hits)``.

    Counts per leading digits (65,536 at most) tell which rows are in, which are out, and which
    few share the digits where the count ends; only those, one in so many of a group, are put in order.
    """
    by = list(by)
    part = rows.withColumn("_d", F.substring("digest", 1, TIE_DIGITS))
    counts = part.groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.max("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto)
    inside = placed.filter(F.col("upto") <= F.col("rest")).select(*by, "hits")
    edge = placed.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    edge = edge.select(*by, "_d", (F.col("rest") - F.col("upto") + F.col("n")).alias("_left"))
    number = F.row_number().over(Window.partitionBy(*by, "_d").orderBy("digest"))
    last = part.join(edge, [*by, "_d"]).withColumn("_n", number).filter(F.col("_n") <= F.col("_left"))
    return inside.unionByName(last.select(*by, F.col("hit").alias("hits"))).groupBy(*by).agg(F.sum("hits").alias("hits"))


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*by, feature, value)`` without missing values."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), nan_to_null(F.col(c).cast("double")).alias("value")) for c in columns]
    )
    return df.select(*by, F.inline(pairs)).filter(F.col("value").isNotNull())


FEW_PROBS = 16  # up to so many quantiles of whole columns are bracketed by a sketch first
NARROW_ERROR = 1e-3
ONE_SLICE_ROWS = 1_000_000  # below this a single slice per group is enough


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: ``(*by, feature, prob, quantile)``.

    Ranks are found from running counts of distinct values, so no task ever holds a
    whole column. A few quantiles of whole columns only move the values near them.
    ``probs`` must ascend.
    """
    columns = list(columns)
    if not by and len(probs) <= FEW_PROBS:
        near = _near_quantiles(df, columns, probs, slices)
        if near is not None:
            return near
    group = [*by, "feature"]
    long = melt(df, columns, by).withColumn("value", F.col("value") + F.lit(0.0))
    counted = long.groupBy(*group, "value").agg(F.count("*").alias("n"))
    ladder = running_sums(
        counted, by=group, value="value", sums=["n"], descending=False, slices=slices, cuts_from=long
    )
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    span = F.col("total_n") - 1
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    if len(probs) > FEW_PROBS and all(abs(p - i / (len(probs) - 1)) < 1e-15 for i, p in enumerate(probs)):
        # evenly spaced: only look at those that can fall on this value
        top = len(probs) - 1
        low = F.greatest(F.lit(0), F.floor(F.try_divide((first - 1) * top, span)))
        high = F.least(F.lit(top), F.ceil(F.try_divide((last + 1) * top, span)))
        part = F.slice(wanted, (low + 1).cast("int"), (high - low + 1).cast("int"))
        wanted = F.when(span > 0, part).otherwise(wanted)

    def covers(rank: Column) -> Column:
        return (rank >= first) & (rank <= last)

    hit = F.filter(wanted, lambda p: covers(F.floor(p * span)) | covers(F.ceil(p * span)))
    hits = ladder.select(*group, "value", "total_n", first.alias("first"), last.alias("last"), F.explode(hit).alias("prob"))
    return _interpolated(hits, group)


def _interpolated(hits: DataFrame, group: list[str]) -> DataFrame:
    """Quantiles from rows ``(group, prob, value, first, last, total_n)`` that hold the
    0-based ranks ``first..last``."""
    rank = F.col("prob") * (F.col("total_n") - 1)

    def inside(r: Column) -> Column:
        return (r >= F.col("first")) & (r <= F.col("last"))

    return (
        hits.groupBy(*group, "prob")
        .agg(
            F.max(F.when(inside(F.floor(rank)), F.col("value"))).alias("_low"),
            F.max(F.when(inside(F.ceil(rank)), F.col("value"))).alias("_high"),
            F.max(rank - F.floor(rank)).alias("_part"),
        )
        .select(*group, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))
    )


def _near_quantiles(df: DataFrame, columns: list[str], probs: Sequence[float], slices: int | None) -> DataFrame | None:
    """Exact quantiles from the values close to approximate ones.

    A sketch brackets each quantile, one aggregate counts the rows below and inside the
    brackets, and only rows inside are shuffled. None when a bracket misses its rank
    (few rows), where the full path takes over.
    """
    spark = df.sparkSession
    numbers = df.select(*[(nan_to_null(F.col(c).cast("double")) + F.lit(0.0)).alias(c) for c in columns])
    asked = sorted({p + d for p in probs for d in (-2 * NARROW_ERROR, 2 * NARROW_ERROR) if 0.0 < p + d < 1.0})
    found = numbers.approxQuantile(columns, asked, NARROW_ERROR) if asked else [[] for _ in columns]
    brackets = []
    for c, values in zip(columns, found):
        at = dict(zip(asked, values))
        for p in probs:
            brackets.append(
                (c, float(p), at.get(p - 2 * NARROW_ERROR, float("-inf")), at.get(p + 2 * NARROW_ERROR, float("inf")))
            )
    counts = []
    for i, (c, _, low, high) in enumerate(brackets):
        counts.append(F.count_if(F.col(c) < low).alias(f"below_{i}"))
        counts.append(F.count_if(F.col(c).between(low, high)).alias(f"inside_{i}"))
    counts += [F.count(c).alias(f"n_{j}") for j, c in enumerate(columns)]
    row = numbers.agg(*counts).first()
    known = []
    for i, (c, p, _, _) in enumerate(brackets):
        n, below, inside = row[f"n_{columns.index(c)}"], row[f"below_{i}"], row[f"inside_{i}"]
        if n == 0:
            continue
        rank = p * (n - 1)
        if math.floor(rank) < below or math.ceil(rank) >= below + inside:
            return None
        known.append((c, p, below, n))
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(p).alias("prob"),
                F.col(c).alias("value"),
                F.col(c).between(low, high).alias("inside"),
            )
            for c, p, low, high in brackets
        ]
    )
    selected = numbers.select(F.inline(F.filter(pairs, lambda s: s["inside"]))).drop("inside")
    counted = selected.groupBy("feature", "prob", "value").agg(F.count("*").alias("n"))
    if max((row[f"inside_{i}"] for i in range(len(brackets))), default=0) <= ONE_SLICE_ROWS:
        slices = 1
    ladder = running_sums(
        counted, by=["feature", "prob"], value="value", sums=["n"], descending=False, slices=slices, cuts_from=selected
    )
    offsets = spark.createDataFrame(known, "feature string, prob double, below long, total_n long")
    hits = ladder.drop("total_n").join(offsets, ["feature", "prob"])
    first = F.col("below") + F.col("cum_n") - F.col("n")
    hits = hits.select("feature", "prob", "value", "total_n", first.alias("first"), (F.col("below") + F.col("cum_n") - 1).alias("last"))
    return _interpolated(hits, ["feature"])
