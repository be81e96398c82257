"""Mixing sources to target weights by entropy balancing.

Among all document rates with the wanted word totals, entropy balancing takes those that
stay closest to the given ones: rates are exponentially tilted by one multiplier per constraint,
and the multipliers solve a convex dual by Newton steps. Documents enter the dual only through
the sums of their source, so steps run on one row per source; the rates are then rounded
into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
NEWTON_STEPS = 60
PREFIX = 3  # hex digits: a source is summed in up to 4,096 runs of its hash order


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Target words per source (``source``, ``source_size`` -> plus ``weight``, ``target``).

    Sources by code point, null last, take the weights in turn and share all words; a target stops at
    ``max_rate`` times its source, what is over goes to the others by weight, until none is above. That
    ends at target = min(cap, level * weight); with sources in order of cap / weight the level follows from
    running sums. One row per source meets in one task here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_rate))
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    left = F.greatest(total - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("cap", cap).withColumn("level", left / rest)
    capped = levelled.withColumn("fits", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level")))
    found = capped.withColumn("common", level.over(every)["level"])
    return found.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def newton_rates(totals: DataFrame, *, steps: int = NEWTON_STEPS) -> DataFrame:
    """Add ``rate`` = exp(multiplier) of each constraint's solution to (``source_size``, ``target``).

    The dual is the sum over sources of size * exp(m) - target * m. Its gradient is size * exp(m) - target and
    its Hessian is diagonal, as a document has one source, so a Newton step is m + target / (size * exp(m)) - 1,
    kept within one unit. All sources step in the same rows, distributed like any projection. An empty source
    or a zero target has no multiplier: its rate is 0.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")

    def step(m: Column, _: Column) -> Column:
        return m + F.least(F.greatest(target / (size * F.exp(m)) - 1, F.lit(-1.0)), F.lit(1.0))

    multiplier = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return totals.withColumn("rate", F.when((size > 0) & (target > 0), F.exp(multiplier)).otherwise(0.0))


def _word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _order() -> Column:
    """Hash order of documents: by doc_id and text, so that only equal rows share a place."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


RESULT = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_rate: int) -> DataFrame:
    """``docs`` with the columns of ``RESULT``, each after two underscores."""
    narrow = stage(docs.select("source", _order().alias("key"), _word_count().alias("size")), "sizes")
    run = F.substring("key", 1, PREFIX)
    pieces = stage(narrow.groupBy("source", run.alias("run")).agg(F.sum("size").alias("words")), "runs")
    totals = pieces.groupBy("source").agg(F.sum("words").alias("source_size"))
    rates = newton_rates(source_targets(totals, weights=weights, max_rate=max_rate))
    whole = F.floor(F.col("rate") + 1e-9)
    extra = F.floor(F.col("rate") * F.col("source_size") - whole * F.col("source_size") + 1e-3).cast("long")
    plan = stage(
        rates.select(F.col("source").alias("of"), "source_size", F.round("target", 6).alias("target"), whole.alias("whole"), extra.alias("extra")), "plan"
    )
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    reached = pieces.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("of")))
    last = reached.where("before <= extra AND extra < before + words").select("of", F.col("run").alias("last_run"), (F.col("extra") - F.col("before")).alias("room"))
    inside = narrow.join(last, F.col("source").eqNullSafe(F.col("of")) & (run == F.col("last_run")))
    # Equal rows are counted first, so a run holds distinct documents only.
    same = inside.groupBy("of", "last_run", "room", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    summed = same.withColumn("sum", F.sum(F.col("rows") * F.col("size")).over(Window.partitionBy("of").orderBy("key")))
    fits, crosses = F.col("sum") <= F.col("room"), F.col("sum") - F.col("rows") * F.col("size") <= F.col("room")
    fitting = F.floor(F.try_divide(F.col("room") - F.col("sum") + F.col("rows") * F.col("size"), F.col("size")))
    ends = summed.groupBy("of", "last_run").agg(
        F.max(F.when(fits, F.col("key"))).alias("last_key"),
        F.max(F.when(~fits & crosses, F.col("key"))).alias("edge"),  # the one that fits in part, if it has several rows
        F.max(F.when(~fits & crosses, fitting)).cast("long").alias("edge_rows"),
    )
    # Below every key of its run if nothing there fits; past all keys where the whole source is taken.
    cut = F.when(F.col("last_run").isNotNull(), F.coalesce("last_key", "last_run")).when(F.col("extra") > 0, F.lit("g")).otherwise(F.lit(""))
    ends = ends.withColumnRenamed("of", "of2")
    limits = plan.join(ends, F.col("of").eqNullSafe(F.col("of2")), "left").select("of", "source_size", "target", "whole", cut.alias("cut"), "edge", "edge_rows")
    limits = stage(limits, "plan").toDF("__of", "__source_size", "__target", "__whole", "__cut", "__edge", "__edge_rows")
    joined = docs.join(limits, F.col("source").eqNullSafe(F.col("__of"))).withColumn("__size", _word_count())
    parted = (F.col("__edge_rows") > 0) & (_order() == F.col("__edge"))
    more = F.when((F.col("__cut") != "") & (_order() <= F.col("__cut")), 1).otherwise(0)
    if limits.where("__edge_rows > 0").isEmpty():
        return _with_copies(joined.withColumn("__more", more), docs.columns)
    # Equal rows of which some are taken: numbered within the tasks that wrote them, and the tasks in order.
    edges = stage(joined.where(parted).withColumn("__row", F.monotonically_increasing_id()), "edges")
    task = F.shiftright("__row", 33)
    counts = edges.groupBy("__of", task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    tasks = Window.partitionBy("__of").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__of").alias("__of2"), "__task", F.coalesce(F.sum("__n").over(tasks), F.lit(0)).alias("__first"))
    at = F.row_number().over(Window.partitionBy("__of", task).orderBy("__row"))
    numbered = edges.withColumn("__at", at).join(counts, F.col("__of").eqNullSafe(F.col("__of2")) & (task == F.col("__task")))
    some = numbered.withColumn("__more", (F.col("__first") + F.col("__at") <= F.col("__edge_rows")).cast("int"))
    rest = joined.where(~F.coalesce(parted, F.lit(False))).withColumn("__more", more)
    return _with_copies(rest.select(*docs.columns, *LIMITS).unionByName(some.select(*docs.columns, *LIMITS)), docs.columns)


LIMITS = ("__size", "__source_size", "__target", "__whole", "__more")


def _with_copies(rows: DataFrame, names: list[str]) -> DataFrame:
    copies = (F.col("__whole") + F.col("__more")).cast("long")
    made = rows.withColumn("__copies", copies).withColumn("__taken", copies * F.col("__size"))
    return made.select(*names, *[f"__{c}" for c in RESULT])


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source and others) with ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A null text has size 0; a null source is a source. Copies are the whole part of the rate, plus one for the
    first documents of the source in the order of a hash of doc_id and text, as long as their words fit what the rest
    of the rate asks for: each source ends within one document of its target, and no
    document exceeds the rate rounded up. Of equal rows, null or repeated ids included, as many are taken as fit; which of
    them doesn't matter, as they are equal. An empty table gives an empty result. Input columns of these five names are replaced.

    No text is shuffled: words are summed by source and the first ``PREFIX`` digits of the hash; only the one
    run per source where its sum is reached is put in order, which yields the last hash to take. A source
    with a third of all words is thus many runs, added up before the shuffle.
    """
    base = docs.drop(*RESULT)
    return _mixed(base, weights, max_rate).select(*base.columns, *[F.col(f"__{c}").alias(c) for c in RESULT])


def repeat_copies(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """The mixed corpus: each row as often as its copies say, with the columns of ``docs``, whatever their names. See ``mix``.

    Rows without copies go; an empty table stays empty.
    """
    mixed = _mixed(docs, weights, max_rate).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
