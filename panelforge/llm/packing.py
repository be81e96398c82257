"""Packing token sequences: shallow length combinations chosen by non-negative least squares.

A document is cut into full windows and one rest. Rests are known by their length, so the
whole problem is a histogram with fewer bins than the window has tokens. Combinations of two
or three lengths that fill a window exactly are enumerated; non-negative least squares finds
how often to repeat each so that the histogram is matched; the counts are rounded down, and
what is left is packed greedily. The plan is a small table over (length, rank among
the rests of that length), which places every row without looking at any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, map_batches, partitions, stage
from .tokens import encoder

WINDOW = 2048
FREQUENT = 40  # lengths whose pairs make the enumerated combinations of three
MAX_GAP = 8  # tokens of padding a greedy combination may leave


def combinations(histogram: np.ndarray, window: int, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Exact fills of two lengths, and of three of which two are frequent; lengths must occur."""
    have = np.flatnonzero(histogram)
    there = set(have.tolist())
    out = {(a, window - a) for a in there if 2 * a >= window and (window - a) in there}
    top = sorted(there, key=lambda n: (-histogram[n], n))[:frequent]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and c in there:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def solve_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference of pattern lengths and histogram, by cyclic
    coordinate steps (each exact in its coordinate, so the loss never rises)."""
    x = np.zeros(len(patterns))
    left = histogram.astype(float).tolist()
    columns = [[(n, p.count(n)) for n in set(p)] for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            new = max(0.0, x[j] + sum(m * left[n] for n, m in c) / norms[j])
            d = new - x[j]
            if d:
                x[j] = new
                moved = max(moved, abs(d))
                for n, m in c:
                    left[n] -= m * d
        if moved < 0.25:
            break
    return x


@dataclass
class Plan:
    """Where the rests of each length go: rows (length, first rank, per sequence, offset, first sequence), sorted;
    per sequence 0: the chain, with its position in place of the offset."""

    window: int
    table: np.ndarray
    first: np.ndarray  # of each length in the table
    chain_at: int  # sequence number where the chain begins
    full_at: int  # and where full windows begin

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each rest; a rest in the chain may go on in the next sequence."""
        key = length * np.int64(1 << 44) + rank
        row = self.table[np.searchsorted(self.table[:, 0] * np.int64(1 << 44) + self.table[:, 1], key, "right") - 1]
        t, m = rank - row[:, 1], row[:, 2]
        k = np.maximum(m, 1)
        position = row[:, 3] + t * length
        sequence = np.where(m > 0, row[:, 4] + t // k, self.chain_at + position // self.window)
        return sequence, np.where(m > 0, row[:, 3] + t % k * length, position % self.window)


def make_plan(histogram: np.ndarray, window: int = WINDOW, max_gap: int = MAX_GAP) -> Plan:
    """Histogram of rests (index: length below the window) -> plan. Driver work bounded by the window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[tuple[int, ...], int]] = []
    patterns = combinations(left, window)
    counts = solve_counts(patterns, left)
    for j in np.argsort(-counts, kind="stable"):
        p = patterns[j]
        n = min([int(counts[j]), *(int(left[a]) // p.count(a) for a in set(p))])
        if n > 0:
            chosen.append((p, n))
            for a in p:
                left[a] -= n
    chain: dict[int, int] = {}
    while left.any():
        pattern: list[int] = []
        space, n = window, None
        avail = left.copy()
        while space > 0:
            fit = np.flatnonzero(avail[: min(space, window - 1) + 1])
            if not len(fit):
                break
            a = int(fit[-1])
            avail[a] -= 1
            pattern.append(a)
            space -= a
        if space <= max_gap:
            n = min(int(left[a]) // pattern.count(a) for a in set(pattern))
            chosen.append((tuple(pattern), n))
            for a in pattern:
                left[a] -= n
        else:  # nothing fills it: the longest goes to the chain, which is cut at the windows
            chain[pattern[0]] = chain.get(pattern[0], 0) + int(left[pattern[0]])
            left[pattern[0]] = 0
    rows, used, sequence = [], np.zeros(window, np.int64), 0
    for p, n in chosen:
        offset = 0
        for a in sorted(set(p), reverse=True):
            m = p.count(a)
            rows.append((a, int(used[a]), m, offset, sequence))
            used[a] += m * n
            offset += m * a
        sequence += n
    position = 0
    for a in sorted(chain, reverse=True):
        rows.append((a, int(used[a]), 0, position, 0))
        position += a * chain[a]
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(window, table, np.unique(table[:, 0]), sequence, sequence + -(-position // window))


def pack(docs: DataFrame, tokenizer_file: str, *, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row of ``docs`` is a document of its own, repeated and null doc_ids too; a null text is empty and
    has the end id alone. Sequences have at most ``window`` tokens, pieces in one lie gapless from 0. All but
    the last of the chain and greedy ones with a gap of at most ``MAX_GAP`` are full. Other columns are
    ignored; an empty table gives an empty result. Ranks among equal lengths come from buckets (a count
    per bucket before it, and the rank in it), so a length that a third of all rows share is many tasks.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batch):
        code = encoder(tokenizer_file)
        ids, bounds = code.encode(column(batch, "text"))
        ids = np.insert(ids, bounds[1:], end_id).astype(code.dtype)
        bounds = bounds + np.arange(len(bounds))
        width = code.dtype.itemsize
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((bounds * width).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(bounds)), pa.array(np.full(batch.num_rows, width)), data.cast(pa.binary())], names=["doc_id", "n", "width", "ids"])

    coded = map_batches(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n long, width long, ids binary")
    tokens = stage(coded.withColumn("row", F.monotonically_increasing_id()), "ids")
    buckets = 4 * partitions(docs.sparkSession)
    rests = tokens.select("row", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("full"), F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    counts = stage(rests.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("full")), "lengths")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rows").alias("n")).collect():  # at most ``window`` rows
        histogram[r["rest"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window))
    # Groups are (length, bucket): rank and full windows before a row, within its group and before the group.
    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_rest = counts.groupBy("rest").agg(F.sum("full").alias("of_rest"))
    rest_before = F.coalesce(F.sum("of_rest").over(Window.orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``window`` rows
    per_rest = per_rest.select("rest", rest_before.alias("full_rest"))
    groups = counts.select(
        "rest", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rank0"), F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full0")
    ).join(per_rest, "rest")
    own = Window.partitionBy("rest", "bucket").orderBy("row")
    ranked = rests.withColumn("rank", F.row_number().over(own) - 1).withColumn(
        "fulls", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = stage(
        ranked.join(groups, ["rest", "bucket"]).select("row", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("fulls") + F.col("full0") + F.col("full_rest")).alias("fulls")),
        "ranks",
    )

    def cut(batch):
        p = plan.value
        doc, n, width = column(batch, "doc_id"), column(batch, "n").to_numpy(), column(batch, "width").to_numpy()
        rank, fulls = column(batch, "rank").to_numpy(), column(batch, "fulls").to_numpy()
        rest, full = n % p.window, n // p.window
        some = np.flatnonzero(rest)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if len(some):
            sequence[some], offset[some] = p.place(rest[some], rank[some])
        here = np.minimum(rest, p.window - offset)  # of a rest in its first sequence
        count = full + (rest > 0) + (rest > here)
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        late = k - full[row]  # below 0: a full window; 0: the rest; 1: what goes on in the next sequence
        start = np.where(late > 0, full[row] * p.window + here[row], k * p.window)
        length = np.where(late < 0, p.window, np.where(late > 0, (rest - here)[row], here[row]))
        at = np.where(late < 0, p.full_at + fulls[row] + k, sequence[row] + late)
        where = np.where(late == 0, offset[row], 0)
        data = column(batch, "ids").cast(pa.large_binary())
        bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(n) + 1]
        ids = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u2" if width[0] == 2 else "<u4").astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces follow one another as the ids do
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
        made = [doc.take(pa.array(row)), pa.array(start), pa.array(length), pieces.cast(pa.binary()), pa.array(n[row]), pa.array(at), pa.array(where)]
        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_batches(tokens.join(placed, "row").select("doc_id", "n", "width", "ids", "rank", "fulls"), cut, schema)
