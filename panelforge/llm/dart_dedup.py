"""Near-duplicate texts by DartMinHash on five-word shingles weighted by their counts.

Each unit of an element's weight is a region of its own, at which darts are thrown by a
hashed Poisson process along the rank axis. A text throws the darts of its elements up to
a rank that grows as its weight shrinks, so every text sees about the same number of darts.
A dart falls on one of K coordinates by hash, and each coordinate keeps the earliest. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interim, column, connected_components, discard, map_batches, mix64, prepare, stage
from .text_arrays import WINDOW, Texts, repeated, slices

ROWS_PER_BAND, BANDS = 5, 26  # a pair of similarity 0.8 shares no band with chance 3e-5
K = ROWS_PER_BAND * BANDS
BLOCK_TEXTS, BLOCK_ELEMENTS = 512, 1_000_000  # of a band that still holds several classes, compared at once
_STEP = np.uint64(0xD1B54A32D192ED03)
_UNIT = np.uint64(0xA24BAED4963EE407)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each window of five words; a text of one to four words has one shingle of them all."""
    _, text, h = t.windows()
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < WINDOW))
    if len(short):
        w = t.word_hashes
        with np.errstate(over="ignore"):
            whole = np.array([mix64(np.array([sum(int(x) * 31**j for j, x in enumerate(w[t.word_bounds[i] : t.word_bounds[i + 1]])) & (2**64 - 1)], np.uint64))[0] for i in short], np.uint64)
        text, h = np.concatenate([text, short]), np.concatenate([h, whole])
    return text, h


def weigh(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, element) with its count."""
    at, first = repeated(text, h)
    count = np.ones(len(h))
    if len(at):
        run = np.cumsum(first) - 1
        n = np.bincount(run)
        count[at] = np.where(first, n[run], 0)
    keep = count > 0
    return text[keep], h[keep], count[keep]


def dart_signatures(n: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int = K) -> np.ndarray:
    """Signatures (n, k) of sparse weighted sets, weights real and positive; a text without elements gets zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weight, minlength=n)
    todo, reach = np.flatnonzero(total > 0), k * (np.log(k) + 2.5)
    while len(todo):
        local = np.full(n, -1)
        local[todo] = np.arange(len(todo))
        mine = local[text] >= 0
        tx, el, w = local[text[mine]], element[mine], weight[mine]
        regions = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(w)), regions)
        number = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
        part = np.minimum(w[at] - number, 1.0)  # of the region, that the weight fills
        limit = (reach / total[todo])[tx[at]]
        with np.errstate(over="ignore"):
            state = mix64(el[at] + number.astype(np.uint64) * _UNIT)
        slot0, rank = tx[at] * k, np.zeros(len(at))
        best, sig = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(state):
            with np.errstate(over="ignore"):
                state = state + _STEP
            dart = mix64(state)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            go = np.flatnonzero(rank < limit)
            state, rank, limit, slot0, part, dart = state[go], rank[go], limit[go], slot0[go], part[go], dart[go]
            place = mix64(dart)
            hit = np.flatnonzero((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 < part) if (part < 1).any() else slice(None)
            slot = slot0[hit] + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[hit])
            darts.append((slot, rank[hit], place[hit]))
        for slot, r, place in darts:
            won = r == best[slot]
            sig[slot[won]] = place[won]
        sig, best = sig.reshape(-1, k), best.reshape(-1, k)
        done = np.isfinite(best).all(1)
        out[todo[done]] = sig[done]
        todo, reach = todo[~done], reach * 2
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    parts = signatures.reshape(len(signatures), -1, rows)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None] + np.uint64(1)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key * _UNIT + parts[:, :, r])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of elements, repeated by their counts."""
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(cx[i], cy[j]).sum())
    return shared / max(1, len(a) + len(b) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""

    def check(batch):
        a, b = column(batch, "sa"), column(batch, "sb")
        good, last, left = [], None, None
        for i in range(batch.num_rows):
            data = a[i].as_buffer()
            left = np.frombuffer(data, np.uint64)
            good.append(similarity(left, np.frombuffer(b[i].as_buffer(), np.uint64)) >= threshold)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("sb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("sa")), "a")
    return map_batches(two.select("a", "b", "sa", "sb"), check, "a long, b long")


def _compare(rows: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links between classes among the texts of one pair of blocks of a band: a forest, found by exact similarity.

    A pair is looked at in the first band that both texts share, so other bands don't repeat it.
    """
    band, same = rows[0]["band"], rows[0]["lb"] == rows[0]["rb"]
    bands = np.array([r["bands"] for r in rows], np.int64)
    at = int(np.flatnonzero(bands[0] == band)[0])
    sets = [np.unique(np.frombuffer(r["elements"], np.uint64), return_counts=True) for r in rows]
    _, local = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
    counts = np.concatenate([c for _, c in sets])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])])
    total = np.array([c.sum() for _, c in sets])
    _, label = np.unique([r["c"] for r in rows], return_inverse=True)
    is_left = np.array([r["left"] for r in rows])
    have, out = np.zeros(int(local.max()) + 1, np.int64), []
    for i in np.flatnonzero(is_left):
        others = np.arange(i + 1, len(rows)) if same else np.flatnonzero(~is_left)
        others = others[label[others] != label[i]]
        few, many = np.minimum(total[others], total[i]), np.maximum(total[others], total[i])
        others = others[few >= threshold * many]
        others = others[~(bands[others, :at] == bands[i, :at]).any(1)]
        if not len(others):
            continue
        mine = slice(bounds[i], bounds[i + 1])
        have[local[mine]] = counts[mine]
        size = bounds[others + 1] - bounds[others]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(bounds[others] - (ends - size), size)
        shared = np.add.reduceat(np.minimum(have[local[take]], counts[take]), ends - size)
        have[local[mine]] = 0
        for j in others[shared / (total[others] + total[i] - shared) >= threshold]:
            if label[j] != label[i]:
                out.append((rows[i]["node"], rows[j]["node"]))
                label[label == label[j]] = label[i]
    return out


def _joined_in_tasks(tasks: DataFrame, threshold: float) -> DataFrame:
    """Run ``_compare`` over the groups of sorted partitions, one group in memory at a time."""
    prepare(tasks.sparkSession)

    def run(batches):
        group, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = (row["band"], row["lb"], row["rb"])
                if now != key and group:
                    out += _compare(group, threshold)
                    group = []
                key = now
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if group and (out := _compare(group, threshold)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    columns = ["band", "lb", "rb", "left", "node", "c", "bands", "elements"]
    return tasks.select(*columns).mapInArrow(run, "a long, b long")


def _classes(nodes: DataFrame, edges: DataFrame, interim: Interim) -> DataFrame:
    parts = connected_components(edges)
    classes = interim.stage(nodes.join(parts, nodes.node == parts.v, "left").select("node", "n", F.coalesce("c", "node").alias("c")), "classes")
    discard(parts)
    return classes


def near_texts(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``class_id``, ``kept``, ``copies``, the text's keys ``h1``, ``h2`` and its ``component``, for each row of ``docs``.

    A class holds texts that a chain of pairs of weighted Jaccard similarity >= ``threshold`` connects; equal texts
    (null counts as empty) are always of one class. ``class_id`` is its smallest doc_id and ``kept`` marks the rows of that
    id; ``copies`` counts the rows of equal doc_id and text. Texts without words are only equal to each other. A
    null doc_id never names a class unless the class has no other. A ``class_id`` that is null or stands on several texts may name
    several classes; ``component`` tells them apart, but differs from run to run. Other columns are ignored; an empty table gives an empty result.

    Equal texts are one node. Texts that share a band are candidates: first each with the smallest node of its bands,
    then with the others; where a band still holds several classes, its texts are compared block by block inside tasks, but
    for pairs already connected. Only links that connect nothing new stay unchecked, so no class is missed.
    Every link is checked on the whole texts, and pairs are never written out.
    """

    def sign(batch):
        for lo, hi, t in slices(column(batch, "text")):
            text, h = shingles(t)
            total = np.bincount(text, minlength=t.n)
            keys = band_keys(dart_signatures(t.n, *weigh(text, h)))
            rows = [keys[i] if total[i] else np.zeros(0, np.int64) for i in range(t.n)]
            own = [column(batch, c).slice(lo, hi - lo) for c in ("doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total.astype(np.int64)), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "n", "bands"])

    kind, interim = dict(docs.dtypes)["doc_id"], Interim()
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(9), text).alias("h2"))
    signed = interim.stage(map_batches(source, sign, f"doc_id {kind}, h1 long, h2 long, n long, bands array<long>"), "signatures")
    grouped = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = interim.stage(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = interim.stage(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "bands")
    members = interim.stage(banded.join(shared, "band").select("band", "node", "n", "pivot"), "members")
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pn"))
    every = members.where("node <> pivot").select("node", "n", "pivot").distinct().join(sizes, "pivot")
    fits = (F.col("n") >= F.col("pn") * threshold) & (F.col("pn") >= F.col("n") * threshold)  # else the sizes alone keep them apart
    star = interim.stage(every.where(fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")), "pairs")

    wanted = members.select("node").distinct()
    chosen = nodes.join(wanted, "node").select("node", "least", F.col("h1").alias("k1"), F.col("h2").alias("k2"))

    def collect(batch):
        for lo, hi, t in slices(column(batch, "text")):
            text, h = shingles(t)
            order = np.lexsort((h, text))
            cut = np.searchsorted(text[order], np.arange(t.n + 1))
            h = h[order]
            rows = [h[cut[i] : cut[i + 1]].tobytes() for i in range(t.n)]
            yield pa.RecordBatch.from_arrays([column(batch, "node").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["node", "elements"])

    found = source.join(chosen, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")
    sets = interim.stage(map_batches(found, collect, "node long, elements binary").dropDuplicates(["node"]), "sets")

    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = interim.stage(_verified(first, sets, threshold), "links")
    classes = _classes(nodes, edges, interim)
    ca = classes.select(F.col("node").alias("a"), F.col("c").alias("ca"))
    cb = classes.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    second = star.join(first.select("b", F.col("a").alias("tried")), "b").where("a <> tried").select("a", "b")
    second = interim.stage(second.join(ca, "a").join(cb, "b").where("ca <> cb").select("a", "b"), "pairs")
    if not second.isEmpty():
        edges = interim.stage(edges.union(_verified(second, sets, threshold)), "links")
        classes = _classes(nodes, edges, interim)
    # What still meets in a band but not in a class is compared inside tasks, which return only links that join classes.
    placed = members.join(classes.select("node", "c"), "node")
    counts = placed.groupBy("band", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.sum("size") / BLOCK_TEXTS, F.sum("elements") / BLOCK_ELEMENTS)).cast("int")
    mixed = interim.stage(counts.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), blocks.alias("mb")).where("classes > 1").drop("classes"), "mixed")
    if not mixed.isEmpty():
        met = placed.join(mixed, "band").select("band", "node", "c", "mb", F.pmod(F.xxhash64("node"), F.col("mb")).cast("int").alias("own"))
        left = met.select("band", "node", "c", F.col("own").alias("lb"), F.explode(F.sequence("own", F.col("mb") - 1)).alias("rb"), F.lit(True).alias("left"))
        right = met.where("own > 0").select("band", "node", "c", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("lb"), F.col("own").alias("rb"), F.lit(False).alias("left"))
        parts = interim.stage(left.union(right), "open")
        known = interim.stage(sets.join(nodes.select("node", "bands"), "node"), "sets")
        tasks = parts.join(known, "node").repartition("band", "lb", "rb").sortWithinPartitions("band", "lb", "rb")
        edges = interim.stage(edges.union(_joined_in_tasks(tasks, threshold)), "links")
        classes = _classes(nodes, edges, interim)
    full = classes.select("node", "c").join(nodes.select("node", "h1", "h2", "least"), "node")
    least = full.groupBy("c").agg(F.min("least").alias("class_id"))
    named = interim.stage(full.join(least, "c").select("h1", "h2", "class_id", F.col("c").alias("component")), "named")
    rows = signed.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")).join(named, ["h1", "h2"])
    one = stage(rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "copies", "h1", "h2", "component"), "result")
    interim.discard()
    return one.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__each")


def keep_one(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One document of each class, with the columns of ``docs``; see ``near_texts``."""
    classes = near_texts(docs, threshold=threshold)
    # Within a class the kept rows have one doc_id, which may stand on several of its texts; one of them stays.
    first = F.min(F.struct("h1", "h2", F.col("doc_id").alias("id"), "copies")).alias("one")
    chosen = classes.where("kept").groupBy("component").agg(first)
    chosen = stage(chosen.select(F.col("one.id").alias("__id"), F.col("one.h1").alias("__h1"), F.col("one.h2").alias("__h2"), F.col("one.copies").alias("__copies")), "kept")
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(
        chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h1")) & (F.xxhash64(F.lit(9), text) == F.col("__h2"))
    )
    if chosen.where("__copies > 1").isEmpty():
        return joined.select(*docs.columns)
    twice = joined.where("__copies > 1").dropDuplicates(["__id", "__h1", "__h2"])
    return joined.where("__copies = 1").select(*docs.columns).union(twice.select(*docs.columns))
