"""Near-duplicate embeddings by product quantisation.

Vectors are put into coarse inverted lists; the residual to the list's centre is coded by
subspace. A vector is compared with its own list and with each list that may hold a
partner: a list behind a plane farther away than the largest distance of a link can't, so
the probes lose nothing. Inside a list, distances come from lookup tables (exact query
against coded member); a member's known coding error widens the limit, so this filter loses
nothing either. What passes is compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, map_batches, prepare, stage

SAMPLE = 20_000  # vectors the centres and codes are trained on; every vector is indexed
PER_LIST = 256  # vectors a coarse list holds on average, as far as the sample allows
CODES = 64
MEMBER_BLOCK, QUERY_BLOCK = 4096, 8192  # rows of one comparison task


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return d.argmin(1), np.maximum(d, 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        to, _ = _nearest(x, centres)
        n = np.bincount(to, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, to, x)
        full = n > 0
        centres[full] = total[full] / n[full, None]
    return centres


class Quantiser:
    """Coarse centres and one codebook per subspace, of unit vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centres = _kmeans(x, lists)
        to, _ = _nearest(x, self.centres)
        rest = x - self.centres[to]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(8, x.shape[1]))
        self.books = [_kmeans(rest[:, c], CODES) for c in self.cuts]

    def assign(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list, and the later lists that may hold vectors within ``reach``."""
        own, d = _nearest(x, self.centres)
        apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(2), 1e-18)) if len(self.centres) <= 512 else None
        probes = []
        for i, c in enumerate(own):
            gap = apart[c] if apart is not None else np.sqrt(np.maximum(((self.centres - self.centres[c]) ** 2).sum(1), 1e-18))
            to_plane = (d[i] - d[i, c]) / (2 * gap)
            near = np.flatnonzero(to_plane <= reach + 1e-6)
            probes.append(near[near > c].astype(np.int32))
        return own, probes

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance between each vector and its coded form."""
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, c], b)[0] for c, b in zip(self.cuts, self.books)], 1)
        coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def tables(self, x: np.ndarray, which: int) -> list[np.ndarray]:
        """Squared distances of each query to each code, by subspace."""
        rest = x - self.centres[which]
        return [_nearest(rest[:, c], b)[1] for c, b in zip(self.cuts, self.books)]


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _links(q: Quantiser, which: int, members: np.ndarray, queries: np.ndarray, threshold: float, same: bool):
    """Yield (query index, linked member indices) by table lookups and exact cosines."""
    reach = np.sqrt(2 - 2 * threshold)
    codes, error = q.encode(members, np.full(len(members), which))
    limit = (reach + error + 1e-6) ** 2
    step = max(1, 2_000_000 // max(1, len(members)))
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        near = sum(t[:, codes[:, m]] for m, t in enumerate(q.tables(part, which))) <= limit
        if same:  # each pair once: members after the query
            near &= np.arange(len(members))[None] > np.arange(lo, lo + len(part))[:, None]
        rows = np.flatnonzero(near.any(1))
        for i in rows:
            at = np.flatnonzero(near[i])
            hit = at[members[at] @ part[i] >= threshold]
            if len(hit):
                yield lo + i, hit


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors``.

    Rows link when their labels are equal and not null and the cosine in doubles reaches the
    threshold. Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing and stand alone, as do rows with a null label. Vectors of different lengths don't link.
    Equal vectors are one node with a count: copies link with each other, but are compared once.
    A repeated vec_id is a row of its own; a null vec_id is never a component's id. Other columns are
    ignored; an empty table gives an empty result.

    A list with many members or queries is cut into blocks, each pair of blocks a task of its
    own. A task returns counts and a spanning forest of its links, not its pairs.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(
        "vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"),
        F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding", "label").alias("h2"),
    )
    groups = rows.where("fine").groupBy("h1", "h2").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"),
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"),
    )
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    keys = rows.select("vec_id", "fine", "h1", "h2")

    models = {}
    for size, n in nodes.groupBy(F.size("embedding")).count().collect():  # one row per vector length
        taken = nodes.where(F.size("embedding") == size).select("embedding").orderBy(F.xxhash64("h1"), "node").limit(sample).toArrow()
        x = _unit(_matrix(taken["embedding"].combine_chunks(), size))
        models[size] = Quantiser(x, int(np.clip(n // PER_LIST, 1, max(1, len(x) // 4))))
    shared = spark.sparkContext.broadcast(models)  # at most ``sample`` / 4 centres per length
    reach = float(np.sqrt(2 - 2 * threshold))

    def assign(batch):
        lengths = np.diff(column(batch, "embedding").offsets.to_numpy())
        for size in np.unique(lengths):
            part = batch.filter(pa.array(lengths == size))
            own, probes = shared.value[size].assign(_unit(_matrix(column(part, "embedding"), size)), reach)
            yield pa.RecordBatch.from_arrays(
                [column(part, "node"), pa.array(own, pa.int32()), pa.array(probes, pa.list_(pa.int32()))], names=["node", "list", "probes"]
            )

    listed = map_batches(nodes.select("node", "embedding"), assign, "node long, list int, probes array<int>")
    placed = stage(
        listed.join(nodes.select("node", "label", "embedding", "copies"), "node").withColumn("size", F.size("embedding")), "lists"
    )
    key = ["label", "size", "list"]
    visits = placed.select("node", "label", "size", F.explode("probes").alias("list"))
    blocks = placed.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("mb")).join(
        visits.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb")), key, "left"
    ).na.fill(0, ["qb"])
    blocks = stage(blocks, "blocks")
    data = ["node", "embedding", "copies"]
    mine = F.pmod(F.xxhash64("node"), F.col("mb")).cast("int")
    members = placed.join(blocks, key).withColumn("own", mine)
    theirs = placed.select("node", "label", "size", F.explode("probes").alias("list"), "embedding", "copies").join(blocks, key)
    as_member = members.select(*key, *data, F.col("own").alias("lb"), F.explode(F.sequence("own", F.col("mb") + F.col("qb") - 1)).alias("rb"), F.lit(True).alias("member"))
    as_query = members.where("own > 0").select(*key, *data, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("lb"), F.col("own").alias("rb"), F.lit(False).alias("member"))
    visiting = theirs.withColumn("rb", F.col("mb") + F.pmod(F.xxhash64("node"), F.col("qb")).cast("int")).select(
        *key, *data, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("lb"), "rb", F.lit(False).alias("member")
    )

    def compare(table: pa.Table) -> pa.Table:
        size, which = table["size"][0].as_py(), table["list"][0].as_py()
        same = table["lb"][0].as_py() == table["rb"][0].as_py()
        q = shared.value[size]
        table = table.combine_chunks()
        x = _unit(_matrix(table["embedding"].combine_chunks() if isinstance(table["embedding"], pa.ChunkedArray) else table["embedding"], size))
        node, copies, member = (table[c].to_numpy() for c in ("node", "copies", "member"))
        left = np.flatnonzero(member)
        right = left if same else np.flatnonzero(~member)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(left) and len(right):
            for i, hit in _links(q, which, x[left], x[right], threshold, same):
                i, hit = right[i], left[hit]
                links[hit] += copies[i]
                links[i] += copies[hit].sum()
                roots = np.unique(label[np.append(hit, i)])
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
        at = np.flatnonzero(links)
        return pa.table({"node": node[at], "links": links[at], "root": node[label[at]]})

    tasks = as_member.unionByName(as_query).unionByName(visiting)
    found = stage(tasks.groupBy(*key, "lb", "rb").applyInArrow(compare, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(parts, nodes.node == parts.v, "left").select("node", "h1", "h2", "copies", "least", F.coalesce("c", "node").alias("c"))
    named = stage(named, "members")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    result = stage(
        named.join(least, "c").join(counts, "node", "left").select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes"
    )
    joined = keys.join(result, ["h1", "h2"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("fine"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
