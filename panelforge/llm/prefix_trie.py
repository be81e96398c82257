"""Trie of the shared beginnings of conversations, built by union-find over neighbours in sorted order.

Conversations are sorted by their turns. Two neighbours are joined by an edge as deep as the beginning they share;
edges are taken from the deepest on, and each union of two components makes their branching node, between
which lie unary nodes. A sorted partition is cut into blocks. A block closes every node that touches neither of its ends; what is
left, the nodes on the paths of its first and last conversation with the sums of all that hangs below them, is its contracted
forest. Contracted forests of neighbouring blocks are merged by the same union-find until one is left.

Long conversations are cut into chunks of turns. Chunks of one depth make tries of their own, one for each beginning,
whose roots hand their sums to the conversation's chunk above. So no row and no key grows with a conversation.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interim, column, map_batches, prepare, stage

HEADS, SPREAD = 6, 100  # shared turns are crc32 % HEADS; ids of one hundred share the head of the first
CHUNK = 256  # turns of a conversation in one row
BLOCK, BLOCK_BYTES = 20_000, 32 << 20  # chunks a block holds at most
FAN = 6  # bits: contracted forests of 64 partitions are merged at once
SEQ = 20  # bits of a block's number within its partition
WIDTH = 16  # bytes of a turn's digest
ROOT = bytes(WIDTH)
TURN = "conv_id long, pos long, digest binary, chars long"
ROWS = (
    "kind string, conv_id long, depth long, parent long, parent_key binary, n_convs long, n_children long, n_leaves long, "
    "saved long, ends string, key binary, ord long, side int, path binary, chars array<long>, payload binary"
)
_ARROW = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("parent_key", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("key", pa.binary()), ("ord", pa.int64()), ("side", pa.int32()), ("path", pa.binary()), ("chars", pa.list_(pa.int64())), ("payload", pa.binary()),
])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def node_key(path: bytes, depth: int) -> bytes:
    """Name of the node ``depth`` elements down a path, whose first element names the trie; the root has that name."""
    return path[:WIDTH] if depth == 1 else hashlib.sha256(path[: WIDTH * depth]).digest()[:WIDTH]


def shared_depth(p: bytes, q: bytes) -> int:
    """Elements that two paths share from their beginning."""
    most = min(len(p), len(q)) // WIDTH
    if p[: most * WIDTH] == q[: most * WIDTH]:
        return most
    return bisect_left(range(1, most + 1), True, key=lambda d: p[: d * WIDTH] != q[: d * WIDTH])


class _Component:
    """A run of neighbours, the sums below and at its topmost node, and sums that wait further up its path."""

    __slots__ = ("lo", "hi", "depth", "convs", "low", "children", "leaves", "saved", "ends", "more", "waiting", "above")

    def __init__(self, at: int, depth: int, payload: dict[int, tuple]):
        self.lo = self.hi = at
        self.depth, self.above = depth, payload
        self.clear()
        self.take(depth)

    def clear(self) -> None:
        self.convs, self.low, self.children, self.leaves, self.saved, self.ends, self.more, self.waiting = 0, None, 0, 0, 0, [], False, []

    def take(self, depth: int) -> None:
        """Arrive at ``depth``, with the sums that wait there."""
        self.depth = depth
        if depth in self.above:
            convs, low, children, leaves, saved, ends, more = self.above.pop(depth)
            self.convs += convs
            self.low = low if self.low is None else self.low if low is None else min(self.low, low)
            self.children, self.leaves, self.saved, self.more = self.children + children, self.leaves + leaves, self.saved + saved, self.more or more
            self.ends.extend(ends)

    def join(self, other: _Component) -> None:
        """Take in the right neighbour, at the same depth."""
        self.hi = other.hi
        self.convs += other.convs
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.children, self.leaves, self.saved, self.more = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved, self.more or other.more
        self.ends.extend(other.ends)
        self.waiting.extend(other.waiting)
        for depth, (convs, low, children, leaves, saved, ends, more) in other.above.items():
            mine = self.above.get(depth, (0, None, 0, 0, 0, [], False))
            least = low if mine[1] is None else mine[1] if low is None else min(mine[1], low)
            self.above[depth] = (mine[0] + convs, least, mine[2] + children, mine[3] + leaves, mine[4] + saved, [*mine[5], *ends], mine[6] or more)


class Forest:
    """The tries of a block of sorted entries (path, characters by depth, sums by depth).

    ``rows`` holds closed nodes, ``spines`` the contracted forest, ``tails`` the conversations that end at open nodes.
    """

    def __init__(self, entries: list[tuple], *, level: int, chunk: int, final: bool, named: bool):
        self.entries, self.level, self.chunk, self.final, self.named = entries, level, chunk, final, named
        self.rows: list[list] = []
        self.spines: list[dict[int, tuple]] = [{}, {}]
        self.tails: list[tuple[bytes, str]] = []
        self.unite()

    def unite(self) -> None:
        entries = self.entries
        deep = np.array([shared_depth(entries[i][0], entries[i + 1][0]) for i in range(len(entries) - 1)], np.int64)
        parts = [_Component(i, len(e[0]) // WIDTH, e[2]) for i, e in enumerate(entries)]
        leader = list(range(len(entries)))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = i = leader[leader[i]]
            return i

        for i in np.argsort(-deep, kind="stable").tolist():
            depth = int(deep[i])
            if depth == 0:
                break  # other tries
            left, right = find(i), find(i + 1)
            self.lift(parts[left], depth)
            self.lift(parts[right], depth)
            parts[left].join(parts[right])
            leader[right] = left
        for i in range(len(entries)):
            if leader[i] == i:
                self.lift(parts[i], 1)
                self.root(parts[i])

    def is_open(self, part: _Component) -> bool:
        return not self.final and (part.lo == 0 or part.hi == len(self.entries) - 1)

    def keep(self, part: _Component) -> None:
        """Leave an open node's sums on its spine."""
        path = self.entries[part.lo][0]
        if part.convs or part.children or part.more:
            self.spines[0 if part.lo == 0 else 1][part.depth] = (part.convs, part.low, part.children, part.leaves, part.saved, [], part.more or bool(part.ends))
        if part.waiting or part.ends:
            key = node_key(path, part.depth)
            for row in part.waiting:
                row[4] = key
            if part.ends:
                self.tails.append((key, ",".join(map(str, part.ends))))

    def row(self, part: _Component, depth: int) -> list:
        """A closed node; its parent is filled in later."""
        path = self.entries[part.lo][0]
        here = depth == part.depth
        if here and part.more:
            ends = None
        else:
            ends = hashlib.sha256(",".join(map(str, part.ends)).encode()).hexdigest() if here and part.ends else _NO_ENDS
        key = node_key(path, depth) if self.named or depth == self.chunk + 1 else None
        return ["node", part.low, self.level * self.chunk + depth - 1, None, None, part.convs, part.children, part.leaves, part.saved, ends, key]

    def lift(self, part: _Component, to: int) -> None:
        """Raise the topmost node of a component to ``to``; nodes on the way are closed, or kept if open."""
        while part.depth > to:
            stop = max([to, *(d for d in part.above if d < part.depth)]) if part.above else to
            if self.is_open(part):
                self.keep(part)
                part.clear()
            else:
                chars, low = self.entries[part.lo][1], part.low
                for depth in range(part.depth, stop, -1):
                    part.leaves = part.leaves or 1
                    part.saved += (part.convs - 1) * chars[depth - 2]
                    made = self.row(part, depth)
                    for row in part.waiting:
                        row[3] = low
                    self.rows.append(made)
                    part.waiting, part.children = [made], 1
                part.ends, part.more = [], False
            part.take(stop)

    def root(self, part: _Component) -> None:
        if self.is_open(part):
            self.keep(part)
            return
        made = self.row(part, 1)
        made[7] = made[7] or 1
        for row in part.waiting:
            if self.level:
                row[4] = self.entries[part.lo][0][:WIDTH]  # the node is in the trie above
            else:
                row[3] = part.low
        if self.level:
            made[0] = "root"
        self.rows.append(made)

    def batches(self, ord: int):
        """The rows, then the contracted forest and its tails, as Arrow batches."""
        rows = [[*r, ord, None, None, None, None] for r in self.rows]
        for key, tail in self.tails:
            rows.append(["tail", None, None, None, None, None, None, None, None, tail, key, ord, None, None, None, None])
        if not self.final:
            sides = [0] if len(self.entries) == 1 else [0, 1]
            for side in sides:
                path, chars, _ = self.entries[0 if side == 0 else -1]
                sums = self.spines[side] if len(sides) == 2 else self.spines[0] | self.spines[1]
                packed = np.array([(d, c, 0 if low is None else low, low is not None, k, v, s, m) for d, (c, low, k, v, s, _, m) in sums.items()], np.int64)
                rows.append(["open", *[None] * 10, ord, side, path, chars, packed.tobytes()])
        for i in range(0, len(rows), 5000):
            part = rows[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)


def _blocks(df: DataFrame, level: int, chunk: int, block: int) -> DataFrame:
    """Closed nodes and contracted forests of sorted partitions."""

    def run(batches):
        part, seq, entries, size = TaskContext.get().partitionId() << SEQ, 0, [], 0
        for batch in batches:
            trie, path, chars = (column(batch, c).to_pylist() for c in ("trie", "path", "chars"))
            for i, row in enumerate(batch.select(["conv_id", "ends", "children", "leaves", "saved"]).to_pylist()):
                conv = row["conv_id"]
                whole = trie[i] + path[i]
                sums = (1, conv, row["children"], row["leaves"], row["saved"], [conv] if row["ends"] else [], False)
                entries.append((whole, chars[i], {len(whole) // WIDTH: sums}))
                size += len(whole)
                if len(entries) >= block or size >= BLOCK_BYTES:
                    yield from Forest(entries, level=level, chunk=chunk, final=False, named=False).batches(part + seq)
                    seq, entries, size = seq + 1, [], 0
        if entries:
            yield from Forest(entries, level=level, chunk=chunk, final=False, named=False).batches(part + seq)

    prepare(df.sparkSession)
    return df.select("trie", "path", "chars", "conv_id", "ends", "children", "leaves", "saved").mapInArrow(run, ROWS)


def _merged(spines: DataFrame, shift: int, level: int, chunk: int, final: bool) -> DataFrame:
    """Contracted forests of neighbouring blocks, merged group by group."""

    def forest(rows: list[dict]) -> Forest:
        entries = []
        for r in rows:
            sums = {}
            for d, c, low, has, k, v, s, m in np.frombuffer(r["payload"], np.int64).reshape(-1, 8).tolist():
                sums[d] = (c, low if has else None, k, v, s, [], bool(m))
            entries.append((r["path"], r["chars"], sums))
        return Forest(entries, level=level, chunk=chunk, final=final, named=True)

    def run(batches):
        group, at = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ord"] >> shift != at and group:
                    yield from forest(group).batches(at << shift)
                    group = []
                at = row["ord"] >> shift
                group.append(row)
        if group:
            yield from forest(group).batches(at << shift)

    near = spines.select("ord", "side", "path", "chars", "payload", F.expr(f"shiftright(ord, {shift})").alias("near"))
    near = near.repartition("near").sortWithinPartitions("near", "ord", "side")
    return near.select("ord", "side", "path", "chars", "payload").mapInArrow(run, ROWS)


def numbered_turns(conversations: DataFrame, interim: Interim) -> DataFrame:
    """Each turn's place in its conversation (``conv_id``, ``pos``, ``digest``, ``chars``), counted over sorted partitions.

    Turns of equal number go by role, the first 32 characters and a digest, so that the order is always the same.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        F.substring(digest, 1, WIDTH).alias("digest"), F.char_length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "digest"]

    def number(batches):
        part, last, have = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = column(batch, "conv_id").to_numpy()
            if not len(conv):
                continue
            new = np.concatenate([[True], conv[1:] != conv[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            pos = np.arange(len(conv)) - first + np.where(conv == last, have, 0) * (first == 0)
            last, have = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [column(batch, "conv_id"), pa.array(pos), column(batch, "digest"), column(batch, "chars"), pa.array(np.full(len(conv), part))], names=["conv_id", "pos", "digest", "chars", "part"]
            )

    prepare(conversations.sparkSession)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = interim.stage(ordered.select("conv_id", "digest", "chars").mapInArrow(number, TURN + ", part long"), "turns")
    runs = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    cut = runs.join(runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "conv_id")
    before = cut.selectExpr("conv_id", "part", "sum(n) over (partition by conv_id order by part) - n as before")
    return interim.stage(local.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0).cast("long"))).alias("pos"), "digest", "chars"), "numbered")


def rebuilt_chunks(conversations: DataFrame, interim: Interim, chunk: int) -> DataFrame:
    """Rebuilt conversations in rows of at most ``chunk`` turns: ``conv_id``, ``level``, ``path``, ``chars``, ``ends``.

    A conversation without turns has one row with an empty path.
    """
    turns = numbered_turns(conversations, interim)
    heads = turns.where(f"conv_id % {SPREAD} = 0 and pos < {HEADS - 1}")
    have = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("have"))
    known = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    known = known.select("conv_id", "own", F.expr(f"conv_id - conv_id % {SPREAD}").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    head = F.least("h", F.coalesce("have", F.lit(0).cast("long")))
    known = interim.stage(known.join(have, "base", "left").withColumn("head", head).withColumn("total", F.expr("head + greatest(own - h, 0)")), "rebuilt")
    shared = heads.select(F.col("conv_id").alias("base"), "pos", "digest", "chars").join(known.select("base", "conv_id", "h", "total"), "base").where("pos < h")
    own = turns.join(known.select("conv_id", "h", "head", "total"), "conv_id").where("pos >= h").select("conv_id", F.expr("head + pos - h").alias("pos"), "digest", "chars", "total")
    every = shared.select("conv_id", "pos", "digest", "chars", "total").union(own)
    listed = every.groupBy("conv_id", F.expr(f"pos div {chunk}").alias("level"), "total").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))  # at most ``chunk``
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""))
    cut = listed.select("conv_id", "level", path.alias("path"), F.transform("turns", lambda t: t.chars).alias("chars"), ((F.col("level") + 1) * chunk >= F.col("total")).alias("ends"))
    bare = known.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("level"), F.lit(b"").alias("path"), F.array().cast("array<long>").alias("chars"), F.lit(True).alias("ends"))
    return interim.stage(cut.union(bare), "chunks")


def prefix_trie(conversations: DataFrame, *, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` per node.

    ``conversations`` has a row per turn (``conv_id``, ``turn``, ``role``, ``text``), ordered by turn, null first; a null role or text is
    empty, turns of equal number have the order of ``numbered_turns``, equal rows are turns of their own. A null
    conv_id belongs to no conversation. Conversations are rebuilt first, each with the head of its hundred. Every distinct beginning is a
    node, from the root of no turns; nodes are named by their smallest member and their depth. ``ends_sha256`` digests
    the ids of the members that end there, in ascending order. Other columns are ignored; an empty table has no nodes.

    Blocks and merges hold bounded rows; the ids that end at a node are hashed as a stream. Longer conversations
    than ``chunk`` take one more pass for each ``chunk`` turns.
    """
    spark, interim = conversations.sparkSession, Interim()
    chunks = rebuilt_chunks(conversations, interim, chunk)
    deepest = chunks.agg(F.max("level").alias("m")).collect()[0]["m"] or 0
    root, zero = F.lit(ROOT), F.lit(0).cast("long")
    tries = [chunks.where("level = 0").withColumn("trie", root)]
    for level in range(1, deepest + 1):  # the beginning a chunk follows names its trie
        name = F.substring(F.unhex(F.sha2(F.concat("trie", "path"), 256)), 1, WIDTH)
        above = tries[-1].where("not ends").select("conv_id", name.alias("trie"))
        tries.append(interim.stage(chunks.where(F.col("level") == level).join(above, "conv_id"), "tries"))
    made, sums = [], None
    for level in range(deepest, -1, -1):
        rows = tries[level]
        if sums is None:
            rows = rows.withColumn("children", zero).withColumn("leaves", zero).withColumn("saved", zero)
        else:
            rows = rows.join(sums, "conv_id", "left")
            for c in ("children", "leaves", "saved"):
                rows = rows.withColumn(c, F.coalesce(c, zero))
        rows = rows.repartitionByRange("trie", "path", "conv_id").sortWithinPartitions("trie", "path", "conv_id")
        made.append(interim.stage(_blocks(rows, level, chunk, block), "forest"))
        spines, shift = made[-1].where("kind = 'open'"), SEQ
        most = spines.agg(F.max("ord").alias("m")).collect()[0]["m"]
        final = most is None
        while not final:
            shift += FAN
            final = most >> shift == 0
            made.append(interim.stage(_merged(spines, shift, level, chunk, final), "forest"))
            spines = made[-1].where("kind = 'open'")
        roots = _all(made).where("kind = 'root'").where(F.col("depth") == level * chunk)
        sums = interim.stage(roots.select("conv_id", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), "saved"), "sums") if level else None

    every = _all(made)
    nodes = every.where("kind = 'node'").select("conv_id", "depth", "parent", "parent_key", "n_convs", "n_children", "n_leaves", "saved", "ends", "key")
    ended = _digests(every.where("kind = 'tail'").select("key", "ord", "ends"))
    named = nodes.where("ends is null").drop("ends").join(ended, "key").select(nodes.columns)
    nodes = interim.stage(nodes.where("ends is not null").union(named), "nodes")
    parents = nodes.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    found = nodes.where("parent_key is not null").join(parents, "parent_key").drop("parent").withColumnRenamed("up", "parent").select(nodes.columns)
    whole = nodes.where("parent_key is null").union(found)
    out = stage(whole.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")), "trie")
    interim.discard()
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.union(t)
    return whole


def _digests(tails: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each open node: (``key``, ``ends``), read in order, one piece at a time."""
    prepare(tails.sparkSession)

    def run(batches):
        at, state = None, None
        for batch in batches:
            keys, shas = [], []
            for row in batch.to_pylist():
                if row["key"] != at:
                    if state is not None:
                        keys.append(at)
                        shas.append(state.hexdigest())
                    at, state = row["key"], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ends"].encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    return tails.repartition("key").sortWithinPartitions("key", "ord").mapInArrow(run, "key binary, ends string")
