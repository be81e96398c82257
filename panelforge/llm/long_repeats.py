"""Passages that repeat across documents, found by level-wise doubling of word windows.

The shortest level looks at sampled windows only: of the windows of ``l`` words inside each window of twice that
length, the one of the least hash, which equal longer windows choose alike. Windows that one length finds in several
documents alone are extended to twice that length, at every place that covers them, until the asked length is
reached or no candidate survives. At the asked length every candidate is tested, so nothing is sampled there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interim, column, map_batches, mix64, stage
from .text_arrays import Texts, slices, window_hashes

SHORTEST = 16  # words; lengths are halved while they stay at least this long
NO_ID = 2**63 - 1
_OTHER = np.uint64(0x9FB21C651E98DF25)


def lengths(length: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before, the last as asked."""
    out = [length]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours; shorter than the input by width - 1."""
    pick, span = np.minimum if least else np.maximum, 1
    if len(values) < width:
        return values[:0]
    while span * 2 <= width:
        values, span = pick(values[:-span], values[span:]), span * 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _within(t: Texts, size: int) -> np.ndarray:
    """Whether the window of ``size`` words at each place lies in one text."""
    text = np.repeat(np.arange(t.n), t.n_words)
    return text[: max(0, len(text) - size + 1)] == text[size - 1 :]


def sampled(t: Texts, h: np.ndarray, size: int, longer: int) -> np.ndarray:
    """Places of windows of ``size`` words whose hash is the least within some window of ``longer`` words of their text."""
    width = longer - size + 1
    best = np.where(_within(t, longer), sliding(h, width), np.uint64(0))
    if not len(best):
        return np.zeros(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, best, edge]), width, least=False) == h)


def covering(t: Texts, h: np.ndarray, alive: np.ndarray, size: int, longer: int) -> np.ndarray:
    """Places of windows of ``longer`` words whose least window of ``size`` words is one of the places ``alive``.

    Other sampled windows inside say nothing: they may be sampled because of what surrounds this window only.
    """
    width = longer - size + 1
    best = sliding(h, width)
    lives = np.full(len(h), ~np.uint64(0))
    lives[alive] = h[alive]
    return np.flatnonzero(_within(t, longer) & (sliding(lives, width) == best))


def _per_text(t: Texts, places: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Places (word numbers within their text) and further values, as one binary a text."""
    cut = np.searchsorted(places, t.word_bounds)
    local = (places - np.repeat(t.word_bounds[:-1], np.diff(cut))).astype("<i4")
    return [pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in range(t.n)], pa.binary()) for v in (local, *values)]


def _window_rows(row: np.ndarray, ord: np.ndarray, n: np.ndarray, pos: np.ndarray, h: np.ndarray, g: np.ndarray):
    """Batches of one row per window, of documents with ``n`` windows each."""
    columns = [np.repeat(row, n), np.repeat(ord, n), pos, h, g]
    for i in range(0, len(pos), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in columns], names=["row", "ord", "pos", "h", "g"])


WINDOW_ROWS = "row long, ord long, pos int, h long, g int"


def _unpacked(df: DataFrame) -> DataFrame:
    """The windows sampled by the first pass: ``row``, ``ord``, ``pos``, ``h``, ``g``."""

    def run(batch):
        flat = [np.frombuffer(b"".join(column(batch, c).to_pylist()), kind) for c, kind in (("pos", "<i4"), ("h", "<i8"), ("g", "<i4"))]
        n = np.array([len(x) // 4 for x in column(batch, "pos").to_pylist()])
        yield from _window_rows(column(batch, "row").to_numpy(), column(batch, "ord").to_numpy(), n, *flat)

    return map_batches(df.select("row", "ord", "pos", "h", "g"), run, WINDOW_ROWS)


def _hashes(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the window at each place: 64 and 32 bits."""
    with np.errstate(over="ignore"):
        second = mix64(t.word_hashes ^ _OTHER)
    return window_hashes(t.word_hashes, size), (window_hashes(second, size) >> np.uint64(32)).astype(np.uint32).view("<i4")


def _windows(t: Texts, sizes: list[int], level: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows to be tested at a level: places and both hashes."""
    size, last = sizes[level], level == len(sizes) - 1
    h, g = _hashes(t, size)
    if level == 0:
        places = np.flatnonzero(_within(t, size)) if last else sampled(t, h, size, sizes[1])
    else:
        places = covering(t, window_hashes(t.word_hashes, sizes[level - 1]), alive, sizes[level - 1], size)
        if not last:
            places = np.intersect1d(places, sampled(t, h, size, sizes[level + 1]), assume_unique=True)
    return places, h[places].view("<i8"), g[places]


def _extended(texts: DataFrame, sizes: list[int], level: int) -> DataFrame:
    """The windows of a level that cover the places found alive at the one before."""

    def run(batch):
        for lo, hi, t in slices(column(batch, "text")):
            places = column(batch, "places").slice(lo, hi - lo)
            each = np.diff(places.offsets.to_numpy())
            alive = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(t.word_bounds[:-1], each)
            at, h, g = _windows(t, sizes, level, alive)
            n = np.diff(np.searchsorted(at, t.word_bounds))
            pos = (at - np.repeat(t.word_bounds[:-1], n)).astype("<i4")
            yield from _window_rows(*(column(batch, c).slice(lo, hi - lo).to_numpy() for c in ("row", "ord")), n, pos, h, g)

    return map_batches(texts.select("row", "ord", "text", "places"), run, WINDOW_ROWS)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join([w for w, g in zip(words, gone) if not g] if len(gone) else words)


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def long_repeats(docs: DataFrame, *, length: int = 50, texts: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` and ``kept_sha256`` for each row of ``docs``.

    A word (a run of other characters than the six ASCII blanks) goes if a window of ``length`` consecutive words covers
    it that also starts in a document of a smaller doc_id. All windows are judged on the input, whole texts, never on
    what is left. ``spans`` are the runs of removed words, as first word and number of words, ``kept_sha256``
    the digest of the kept words joined by one space. ``key`` is a hash of the text, by which ``drop_long_repeats`` finds it. With ``texts``, ``kept`` holds the kept words of texts that lost some.

    A null text is empty; texts shorter than a window keep all words. A null doc_id counts as larger than all others, so rows
    without one lose what numbered rows hold and lose nothing to each other; rows of one doc_id lose nothing to each other.
    Equal rows get equal results. Other columns are ignored; an empty table gives an empty result.

    Only hashes are shuffled, and the texts of documents with candidates; a window found in many documents is reduced
    map-side to its smallest doc_id, and a hot one is joined from written tables, which adaptive execution may split.
    """
    sizes, interim = lengths(length), Interim()
    ident = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.coalesce(ident, F.lit(NO_ID)).alias("ord"), ident.alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    names = ["ord", "doc_id", "k", "n_words", "sha", "pos", "h", "g"]

    def first(batch):
        for lo, hi, t in slices(column(batch, "text")):
            own = [column(batch, c).slice(lo, hi - lo) for c in names[:3]]
            raw = t.raw.tobytes()
            sha = [hashlib.sha256(_kept(raw[a:b], ())).hexdigest() for a, b in zip(t.bounds[:-1], t.bounds[1:])]
            yield pa.RecordBatch.from_arrays([*own, pa.array(t.n_words.astype(np.int64)), pa.array(sha, pa.string()), *_per_text(t, *_windows(t, sizes, 0, None))], names=names)

    numbered = lambda df: df.withColumn("row", F.monotonically_increasing_id())
    base = map_batches(source, first, "ord long, doc_id long, k long, n_words long, sha string, pos binary, h binary, g binary")
    held = base = interim.stage(numbered(base), "sampled")
    whole = source.select("ord", "k", "text")
    for level, size in enumerate(sizes):
        rows, last = _extended(held, sizes, level) if level else _unpacked(base), size == length
        repeated = rows.groupBy("h", "g").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most")
        repeated = interim.stage(repeated.select("h", "g", "least"), "repeated")
        lives = rows.join(repeated, ["h", "g"])
        alive = lives.where("least < ord") if last else lives
        alive = interim.stage(alive.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("places")), "places")
        places = held.select("row", "ord", "k").join(alive, "row").drop("row").dropDuplicates(["ord", "k"])  # equal rows have equal places
        if last or alive.isEmpty():
            whole = whole if last else whole.limit(0)
            break
        held = interim.stage(numbered(whole.join(places, ["ord", "k"])), "extended")
        whole = held.select("ord", "k", "text")

    kinds = "ord long, k long, n_removed long, spans array<struct<start:int,words:int>>, cut string, kept string"
    changed = map_batches(whole.join(places, ["ord", "k"]), _removal(length, texts), kinds)
    changed = interim.stage(changed, "changed").dropDuplicates(["ord", "k"])
    joined = base.select("ord", "k", "doc_id", "n_words", "sha").join(changed, ["ord", "k"], "left")
    more = ["kept"] if texts else []
    out = stage(
        joined.select(
            "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,words:int>>")).alias("spans"), F.coalesce("cut", "sha").alias("kept_sha256"), F.col("k").alias("key"), *more,
        ),
        "result",
    )
    interim.discard()
    return out


def _removal(length: int, texts: bool):
    def run(batch):
        removed, spans, sha, kept = [], [], [], []
        for text, places in zip(column(batch, "text"), column(batch, "places")):
            data = text.as_buffer().to_pybytes()
            gone = _covered(len(data.split()), places.values.to_numpy(zero_copy_only=False).astype(np.int64), length)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            removed.append(int(gone.sum()))
            spans.append([{"start": a, "words": b - a} for a, b in edge.reshape(-1, 2).tolist()])
            left = _kept(data, gone)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode() if texts else None)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "ord"), column(batch, "k"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
            names=["ord", "k", "n_removed", "spans", "cut", "kept"],
        )

    return run


def drop_long_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """The rows and columns of ``docs``; a text that loses words becomes its kept words joined by one space.

    Other texts stay as they are, null included; columns may have any names. See ``long_repeats``.
    """
    found = long_repeats(docs, length=length, texts=True).where("n_removed > 0").dropDuplicates(["doc_id", "key"])
    mine = found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    joined = docs.join(mine, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key")), "left")
    text = F.coalesce("__kept", "text")
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
