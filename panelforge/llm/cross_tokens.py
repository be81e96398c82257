"""Alignment of two tokenizers over the same texts, and how often their ids stand for each other.

Most token groups are one id on either side with the same bytes. An array from A ids to the B id of equal bytes is
made once; the pairs it names are counted in a vector as long as A's vocabulary. Only the other pairs, of irregular
groups, are shuffled to be counted, and looked up: the most frequent ones in a table of bounded size that every task
holds, the rest by a join.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interim, column, map_batches, prepare, stage

HEAVY = 131_072  # most frequent irregular pairs that tasks look up themselves; rarer ones are joined
CACHE_PIECES, LONG_PIECE = 400_000, 200  # remembered, twice as many at most, none longer
FLUSH = 1_000_000  # irregular pairs a task counts before it hands them on
SLICE_BYTES = 4_000_000
# Bytes after a blank that surely begin no blank of any script (lead bytes that may are left out).
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xF5] = True
_SAFE[[0xE1, 0xE2, 0xE3]] = False


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their ids, and what is known of pieces met before.

    A piece starts at a blank that follows no blank and precedes a letter that is none; no token of either side
    reaches across such a place, which is checked for each piece when it is first met.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.width = len(self.b_bytes)
        at = {}
        for i, x in enumerate(self.b_bytes):
            if x and not self.b.is_control(i) and not self.b.is_unknown(i) and (x not in at or self.b.is_byte(at[x])):
                at[x] = i
        self.same = np.array([at.get(x, -1) for x in self.a_bytes], np.int64)  # the identity map
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_names = pa.array([str(i) for i in range(len(self.a_bytes))])
        self.b_names = pa.array([str(i) for i in range(self.width)])
        self.cache: dict[str, tuple[bytes, bytes] | None] = {" ": None}  # the blank before an empty text
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        """A and B ids (unsigned 32-bit) of a text that begins with a blank; None if either doesn't give it back."""
        return self._encode([text])[0]

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The same for pieces, encoded together and cut where both end; if that fails, one by one."""
        whole = "".join(texts)
        data = whole.encode()
        a = np.array(self.a.encode(whole, add_special_tokens=False).ids, np.uint32)
        b = np.array(self.b.encode(whole[1:], num_threads=1), np.uint32)
        same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        if same and len(texts) == 1:
            return [(a.tobytes(), b.tobytes())]
        if same:
            size = np.fromiter(map(len, texts), np.int64, len(texts)) if whole.isascii() else np.array([len(t.encode()) for t in texts])
            cut, a_ends, b_ends = np.cumsum(size), np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
            na, nb = np.searchsorted(a_ends, cut, "right"), np.searchsorted(b_ends, cut, "right")
            same = bool((a_ends[na - 1] == cut).all() and (b_ends[nb - 1] == cut).all())
        if not same:
            return [None] if len(texts) == 1 else [self._whole(t) for t in texts]
        xa, xb, i, j, out = a.tobytes(), b.tobytes(), 0, 0, []
        for x, y in zip((na * 4).tolist(), (nb * 4).tolist()):
            out.append((xa[i:x], xb[j:y]))
            i, j = x, y
        return out

    def _pieces(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of pieces: recent ones are remembered, in two generations, long ones are not."""
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {" ": None}, self.cache
        cache, older, fresh, found = self.cache, self.older, [], {}
        for t in texts:
            if t not in cache:
                if t in older:
                    cache[t] = older[t]
                else:
                    fresh.append(t)
        i = 0
        while i < len(fresh):
            j, size = i, 0
            while j < len(fresh) and (j == i or size + len(fresh[j]) < 40_000):
                size += len(fresh[j])
                j += 1
            for t, known in zip(fresh[i:j], self._encode(fresh[i:j])):
                (cache if len(t) <= LONG_PIECE else found)[t] = known
            i = j
        return [cache[t] if t in cache else found[t] for t in texts] if found else list(map(cache.__getitem__, texts))

    def _aligned(self, ids: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each piece (A tokens, B tokens, groups, links), and the group text; then the codes of all links in order."""
        a, b = (np.frombuffer(b"".join(x[i] for x in ids), np.uint32).astype(np.int64) for i in (0, 1))
        na, nb = (np.cumsum(np.fromiter((len(x[i]) >> 2 for x in ids), np.int64, len(ids))) for i in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
        marks[a_ends] = 1
        marks[b_ends] += 2
        any_end = np.flatnonzero(marks)
        both = np.flatnonzero(marks == 3)
        codes = a[np.searchsorted(a_ends, any_end)] * self.width + b[np.searchsorted(b_ends, any_end)]
        ga, gb = np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")
        cut = np.concatenate([[0], a_ends])[na]  # bytes at which pieces end
        ng, nl = np.searchsorted(both, cut, "right"), np.searchsorted(any_end, cut, "right")

        def listed(names: pa.Array, tokens: np.ndarray, ends: np.ndarray, mark: str) -> pa.Array:
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(tokens))), mark)

        groups = pc.binary_join_element_wise(listed(self.a_names, a, ga, ","), listed(self.b_names, b, gb, ","), "|")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ng]), pa.int32()), groups), ";")
        counts = np.stack([np.diff(x, prepend=0) for x in (na, nb, ng, nl)])
        return counts, codes, nl, text

    def documents(self, texts: pa.Array):
        """For each text: (A tokens, B tokens, groups, links), its group text, and its pairs as (codes, times), pairs once each."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return [], [], []
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        bounds = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        raw = np.frombuffer(spaced.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        blank = raw == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[:-1] &= _SAFE[raw[1:]]
        start[-1] = False
        start[bounds[:-1]] = True
        starts = np.flatnonzero(start)
        offsets = np.concatenate([starts, [len(raw)]]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        known = self._pieces(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.searchsorted(starts, bounds)
        bad = np.array([k is None for k in known], bool)
        empty = np.diff(bounds) == 1
        odd = (np.add.reduceat(bad[at], cut[:-1]) > 0) & ~empty
        none = empty | odd
        counts, codes, _, names = self._aligned([k or (b"", b"") for k in known])
        total = np.add.reduceat(counts[:, at], cut[:-1], axis=1)
        total[:, none] = 0
        names, order, edges = names.to_pylist(), at.tolist(), cut.tolist()
        groups = [b"" if none[d] else ";".join([names[p] for p in order[edges[d] : edges[d + 1]]]).encode() for d in range(len(texts))]

        links = counts[3]
        doc = np.repeat(np.arange(len(texts)), np.diff(cut))
        use = np.flatnonzero(~none[doc])
        uses, times = _counted_keys(doc[use] * len(known) + at[use])
        doc, piece = np.divmod(uses, len(known))
        size, ends = links[piece], np.cumsum(links)
        take = np.arange(size.sum()) + np.repeat((ends - links)[piece] - (np.cumsum(size) - size), size)
        pairs, often = _counted_keys((np.repeat(doc, size) << 32) | codes[take], np.repeat(times, size))
        at_doc = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)) * 4
        data, times = (pairs & 0xFFFFFFFF).astype("<u4").tobytes(), often.astype("<u4").tobytes()
        linked = [(data[x:y], times[x:y]) for x, y in zip(at_doc[:-1].tolist(), at_doc[1:].tolist())]

        for d in np.flatnonzero(odd).tolist():  # some piece can't be rebuilt: the whole text decides
            one = self._whole(" " + texts[d].as_py())
            if one is not None:
                n, codes, _, text = self._aligned([one])
                total[:, d] = n[:, 0]
                groups[d] = text[0].as_py().encode()
                mine, often = _counted_keys(codes)
                linked[d] = (mine.astype("<u4").tobytes(), often.astype("<u4").tobytes())
        return total.T, groups, linked


def _counted_keys(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often (or with what weight) each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weight is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weight[order], first)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The worker's aligner; kept between tasks."""
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


def _cuts(texts: pa.Array):
    """Rows lo to hi of about ``SLICE_BYTES``, at least one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def token_groups(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``doc_id`` and ``groups`` of each row of ``docs``: the smallest runs of A and of B ids that cover the same bytes.

    Written as ``a1,a2|b1;a3|b2,b3`` in order. A text that is null, empty or that either tokenizer can't give back
    byte by byte has no tokens and an empty string. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batch):
        for lo, hi in _cuts(column(batch, "text")):
            _, groups, _ = aligner(a_file, b_file).documents(column(batch, "text").slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array([g.decode() for g in groups], pa.string())], names=["doc_id", "groups"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, groups string")


def _counted(docs: DataFrame, same: np.ndarray, width: int) -> DataFrame:
    """Partial counts of documents by pair: (``exact``, ``code``, ``n``), summed within each task."""
    prepare(docs.sparkSession)

    def rows(exact, code, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), exact)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["exact", "code", "n"])

    def run(batches):
        vector, odd, held = np.zeros(len(same), np.int64), [], 0
        total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            codes = np.frombuffer(b"".join(column(batch, "codes").to_pylist()), "<u4").astype(np.int64)
            regular = same[codes // width] == codes % width
            vector += np.bincount(codes[regular] // width, minlength=len(same))
            odd.append(codes[~regular])
            held += len(odd[-1])
            if held > FLUSH:
                total, odd, held = _merged(total, odd), [], 0
                if len(total[0]) > FLUSH:
                    yield rows(False, *total)
                    total = (total[0][:0], total[1][:0])
        yield rows(False, *_merged(total, odd))
        met = np.flatnonzero(vector)
        yield rows(True, met * width + same[met], vector[met])

    return docs.select("codes").mapInArrow(run, "exact boolean, code long, n long")


def _merged(total: tuple[np.ndarray, np.ndarray], codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
    every, back = np.unique(np.concatenate([total[0], one]), return_inverse=True)
    return every, np.bincount(back, np.concatenate([total[1], n]), len(every)).astype(np.int64)


def align_tokens(docs: DataFrame, a_file: str, b_file: str, *, heavy: int = HEAVY) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` per row of ``docs``.

    A encodes a blank and the text, B the text, before which it sets a blank itself; strings of special tokens are
    plain text. Bytes where tokens of both end cut groups (``token_groups`` gives them). A link is a pair of an A and
    a B token that share a byte; a pair of ids counts the documents that hold it linked. ``n_best`` counts links whose
    count is the highest of their A id, ties included; ``count_sum`` sums the counts over links.

    A text that is null, empty, or that either tokenizer doesn't give back has zeros and an empty digest. Equal
    rows count as documents of their own. Other columns are ignored; an empty table gives an empty result.

    The driver receives vectors as long as A's vocabulary and the ``heavy`` most frequent irregular pairs; a pair
    beyond them is rarer than each of them, so no key of the join is hot.
    """
    spark, interim = docs.sparkSession, Interim()
    prepare(spark)
    model = aligner(a_file, b_file)
    same, width = model.same, model.width

    def encode(batch):
        for lo, hi in _cuts(column(batch, "text")):
            total, groups, linked = aligner(a_file, b_file).documents(column(batch, "text").slice(lo, hi - lo))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            numbers = [pa.array(np.ascontiguousarray(total[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").slice(lo, hi - lo), *numbers, pa.array(sha, pa.string()), *(pa.array([x[i] for x in linked], pa.binary()) for i in (0, 1))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    coded = map_batches(docs.select("doc_id", "text"), encode, f"doc_id {kind}, {numbers}, groups_sha256 string, codes binary, times binary")
    coded = interim.stage(coded.withColumn("row", F.monotonically_increasing_id()), "aligned")

    partial = interim.stage(_counted(coded, same, width), "counts")
    exact = np.zeros(len(same), np.int64)
    for r in partial.where("exact").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most A's vocabulary
        exact[r["code"] // width] = r["n"]
    pairs = interim.stage(partial.where("not exact").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    best = exact.copy()
    for r in pairs.groupBy(F.floor(F.col("code") / F.lit(width)).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    top = pairs.orderBy(F.desc("n"), "code").limit(heavy).toArrow()
    code, n = top.column("code").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((same, exact, best, code[order], n[order]))

    def look_up(batch):
        same, exact, best, heavy_code, heavy_n = shared.value
        sizes = np.array([len(x) // 4 for x in column(batch, "codes").to_pylist()], np.int64)
        code = np.frombuffer(b"".join(column(batch, "codes").to_pylist()), "<u4").astype(np.int64)
        times = np.frombuffer(b"".join(column(batch, "times").to_pylist()), "<u4").astype(np.int64)
        a, doc = code // width, np.repeat(np.arange(batch.num_rows), sizes)
        n = np.where(same[a] == code % width, exact[a], 0)
        if len(heavy_code):
            at = np.minimum(np.searchsorted(heavy_code, code), len(heavy_code) - 1)
            n = np.where(heavy_code[at] == code, heavy_n[at], n)
        sums = [np.bincount(doc, x, batch.num_rows).astype(np.int64) for x in (times * (n == best[a]) * (n > 0), times * n)]
        rest = np.flatnonzero(n == 0)
        cut = np.searchsorted(doc[rest], np.arange(batch.num_rows + 1))
        left = [pa.array([x[rest[cut[i] : cut[i + 1]]].astype(t).tobytes() for i in range(batch.num_rows)], pa.binary()) for x, t in ((code, "<u4"), (times, "<u4"))]
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *map(pa.array, sums), *left],
            names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "codes", "times"],
        )

    seen = map_batches(coded, look_up, f"row long, doc_id {kind}, {numbers}, groups_sha256 string, n_best long, count_sum long, codes binary, times binary")
    seen = interim.stage(seen, "looked-up")

    def unpack(batch):
        size = np.array([len(x) // 4 for x in column(batch, "codes").to_pylist()], np.int64)
        code, times = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "<u4").astype(np.int64) for c in ("codes", "times"))
        row = np.repeat(column(batch, "row").to_numpy(), size)
        for i in range(0, len(code), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (row, code, times)], names=["row", "code", "times"])

    highest = spark.createDataFrame(pa.table({"a": np.arange(len(best)), "best": best}))  # as long as A's vocabulary
    marked = pairs.join(F.broadcast(highest), F.floor(pairs.code / F.lit(width)) == F.col("a")).select("code", "n", (F.col("n") == F.col("best")).alias("top"))
    rare = map_batches(seen.where("length(codes) > 0").select("row", "codes", "times"), unpack, "row long, code long, times long").join(marked, "code")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
    whole = seen.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
    out = stage(whole, "result")
    interim.discard()
    return out
