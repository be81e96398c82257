"""Quality rules: counts per text, and a log-likelihood ratio of hashed n-grams.

Byte trigrams of words (with the blank on either side) are hashed into ``1 << BITS`` buckets.
Two multinomials are counted, of trusted texts and of the whole raw corpus; a text's score
is the mean over its n-grams of log(trusted / raw). Texts under a threshold fixed by the trusted
texts are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles
from .common import Interim, column, map_batches
from .text_arrays import Texts, repeated, slices

BITS = 18
MASK_BITS = 26  # log2 of the bits of the map of trusted ids
KEEP_SHARE = 0.999  # of the trusted texts that pass the counts, so many pass the score too
MARGIN = 0.1  # in mean log ratio per n-gram
SLICE = 500_000  # bytes of texts that are counted at once, with arrays of about a hundred times as many
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of each text; word_chars and n_symbols count code points."""
    lead = (t.raw & 0xC0) != 0x80
    line_end = np.flatnonzero(t.raw == 0x0A)
    cuts = np.sort(np.concatenate([line_end, t.bounds[1:]]))  # the end of each line; a text's end is one
    first = np.empty(len(cuts), np.int64)
    if len(cuts):
        first[0] = 0
        is_break = np.zeros(len(t.raw) + 1, bool)
        is_break[line_end] = True
        first[1:] = cuts[:-1] + is_break[cuts[:-1]]
    first = np.minimum(first, cuts)
    filled = np.searchsorted(t.starts, cuts) > np.searchsorted(t.starts, first)
    lo, hi = first[filled], cuts[filled]
    of = np.searchsorted(t.bounds, lo, "right") - 1
    at, is_first = repeated(of, t.hash_spans(lo, hi))
    dup = np.bincount(of[at[~is_first]], minlength=t.n)
    word, text, h = t.windows()
    again, _ = repeated(text, h)
    cover = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(cover, word[again], 1)
    np.add.at(cover, word[again] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return {
        "n_words": t.n_words,
        "word_chars": t.count(t.inside & lead),
        "n_symbols": t.count(_IS_SYMBOL[t.raw]),
        "n_dup_lines": dup,
        "n_repeat_words": covered[t.word_bounds[1:]] - covered[t.word_bounds[:-1]],
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def grams(t: Texts) -> np.ndarray:
    """Bucket of the trigram around each byte (meaningful for bytes of words)."""
    b = np.where(t.inside, t.raw, 0x20).astype(np.uint32)
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    if len(b):
        inner = t.bounds[t.bounds < len(b)]
        before[inner] = 0x20
        after[t.bounds[t.bounds > 0] - 1] = 0x20
    with np.errstate(over="ignore"):
        return ((before << 16 | b << 8 | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _counter(with_base: bool):
    def count(batch):
        total = np.zeros(1 << BITS, np.int64)
        for _, _, t in slices(column(batch, "text"), SLICE):
            g, use = grams(t), t.inside
            if with_base:
                fine = ~base_failed(base_counts(t))
                use = use & np.repeat(fine, np.diff(t.bounds))
            total += np.bincount(g[use], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return count


def _dense(counts: DataFrame) -> np.ndarray:
    """Counts by bucket: at most ``1 << BITS`` rows reach the driver."""
    out = np.zeros(1 << BITS)
    got = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def _scorer(weights: np.ndarray):
    def score(t: Texts) -> np.ndarray:
        n = t.count(t.inside)
        return t.count(np.where(t.inside, weights[grams(t)], 0.0)) / np.maximum(n, 1)

    return score


class QualityModel:
    """Log ratios by bucket and the threshold on the mean."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold


def _trusted(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Texts of the rows whose id is in ``good``.

    A bit map of those ids, of bounded size, drops most other rows before the exact join, which so moves hardly any
    text but the trusted ones; always a merge join, as the ids grow with the labels.
    """
    place = f"pmod(xxhash64(CAST(doc_id AS STRING)), {1 << MASK_BITS}L)"
    word, bit = F.expr(f"shiftright({place}, 6)"), F.expr(f"shiftleft(1L, CAST({place} & 63 AS INT))")
    mask = good.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    near = docs.select("doc_id", "text", word.alias("__word")).join(F.broadcast(mask), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return near.select("doc_id", "text").join(good.hint("merge"), "doc_id").select("text")  # ids in good are distinct


def fit(docs: DataFrame, labels: DataFrame, *, keep_share: float = KEEP_SHARE) -> QualityModel:
    """Count both multinomials: the raw one over every text, the trusted one over every text labelled 1.
    The threshold comes from the exact quantiles of all trusted scores. Null labels and ids are ignored. Without
    trusted texts all weights are 0 and every text passes the score."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    interim = Interim()
    # Read twice; written so that the join moves texts once.
    trusted = interim.stage(_trusted(docs, good), "trusted")
    try:
        raw = _dense(map_batches(docs.select("text"), _counter(False), "gram long, n long"))
        target = _dense(map_batches(trusted, _counter(True), "gram long, n long"))
        if not target.sum():
            return QualityModel(np.zeros(1 << BITS), -np.inf)
        p, q = (target + 0.5) / (target + 0.5).sum(), (raw + 0.5) / (raw + 0.5).sum()
        weights = np.log(p / q)
        shared = spark.sparkContext.broadcast(weights)

        def scores(batch):
            for _, _, t in slices(column(batch, "text"), SLICE):
                s = _scorer(shared.value)(t)[~base_failed(base_counts(t))]
                yield pa.RecordBatch.from_arrays([pa.array(s)], names=["score"])

        known = interim.stage(map_batches(trusted, scores, "score double"), "scores")
        found = {r["prob"]: r["quantile"] for r in exact_quantiles(known, ["score"], sorted({1 - keep_share, 0.5})).collect()}
    finally:
        interim.discard()
    if not found:
        return QualityModel(weights, -np.inf)
    # Below every trusted text but the share given up, with a margin as wide as their spread
    # and at least MARGIN, as trusted texts may be few or alike.
    low = found[1 - keep_share]
    return QualityModel(weights, low - max(found[0.5] - low, MARGIN))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def rate(docs: DataFrame, model: QualityModel, keep_columns: list[str], prefix: str = "") -> DataFrame:
    """The counts, the score and the verdict for each row, after the columns named; ``prefix`` goes before the new names.

    Null text is an empty one: it has no words and is rejected by the counts. Every row is rated on
    its whole text; repeated rows get equal verdicts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep_columns, F.col("text").alias("__text"))

    def run(batch):
        m = shared.value
        for lo, hi, t in slices(column(batch, "__text"), SLICE):
            c = base_counts(t)
            failed = base_failed(c)
            s = _scorer(m.weights)(t)
            own = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep_columns))]
            made = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [*own, *made, pa.array(failed), pa.array(~failed & (s >= m.threshold)), pa.array(s)], schema=None, names=out_names
            )

    made_names = [prefix + x for x in OUT.split(", ")]
    out_names = [*keep_columns, *[x.split()[0] for x in made_names]]
    kinds = dict(docs.dtypes)
    return map_batches(source, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep_columns), *made_names]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score`` of every document.

    See ``rate`` and ``fit``. An empty table gives an empty result; other columns are ignored.
    """
    return rate(docs, fit(docs, labels), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns, whatever their names; a null text has no words and goes."""
    kept = rate(docs, fit(docs, labels), docs.columns, prefix="__quality_")
    return kept.where("__quality_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
