"""Secrets: base rules, and a character convolutional network over every candidate in its context.

Candidates are all runs of at least six key characters, as far as no base rule takes them; a long run is judged
by overlapping windows and counts with the best of them. The network is trained on the
rules' findings against all runs that are none, equal runs once, with contexts swapped so
that it has to look at the run itself. Many examples are dealt over tasks, whose weights are averaged after each
round. Its outputs are calibrated on the third of all examples left out of the training, and the threshold is the highest that still finds the wanted share of the findings.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles
from .common import column, discard, map_batches, prepare, stage
from .text_arrays import Texts, slices

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 6
LOCAL_ROWS = 6_000  # up to so many examples are learned from in one place, more of them in tasks
ROUNDS, SHARD_ROWS, SHARD_FOUND = 6, 8_192, 32  # passes between averages; other runs of a task and pass, findings of a task at least
EPOCH_ROWS = 48_000  # fewer examples are gone through several times
BEFORE, INSIDE, AFTER = 24, 40, 16
WIDTH, FILTERS, REACH, EMBED = BEFORE + INSIDE + AFTER, 16, 5, 8
LETTERS, BLANK = 97, 1  # codes of characters; a blank's, which pads texts
STEP = INSIDE // 4  # between the windows of a run longer than INSIDE
RECALL = 0.99
PLACES = 16_384  # of a text, that are convolved at once
_HEX, _RUN = (np.zeros(256, bool) for _ in range(2))
_HEX[48:58], _HEX[97:103] = True, True
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def _runs(mask: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start byte, end byte) of maximal runs of at least so many bytes within one text."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds] = True
    begin = mask & (np.concatenate([[True], ~mask[:-1]]) | edge[:-1])
    end = mask & (np.concatenate([~mask[1:], [True]]) | edge[1:])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = hi - lo >= least
    lo, hi = lo[long], hi[long]
    return np.searchsorted(bounds, lo, "right") - 1, lo, hi


def base_spans(t: Texts, strings: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points, by start, then kind, for each text."""
    out: list[list] = [[] for _ in range(t.n)]
    lead = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80)])
    for i, lo, hi in zip(*(x.tolist() for x in _runs(_HEX[t.raw], t.bounds, MIN_HEX))):
        first = lead[t.bounds[i]]
        out[i].append((int(lead[lo] - first), 2, int(lead[hi] - first)))
    # A cheap search finds the texts that can hold the two others.
    keyed = pc.match_substring_regex(strings, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    for i in np.flatnonzero(keyed.to_numpy(zero_copy_only=False)):
        out[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(strings[i].as_py()) if len(m[2]) >= MIN_VALUE]
    for i in np.flatnonzero(pc.match_substring(strings, "AKIA").to_numpy(zero_copy_only=False)):
        out[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(strings[i].as_py()) if m.end() - m.start() >= MIN_ACCESS]
    return [sorted(x) for x in out]


def window(text: str, start: int, end: int) -> str:
    """A run of at most INSIDE characters in its context, padded with blanks at the ends of the text."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE) + text[start:end] + text[end : end + AFTER].ljust(AFTER)


def _codes(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 0, 96))


def _coded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows, padded to the longest, and the lengths of their runs."""
    joined = "".join(w.ljust(WIDTH) for w in windows)
    return _codes(np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)).astype(np.int64), np.array([len(w) - BEFORE - AFTER for w in windows], np.int64)


def window_places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, from, to) of overlapping windows at most INSIDE wide that cover each run, the last one up to its end."""
    n = 1 + np.maximum(0, -(-(hi - lo - INSIDE) // STEP))
    run = np.repeat(np.arange(len(lo)), n)
    number = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(lo[run] + number * STEP, np.maximum(hi[run] - INSIDE, lo[run]))
    return run, start, np.minimum(hi[run], start + INSIDE)


def candidates(points: np.ndarray, bounds: np.ndarray, base: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of all runs of key characters outside base spans, in code points of all texts together."""
    mask = _RUN[np.minimum(points, 255)]
    for i, spans in enumerate(base):
        for s, _, e in spans:
            mask[bounds[i] + s : bounds[i] + e] = False
    return _runs(mask, bounds, MIN_RUN)


class CharNet:
    """Embedding, convolution, rectifier, maxima over the places before, inside and after a run, and the mean inside.

    A place belongs to the part where its filter begins; one that begins in the run and ends beyond belongs to what is after.
    Nothing depends on where a window is cut, so a text is convolved once for all of its runs.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (LETTERS, EMBED)), "c": rng.normal(0, 1 / np.sqrt(REACH * EMBED), (REACH * EMBED, FILTERS)), "cb": np.zeros(FILTERS),
            "o": rng.normal(0, 0.1, 4 * FILTERS), "ob": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, codes: np.ndarray, n: np.ndarray):
        places = np.lib.stride_tricks.sliding_window_view(codes, REACH, axis=1)
        x = self.p["e"][places].reshape(len(codes), -1, REACH * EMBED)
        h = np.maximum(x @ self.p["c"] + self.p["cb"], 0)
        at, last = np.arange(h.shape[1])[None], BEFORE + n[:, None] - REACH
        parts = [(at < BEFORE) & (last > 0), (at >= BEFORE) & (at <= last), (at > last) & (at <= last + AFTER)]
        arg = [np.where(m[:, :, None], h, -1).argmax(1) for m in parts]
        top = [np.take_along_axis(h, g[:, None], 1)[:, 0] for g in arg]
        inside = parts[1][:, :, None] / (n - REACH + 1)[:, None, None]
        return places, x, h, arg, np.concatenate([*top, (h * inside).sum(1)], 1), inside

    def logits(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._forward(codes, n)[4] @ self.p["o"] + self.p["ob"]

    def _tables(self) -> list[np.ndarray]:
        """Responses of the filter's first two letters, the next two, and the last, by their codes."""
        one = [(self.p["e"] @ self.p["c"][k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(REACH)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        return [pair(one[0] + self.p["cb"].astype(np.float32), one[1]), pair(one[2], one[3]), one[4]]

    def text_logits(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logits of the runs ``start`` to ``end`` (ascending) of texts that are padded by blanks, convolving each place once.

        Maxima of 2, 4, 8, 16 and 32 neighbouring places give that of any stretch as the larger of two.
        """
        tables, out = self._tables(), np.zeros(len(start))
        o, bias = self.p["o"].astype(np.float32), float(self.p["ob"][0])
        pairs = codes[:-1].astype(np.int32) * LETTERS + codes[1:]
        lo = 0
        while lo < len(start):
            hi = int(np.searchsorted(start, start[lo] + PLACES, "left"))
            first, stop = int(start[lo]) - BEFORE, int(end[lo:hi].max()) + AFTER - REACH + 1
            h = tables[0].take(pairs[first:stop], axis=0)
            h += tables[1].take(pairs[first + 2 : stop + 2], axis=0)
            h += tables[2].take(codes[first + 4 : stop + 4], axis=0)
            np.maximum(h, 0, out=h)
            total = np.concatenate([np.zeros((1, FILTERS), np.float32), np.cumsum(h, axis=0, dtype=np.float32)])
            steps = [h]
            for k in range(5):
                steps.append(np.maximum(steps[-1][: -(1 << k)], steps[-1][1 << k :]) if len(steps[-1]) > 1 << k else steps[-1][:0])
            s, e = start[lo:hi] - first, end[lo:hi] - first - REACH + 1  # places inside are s to e
            size = e - s
            level = np.frexp(size)[1] - 1
            inside = np.empty((len(s), FILTERS), np.float32)
            for k in np.unique(level):
                some = np.flatnonzero(level == k)
                inside[some] = np.maximum(steps[k][s[some]], steps[k][e[some] - (1 << int(k))])
            before = np.maximum(steps[4][s - BEFORE], steps[4][s - 16])
            after = np.maximum(steps[4][e], steps[4][e + AFTER - 16])
            mean = (total[e] - total[s]) / size[:, None].astype(np.float32)
            f = FILTERS
            out[lo:hi] = before @ o[:f] + inside @ o[f : 2 * f] + after @ o[2 * f : 3 * f] + mean @ o[3 * f :] + bias
            lo = hi
        return out

    def train(self, codes: np.ndarray, n: np.ndarray, good: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 4) -> None:
        """Steps over batches that hold as many examples of either kind; those of the rarer kind return as often as that takes."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        kinds = [np.flatnonzero(good > 0), np.flatnonzero(good <= 0)]
        most = max(map(len, kinds))
        for _ in range(epochs):
            order = np.column_stack([np.concatenate([rng.permutation(k) for _ in range(-(-most // len(k)))])[:most] for k in kinds if len(k)]).ravel()
            for at in np.array_split(order, max(1, len(order) // 128)):
                places, x, h, arg, top, inside = self._forward(codes[at], n[at])
                d = (1 / (1 + np.exp(-np.clip(top @ self.p["o"] + self.p["ob"], -30, 30))) - good[at]) / len(at)
                g = {"o": top.T @ d, "ob": d.sum(keepdims=True)}
                back = d[:, None] * self.p["o"][None]
                dh = np.zeros_like(h)
                rows, filters = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
                for k in range(3):
                    dh[rows, arg[k], filters] += back[:, k * FILTERS : (k + 1) * FILTERS]
                dh += back[:, None, 3 * FILTERS :] * inside
                dh *= h > 0
                g["cb"] = dh.sum((0, 1))
                # few responses have a gradient: it is summed by letter for each place of the filter
                row, place, f = np.nonzero(dh)
                some = dh[row, place, f]
                g["c"], g["e"] = np.empty_like(self.p["c"]), np.zeros_like(self.p["e"])
                for k in range(REACH):
                    block = slice(k * EMBED, (k + 1) * EMBED)
                    letters = np.bincount(places[row, place, k] * FILTERS + f, some, LETTERS * FILTERS).reshape(LETTERS, FILTERS)
                    g["c"][block] = self.p["e"].T @ letters
                    g["e"] += letters @ self.p["c"][block].T
                step += 1
                for k in self.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, n: np.ndarray, good: np.ndarray, recall: float = RECALL) -> None:
        """Fit scale and shift of the logit, and take the highest threshold with the wanted recall, whatever else it lets through."""
        z = self.logits(codes, n)
        w = np.array([1.0, 0.0])
        x = np.column_stack([z, np.ones(len(z))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (good - p) - 0.05 * (w - [1, 0]))
        self.scale, self.shift = float(w[0]), float(w[1])
        found = np.sort(self.chance(z)[good > 0])
        self.threshold = float(found[int(np.floor((1 - recall) * len(found)))]) if len(found) else 1.1

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits * self.scale + self.shift, -30, 30)))


def fit(windows: list[str], good: np.ndarray) -> CharNet:
    """Train on two thirds of the examples, calibrate on the rest; without both kinds nothing is ever added."""
    net = CharNet()
    if not good.any() or good.all():
        net.threshold = 1.1
        return net
    held = np.arange(len(good)) % 3 == 2
    rng, learn = np.random.default_rng(2), [w for w, h in zip(windows, held) if not h]
    around = [learn[i] for i in rng.permutation(len(learn))]  # the same runs in contexts of other examples
    swapped = [c[:BEFORE] + w[BEFORE:-AFTER] + c[-AFTER:] for w, c in zip(learn, around)]
    label = good[~held].astype(float)
    net.train(*_coded(learn + swapped), np.concatenate([label, label]), epochs=min(6, max(1, EPOCH_ROWS // (2 * len(learn)))))
    if good[held].any():
        windows, good = [w for w, h in zip(windows, held) if h], good[held]
    net.calibrate(*_coded(windows), good.astype(float))
    return net


def _shared_steps(examples: DataFrame, net: CharNet, seed: int) -> CharNet:
    """One round: every shard trains on its examples from the same weights, whose mean is the next network.

    Weights are summed as integers, so that the order in which shards end makes no difference.
    """
    start, unit = examples.sparkSession.sparkContext.broadcast(net.p), float(1 << 32)

    def steps(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["w"])
        windows, good = table["w"].take(order).to_pylist(), table["good"].take(order).to_numpy().astype(float)
        rng, own = np.random.default_rng(seed), CharNet()
        own.p = {k: v.copy() for k, v in start.value.items()}
        around = rng.permutation(len(windows))  # every other run in the context of another example
        windows = [w if i % 2 else windows[c][:BEFORE] + w[BEFORE:-AFTER] + windows[c][-AFTER:] for i, (w, c) in enumerate(zip(windows, around.tolist()))]
        own.train(*_coded(windows), good, epochs=1, seed=seed)
        flat = np.concatenate([own.p[k].ravel() for k in own.p])
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(np.rint(flat * unit).astype(np.int64))})

    got = examples.groupBy("shard").applyInArrow(steps, "at int, v long").groupBy("at").agg(F.sum("v").alias("v"), F.count("v").alias("n")).toArrow()
    flat = np.empty(got.num_rows)
    flat[got["at"].to_numpy()] = got["v"].to_numpy() / unit / got["n"].to_numpy()
    out, cut = CharNet(), 0
    for k, v in net.p.items():
        out.p[k], cut = flat[cut : cut + v.size].reshape(v.shape), cut + v.size
    return out


def _calibrated(net: CharNet, held: DataFrame, recall: float = RECALL) -> None:
    """``CharNet.calibrate`` over a table of any size: sums for each step, the threshold by exact rank."""
    model = held.sparkSession.sparkContext.broadcast(net)

    def logits(batch):
        z = model.value.logits(*_coded(column(batch, "w").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(z), column(batch, "good")], names=["z", "good"])

    known = stage(map_batches(held.select("w", "good"), logits, "z double, good boolean"), "logits")
    w = np.array([1.0, 0.0])
    line = lambda: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(w[0]) + float(w[1])))
    for _ in range(50):
        p, off = 1 / (1 + F.exp(-line())), F.col("good").cast("double")
        v, d, z = p * (1 - p) + 1e-9, off - p, F.col("z")
        s = known.agg(F.sum(v * z * z), F.sum(v * z), F.sum(v), F.sum(d * z), F.sum(d)).first()
        move = np.linalg.solve(np.array([[s[0], s[1]], [s[1], s[2]]]) + 0.05 * np.eye(2), np.array([s[3], s[4]]) - 0.05 * (w - [1, 0]))
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    net.scale, net.shift = float(w[0]), float(w[1])
    found = known.where("good").select((1 / (1 + F.exp(-line()))).alias("chance"))
    n = found.count()
    if n:
        rank = int(np.floor((1 - recall) * n))
        near = exact_quantiles(found, ["chance"], [rank / max(n - 1, 1)]).first()["quantile"]
        net.threshold = float(found.where(F.col("chance") <= near + 1e-12).agg(F.max("chance")).first()[0])
    else:
        net.threshold = 1.1
    discard(known)


def learn(examples: DataFrame) -> CharNet:
    """The network of all examples (a written table, equal other runs once): by ``fit`` where they are few, else in rounds of tasks.

    Only findings are written once more, as one window may be found by two kinds; the others are read where they are. A third is held for calibration by a hash of its text. Each round takes one of ``ROUNDS`` parts of the other runs, so
    that each is learned from once, and all findings.
    """
    prepare(examples.sparkSession)
    findings = stage(examples.where("kind >= 0").select("w", F.lit(True).alias("good")).distinct(), "findings")
    others = examples.where("kind < 0").select("w", F.lit(False).alias("good"))
    every, count = others.union(findings), {True: findings.count(), False: others.count()}
    if sum(count.values()) <= LOCAL_ROWS or not all(count.values()):
        # without both kinds nothing is ever added, however many there are
        rows = every.limit(LOCAL_ROWS).toPandas().sort_values(["w", "good"])
        rows = rows.iloc[np.random.default_rng(1).permutation(len(rows))]
        discard(findings)
        return fit(rows["w"].tolist(), rows["good"].to_numpy(bool))
    shards = max(1, min(count[False] * 2 // 3 // (ROUNDS * SHARD_ROWS), count[True] * 2 // 3 // SHARD_FOUND))
    place = F.xxhash64("w")
    dealt = every.withColumns({"held": F.pmod(place, F.lit(3)) == 2, "round": F.pmod(F.shiftright(place, 8), F.lit(ROUNDS)), "shard": F.pmod(F.shiftright(place, 24), F.lit(shards))})
    net = CharNet()
    for r in range(ROUNDS):
        net = _shared_steps(dealt.where(~F.col("held") & (F.col("good") | (F.col("round") == r))), net, 100 + r)
    _calibrated(net, dealt.where("held"))
    discard(findings)
    return net


def padded(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts with blanks before, between and after them, and how far each text has moved."""
    gap = BEFORE + AFTER + REACH
    shift = gap * (1 + np.arange(len(bounds) - 1))
    out = np.full(len(codes) + gap * len(bounds), BLANK, codes.dtype)
    out[np.arange(len(codes)) + np.repeat(shift, np.diff(bounds))] = codes
    return out, shift


def secret_examples(docs: DataFrame) -> DataFrame:
    """Findings and other runs in their contexts: ``kind`` (one of KINDS by number, -1 for none) and the window ``w``.

    All findings, and all other runs, whatever their letters; equal windows once, equal other runs once, in the context
    with the smallest hash.
    """

    def scan(batch):
        for _, _, part, base, points, bounds, (at, a, b), hashes, around in _found(batch, with_hashes=True):
            order = np.lexsort((around.view(np.int64), hashes))  # equal runs of these texts side by side, the one to keep first
            taken = np.sort(order[np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])]) if len(order) else order
            run, start, end = window_places(a[taken], b[taken])
            kinds, groups, contexts, first, texts = [], [], [], around[taken][run].view(np.int64).tolist(), {}
            for i, s, e in zip(at[taken][run].tolist(), start.tolist(), end.tolist()):
                text = texts[i] if i in texts else texts.setdefault(i, part[i].as_py())
                kinds.append(-1)
                w = window(text, s - int(bounds[i]), e - int(bounds[i]))
                groups.append(w[BEFORE:-AFTER])
                contexts.append(w[:BEFORE] + w[-AFTER:])
            for i, spans in enumerate(base):
                text = (texts[i] if i in texts else part[i].as_py()) if spans else ""
                for s, k, e in spans:
                    if k == 0:  # the value, without the name before it
                        s = e - len(ASSIGN.match(text, s)[2])
                    kinds.append(k)
                    groups.append(window(text, s, min(e, s + INSIDE)))
                    contexts.append("")
                    first.append(0)
            made = [pa.array(kinds, pa.int32()), pa.array(groups, pa.string()), pa.array(contexts, pa.string()), pa.array(first, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["kind", "run", "context", "first"])

    # A finding's group is its window, another run's the run; what is around it moves beside it, so that no character is shuffled twice.
    # Sorted by the run first, as nearly all share a kind.
    every = map_batches(docs.select("text"), scan, "kind int, run string, context string, first long")
    kept = every.groupBy("run", "kind").agg(F.min(F.struct("first", "context"))["context"].alias("context"))
    return kept.select("kind", F.concat(F.substring("context", 1, BEFORE), "run", F.substring("context", BEFORE + 1, AFTER)).alias("w"))


def _found(batch, with_hashes: bool = False):
    """Texts, base spans, code points with their bounds, candidates, and hashes of each candidate alone and in its context."""
    strings = column(batch, "text").fill_null("")
    for lo, hi, t in slices(strings):
        part = strings.slice(lo, hi - lo)
        base = base_spans(t, part)
        lead = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80)])
        points = np.frombuffer(t.raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        runs = candidates(points, lead[t.bounds], base)
        begin = np.append(np.flatnonzero((t.raw & 0xC0) != 0x80), len(t.raw))
        alone = around = None
        if with_hashes:
            a, b = begin[runs[1]], begin[runs[2]]
            alone, around = t.hash_spans(a, b), t.hash_spans(np.maximum(a - BEFORE, t.bounds[runs[0]]), np.minimum(b + AFTER, t.bounds[runs[0] + 1]))
        yield lo, hi, part, base, points, lead[t.bounds], runs, alone, around


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` for each row.

    A null or empty text has no spans (zero counts, the digest of the empty string, empty ``spans``); a null doc_id is
    kept, repeated rows are each searched, other columns are ignored, an empty table gives an empty result. Places are
    code points, ends exclusive. Learned spans never overlap base ones; what a base rule leaves of a run is judged as a run. Every finding and every other
    run is trained or calibrated on (see ``learn``), and every candidate of every text is judged.
    """
    kind = dict(docs.dtypes)["doc_id"]

    examples = stage(secret_examples(docs), "secrets")
    net = docs.sparkSession.sparkContext.broadcast(learn(examples))
    discard(examples)

    def judge(batch):
        model = net.value
        for lo, hi, _, base, points, bounds, (at, a, b), _, _ in _found(batch):
            best = np.full(len(a), -np.inf)
            if len(a):
                codes, shift = padded(_codes(points).astype(np.uint8), bounds)
                run, start, end = window_places(a, b)
                move = shift[at[run]]
                np.maximum.at(best, run, model.text_logits(codes, start + move, end + move))
            all_spans = [list(x) for x in base]
            for j in np.flatnonzero(model.chance(best) >= model.threshold):
                all_spans[at[j]].append((int(a[j] - bounds[at[j]]), 3, int(b[j] - bounds[at[j]])))
            named = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            out = [(*(sum(k == x[1] for x in spans) for k in range(3)), hashlib.sha256(named(spans).encode()).hexdigest(), named(sorted(every))) for spans, every in zip(base, all_spans)]
            made = [pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), *made], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", "text"), judge, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
