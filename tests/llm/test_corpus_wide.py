"""Operators that compare whole corpora, against brute force: nulls, empty tables, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelforge.llm import cross_tokens, long_repeats, prefix_trie
from panelforge.llm.text_arrays import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, k string, pos int, ord long, kept boolean"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), 1, "k", 2, 3, True) for i, t in texts]


def cut_by_hand(rows, length):
    """(doc_id, words, removed, kept words) of each row, every window looked up in a table of all."""
    least, split = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[s : s + length])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            m = least.get(tuple(w[s : s + length]))
            if m is not None and (i is None or m < i):
                gone |= set(range(s, s + length))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.fixture(scope="module")
def repeated():
    rng = np.random.default_rng(5)
    some = lambda n, k=40: " ".join(rng.choice([f"w{j}" for j in range(k)], n))
    passage, long = some(60, 500), some(400, 500)
    rows = [(i, some(30 + 20 * i) + "\n" + passage + "\t" + some(25)) for i in range(10)]
    rows += [(20 + i, long if i % 2 else long.replace("w7 ", "q7 ")) for i in range(12)] + [(20, long), (20, long), (None, long), (None, passage), (None, some(80)), (-3, passage)]
    rows += [(50, "a " * 300), (51, "a " * 70), (52, "a " * 49), (53, None), (53, ""), (54, " \n"), (55, "b c " * 60 + "é ü"), (56, "c b " * 55), (57, passage + "\x1cx"), (58, "　".join([passage] * 2))]
    return rows


@pytest.mark.parametrize("length", [50, 9, 130])
def test_long_repeats(spark, repeated, length):
    got = long_repeats.long_repeats(spark.createDataFrame(rows_of(repeated), SCHEMA), length=length).collect()
    wanted = cut_by_hand(repeated, length)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in wanted)
    assert all(sum(s["words"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert sum(gone for _, _, gone, _ in wanted) > 500


def test_long_repeats_of_nothing_and_without_repeats(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert long_repeats.long_repeats(none).count() == 0 and long_repeats.drop_long_repeats(none).columns == none.columns
    rows = [(1, " ".join(map(str, range(100)))), (2, None), (2, None)]
    got = long_repeats.long_repeats(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 100, 0), (2, 0, 0), (2, 0, 0)]


def test_texts_without_long_repeats(spark, repeated):
    docs = spark.createDataFrame(rows_of(repeated), SCHEMA)
    got = long_repeats.drop_long_repeats(docs, length=50)
    assert got.columns == docs.columns
    wanted = Counter((i, kept if gone else text) for (i, text), (_, _, gone, kept) in zip(repeated, cut_by_hand(repeated, 50)))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == wanted


def test_sampled_windows_cover_every_longer_one():
    rng = np.random.default_rng(6)
    data = " ".join(rng.choice(list("abcdefgh"), 4000)).encode()
    t = Texts(np.frombuffer(data, np.uint8), np.array([0, 3000, 3060, len(data)]))
    h = long_repeats.window_hashes(t.word_hashes, 25)
    places = long_repeats.sampled(t, h, 25, 50)
    every = np.flatnonzero(long_repeats._within(t, 50))
    assert (np.searchsorted(places, every + 25, "right") > np.searchsorted(places, every)).all()
    assert len(places) < len(h) / 10
    assert (long_repeats.covering(t, h, places, 25, 50) == every).all()
    assert len(long_repeats.covering(t, h, places[:0], 25, 50)) == 0


A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts through the libraries, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        self.letters = cross_tokens.byte_letters()

    def align(self, text):
        """Ends of groups as (A ids, B ids), and links (a, b); None without tokens."""
        if not text:
            return None
        data = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            return None
        spans = lambda ids: [(i, sum(len(y) for _, y in ids[:n]), sum(len(y) for _, y in ids[: n + 1])) for n, (i, _) in enumerate(ids)]
        sa, sb = spans(a), spans(b)
        links = [(i, j) for i, s, e in sa for j, t, f in sb if s < f and t < e]
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups = [",".join(str(i) for i, _, e in sa if lo < e <= hi) + "|" + ",".join(str(i) for i, _, e in sb if lo < e <= hi) for lo, hi in zip([0, *ends], ends)]
        return len(a), len(b), groups, links


def aligned_by_hand(rows):
    plain = Plain()
    found = [(i, plain.align(t)) for i, t in rows]
    count = Counter(pair for _, f in found if f for pair in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = Counter()
    for i, f in found:
        if f is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        na, nb, groups, links = f
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out[i, na, nb, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), sha] += 1
    return out


@pytest.fixture(scope="module")
def polyglot(spark):
    rng = np.random.default_rng(7)
    words = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    odd = list("aZ9 \n\t\r'.,—’é한국語ßﬁİΣ😀\u0301\u00a0\u2003\u3000\u0085\x0b\x1c\x00\u200d") + ["  ", " a", "'s ", "<s>", "<0x41>", "<|endoftext|>", "don't", " 12", "нет", "の"]
    rows = [(i, t[:600]) for i, t in enumerate(words)] + [(100 + i, "".join(rng.choice(odd, rng.integers(1, 40)))) for i in range(150)]
    rows += [(300, None), (301, ""), (302, " "), (303, "   "), (304, "a▁b"), (305, " x ▁ y"), (None, "the cat"), (306, "the cat"), (306, "the cat"), (307, "x" * 5000), (308, "▁")]
    return rows


@pytest.mark.parametrize("heavy", [131_072, 50])
def test_cross_tokens(spark, polyglot, heavy):
    docs = spark.createDataFrame(rows_of(polyglot), SCHEMA).repartition(3)
    got = cross_tokens.align_tokens(docs, A_FILE, B_FILE, heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == aligned_by_hand(polyglot)
    sha = {r["doc_id"]: r["groups_sha256"] for r in got.collect()}
    for r in cross_tokens.token_groups(docs, A_FILE, B_FILE).collect():
        assert sha[r["doc_id"]] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_cross_tokens_of_nothing(spark):
    assert cross_tokens.align_tokens(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE).count() == 0
    got = cross_tokens.align_tokens(spark.createDataFrame(rows_of([(1, None), (1, None)]), SCHEMA), A_FILE, B_FILE).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(8)
    model, plain = cross_tokens.Aligner(A_FILE, B_FILE), Plain()
    some = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x1680, 0xFEFF, 0x1F600, 0x0301] if c != 0x2581] + [" "] * 60 + ["\n"] * 10
    texts = ["".join(rng.choice(some, rng.integers(1, 60))) for _ in range(3000)]
    total, groups, _ = model.documents(pa.array(texts))
    for text, n, g in zip(texts, total.tolist(), groups):
        wanted = plain.align(text)
        assert (n[0], n[1], n[3], g.decode()) == ((wanted[0], wanted[1], len(wanted[3]), ";".join(wanted[2])) if wanted else (0, 0, 0, "")), repr(text)


TURNS = "conv_id long, turn long, role string, text string, depth long, level int, path string, key binary"


def trie_by_hand(turns):
    """Every node of the rebuilt conversations, from a dictionary of all beginnings."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = (*own.get(base, [])[:h], *mine[h:])
    members, children = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            if d:
                children.setdefault(seq[: d - 1], set()).add(seq[:d])
    leaves, saved = Counter(), Counter()
    for seq, m in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += seq not in children
            saved[seq[:d]] += (len(m) - 1) * len(seq[-1][1]) if seq else 0
    out = Counter()
    for seq, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == seq)
        up = min(members[seq[:-1]]) if seq else None
        out[min(m), len(seq), up, len(m), len(children.get(seq, ())), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(9)
    rows = []
    for c in [*range(-120, -80), *range(0, 140), *range(200, 230), 399, 512, 10**12]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, "user" if turn % 2 else "bot", f"say {rng.integers(0, 2)}" * int(rng.integers(1, 3))))
    rows += [(600 + c, t, "a", f"same {t}") for c in range(40) for t in range(c % 11)]  # beginnings of one another
    rows += [(700, t, "a", "long") for t in range(37)] + [(701, t, "a", "long") for t in range(37)] + [(702, t, "a", "long" if t < 30 else "other é") for t in range(35)]
    rows += [(800, None, None, None), (800, None, "x", ""), (800, 3, "x", "b"), (800, 3, "x", "a"), (800, 3, "x", "a"), (801, None, "", None), (None, 1, "x", "lost"), (None, None, None, None)]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("chunk,block,parts", [(256, 20_000, 4), (4, 3, 7), (5, 2, 80), (1, 20_000, 1)])
def test_prefix_trie(spark, talks, chunk, block, parts):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts < 5).lower())
    try:
        df = spark.createDataFrame([(*r, 1, 2, "p", b"k") for r in (talks if chunk > 1 else talks[:200])], TURNS)
        got = prefix_trie.prefix_trie(df, chunk=chunk, block=block).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = trie_by_hand(talks if chunk > 1 else talks[:200])
    assert Counter(tuple(r) for r in got) == wanted


def test_prefix_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = spark.createDataFrame([(7, 0, None, None, 1, 2, "p", b"k")], TURNS)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(one).collect()) == trie_by_hand([(7, 0, None, None)])


def test_numbers_of_turns_across_partitions(spark):
    rows = [(c, t, "r", f"t{t}") for c, n in ((1, 2), (2, 300), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered_turns(df, prefix_trie.Interim()).select("conv_id", "pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in got) == sorted((c, t) for c, t, _, _ in rows)


def test_depth_that_paths_share():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p, q = (b"".join(bytes([x]) * 16 for x in rng.integers(0, 2, rng.integers(0, 12))) for _ in (0, 1))
        n = 0
        while p[n * 16 : n * 16 + 16] == q[n * 16 : n * 16 + 16] != b"":
            n += 1
        assert prefix_trie.shared_depth(p, q) == n
