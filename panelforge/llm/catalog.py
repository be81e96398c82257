"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cross_tokens import align_tokens
from .dart_dedup import near_texts
from .html_text import extract_main_text
from .long_repeats import long_repeats
from .mixing import mix
from .packing import pack
from .pair_quality import pair_quality
from .pii import find_pii
from .pq_dedup import near_vectors
from .prefix_trie import prefix_trie
from .quality_rules import quality_rules
from .secrets import find_secrets
from .token_files import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


@query("op2_html_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


OP3_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN reach ON a = v.vec_id"""


@query("op3_pq_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), threshold=0.98)


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_pair_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pair_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3e0 * source_size AS cap FROM s),
l AS (SELECT *, greatest(CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0e0), 0e0) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0e0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, cap / weight) AS common FROM l WHERE level * weight < cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT common FROM c) * weight, cap)) AS target FROM l),
p AS (SELECT *, floor(target / greatest(source_size, 1) + 1e-9) AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size + 1e-3) AS extra FROM p),
r AS (SELECT d.doc_id, d.size, q.source_size, round(q.target, 6) AS target, q.whole, q.extra,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN extra > 0 AND upto <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


@query("op5_mix_sources", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_pack")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_dart_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_texts(table(spark, folder, "documents"), threshold=0.8).select("doc_id", "class_id", "kept")


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents"))


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, doc_id, i, md5(string_agg(word, ' ') OVER f) AS h, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least_id AS (SELECT h, min(doc_id) AS m FROM g WHERE n = 50 GROUP BY h),
bad AS (SELECT r, i FROM g JOIN least_id USING (h) WHERE n = 50 AND (m < doc_id OR (doc_id IS NULL AND m IS NOT NULL))),
c AS (SELECT w.r, w.i, w.word, max(b.i) OVER (PARTITION BY w.r ORDER BY w.i) AS upto FROM w LEFT JOIN bad b ON b.r = w.r AND b.i = w.i),
k AS (SELECT r, count(*) FILTER (WHERE upto IS NOT NULL AND i < upto + 50) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE upto IS NULL OR i >= upto + 50) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


@query("op13_long_repeats", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return long_repeats(table(spark, folder, "documents"), length=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op11_cross_tokens")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP12_SQL = r"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS own,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM c GROUP BY conv_id),
n AS (SELECT i.conv_id, i.base, i.h, least(i.h, coalesce(b.own, 0)) AS head FROM i LEFT JOIN i b ON b.conv_id = i.base),
t AS (SELECT n.conv_id, c.pos, c.role, c.text FROM n JOIN c ON c.conv_id = n.base AND c.pos < n.h
  UNION ALL SELECT n.conv_id, n.head + c.pos - n.h, c.role, c.text FROM n JOIN c ON c.conv_id = n.conv_id AND c.pos >= n.h),
p AS (SELECT conv_id, pos + 1 AS depth, text, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM t
  UNION ALL SELECT conv_id, 0, '', '' FROM n),
z AS (SELECT conv_id, max(depth) AS total FROM p GROUP BY conv_id),
v AS (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS chars,
  sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256 FROM p JOIN z USING (conv_id) GROUP BY path, depth),
k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
s AS (SELECT p.path, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN v u ON f.depth > 0 AND u.path = substr(f.path, 1, 32 * (f.depth - 1))"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
