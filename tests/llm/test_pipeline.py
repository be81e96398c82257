"""The pipeline's stages over the small tables: columns, what each keeps, and whole results."""

from collections import Counter

import corpus_pipeline
from panelforge.llm.common import stage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF), "test"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == COLUMNS
    good, one, clean, mixed, packed = out[1:]
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert set(ids(good)) <= set(ids(docs)) and set(ids(one)) <= set(ids(good)) and ids(clean) == ids(one)
    assert max(ids(one).values()) == 1
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    clean_ids = [i for i, q in labels.items() if q == 1 and words[i] >= 40]
    assert sum(i in ids(good) for i in clean_ids) >= 0.97 * len(clean_ids)
    assert set(ids(mixed)) <= set(ids(clean)) and max(ids(mixed).values()) <= 3
    assert ids(packed.where("start = 0")) == ids(mixed)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == packed.count()
