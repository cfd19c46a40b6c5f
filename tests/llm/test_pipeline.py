"""The pipeline against a plain version of its stages, on the driver's smallest tables and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate as D, line_dedup as LD, ngram_join as N, toxicity as T


def plain(spark, docs, sf_dir):
    """Rows (doc_id, text) that should be left, by brute force after the fitted first stage."""
    model = T.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in T.without_toxic(docs, model).select("doc_id", "text").collect())
    gone = LD.brute_force(rows)
    texts, seen = [], {}
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone[doc]]
        far = 0
        for i in gone[doc]:
            s = set(lines[i].split(" "))
            own = [t for d, t in seen.values() if d != doc and 190 * len(s & t) >= 90 * (len(s) + len(t))]
            far += len(lines[i].split(" ")) * bool(own)
        for i, x in enumerate(lines):
            if len(set(x.split(" "))) >= 5:
                seen[doc, i] = (doc, set(x.split(" ")))
        if far < 0.8 * sum(len(x.split(" ")) for x in lines):
            texts.append((doc, "\n".join(kept)))
    texts = [x for x, c in zip(texts, N.brute_force(texts, 5, 80), strict=True) if c[0] == c[2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    auto = D.SuffixAutomaton([(i, D.words(t)) for i, t in items], 10)
    out = []
    for doc, text in texts:
        its = D.words(text)
        hit, _ = auto.hits(its)
        if sum(hit[1::2]) - sum(hit[::2]) <= 0.5 * len(its):
            out.append((doc, D.without_spans(text, hit) if hit else text))
    return out


def test_against_plain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = corpus_pipeline.run(spark, data)
    assert got.columns == [*docs.columns, "position"]
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(plain(spark, docs, data))
    assert len({r.position for r in rows}) == len(rows) and all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_odd_rows(spark, data, k):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**12, "", "en", "s", 0), (10**12, "", "en", "s", 0), (10**12 + 1, "word", None, None, 4)], docs.schema)
    _, stage = corpus_pipeline.STAGES[k]
    both = docs.unionByName(odd).withColumns({"__rank": F.lit(1), "hits": F.lit("x")})
    out = stage(spark, both, data)
    assert set(both.columns) <= set(out.columns)
    assert out.filter("doc_id >= 1000000000000 or doc_id is null").count() == 4
    assert stage(spark, docs.limit(0), data).count() == 0
