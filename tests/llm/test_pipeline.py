from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, corpus, frame, jaccard_components


def test_stages_by_brute_force(spark, tmp_path):
    rows = [r for r in corpus() if r[0] != 306]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    text = {r[0]: r[1] for r in rows}
    assert set(kept["language_id"]) == {i for i, t in text.items() if any(map(str.isalpha, t or ""))}
    last = {}
    for i in sorted(kept["language_id"]):
        last[text[i]] = i
    assert kept["exact_dedup"] == Counter(last.values())
    left = [(i, text[i]) for i in kept["exact_dedup"]]
    groups = jaccard_components(left, 5, 80, 100)
    assert kept["ngram_jaccard"] == Counter(i for i, (_, c) in groups.items() if i == c)
    assert set(kept["mix_sources"]) <= set(kept["ngram_jaccard"]) and set(kept["best_fit_packing"]) == set(kept["mix_sources"])
    first = docs.where("piece = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r["doc_id"]: r["n"] for r in first.collect()} == dict(kept["mix_sources"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["doc_id"] for r in again.collect()) == kept["best_fit_packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
