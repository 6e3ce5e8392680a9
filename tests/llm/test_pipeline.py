"""The pipeline's stages on the smallest table."""

import corpus_pipeline
from voxelith.llm import ngram_join, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "ngram_jaccard_join":
            named = ngram_join.join_documents(before)
            assert docs.count() == named.select("component_id").distinct().count()
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] <= sizes[5]


def test_repeated_rows_count_once(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a b c d e f", None, None, 11), (1, "a b c d e f", None, None, 11), (2, "a b c d e f", None, None, 11), (3, "", None, None, 0), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, rows, sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
