"""Contaminated rows go whatever their doc_id is, and take no clean row with them."""

import corpus_pipeline


def test_rows_are_judged_by_their_text(spark, sf_dir):
    item = max((r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    bad, clean = f"before {item} after", "a clean text of its own"
    rows = [(None, bad), (1, bad), (1, clean), (2, clean), (None, clean), (3, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, clean), (2, clean), (None, clean), (3, None)], key=str)
