"""Queries on jobs read every text to its end; that they equal their SQL is tested with all others."""

from quarryline.plans import registry
from quarryline.plans.tables import table


def test_jobs_keep_whole_texts(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    assert all(r.description_text.startswith(texts[r.doc_id]) for r in table(spark, data, "jobs").collect())


def test_words_at_the_end_count(spark, tmp_path):
    own = "plain words of no weight " * 400
    rows = [(1, own + "commission only be your own boss https://far.example.org/x1"), (2, own + "see http://end.example.org/y."), (4, own + "x"), (20, own + "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    uid = {r.job_uid: r.doc_id for r in table(spark, str(tmp_path), "jobs").collect()}
    urls = {uid[r.job_uid]: r.urls.split() for r in q["q_all_urls"](spark, str(tmp_path)).collect()}
    assert urls[1] == ["https://far.example.org/x1"] and urls[2] == ["http://end.example.org/y"]
    flags = {uid[r.job_uid]: r.flags for r in q["q_quality_flags"](spark, str(tmp_path)).collect()}
    assert "mlm_scam" in flags[1]
    assert len(q["q_classify_internship"](spark, str(tmp_path)).collect()) == 4
