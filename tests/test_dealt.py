"""Texts are dealt over tasks of bounded size."""

from sitegauge import session
from sitegauge.operators import topics


def test_texts_are_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id", "repeat(md5(string(id)), 50) || ' word' || id % 7 || ' two words' as text").repartition(2).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    splits = texts.rdd.getNumPartitions()
    assert session.dealt(texts).rdd.getNumPartitions() == splits
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    more = session.dealt(texts)
    assert splits < more.rdd.getNumPartitions() <= session.MOST_PARTS * splits
    counts = [sorted(map(tuple, topics.term_counts(topics.with_terms(t, "text")).collect())) for t in (texts, more)]
    assert counts[0] == counts[1] and counts[0]
