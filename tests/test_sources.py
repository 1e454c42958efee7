import gzip
import json

import pytest

from evtide.sources import files
from evtide.streaming import counts


def test_last_prediction_wins(spark, tmp_path):
    f = tmp_path / "p.jsonl.gz"
    rows = [{"qid": "a", "answer": [{"firm_ticker": "X"}]}, {"qid": "b", "answer": 3}, {"qid": "a", "answer": [{"firm_ticker": "Y", "cited_urls": ["u"]}]}, {"answer": 1}]
    f.write_bytes(gzip.compress(("\n".join(map(json.dumps, rows)) + "\n\n{bad").encode()))
    got = {r.qid: r for r in files.predictions(spark, str(f)).collect()}
    assert set(got) == {"a", "b"} and got["a"].answer[0].firm_ticker == "Y" and got["b"].number == 3


def test_legacy_shapes(spark):
    shapes = [{"a": "1", "b": "2"}, [{"qid": "c", "answer": "3"}], {"predictions": [{"qid": "d", "answer": "4"}]}]
    df = spark.createDataFrame([(json.dumps(s),) for s in shapes], "value string")
    assert {(r.qid, r.answer) for r in files.legacy_predictions(df).collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")}


def test_csv_corpus(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text('article_url,article_date,title,text,ticker\nu1,2020,"a","first ""x""\nline",T\nu1,2021,b,second,\n,2020,c,no url,\n')
    got = {r.article_url: (r.text, r.ticker) for r in files.csv_corpus(spark, str(f)).collect()}
    assert got == {"u1": ("second", ""), "": ("no url", "")}
    with pytest.raises(ValueError):
        files.csv_corpus(spark, str(f), ("missing",))


def test_json_document_and_entity_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    assert files.json_records(spark, str(tmp_path / "d.json"), "k int").count() == 2
    files.write_per_entity(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "e string, n int"), str(tmp_path / "out"), "e")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    files.write_lines(spark.range(2), str(tmp_path / "lines"))
    files.write_lines(spark.range(2), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4


def test_stream_counts_like_a_batch(spark, base, tmp_path):
    events = spark.read.parquet(f"{base}/events.parquet").orderBy("ts")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    events.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    stream = counts.windowed_counts(counts.first_seen(counts.event_stream(spark, str(tmp_path / "in"), "60 days")))
    counts.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = counts.windowed_counts(events.withColumn("ts", events["ts"].cast("timestamp")))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert streamed.subtract(batch).count() == 0
    assert batch.agg({"n": "sum"}).first()[0] == events.count()
