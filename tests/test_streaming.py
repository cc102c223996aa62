import datetime as dt

from lumenfold.operators import proximity as P
from lumenfold.streaming import ledger as L


def test_stream_scores_equal_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "supply risk", t), (2, "nothing", t), (3, "supply risk", t), (4, "risk in supply", t + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "doc_id long, text string, arrived timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    v = lambda x: P.vocabulary(spark, {x: 1.0})
    stream = L.distinct_texts(L.document_stream(spark, f"{tmp_path}/in"))
    L.score_stream(stream, (v("supply"), v("risk"), v("none")), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {r.id: r.n_pairs for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 3 and got[2] == 0 and got[4] == 1
    query = L.arrivals(L.document_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("arrivals").collect()) == [1, 3]
