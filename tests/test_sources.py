import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine.sources import readers as rd
from vectrine.sources import writers as wr
from vectrine.streaming import online as st


def test_corpus_and_queries(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.jsonl").write_text('{"_id": "1", "contents": "a  b"}\n\n{"id": "2", "text": " "}\n{"doc_id": "3", "text": "t"}\n{"text": "no id"}\n')
    with gzip.open(tmp_path / "c" / "y.jsonl.gz", "wt") as f:
        f.write('{"doc_id": "4", "body": "z"}\n')
    assert sorted((r.doc_id, r.text) for r in rd.read_corpus(spark, str(tmp_path / "c")).collect()) == [("1", "a b"), ("3", "t"), ("4", "z")]
    e = tmp_path / "e" / "deep"
    e.mkdir(parents=True)
    (e / "my_queries.jsonl").write_text('{"_id": "q1", "text": "a", "emb": [1, 2]}\n{"_id": "q1", "text": "b", "emb": [3, 4]}\n{"_id": "q2", "text": "c"}\n')
    (e / "other.jsonl").write_text('{"_id": "q9", "text": "a", "emb": [1, 2]}\n')
    assert [tuple(r) for r in rd.read_embedded_queries(spark, str(tmp_path / "e")).collect()] == [("q1", "a", [1.0, 2.0])]


def test_qrels_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("query_id\tdoc_id\nq1\td1\nq1\td1\nq2\td2\n")
    (tmp_path / "b.txt").write_text("q1 0 d1 1\nq2 0 d2 0\n")
    (tmp_path / "c.tsv").write_text("qid\tdid\nq1\td1\n")
    want = [("q1", "d1"), ("q2", "d2")]
    read = lambda f, n: sorted(tuple(r) for r in f(spark, str(tmp_path / n)).collect())
    assert read(rd.read_qrels, "a.tsv") == read(rd.read_qrels, "b.txt") == read(rd.read_qrels_strict, "a.tsv") == want
    with pytest.raises(ValueError):
        rd.read_qrels_strict(spark, str(tmp_path / "c.tsv"))
    q = rd.read_qrels(spark, str(tmp_path / "a.tsv"))
    assert rd.restrict_qrels(q, spark.createDataFrame([("q1",)], "query_id string"), spark.createDataFrame([("d1",), ("d2",)], "doc_id string")).count() == 1


def test_matrices_offsets_and_rankings(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = rd.read_matrices(spark, str(tmp_path / "m.npy")).orderBy("row").collect()
    assert [r.v for r in got] == m.tolist()
    np.save(tmp_path / "f.npy", np.asfortranarray(m))
    with pytest.raises(Exception, match="row order"):
        rd.read_matrices(spark, str(tmp_path / "f.npy")).collect()
    (tmp_path / "o.txt").write_text("7\n3\n\n7\n")
    assert sorted(r.offset for r in rd.read_offsets(spark, str(tmp_path / "o.txt"), 4, 5).collect()) == [0, 1, 2, 3, 7]
    with pytest.raises(ValueError):
        rd.read_offsets(spark, str(tmp_path / "o.txt"), 4, 9)
    (tmp_path / "r.jsonl").write_text(json.dumps({"query_id": "q", "doc_ids": ["b", "a", "b"]}) + "\n")
    (tmp_path / "r.tsv").write_text("q\tb\nq\ta\n")
    ids = spark.createDataFrame([(0, "b"), (1, "a")], "doc_idx long, doc_id string")
    np.save(tmp_path / "n.npy", np.array([[0, 1]]))
    want = [("q", 1, "b"), ("q", 2, "a")]
    assert sorted(map(tuple, rd.read_rankings(spark, str(tmp_path / "r.jsonl"), "jsonl").collect())) == want
    assert sorted(map(tuple, rd.read_rankings(spark, str(tmp_path / "r.tsv"), "tsv").collect())) == want
    assert sorted(map(tuple, rd.read_rankings(spark, str(tmp_path / "n.npy"), "npy", ids).collect())) == [("0", 1, "b"), ("0", 2, "a")]


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("Total time: 5 ms\n[A]\nTotal time: 7.5 ms\nk-NNs IDs: (3, 1, 2)\n[B]\nTotal comm: 2 MB\n")
    log = rd.lines(spark, str(tmp_path / "x.log"))
    r = rd.last_metric(log, **rd.COMMON_METRICS).first()
    assert (r.total_ms, r.total_mb) == (7.5, 2.0)
    assert rd.neighbour_ids(log, 2).first().ids == [3, 1]
    assert [r.section for r in rd.sections(log, r"^\[(\w)\]").orderBy("line_no").collect()] == [None, "A", "A", "A", "B", "B"]


def test_query_lines_and_paths(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\thello  there\n1\tagain\n2\tx\ty\nbad\n")
    assert sorted(map(tuple, rd.read_query_tsv(spark, str(tmp_path / "q.tsv")).collect())) == [("1", "hello there"), ("2", "x y")]
    assert rd.resolve(spark, str(tmp_path / "*.tsv")).endswith("q.tsv")
    with pytest.raises(ValueError):
        rd.resolve(spark, str(tmp_path / "*.none"))


def test_round_trips(spark, tmp_path):
    d = spark.createDataFrame([(1, [0.5, -1.0])], "doc_idx long, v array<double>")
    wr.write_matrix_text(d, "v", str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == "0.5 -1.0"
    assert np.frombuffer(wr.quantized_bytes(d, "doc_idx", "v").first().bytes, "<u4").tolist() == [191, 0]
    a = spark.createDataFrame([(1, 0)], "doc_idx long, cluster_id int")
    wr.write_cluster_artifact(a, spark.createDataFrame([(0, 0.1)], "cluster_id int, r_max double"), {"k": 1}, str(tmp_path / "art"))
    assert json.loads(spark.read.text(str(tmp_path / "art" / "meta")).first().value) == {"k": 1}
    p = str(tmp_path / "grow")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    wr.append_missing(rows.filter("id = 1"), p, "id")
    wr.append_missing(rows, p, "id")
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [1, 2]
    c = spark.createDataFrame([("s", 1.0, 2.0, 3.0, ["x", "y"])], "system string, client_ms double, server_ms double, recover_ms double, notes array<string>")
    wr.write_contract_csv(c, str(tmp_path / "csv"))
    r = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert (r.system, r.total_ms, r.notes, r.dataset) == ("s", "6.0", "x|y", None)
    wr.write_topk_tsv(spark.createDataFrame([("q", 1, "d"), ("q", 2, "e")], "query_id string, rank int, doc_idx string"), spark.createDataFrame([("q", "e")], "query_id string, doc_idx string"), str(tmp_path / "top"))
    assert sorted((r["rank"], r.relevant) for r in spark.read.csv(str(tmp_path / "top"), sep="\t", header=True).collect()) == [("1", "0"), ("2", "1")]
    assert "constexpr int kDim = 64;" in wr.bridge_header({"Dim": 64})


def test_streams(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, qv array<double>").write.parquet(str(src))
    cs = spark.createDataFrame([(0, [1.0, 0.1], 0.5), (1, [0.0, 1.0], 0.01)], "cluster_id int, center array<double>, r_max double")
    q = spark.readStream.schema("query_id long, qv array<double>").parquet(str(src))
    s = st.stream_retrieval(q, lambda df: st.stream_gate(df, cs, 0.1), str(sink), str(tmp_path / "ck"))
    s.awaitTermination()
    got = {r.query_id: (r.cluster_id, r.track) for r in spark.read.parquet(str(sink)).collect()}
    assert got == {1: (0, "dense_rdp"), 2: (1, "out_of_scope")}


def test_late_events_are_dropped(spark, tmp_path):
    rows = lambda ts: spark.createDataFrame([(t, "click", 1.0) for t in ts], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    src = str(tmp_path / "ev")
    rows(["2025-01-01 00:10:00", "2025-01-01 05:00:00"]).coalesce(1).write.parquet(src)
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: st.stream_metrics(events, "1 hour", "30 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    run()
    rows(["2025-01-01 00:20:00", "2025-01-01 09:00:00"]).coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted((r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [(0, 1), (5, 1)]
