"""Sources, sinks and streams over several files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import verification as vf
from scriptoria.sources import corpus, event_log, exports, vector_store
from scriptoria.streaming import monitors as mo
from scriptoria.streaming import sources as so
from scriptoria.streaming.verification import verify_stream


def test_text_files(spark, tmp_path):
    words = " ".join(["motté"] * 60)
    (tmp_path / "a.txt").write_bytes(words.encode("utf-8"))
    (tmp_path / "b.TXT").write_bytes(words.encode("latin-1"))
    (tmp_path / "short.txt").write_text("too short")
    (tmp_path / "c.pdf").write_text(words)
    rows = corpus.ingest_text(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.txt", "b.TXT"]
    assert {r.text for r in rows} == {words} and {r.word_count for r in rows} == {60}


def test_training_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,author,label\n"one, two",ann,0\nthree,bo,1\n"four\nfive",ann,x\n')
    by_label = corpus.load_training_csv(spark, str(tmp_path), label_col="label").collect()
    assert {(r.kind, r.text) for r in by_label} == {("human", "one, two"), ("ai", "three")}
    assert corpus.load_training_csv(spark, str(tmp_path)).filter("author = 'ann'").count() == 2


def test_event_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(5).select(F.lit("SubmissionMinted").alias("eventType"), F.col("id").alias("tokenId"))
    event_log.append_events(rows, path)
    event_log.append_events(rows, path)
    back = event_log.read_events(spark, path)
    assert back.count() == 10 and back.schema == event_log.EVENT_SCHEMA


def test_exports(spark, tmp_path):
    rows = spark.range(25).select((F.col("id") % 2).alias("user"), "id")
    docs = exports.chunked_documents(rows, "user", "id", ["id"], {}, per_document=5)
    n = docs.select("user", F.size(F.from_json("document", "records array<struct<id:long>>")["records"]).alias("n"))
    assert n.agg(F.sum("n")).head()[0] == 25 and docs.count() > 2
    exports.write_export(rows, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 25
    with pytest.raises(ValueError):
        exports.write_export(rows, str(tmp_path / "p"), "pdf")


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "v")
    packed = spark.createDataFrame([([1, 2], [[1.0], [2.0]])], "ids array<long>, vs array<array<double>>")
    vector_store.write_vectors(vector_store.zip_ids(packed, "ids", "vs"), path)
    store = vector_store.read_vectors(spark, path)
    found = {r.id: r.vector for r in vector_store.lookup(spark.range(1, 4), store, "id").collect()}
    assert found == {1: [1.0], 2: [2.0], 3: None}
    bad = spark.createDataFrame([([1, 2], [[1.0]])], "ids array<long>, vs array<array<double>>")
    with pytest.raises(Exception, match="differ"):
        vector_store.zip_ids(bad, "ids", "vs").collect()


@pytest.fixture(scope="module")
def login_files(spark, tmp_path_factory):
    """Logins of three users over four files in time order; one user makes most of them."""
    rng, start = random.Random(11), dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([30, 200, 900, 4000])
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), start + dt.timedelta(seconds=t), rng.random() < 0.15))
    path = str(tmp_path_factory.mktemp("logins"))
    schema = "event_id long, user_id long, ts timestamp, success boolean"
    for k in range(4):
        spark.createDataFrame(rows[k * 100:(k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, schema)


def test_lockout_stream_equals_table(spark, login_files):
    path, table = login_files
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = so.drain(mo.lockouts(stream, "user_id", "ts", "success"), "locks", "append")
    got = {(r.user, r.locked_until) for r in rows.collect()}
    want = mo.lockouts_table(table, "user_id", "ts", "event_id", "success").collect()
    assert want and {(r.user_id, r.locked_until) for r in want} <= got
    assert rows.count() == sum(r.failures - 4 for r in want)


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def run_on(spark, make, first, then, folder):
    """Checkpoint of a stream that has read its first rows and, twice, rows far later that move the watermark."""
    path, checkpoint = str(folder / "in"), str(folder / "checkpoint")
    for rows in (first, then, then):
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        query = make(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
    return checkpoint


def test_no_state_is_left_after_the_last_timer(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    row = lambda i, user, minutes, ok, status: (i, user, start + dt.timedelta(minutes=minutes), ok, status)
    schema = "n int, user_id string, ts timestamp, success boolean, status string"
    early = spark.createDataFrame([row(i, f"u{i % 5}", i, False, "PENDING") for i in range(40)], schema)
    late = spark.createDataFrame([row(99, "later", 100_000, True, "CONFIRMED")], schema)
    locks = lambda s: mo.lockouts(s, "user_id", "ts", "success", tie="n")
    checkpoint = run_on(spark, locks, early, late, tmp_path / "locks")
    assert state_rows(spark, checkpoint, "run") == 0
    changes = lambda s: mo.status_changes(s, "user_id", "ts", "status", tie="n", forget_seconds=3600)
    checkpoint = run_on(spark, changes, early, late, tmp_path / "changes")
    assert state_rows(spark, checkpoint, "seen") <= 1  # the latest key alone


def test_counts_stream_equals_table(spark, login_files):
    path, table = login_files
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = so.newest_state(so.drain(mo.requests_per_minute(stream, "user_id", "ts", "1 day"), "rpm", "update"), ["user_id", "minute"])
    want = mo.requests_per_minute(table, "user_id", "ts")
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_verification_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"o{i % 2}", f"sample essay number {i // 2} with a few more words to read and compare. It has two sentences." * 3) for i in range(8)],
        "doc_id long, source string, text string")
    vectors = docs.select("doc_id", F.array(F.lit(1.0), (F.col("doc_id") / 10.0)).alias("embedding"))
    docs.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.result, r.n_duplicates) for r in verify_stream(stream, vectors).collect()}
    want = {r.doc_id: (r.result, r.n_duplicates) for r in vf.verify_submissions(docs, vectors).collect()}
    assert got == want and all(n > 0 for _, n in want.values())


def test_rejected_files_and_lines_are_told(spark):
    files = [("a.txt", 5, b"too few"), ("b.pdf", 5, b"x"), ("c.TXT", 99, b"x"), ("d.txt", 9, b"word " * 60), ("e.txt", 3, None)]
    table = spark.createDataFrame([(p, n, bytearray(c) if c else None) for p, n, c in files], "path string, length long, content binary")
    told = {r.path: r.reason for r in corpus.judged_text_files(table, max_bytes=50).collect()}
    assert told == {"a.txt": "too few words", "b.pdf": "suffix", "c.TXT": "size", "d.txt": None, "e.txt": "no content"}
    assert [r.path for r in corpus.accept_text_files(table, max_bytes=50).collect()] == ["d.txt"]
    lines = spark.createDataFrame([('{"eventType": "Paused"}',), ("{broken",), (None,), ("{}",)], "value string")
    assert event_log.parse_lines(lines).count() == 1 and event_log.unreadable_lines(lines).count() == 3


def test_feature_matrix_has_no_limit_on_names(spark):
    from scriptoria.operators import stylometry

    rows = spark.sql("SELECT id % 7 AS k, concat('f', lpad(id, 6, '0')) AS feature, CAST(id AS DOUBLE) AS value FROM range(20000)")
    names, matrix = stylometry.feature_matrix(rows, "k")
    got = names.orderBy("feature").collect()
    assert [r.pos for r in got] == list(range(20000))
    row = matrix.filter("k = 3").first()
    assert row.size == 20000 and row.pos == list(range(3, 20000, 7)) and row["values"] == [float(i) for i in range(3, 20000, 7)]


def test_streams_read_tables_of_several_files_and_none(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "other.parquet"))
    rows = so.drain(so.stream_table(spark, str(tmp_path), "many"), "many", "append")
    assert sorted(r.id for r in rows.collect()) == list(range(10))
    (tmp_path / "none.parquet").mkdir()
    none = spark.readStream.schema("id long").parquet(str(tmp_path / "none.parquet"))
    got = so.drain(none, "none", "append", lambda batch, batch_id: batch.withColumn("twice", batch["id"] * 2))
    assert got.columns[:2] == ["id", "twice"] and got.count() == 0
