import pytest

from framewright.streaming import processors as P


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_reorder_batch(spark):
    rows = spark.createDataFrame([("s", i, p) for i, p in enumerate([0, 40, 20, 10, 30, 50])], "k string, n long, pts long")
    out = P.run_batch(rows, "k", "n", lambda: P.Reorder(2))
    assert [r["pts"] for r in sorted(out.collect(), key=lambda r: (r["released_by"] is None, r["released_by"] or 0, r["pts"]))] == [0, 10, 20, 30, 40, 50]


def test_clock_and_recovery(spark):
    rows = spark.createDataFrame([("s", 0, None, 480), ("s", 1, 1000, 480), ("s", 2, None, 480)], "k string, n long, anchor long, samples long")
    assert collect(P.run_batch(rows, "k", "n", P.AudioClock), "n", "ns") == [(0, None), (1, 1000), (2, 10001000)]
    units = [(0, False, True, True), (1, True, False, False), (2, True, True, False), (3, False, True, False), (4, False, True, True), (5, True, False, False)]
    rows = spark.createDataFrame([("s", *u) for u in units], "k string, n long, bad boolean, reference boolean, key boolean")
    assert collect(P.run_batch(rows, "k", "n", P.Recovery), "n", "action") == [(0, "decode"), (1, "drop"), (2, "flush"), (3, "drop"), (4, "decode"), (5, "drop"), (5, "error")]


def test_slots(spark):
    rows = [("s", 0, 0xFF, True, None), ("s", 1, 0x02, False, None), ("s", 2, 0, True, 1), ("s", 3, 0x01, True, None)]
    out = P.run_batch(spark.createDataFrame(rows, "k string, n long, refresh int, show boolean, existing int"), "k", "n", lambda: P.Slots(3))
    assert collect(out, "n", "shown", "slots") == [(0, 0, "0,0,0"), (1, None, "0,1,0"), (2, 1, "0,1,0"), (3, 3, "3,1,0")]
    rows = [("s", 0, True, 0, 0, 7), ("s", 1, False, 1, 2, 1), ("s", 2, False, 2, 1, 0)]
    out = P.run_batch(spark.createDataFrame(rows, "k string, n long, key boolean, copy_golden int, copy_alternate int, refresh int"), "k", "n", P.ThreeReferences)
    assert collect(out, "n", "slots") == [(0, "0,0,0"), (1, "1,0,0"), (2, "1,0,1")]


def test_isolation_and_policies(spark):
    rows = spark.createDataFrame([("s", i, k, b) for i, (k, b) in enumerate([("video", False), ("audio", True), ("audio", False), ("video", False)])], "k string, n long, kind string, bad boolean")
    assert collect(P.run_batch(rows, "k", "n", P.Tracks), "n", "kind") == [(0, "video"), (1, "audio_error"), (3, "video")]
    rows = spark.createDataFrame([("s", i, "video", i == 1) for i in range(4)], "k string, n long, kind string, bad boolean")
    for policy, left in (("sticky", [0]), ("skip", [0, 2, 3]), ("reset", [0, 2, 3])):
        out = P.run_batch(rows, "k", "n", P.Tracks, policy).collect()
        assert sorted(r["n"] for r in out if r["failure"] is None) == left and sum(r["failure"] is not None for r in out) == 1


def test_overlap(spark):
    rows = spark.createDataFrame([("s", 0, [1.0, 2.0, 3.0, 4.0]), ("s", 1, [10.0, 20.0, 30.0, 40.0])], "k string, n long, block array<double>")
    assert collect(P.run_batch(rows, "k", "n", P.Overlap), "n", "samples") == [(0, [1.0, 2.0]), (1, [13.0, 24.0])]


@pytest.mark.parametrize("cuts", [(1,), (3, 17), (257,)])
def test_stream_equals_batch(spark, tmp_path, cuts):
    """Records of 5 bytes out of chunks of any size, in micro-batches."""
    data, rows, at, i = bytes(range(250)) * 3, [], 0, 0
    while at < len(data):
        n = 64 * cuts[i % len(cuts)]
        rows.append(("s", i, bytearray(data[at : at + n]), False))
        at, i = at + n, i + 1
    rows.append(("s", i, None, True))
    schema = "k string, seq long, bytes binary, end boolean"
    source = tmp_path / "in"
    for j in range(0, len(rows), 5):
        spark.createDataFrame(rows[j : j + 5], schema).coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = f"out{len(rows)}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = P.run_stream(stream, "k", "seq", lambda: P.Chunks(5)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = b"".join(bytes(r["record"]) for r in spark.table(name).orderBy("n").collect())
    batch = P.run_batch(spark.createDataFrame(rows[:-1], schema), "k", "seq", lambda: P.Chunks(5))
    assert got == data == b"".join(bytes(r["record"]) for r in batch.orderBy("n").collect())
