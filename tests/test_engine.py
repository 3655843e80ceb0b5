"""The engine's registered queries against DuckDB, and its operators against small worked cases."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import scalars, timeparts
from tidemark.operators import ml, pca, profile, resample, sampling, segments, store, windows
from tidemark.plans import queries as engine
from tidemark.plans.registry import Registry, Resource, standard
from tidemark.sources import codecs, files, npy, remote
from tidemark.streaming import sensors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, con, name):
    got = engine.QUERIES[name](spark, SF).toPandas()
    if name not in engine.ORACLES:
        assert len(got) > 0
        return
    want = con.execute(engine.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float | np.floating) else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)


#: Queries over every event's metric, which a value of 655.36 or more takes out of int16.
WIDE = [
    "battery_percent",
    "partition_keys_hour",
    "stream_count_features",
    "stream_reservoir",
    "zigzag_delta",
    "delta_decode_roundtrip",
    "partition_keys_minute",
    "store_append_query",
    "stream_count_windows",
    "stream_time_windows",
    "partition_keys_date",
    "samples_append_roundtrip",
    "store_query_counters",
    "stream_features",
    "timerange_dense_rows",
]


@pytest.fixture(scope="session")
def wide(tmp_path_factory):
    """Two copies of the events with shifted keys, in which ids don't rise with time, and two values beyond int16."""
    d = str(tmp_path_factory.mktemp("wide"))
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    value = "CASE WHEN event_id = 500 AND k = 1 THEN 700.5 WHEN event_id = 700 THEN 2000 ELSE value END AS value"
    c.execute(f"COPY (SELECT event_id + 1000 * k AS event_id, ts + to_microseconds(137 * k) AS ts, user_id, event_type, {value}, props FROM '{SF}/events.parquet', range(2) AS t(k) ORDER BY 1) TO '{d}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return d, c


@pytest.mark.parametrize("name", WIDE)
def test_values_beyond_int16(spark, wide, name):
    """Against the query's SQL with a metric of 32 bits; as it stands the SQL refuses such values wherever it needs them."""
    d, c = wide
    got = engine.QUERIES[name](spark, d).toPandas()
    if name not in engine.ORACLES:
        assert got.groupby("key").size().tolist() == [10] * 4 and got.groupby("key")["seen"].first().sum() == 2000
        return
    sql = engine.ORACLES[name].replace("CAST(floor(value * 50) AS SMALLINT)", "CAST(floor(value * 50) AS INTEGER)").replace("& 131071", "")
    want = c.execute(sql).df()
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float | np.floating) else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and key(got) == key(want)


#: Queries that need no narrower metric than 64 bits.
FAR = [
    "partition_keys_hour",
    "stream_reservoir",
    "delta_decode_roundtrip",
    "partition_keys_minute",
    "stream_time_windows",
    "partition_keys_date",
    "stream_features",
    "timerange_dense_rows",
    # far: more
]


@pytest.fixture(scope="session")
def far(tmp_path_factory):
    """Events of which one's metric is beyond 32 bits, and some have no value or no time; ids leave gaps of more than 100,000."""
    d = str(tmp_path_factory.mktemp("far"))
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    odd = "event_id + event_id // 300 * 250000 AS event_id, CASE WHEN event_id = 70 THEN NULL ELSE ts END AS ts, CASE WHEN event_id = 700 THEN 5e7 WHEN event_id % 50 = 9 THEN NULL ELSE value END AS value"
    c.execute(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet') TO '{d}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return d, c


@pytest.mark.parametrize("name", FAR)
def test_values_beyond_32_bits_and_nulls(spark, far, name):
    """Against the query's SQL with a metric of 64 bits."""
    d, c = far
    got = engine.QUERIES[name](spark, d).toPandas()
    if name not in engine.ORACLES:
        assert got.groupby("key").size().tolist() == [10] * 4 and got.groupby("key")["seen"].first().sum() == 1000
        return
    want = c.execute(engine.ORACLES[name].replace("AS SMALLINT", "AS BIGINT").replace("CAST(v AS INT)", "v")).df()
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple("" if str(x) in ("None", "nan", "<NA>") else f"{x:.6f}" if isinstance(x, int | float | np.number) else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and key(got) == key(want)


#: Queries that give the total of a partition's metric.
TOTALS = [
    "partition_keys_minute",
    "partition_keys_date",
    # totals: more
]


@pytest.mark.parametrize("name", TOTALS)
def test_totals_whose_parts_leave_64_bits(spark, tmp_path, name):
    """Metrics of 8.5e18 and -8.5e18 in one minute, half of each: any two of one sign are beyond 64 bits, the total is 0."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    odd = "TIMESTAMP '2024-01-01 05:00:01' + to_microseconds(event_id) AS ts, CASE WHEN event_id % 4 < 2 THEN 1.7e17 ELSE -1.7e17 END AS value"
    c.execute(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(f"SELECT path, n, total FROM ({engine.ORACLES[name].replace('AS SMALLINT', 'AS BIGINT')})").fetchall()
    assert [tuple(r) for r in engine.QUERIES[name](spark, str(tmp_path)).select("path", "n", "total").collect()] == want and want[0][1:] == (1000, 0)


@pytest.mark.parametrize("name", ["partition_keys_date"])
@pytest.mark.parametrize("years", [10_000, -2_030, -2_124, 270_000])
def test_paths_of_years_beyond_four_digits(spark, tmp_path, name, years):
    """Against the query's SQL as it stands; half of the events keep their year."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + to_years({years}) END AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(f"SELECT path, n, total FROM ({engine.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in engine.QUERIES[name](spark, str(tmp_path)).select("path", "n", "total").collect()) == sorted(want)


def changed(tmp_path, odd, order="event_id"):
    """A folder of events with some columns replaced, and DuckDB on them."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet' ORDER BY {order}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    return str(tmp_path), c


@pytest.mark.parametrize("name", ["partition_keys_date", "partition_keys_hour", "partition_keys_minute"])
def test_paths_of_infinite_times(spark, tmp_path, name):
    """Against the query's SQL as it stands."""
    d, c = changed(tmp_path, "CASE event_id % 10 WHEN 3 THEN 'infinity' WHEN 7 THEN '-infinity' ELSE ts END AS ts")
    want = c.execute(f"SELECT path, n, total FROM ({engine.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in engine.QUERIES[name](spark, d).select("path", "n", "total").collect()) == sorted(want)


def dense(spark, d):
    return sorted((tuple(r) for r in engine.QUERIES["timerange_dense_rows"](spark, d).select("event_id", "row_idx", "us", "v").collect()))


def test_dense_rows_of_infinite_times(spark, tmp_path):
    """Against the query's SQL as it stands, in which infinite times have no number: 100 of each."""
    d, c = changed(tmp_path, "CASE event_id % 10 WHEN 3 THEN 'infinity' WHEN 7 THEN '-infinity' ELSE ts END AS ts")
    got, want = dense(spark, d), sorted(c.execute(f"SELECT event_id, row_idx, us, v FROM ({engine.ORACLES['timerange_dense_rows']})").fetchall())
    timed = lambda rows: [r for r in rows if r[2] is not None]
    assert timed(got) == timed(want) and len(timed(got)) == 800
    rest = lambda rows: sorted((r[0], r[3]) for r in rows if r[2] is None)
    assert rest(got) == rest(want) and sorted(r[1] for r in got if r[2] is None) == list(range(200))


def test_dense_rows_of_one_time_go_by_id(spark, tmp_path):
    d, c = changed(tmp_path, "date_trunc('hour', ts) AS ts", "md5(event_id::VARCHAR)")
    sql = engine.ORACLES["timerange_dense_rows"].replace("ORDER BY us)", "ORDER BY us, event_id)")
    assert dense(spark, d) == sorted(c.execute(f"SELECT event_id, row_idx, us, v FROM ({sql})").fetchall())


@pytest.mark.parametrize("value", ["184467440737095516.15", "'inf'", "'nan'", "-2e17"])  # 50 times the first is 2 ** 63
def test_a_metric_beyond_64_bits_is_an_error(spark, tmp_path, value):
    d, _ = changed(tmp_path, f"CASE WHEN event_id = 5 THEN {value}::DOUBLE ELSE value END AS value")
    with pytest.raises(Exception, match="beyond 64 bits|CAST_OVERFLOW"):
        dense(spark, d)


def test_the_largest_metrics_are_whole(spark, tmp_path):
    d, _ = changed(tmp_path, "CASE event_id WHEN 5 THEN 184467440737095488 WHEN 6 THEN -184467440737095516.16 ELSE value END AS value")
    v = {r[0]: r[3] for r in dense(spark, d)}
    assert (v[5], v[6]) == (int(184467440737095488.0 * 50), int(-184467440737095516.16 * 50)) and v[5] < 1 << 63


def test_delta_decode_of_no_events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert engine.QUERIES["delta_decode_roundtrip"](spark, str(tmp_path)).count() == 0


def test_registry_names():
    r = standard()
    assert r["raw"].hop_us == 40_000 and r["predictions"].columns == ("a", "b", "c", "d")
    with pytest.raises(ValueError):
        r["nothing"]
    for bad in (dict(columns=()), dict(hop_us=0), dict(granularity="week"), dict(codec="zip"), dict(dtype="int8")):
        with pytest.raises(ValueError):
            Resource(**({"name": "t", "columns": ("a",), "hop_us": 1} | bad))


def make(spark, tmp_path, granularity="hour", hop=1_000_000, columns=("a", "b")):
    r = Registry()
    r.add(Resource("sensor", columns, hop, granularity))
    return store.Store(spark, str(tmp_path), r)


def ramp(spark, n, offset=0):
    return spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + offset) % 30000).cast("short").alias("a"), ((F.col("id") + offset + 100) % 30000).cast("short").alias("b"))


HOUR = 1_704_412_800


def test_round_trip_and_ranges(spark, tmp_path):
    s = make(spark, tmp_path)
    assert s.query("sensor", 0, HOUR * 2).count() == 0 and not s.info("sensor").first()["has_data"] and s.last("sensor").count() == 0
    s.append("sensor", ramp(spark, 3600), HOUR)
    rows = s.query("sensor", HOUR, HOUR + 3600).collect()
    assert len(rows) == 3600 and [r["a"] for r in rows] == list(range(3600)) and rows[-1]["row_idx"] == 3599
    assert s.query("sensor", HOUR + 1000, HOUR + 2000).count() == 1000
    assert s.query("sensor", HOUR - 500, HOUR + 100).count() == 100 and s.query("sensor", HOUR + 7200, HOUR + 9000).count() == 0
    assert s.query("sensor", HOUR, HOUR + 10, ["b"]).columns == ["ts", "row_idx", "b"]
    with pytest.raises(ValueError):
        s.query("sensor", HOUR, HOUR - 1)
    with pytest.raises(ValueError):
        s.append("sensor", ramp(spark, 0), HOUR)
    with pytest.raises(ValueError):
        s.append("sensor", ramp(spark, 5).drop("b"), HOUR)


@pytest.mark.parametrize("granularity,start,rows,parts", [("hour", HOUR + 3500, 200, 2), ("minute", HOUR + 30, 150, 3), ("date", HOUR, 300, 1)])
def test_partition_split(spark, tmp_path, granularity, start, rows, parts):
    s = make(spark, tmp_path, granularity)
    s.append("sensor", ramp(spark, rows), start)
    info = s.info("sensor").first()
    assert info["n_partitions"] == parts and s.query("sensor", start, start + rows).count() == rows


def test_late_partitions(spark, tmp_path):
    s = make(spark, tmp_path)
    s.append("sensor", ramp(spark, 10), HOUR + 3600)
    with pytest.raises(ValueError):
        s.append("sensor", ramp(spark, 10), HOUR)
    s.append("sensor", ramp(spark, 10), HOUR, on_late="drop")
    s.append("sensor", ramp(spark, 10, 10), HOUR + 3700)
    again = store.Store(spark, str(tmp_path), s.registry)  # the guard reads what is stored
    with pytest.raises(ValueError):
        again.append("sensor", ramp(spark, 10), HOUR)
    assert again.query("sensor", 0, HOUR * 2).count() == 20
    again.drop("sensor")
    assert again.rows("sensor").count() == 0


def test_half_a_day_and_pruning(spark, tmp_path):
    s = make(spark, tmp_path)
    s.load_samples("sensor", ramp(spark, 43_200), HOUR)
    assert s.info("sensor").first()["n_partitions"] == 12
    out = s.query("sensor", HOUR + 5 * 3600, HOUR + 7 * 3600)
    assert out.count() == 7200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert s.last("sensor", 3600).count() == 3600


def test_floor_at_both_ends(spark):
    r = Resource("t", ("v",), 700_000, "date")
    rows = spark.range(4).select(F.timestamp_micros(F.col("id") * 700_000).alias("ts"), F.lit(1).cast("short").alias("v"))
    got = store.in_range(store.with_partitions(rows, r), r, 1, 2)
    assert [x["row_idx"] for x in got.collect()] == [1]


def test_catalog_and_counters_of_ranges(spark, tmp_path):
    s = make(spark, tmp_path)
    assert not s.info("sensor").first()["has_data"] and s.partitions("sensor") == []
    rows, counts = s.counted("sensor", HOUR, HOUR + 10)
    assert rows.count() == 0 and counts()["rows_read"] == 0
    s.append("sensor", ramp(spark, 3 * 3600), HOUR)
    got = s.info("sensor").first()
    assert (got["n_partitions"], got["start"], got["end"]) == (3, HOUR, HOUR + 3 * 3600)
    assert got["last_row"].timestamp() - got["first_row"].timestamp() == 3 * 3600 - 1
    rows, counts = s.counted("sensor", HOUR + 3500, HOUR + 3600 + 50, ["b"])
    assert rows.columns == ["ts", "row_idx", "b"] and len(rows.collect()) == 150
    got = counts()
    assert (got["partitions"], got["rows_read"], got["rows_skipped"], got["bytes"]) == (2, 150, 7050, 300) and got["total_ms"] >= got["plan_ms"] >= 0
    s.drop("sensor")
    assert not s.info("sensor").first()["has_data"]


def test_remote_source(spark):
    import http.server
    import threading
    import urllib.error
    import urllib.parse

    class Device(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = urllib.parse.urlsplit(self.path)
            asked = dict(urllib.parse.parse_qsl(at.query))
            if asked.get("resource") != "sensor":
                return self.send_error(404)
            if at.path == "/info":
                body = b'{"has_data": true}'
            else:
                t = np.arange(int(asked["start"]), min(int(asked["end"]), 250))  # nothing from second 250 on
                body = npy.to_bytes(np.stack([t, -t], 1))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Device)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        npy.register(spark)
        source = spark.read.format("remote").option("url", url).option("resource", "sensor").option("columns", "a,b").option("seconds", 100)
        got = source.option("start", 30).option("end", 400).load().collect()
        assert sorted((r["start_s"] + r["i"], r["a"], r["b"]) for r in got) == [(t, t, -t) for t in range(30, 250)]
        assert remote.info(url, "sensor") == {"has_data": True}
        with pytest.raises(urllib.error.HTTPError):
            remote.info(url, "nothing")
        with pytest.raises(ValueError):
            remote.get("file:///etc", "hostname")
    finally:
        server.shutdown()


def test_device_streams(spark, tmp_path):
    def rows(source, name):
        q = source.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
        try:
            while not q.lastProgress or q.lastProgress["batchId"] < 1:
                assert q.isActive
                q.awaitTermination(1)
        finally:
            q.stop()
        return spark.table(name)

    got = rows(sensors.accelerometer(spark, HOUR, rows_per_batch=60), "samples_").where("i < 60").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(60)) and (got[50].ts - got[0].ts).total_seconds() == 2
    assert (got[0].x, got[0].z) == (0, 1000) and got[50].x == got[0].x and max(abs(r.x) for r in got) <= 400
    got = rows(sensors.battery(spark, rows_per_batch=5), "battery_").limit(5).collect()
    assert [r["mv"] for r in sorted(got, key=lambda r: -r["mv"])][:5] == [4200, 4199, 4198, 4197, 4196] and all(0 <= r["percent"] <= 100 for r in got)


def test_gaps_close_in_dense_mode(spark, tmp_path):
    s = make(spark, tmp_path)
    s.append("sensor", ramp(spark, 20).where("i < 5 or i > 14"), HOUR, dense=True)
    assert [r["row_idx"] for r in s.query("sensor", HOUR, HOUR + 60).collect()] == list(range(10))


def test_features_by_hand(spark):
    xs = [(100, -50, 1000), (164, -50, 1128), (36, -50, 872), (100, -50, 1000)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "r int, x int, y int, z int")
    assert tuple(windows.window_features(df, 4, 4).first()) == (0, 1628, -814, 16282, 3, 100, -50, 1000)
    zero = spark.range(4).select(F.col("id").alias("r"), *(F.lit(0).alias(a) for a in "xyz"))
    assert tuple(windows.window_features(zero, 4, 4).first()) == (0,) * 8
    low = spark.createDataFrame([(0, -1, 0, 0), (1, 0, 0, 0)], "r int, x int, y int, z int")
    assert windows.window_features(low, 2, 2).first()["mean_x"] == 0


@pytest.mark.parametrize("n,want", [(0, 0), (99, 0), (100, 1), (124, 1), (125, 2), (60_000, 2397)])
def test_window_counts(spark, n, want):
    assert spark.range(1).select(windows.count_windows(n, 100, 25)).first()[0] == want
    if n < 1000:
        rows = spark.range(n).select(F.col("id").alias("r"), *(F.col("id").alias(a) for a in "xyz"))
        assert windows.window_features(rows, 100, 25).count() == want


def test_codec_words_by_hand():
    x = np.array([[32767], [-32768], [0], [-1], [1], [32767], [-32768]])
    assert codecs.zigzag(x[:, 0], 32767).tolist() == [0, 131069, 65536, 1, 4, 65532, 131069]
    data = codecs.encode_file(x)
    assert len(data) == 38 and [f"{w:08X}" for w in np.frombuffer(data, "<u4", 6, 14)] == ["80000000", "8001FFFD", "80010000", "70010001", "8000FFFC", "8001FFFD"]


@pytest.mark.parametrize("codec", sorted(codecs.MAGIC))
def test_codecs_round_trip(codec):
    rng = np.random.default_rng(1)
    for x in (np.stack([np.arange(300), 2 * np.arange(300) - 100, 50 - np.arange(300)], 1), rng.integers(-32768, 32768, (1000, 4)), rng.integers(-3, 4, (129, 1)), np.zeros((0, 2))):
        data = codecs.encode_file(x.astype(int), codec)
        assert (codecs.decode_file(data) == x).all() and codecs.read_header(data)[0] == codec
        more = codecs.append_file(data, x.astype(int))
        assert len(codecs.decode_file(more)) == 2 * len(x)
        if x.shape[1] > 2:
            assert (np.concatenate(list(codecs.decode_chunks(data, [2, 0]))) == x[:, [2, 0]]).all()
    with pytest.raises(ValueError):
        codecs.append_file(data, np.zeros((3, 5), int))
    with pytest.raises(ValueError):
        codecs.read_header(b"XXXX\1\2\0\0")
    with pytest.raises(ValueError):
        codecs.encode_file(np.array([[40_000]]), codec)


def test_ramps_pack_well():
    x = np.stack([np.arange(300), np.arange(300) * 2, np.arange(300) * 3], 1)
    assert x.size * 2 / len(codecs.encode_file(x)) > 3


def test_sample_files_as_a_source(spark, tmp_path):
    npy.register(spark)
    rows = spark.range(500).select(*((F.col("id") * (i + 1)).cast("short").alias(c) for i, c in enumerate("pq")))
    for codec in codecs.MAGIC:
        path = f"{tmp_path}/{codec}"
        rows.coalesce(1).write.format("samples").option("codec", codec).mode("append").save(path)
        back = spark.read.format("samples").option("columns", "p,q").load(path)
        assert [tuple(r) for r in back.orderBy("file", "pos").select("p", "q").collect()] == [tuple(r) for r in rows.collect()]
    numbered = rows.withColumn("i", F.col("p").cast("long"))
    npy.save(numbered, ["p", "q"], "i", f"{tmp_path}/x.npy")
    back = spark.read.format("npy").option("columns", "p,q").option("rows", "128").load(f"{tmp_path}/x.npy")
    assert back.rdd.getNumPartitions() == 4 and [tuple(r)[1:] for r in back.orderBy("i").collect()] == [tuple(r) for r in rows.collect()]
    assert (npy.from_bytes(b"".join(npy.response(numbered.orderBy("i"), ["p", "q"]))) == np.load(f"{tmp_path}/x.npy")).all()
    assert len(npy.header(3, 2)) % 64 == 0


def test_sample_files_append_and_overwrite(spark, tmp_path):
    npy.register(spark)
    rows = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a short, b short, c short").coalesce(1)
    path = f"{tmp_path}/s"
    for mode, n in (("overwrite", 2), ("append", 4), ("append", 6), ("overwrite", 2)):
        rows.write.format("samples").mode(mode).save(path)
        assert spark.read.format("samples").load(path).count() == n
    got = spark.read.format("samples").option("columns", "a,b,c").option("select", "c,a").load(path)
    assert got.columns == ["file", "pos", "c", "a"] and [(r["c"], r["a"]) for r in got.orderBy("pos").collect()] == [(3, 1), (6, 4)]
    big = spark.range(1000).select(*(F.col("id").cast("short").alias(c) for c in "abc")).coalesce(1)
    big.write.format("samples").option("chunk", 128).mode("overwrite").save(path)
    assert [r["b"] for r in spark.read.format("samples").option("columns", "a,b,c").load(path).orderBy("pos").collect()] == list(range(1000))


def test_a_batch_appended_again_adds_nothing(spark, tmp_path):
    s = make(spark, tmp_path)
    s.append("sensor", ramp(spark, 4000), HOUR, batch=0)
    s.append("sensor", ramp(spark, 100), HOUR + 4000, batch=1)
    s.append("sensor", ramp(spark, 100), HOUR + 4000, batch=1)
    assert s.rows("sensor").count() == 4100 and s.newest("sensor") == ("2024-01-05", "01")
    assert s.query("sensor", HOUR + 3990, HOUR + 4010).count() == 20
    plan = s.query("sensor", HOUR + 10, HOUR + 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "LessThan(ts" in plan
    with pytest.raises(ValueError):
        s.query("sensor", HOUR, HOUR)


def test_running_totals_in_two_levels(spark):
    from tidemark.operators.prefix import before_each

    rows = spark.range(25).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    for total, start in ((F.sum, lambda x: sum(x) if x else None), (F.max, lambda x: max(x, default=None))):
        got = {r["k"]: r["o"] for r in before_each(rows, "k", "v", total, "o", run=4).collect()}
        assert got == {k: start([i % 5 for i in range(k)]) for k in range(25)}


def test_row_numbers_over_several_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = windows.number_rows(rows, ["x"], parts=7)
    assert got.where("r <> x").count() == 0 and got.count() == 1000


def test_live_chain(spark, tmp_path):
    from tidemark.streaming import features as stream

    r = Registry()
    r.add(Resource("raw", ("acc_x", "acc_y", "acc_z"), 40_000, "minute"))
    r.add(Resource("features", stream.FEATURES, 1_000_000, "hour"))
    r.add(Resource("predictions", ("a",), 1_000_000, "hour"))
    s = store.Store(spark, f"{tmp_path}/db", r)
    samples = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 90).cast("short").alias("x"), (F.col("id") % 7).cast("short").alias("y"), F.lit(1000).cast("short").alias("z"))
    for _ in range(2):  # again from the same checkpoint: nothing is added
        source = stream.replay(spark, samples, f"{tmp_path}/replay", HOUR, 40_000, 300) if not os.path.exists(f"{tmp_path}/replay") else spark.readStream.schema("ts timestamp, i long, x short, y short, z short").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/replay/files")
        for q in stream.live(source, s, "raw", "features", f"{tmp_path}/check", 100, 25, lambda f: f.select("ts", F.floor(F.col("mean_z") / 500).cast("short").alias("a")), "predictions"):
            q.awaitTermination()
        assert s.rows("raw").count() == 1000 and s.rows("features").count() == 37
        assert [x["a"] for x in s.rows("predictions").collect()] == [2] * 37
    want = [tuple(x)[1:] for x in windows.window_features(samples.withColumnRenamed("i", "r")).orderBy("w").collect()]
    assert [tuple(x) for x in s.rows("features").orderBy("ts").select(*stream.FEATURES).collect()] == want


def test_stream_windows_begin_anew(spark, tmp_path):
    from tidemark.streaming import features as stream

    spark.range(10).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("i"), F.col("id").alias("x"), (F.col("id") == 5).alias("new")).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key long, i long, x long, new boolean").parquet(f"{tmp_path}/in")
    got = stream.to_table(stream.count_windows(source, 4, 1, "new"), "append", f"{tmp_path}/c", f"{tmp_path}/o")
    assert sorted((r["w"], r["total"]) for r in got.collect()) == [(0, 6), (0, 26), (1, 10), (1, 30)]


@pytest.mark.parametrize("p95,bits,words,ratio", [(10, 5, 5, 2.5), (0, 1, 28, 14.0), (20000, 16, 1, 0.5)])
def test_compression_by_hand(spark, p95, bits, words, ratio):
    prof = spark.createDataFrame([("s", 100, float(p95))], "series string, n long, p95_abs double")
    r = profile.compression_estimate(prof).first()
    assert (r["bits"], r["per_word"], r["ratio"]) == (bits, words, ratio)


@pytest.mark.parametrize("mv,want", [(2000, 0), (2600, 0), (3000, 22), (4350, 100), (5000, 100)])
def test_battery(spark, mv, want):
    assert spark.range(1).select(scalars.battery_percent(F.lit(mv))).first()[0] == want


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(scalars.chunk_size(F.lit("abc")), scalars.chunk_size(F.lit("64")), scalars.chunk_size(F.lit(None).cast("string"))).first()[:] == (1024, 64, 1024)
    assert one.select(timeparts.duration_text(F.lit(59)), timeparts.duration_text(F.lit(90)), timeparts.duration_text(F.lit(5400))).first()[:] == ("59s", "2m", "1.5h")
    assert one.select(scalars.binary_text(F.lit(33)), scalars.binary_text(F.lit(-2)), resample.to_int16(F.lit(-8.0), 16.0)).first()[:] == ("0b100001", "-0b10", -16383)
    for d in (-65535, -1, 0, 1, 65535):
        code = one.select(scalars.zigzag(F.lit(d)).alias("c"))
        assert code.select(scalars.unzigzag(F.col("c"))).first()[0] == d


def gaussian(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [900, 300, 50, 20, 5] + 7
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("method", ["eigh", "power"])
def test_pca(spark, method):
    x, df = gaussian(spark)
    m = pca.fit(df, "v", 5, 3, method)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(m.variances, values[::-1][:3], rtol=1e-3) and np.allclose(np.abs((m.components * vectors.T[::-1][:3]).sum(1)), 1, atol=1e-3)
    assert np.allclose(m.components @ m.components.T, np.eye(3), atol=0.05) and abs(m.ratio_kept.sum() - 1) < 1e-9 and m.ratio.sum() < 1
    got = np.array([r["pca"] for r in m.transform(df, "v").orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ m.components.T)
    with pytest.raises(ValueError):
        pca.fit(df.limit(1), "v", 5)
    assert (pca.power_iteration(np.array([[1.0, -1.0], [-1.0, 1.0]]))[1] == 0).all()


def test_samples(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    for k in (1, 10, 2000):
        got = sampling.reservoir(df, k, 1).collect()
        assert len(got) == min(k, 1000) == len({r["id"] for r in got}) and all(r["x"] == 2 * r["id"] for r in got)
    r = sampling.Reservoir(3, 1)
    r.add_many([(1, 2), (3, 4)], 2)
    assert len(r) == 2
    with pytest.raises(ValueError):
        r.add_many([(1,)], 2)
    with pytest.raises(ValueError):
        sampling.Reservoir(0)
    seen = np.zeros(20)
    for s in range(2000):
        r = sampling.Reservoir(5, s)
        r.add_many(range(20))
        seen[r.rows] += 1
    assert np.abs(seen / 2000 - 0.25).max() < 0.05
    sizes = {r["split"]: r["count"] for r in sampling.split(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 500, "val": 250, "test": 250}


def test_forest(spark, tmp_path):
    df = ml.noisy_xor(spark)
    rows = df.select("id", F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("v"), F.col("label").cast("double").alias("label"))
    rows = ml.with_vector(rows, "v")
    ml.save(ml.train_forest(rows), f"{tmp_path}/m")
    out = ml.predict(ml.load(spark, f"{tmp_path}/m"), rows)
    assert out.where("prediction = label").count() > 240


def test_segments_split(spark):
    df = spark.range(1000).select(F.col("id").alias("r"), F.col("id").cast("short").alias("x"))
    s = segments.encode_segments(df, ["x"], "compressed", rows=300)
    assert s.count() == 4 and [r["x"] for r in segments.decode_segments(s, ["x"]).orderBy("r").collect()] == list(range(1000))


def test_files(spark, tmp_path):
    told = []
    f = files.Files(spark, str(tmp_path), lambda path, event: told.append((path.split("/")[-1], event)))
    f.put("m/model.csv", b"x" * 2500)
    f.put("m/model.csv", b"y" * 2500)
    assert f.get("m/model.csv") == b"y" * 2500 and [r["name"] for r in files.list_files(spark, f"{tmp_path}/m").where("name not like '.%'").collect()] == ["model.csv"]
    blocks = files.read_files(spark, f"{tmp_path}/m").orderBy("i").collect()
    assert [len(b["data"]) for b in blocks] == [1024, 1024, 452]
    f.delete("m/model.csv")
    assert told == [("model.csv", "put"), ("model.csv", "put"), ("model.csv", "delete")]
    for bad in (lambda: f.get("none"), lambda: f.delete("none"), lambda: f.put("../out", b""), lambda: files.list_files(spark, f"{tmp_path}/none"), lambda: files.safe_path("/b", "")):
        with pytest.raises(ValueError):
            bad()
    assert files.safe_path("/b", "a/../c") == "/b/c"


def test_compact_parquet_is_delta_packed(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    files.write_compact(spark.range(5000).select(F.col("id").cast("short").alias("x")), f"{tmp_path}/c")
    col = pq.ParquetFile(glob.glob(f"{tmp_path}/c/*.parquet")[0]).metadata.row_group(0).column(0)
    assert col.compression == "GZIP" and "DELTA_BINARY_PACKED" in col.encodings


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
