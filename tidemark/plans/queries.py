"""The time-series engine's registered queries over the test tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars, timeparts
from tidemark.operators import asof, ml, pca, profile, resample, sampling, segments, store, windows
from tidemark.plans.registry import Registry, Resource
from tidemark.plans.tables import shared, table, written
from tidemark.sources import files, npy
from tidemark.streaming import features as stream

#: Fixed test ranges, in epoch seconds.
START, END = 1_704_412_800, 1_704_585_600  # 2024-01-05 to 2024-01-07
EVENTS = Resource("events", ("v",), 1_000_000, "hour")
SLOW = Resource("slow", ("v",), 700_000, "date")
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with UTC times and the metric v = floor(50 value) in 64 bits, an error beyond; results that are narrower narrow it themselves."""
    v = F.col("value") * 50
    beyond = F.raise_error(F.concat(F.lit("a metric is beyond 64 bits: "), v.cast("string")))  # floor would cut it, and the cast cuts 2 ** 63
    v = F.when(F.abs("value") < float(1 << 57), F.floor(v)).when(v >= float(1 << 63), beyond).otherwise(v.cast("long"))
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", v.alias("v"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Line items as one dense three-axis series numbered by r."""
    rows = table(spark, d, "lineitem").select(*ORDER, (F.col("l_quantity") * 100).cast("int").alias("x"), F.round(F.col("l_discount") * 10000).cast("int").alias("y"), F.round(F.col("l_tax") * 10000).cast("int").alias("z"))
    return windows.number_rows(rows, ORDER).select("r", "x", "y", "z")


#: The same in SQL.
SAMPLES = """samples AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r,
  CAST(trunc(l_quantity * 100) AS INT) AS x, CAST(round(l_discount * 10000) AS INT) AS y, CAST(round(l_tax * 10000) AS INT) AS z FROM lineitem)"""
E = "ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, CAST(floor(value * 50) AS SMALLINT) AS v FROM events)"


def by_id(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("event_id", *cols)


@query(f"WITH {E} SELECT event_id, us, v FROM ev WHERE us >= {START}000000 AND us < {END}000000")
def timerange_scan(spark, d):
    rows = store.with_partitions(events(spark, d), EVENTS)
    return store.in_range(rows, EVENTS, START, END).select("event_id", F.unix_micros("ts").alias("us"), F.col("v").cast("short").alias("v"))


@query(f"""WITH {E}, p AS (SELECT *, us - us % 86400000000 AS b FROM ev)
SELECT event_id, (us - b) // 700000 AS row_idx FROM p WHERE b BETWEEN ({START}000000 // 86400000000) * 86400000000 AND {END}999999
  AND (us - b) // 700000 >= greatest(0, CAST(floor(({START + 1}000000 - b) / 700000.0) AS BIGINT)) AND (us - b) // 700000 < CAST(floor(({END - 1}000000 - b) / 700000.0) AS BIGINT)""")
def timerange_floor_rows(spark, d):
    """A sample distance that doesn't divide a second: both ends are rounded down to whole rows."""
    rows = store.with_partitions(events(spark, d), SLOW)
    return store.in_range(rows, SLOW, START + 1, END - 1).select("event_id", "row_idx")


@query(f"""WITH {E}, n AS (SELECT event_id, v, us - us % 3600000000 AS b, row_number() OVER (PARTITION BY us - us % 3600000000 ORDER BY us) - 1 AS row_idx FROM ev)
SELECT event_id, row_idx, b + row_idx * 1000000 AS us, v FROM n""")
def timerange_dense_rows(spark, d):
    """Events of one time, which the SQL leaves in any order, are numbered by event_id."""
    return store.dense_rows(events(spark, d), EVENTS, ties=("event_id",)).select("event_id", "row_idx", F.unix_micros("ts").alias("us"), "v")


def _keys(granularity: str):
    def run(spark, d):
        path = timeparts.partition_path(F.unix_micros("ts"), granularity)
        return events(spark, d).groupBy(path.alias("path")).agg(F.count("*").alias("n"), scalars.total(F.col("v")).alias("total"))

    run.__name__ = f"partition_keys_{granularity}"
    form = {"date": "date=%Y-%m-%d", "hour": "date=%Y-%m-%d/hour=%H", "minute": "date=%Y-%m-%d/hour=%H/min=%M"}[granularity]
    query(f"WITH {E} SELECT strftime(ts, '{form}') AS path, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ev GROUP BY 1")(run)


for _g in ("date", "hour", "minute"):
    _keys(_g)


@query(f"""WITH {E} SELECT count(*) > 0 AS has_data, count(DISTINCT us // 3600000000) AS n_partitions, min(us // 3600000000) * 3600 AS start, max(us // 3600000000) * 3600 + 3600 AS "end",
  CAST(1000000 AS BIGINT) AS hop, 'v' AS columns, min(us) AS first_row, max(us) AS last_row FROM ev""")
def partition_info(spark, d):
    out = store.info(store.with_partitions(events(spark, d), EVENTS), EVENTS)
    return out.withColumns({c: F.unix_micros(c) for c in ("first_row", "last_row")})


@query(f"""SELECT strftime(make_timestamp(s * 1000000), 'date=%Y-%m-%d/hour=%H') AS path, s AS start_s, s + 3600 AS end_s FROM (SELECT unnest(range({START}, {END + 1800}, 3600)) AS s)""")
def partition_range_enum(spark, d):
    return store.partitions_in_range(spark, "hour", START + 5, END + 1800)


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, max(date_trunc('day', o_orderdate)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM orders)
WHERE date_trunc('day', o_orderdate) < seen""")
def out_of_order_rows(spark, d):
    return store.late_rows(table(spark, d, "orders"), "o_orderkey", "o_orderdate", "date").select("o_orderkey", "o_custkey")


@query(f"WITH {E}, i AS (SELECT max(us // 3600000000) * 3600000000 + 3600000000 AS e FROM ev) SELECT event_id, v FROM ev, i WHERE us >= e - 7200000000")
def last_2h(spark, d):
    rows = store.with_partitions(events(spark, d), EVENTS)
    end = store.info(rows, EVENTS).first()["end"]
    return store.in_range(rows, EVENTS, end - 7200, end).select("event_id", F.col("v").cast("short").alias("v"))


@query(f"WITH {SAMPLES} SELECT r, 'x' AS series, x AS value FROM samples UNION ALL SELECT r, 'y', y FROM samples UNION ALL SELECT r, 'z', z FROM samples")
def unpivot_series(spark, d):
    return profile.long_form(samples(spark, d), "r", ["x", "y", "z"])


@query("""SELECT event_id, CAST(trunc(least(value, 600) / 600 * 32767) AS SMALLINT) AS scaled, greatest(least(CAST(trunc(value * 100) AS INT), 32767), -32768) AS clipped FROM events WHERE value IS NOT NULL""")
def int16_rescale_clip(spark, d):
    rows = table(spark, d, "events").na.drop(subset=["value"])
    return rows.select("event_id", resample.to_int16(F.least("value", F.lit(600.0)), 600.0).alias("scaled"), resample.clip((F.col("value") * 100).cast("int")).alias("clipped"))


@query("SELECT round(avg(CASE WHEN a <> trunc(greatest(least(a, 32767), -32768)) THEN 1 ELSE 0 END), 9) AS a, round(avg(CASE WHEN q <> trunc(greatest(least(q, 32767), -32768)) THEN 1 ELSE 0 END), 9) AS q FROM (SELECT value * 100 AS a, CAST(l AS DOUBLE) AS q FROM (SELECT value, event_id AS l FROM events))")
def clipped_share(spark, d):
    rows = table(spark, d, "events").select((F.col("value") * 100).alias("a"), F.col("event_id").cast("double").alias("q"))
    out = resample.clipped_share(rows, ["a", "q"])
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"WITH {E} SELECT user_id, us - us % 3600000000 AS bucket, round(avg(value), 6) AS value FROM ev GROUP BY 1, 2")
def resample_mean(spark, d):
    return resample.resample_mean(events(spark, d), "user_id", "ts", ["value"], 3_600_000_000).withColumn("value", F.round("value", 6))


@query(f"""WITH {E}, m AS (SELECT user_id, us - us % 3600000000 AS bucket, round(avg(value), 6) AS value FROM ev GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY user_id, bucket) - 1 AS r FROM m)
SELECT user_id, value, r, r * 40000 AS time_us FROM n""")
def resample_timeline(spark, d):
    return resample.one_timeline(resample_mean(spark, d), "user_id", 40_000).select("user_id", "value", "r", "time_us")


@query(f"WITH {E} SELECT count(*) AS n_groups, CAST(sum(m) AS BIGINT) AS total, max(m) AS longest FROM (SELECT user_id, max(us - 1704067200000000) AS m FROM ev GROUP BY 1)")
def group_duration(spark, d):
    rows = events(spark, d).withColumn("t", F.unix_micros("ts") - 1_704_067_200_000_000)
    return resample.group_duration(rows, "user_id", "t")


FEATURES_SQL = f"""WITH {SAMPLES}, e AS (SELECT s.*, w FROM samples s, LATERAL (SELECT unnest(range(CAST(greatest(0, ceil((r - 99) / 25.0)) AS BIGINT), r // 25 + 1)) AS w)),
s AS (SELECT w, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM e GROUP BY w HAVING count(*) = 100),
m AS (SELECT w, CAST(sum(abs(n * x - sx) + abs(n * y - sy) + abs(n * z - sz)) AS BIGINT) AS moved FROM e JOIN s USING (w) GROUP BY w),
u AS (SELECT *, sx / CAST(n AS DOUBLE) AS mx, sy / CAST(n AS DOUBLE) AS my, sz / CAST(n AS DOUBLE) AS mz FROM s JOIN m USING (w)),
k AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my + mz * mz) = 0 THEN 1.0 ELSE sqrt(mx * mx + my * my + mz * mz) END AS size FROM u)
SELECT w, CAST(trunc(mx / size * 16384) AS INT) AS orient_x, CAST(trunc(my / size * 16384) AS INT) AS orient_y, CAST(trunc(mz / size * 16384) AS INT) AS orient_z,
  CAST(moved // (n * n * 32) AS INT) AS sma, CAST(sx // n AS INT) AS mean_x, CAST(sy // n AS INT) AS mean_y, CAST(sz // n AS INT) AS mean_z FROM k"""


@query(FEATURES_SQL)
def window_features(spark, d):
    return windows.window_features(samples(spark, d))


@query("SELECT count(*) AS n_rows, CASE WHEN count(*) < 100 THEN 0 ELSE (count(*) - 100) // 25 + 1 END AS n_windows FROM lineitem")
def window_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_rows")).select("n_rows", windows.count_windows(F.col("n_rows"), 100, 25).alias("n_windows"))


def _time(name: str, width: int, hop: int):
    def run(spark, d):
        out = windows.time_windows(events(spark, d), "ts", width, hop)
        return out.select(F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "n", F.round("total", 4).alias("total"))

    run.__name__ = name
    query(f"""WITH {E}, w AS (SELECT value, unnest(range(CAST(floor((us - {width}000000) / {hop}000000.0) AS BIGINT) + 1, us // {hop}000000 + 1)) AS w FROM ev)
SELECT w * {hop}000000 AS start_us, w * {hop}000000 + {width}000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY w""")(run)


_time("sliding_time_window", 14_400, 3600)
_time("tumbling_time_window", 3600, 3600)

PROFILE = f"""{SAMPLES}, l AS (SELECT 'x' AS series, x AS value, abs(x - lag(x) OVER (ORDER BY r)) AS delta FROM samples UNION ALL SELECT 'y', y, abs(y - lag(y) OVER (ORDER BY r)) FROM samples UNION ALL SELECT 'z', z, abs(z - lag(z) OVER (ORDER BY r)) FROM samples),
p AS (SELECT series, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(delta), 6) AS mean_abs, quantile_cont(delta, 0.5) AS median_abs, max(delta) AS max_abs, quantile_cont(delta, 0.95) AS p95_abs FROM l GROUP BY series)"""
ESTIMATE = f"""{PROFILE}, c AS (SELECT series, n, length(bin(greatest(1, CAST(trunc(2 * p95_abs) AS BIGINT)))) AS bits FROM p), q AS (SELECT *, greatest(1, 28 // bits) AS per_word FROM c)"""


@query(f"WITH {PROFILE} SELECT series, n, min, max, mean_abs, CAST(median_abs AS DOUBLE) AS median_abs, max_abs, CAST(p95_abs AS DOUBLE) AS p95_abs FROM p")
def delta_profile(spark, d):
    return profile.delta_profile(samples(spark, d), "r", ["x", "y", "z"]).withColumn("mean_abs", F.round("mean_abs", 6))


@query(f"WITH {ESTIMATE} SELECT series, n, CAST(bits AS INT) AS bits, CAST(per_word AS INT) AS per_word, round(32.0 / per_word, 6)::DOUBLE AS bits_stored, round(16.0 / (32.0 / per_word), 6)::DOUBLE AS ratio, round(n * (32.0 / per_word) / 8, 3)::DOUBLE AS bytes FROM q")
def compression_estimate(spark, d):
    out = profile.compression_estimate(profile.delta_profile(samples(spark, d), "r", ["x", "y", "z"]))
    return out.select("series", "n", "bits", "per_word", F.round("bits_stored", 6).alias("bits_stored"), F.round("ratio", 6).alias("ratio"), F.round("bytes", 3).alias("bytes"))


@query(f"""WITH {ESTIMATE}, t AS (SELECT CAST(sum(n) * 2 AS DOUBLE) AS raw_bytes, CAST(sum(n * (32.0 / per_word) / 8) AS DOUBLE) AS packed_bytes FROM q)
SELECT raw_bytes, round(packed_bytes, 3) AS packed_bytes, round(raw_bytes / packed_bytes, 6) AS ratio, CASE WHEN raw_bytes / packed_bytes > 1.5 THEN 'good' WHEN raw_bytes / packed_bytes > 0.9 THEN 'marginal' ELSE 'worse' END AS verdict FROM t""")
def compression_totals(spark, d):
    out = profile.recommendation(profile.compression_estimate(profile.delta_profile(samples(spark, d), "r", ["x", "y", "z"])))
    return out.select("raw_bytes", F.round("packed_bytes", 3).alias("packed_bytes"), F.round("ratio", 6).alias("ratio"), "verdict")


ZIGZAG = f"""{E}, z AS (SELECT event_id AS r, CAST(v AS INT) AS value, coalesce(CAST(v AS INT) - lag(CAST(v AS INT)) OVER (ORDER BY event_id), 0) AS delta FROM ev)"""


@query(f"WITH {ZIGZAG} SELECT r, value, delta, xor(CAST(delta * 2 AS INT), CASE WHEN delta < 0 THEN -1 ELSE 0 END) & 131071 AS code FROM z")
def zigzag_delta(spark, d):
    return profile.zigzag_deltas(events(spark, d).withColumnRenamed("event_id", "r"), "r", "v")


@query(f"WITH {ZIGZAG} SELECT r, value FROM z")
def delta_decode_roundtrip(spark, d):
    """Differences of the values that there are; events without one have no code and stay without."""
    rows = events(spark, d).select(F.col("event_id").alias("r"), "v")
    coded = profile.zigzag_deltas(rows.where("v IS NOT NULL"), "r", "v", "long")
    first = coded.orderBy("r").first()
    back = coded.select("r", scalars.unzigzag(F.col("code")).alias("delta"))
    return profile.undo_deltas(back, "r", first["value"] if first else 0).unionByName(rows.where("v IS NULL").withColumnRenamed("v", "value"))


COV = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in COV) + " FROM lineitem")
def column_means(spark, d):
    return pca.column_means(table(spark, d, "lineitem"), COV).select(*(F.round(c, 6).alias(c) for c in COV))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for a in COV for b in COV))
def covariance_matrix(spark, d):
    return pca.covariance(table(spark, d, "lineitem"), COV).select("a", "b", (F.round("cov", 4) + 0.0).alias("cov"))


@query("WITH m AS (SELECT avg(value) AS m FROM events) SELECT event_id, round(value - m, 6) + 0.0 AS value FROM events, m")
def centred(spark, d):
    rows = pca.centred(table(spark, d, "events").select("event_id", "value"), ["value"])
    return rows.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@query()
def pca_fit(spark, d):
    m = pca.fit(table(spark, d, "embeddings"), "embedding", 64, 4)
    rows = [(i, float(v), float(a), float(b), [float(x) for x in c]) for i, (v, a, b, c) in enumerate(zip(m.variances, m.ratio, m.ratio_kept, m.components, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, ratio_kept double, direction array<double>")


@query()
def pca_transform(spark, d):
    rows = table(spark, d, "embeddings")
    return pca.fit(rows, "embedding", 64, 2).transform(rows, "embedding").select("vec_id", "label", "pca")


@query("SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100")
def sample_hash_k(spark, d):
    return sampling.sample_by_hash(table(spark, d, "events"), "event_id", 100).select("event_id", "value")


@query()
def reservoir_k(spark, d):
    return sampling.reservoir(table(spark, d, "events").select("event_id", "value"), 100, seed=5)


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p, count(*) OVER () AS c FROM documents)
SELECT doc_id, CASE WHEN p < floor(c * 0.25) THEN 'test' WHEN p < floor(c * 0.25) * 2 THEN 'val' ELSE 'train' END AS split FROM n""")
def split_train_val_test(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def _codec(name: str, codec: str):
    def run(spark, d):
        return segments.decode_segments(segments.encode_segments(samples(spark, d), ["x", "y", "z"], codec), ["x", "y", "z"])

    run.__name__ = name
    query(f"WITH {SAMPLES} SELECT r, x, y, z FROM samples")(run)


for _n, _c in (("codec_roundtrip_ds9", "compressed"), ("codec_roundtrip_raw", "raw"), ("codec_roundtrip_raw_col", "raw_col"), ("npy_roundtrip", "npy")):
    _codec(_n, _c)


@query(f"WITH {E} SELECT event_id, mv, CASE WHEN mv <= 2600 THEN 0 WHEN mv >= 4350 THEN 100 ELSE (mv - 2600) * 100 // 1750 END AS percent FROM (SELECT event_id, ((v // 256) & 63) * 256 + v % 256 AS mv FROM (SELECT event_id, CAST(v AS INT) AS v FROM ev))")
def battery_percent(spark, d):
    v = F.col("v").cast("int")
    mv = scalars.battery_mv(F.shiftright(v, 8), v.bitwiseAND(F.lit(255)))
    return events(spark, d).select("event_id", mv.alias("mv")).select("event_id", "mv", scalars.battery_percent(F.col("mv")).alias("percent"))


@query("""WITH e AS (SELECT event_id, event_id * 7 % 9001 AS s, event_id * event_id * 3 AS b FROM events),
t AS (SELECT *, (s * 10 + 1800) // 3600 AS h, (b * 10 + 512) // 1024 AS kb, (b * 10 + 524288) // 1048576 AS mb FROM e)
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s + 30) // 60 || 'm' ELSE h // 10 || '.' || h % 10 || 'h' END AS duration,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN kb // 10 || '.' || kb % 10 || ' KB' ELSE mb // 10 || '.' || mb % 10 || ' MB' END AS size FROM t""")
def fmt_duration(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 9001).alias("s"), (F.col("event_id") * F.col("event_id") * 3).alias("b"))
    return rows.select("event_id", timeparts.duration_text(F.col("s")).alias("duration"), timeparts.bytes_text(F.col("b")).alias("size"))


@query("""SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, epoch_us(ts) // 1000000 AS epoch, strftime(ts, '%Y-%m-%dT%H:%M') AS form FROM events""")
def calendar_parts(spark, d):
    p = timeparts.parts(F.col("ts"))
    rows = events(spark, d).select("event_id", *(c.alias(n) for n, c in p.items()), timeparts.local_minute(F.col("ts")).alias("form"))
    return rows.withColumn("epoch", timeparts.from_parts(*(F.col(n) for n in p)))


@query("SELECT event_id, event_id * event_id AS squared, event_id * event_id * event_id AS cubed, event_id % 2 = 0 AS is_even, '0b' || bin(event_id) AS binary_text, (event_id | 8) & ~CAST(1 AS BIGINT) AS bits FROM events")
def scalar_demo(spark, d):
    scalars.register(spark)
    rows = table(spark, d, "events").select("event_id", F.expr("square(event_id)").alias("squared"), F.expr("cube_of(event_id)").alias("cubed"), F.expr("is_even(event_id)").alias("is_even"), scalars.binary_text(F.col("event_id")).alias("binary_text"), scalars.clear_bit(scalars.set_bit(F.col("event_id"), 3), 0).alias("bits"))
    return rows


@query("""WITH o AS (SELECT user_id, ts, event_type, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, event_type, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def class_durations(spark, d):
    return ml.class_durations(events(spark, d), "user_id", "ts", "event_type").withColumns({c: F.unix_micros(c) for c in ("first", "last")})


@query(f"WITH {E}, c AS (SELECT us - us % 86400000000 AS bucket, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT bucket, event_type, n, round(n / sum(n) OVER (PARTITION BY bucket), 9) AS share FROM c")
def class_shares(spark, d):
    out = ml.class_shares(events(spark, d), timeparts.partition_start_us(F.unix_micros("ts"), "date"), "event_type")
    return out.withColumn("share", F.round("share", 9))


@query()
def forest_predict(spark, d):
    rows = ml.with_vector(sampling.split(table(spark, d, "embeddings"), "vec_id"), "embedding")
    rows = written(rows.select("vec_id", "label", "split", F.col("embedding").alias("e")))
    rows = ml.with_vector(rows, "e")
    model = ml.train_forest(rows.where("split = 'train'"))
    return ml.predict(model, rows).select("vec_id", "label", "split", "prediction", "probability")


@query()
def kmeans_clusters(spark, d):
    return ml.clusters(ml.with_vector(table(spark, d, "embeddings"), "embedding"), 8).select("vec_id", "label", "cluster")


@query(f"WITH {E} SELECT event_id % 7 AS k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ev WHERE us >= {START}000000 AND us < {END}000000 GROUP BY 1")
def store_append_query(spark, d):
    """Events appended to a partitioned table, then read back by a pruned range query."""
    registry = Registry()
    registry.add(Resource("events", ("high", "low", "k"), 1_000_000, "date"))
    s = store.Store(spark, shared(spark, "store"), registry)
    high, low = scalars.words(F.col("v"))
    s.append("events", events(spark, d).select("ts", high.alias("high"), low.alias("low"), (F.col("event_id") % 7).cast("short").alias("k")))
    v = scalars.of_words(F.col("high"), F.col("low"))
    return s.query("events", START, END).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum(v).alias("total"))


@query(f"""WITH {E}, p AS (SELECT us, us >= {START + 1800}000000 AND us < {END - 1800}000000 AS taken FROM ev WHERE us // 86400000000 BETWEEN {START // 86400} AND {(END - 1801) // 86400})
SELECT count(DISTINCT us // 86400000000) AS partitions, count(*) FILTER (WHERE taken) AS rows_read, count(*) FILTER (WHERE NOT taken) AS rows_skipped, 2 * count(*) FILTER (WHERE taken) AS bytes FROM p""")
def store_query_counters(spark, d):
    """What a range query on the store counted while it ran, its times left out."""
    registry = Registry()
    registry.add(Resource("events", ("high", "low"), 1_000_000, "date"))
    s = store.Store(spark, shared(spark, "store"), registry)
    high, low = scalars.words(F.col("v"))
    s.append("events", events(spark, d).select("ts", high.alias("high"), low.alias("low")))
    rows, counts = s.counted("events", START + 1800, END - 1800, ["low"])
    rows.write.format("noop").mode("overwrite").save()
    got = counts()
    names = ["partitions", "rows_read", "rows_skipped", "bytes"]
    return spark.createDataFrame([tuple(got[c] for c in names)], ", ".join(f"{c} long" for c in names))


def _event_stream(spark: SparkSession, d: str, by_id: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """The events table, or its columns `only`, as a stream of files in a folder of its own, written in the order of time, or of event_id: files stream by age."""
    path = shared(spark, "events_stream")
    rows = events(spark, d)
    part = F.coalesce(F.floor(F.dayofmonth("ts") / 8), F.lit(3))  # null is last
    if by_id:
        low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
        part = F.least(F.floor((F.col("event_id") - (low or 0)) / ((high or 0) - (low or 0) + 1) * 4), F.lit(3))  # rises with the id; null is last
    own = rows.select(*only) if only else rows
    for n in range(4):
        rows.where(part == n).select(*own.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""WITH {E}, w AS (SELECT value, unnest(range((us - 14400000000) // 3600000000 + 1, us // 3600000000 + 1)) AS w FROM ev)
SELECT w * 3600000000 AS start_us, w * 3600000000 + 14400000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY w""")
def stream_time_windows(spark, d):
    out = stream.time_totals(_event_stream(spark, d, only=("ts", "value")), "4 hours", "1 hour", "1 day")
    got = stream.to_table(out, "complete", shared(spark, "stream_state"), shared(spark, "stream_out"))
    return got.select(F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH {E}, k AS (SELECT user_id % 8 AS key, CAST(v AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS i FROM ev),
s AS (SELECT key, i, sum(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS total FROM k)
SELECT key, (i - 19) // 5 AS w, CAST(total AS BIGINT) AS total FROM s WHERE i >= 19 AND (i - 19) % 5 = 0""")
def stream_count_windows(spark, d):
    source = _event_stream(spark, d, by_id=True).select((F.col("user_id") % 8).alias("key"), F.col("event_id").alias("i"), F.col("v").cast("long").alias("x"))
    out = stream.to_table(stream.count_windows(source, 20, 5), "append", shared(spark, "stream_state"), shared(spark, "stream_out"))
    return out.select("key", "w", "total")


STREAM_FEATURES_SQL = f"""WITH {E}, k AS (SELECT user_id % 8 AS key, CAST(v AS BIGINT) AS x, event_id % 100 AS y, 50 AS z, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS r FROM ev),
e AS (SELECT k.*, w FROM k, LATERAL (SELECT unnest(range(CAST(greatest(0, ceil((r - 19) / 5.0)) AS BIGINT), r // 5 + 1)) AS w)),
s AS (SELECT key, w, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM e GROUP BY key, w HAVING count(*) = 20),
m AS (SELECT key, w, CAST(sum(abs(n * x - sx) + abs(n * y - sy) + abs(n * z - sz)) AS BIGINT) AS moved FROM e JOIN s USING (key, w) GROUP BY key, w),
u AS (SELECT *, sx / CAST(n AS DOUBLE) AS mx, sy / CAST(n AS DOUBLE) AS my, sz / CAST(n AS DOUBLE) AS mz FROM s JOIN m USING (key, w)),
g AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my + mz * mz) = 0 THEN 1.0 ELSE sqrt(mx * mx + my * my + mz * mz) END AS size FROM u)
SELECT key, w, CAST(trunc(mx / size * 16384) AS INT) AS orient_x, CAST(trunc(my / size * 16384) AS INT) AS orient_y, CAST(trunc(mz / size * 16384) AS INT) AS orient_z,
  CAST(moved // (n * n * 32) AS INT) AS sma, CAST(trunc(mx) AS INT) AS mean_x, CAST(trunc(my) AS INT) AS mean_y, CAST(trunc(mz) AS INT) AS mean_z FROM g"""


@query(STREAM_FEATURES_SQL)
def stream_count_features(spark, d):
    """The seven features of count windows over the event stream, eight devices apart."""
    events_ = _event_stream(spark, d, by_id=True)
    source = _axes(events_, "user_id", "event_id").select((F.col("user_id") % 8).alias("key"), "ts", F.col("event_id").alias("i"), F.col("x").cast("int").alias("x"), "y", "z")
    out = stream.to_table(stream.count_features(source, 20, 5), "append", shared(spark, "stream_state"), shared(spark, "stream_out"))
    return out.drop("ts", "batch")


@query(f"WITH {E} SELECT 2 * count(*) AS n, CAST(2 * sum(v) AS BIGINT) AS total, CAST(2 * sum(event_id % 100) AS BIGINT) AS others FROM ev")
def samples_append_roundtrip(spark, d):
    """Chunk files written, overwritten and appended to, then three of four columns read back."""
    npy.register(spark)
    path = shared(spark, "samples")
    high, low = scalars.words(F.col("v"))
    rows = events(spark, d).select(high.alias("high"), low.alias("low"), F.lit(1).cast("short").alias("k"), (F.col("event_id") % 100).cast("short").alias("w"))
    for mode in ("append", "overwrite", "append"):
        rows.write.format("samples").mode(mode).save(path)
    back = spark.read.format("samples").option("columns", "high,low,k,w").option("select", "w,low,high").load(path)
    return back.agg(F.count("*").alias("n"), F.sum(scalars.of_words(F.col("high"), F.col("low"))).alias("total"), F.sum("w").alias("others"))


def _axes(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "ts", F.col("v").alias("x"), F.pmod("event_id", F.lit(100)).cast("int").alias("y"), F.lit(50).alias("z"))


@query(f"""WITH {E}, e AS (SELECT CAST(v AS BIGINT) AS x, event_id % 100 AS y, 50 AS z, unnest(range((us - 14400000000) // 3600000000 + 1, us // 3600000000 + 1)) AS w FROM ev),
s AS (SELECT w, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM e GROUP BY w),
m AS (SELECT w, CAST(sum(abs(n * x - sx) + abs(n * y - sy) + abs(n * z - sz)) AS BIGINT) AS moved FROM e JOIN s USING (w) GROUP BY w),
u AS (SELECT *, sx / CAST(n AS DOUBLE) AS mx, sy / CAST(n AS DOUBLE) AS my, sz / CAST(n AS DOUBLE) AS mz FROM s JOIN m USING (w)),
g AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my + mz * mz) = 0 THEN 1.0 ELSE sqrt(mx * mx + my * my + mz * mz) END AS size FROM u),
t AS (SELECT (max(us) // 1000) * 1000 - 86400000000 AS closed FROM ev)
SELECT w * 3600000000 AS start_us, w * 3600000000 + 14400000000 AS end_us, n, CAST(trunc(mx / size * 16384) AS INT) AS orient_x, CAST(trunc(my / size * 16384) AS INT) AS orient_y,
  CAST(trunc(mz / size * 16384) AS INT) AS orient_z, CAST(moved // (n * n * 32) AS INT) AS sma, CAST(trunc(mx) AS INT) AS mean_x, CAST(trunc(my) AS INT) AS mean_y, CAST(trunc(mz) AS INT) AS mean_z
FROM g, t WHERE w * 3600000000 + 14400000000 <= closed""")
def stream_features(spark, d):
    """Feature windows of the event stream; windows still open at its end are not given."""
    out = stream.time_features(_axes(_event_stream(spark, d)), "4 hours", "1 hour", delay="1 day")
    got = stream.to_table(out, "append", shared(spark, "stream_state"), shared(spark, "stream_out"))
    return got.select(F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), *(c for c in out.columns if c not in ("window_start", "window_end")))


@query()
def stream_reservoir(spark, d):
    source = _event_stream(spark, d, only=("user_id", "event_id")).select((F.col("user_id") % 4).alias("key"), F.col("event_id").alias("x"))
    got = stream.to_table(stream.reservoirs(source, 10, seed=2), "update", shared(spark, "stream_state"), shared(spark, "stream_out"))
    return got.withColumn("top", F.max("seen").over(Window.partitionBy("key"))).where("seen = top").select("key", "seen", "x")


@query(f"WITH {E} SELECT count(*) AS rows_read, count(DISTINCT us // 3600000000) AS partitions, 2 * count(*) AS bytes FROM ev WHERE us >= {START}000000 AND us < {END}000000")
def query_counters(spark, d):
    """What a range query read: rows, partitions and the bytes of its int16 column."""
    rows = store.in_range(store.with_partitions(events(spark, d), EVENTS), EVENTS, START, END)
    return rows.agg(F.count("*").alias("rows_read"), F.countDistinct("date", "hour").alias("partitions"), (F.count("v") * 2).alias("bytes"))


@query("""SELECT l.event_id, l.user_id, coalesce(r.event_id, -1) AS asof_event_id, coalesce(r.value, -1.0) AS asof_value FROM (SELECT * FROM events WHERE event_id % 2 = 0) l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark, d):
    """Two tables on one time axis: each even event with its user's newest odd one."""
    rows = events(spark, d).select("event_id", "user_id", "ts", "value")
    out = asof.asof_join(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts", ["event_id", "value"])
    return out.select("event_id", "user_id", F.coalesce("asof_event_id", F.lit(-1)).alias("asof_event_id"), F.coalesce("asof_value", F.lit(-1.0)).alias("asof_value"))


@query(f"WITH {SAMPLES} SELECT r, CAST(x AS SMALLINT) AS x, CAST(y AS SMALLINT) AS y, CAST(z AS SMALLINT) AS z FROM samples")
def compact_parquet_roundtrip(spark, d):
    path = shared(spark, "compact")
    files.write_compact(samples(spark, d).select("r", *(F.col(c).cast("short").alias(c) for c in "xyz")), path)
    return spark.read.parquet(path)


@query()
def file_listing(spark, d):
    return files.list_files(spark, d)
