"""Queries for sources, sinks and streams; files are written to a new folder next to the checkpoints."""
import uuid

from pyspark.sql import functions as F

from bermline.functions import crs
from bermline.plans import views as V
from bermline.plans.registry import query, rounded
from bermline.session import ensure_checkpoint_dir
from bermline.sources import features as S
from bermline.sources import lidar as LI
from bermline.sources import scenes as SC
from bermline.streaming import streams as ST

N = lambda: F.count(F.lit(1)).alias("n")


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/q-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


@query("s1_read_features", """SELECT line_id, CAST(ax AS DOUBLE) AS xmin, CAST(ay AS DOUBLE) AS ymin, CAST(cx AS DOUBLE) AS xmax, CAST(cy AS DOUBLE) AS ymax, 1::BIGINT AS n_parts FROM lines
 WHERE cx >= 300 AND ax <= 2000 AND cy >= 250 AND ay <= 1200""")
def s1(spark, d):
    p = scratch(spark)
    ln = V.lines(spark, d)
    S.write_features(ln.filter("size <= 25").selectExpr("line_id", "kind", "array(pts) AS parts"), f"{p}/a", 2180)
    S.write_features(ln.filter("size > 25").selectExpr("line_id", "size", "array(pts) AS parts"), f"{p}/b", 2180)
    f = S.read_features(spark, [f"{p}/a", f"{p}/b"], (300.0, 250.0, 2000.0, 1200.0))
    return f.select("line_id", "xmin", "ymin", "xmax", "ymax", F.size("parts").cast("long").alias("n_parts"))


def _s2_sql() -> str:
    """Coordinates in 3035 of points given in 2180, step by step: inverse transverse Mercator, authalic latitude, azimuthal forward."""
    tm, la = crs.PROJECTIONS[2180], crs.PROJECTIONS[3035]
    series = lambda c, f, g="": " - ".join(f"{v!r} * {f}({2 * j} * xi)" + (f" * {g}({2 * j} * eta)" if g else "") for j, v in enumerate(c, 1))
    delta = " + ".join(f"{v!r} * sin({2 * j} * chi)" for j, v in enumerate(crs._DELTA, 1))
    q = lambda s: f"((1 - {crs.E2!r}) * ({s} / (1 - {crs.E2!r} * {s} * {s}) - ln((1 - {crs.E!r} * {s}) / (1 + {crs.E!r} * {s})) / {2 * crs.E!r}))"
    return f"""WITH a AS (SELECT line_id, (ay + 400000 - ({tm.fn})) / {tm.k0 * crs._KR!r} AS xi, (ax + 500000 - {tm.fe}) / {tm.k0 * crs._KR!r} AS eta FROM lines),
 b AS (SELECT line_id, xi - {series(crs._BETA, "sin", "cosh")} AS xp, eta - {series(crs._BETA, "cos", "sinh")} AS ep FROM a),
 c AS (SELECT line_id, asin(sin(xp) / cosh(ep)) AS chi, atan2(sinh(ep), cos(xp)) + radians({tm.lon0 - la.lon0}) AS lam FROM b),
 d AS (SELECT line_id, sin(chi + {delta}) AS s, lam FROM c),
 k AS (SELECT {q("1.0")} AS qp, {q(f"sin(radians({la.lat0}))")} AS q0, sin(radians({la.lat0})) AS s0),
 e AS (SELECT line_id, lam, asin({q("s")} / qp) AS beta, asin(q0 / qp) AS b0, {crs.A} * sqrt(qp / 2) AS rq, {crs.A} * sqrt(1 - s0 * s0) / sqrt(1 - {crs.E2!r} * s0 * s0) AS m0 FROM d, k),
 f AS (SELECT *, m0 / (rq * cos(b0)) AS dd, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(lam))) AS bb FROM e)
SELECT line_id, 3035 AS epsg, round({la.fe} + bb * dd * cos(beta) * sin(lam), 3) AS x, round({la.fn} + bb / dd * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(lam)), 3) AS y FROM f"""


@query("s2_write_features", _s2_sql())
def s2(spark, d):
    """Written in one system, read in another: coordinates of the first vertex."""
    p = scratch(spark)
    q = F.transform("pts", lambda v: F.struct((v["x"] + 500000).alias("x"), (v["y"] + 400000).alias("y")))
    S.write_features(V.lines(spark, d).select("line_id", F.array(q).alias("parts")), p, 2180)
    f = S.read_features(spark, p, epsg=3035)
    return f.select("line_id", "epsg", F.round(F.col("parts")[0][0]["x"], 3).alias("x"), F.round(F.col("parts")[0][0]["y"], 3).alias("y"))


@query("s3_read_patch_metadata", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS region, printf('pos_%07d', o_orderkey) AS patch_id, 'positive' AS patch_type, o_totalprice AS uparea, o_orderkey AS comid FROM orders""")
def s3(spark, d):
    p = scratch(spark)
    o = V.table(spark, d, "orders").selectExpr(
        "format_string('pos_%07d', o_orderkey) AS patch_id", "'positive' AS patch_type", "CAST(NULL AS STRING) AS category", "1.5D AS center_x", "2.5D AS center_y", "o_custkey AS source_idx",
        "o_totalprice AS uparea", "o_orderkey AS comid", "CAST(NULL AS BIGINT) AS basin_id", "7 AS n_label_px", "'x.npz' AS npz_path")
    for r, k in (("a", 0), ("b", 1)):
        o.filter(F.col("comid") % 2 == k).write.csv(f"{p}/{r}", header=True)
    return S.read_patch_metadata(spark, {r: f"{p}/{r}" for r in "ab"}).select("region", "patch_id", "patch_type", "uparea", "comid")


def channel_patches(spark, d):
    return V.patches(spark, d).selectExpr("patch_id", "region", "map('dsm', value, 'canopy_height', prob) AS channels", "label")


@query("s4_read_patches_npz", """SELECT m.patch_id, 8 AS n, CAST(sum(truth) AS BIGINT) AS n_label, round(sum(value::FLOAT::DOUBLE), 4) AS dsm_sum FROM pixels p JOIN patch_meta m ON p.raster_id = m.vec_id GROUP BY 1""")
def s4(spark, d):
    p = scratch(spark)
    S.write_patches_npz(channel_patches(spark, d), local(p)).count()
    q = S.read_patches_npz(spark, p)
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return q.select("patch_id", "n", s("label").cast("long").alias("n_label"), F.round(s(F.col("channels")["dsm"]), 4).alias("dsm_sum"))


@query("s5_write_patches", "SELECT region, split, count(*) AS n FROM (SELECT region, CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM patch_meta) GROUP BY 1, 2")
def s5(spark, d):
    p = scratch(spark)
    S.write_patches(channel_patches(spark, d).withColumn("split", F.expr("CASE WHEN CAST(substr(patch_id, 3) AS BIGINT) % 4 = 0 THEN 'val' ELSE 'train' END")), p)
    return spark.read.parquet(p).groupBy("region", "split").agg(N())


@query("s7_write_raster", "SELECT count(*) AS n, count(value) AS n_valid, CAST(max(row) AS BIGINT) AS max_row, 10.0::DOUBLE AS res, 'value' AS bands FROM mosaic")
def s7(spark, d):
    p = scratch(spark)
    m = V.mosaic(spark, d)
    S.write_raster(m, p, {"x0": 0.0, "y0": 100.0, "res": 10.0, "epsg": 2180}, -9999.0)
    px, meta = S.read_raster(spark, p)
    return px.agg(N(), F.count("value").alias("n_valid"), F.max("row").alias("max_row")).crossJoin(meta.select("res", F.array_join("bands", ",").alias("bands")))  # one row each


def granules(spark, d):
    return V.table(spark, d, "events").selectExpr(
        "concat('g', user_id % 3) AS granule", "concat('gt', user_id % 6) AS beam", "event_id AS seg", "user_id / 10.0D AS lat", "value / 100 AS lon", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS delta_time",
        "CASE WHEN event_id % 10 = 0 THEN 3.4e38D ELSE value END AS h_te_median", "CASE WHEN event_id % 4 = 0 THEN 3.4e38D ELSE (event_id % 7) / 2.0D END AS h_te_uncertainty",
        "CAST(15 + event_id % 20 AS DOUBLE) AS n_te_photons", "1.0D AS snr", "1.0D AS night_flag", "0.0D AS layer_flag", "CAST(event_id % 3 AS DOUBLE) AS cloud_flag_atm", "0.0D AS msw_flag",
        "CASE WHEN event_id % 11 = 0 THEN 1.0D ELSE 0.0D END AS sat_flag", "0.0D AS terrain_flg", "value AS dem_h",
        "CASE WHEN event_id % 5 <> 0 THEN transform(sequence(0, 4), j -> struct(user_id / 10.0D + j * 0.01D AS lat, value / 100 AS lon, CASE WHEN (event_id + j) % 6 = 0 THEN 3.4e38D ELSE value + j END AS h)) END AS sub20m")


_GRAN = """(SELECT event_id AS seg, 'g' || (user_id % 3) AS granule, CASE WHEN event_id % 5 <> 0 THEN '20m' ELSE '100m' END AS res, CASE WHEN event_id % 5 <> 0 THEN value + j ELSE value END AS h, epoch_us(ts) / 1e6 + 0.0028 * j AS t
 FROM events, range(5) r(j) WHERE (event_id % 4 = 0 OR (event_id % 7) / 2.0 <= 2.5) AND 15 + event_id % 20 >= 20 AND event_id % 3 <= 1 AND event_id % 11 <> 0
 AND CASE WHEN event_id % 5 <> 0 THEN (event_id + j) % 6 <> 0 ELSE j = 0 AND event_id % 10 <> 0 END)"""


@query("s8_flatten_granules", f"SELECT seg, granule, res, round(h, 6) AS h, round(t, 3) AS t FROM {_GRAN}")
def s8(spark, d):
    f = LI.flatten_granules(granules(spark, d))
    return rounded(f.select("seg", "granule", "res", F.col("h_te_ellipsoid").alias("h"), F.round("delta_time", 3).alias("t")))


def scene_files(spark, d):
    return V.table(spark, d, "orders").selectExpr(
        "concat('/data/', CASE o_custkey % 2 WHEN 0 THEN 'asc' ELSE 'desc' END, '/', o_custkey % 40, '/S1A_', date_format(o_orderdate, 'yyyyMMdd'), 'T050000_', CASE o_orderkey % 2 WHEN 0 THEN 'VV' ELSE 'VH' END, "
        "CASE WHEN o_custkey % 40 < 10 THEN CASE o_orderkey % 3 WHEN 0 THEN '_sigma0-elp.tif' ELSE '_gamma0-elp.tif' END WHEN o_custkey % 40 < 20 THEN CASE o_orderkey % 3 WHEN 0 THEN '_gamma0-elp.tif' ELSE '_grd_elp.tif' END "
        "WHEN o_custkey % 40 < 30 THEN '_x.tif' ELSE '.txt' END) AS path", "o_orderkey AS length", "CASE o_custkey % 2 WHEN 0 THEN 'asc' ELSE 'desc' END AS orbit")


_SC = """(SELECT o_orderkey AS length, o_custkey % 40 AS f, o_custkey % 2 AS o, strftime(o_orderdate, '%Y%m%d') AS day, CASE WHEN o_custkey % 40 < 10 THEN CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 2 END WHEN o_custkey % 40 < 20 THEN CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 3 END ELSE 4 END AS rank
 FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 40 < 30)"""
_BEST = f"(SELECT s.* FROM {_SC} s JOIN (SELECT f, min(rank) AS b FROM {_SC} GROUP BY 1) m ON s.f = m.f AND s.rank = m.b)"


@query("s9_list_scenes", f"SELECT length, CAST(rank AS BIGINT) AS rank FROM {_BEST}")
def s9(spark, d):
    return SC.list_scenes(scene_files(spark, d).select("path", "length"), "VV").select("length", F.col("rank").cast("long").alias("rank"))


@query("s10_scene_inventory", f"SELECT CASE o WHEN 0 THEN 'asc' ELSE 'desc' END AS orbit, count(*) AS n_scenes, min(day) AS date_min, max(day) AS date_max, count(DISTINCT day) AS n_unique_dates FROM {_BEST} GROUP BY 1")
def s10(spark, d):
    s = SC.list_scenes(scene_files(spark, d), "VV")
    return SC.scene_inventory(s, ("orbit",))


@query("s11_pending", "SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= 0.99 * o_totalprice)")
def s11(spark, d):
    m = V.table(spark, d, "orders").selectExpr("o_orderkey AS name", "o_totalprice AS size")
    e = V.table(spark, d, "lineitem").selectExpr("l_orderkey AS name", "l_extendedprice AS size")
    return SC.pending(m, e).select("name")


# ---- streams ------------------------------------------------------------------------------------

@query("t1_stream_granules", f"SELECT granule, res, count(*) AS n, round(sum(h), 2) AS h FROM {_GRAN} GROUP BY 1, 2")
def t1(spark, d):
    """Two arrivals of granule files, two runs of the ingest, every file once."""
    p = scratch(spark)
    g = granules(spark, d)
    for k in (0, 1):
        g.filter(F.col("seg") % 2 == k).write.mode("append").parquet(f"{p}/in")
        ST.ingest_granules(spark, f"{p}/in", f"{p}/out", f"{p}/ck")
    o = spark.read.parquet(f"{p}/out")
    return o.groupBy("granule", "res").agg(N(), F.round(F.sum("h_te_ellipsoid"), 2).alias("h"))


def event_arrivals(spark, d, p, parts=3):
    """Events written part by part in order of time; after each part the stream that reads all that is new."""
    e = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("run"), "value")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / parts
    for k in range(parts):
        part = e.filter((F.col("ts") >= F.lit(lo + step * k)) & ((F.col("ts") < F.lit(lo + step * (k + 1))) if k < parts - 1 else F.lit(True)))
        part.write.mode("append").parquet(f"{p}/in")
        yield spark.readStream.schema(e.schema).parquet(f"{p}/in")


@query("t2_stream_moments", "SELECT event_type AS run, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def t2(spark, d):
    p = scratch(spark)
    for arrived in event_arrivals(spark, d, p):
        ST.run_updates(ST.stream_moments(arrived, ["run"], "value"), f"{p}/out", f"{p}/ck")
    return rounded(ST.latest_updates(spark, f"{p}/out", ["run"]))


@query("t3_stream_hourly", """WITH h AS (SELECT event_type AS run, date_trunc('hour', ts) AS h, sum(value) / 1000 AS v FROM events GROUP BY 1, 2) SELECT run, CAST(epoch_us(h) // 3600000000 AS BIGINT) AS hour, round(v, 6) AS volume_mil_m3 FROM h
 WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def t3(spark, d):
    """Closed hours only: the last hours stay open until the watermark passes them."""
    p = scratch(spark)
    for arrived in event_arrivals(spark, d, p):
        h = ST.hourly_volumes(arrived)
        q = h.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    o = spark.read.parquet(f"{p}/out")
    return rounded(o.select("run", F.floor(F.unix_micros("hour_start") / 3600000000).alias("hour"), "volume_mil_m3"))


@query("t3_stream_steadiness", """WITH h AS (SELECT event_type AS run, date_trunc('hour', ts) AS h, sum(value) / 1000 AS v, max(value) AS z FROM events GROUP BY 1, 2),
 l AS (SELECT *, (v - lag(v) OVER (PARTITION BY run ORDER BY h)) * 1e6 / 3600.0 AS dv FROM h), q AS (SELECT event_type AS run, max(value) * 100 AS q_in FROM events GROUP BY 1)
 SELECT run, CAST(epoch_us(h) // 3600000000 AS BIGINT) AS hour, round(dv, 4) AS dv, coalesce(abs(dv / q_in * 100) < 25.0, z < 0.05) AS steady FROM l JOIN q USING (run)
 WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def t3s(spark, d):
    """The change between closed hours, kept in one number of state per run."""
    p = scratch(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        inflow = V.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg((F.max("value") * 100).alias("q_in"))
        for arrived in event_arrivals(spark, d, p):
            s = ST.stream_steadiness(ST.hourly_volumes(arrived), inflow, 25.0)
            q = s.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/ck").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
    o = spark.read.parquet(f"{p}/out")
    return rounded(o.select("run", F.floor(F.unix_micros("hour_start") / 3600000000).alias("hour"), F.round("dV_dt_m3s", 4).alias("dv"), "steady"))
