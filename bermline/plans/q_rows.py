"""Queries for projections, filters and scalar functions."""
from pyspark.sql import functions as F

from bermline.functions import crs
from bermline.functions import geometry as G
from bermline.operators import flood as FL
from bermline.operators import rows as P
from bermline.plans import views as V
from bermline.plans.registry import query, rounded

# two edges of a line in one row: lengths l1, l2 and total L
_L = """(SELECT l.*, sqrt((bx-ax)^2+(by_-ay)^2) AS l1, sqrt((cx-bx)^2+(cy-by_)^2) AS l2,
 sqrt((bx-ax)^2+(by_-ay)^2) + sqrt((cx-bx)^2+(cy-by_)^2) AS L FROM lines l)"""


def at(d: str, c: str) -> str:
    """SQL for the x or y coordinate at distance d along the line."""
    a, b, e = (("ax", "bx", "cx") if c == "x" else ("ay", "by_", "cy"))
    return f"CASE WHEN {d} <= l1 THEN {a} + ({b} - {a}) * ({d}) / l1 ELSE {b} + ({e} - {b}) * (({d}) - l1) / l2 END"


def mline(spark, d):
    """Lines as multi-lines with an empty or a degenerate part here and there."""
    return V.lines(spark, d).selectExpr("line_id", "CASE WHEN size % 7 = 0 THEN 'Point' ELSE 'MultiLineString' END AS kind",
                                        "CASE WHEN size % 5 = 0 THEN filter(array(pts), p -> false) ELSE array(pts, array(pts[0], pts[0])) END AS parts")


@query("p1_drop_empty", "SELECT line_id FROM lines WHERE size % 5 <> 0")
def p1(spark, d):
    return P.drop_empty(mline(spark, d)).select("line_id")


@query("p2_explode_lines", f"SELECT line_id, 0::BIGINT AS part, round(L, 6) AS length_m FROM {_L} WHERE size % 5 <> 0 AND size % 7 <> 0")
def p2(spark, d):
    return rounded(P.explode_lines(mline(spark, d)).selectExpr("line_id", "CAST(part AS BIGINT) AS part", "length_m"))


@query("p3_segment_equal", f"""SELECT line_id, k, round(k * L / n, 6) AS chain0, round(L / n, 6) AS length_m, round(L / n, 6) AS geom_length FROM
 (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM (SELECT *, greatest(1, round_even(L / 50.0, 0)) AS n FROM {_L} WHERE L >= 20))""")
def p3(spark, d):
    s = P.segment_equal(V.lines(spark, d), 50.0, 20.0).withColumn("geom_length", G.line_length(F.col("pts")))
    return rounded(s.select("line_id", F.col("k").cast("long").alias("k"), "chain0", "length_m", "geom_length"))


@query("p4_segment_tail_merge", f"""WITH c AS (SELECT *, CAST(floor(L / 45.0) AS BIGINT) AS nf, L - floor(L / 45.0) * 45.0 AS tail FROM {_L}),
 n AS (SELECT *, CASE WHEN L <= 63.0 THEN 1 WHEN tail < 18.0 THEN nf ELSE nf + 1 END AS np FROM c), s AS (SELECT *, unnest(range(np)) AS k FROM n)
 SELECT line_id, k, round(k * 45.0, 6)::DOUBLE AS chain0, round(CASE WHEN k = np - 1 THEN L - k * 45.0 ELSE 45.0 END, 6) AS length_m FROM s""")
def p4(spark, d):
    return rounded(P.segment_tail_merge(V.lines(spark, d), 45.0, 0.4).select("line_id", F.col("k").cast("long").alias("k"), "chain0", "length_m"))


@query("p5_line_length", f"SELECT line_id, round(L, 6) AS len FROM {_L}")
def p5(spark, d):
    return rounded(V.lines(spark, d).select("line_id", G.line_length(F.col("pts")).alias("len")))


@query("p6_midpoint", f"SELECT line_id, round({at('L / 2', 'x')}, 6) AS x, round({at('L / 2', 'y')}, 6) AS y FROM {_L}")
def p6(spark, d):
    return rounded(P.segment_centres(V.lines(spark, d)).select("line_id", "x", "y"))


@query("p7_substring", f"""SELECT line_id, round({at('20.0', 'x')}, 6) AS xs, round({at('20.0', 'y')}, 6) AS ys, round({at('100.0', 'x')}, 6) AS xe,
 round({at('100.0', 'y')}, 6) AS ye, 80.0::DOUBLE AS len, 3::BIGINT AS n FROM {_L}""")
def p7(spark, d):
    s = V.lines(spark, d).select("line_id", G.substring(F.col("pts"), F.lit(20.0), F.lit(100.0)).alias("s"))
    return rounded(s.select("line_id", F.col("s")[0]["x"].alias("xs"), F.col("s")[0]["y"].alias("ys"), F.element_at("s", -1)["x"].alias("xe"),
                            F.element_at("s", -1)["y"].alias("ye"), G.line_length(F.col("s")).alias("len"), F.size("s").cast("long").alias("n")))


@query("p8_densify_even", f"""SELECT line_id, k, round({at('at_', 'x')}, 6) AS x, round({at('at_', 'y')}, 6) AS y FROM
 (SELECT *, k * L / n AS at_ FROM (SELECT *, unnest(range(n + 1)) AS k FROM (SELECT *, greatest(1, CAST(floor(L / 25.0) AS BIGINT)) AS n FROM {_L})))""")
def p8(spark, d):
    return rounded(P.densify(V.lines(spark, d), 25.0, "even").select("line_id", F.col("k").cast("long").alias("k"), "x", "y"))


@query("p8_densify_step", f"""SELECT line_id, k, round({at('at_', 'x')}, 6) AS x, round({at('at_', 'y')}, 6) AS y FROM
 (SELECT *, k * 30.0 AS at_ FROM (SELECT *, unnest(range(CAST(floor(L / 30.0) AS BIGINT) + 1)) AS k FROM {_L}))""")
def p8s(spark, d):
    return rounded(P.densify(V.lines(spark, d), 30.0).select("line_id", F.col("k").cast("long").alias("k"), "x", "y"))


# the point 10 units right of the middle vertex and 25 above the start
_PT = f"""(SELECT *, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/(l1*l1))) AS t1, greatest(0.0, least(1.0, ((px-bx)*(cx-bx)+(py-by_)*(cy-by_))/(l2*l2))) AS t2
 FROM (SELECT *, bx + 10 AS px, ay + 25 AS py FROM {_L}))"""
_PD = f"""(SELECT *, sqrt((px-(ax+t1*(bx-ax)))^2+(py-(ay+t1*(by_-ay)))^2) AS d1, sqrt((px-(bx+t2*(cx-bx)))^2+(py-(by_+t2*(cy-by_)))^2) AS d2 FROM {_PT})"""
_PROJ = f"(SELECT *, CASE WHEN d1 <= d2 THEN t1 * l1 ELSE l1 + t2 * l2 END AS chain FROM {_PD})"


def probe(spark, d):
    return V.lines(spark, d).withColumn("px", F.col("pts")[1]["x"] + 10).withColumn("py", F.col("pts")[0]["y"] + 25)


@query("p9_project_point", f"SELECT line_id, round(least(d1, d2), 6) AS dist, round(chain, 6) AS chain FROM {_PROJ}")
def p9(spark, d):
    q = probe(spark, d).withColumn("_r", G.project_point(F.col("pts"), F.col("px"), F.col("py")))
    return rounded(q.select("line_id", F.col("_r.d").alias("dist"), F.col("_r.chain").alias("chain")))


@query("p10_points_around", f"""SELECT line_id, round({at('greatest(chain - 30, 0)', 'x')}, 6) AS xb, round({at('greatest(chain - 30, 0)', 'y')}, 6) AS yb,
 round({at('least(chain + 90, L)', 'x')}, 6) AS xa, round({at('least(chain + 90, L)', 'y')}, 6) AS ya FROM {_PROJ}""")
def p10(spark, d):
    q = probe(spark, d).withColumn("_r", G.points_around(F.col("pts"), F.col("px"), F.col("py"), 30.0, 90.0))
    return rounded(q.select("line_id", F.col("_r.before.x").alias("xb"), F.col("_r.before.y").alias("yb"), F.col("_r.after.x").alias("xa"), F.col("_r.after.y").alias("ya")))


@query("p11_angle", f"SELECT line_id, round(degrees(acos(greatest(-1.0, least(1.0, ((ax-bx)*(cx-bx)+(ay-by_)*(cy-by_))/(l1*l2))))), 6) AS angle FROM {_L}")
def p11(spark, d):
    p = F.col("pts")
    return rounded(V.lines(spark, d).select("line_id", G.angle_deg(*[p[k][c] for k in range(3) for c in ("x", "y")]).alias("angle")))


@query("p12_perpendicular_profile", f"""SELECT line_id, offset_ AS "offset", round({at('L / 2', 'x')} - (cy-by_)/l2 * offset_, 6) AS x, round({at('L / 2', 'y')} + (cx-bx)/l2 * offset_, 6) AS y
 FROM (SELECT *, CAST(unnest(range(9)) * 10.0 - 40.0 AS DOUBLE) AS offset_ FROM {_L})""")
def p12(spark, d):
    q = V.lines(spark, d).withColumn("pos", G.line_length(F.col("pts")) / 2)
    return rounded(P.perpendicular_profile(q, "pos", 40.0, 10.0).select("line_id", "offset", "x", "y"))


@query("p13_size_class", "SELECT comid, CASE WHEN uparea >= 200000 THEN 'L' ELSE 'M' END AS category FROM reaches")
def p13(spark, d):
    return V.reaches(spark, d).select("comid", P.size_class(F.col("uparea"), 200000.0).alias("category"))


@query("p14_bin_class", """SELECT comid, CASE WHEN uparea >= 1000 AND uparea < 100000 THEN 'S' WHEN uparea >= 100000 AND uparea < 200000 THEN 'M' ELSE 'L' END AS category
 FROM reaches WHERE uparea >= 1000 AND uparea < 400000""")
def p14(spark, d):
    bins = {"S": (1000, 100000), "M": (100000, 200000), "L": (200000, 400000)}
    return P.bin_class(V.reaches(spark, d), "uparea", bins).select("comid", "category")


@query("p15_select_values", "SELECT flag, count(*) AS n FROM points WHERE flag NOT IN ('R') GROUP BY 1")
def p15(spark, d):
    return P.select_values(V.points(spark, d), "flag", ["R"], remove=True).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def boxes(spark, d):
    b = V.lines(spark, d).withColumn("_b", G.bounds(F.col("pts")))
    return b.select("line_id", "_b.*")


@query("p16_in_bounds", "SELECT line_id FROM lines WHERE cx >= 300 AND ax <= 900 AND cy >= 250 AND ay <= 800")
def p16(spark, d):
    return P.in_bounds(boxes(spark, d), (300.0, 250.0, 900.0, 800.0)).select("line_id")


@query("p17_select_reference_levees", f"""SELECT line_id, CASE WHEN size % 3 = 0 THEN 'dyke' ELSE 'bank' END AS source FROM {_L}
 WHERE size % 3 = 0 OR (size % 3 = 1 AND L >= 140 AND size % 4 >= 2 AND size % 20 >= 12)""")
def p17(spark, d):
    q = V.lines(spark, d).withColumn("length_m", G.line_length(F.col("pts"))).selectExpr(
        "*", "CASE size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS rodzaj",
        "CASE WHEN size % 4 >= 1 THEN CAST(size % 4 AS DOUBLE) END AS wysokosc", "CAST(size % 20 AS DOUBLE) AS szerKorony")
    return P.select_reference_levees(q, min_length=140.0, dyke="a", bank="b").select("line_id", "source")


_UNC, _PH, _CL, _SAT, _NI = "(h > 45 OR h / 10 <= 2.5)", "(flag = 'R' OR h >= 20)", "(canopy <= 1)", "(dz <= 4)", "(dz < -2)"


@query("p18_quality_mask", f"SELECT flag, count(*) AS n, sum(h) AS h FROM points WHERE {_UNC} AND {_PH} AND {_CL} AND {_SAT} AND {_NI} GROUP BY 1")
def p18(spark, d):
    q = P.quality_mask(lidar_flag(spark, d), P.quality_rules(night=True))
    return q.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))


def lidar_flag(spark, d):
    return V.points(spark, d).selectExpr(
        "flag", "h", "CASE WHEN h > 45 THEN NULL ELSE h / 10 END AS h_te_uncertainty", "CASE WHEN flag = 'R' THEN NULL ELSE h END AS n_te_photons",
        "CAST(canopy AS DOUBLE) AS cloud_flag_atm", "CASE WHEN dz > 4 THEN 1.0D ELSE 0.0D END AS sat_flag", "CASE WHEN dz < -2 THEN 1.0D END AS night_flag")


_F = lambda n, c: f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS passed, round(count(*) FILTER ({c}) / count(*), 6) AS share FROM points"


@query("p19_filter_funnel", " UNION ALL ".join([_F("uncertainty", _UNC), _F("photons", _PH), _F("cloud", _CL), _F("saturation", _SAT), _F("night", _NI),
                                               _F("strict", f"{_UNC} AND {_PH} AND {_CL} AND {_SAT}"), _F("relaxed", f"{_CL} AND {_SAT}")]))
def p19(spark, d):
    sets = {"strict": ["uncertainty", "photons", "cloud", "saturation"], "relaxed": ["cloud", "saturation"]}
    return rounded(P.filter_funnel(lidar_flag(spark, d), P.quality_rules(night=True), sets))


@query("p20_safe_ratio", "SELECT raster_id, i, round(CASE WHEN value > 0 THEN score / value END, 6) AS ratio FROM pixels")
def p20(spark, d):
    return rounded(V.pixels(spark, d).select("raster_id", "i", P.safe_ratio(F.col("score"), F.col("value")).alias("ratio")))


@query("p21_quantise", """WITH v AS (SELECT label_id, raster_id, i, CASE WHEN value >= -0.2 THEN value END AS v FROM pixels),
 q AS (SELECT label_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY 1)
 SELECT raster_id, i, CAST(floor((least(greatest(coalesce(v, lo), lo), hi) - lo) / (hi - lo + 1e-10) * 63) AS BIGINT) AS level FROM v JOIN q USING (label_id)""")
def p21(spark, d):
    p = V.pixels(spark, d).withColumn("v", F.when(F.col("value") >= -0.2, F.col("value")))
    return P.quantise(p, "v", 64, ("label_id",)).select("raster_id", "i", "level")


@query("p22_normalize_patches", """SELECT raster_id, 'dsm' AS channel, i, round(value - median(value) OVER (PARTITION BY raster_id), 6) AS v FROM pixels
 UNION ALL SELECT raster_id, 'water', i, CAST(truth AS DOUBLE) FROM pixels UNION ALL SELECT raster_id, 'tpi', i, round((score - 0.4) / (0.2 + 1e-6), 6) FROM pixels""")
def p22(spark, d):
    p = V.patches(spark, d).select(F.col("vec_id").alias("raster_id"), F.expr("map('dsm', value, 'water', CAST(label AS ARRAY<DOUBLE>), 'tpi', prob)").alias("channels"))
    n = P.normalize_patches(p, {"tpi": (0.4, 0.2)}).select("raster_id", F.explode("channels").alias("channel", "_a"))
    return rounded(n.select("raster_id", "channel", F.posexplode("_a").alias("i", "v")).withColumn("i", F.col("i").cast("long")))


@query("p23_footprints", "SELECT comid, x - 1280 AS xmin, y - 1280 AS ymin, x + 1280 AS xmax, y + 1280 AS ymax FROM reaches")
def p23(spark, d):
    return P.footprints(V.reaches(spark, d), 2560.0, "x", "y").select("comid", "xmin", "ymin", "xmax", "ymax")


@query("p24_total_bounds", "SELECT min(ax) AS xmin, min(ay) AS ymin, max(cx) AS xmax, max(cy) AS ymax FROM lines")
def p24(spark, d):
    return P.total_bounds(boxes(spark, d))


@query("p24_extent_bounds", "SELECT line_id, CAST(ax AS DOUBLE) AS e0, CAST(cx AS DOUBLE) AS e1, CAST(ay AS DOUBLE) AS e2, CAST(cy AS DOUBLE) AS e3, 5::BIGINT AS n FROM lines")
def p24e(spark, d):
    b = boxes(spark, d)
    e = G.bounds_to_extent(G.extent_to_bounds(F.array("xmin", "xmax", "ymin", "ymax")))
    ring = G.bounds_polygon(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return b.select("line_id", *[e[k].alias(f"e{k}") for k in range(4)], F.size(ring).cast("long").alias("n"))


@query("p25_snap_bounds", """SELECT line_id, floor((ax - 3.0) / 10.0) * 10.0 + 3.0 AS xmin, floor((ay - 7.0) / 10.0) * 10.0 + 7.0 AS ymin,
 ceil((cx - 3.0) / 10.0) * 10.0 + 3.0 AS xmax, ceil((cy - 7.0) / 10.0) * 10.0 + 7.0 AS ymax FROM (SELECT line_id, ax::DOUBLE AS ax, ay::DOUBLE AS ay, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM lines)""")
def p25(spark, d):
    s = G.snap_bounds(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], 3.0, 7.0, 10.0, 10.0)
    return boxes(spark, d).withColumn("_s", s).select("line_id", "_s.*")


@query("p26_cell_center", "SELECT id, (floor(x / 7.0) + 0.5) * 7.0::DOUBLE AS cx, 3000 - (floor((3000 - y) / 7.0) + 0.5) * 7.0::DOUBLE AS cy FROM points")
def p26(spark, d):
    c = G.cell_center(F.col("x"), F.col("y"), 0.0, 3000.0, 7.0, 7.0)
    return V.points(spark, d).withColumn("_c", c).select("id", F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"))


@query("p27_pixel_world", """SELECT id, r AS row, c AS col, (c + 0.5) * 6.0::DOUBLE AS wx, 3000 - (r + 0.5) * 6.0::DOUBLE AS wy FROM
 (SELECT id, CAST(round_even((3000 - y) / 6.0, 0) AS BIGINT) AS r, CAST(round_even(x / 6.0, 0) AS BIGINT) AS c FROM points)""")
def p27(spark, d):
    q = V.points(spark, d).withColumn("_p", G.to_pixel(F.col("x"), F.col("y"), 0.0, 3000.0, 6.0)).select("id", "_p.*")
    return q.withColumn("_w", G.to_world(F.col("row"), F.col("col"), 0.0, 3000.0, 6.0)).select("id", "row", "col", F.col("_w.x").alias("wx"), F.col("_w.y").alias("wy"))


@query("p28_in_raster", "SELECT count(*) FILTER (x BETWEEN 100 AND 1100 AND y BETWEEN 200 AND 1200) AS n_in, count(*) AS n FROM points")
def p28(spark, d):
    t = G.in_raster(F.col("x"), F.col("y"), 100.0, 1200.0, 1000.0, 1000.0)
    return V.points(spark, d).agg(F.count_if(t).alias("n_in"), F.count(F.lit(1)).alias("n"))


@query("p29_reclassify", "SELECT line_id, coalesce(map {" + ", ".join(f"{k}: {v}::DOUBLE" for k, v in P.MANNING.items()) + "}[size // 5 * 10], 0.04::DOUBLE) AS manning FROM lines")
def p29(spark, d):
    q = V.lines(spark, d).selectExpr("line_id", "CAST(size div 5 * 10 AS INT) AS lulc")
    return P.reclassify(q, "lulc", P.MANNING, P.MANNING_DEFAULT, "manning").select("line_id", "manning")


@query("p30_constant_series", """SELECT strftime(TIMESTAMP '2020-01-31 22:00:00' + to_hours(CAST(k AS INT)), '%Y-%m-%d %H:%M:%S') AS time, s_suppkey AS point_id, s_acctbal AS q
 FROM supplier, range(49) t(k)""")
def p30(spark, d):
    s = V.table(spark, d, "supplier").selectExpr("s_suppkey AS index", "s_acctbal AS q_rp100")
    return FL.constant_series(s, "20200131 220000", 48).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


def domain(spark, d):
    """Rectangles, one per 5 parts' worth of strip, as polygons with one hole."""
    return V.table(spark, d, "part").selectExpr("p_partkey div 50 AS polygon_id").distinct().selectExpr(
        "polygon_id", "polygon_id * 75.0D AS x0").selectExpr(
        "polygon_id", "array(array(struct(x0 AS x, 100.0D AS y), struct(x0 + 60 AS x, 100.0D AS y), struct(x0 + 60 AS x, 1500.0D AS y), struct(x0 AS x, 1500.0D AS y), struct(x0 AS x, 100.0D AS y))) AS parts")


# a line inside a rectangle: per edge the parameter interval left by slab clipping
_CLIP = """(SELECT line_id, polygon_id, edge, greatest(0.0, least((p0-x0)/(x1-x0), (p0+60-x0)/(x1-x0)), least((100.0-y0)/(y1-y0), (1500.0-y0)/(y1-y0))) AS ta,
 least(1.0, greatest((p0-x0)/(x1-x0), (p0+60-x0)/(x1-x0)), greatest((100.0-y0)/(y1-y0), (1500.0-y0)/(y1-y0))) AS tb, sqrt((x1-x0)^2+(y1-y0)^2) AS len
 FROM line_edges, (SELECT DISTINCT p_partkey // 50 AS polygon_id, (p_partkey // 50) * 75.0::DOUBLE AS p0 FROM part))"""


@query("p31_prepare_levees", f"""SELECT line_id, with_z, round(sum((tb - ta) * len), 4) AS len FROM (SELECT *, line_id % 3 <> 0 AS with_z FROM {_CLIP} WHERE tb > ta) GROUP BY 1, 2""")
def p31(spark, d):
    q = V.lines(spark, d).withColumn("z", F.expr("CASE WHEN line_id % 3 <> 0 THEN 2.0D + size END"))
    a, b = FL.prepare_levees(q, domain(spark, d), 100.0)
    u = a.drop("z").withColumn("with_z", F.lit(True)).unionByName(b.withColumn("with_z", F.lit(False)))
    return rounded(u.groupBy("line_id", "with_z").agg(F.sum("len").alias("len")), places=4)


@query("p32_weir_rows", """SELECT line_id AS structure, seq, printf('%.2f %.2f %.2f %.2f', CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(size AS DOUBLE), 0.6::DOUBLE) AS line FROM (
 SELECT line_id, 0::BIGINT AS seq, ax AS x, ay AS y, size FROM lines UNION ALL SELECT line_id, 1, bx, by_, size FROM lines UNION ALL SELECT line_id, 2, round(cx, 1), cy, size FROM lines)""")
def p32(spark, d):
    q = V.lines(spark, d).withColumn("pts", F.transform("pts", lambda p: F.struct(F.round(p["x"], 1).alias("x"), p["y"].alias("y")))).withColumn("z", F.col("size"))
    return FL.weir_rows(q, 0.6).select("structure", F.col("seq").cast("long").alias("seq"), "line")


@query("p33_reproject", "SELECT comid, 0::BIGINT AS err_mm FROM reaches")
def p33(spark, d):
    """Round trip of reach positions through three map systems; the error in whole millimetres.

    The strip of positions grows with the table, beyond the circumference of the earth; its eastings are wound into the
    400 km in which the first system is defined, so that every reach has a position on the map.
    """
    q = V.reaches(spark, d).select("comid", ((F.col("x") * 10) % 400000 + 400000).alias("x0"), (F.col("y") * 10 + 300000).alias("y0"))
    q = q.withColumn("x", F.col("x0")).withColumn("y", F.col("y0"))
    for a, b in ((2180, 3035), (3035, 5070), (5070, 4326), (4326, 2180)):
        q = crs.reproject(q, a, b)
    err = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return q.select("comid", F.bround(err * 1000 / 5, 0).cast("long").alias("err_mm"))


_ORTH = """p AS (SELECT id, h, x / 100.0 AS c, y / 100.0 AS r FROM points), g AS (SELECT DISTINCT CAST(floor(y / 50) AS BIGINT) AS row, CAST(floor(x / 50) AS BIGINT) AS col FROM points)"""


@query("p34_orthometric", f"""WITH {_ORTH}, n AS (SELECT row, col, 30 + row * 0.5 + col * 0.25 + row * col * 0.01 AS v FROM g),
 q AS (SELECT id, h, floor(c) AS c0, floor(r) AS r0, c - floor(c) AS u, r - floor(r) AS w FROM p),
 e AS (SELECT id, any_value(h) AS h, sum(v * CASE WHEN row = r0 THEN 1 - w ELSE w END * CASE WHEN col = c0 THEN 1 - u ELSE u END) AS s, count(*) AS k
  FROM q JOIN n ON row BETWEEN r0 AND r0 + 1 AND col BETWEEN c0 AND c0 + 1 GROUP BY 1)
 SELECT id, round(CASE WHEN k = 4 THEN s END, 6)::DOUBLE AS geoid_n, round(CASE WHEN k = 4 THEN h - s END, 6)::DOUBLE AS h_ortho FROM (SELECT DISTINCT id FROM points) LEFT JOIN e USING (id)""")
def p34(spark, d):
    p = V.points(spark, d).selectExpr("id", "h AS h_te_ellipsoid", "x AS lon", "y AS lat").dropDuplicates(["id"])
    g = V.points(spark, d).select(F.floor(F.col("y") / 50).alias("row"), F.floor(F.col("x") / 50).alias("col")).distinct()
    g = g.withColumn("n_value", F.lit(30.0) + F.col("row") * 0.5 + F.col("col") * 0.25 + F.col("row") * F.col("col") * 0.01)
    o = crs.orthometric(p, g, 0.0, 0.0, 100.0)
    return rounded(o.select("id", F.col("geoid_N").alias("geoid_n"), F.col("h_te_ortho").alias("h_ortho")))


@query("p35_simplify_lines", f"""SELECT line_id, CASE WHEN dist > 12 THEN 3 ELSE 2 END::BIGINT AS n, round(CASE WHEN dist > 12 THEN L ELSE sqrt((cx-ax)^2+(cy-ay)^2) END, 6) AS length_m FROM (
 SELECT *, abs((cx-ax)*(by_-ay)-(cy-ay)*(bx-ax))/sqrt((cx-ax)^2+(cy-ay)^2) AS dist FROM {_L}) WHERE CASE WHEN dist > 12 THEN L ELSE sqrt((cx-ax)^2+(cy-ay)^2) END >= 135""")
def p35(spark, d):
    return rounded(P.simplify_lines(V.lines(spark, d), 12.0, 135.0).select("line_id", F.size("pts").cast("long").alias("n"), "length_m"))


@query("p36_convex_hull")
def p36(spark, d):
    return P.convex_hull(V.points(spark, d).select("flag", "x", "y"), "flag")


@query("p36_close_holes", "SELECT line_id, 1::BIGINT AS n FROM lines")
def p36c(spark, d):
    q = V.lines(spark, d).selectExpr("line_id", "array(pts, slice(pts, 1, 2)) AS parts")
    return P.close_holes(q).select("line_id", F.size("parts").cast("long").alias("n"))


_TURN = "CASE t % 4 WHEN 0 THEN row * 8 + col WHEN 1 THEN col * 8 + 7 - row WHEN 2 THEN (7 - row) * 8 + 7 - col ELSE (7 - col) * 8 + row END"


@query("p37_expand_d4", f"""WITH o AS (SELECT raster_id, t, row * 8 + col AS i, {_TURN} AS s FROM (SELECT DISTINCT raster_id, row, col FROM pixels), range(8) r(t)),
 m AS (SELECT raster_id, t, i, CASE WHEN t >= 4 THEN s // 8 * 8 + 7 - s % 8 ELSE s END AS s FROM o)
 SELECT m.raster_id, m.t, m.i, round(p.value, 6) AS v FROM m JOIN pixels p ON m.raster_id = p.raster_id AND m.s = p.i""")
def p37(spark, d):
    e = P.expand_d4(V.patches(spark, d).select(F.col("vec_id").alias("raster_id"), "value"), ["value"], 8)
    return rounded(e.select("raster_id", F.col("t").cast("long").alias("t"), F.posexplode("value").alias("i", "v")).withColumn("i", F.col("i").cast("long")))


@query("p37_augment")
def p37a(spark, d):
    return P.augment(V.patches(spark, d).select("patch_id", "region", "value", "label"), ["value", "label"], 8, ["region", "patch_id"])


@query("p38_thin_uniform", "WITH o AS (SELECT comid, row_number() OVER (ORDER BY comid) - 1 AS j, count(*) OVER () AS n FROM reaches) SELECT comid FROM o WHERE j IN (SELECT CAST(floor(i * n / 700) AS BIGINT) FROM range(700) t(i), (SELECT count(*) AS n FROM reaches)) ")
def p38(spark, d):
    return P.thin_uniform(V.reaches(spark, d).select("comid"), 700, ["comid"])


@query("p39_orbit_direction", """SELECT d AS direction, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'ASCENDING' WHEN 1 THEN 'DESCENDING' ELSE 'UNKNOWN' END AS d FROM part) GROUP BY 1""")
def p39(spark, d):
    t = V.table(spark, d, "part").selectExpr("concat(p_name, ' pass: ', CASE p_size % 3 WHEN 0 THEN 'ascending' WHEN 1 THEN 'Descending' ELSE '-' END) AS text")
    return t.groupBy(P.orbit_direction(F.col("text")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("p40_clean_lines", "SELECT line_id, size % 2 = 0 AS changed, 3::BIGINT AS n FROM lines")
def p40(spark, d):
    q = V.lines(spark, d).withColumn("pts", F.expr("CASE WHEN size % 2 = 0 THEN array(pts[0], pts[1], pts[1], pts[2], pts[2]) ELSE pts END"))
    return P.clean_lines(q).select("line_id", "changed", F.size("pts").cast("long").alias("n"))

