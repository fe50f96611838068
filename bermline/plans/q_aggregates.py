"""Queries for the aggregate family."""
from pyspark.sql import functions as F

from bermline.operators import metrics as M
from bermline.operators import robust as R
from bermline.plans import views as V
from bermline.plans.registry import query, rounded

MET = "{p}tp / ({p}tp + {p}fp + {e})"


def metric_sql(e: str, prefix: str = "") -> str:
    """Metric expressions over columns tp, fp, fn of the FROM relation."""
    p, r = f"(tp / (tp + fp + {e}))", f"(tp / (tp + fn + {e}))"
    return (f"round({p}, 6) AS {prefix}precision, round({r}, 6) AS {prefix}recall, round(2 * {p} * {r} / ({p} + {r} + {e}), 6) AS {prefix}f1, "
            f"round(tp / (tp + fp + fn + {e}), 6) AS {prefix}iou, round(2 * tp / (2 * tp + fp + fn + {e}), 6) AS {prefix}dice")


SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn"
SCORED = ("score", "truth")


@query("a1_confusion_counts", "SELECT patch_id, region, category, patch_type, tp, fp, fn, tn FROM confusion")
def a1(spark, d):
    return M.confusion_counts(V.patches(spark, d).select("patch_id", "region", "category", "patch_type", "prob", "label"))


@query("a2_count_metrics", f"SELECT patch_id, region, tp, fp, fn, tn, {metric_sql('1e-6')} FROM confusion")
def a2(spark, d):
    return rounded(V.results(spark, d).select("patch_id", "region", *M.COUNTS, *M.METRICS))


@query("a2_count_metrics_null", """
SELECT doc_id, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
 CASE WHEN tp > 0 THEN 1.0::DOUBLE END AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice
FROM (SELECT doc_id, CAST(truth * score AS BIGINT) AS tp, CAST((1 - truth) * score AS BIGINT) AS fp, CAST(truth * (1 - score) AS BIGINT) AS fn FROM docs)""")
def a2n(spark, d):
    x = V.docs(spark, d).selectExpr("doc_id", "CAST(truth * score AS BIGINT) AS tp", "CAST((1 - truth) * score AS BIGINT) AS fp",
                                    "CAST(truth * (1 - score) AS BIGINT) AS fn")
    return rounded(M.count_metrics(x, null_on_empty=True).drop("tp", "fp", "fn"))


_macro = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in M.METRICS)


@query("a3_macro_report", f"""SELECT category, patch_type, count(*) AS n, {_macro}
 FROM (SELECT * REPLACE (coalesce(category, patch_type) AS category) FROM results) GROUP BY 1, 2""")
def a3(spark, d):
    return rounded(M.macro_report(V.results(spark, d)))


@query("a4_micro_report", f"SELECT *, {metric_sql('1e-9')} FROM (SELECT count(*) AS n, {SUMS} FROM results)")
def a4(spark, d):
    return rounded(M.micro_report(V.results(spark, d)))


@query("a4_micro_report_positives", f"SELECT *, {metric_sql('1e-9')} FROM (SELECT region, count(*) AS n, {SUMS} FROM results WHERE patch_type = 'positive' GROUP BY 1)")
def a4p(spark, d):
    return rounded(M.micro_report(V.results(spark, d), ("region",), positives_only=True))


@query("a5_grouped_summary", f"""SELECT *, {metric_sql('1e-9', 'micro_')} FROM (
 SELECT category, patch_type, region, CAST(grouping(category) * 4 + grouping(patch_type) * 2 + grouping(region) AS BIGINT) AS level, count(*) AS n,
 round(avg(dice), 6) AS dice_mean, round(avg(iou), 6) AS iou_mean, round(avg(f1), 6) AS f1_mean, {SUMS}
 FROM (SELECT * REPLACE (coalesce(category, patch_type) AS category) FROM results)
 GROUP BY GROUPING SETS ((), (category, patch_type), (region, patch_type)))""")
def a5(spark, d):
    return rounded(M.grouped_summary(V.results(spark, d)))


@query("a6_variant_table", f"""WITH v AS (SELECT 'v' || (CAST(substr(patch_id, 3) AS BIGINT) % 3) AS variant, * FROM results),
 t AS (SELECT variant, count(*) AS n_patches, avg(dice) AS mean_dice, stddev_samp(dice) AS std_dice, avg(iou) AS mean_iou, stddev_samp(iou) AS std_iou,
  avg(f1) AS mean_f1, stddev_samp(f1) AS std_f1, {SUMS} FROM v GROUP BY 1), b AS (SELECT * FROM t WHERE variant = 'v0')
 SELECT t.variant, t.n_patches, round(t.mean_dice, 6) AS mean_dice, round(t.std_dice, 6) AS std_dice, round(t.mean_iou, 6) AS mean_iou,
  round(t.std_iou, 6) AS std_iou, round(t.mean_f1, 6) AS mean_f1, round(t.std_f1, 6) AS std_f1, t.tp, t.fp, t.fn, t.tn,
  {metric_sql('1e-6', 'micro_').replace('tp', 't.tp').replace('fp', 't.fp').replace('fn', 't.fn')},
  round((t.mean_dice - b.mean_dice) / greatest(b.mean_dice, 1e-6) * 100, 6) AS change_dice_pct,
  round((t.mean_iou - b.mean_iou) / greatest(b.mean_iou, 1e-6) * 100, 6) AS change_iou_pct,
  round((t.mean_f1 - b.mean_f1) / greatest(b.mean_f1, 1e-6) * 100, 6) AS change_f1_pct FROM t, b""")
def a6(spark, d):
    r = V.results(spark, d).withColumn("variant", F.expr("concat('v', CAST(substr(patch_id, 3) AS BIGINT) % 3)"))
    return rounded(M.variant_table(r))


_SWEEP = ", ".join(f"({t})" for t in M.SWEEP)


@query("a7_threshold_sweep", f"""SELECT *, {metric_sql('1e-9')} FROM (SELECT region, CAST(t AS DOUBLE) AS threshold,
 count(*) FILTER (score >= t AND truth = 1) AS tp, count(*) FILTER (score >= t AND truth = 0) AS fp,
 count(*) FILTER (score < t AND truth = 1) AS fn, count(*) FILTER (score < t AND truth = 0) AS tn
 FROM (SELECT 'r' || (label_id % 2) AS region, score, truth FROM pixels), (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES {_SWEEP}) _t(t)) GROUP BY 1, 2)""")
def a7(spark, d):
    p = V.pixels(spark, d).withColumn("region", F.expr("concat('r', label_id % 2)"))
    return rounded(M.threshold_sweep(p, by=("region",)))


@query("a8_best_threshold", f"""WITH s AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM (SELECT CAST(t AS DOUBLE) AS threshold,
 count(*) FILTER (score >= t AND truth = 1) AS tp, count(*) FILTER (score >= t AND truth = 0) AS fp, count(*) FILTER (score < t AND truth = 1) AS fn
 FROM pixels, (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES {_SWEEP}) _t(t)) GROUP BY 1)), f AS (SELECT *, 2 * p * r / (p + r + 1e-9) AS f FROM s)
 SELECT threshold AS best_threshold, {metric_sql('1e-9')}, (SELECT round(f, 6) FROM f WHERE threshold = 0.5) AS f1_at_reference
 FROM f ORDER BY f DESC, threshold LIMIT 1""")
def a8(spark, d):
    return rounded(M.best_threshold(M.threshold_sweep(V.pixels(spark, d))))


_CUM = """t AS (SELECT round(score, 4) AS score, CAST(sum(truth) AS DOUBLE) AS pos, CAST(sum(1 - truth) AS DOUBLE) AS neg FROM pixels GROUP BY 1),
 c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, (SELECT sum(pos) FROM t) AS np, (SELECT sum(neg) FROM t) AS nn FROM t)"""


def scored(spark, d):
    return V.pixels(spark, d).select(F.round("score", 4).alias("score"), "truth")


@query("a9_pr_curve", f"""WITH {_CUM}, p AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, tp / np AS recall FROM c)
 SELECT score, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-10), 6) AS f1 FROM p""")
def a9(spark, d):
    return rounded(M.pr_curve(scored(spark, d)))


@query("a10_rank_metrics", f"""WITH {_CUM} SELECT round(sum(pos / np * tp / (tp + fp)), 6) AS ap, round(sum(neg * (tp - pos / 2)) / max(np * nn), 6) AS roc_auc FROM c""")
def a10(spark, d):
    return rounded(M.rank_metrics(scored(spark, d)))


@query("a10_rank_metrics_weighted", """WITH t AS (SELECT round(score, 4) AS score, sum(truth * w) AS pos, sum((1 - truth) * w) AS neg FROM (SELECT *, 1.0 + i % 3 AS w FROM pixels) GROUP BY 1),
 c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, (SELECT sum(pos) FROM t) AS np, (SELECT sum(neg) FROM t) AS nn FROM t)
 SELECT CAST(round(sum(pos / np * tp / (tp + fp)), 6) AS DOUBLE) AS ap, CAST(round(sum(neg * (tp - pos / 2)) / max(np * nn), 6) AS DOUBLE) AS roc_auc FROM c""")
def a10w(spark, d):
    p = V.pixels(spark, d).select(F.round("score", 4).alias("score"), "truth", (F.col("i") % 3 + 1.0).alias("w"))
    return rounded(M.rank_metrics(p, weight="w"))


@query("a11_class_report", """WITH c AS (SELECT CAST(count(*) FILTER (score >= 0.55 AND truth = 1) AS DOUBLE) AS tp, count(*) FILTER (score >= 0.55 AND truth = 0) AS fp,
 count(*) FILTER (score < 0.55 AND truth = 1) AS fn, count(*) FILTER (score < 0.55 AND truth = 0) AS tn FROM pixels),
 m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS n0, tp + fn AS n1, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c),
 f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, n0 + n1 AS n FROM m)
 SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(n0 AS BIGINT) AS support FROM f
 UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(n1 AS BIGINT) FROM f
 UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(n AS BIGINT) FROM f
 UNION ALL SELECT 'macro', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
 UNION ALL SELECT 'weighted', round((p0 * n0 + p1 * n1) / n, 6), round((r0 * n0 + r1 * n1) / n, 6), round((f0 * n0 + f1 * n1) / n, 6), CAST(n AS BIGINT) FROM f""")
def a11(spark, d):
    return rounded(M.class_report(V.pixels(spark, d), 0.55))


def rb(col: str) -> str:
    return (f"count({col}) AS n, round(avg(abs({col})), 6) AS mae, round(quantile_cont({col}, 0.2), 6) AS p20, "
            f"round(quantile_cont({col}, 0.5), 6) AS median, round(quantile_cont({col}, 0.8), 6) AS p80")


@query("a12_robust_block", f"SELECT beam, {rb('h')} FROM tracks GROUP BY 1")
def a12(spark, d):
    return rounded(R.robust_block(V.tracks(spark, d), "h", ("beam",)))


@query("a12_robust_block_overall", f"SELECT {rb('price')} FROM points")
def a12o(spark, d):
    return rounded(R.robust_block(V.points(spark, d), "price"))


@query("a13_robust_by_method", f"SELECT flag AS method, {rb('dz')}, round(sum(price) / 1000, 2) AS length_km FROM points GROUP BY 1")
def a13(spark, d):
    p = V.points(spark, d).withColumnsRenamed({"flag": "method", "price": "length_m"})
    return rounded(rounded(R.robust_by_method(p, "dz"), "length_km", places=2))


@query("a14_grid_stats", """SELECT gx, gy, n, round(m, 6) AS median, (gx + 0.5) * 200.0::DOUBLE AS x_m, (gy + 0.5) * 200.0::DOUBLE AS y_m FROM (
 SELECT CAST(floor(x / 200) AS BIGINT) AS gx, CAST(floor(y / 200) AS BIGINT) AS gy, count(h) AS n, quantile_cont(h, 0.5) AS m FROM points GROUP BY 1, 2) WHERE n >= 100""")
def a14(spark, d):
    return rounded(R.grid_stats(V.points(spark, d), "h", 200.0, 100))


@query("a15_datum_offset", """WITH p AS (SELECT dz, CAST(floor(x / 200) AS BIGINT) AS gx, CAST(floor(y / 200) AS BIGINT) AS gy FROM points),
 q AS (SELECT quantile_cont(dz, 0.5) AS m, count(*) AS n, stddev_pop(dz) AS s, quantile_cont(dz, 0.2) AS p20, quantile_cont(dz, 0.8) AS p80 FROM p)
 SELECT round((SELECT quantile_cont(dz, 0.5) FROM p WHERE gy <= 4), 6) AS offset, round(m, 6) AS median_all, (SELECT count(*) FROM p WHERE gy <= 4) AS n_corridor,
 n AS n_all, round(s, 6) AS std, round(p20, 6) AS p20, round(p80, 6) AS p80,
 round((SELECT avg(CASE WHEN abs(dz - m) <= 0.2 THEN 1.0 ELSE 0.0 END) FROM p), 6) AS share_02,
 round((SELECT avg(CASE WHEN abs(dz - m) <= 0.5 THEN 1.0 ELSE 0.0 END) FROM p), 6) AS share_05 FROM q""")
def a15(spark, d):
    p = V.points(spark, d)
    cells = p.select(F.floor(F.col("x") / 200).alias("gx"), F.floor(F.col("y") / 200).alias("gy")).filter("gy <= 4").distinct()
    return rounded(R.datum_offset(p, "dz", cells, 200.0))


@query("a16_kruskal", """WITH v AS (SELECT flag, h, count(*) OVER (PARTITION BY h) AS t, rank() OVER (ORDER BY h) AS r FROM points),
 g AS (SELECT flag, sum(r + (t - 1) / 2.0) AS s, count(*) AS n FROM v GROUP BY 1), a AS (SELECT sum(s * s / n) AS s, sum(n) AS n, count(*) AS k FROM g),
 u AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM (SELECT h, count(*) AS t FROM points GROUP BY 1))
 SELECT round((12 / (n::DOUBLE * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n::DOUBLE * n * n - n)), 4) AS h, k - 1 AS dof, CAST(n AS BIGINT) AS n FROM a, u""")
def a16(spark, d):
    return rounded(R.kruskal_terms(V.points(spark, d), "h", "flag"), places=4)


@query("a17_trend_sums", """WITH c AS (SELECT (gx + 0.5) * 200.0 / 1e5 AS x, (gy + 0.5) * 200.0 / 1e5 AS y, n, m AS v FROM (
 SELECT CAST(floor(x / 200) AS BIGINT) AS gx, CAST(floor(y / 200) AS BIGINT) AS gy, count(h) AS n, quantile_cont(h, 0.5) AS m FROM points GROUP BY 1, 2) WHERE n >= 100)
 SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS s1, round(sum(n * x), 6) AS sx, round(sum(n * y), 6) AS sy, round(sum(n * x * x), 6) AS sxx, round(sum(n * x * y), 6) AS sxy,
 round(sum(n * y * y), 6) AS syy, round(sum(n * v), 6) AS sv, round(sum(n * x * v), 6) AS sxv, round(sum(n * y * v), 6) AS syv, round(sum(n * v * v), 6) AS svv FROM c""")
def a17(spark, d):
    return rounded(R.trend_sums(R.grid_stats(V.points(spark, d), "h", 200.0, 100)))


_T = "greatest(0.0, least(1.0, ((p.x-e.x0)*(e.x1-e.x0)+(p.y-e.y0)*(e.y1-e.y0))/((e.x1-e.x0)^2+(e.y1-e.y0)^2)))"
_EDGE_DIST = f"sqrt((p.x-(e.x0+{_T}*(e.x1-e.x0)))^2+(p.y-(e.y0+{_T}*(e.y1-e.y0)))^2)"


@query("a15_corridor_offset", f"""WITH p AS (SELECT dz, CAST(floor(x / 100) AS BIGINT) AS gx, CAST(floor(y / 100) AS BIGINT) AS gy FROM points),
 c AS (SELECT gx, gy, (gx + 0.5) * 100 AS x, (gy + 0.5) * 100 AS y FROM p GROUP BY 1, 2 HAVING count(*) >= 20),
 k AS (SELECT DISTINCT gx, gy FROM c p JOIN line_edges e ON p.x BETWEEN e.x0 - 40 AND e.x1 + 40 AND p.y BETWEEN e.y0 - 40 AND e.y1 + 40 WHERE {_EDGE_DIST} <= 40)
 SELECT round(quantile_cont(dz, 0.5), 6) AS offset, count(*) AS n_corridor, (SELECT count(*) FROM points) AS n_all, (SELECT count(*) FROM k) AS n_cells FROM p SEMI JOIN k USING (gx, gy)""")
def a15c(spark, d):
    p = V.points(spark, d)
    n = R.axis_cells(p, "dz", V.lines(spark, d), 40.0, 100.0, 20).agg(F.count(F.lit(1)).alias("n_cells"))
    o = R.corridor_offset(p, "dz", V.lines(spark, d), 40.0, 100.0, 20)
    return rounded(o.select("offset", "n_corridor", "n_all").crossJoin(n))  # one row each


@query("a16_kruskal_table", """WITH v AS (SELECT flag, h, count(*) OVER (PARTITION BY h) AS t, rank() OVER (ORDER BY h) AS r FROM points WHERE flag IN ('A', 'N', 'R')),
 g AS (SELECT flag, sum(r + (t - 1) / 2.0) AS s, count(*) AS n FROM v GROUP BY 1), a AS (SELECT sum(s * s / n) AS s, sum(n) AS n, count(*) AS k FROM g),
 u AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM (SELECT h, count(*) AS t FROM v GROUP BY 1)),
 h AS (SELECT (12 / (n::DOUBLE * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n::DOUBLE * n * n - n)) AS h, k - 1 AS dof, CAST(n AS BIGINT) AS n FROM a, u)
 SELECT round(h, 4) AS h, dof, n, round(exp(-h / 2), 4) AS p FROM h""")
def a16t(spark, d):
    """With three groups the chi-square tail has the closed form of the twin."""
    return rounded(R.kruskal_table(V.points(spark, d).filter("flag IN ('A', 'N', 'R')"), "h", "flag"), places=4)


@query("a17_trend_table", """WITH c AS (SELECT (gx + 0.5) * 200.0 / 1e5 AS x, (gy + 0.5) * 200.0 / 1e5 AS y, n, m AS v FROM (
 SELECT CAST(floor(x / 200) AS BIGINT) AS gx, CAST(floor(y / 200) AS BIGINT) AS gy, count(h) AS n, quantile_cont(h, 0.5) AS m FROM points GROUP BY 1, 2) WHERE n >= 100),
 m AS (SELECT count(*) - 3 AS dof, sum(n)::DOUBLE AS w, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(n * v) / sum(n) AS mv FROM c),
 z AS (SELECT any_value(dof) AS dof, any_value(w) AS w, any_value(mx) AS mx, any_value(my) AS my, any_value(mv) AS mv, sum(n * (x - mx) ^ 2) AS xx, sum(n * (y - my) ^ 2) AS yy, sum(n * (x - mx) * (y - my)) AS xy,
  sum(n * (x - mx) * (v - mv)) AS xv, sum(n * (y - my) * (v - mv)) AS yv, sum(n * (v - mv) ^ 2) AS vv FROM c, m),
 b AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS e, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS o FROM z),
 r AS (SELECT *, (vv - e * xv - o * yv) / dof AS s2, xx * yy - xy * xy AS det FROM b),
 t AS (SELECT 'constant' AS term, mv - e * mx - o * my AS coef, sqrt(s2 * (1 / w + (mx * mx * yy - 2 * mx * my * xy + my * my * xx) / det)) AS se FROM r UNION ALL
  SELECT 'east', e, sqrt(s2 * yy / det) FROM r UNION ALL SELECT 'north', o, sqrt(s2 * xx / det) FROM r)
 SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS t FROM t""")
def a17t(spark, d):
    return rounded(R.trend_table(R.grid_stats(V.points(spark, d), "h", 200.0, 100)).drop("p"), places=4)


def height_inputs(spark, d):
    p = V.points(spark, d).selectExpr("comid div 2 AS segment_id", "comid div 20 AS levee_id", "h", "dz", "canopy")
    s = V.reaches(spark, d).selectExpr("comid div 2 AS segment_id", "comid div 20 AS levee_id", "uparea").groupBy("segment_id", "levee_id").agg(
        (F.max("uparea") / 1000).alias("dsm_med"), F.sum("uparea").alias("length_m"))
    return s, p


_HEIGHTS = """p AS (SELECT comid // 2 AS segment_id, comid // 20 AS levee_id, h, dz FROM points),
 s AS (SELECT comid // 2 AS segment_id, comid // 20 AS levee_id, max(uparea) / 1000 AS dsm_med, sum(uparea) AS length_m FROM reaches GROUP BY 1, 2),
 a AS (SELECT segment_id, count(*) AS n, quantile_cont(h, 0.5) AS hm, quantile_cont(h, 0.2) AS hc, quantile_cont(dz, 0.5) AS dm FROM p GROUP BY 1),
 l AS (SELECT levee_id, count(*) AS n, quantile_cont(dz, 0.5) AS dm, quantile_cont(dz, 0.2) AS dc FROM p GROUP BY 1),
 r AS (SELECT s.*, coalesce(a.n, 0) AS n_pts, CASE WHEN a.n >= 3 THEN 'z_measured' WHEN l.n >= 3 THEN 'dz_levee' ELSE 'dz_default' END AS method,
  CASE WHEN a.n >= 3 THEN a.dm WHEN l.n >= 3 THEN l.dm ELSE 0.9 END AS dz_used,
  CASE WHEN a.n >= 3 THEN hm WHEN l.n >= 3 THEN dsm_med + l.dm ELSE dsm_med + 0.9 END AS z,
  CASE WHEN a.n >= 3 THEN hc WHEN l.n >= 3 THEN dsm_med + l.dc ELSE dsm_med + 0.9 END AS z_cons
  FROM s LEFT JOIN a USING (segment_id) LEFT JOIN l USING (levee_id))"""


@query("a18_resolve_heights", f"""WITH {_HEIGHTS} SELECT segment_id, levee_id, round(dsm_med, 6) AS dsm_med, round(length_m, 2) AS length_m, n_pts, method,
 round(dz_used, 6) AS dz_used, round(z, 6) AS z, round(z_cons, 6) AS z_cons FROM r""")
def a18(spark, d):
    s, p = height_inputs(spark, d)
    return rounded(rounded(R.resolve_heights(s, p), "length_m", places=2))


@query("a19_length_share", f"WITH {_HEIGHTS} SELECT method, round(sum(length_m) / (SELECT sum(length_m) FROM r) * 100, 1) AS percent_length FROM r GROUP BY 1")
def a19(spark, d):
    s, p = height_inputs(spark, d)
    return R.length_share(R.resolve_heights(s, p))


@query("a20_removal_reasons", """SELECT CASE WHEN canopy > 2.0 THEN 'vegetation' WHEN dz > 4.5 THEN 'structure' WHEN dz < -0.3 THEN 'below_dsm' ELSE 'kept' END AS reason,
 count(*) AS n FROM points GROUP BY 1""")
def a20(spark, d):
    return R.removal_reasons(V.points(spark, d), dz_max=4.5).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a21_channel_stats", """SELECT 'ch' || label_id AS channel, CASE WHEN label_id = 3 THEN 0.0 ELSE round(sum(value) / count(*), 6) END AS mean,
 CASE WHEN label_id = 3 THEN 1.0 ELSE round(sqrt(greatest(sum(value * value) / count(*) - (sum(value) / count(*)) ^ 2, 1e-12)), 6) END AS std FROM pixels GROUP BY label_id""")
def a21(spark, d):
    p = V.pixels(spark, d).select(F.concat(F.lit("ch"), "label_id").alias("channel"), "value")
    return rounded(R.channel_stats(p, exclude=("ch3",)))


@query("a22_pixel_stack_stats", "SELECT row, col, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM (SELECT row, col, CASE WHEN value >= -0.2 THEN value END AS v FROM pixels) GROUP BY 1, 2")
def a22(spark, d):
    p = V.pixels(spark, d).withColumn("value", F.when(F.col("value") >= -0.2, F.col("value")))
    return rounded(R.pixel_stack_stats(p))


@query("a23_merge_moments", "SELECT label_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM pixels GROUP BY 1")
def a23(spark, d):
    part = R.partial_moments(V.pixels(spark, d), ("label_id", "row"), "value")
    return rounded(R.merge_moments(part, ("label_id",)))


_QS = "[" + ", ".join(repr(0.005 + 0.99 * k / 199) for k in range(200)) + "]"


@query("a24_domain_shift", f"""WITH v AS (SELECT 'row' || row AS channel, label_id % 2 AS dom, value FROM pixels),
 s AS (SELECT channel, dom, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, [0.02, 0.5, 0.98]) AS f, quantile_cont(value, {_QS}) AS q FROM v GROUP BY 1, 2),
 j AS (SELECT a.channel, a.m AS ma, b.m AS mb, a.sd AS sa, b.sd AS sb, a.f AS fa, b.f AS fb, list_avg(list_transform(list_zip(a.q, b.q), lambda z: abs(z[1] - z[2]))) AS w
  FROM s a JOIN s b ON a.channel = b.channel AND a.dom = 0 AND b.dom = 1)
 SELECT channel, round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(fa[1], 6) AS p2_a, round(fa[2], 6) AS median_a, round(fa[3], 6) AS p98_a,
 round(mb, 6) AS mean_b, round(sb, 6) AS std_b, round(fb[1], 6) AS p2_b, round(fb[2], 6) AS median_b, round(fb[3], 6) AS p98_b,
 round(w, 6) AS w1, round((mb - ma) / sa, 6) AS smd, round(w / sa, 6) AS w1_rel FROM j""")
def a24(spark, d):
    p = V.pixels(spark, d).select(F.concat(F.lit("row"), "row").alias("channel"), "label_id", "value")
    return rounded(R.domain_shift(p.filter("label_id % 2 = 0").drop("label_id"), p.filter("label_id % 2 = 1").drop("label_id")))


@query("a25_inventory", """WITH c AS (SELECT 'region' AS column_name, region AS value, patch_type AS x FROM docs UNION ALL SELECT 'source', source, patch_type FROM docs
 UNION ALL SELECT 'category', category, patch_type FROM docs UNION ALL SELECT 'patch_type', patch_type, patch_type FROM docs UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), patch_type FROM docs),
 low AS (SELECT column_name FROM c GROUP BY 1 HAVING count(DISTINCT value) <= 40), k AS (SELECT c.* FROM c JOIN low USING (column_name)),
 a AS (SELECT column_name, value, count(*) AS n FROM k GROUP BY 1, 2)
 SELECT column_name, value, n, '' AS patch_type FROM a UNION ALL
 SELECT a.column_name, a.value, (SELECT count(*) FROM k WHERE k.column_name = a.column_name AND k.value = a.value AND k.x = t.x), t.x
 FROM a, (SELECT DISTINCT x FROM k) t WHERE a.column_name <> 'patch_type'""")
def a25(spark, d):
    return R.inventory(V.docs(spark, d), ("region", "source", "category", "patch_type", "doc_id"))


@query("a26_split_counts", """SELECT split, region, patch_type, CAST(grouping(split) * 4 + grouping(region) * 2 + grouping(patch_type) AS BIGINT) AS level, count(*) AS n
 FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM docs) GROUP BY GROUPING SETS ((split), (split, region), (split, patch_type), (split, region, patch_type))""")
def a26(spark, d):
    return R.split_counts(V.docs(spark, d).withColumn("split", F.expr("CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END")))


@query("a29_mask_counts", """SELECT count(*) FILTER (c = 1) AS n_positive, count(*) FILTER (c <> 255) AS n_valid,
 round(count(*) FILTER (c = 1) / greatest(count(*) FILTER (c <> 255), 1), 6) AS share, round(count(*) FILTER (c = 1) * 100.0 / 1e6, 6) AS area_km2
 FROM (SELECT CASE WHEN value < -0.2 THEN 255 WHEN value >= 0.1 THEN 1 ELSE 0 END AS c FROM pixels)""")
def a29(spark, d):
    from bermline.operators.rasters import classify, mask_counts
    p = V.pixels(spark, d).withColumn("prob", F.when(F.col("value") >= -0.2, F.col("value")))
    return rounded(mask_counts(classify(p, 0.1)))


@query("a30_five_numbers", " UNION ALL ".join(
    f"SELECT flag, '{c}' AS column_name, count({c}) AS n, round(min({c}), 6) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS med, "
    f"round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS hi, max({c}) - min({c}) <= 1e-9 AS constant FROM points GROUP BY 1" for c in ("h", "price")))
def a30(spark, d):
    return rounded(M.five_numbers(V.points(spark, d), ("h", "price"), ("flag",)))


@query("a31_binned_median", """SELECT (b + 0.5) * 500.0::DOUBLE AS mid, n, round(m, 6) AS median FROM (SELECT CAST(floor(price / 500.0) AS BIGINT) AS b, count(h) AS n, quantile_cont(h, 0.5) AS m
 FROM points GROUP BY 1) WHERE n >= 15""")
def a31(spark, d):
    return rounded(R.binned_median(V.points(spark, d), "price", "h", 500.0))


@query("a32_prominence_sweep", f"""SELECT t AS threshold, count(*) AS n_selected, {rb('diff')} FROM (SELECT dz AS prom, h - canopy AS diff FROM points) p,
 (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.5), (1.5), (2.5), (3.5)) _t(t)) WHERE prom >= t AND prom <= 5.0 GROUP BY 1""")
def a32(spark, d):
    p = V.points(spark, d).selectExpr("dz AS prom", "h - canopy AS diff")
    return rounded(R.prominence_sweep(p, (0.5, 1.5, 2.5, 3.5), cap=5.0))


@query("a32_threshold_flags", """SELECT count(*) FILTER (dz BETWEEN 0.5 AND 5.0) AS sel_050, count(*) FILTER (dz BETWEEN 1.5 AND 5.0) AS sel_150, count(*) AS n FROM points""")
def a32f(spark, d):
    p = R.threshold_flags(V.points(spark, d).withColumnRenamed("dz", "prom"), (0.5, 1.5), 5.0)
    return p.agg(F.count_if("sel_050").alias("sel_050"), F.count_if("sel_150").alias("sel_150"), F.count(F.lit(1)).alias("n"))


@query("a34_best_epoch", """WITH h AS (SELECT event_type AS run, CAST(epoch_us(date_trunc('day', ts)) // 86400000000 - 19723 AS BIGINT) AS epoch, round(avg(value), 6) AS val_score FROM events GROUP BY 1, 2)
 SELECT run, n_epochs, epoch, val_score FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n_epochs, row_number() OVER (PARTITION BY run ORDER BY val_score DESC, epoch) AS rn FROM h) WHERE rn = 1""")
def a34(spark, d):
    t = V.tracks(spark, d)
    h = t.groupBy(F.col("beam").alias("run"), F.floor(F.unix_micros("ts") / 86400000000 - 19723).alias("epoch")).agg(F.round(F.avg("h"), 6).alias("val_score"))
    return M.best_epoch(h, by=("run",))


@query("a36_micro_by_category", f"SELECT *, {metric_sql('1e-9')} FROM (SELECT category, count(*) AS n, {SUMS} FROM results WHERE category IN ('M', 'L') GROUP BY 1)")
def a36(spark, d):
    return rounded(M.micro_by_category(V.results(spark, d)))


@query("a37_height_summary", """SELECT beam, count(h) AS n, min(h) AS h_min, max(h) AS h_max, round(avg(h), 6) AS h_mean, round(stddev_samp(h), 6) AS h_std FROM tracks GROUP BY 1""")
def a37(spark, d):
    return rounded(R.height_summary(V.tracks(spark, d), "h", ("beam",)))


@query("a38_key_coverage", """SELECT count(*) AS n_total, count(quality) AS n_with, count(*) - count(quality) AS n_missing,
 (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 5)) AS sample_ids
 FROM documents LEFT JOIN labels USING (doc_id)""")
def a38(spark, d):
    x = V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left")
    return R.key_coverage(x, "quality", "doc_id")


@query("l1_order_desc", "SELECT comid, uparea FROM reaches")
def l1(spark, d):
    return M.order_desc(V.reaches(spark, d).select("comid", "uparea"), ["uparea"], ["comid"])


@query("l2_top_n_by_sum", "SELECT line_id, round(sum_len, 6) AS sum_len FROM (SELECT comid // 10 AS line_id, sum(price) AS sum_len FROM points GROUP BY 1) ORDER BY sum_len DESC, line_id LIMIT 3")
def l2(spark, d):
    p = V.points(spark, d).selectExpr("comid div 10 AS line_id", "price AS len")
    return rounded(M.top_n_by_sum(p, "line_id", "len"), "sum_len")


@query("l4_ranked", "SELECT comid, uparea, row_number() OVER (ORDER BY uparea DESC, comid) AS rank FROM reaches")
def l4(spark, d):
    return M.ranked(V.reaches(spark, d).select("comid", "uparea"), "uparea", ["comid"])


@query("l5_thin_curve", f"""WITH {_CUM} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM c)
 WHERE (rn - 1) % greatest(1, n // 200) = 0""")
def l5(spark, d):
    return rounded(M.thin_curve(M.pr_curve(scored(spark, d)).select("score", "precision", "recall"), ["score"]))
