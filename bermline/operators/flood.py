"""Inputs and results of paired flood runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bermline.operators.ordered import quantiles

RUN_KEYS = {"x0": "double", "y0": "double", "dx": "double", "dy": "double", "mmax": "int", "nmax": "int"}


def parse_run_config(texts: DataFrame, default_epsg: int = 2180) -> DataFrame:
    """run, text of ``key = value`` lines -> one typed row; ``missing`` lists absent required keys."""
    raw = {k: F.nullif(F.regexp_extract("text", rf"(?m)^\s*{k}\s*=\s*(\S+)", 1), F.lit("")) for k in [*RUN_KEYS, "epsg"]}
    d = texts.select("run", *[v.alias(f"_{k}") for k, v in raw.items()])
    missing = F.filter(F.array(*[F.when(F.col(f"_{k}").isNull(), k) for k in RUN_KEYS]), lambda v: v.isNotNull())
    return d.select("run", *[F.col(f"_{k}").try_cast(t).alias(k) for k, t in RUN_KEYS.items()],
                    F.coalesce(F.col("_epsg").try_cast("int"), F.lit(default_epsg)).alias("epsg"),
                    F.array_join(missing, ",").alias("missing"))


def total_inflow(lines: DataFrame) -> DataFrame:
    """run, line_no, line -> q_in: sum of all but the first number of the last line with two or more numbers."""
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda s: s != "")
    d = lines.select("run", "line_no", F.transform(parts, lambda s: s.try_cast("double")).alias("_v"))
    d = d.filter((F.size("_v") >= 2) & ~F.exists("_v", lambda v: v.isNull()))
    d = d.groupBy("run").agg(F.max_by("_v", "line_no").alias("_v"))
    return d.select("run", F.aggregate(F.slice("_v", F.lit(2), F.size("_v") - 1), F.lit(0.0), lambda s, v: s + v).alias("q_in"))


def check_weirs(lines: DataFrame, extent: Sequence[float]) -> DataFrame:
    """Blocks, vertices, bad rows, ranges, vertices inside the bounds, and inside with x and y swapped. Per file."""
    xmin, ymin, xmax, ymax = extent
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda s: s != "")
    d = lines.select("file", parts.alias("_p")).withColumn("_v", F.transform("_p", lambda s: s.try_cast("double")))
    four = F.size("_p") == 4
    good = four & ~F.exists("_v", lambda v: v.isNull())
    x, y, z = (F.when(good, F.col("_v")[k]) for k in range(3))
    return d.groupBy("file").agg(
        F.count_if((F.size("_p") == 1)).alias("n_blocks"), F.count_if(good).alias("n_vertices"), F.count_if(four & ~good).alias("n_bad"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.min(z).alias("z_min"), F.max(z).alias("z_max"),
        F.count_if(x.between(xmin, xmax) & y.between(ymin, ymax)).alias("n_inside"),
        F.count_if(y.between(xmin, xmax) & x.between(ymin, ymax)).alias("n_inside_swapped"))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (empty means valid)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``; raise when a key occurs twice."""
    bad = assert_unique(df, keys).head(1)
    if bad:
        raise ValueError(f"{list(keys)} must be unique, found {bad[0].asDict()}")
    return df


def constant_series(points: DataFrame, t0: str, hours: int, id_col: str = "index", q: str = "q_rp100") -> DataFrame:
    """Constant hourly values from t0 (``yyyyMMdd HHmmss``) to t0 + hours, both included."""
    start = F.to_timestamp(F.lit(t0), "yyyyMMdd HHmmss")
    times = F.sequence(start, start + F.expr(f"INTERVAL {int(hours)} HOURS"), F.expr("INTERVAL 1 HOUR"))
    return points.select(F.explode(times).alias("time"), F.col(id_col).cast("long").alias("point_id"), F.col(q).cast("double").alias("q"))


def wide_series(series: DataFrame, ids: Sequence[int]) -> DataFrame:
    """One column per (named) point id."""
    return series.groupBy("time").pivot("point_id", list(ids)).agg(F.first("q"))


def prepare_levees(levees: DataFrame, domain: DataFrame, size: float = 1000.0, line_id: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Levee pieces inside the domain, split into those with and without crest height ``z``."""
    from bermline.operators.cells import clip_lines

    pieces = clip_lines(levees.select(line_id, "pts"), domain, size, line_id).filter(F.col("len") > 0)
    d = pieces.join(levees.select(line_id, "z"), line_id)
    return d.filter(F.col("z").isNotNull()), d.filter(F.col("z").isNull()).drop("z")


def weir_rows(levees: DataFrame, cd: float = 0.6, line_id: str = "line_id") -> DataFrame:
    """structure, seq, x, y, z, cd and the two-decimal text row; lines with fewer than two vertices drop out."""
    d = levees.filter(F.size("pts") >= 2).select(F.col(line_id).alias("structure"), F.posexplode("pts").alias("seq", "_p"), F.col("z").cast("double").alias("z"))
    d = d.select("structure", "seq", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), "z", F.lit(float(cd)).alias("cd"))
    return d.withColumn("line", F.format_string("%.2f %.2f %.2f %.2f", "x", "y", "z", "cd"))


def depth_grid(cells: DataFrame, min_depth: float = 0.05) -> DataFrame:
    """Depth = zsmax - zb, NULL below ``min_depth``."""
    h = F.col("zsmax") - F.col("zb")
    return cells.withColumn("h", F.when(h >= min_depth, h))


def orient(cells: DataFrame) -> DataFrame:
    """Renumber rows and columns so that x grows with col and y falls with row (transposing if needed)."""
    s = cells.groupBy("run").agg(
        F.covar_pop("x", "col").alias("_xc"), F.covar_pop("x", "row").alias("_xr"), F.covar_pop("y", "col").alias("_yc"),
        F.covar_pop("y", "row").alias("_yr"), F.max("row").alias("_mr"), F.max("col").alias("_mc"))
    d = cells.join(s, "run")
    t = F.abs("_xr") > F.abs("_xc")
    r, c = F.when(t, F.col("col")).otherwise(F.col("row")), F.when(t, F.col("row")).otherwise(F.col("col"))
    mr, mc = F.when(t, F.col("_mc")).otherwise(F.col("_mr")), F.when(t, F.col("_mr")).otherwise(F.col("_mc"))
    yr = F.when(t, F.col("_yc")).otherwise(F.col("_yr"))
    xc = F.when(t, F.col("_xr")).otherwise(F.col("_xc"))
    return (d.withColumn("_r", F.when(yr > 0, mr - r).otherwise(r)).withColumn("_c", F.when(xc < 0, mc - c).otherwise(c))
            .withColumn("row", F.col("_r")).withColumn("col", F.col("_c")).drop("_r", "_c", "_xc", "_xr", "_yc", "_yr", "_mr", "_mc"))


def depth_stats(cells: DataFrame, cell_area: float, min_depth: float = 0.05) -> DataFrame:
    """Wet area, depth maximum and mean, water volume per run."""
    d = depth_grid(cells, min_depth)
    return d.groupBy("run").agg((F.count("h") * cell_area / 1e6).alias("wet_area_km2"), F.max("h").alias("max_depth_m"),
                                F.avg("h").alias("mean_depth_m"), (F.sum("h") * cell_area / 1e6).alias("volume_mil_m3"))


def hourly_series(cells: DataFrame, cell_area: float, min_depth: float = 0.05) -> DataFrame:
    """Wet area and volume per run and hour (wet: depth > min_depth)."""
    h = F.col("zs") - F.col("zb")
    wet = h > min_depth
    return cells.groupBy("run", "hour").agg((F.count_if(wet) * cell_area / 1e6).alias("wet_area_km2"),
                                            (F.sum(F.when(wet, h).otherwise(0.0)) * cell_area / 1e6).alias("volume_mil_m3"))


def align_runs(a: DataFrame, b: DataFrame, config: DataFrame | None = None, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cells of two runs side by side (suffix _b for base, _l for levees), after a same-grid check."""
    if config is not None:
        n = config.select("x0", "y0", "dx", "dy", "mmax", "nmax").distinct().limit(2).count()
        if n != 1:
            raise ValueError("runs are on different grids")
    ra = a.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("h", "zs")])
    rb = b.select(*keys, *[F.col(c).alias(f"{c}_l") for c in ("h", "zs")])
    return ra.join(rb, list(keys), "full")


def compare_runs(aligned: DataFrame, cell_area: float, diff_min: float = 0.05) -> DataFrame:
    """Protected, newly wet and changed area and the level change statistics between two aligned runs."""
    wb, wl = F.col("h_b").isNotNull(), F.col("h_l").isNotNull()
    dz = F.when(wb & wl, F.col("zs_l") - F.col("zs_b"))
    d = aligned.withColumn("_dz", dz).withColumn("_ch", F.when(F.abs(dz) > diff_min, dz))
    km2 = lambda cond: F.count_if(cond) * cell_area / 1e6
    q = quantiles(d, (), "_ch", (0.5,), extra=[
        km2(wb & ~wl).alias("protected_area_km2"), km2(wl & ~wb).alias("newly_wet_area_km2"),
        ((F.count_if(wl) - F.count_if(wb)) * cell_area / 1e6).alias("wet_area_diff_km2"), km2(F.col("_ch").isNotNull()).alias("changed_area_km2"),
        F.min("_dz").alias("dz_min_m"), F.max("_dz").alias("dz_max_m")])
    return q.select("protected_area_km2", "newly_wet_area_km2", "wet_area_diff_km2", "changed_area_km2",
                    F.col("q")[0].alias("dz_median_changed_m"), "dz_min_m", "dz_max_m")


__all__ = ["parse_run_config", "total_inflow", "check_weirs", "assert_unique", "require_unique", "constant_series", "wide_series",
           "prepare_levees", "weir_rows", "depth_grid", "orient", "depth_stats", "hourly_series", "align_runs", "compare_runs"]
