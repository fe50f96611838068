"""Row-level operators: line cutting, classes, filters, profiles, patch arrays, footprints."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.functions import geometry as G
from bermline.operators.ordered import null_safe_join, quantiles, row_numbers


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present, case-insensitive."""
    low = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def drop_empty(df: DataFrame, parts: str = "parts") -> DataFrame:
    return df.filter(F.size(F.coalesce(F.col(parts), F.array().cast(df.schema[parts].dataType))) > 0)


def explode_lines(df: DataFrame, parts: str = "parts", kind: str | None = "kind") -> DataFrame:
    """One row per line part (``part``, ``pts``, ``length_m``); other geometry kinds and zero lengths drop out."""
    if kind and kind in df.columns:
        df = df.filter(F.col(kind).isin("LineString", "MultiLineString"))
    d = df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part", "pts"))
    return d.withColumn("length_m", G.line_length(F.col("pts"))).filter(F.col("length_m") > 0)


def _cut(df: DataFrame, bounds: Column, pts: str = "pts") -> DataFrame:
    """Cut ``pts`` at an array of distances (n + 1 bounds for n pieces)."""
    # vertex distances are computed once per line, before the pieces are exploded
    d = df.withColumn("_ch", G.chains(F.col(pts))).withColumn("_bd", bounds)
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.size("_bd") - 2)).alias("k"))
    d0, d1 = F.element_at("_bd", F.col("k") + 1), F.element_at("_bd", F.col("k") + 2)
    d = d.withColumn("chain0", d0).withColumn("chain1", d1)
    d = d.withColumn(pts, G.substring(F.col(pts), F.col("chain0"), F.col("chain1"), F.col("_ch")))
    return d.withColumn("length_m", F.col("chain1") - F.col("chain0")).drop("_ch", "_bd")


def segment_equal(df: DataFrame, segment: float = 500.0, minimum: float = 100.0, pts: str = "pts") -> DataFrame:
    """n = max(1, round-half-even(L / segment)) equal pieces; lines shorter than ``minimum`` drop out."""
    d = df.withColumn("_L", G.line_length(F.col(pts))).filter((F.col("_L") >= minimum) & (F.col("_L") > 0))
    n = F.greatest(F.lit(1), F.bround(F.col("_L") / segment, 0).cast("int"))
    bounds = F.transform(F.sequence(F.lit(0), n), lambda i: i * (F.col("_L") / n))
    return _cut(d, bounds, pts).drop("_L")


def segment_tail_merge(df: DataFrame, segment: float = 1000.0, tail: float = 0.4, pts: str = "pts") -> DataFrame:
    """Pieces of fixed length; a tail shorter than tail*segment joins the piece before."""
    d = df.withColumn("_L", G.line_length(F.col(pts))).filter(F.col("_L") > 0)
    L = F.col("_L")
    full = F.floor(L / segment).cast("int")
    rest = L - full * segment
    cuts = F.transform(F.sequence(F.lit(0), full), lambda i: i * F.lit(float(segment)))
    bounds = (F.when(L <= segment * (1 + tail), F.array(F.lit(0.0), L))
              .when(rest < tail * segment, F.concat(F.slice(cuts, F.lit(1), full), F.array(L)))
              .otherwise(F.concat(cuts, F.array(L))))
    return _cut(d, bounds, pts).drop("_L")


def densify(df: DataFrame, step: float, mode: str = "step", pts: str = "pts") -> DataFrame:
    """Points along a line. ``step``: every ``step`` from the start; ``even``: max(2, floor(L/step)+1) with both ends."""
    d = df.withColumn("_L", G.line_length(F.col(pts)))
    L = F.col("_L")
    n = F.floor(L / step).cast("int")
    if mode == "even":
        n = F.greatest(F.lit(1), n)
        at = F.transform(F.sequence(F.lit(0), n), lambda i: i * (L / n))
    else:
        at = F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(float(step)))
    d = d.select(*df.columns, F.posexplode(at).alias("k", "at"))
    return d.withColumn("_p", G.interpolate(F.col(pts), F.col("at"))).select(
        *[c for c in df.columns if c != pts], "k", "at", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def perpendicular_profile(df: DataFrame, position: str, length: float = 800.0, step: float = 10.0, pts: str = "pts") -> DataFrame:
    """Samples at offsets -length..length across the line at a position; lines without direction drop out."""
    p, at = F.col(pts), F.col(position)
    d = df.withColumn("_c", G.interpolate(p, at)).withColumn("_a", G.interpolate(p, F.greatest(F.lit(0.0), at - 0.5)))
    d = d.withColumn("_b", G.interpolate(p, F.least(G.line_length(p), at + 0.5)))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    d = d.withColumn("_n", F.hypot(dx, dy)).filter(F.col("_n") > 0).withColumn("_ux", -dy / F.col("_n")).withColumn("_uy", dx / F.col("_n"))
    n = int(round(2 * length / step))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("s")).withColumn("offset", F.col("s") * step - length)
    return d.withColumn("x", F.col("_c.x") + F.col("_ux") * F.col("offset")).withColumn(
        "y", F.col("_c.y") + F.col("_uy") * F.col("offset")).drop("_a", "_b", "_c", "_n", "_ux", "_uy", pts)


def segment_centres(df: DataFrame, pts: str = "pts") -> DataFrame:
    return df.withColumn("_p", G.interpolate(F.col(pts), F.lit(0.5), normalized=True)).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")


# ---- classes and filters --------------------------------------------------------------

def size_class(uparea: Column, large: float = 10000.0) -> Column:
    return F.when(uparea.isNull() | F.isnan(uparea), F.lit(None).cast("string")).when(uparea >= large, "L").otherwise("M")


def bin_class(df: DataFrame, col: str, bins: dict[str, tuple[float, float]], out: str = "category") -> DataFrame:
    """First half-open bin that holds the value; rows outside all bins drop out."""
    e = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(bins.items())):
        e = F.when((F.col(col) >= lo) & (F.col(col) < hi), name).otherwise(e)
    return df.withColumn(out, e).filter(F.col(out).isNotNull())


def select_values(df: DataFrame, col: str, values: Sequence, remove: bool = False) -> DataFrame:
    keep = F.col(col).isin(list(values))
    return df.filter(~F.coalesce(keep, F.lit(False)) if remove else keep)


def in_bounds(df: DataFrame, b: Sequence[float]) -> DataFrame:
    """Rows whose box (xmin..ymax columns) meets the bounds; four comparisons that reach the scan."""
    return df.filter((F.col("xmax") >= b[0]) & (F.col("xmin") <= b[2]) & (F.col("ymax") >= b[1]) & (F.col("ymin") <= b[3]))


# fixed values: names of the two structure types in the national layer
DYKE_KIND = "wal przeciwpowodziowy lub grobla"
BANK_KIND = "nasyp"


def select_reference_levees(df: DataFrame, min_length: float = 1000.0, min_height: float = 2.0, min_width: float = 12.0,
                            dyke: str = DYKE_KIND, bank: str = BANK_KIND) -> DataFrame:
    """All dykes, and banks that are long, high and wide enough; ``source`` names the rule."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    big = (F.col("length_m") >= min_length) & (zero("wysokosc") >= min_height) & (zero("szerKorony") >= min_width)
    source = F.when(F.col("rodzaj") == dyke, "dyke").when((F.col("rodzaj") == bank) & big, "bank")
    return df.withColumn("source", source).filter(F.col("source").isNotNull())


def present(col: Column, fill: float = 1e30) -> Column:
    """NULL for NaN and fill values."""
    return F.when(~F.isnan(col) & (F.abs(col) < fill), col)


def quality_rules(max_unc: float | None = 2.5, min_photons: float | None = 20, cloud: float | None = 1, saturation: bool = True,
                  terrain_flag: bool = False, night: bool = False) -> dict[str, Column]:
    """Named rules; a missing value passes, only the night rule fails on it."""
    r: dict[str, Column] = {}
    if max_unc is not None:
        r["uncertainty"] = F.coalesce(F.col("h_te_uncertainty") <= max_unc, F.lit(True))
    if min_photons is not None:
        r["photons"] = F.coalesce(F.col("n_te_photons") >= min_photons, F.lit(True))
    if cloud is not None:
        r["cloud"] = F.coalesce(F.col("cloud_flag_atm") <= cloud, F.lit(True))
    if saturation:
        r["saturation"] = F.coalesce(F.col("sat_flag") == 0, F.lit(True))
    if terrain_flag:
        r["terrain"] = F.coalesce(F.col("terrain_flg") == 0, F.lit(True))
    if night:
        r["night"] = F.coalesce(F.col("night_flag") == 1, F.lit(False))
    return r


def quality_mask(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    keep = F.lit(True)
    for r in rules.values():
        keep = keep & r
    return df.filter(keep)


def filter_funnel(df: DataFrame, rules: dict[str, Column], sets: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Pass count and share per rule and per named rule set, in one pass."""
    tests = dict(rules)
    for name, members in (sets or {"all": list(rules)}).items():
        t = F.lit(True)
        for m in members:
            t = t & rules[m]
        tests[name] = t
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(t).alias(f"_{k}") for k, t in enumerate(tests.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{k}").alias("passed"), (F.col(f"_{k}") / F.col("_n")).alias("share"))
                     for k, name in enumerate(tests)])
    return agg.select(F.inline(rows))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def quantise(df: DataFrame, col: str, levels: int = 64, by: Sequence[str] = (), out: str = "level") -> DataFrame:
    """Levels 0..levels-1 between the 2nd and 98th percentile of valid values; missing goes to level 0."""
    q = quantiles(df, by, col, (0.02, 0.98)).select(*by, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    d = null_safe_join(df, q, by) if by else df.crossJoin(q)  # one row of bounds
    v = F.least(F.greatest(F.coalesce(F.col(col), F.col("_lo")), F.col("_lo")), F.col("_hi"))
    level = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10) * (levels - 1))
    return d.withColumn(out, F.coalesce(level, F.lit(0))).drop("_lo", "_hi")


def reclassify(df: DataFrame, col: str, mapping: dict, default: float, out: str = "value") -> DataFrame:
    """Class to value: through a literal map, or a join when the class table is large."""
    if len(mapping) > 1000:
        spark = df.sparkSession
        table = spark.createDataFrame([(k, float(v)) for k, v in mapping.items()], "_class double, _to double")
        return df.join(table, F.col(col).cast("double") == F.col("_class"), "left").withColumn(out, F.coalesce("_to", F.lit(float(default)))).drop("_class", "_to")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(col)), F.lit(default)))


# fixed values: land-cover class to Manning roughness
MANNING = {10: 0.12, 20: 0.05, 30: 0.034, 40: 0.04, 50: 0.1, 60: 0.03, 70: 0.03, 80: 0.03, 90: 0.05, 95: 0.07, 100: 0.035}
MANNING_DEFAULT = 0.04


def footprints(df: DataFrame, size: float = 2560.0, x: str = "center_x", y: str = "center_y") -> DataFrame:
    """Square around a centre: box columns and a ring."""
    h = size / 2
    d = df.withColumns({"xmin": F.col(x) - h, "ymin": F.col(y) - h, "xmax": F.col(x) + h, "ymax": F.col(y) + h})
    return d.withColumn("ring", G.bounds_polygon(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def total_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def orbit_direction(text: Column) -> Column:
    u = F.upper(text)
    return F.when(u.contains("ASCENDING"), "ASCENDING").when(u.contains("DESCENDING"), "DESCENDING").otherwise("UNKNOWN")


def thin_uniform(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """k of n rows at positions int(i * n / k); all rows when n <= k."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = row_numbers(df, [], order, "_rn").crossJoin(n)  # one row of totals
    pos = F.col("_rn") - 1
    i = F.ceil(pos * k / F.col("_n"))
    hit = (i < k) & (F.floor(i * F.col("_n") / k) == pos)
    return d.filter((F.col("_n") <= k) | hit).drop("_rn", "_n")


def clean_lines(df: DataFrame, pts: str = "pts") -> DataFrame:
    """Drop repeated vertices; ``changed`` tells where."""
    d = df.withColumn("_p", G.without_repeats(F.col(pts)))
    return d.withColumn("changed", F.size("_p") != F.size(pts)).withColumn(pts, F.col("_p")).drop("_p")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _kept_vertices(xs: pd.Series, ys: pd.Series, tol: pd.Series) -> pd.Series:
    """Indices that Douglas-Peucker keeps, per line."""
    import numpy as np

    def one(x, y, t):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(x)
        keep = np.zeros(n, bool)
        keep[[0, -1]] = True
        stack = [(0, n - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            l2 = dx * dx + dy * dy
            u = np.clip(((x[a + 1:b] - x[a]) * dx + (y[a + 1:b] - y[a]) * dy) / l2, 0, 1) if l2 > 0 else 0.0
            d = np.hypot(x[a + 1:b] - x[a] - u * dx, y[a + 1:b] - y[a] - u * dy)
            m = int(d.argmax())
            if d[m] > t:
                keep[a + 1 + m] = True
                stack += [(a, a + 1 + m), (a + 1 + m, b)]
        return np.flatnonzero(keep).tolist()

    return pd.Series([one(x, y, t) if len(x) > 1 else list(range(len(x))) for x, y, t in zip(xs, ys, tol)])


def simplify_lines(df: DataFrame, tol: float, min_length: float | None = None, pts: str = "pts") -> DataFrame:
    """Simplify, recompute ``length_m`` and drop lines that became too short."""
    d = df.withColumn("_x", F.transform(pts, lambda p: p["x"])).withColumn("_y", F.transform(pts, lambda p: p["y"]))
    d = d.withColumn("_k", _kept_vertices("_x", "_y", F.lit(float(tol))))
    d = d.withColumn(pts, F.transform("_k", lambda i: F.element_at(F.col(pts), i + 1))).drop("_x", "_y", "_k")
    d = d.withColumn("length_m", G.line_length(F.col(pts)))
    return d if min_length is None else d.filter(F.col("length_m") >= min_length)


def close_holes(df: DataFrame, parts: str = "parts") -> DataFrame:
    return df.withColumn(parts, F.slice(parts, 1, 1))


def _hull(x, y):
    """Vertices of the convex hull, counter-clockwise (monotone chain)."""
    pts = sorted(set(zip(x, y)))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def convex_hull(df: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Hull vertices per key in order (``k, x, y``).

    Hulls of parts are combined: first per Arrow batch, then per (key, salt),
    then per key, so only hull vertices travel and no task sees a whole group.
    """
    dt = df.schema[key].dataType.simpleString()
    schema = f"{key} {dt}, x double, y double"

    def local(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, dropna=False):
                h = _hull(g["x"], g["y"])
                yield pd.DataFrame({key: [k] * len(h), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf["x"], pdf["y"])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(h), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = merge(pdf)
        h.insert(1, "k", range(len(h)))
        return h

    d = df.select(key, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(local, schema)
    d = d.withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy(key, "_s").applyInPandas(
        lambda pdf: merge(pdf), schema)
    return d.groupBy(key).applyInPandas(final, f"{key} {dt}, k int, x double, y double")


# ---- patch arrays (row-major, n x n) ------------------------------------------------------

D4 = tuple((flip, k) for flip in (0, 1) for k in range(4))
FLIPS = ("none", "cols", "rows", "both")


def _source_index(i: Column, n: int, flip: int, k: int) -> Column:
    """Index in the input of output cell i for: mirror columns first if flip, then k quarter turns."""
    r, c = F.floor(i / n), i % n
    for _ in range(k):  # one turn: out[r, c] = in[c, n-1-r]
        r, c = c, (n - 1) - r
    if flip:
        c = (n - 1) - c
    return (r * n + c).cast("int")


def turn(arr: Column, n: int, flip: int, k: int) -> Column:
    """Mirror and rotate an n x n array."""
    cells = F.sequence(F.lit(0), F.lit(n * n - 1))
    # the array is bound once through a one-element array; a lambda body would compute it again per cell
    return F.transform(F.array(arr), lambda a: F.transform(cells, lambda i: F.element_at(a, _source_index(i, n, flip, k) + 1)))[0]


def unturn(arr: Column, n: int, flip: int, k: int) -> Column:
    """Inverse of :func:`turn`."""
    back = turn(arr, n, 0, (4 - k) % 4) if k else arr
    return turn(back, n, 1, 0) if flip else back


def mirror(arr: Column, n: int, how: str) -> Column:
    """The four flip transforms; each is its own inverse."""
    if how == "none":
        return arr
    return turn(arr, n, *{"cols": (1, 0), "rows": (1, 2), "both": (0, 2)}[how])


def expand_d4(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Eight rows per patch, one per symmetry (``t`` = 4*flip + turns)."""
    variants = F.array(*[F.struct(F.lit(4 * f + k).alias("t"), *[turn(F.col(c), n, f, k).alias(c) for c in cols]) for f, k in D4])
    d = df.select(*[c for c in df.columns if c not in cols], F.explode(variants).alias("_v"))
    return d.select("*", "_v.t", *[F.col(f"_v.{c}").alias(c) for c in cols]).drop("_v")


def augment(df: DataFrame, cols: Sequence[str], n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Turn each patch by a repeatable random symmetry drawn from its key."""
    t = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(8))
    for c in cols:
        e = F.col(c)
        for f, k in D4[1:]:
            e = F.when(F.col("_t") == 4 * f + k, turn(F.col(c), n, f, k)).otherwise(e)
        df = df.withColumn("_t", t).withColumn(c, e)
    return df.withColumnRenamed("_t", "t")


def tta_average(patches: DataFrame, score: Callable[[Column], Column], n: int, arr: str = "value", mode: str = "d4", out: str = "prob") -> DataFrame:
    """Score every symmetry of a patch, undo it, average per pixel; all inside the row, without a shuffle."""
    x = F.col(arr)
    if mode == "d4":
        parts = [unturn(score(turn(x, n, f, k)), n, f, k) for f, k in D4]
    else:
        parts = [mirror(score(mirror(x, n, h)), n, h) for h in FLIPS]
    names = [f"_p{i}" for i in range(len(parts))]
    d = patches.withColumns(dict(zip(names, parts)))
    total = F.col(names[0])
    for nm in names[1:]:
        total = F.zip_with(total, F.col(nm), lambda a, b: a + b)
    return d.withColumn(out, F.transform(total, lambda v: v / len(parts))).drop(*names)


def normalize_patches(patches: DataFrame, stats: dict[str, tuple[float, float]], channels: str = "channels",
                      eps: float = 1e-6) -> DataFrame:
    """Channel map to normalised arrays: dsm minus its patch median, water untouched, others z-scored. Missing counts as 0."""
    from bermline.operators.windows import array_median

    m = F.create_map(*[x for c, (mu, sd) in stats.items() for x in (F.lit(c), F.struct(F.lit(float(mu)).alias("m"), F.lit(float(sd)).alias("s")))])
    clean = lambda a: F.transform(a, lambda v: F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v.cast("double")), F.lit(0.0)))

    def one(name, arr):
        a = clean(arr)
        s = F.try_element_at(m, name)
        # the median is bound once through a one-element array, not once per pixel
        centred = F.transform(F.array(array_median(a)), lambda med: F.transform(a, lambda v: v - med))[0]
        return (F.when(name == "dsm", centred).when(name == "water", a)
                .otherwise(F.transform(a, lambda v: (v - s["m"]) / (s["s"] + eps))))

    return patches.withColumn(channels, F.transform_values(channels, one))
