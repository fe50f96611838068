"""Ordered scans and quantiles on groups where one key holds most of the rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bermline.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 40_000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c", None], n))
    t = np.round(rng.random(n) * 1000, 3)
    v = np.where(rng.random(n) < 0.5, np.round(rng.normal(0, 3, n), 1), rng.normal(200, 0.01, n))
    pdf = pd.DataFrame({"g": g, "id": range(n), "t": t, "v": v})
    pdf.loc[rng.random(n) < 0.02, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()
    return df, pdf


def test_quantiles_match_numpy(skewed):
    df, pdf = skewed
    probs = (0.0, 0.02, 0.2, 0.5, 0.8, 0.98, 1.0)
    got = {r["g"]: r for r in O.quantiles(df, ("g",), "v", probs).collect()}
    assert len(got) == 5
    for k, part in pdf.assign(g=pdf.g.where(pdf.g.notna(), "none")).groupby("g"):
        r = got[None if k == "none" else k]
        x = part.v.dropna()
        assert r["n"] == len(x)
        np.testing.assert_allclose(r["q"], np.quantile(x, probs), rtol=0, atol=1e-9)


def test_quantiles_many_probs_and_bounded(skewed):
    df, pdf = skewed
    qs = [0.005 + 0.99 * k / 199 for k in range(200)]
    r = O.quantiles(df, (), "v", qs).first()
    np.testing.assert_allclose(r["q"], np.quantile(pdf.v.dropna(), qs), atol=1e-9)
    b = O.quantiles(df, ("g",), "v", (0.3,), bounded=True).filter("g = 'hot'").first()
    np.testing.assert_allclose(b["q"][0], np.quantile(pdf.v[pdf.g == "hot"].dropna(), 0.3), atol=1e-9)


def test_quantiles_without_broadcast(skewed, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(O, "literal_table", lambda d, limit=0: (d, False))
    r = O.quantiles(df.filter("g IS NOT NULL"), ("g",), "v", (0.25, 0.75)).filter("g = 'hot'").first()
    np.testing.assert_allclose(r["q"], np.quantile(pdf.v[pdf.g == "hot"].dropna(), (0.25, 0.75)), atol=1e-9)


def test_quantiles_all_null(spark):
    d = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in O.quantiles(d, ("g",), "v", (0.5,)).collect()}
    assert got == {"a": None, "b": [1.0]}


def test_running_totals_and_previous(skewed):
    df, pdf = skewed
    d = df.filter("g IS NOT NULL").withColumn("w", (F.col("id") % 7).cast("double"))
    run = O.running_totals(d, ["g"], ["t", "id"], {"cum": "w"})
    run = O.previous_values(run, ["g"], ["t", "id"], {"prev": "id"}).select("id", "cum", "prev").toPandas().set_index("id").sort_index()
    p = pdf[pdf.g.notna()].sort_values(["t", "id"])
    cum = (p["id"] % 7).groupby(p["g"]).cumsum()
    prev = p.groupby("g")["id"].shift()
    np.testing.assert_allclose(run["cum"], cum.sort_index())
    np.testing.assert_array_equal(run["prev"].fillna(-1), prev.sort_index().fillna(-1))


def test_row_numbers_descending(skewed):
    df, pdf = skewed
    got = O.row_numbers(df.select("id", "t"), [], ["t", "id"], descending=True).toPandas().sort_values("rn")
    want = pdf.sort_values(["t", "id"], ascending=False)["id"].tolist()
    assert got["id"].tolist() == want and got["rn"].tolist() == list(range(1, len(want) + 1))


def test_hashed_rank_is_a_permutation_per_group(skewed):
    df, _ = skewed
    d = O.hashed_rank(df.withColumn("u", O.uniform_hash("id")), ["g"], "u", ["id"]).toPandas()
    for _, p in d.groupby("g", dropna=False):
        assert sorted(p["rank"]) == list(range(1, len(p) + 1)) and (p["total"] == len(p)).all()
        assert p.sort_values("rank")["u"].is_monotonic_increasing


def test_hot_key_is_spread(skewed):
    """No task of the window stage sees more than a small part of the hot key."""
    df, _ = skewed
    d = O._bucketed(df, ["t"], 16).filter("g = 'hot'").groupBy("_b").count().toPandas()
    assert len(d) == 16 and d["count"].max() < d["count"].sum() / 8


def test_buckets_grow_with_the_shuffle_width(skewed):
    df, _ = skewed
    conf, key = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    try:
        conf.set(key, "6000")
        assert O.bucket_count(df) == O.bucket_count(df, 1024) == 8192
        conf.set(key, "20")
        assert O.bucket_count(df) == 32 and O.bucket_count(df, 1024) == 1024
    finally:
        conf.set(key, before)
