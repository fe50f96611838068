"""Graph operators: outlets of a river network, components, greedy scene groups."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bermline.operators.ordered import running_totals
from bermline.session import cut_lineage, drop_cut

PIECE_CELLS = 1_000_000  # scene cells that one task puts in order


def trace_outlets(reaches: DataFrame, id: str = "comid", next: str = "next_down") -> DataFrame:
    """Terminal reach of every reach: columns ``id, basin_id``.

    A reach ends where its pointer is missing, <= 0 or leaves the set; the
    reaches of a cycle share its smallest id. Pointers double every round
    (next <- next(next)), so the rounds grow with the logarithm of the river
    length. Every join is on a unique key; a pointer shared by many reaches is
    one row on the build side.
    """
    ids = reaches.select(F.coalesce(F.col(id).try_cast("bigint"), F.lit(-1)).alias("id"),
                         F.coalesce(F.col(next).try_cast("bigint"), F.lit(-1)).alias("nxt"))
    ids = ids.groupBy("id").agg(F.max("nxt").alias("nxt"))
    known = ids.select(F.col("id").alias("_k"))
    start = ids.join(known, (F.col("nxt") == F.col("_k")) & (F.col("nxt") > 0), "left").select(
        "id", F.coalesce("_k", "id").alias("ptr"))
    # low: smallest id met so far, needed only for cycles; open: the pointer has not come to rest
    cur = cut_lineage(start.select("id", "ptr", F.least("id", "ptr").alias("low"), (F.col("id") != F.col("ptr")).alias("open")))
    n, rounds = cur.count(), 0
    while not cur.filter("open").isEmpty():
        # open after more than n steps: in a cycle or behind one
        if 2 ** rounds > 2 * n:
            break
        rounds += 1
        hop = cur.select(F.col("id").alias("_i"), F.col("ptr").alias("_p"), F.col("low").alias("_l"), F.col("open").alias("_o"))
        moved = cur.filter("open").join(hop, F.col("ptr") == F.col("_i")).select(
            "id", F.col("_p").alias("ptr"), F.least("low", "_l").alias("low"), F.col("_o").alias("open"))
        last, cur = cur, cut_lineage(cur.filter("NOT open").unionByName(moved))
        drop_cut(last)
    # a pointer that stands on a cycle: the low value of that node covers the whole cycle
    low = cur.filter("open").select(F.col("id").alias("_i"), F.col("low").alias("_cl"))
    done = cur.join(low, F.col("ptr") == F.col("_i"), "left")
    return done.select(F.col("id").alias(id), F.when(F.col("open"), F.col("_cl")).otherwise(F.col("ptr")).alias("basin_id"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b`` pairs: ``id, component`` (smallest id), by alternating star contraction.

    Each round is two aggregations and two joins on vertex keys: no neighbour
    list is ever collected, so a vertex of any degree is fine. The planner takes
    vertices for as small as the file they come from and would broadcast them
    all, so the joins here and in ``list_order`` ask for a shuffle.
    """
    vertices = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e)
    while True:  # ends when a round changes nothing; the rounds grow with the logarithm of the size
        # large star: every neighbour larger than u is connected to the smallest neighbour of u (or u itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are connected to the smallest of them
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m2.select("u", F.col("m").alias("v")))
        new = cut_lineage(small.filter("u <> v").distinct())
        if new.count() == e.count() and new.join(e.hint("merge"), ["u", "v"], "left_anti").isEmpty():
            drop_cut(new)
            break
        drop_cut(e)
        e = new
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(root.hint("merge"), F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index joined to each of ``n`` indices by the edges ``a, b``, inside a task: labels are hooked to the smaller
    one and pointers doubled until no edge joins two labels."""
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            return lab
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _greedy_in_task(pdf: pd.DataFrame, scene: str) -> pd.DataFrame:
    """Scenes of one piece in the order of their new cells ``n``, largest first, smallest id on ties, until nothing is gained."""
    cell = pdf.groupby(["cx", "cy"], sort=False).ngroup().to_numpy()
    code, names = pd.factorize(pdf[scene], sort=True)
    gain, free = np.bincount(code), np.ones(cell.max() + 1, bool)
    groups = lambda key, value: np.split(value[np.argsort(key, kind="stable")], np.cumsum(np.bincount(key))[:-1])
    cells, holders, out = groups(code, cell), groups(cell, code), []
    while gain.any():
        k = int(gain.argmax())
        new = cells[k][free[cells[k]]]
        out.append((names[k], len(new)))
        free[new] = False
        np.subtract.at(gain, np.concatenate([holders[c] for c in new]), 1)
    return pd.DataFrame(out, columns=[scene, "n"])


def _greedy_in_rounds(free: DataFrame, scene: str) -> DataFrame | None:
    """As ``_greedy_in_task`` over all rows: each round takes every scene that is ahead of all others in each of its free cells,
    as nothing that is picked before can take a cell from it."""
    out = None
    while not free.isEmpty():
        gain = free.groupBy(scene).agg(F.count(F.lit(1)).alias("n"))
        ranked = free.join(gain.hint("merge"), scene).withColumn("_r", F.struct((-F.col("n")).alias("n"), F.col(scene).alias("s")))
        best = ranked.groupBy("cx", "cy").agg(F.min("_r").alias("_best"))
        won = ranked.join(best.hint("merge"), ["cx", "cy"]).groupBy(scene, "n").agg(F.every(F.col("_r") == F.col("_best")).alias("_won")).filter("_won")
        won = cut_lineage(won.select(scene, "n"))
        out = won if out is None else out.unionByName(won)
        free = cut_lineage(free.join(free.join(won.hint("merge"), scene, "left_semi").select("cx", "cy").hint("merge"), ["cx", "cy"], "left_anti"))
    return out


def coverage_groups(scene_cells: DataFrame, aoi_cells: DataFrame, min_coverage: float = 0.93, scene: str = "scene_id") -> DataFrame:
    """Greedy groups of scenes that each cover the area: ``scene, grp, step, coverage, accepted``.

    The next scene is the one with the largest new area (smallest id on ties);
    a group closes at ``min_coverage`` or when nothing is gained. Groups below
    the limit are marked not accepted.

    Scenes in pieces that share no cell don't change each other's gains, and the gains of a piece never rise. So the order
    of all is that of the pieces, merged by gain and id, and a group is its beginning: a few jobs for each group, none for
    each scene. A piece of more than PIECE_CELLS scene cells is put in order by joins instead of inside a task. The cells are
    many times the scenes that the planner goes by, so no join broadcasts them.
    """
    aoi = aoi_cells.select("cx", "cy").distinct()
    total = aoi.count()
    kind = scene_cells.schema[scene].dataType.simpleString()
    pool = cut_lineage(scene_cells.select(scene, "cx", "cy").distinct().join(aoi.hint("merge"), ["cx", "cy"], "left_semi"))
    first = pool.groupBy("cx", "cy").agg(F.min(scene).alias("a"))
    parts = components(pool.join(first.hint("merge"), ["cx", "cy"]).select("a", F.col(scene).alias("b")).distinct()).select(F.col("id").alias(scene), F.col("component").alias("_piece"))
    parts = cut_lineage(parts)
    size = pool.join(parts.hint("merge"), scene).groupBy("_piece").agg((F.count(F.lit(1)) > PIECE_CELLS).alias("_large"))
    last, pool = pool, cut_lineage(pool.join(parts.join(size.hint("merge"), "_piece").hint("merge"), scene))
    drop_cut(last)
    drop_cut(parts)
    any_large = not pool.filter("_large").isEmpty()
    need, taken = min_coverage * total, []
    while total:
        order = pool.filter("NOT _large").groupBy("_piece").applyInPandas(lambda pdf: _greedy_in_task(pdf, scene), f"{scene} {kind}, n long")
        large = _greedy_in_rounds(pool.filter("_large").select(scene, "cx", "cy"), scene) if any_large else None
        order = cut_lineage((order if large is None else order.unionByName(large)).withColumns({"_less": -F.col("n"), "_one": F.lit(1).cast("long")}))
        members = cut_lineage(running_totals(order, [], ["_less", scene], {"_sum": "n", "_k": "_one"}).filter(F.col("_sum") - F.col("n") < need))
        covered = members.agg(F.sum("n")).first()[0]
        if covered is None:
            break
        taken.append(members.select(scene, F.lit(len(taken)).alias("grp"), (F.col("_k") - 1).cast("int").alias("step"),
                                    F.lit(covered / total).alias("coverage"), F.lit(covered >= need).alias("accepted")))
        drop_cut(order)
        last, pool = pool, cut_lineage(pool.join(members.select(scene).hint("merge"), scene, "left_anti"))
        drop_cut(last)
        if pool.isEmpty():
            break
    if not taken:
        return scene_cells.sparkSession.createDataFrame([], f"{scene} {kind}, grp int, step int, coverage double, accepted boolean")
    return reduce(DataFrame.unionByName, taken)


def union_aligned(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def coalesce_columns(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    return df.withColumn("_o", F.coalesce(first, second)).drop(first, second).withColumnRenamed("_o", out)


def matching_round(pairs: DataFrame) -> DataFrame:
    """Pairs that a greedy matching of ``a, b, gap`` (different rows) takes, as far as one round can tell.

    A pair that is the best of both its ends is what the greedy order would take. A pair that is the best of one end and
    the second of the other depends on one pair alone, the other end's best: it is taken exactly if that one is not. Such
    pairs form lists that end at a pair sure to be taken, so the parity of the place decides all of them in one round,
    however long a list is. Only the first two pairs of an end are shuffled, tasks leave the others out before.
    """
    ends = pairs.select(F.struct("gap", "a", "b").alias("o"), F.explode(F.array_distinct(F.array("a", "b"))).alias("e"))
    so_far = W.partitionBy("e").orderBy("o").rowsBetween(W.unboundedPreceding, W.currentRow)
    two = ends.withColumns({"place": F.row_number().over(so_far), "best": F.first("o").over(so_far)}).filter("place <= 2")
    one = two.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("ahead"), F.max(F.when(F.col("place") == 2, F.col("best"))).alias("nxt"))
    links = one.filter("n = IF(o.a = o.b, 1, 2) AND ahead - n <= 1").select(F.col("o").alias("id"), "nxt")
    # lists that lead to a pair with more ahead of it are not decided in this round: list_order leaves them out
    return list_order(links).filter("hops % 2 = 0").select("id.a", "id.b", "id.gap")


def mutual_matching(pairs: DataFrame) -> DataFrame:
    """Greedy matching of ``a, b, gap`` (shortest gap first, ids break ties), each end used once: rounds of
    ``matching_round`` until no pair is left."""
    p = cut_lineage(pairs.select("a", "b", "gap").distinct())
    taken = []
    while not p.isEmpty():
        taken.append(cut_lineage(matching_round(p)))
        used = taken[-1].select(F.explode(F.array("a", "b")).alias("e")).distinct().hint("merge")
        last, p = p, cut_lineage(p.join(used, F.col("a") == F.col("e"), "left_anti").join(used, F.col("b") == F.col("e"), "left_anti"))
        drop_cut(last)
    return reduce(DataFrame.unionByName, taken) if taken else p


def list_order(links: DataFrame, value: str | None = None) -> DataFrame:
    """Positions in singly linked lists: ``id, nxt`` (NULL at the end) -> ``id, last, hops`` (and ``total`` of ``value``
    from the node to the end, the node included). Pointer doubling; nodes on cycles are left out.
    """
    v = F.col(value).cast("double") if value else F.lit(0.0)
    cur = links.select("id", F.col("nxt").alias("ptr"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("hops"), v.alias("total"),
                       F.when(F.col("nxt").isNull(), F.col("id")).alias("last"))
    cur = cut_lineage(cur)
    n = cur.count()
    k = 0
    while not cur.filter("ptr IS NOT NULL").isEmpty() and 2 ** k <= 2 * max(n, 1):  # what is open then is on a cycle
        k += 1
        hop = cur.select(F.col("id").alias("_i"), F.col("ptr").alias("_p"), F.col("hops").alias("_h"), F.col("total").alias("_t"), F.col("last").alias("_l"))
        nxt = cur.filter("ptr IS NOT NULL").join(hop.hint("merge"), F.col("ptr") == F.col("_i")).select(
            "id", F.col("_p").alias("ptr"), (F.col("hops") + F.col("_h")).alias("hops"), (F.col("total") + F.col("_t")).alias("total"), F.col("_l").alias("last"))
        last, cur = cur, cut_lineage(cur.filter("ptr IS NULL").unionByName(nxt))
        drop_cut(last)
    return cur.filter("ptr IS NULL").select("id", "last", "hops", "total")


__all__ = ["trace_outlets", "components", "coverage_groups", "union_aligned", "coalesce_columns", "matching_round", "mutual_matching", "list_order"]
