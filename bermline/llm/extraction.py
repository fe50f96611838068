"""Main text of pages: a tree-structured graphical model over the elements of a page.

Every element is content or not. Its own evidence (tag, names, text) gives a potential for each state, and every
parent-child pair one for each combination of states, by the child's tag. Sum-product messages go from the leaves to the
root and back, and give the exact probability of each element's state; texts of elements that are likelier content than
not are kept. All potentials are smoothed counts over labelled pages.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.dom import attributes, read_page
from bermline.llm.labelled_pages import labelled_page

PAGES = 1500  # labelled pages of the default fit
SMOOTHING = 0.3
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def name_features(tag: str, attrs: str) -> tuple[str, ...]:
    """Evidence from an element's start tag."""
    out = [f"tag {tag}"]
    if attrs and not attrs.isspace():
        told = attributes(attrs)
        for key in ("class", "id", "role", "itemprop", "aria-label"):
            out += [f"name {x.lower()}" for x in _NAMES.findall(told.get(key, ""))]
        if "hidden" in told.get("style", "") or "display:none" in told.get("style", "").replace(" ", ""):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


def text_features(page) -> list[str]:
    """For each element: how much text stands in it, and how much of that in links (both in classes)."""
    n = len(page.tags)
    own, linked = [0] * n, [0] * n
    for owner, _, text in page.texts:
        own[owner] += len(text.split())
    total = own[:]
    for k in range(n - 1, 0, -1):
        if page.tags[k] == "a":
            linked[k] = total[k]
        total[page.parents[k]] += total[k]
        linked[page.parents[k]] += linked[k]
    size = lambda x: min(x.bit_length() // 2, 4)
    return [f"text {size(o)} {size(t)} {min(4 * l // t, 3) if t else 0}" for o, t, l in zip(own, total, linked)]


def count_page(html: str) -> Counter:
    """Counts of (kind, evidence, state or states) on a labelled page; elements without a label above them are skipped."""
    page, out = read_page(html), Counter()
    labels: list[int | None] = [None]
    for k in range(1, len(page.tags)):
        told = attributes(page.attrs[k]).get("data-label") if "data-label" in page.attrs[k] else None
        labels.append(int(told) if told in ("0", "1") else labels[page.parents[k]])
    for k, text in enumerate(text_features(page)):
        y = labels[k]
        if y is None:
            continue
        out["state", "", str(y)] += 1
        for f in (*name_features(page.tags[k], page.attrs[k]), text):
            out["own", f, str(y)] += 1
        above = labels[page.parents[k]]
        if above is not None:
            out["pair", page.tags[k], f"{above}{y}"] += 1
            out["pair", "", f"{above}{y}"] += 1
    return out


class TreeModel:
    """Log potentials of single elements and of parent-child pairs."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        states = [counts.get(("state", "", str(y)), 0) + 1.0 for y in (0, 1)]
        self.own: dict[str, tuple[float, float]] = {}
        for kind, f, _ in counts:
            if kind == "own" and f not in self.own:
                self.own[f] = tuple(math.log((counts.get(("own", f, str(y)), 0) + SMOOTHING) / (states[y] + 2 * SMOOTHING)) for y in (0, 1))
        self.pairs: dict[str, np.ndarray] = {}
        for tag in {f for kind, f, _ in counts if kind == "pair"} | {""}:
            c = np.array([[counts.get(("pair", tag, f"{a}{b}"), 0) + SMOOTHING for b in (0, 1)] for a in (0, 1)])
            self.pairs[tag] = np.log(c / c.sum(axis=1, keepdims=True)) - np.log(np.array(states) / sum(states))
        self.prior = np.log(np.array(states) / sum(states))
        self._cache: dict[tuple[str, str], tuple[float, float]] = {}

    def evidence(self, tag: str, attrs: str) -> tuple[float, float]:
        key = (tag, attrs)
        if key not in self._cache:
            if len(self._cache) > 50_000:
                self._cache.clear()
            known = [self.own[f] for f in name_features(tag, attrs) if f in self.own]
            self._cache[key] = (sum(x[0] for x in known), sum(x[1] for x in known))
        return self._cache[key]

    def marginals(self, pages: list) -> list[np.ndarray]:
        """Probability that each element is content, for several pages at once: two passes over the levels of the trees."""
        own, parent, level, tag, first = [], [], [], [], []
        for page in pages:
            base = len(own)
            first.append(base)
            text = text_features(page)
            for k, (t, a, p) in enumerate(zip(page.tags, page.attrs, page.parents)):
                x, y = self.evidence(t, a), self.own.get(text[k], (0.0, 0.0))
                own.append((x[0] + y[0], x[1] + y[1]))
                parent.append(base + p if k else -1)
                level.append(level[base + p] + 1 if k else 0)
                tag.append(t)
        if not own:
            return []
        up = np.array(own) + self.prior
        parent, level = np.array(parent), np.array(level)
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tag))}
        table = np.stack([self.pairs.get(t, self.pairs[""]) for t in kinds])
        pair = table[[kinds[t] for t in tag]]
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(level.max() + 2))
        message = np.zeros((len(up), 2))
        for d in range(len(bounds) - 2, 0, -1):  # leaves to root
            at = order[bounds[d] : bounds[d + 1]]
            message[at] = np.logaddexp(pair[at, :, 0] + up[at, 0:1], pair[at, :, 1] + up[at, 1:2])
            np.add.at(up, parent[at], message[at])
        belief = up.copy()
        for d in range(1, len(bounds) - 1):  # root to leaves
            at = order[bounds[d] : bounds[d + 1]]
            rest = belief[parent[at]] - message[at]
            belief[at] += np.logaddexp(pair[at, 0] + rest[:, 0:1], pair[at, 1] + rest[:, 1:2])
        share = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return np.split(share, first[1:])


def main_text(page, content: np.ndarray) -> str:
    """Texts of content elements: one line a block, white space inside it one blank."""
    out: list[str] = []
    last = -1
    for owner, block, text in page.texts:
        if content[owner] > 0.5:
            if block != last:
                out.append("")
                last = block
            out[-1] += text
    lines = (_BLANK.sub(" ", unescape(x)).strip(" ") for x in out)
    return "\n".join(x for x in lines if x)


def fit_extractor(spark: SparkSession, labelled: DataFrame | None = None, html: str = "html") -> TreeModel:
    """Count labelled pages (``data-label`` attributes); by default ``PAGES`` pages of the grammar. Only counts reach the driver."""
    if labelled is None:
        def make(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([labelled_page(k) for k in b.column(0).to_pylist()])], names=["html"])
        labelled, html = spark.range(PAGES, numPartitions=4).mapInArrow(make, "html string"), "html"

    def count(batches):
        total = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                total.update(count_page(x or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "f", "y", "n"])
    rows = labelled.select(html).mapInArrow(count, "kind string, f string, y string, n long").groupBy("kind", "f", "y").agg(F.sum("n").alias("n")).collect()
    return TreeModel({(r["kind"], r["f"], r["y"]): r["n"] for r in rows})


def extract(pages: DataFrame, model: TreeModel, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the page) with ``text``, the main text of the whole page; null counts as empty.

    An input column named ``text`` is replaced.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c != "text" and (keep is not None or c != html)]

    def run(batches):
        for b in batches:
            source, out = b.column(b.num_columns - 1), []
            for a in range(0, len(source), 128):
                read = [read_page(x or "") for x in source.slice(a, 128).to_pylist()]
                out += [main_text(p, m) for p, m in zip(read, model.marginals(read))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "text"])
    slim = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType())]))
