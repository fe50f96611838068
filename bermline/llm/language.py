"""Language ID in two steps: language family first, then one-versus-one linear support vector machines inside it.

Features are hashed character n-grams of one to three letters, words set off by a blank, as shares of the text. The
family step and every pair of languages are separate linear SVMs (squared hinge loss, dual coordinate descent), each
fitted in a task of its own on a bounded sample; a text is scored by one product of its features with all weights.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.sampling import bounded_sample, held_out
from bermline.llm.text import mix

DIMENSIONS = 4096
SAMPLE = 600  # texts of each language that are learned from at most
PIECE = 1 << 18  # code points that are hashed at once
COST, PASSES = 20.0, 25
SHARPNESS = 4.0
UNKNOWN = "und"

# Languages of one family by their codes; any other code is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_MULTIPLIERS = mix(np.arange(900, 903, dtype=np.uint64)) | np.uint64(1)


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0], language)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letter_grams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Shares of the hashed 1- to 3-grams of letters in the whole lower-cased text; length 1 (or 0 without a letter)."""
    low = text.lower()
    counts = np.zeros(dimensions)
    for a in range(0, len(low), PIECE):
        piece = low[max(a - 2, 0) : a + PIECE]
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        plain = (c >= 97) & (c <= 122)
        wide = np.flatnonzero(c >= 128)
        if len(wide):
            kinds, back = np.unique(c[wide], return_inverse=True)
            plain[wide] = np.array([chr(int(k)).isalpha() for k in kinds])[back]
        c = np.where(plain, c, np.uint64(32))
        c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        one = c * _MULTIPLIERS[0]
        two = c[:-1] * _MULTIPLIERS[1] + c[1:] * _MULTIPLIERS[0]
        three = c[:-2] * _MULTIPLIERS[2] + two[1:] * np.uint64(31) if len(c) > 2 else two[:0]
        for h in (one[c != 32], two, three):
            if len(h):
                h = h ^ (h >> np.uint64(29))
                counts += np.bincount(((h * _MULTIPLIERS[2]) >> np.uint64(52)).astype(np.int64) % dimensions, minlength=dimensions)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts**2).sum())
    return (counts / norm if norm else counts).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2 / len(y)  # both sides weigh the same
    diagonal = 1 / (2 * cost * np.maximum(share, 1e-6))
    q = (x**2).sum(axis=1) + diagonal
    order = np.argsort(mix(np.arange(len(x), dtype=np.uint64)))
    for _ in range(passes):
        for i in order:
            g = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _fit_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """One machine: rows (task, positive, text) of a bounded sample."""
    pdf = pdf.sort_values(["_order", "_text", "_positive"])
    x = np.stack([letter_grams(t) for t in pdf["_text"]])
    w = fit_svm(x, np.where(pdf["_positive"], 1.0, -1.0))
    return pd.DataFrame({"_task": [pdf["_task"].iloc[0]], "_weights": [w.astype(np.float32).tolist()]})


class LanguageModel:
    """Families, their languages, and one weight row for each machine."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for x in sorted(languages):
            self.families.setdefault(family_of(x), []).append(x)
        self.weights = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @staticmethod
    def tasks(languages: list[str]) -> list[tuple[str, str, bool]]:
        """(task, language, positive) of every machine: one family against the others, and each pair inside a family."""
        families: dict[str, list[str]] = {}
        for x in sorted(languages):
            families.setdefault(family_of(x), []).append(x)
        out = []
        if len(families) > 1:
            out += [(f"family {f}", x, family_of(x) == f) for f in families for x in sorted(languages)]
        for members in families.values():
            for a, b in combinations(members, 2):
                out += [(f"pair {a} {b}", a, True), (f"pair {a} {b}", b, False)]
        return out

    def predict(self, features: np.ndarray) -> list[tuple[str, float]]:
        """Language and confidence of each row: product of the family's share and the language's share of its pairs."""
        n = len(features)
        if not self.families:
            return [(UNKNOWN, 0.0)] * n
        x = np.hstack([features, np.ones((n, 1), np.float32)])
        sure = lambda task: 1 / (1 + np.exp(-np.clip(SHARPNESS * (x @ self.weights[task]), -50, 50)))
        names = list(self.families)
        family = np.stack([sure(f"family {f}") for f in names]) if len(names) > 1 else np.ones((1, n))
        family = family / family.sum(axis=0)
        best = family.argmax(axis=0)
        languages, scores = np.empty(n, object), np.zeros(n)
        for k, f in enumerate(names):
            at, members = np.flatnonzero(best == k), self.families[f]
            votes = np.zeros((len(members), n))
            for a, b in combinations(range(len(members)), 2):
                p = sure(f"pair {members[a]} {members[b]}")
                votes[a] += p
                votes[b] += 1 - p
            pairs = max(len(members) - 1, 1)
            top = votes.argmax(axis=0) if len(members) > 1 else np.zeros(n, int)
            share = votes.max(axis=0) / pairs if len(members) > 1 else np.ones(n)
            for i in at:
                languages[i], scores[i] = members[top[i]], family[k, i] * share[i]
        return list(zip(languages, scores.clip(0, 1).tolist()))


def fit_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> LanguageModel:
    """Learn from rows that are not held out and have a language and a text.

    At most ``most`` texts of a language, drawn by a hash of the id, are read: the documented bound of the fit. A
    machine sees at most ``most`` texts of each of its languages, so its task is bounded too.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id))).select(F.col(id).alias("_id"), F.col(lang).alias("_lang"))
    ids = bounded_sample(known, "_lang", most, "_id").distinct()
    texts = docs.select(F.col(id).alias("_i"), F.col(lang).alias("_l"), F.col(text).alias("_text"))
    sample = texts.join(F.broadcast(ids), texts["_i"].eqNullSafe(ids["_id"]) & (texts["_l"] == ids["_lang"])).select("_lang", "_text", F.xxhash64("_id").alias("_order"))
    languages = [r[0] for r in ids.select("_lang").distinct().collect()]
    tasks = LanguageModel.tasks(languages)
    if not tasks:
        return LanguageModel(languages, {})
    plan = docs.sparkSession.createDataFrame(tasks, "_task string, _l string, _positive boolean")
    fitted = sample.join(F.broadcast(plan), sample["_lang"] == plan["_l"]).select("_task", "_positive", "_text", "_order").groupBy("_task").applyInPandas(
        _fit_task, "_task string, _weights array<float>")
    return LanguageModel(languages, {r["_task"]: np.array(r["_weights"]) for r in fitted.collect()})


def _predict(model: LanguageModel):
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out: list[tuple[str, float]] = []
            for a in range(0, len(texts), 256):
                part = [x.as_py() or "" for x in texts.slice(a, 256)]
                told = model.predict(np.stack([letter_grams(t) for t in part]))
                out += [p if has_letter(t) else (UNKNOWN, 0.0) for p, t in zip(told, part)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                                             names=[*b.schema.names[:-1], "lang_pred", "lang_score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``lang_pred`` and ``lang_score`` (0 to 1) of the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Columns with these two names
    are replaced.
    """
    mine = ("lang_pred", "lang_score")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in mine and (keep is not None or c != text)]
    slim = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(_predict(model), T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
