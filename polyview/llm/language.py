"""Language identification: blended-spectrum string kernel with Nystroem landmarks and one-versus-rest
kernel ridge regression.

A text's features are the hashed character n-grams (lengths ``LENGTHS``) that it holds, present or not.
k(a, b) = |A and B| / sqrt(|A| |B|). Landmarks are training texts L; Z = K(X, L) K(L, L)^(-1/2) maps the
training texts X, and ridge regression of one +1/-1 target a language on Z gives weights, so a text's
outputs are k(x, L) K(L, L)^(-1/2) W. As k(x, L) is the product of x's 0/1 row with the landmarks' rows,
the two matrix products associate: presence rows times (landmark rows K^(-1/2) W), which is
multiplied once and then applied to all texts in batches.

Training takes about ``per_lang`` texts of each language, by a hash of the id; rows of one id and language
count as one, with the text that sorts first, so repeated rows don't enlarge the sample. Runs of white
space count as one space and case is folded; digits and punctuation aren't part of any n-gram.

Null texts and those without a letter are ``und`` with score 0, as all are where there is nothing to
learn from. With one language learned, it is the answer for the rest. Null languages aren't learned from.
Ties go to the language that sorts first. identify() keeps all columns, but replaces those called lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import LETTERS, hash_unit, mixed

BINS = 1 << 16
LENGTHS = (1, 2, 3, 4)
UNKNOWN = "und"


def grams(text: str | None, bins: int = BINS, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    """Numbers of the distinct n-grams of a text; none if it has no letter."""
    runs = LETTERS.findall(text.lower()) if text else []
    if not "".join(runs).isalpha():  # the pattern also has numerals such as superscripts and fractions
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    if not runs:
        return np.empty(0, np.int64)
    code = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(bins, bool)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(lengths) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n in lengths:
            seen[(mixed(h) & np.uint64(bins - 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    langs: list[str]
    weights: np.ndarray  # bins x languages

    def outputs(self, rows: list[np.ndarray]) -> np.ndarray:
        """Presence rows times weights over the rows' norms."""
        dense = np.zeros((len(rows), len(self.weights)), np.float32)
        for i, r in enumerate(rows):
            dense[i, r] = 1
        return (dense @ self.weights) / np.sqrt(np.maximum(1, [len(r) for r in rows]))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        rows = [grams(t, len(self.weights)) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        out = self.outputs(rows)
        best = out.argmax(1)
        score = np.clip((out[np.arange(len(rows)), best] + 1) / 2, 0, 1)
        bare = np.array([len(r) == 0 for r in rows], bool)
        return [UNKNOWN if b else self.langs[k] for k, b in zip(best, bare, strict=True)], np.where(bare, 0.0, score)


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = 192, ridge: float = 1e-2, bins: int = BINS) -> KernelModel:
    """Landmarks are dealt evenly over the languages, in the order of the rows."""
    used = [i for i, r in enumerate(rows) if len(r)]
    names = sorted({langs[i] for i in used})
    if not names:
        return KernelModel([], np.zeros((bins, 0), np.float32))
    each = -(-landmarks // len(names))
    marks = [i for name in names for i in [j for j in used if langs[j] == name][:each]]

    def presence(which: list[int]) -> np.ndarray:
        m = np.zeros((len(which), bins), np.float32)
        for k, i in enumerate(which):
            m[k, rows[i]] = 1 / np.sqrt(len(rows[i]))
        return m

    basis = presence(marks)
    value, vector = np.linalg.eigh(basis.astype(np.float64) @ basis.T)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = np.concatenate([presence(used[k : k + 256]) @ basis.T for k in range(0, len(used), 256)]) @ root
    y = np.array([[1.0 if langs[i] == name else -1.0 for name in names] for i in used])
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return KernelModel(names, (basis.T @ (root @ w)).astype(np.float32))


def train(docs: DataFrame, use: Column | None = None, per_lang: int = 400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> KernelModel:
    """use: a condition on ``_id`` that says which rows may be learned from."""
    known = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    known = known if use is None else known.where(use)
    counts = {r["_lang"]: r["n"] for r in known.select("_lang", "_id").distinct().groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], **how)
    share = F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(1.0, per_lang / n))])

    bins = how.get("bins", BINS)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"].astype(str), "lang": b["_lang"], "g": [grams(x, bins).astype(np.int32).tobytes() for x in b["_text"]]})

    sample = known.where(hash_unit("_id", "_lang") < share[F.col("_lang")]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    got = sample.mapInPandas(numbers, "id string, lang string, g binary").toPandas()
    got = got.sort_values(["id", "lang", "g"], kind="stable")
    return fit([np.frombuffer(g, np.int32).astype(np.int64) for g in got["g"]], got["lang"].tolist(), **how)


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. The model is bins x languages, bounded by its parameters, and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores = [], []
            for k in range(0, len(b), 64):
                n, s = shared.value.predict(b.iloc[k : k + 64].tolist())
                names += n
                scores.append(s)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate([*scores, np.empty(0)]).astype(float)})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", predicted(F.col(text))).select(*[F.col(f"`{c}`") for c in kept], "_p.lang_pred", "_p.score")
