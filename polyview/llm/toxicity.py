"""Toxicity: a factorization machine over hashed terms (Rendle, 2010).

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) for the set of terms that a text
holds. The pairwise part learns that two insults, or an insult next to a mention of a group, weigh more than
each alone, which additive weights miss; it is computed in time linear in the number of terms as
half of (sum v_i x_i)^2 - sum v_i^2 x_i^2.

Fitting uses a sample of labelled rows bounded by about ``per_class`` for each label, chosen by a hash of the
id; rows of one id count as one, with the text that sorts first, and texts with the same terms count as one. Of the terms, the ``most``
that go together with the label most surely (by the likelihood-ratio statistic G2, which has to exceed what chance gives once in
a thousand) are counted by Spark and learned from, so the driver holds ``most`` numbers for each row of the sample at most. Scoring is a map over all rows.

Null and empty texts have no terms and get sigmoid(w0). Labels other than 0 and 1, null ids, and ids with both labels aren't
learned from. Without any usable label every score is below 1e-12, and with labels of one kind alone, all scores agree with it.
Repeated rows are scored alike. score() keeps all columns, but replaces one that has the name of its result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import LETTERS, Memo, drop_stored, fresh_worker, hash_unit, stored

DIM = 1 << 20
PREFIXES = (3, 4, 5, 6, 8)
#: G2 that one term in a thousand exceeds by chance (chi-square, one degree of freedom).
SURE = 10.83


def numbers(word: str, dim: int = DIM) -> tuple[int, ...]:
    """Hashed numbers of a word and of its beginnings of PREFIXES letters, as languages that inflect and compound seldom
    repeat an insult letter for letter."""
    number = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % dim
    return (number(word), *(number(f"{word[:n]}*") for n in PREFIXES if len(word) >= n))


def terms(text: str | None, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    """What ``memo`` has for the runs of letters in lower case that a text holds, each once, ascending."""
    if not text:
        return np.empty(0, np.int32)
    found: set[int] = set()
    for w in set(LETTERS.findall(text.lower())):
        found.update(memo[w])
    return np.sort(np.fromiter(found, np.int32, len(found)))


def term_memo(dim: int = DIM) -> Memo:
    return Memo(lambda w: numbers(w, dim))


@dataclass
class FactorizationMachine:
    """terms: the numbers of the terms it knows, ascending; w and v have a row for each. Others count nothing."""

    w0: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def memo(self, dim: int = DIM) -> Memo:
        """From a word to the rows of its known terms."""
        row = {int(t): k for k, t in enumerate(self.terms)}
        return Memo(lambda w: tuple(row[t] for t in numbers(w, dim) if t in row))

    def by_row(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margins of sets of rows of w and v."""
        lengths = np.array([len(r) for r in rows], np.int64)
        idx = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        vx = self.v[idx]
        s = _by_set(vx, lengths)
        return self.w0 + _by_set(self.w[idx], lengths) + 0.5 * ((s * s).sum(1) - _by_set((vx * vx).sum(1), lengths))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margins of sets of term numbers."""
        return self.by_row([_known(self.terms, r) for r in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.margins(rows))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -30, 30)))


def _known(names: np.ndarray, r: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, r), max(0, len(names) - 1))
    return at[names[at] == r] if len(names) else np.empty(0, np.int64)


def _by_set(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows of ``values``; 0 for empty stretches."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def association(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """G2 of terms that n1 of all1 rows with label 1 and n0 of all0 others hold."""
    n1, n0 = np.asarray(n1, float), np.asarray(n0, float)

    def ln(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    p = (n1 + n0) / (all1 + all0)
    return 2 * (ln(n1, all1, n1 / all1) + ln(n0, all0, n0 / all0) - ln(n1, all1, p) - ln(n0, all0, p))


def chosen(term: np.ndarray, n1: np.ndarray, n0: np.ndarray, all1: float, all0: float, most: int, min_rows: int = 4) -> np.ndarray:
    """The terms to learn from, ascending."""
    g = np.where(n1 + n0 >= min_rows, association(n1, n0, all1, all0), 0.0)
    best = np.lexsort((term, -g))[:most]
    return np.sort(term[best[g[best] > SURE]])


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float | None = None, known: np.ndarray | None = None, most: int = 1024, factors: int = 4, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """prior: the share of label 1 where the model is used, if the rows are balanced; the intercept is moved to it. known:
    the terms to learn from (chosen() from the rows without it). Labels may be shares.

    Logistic loss with squared penalties on w and v, by Adam on batches of the dense presence matrix, which has len(rows) x most
    entries at most."""
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(30.0 if share else -30.0, np.empty(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    if known is None:
        flat, weight = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
        term, at = np.unique(flat, return_inverse=True)
        n1 = np.bincount(at, weight, len(term))
        known = chosen(term, n1, np.bincount(at, minlength=len(term)) - n1, labels.sum(), (1 - labels).sum(), most)
    x = np.zeros((len(rows), len(known)), np.float32)
    for k, r in enumerate(rows):
        x[k, _known(known, r)] = 1
    rng = np.random.default_rng(seed)
    w0, w, v = np.array([np.log(share / (1 - share))]), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors))
    mean, square, step = [np.zeros_like(p) for p in (w0, w, v)], [np.zeros_like(p) for p in (w0, w, v)], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            own = x[part]
            s = own @ v
            m = w0[0] + own @ w + 0.5 * ((s * s).sum(1) - own @ (v * v).sum(1))  # x is 0 or 1
            err = (sigmoid(m) - labels[part]) / len(part)
            step += 1
            for k, (p, g) in enumerate(((w0, np.array([err.sum()])), (w, own.T @ err + decay * w), (v, own.T @ (err[:, None] * s) - v * (own.T @ err)[:, None] + decay * v))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                p -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    moved = 0.0 if prior is None or not 0 < prior < 1 else np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return FactorizationMachine(float(w0[0] + moved), known, w, v)


def labelled_terms(docs: DataFrame, labels: DataFrame, use: Column, per_class: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[DataFrame | None, float]:
    """A stored table of terms (t, an array) and labels (y, a share where texts with the same terms differ), of about ``per_class`` rows of each label at most,
    of those for which ``use`` holds; and the share of label 1 among all usable labels.

    The rows are those with the smallest hashes of their ids. The labels' sample is bounded by twice
    per_class (a label's share is set by its count), so it is broadcast to the texts."""
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    marked = marked.where(use).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, 0.0
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_class / n))])
    sample = marked.where(hash_unit("_id") < share[F.col("_y")])
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        memo = term_memo()
        for b in batches:
            yield pd.DataFrame({"y": b["_y"].astype(float), "t": [terms(x, memo) for x in b["_text"]]})

    got = rows.mapInPandas(found, "y double, t array<int>").groupBy("t").agg(F.avg("y").alias("y"))
    return stored(got, "sample"), counts.get(1, 0) / sum(counts.values())


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of probabilities. The model's size is bounded by ``most`` terms, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        memo = shared.value.memo()
        for b in batches:
            parts = [sigmoid(shared.value.by_row([terms(t, memo) for t in b.iloc[k : k + 500]])) for k in range(0, len(b), 500)]
            yield pd.Series(np.concatenate([*parts, np.empty(0)]))

    return docs.withColumn(out, scored(F.col(text)))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, per_class: int = 5_000, most: int = 1024, **how) -> FactorizationMachine:
    """use: a condition on ``_id`` that says which labels may be learned from."""
    sample, prior = labelled_terms(docs, labels, F.lit(True) if use is None else use, per_class)
    if sample is None:
        return fit([], np.empty(0), **how)
    size, all1 = sample.agg(F.count("*"), F.sum("y")).first()
    if not size or not 0 < all1 < size:
        known = np.empty(0, np.int64)
    else:
        counts = sample.select("y", F.explode("t").alias("term")).groupBy("term").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).where("n >= 4")
        # the statistic again in SQL, so that only the best come to the driver
        ln = lambda k, n, p: f"({k} * ln(greatest(1e-12, least(1 - 1e-12, {p}))) + ({n} - {k}) * ln(1 - greatest(1e-12, least(1 - 1e-12, {p}))))"
        one, zero, both = f"n1 / {all1}D", f"(n - n1) / {size - all1}D", f"n / {size}D"
        g2 = F.expr(f"2 * ({ln('n1', f'{all1}D', one)} + {ln('(n - n1)', f'{size - all1}D', zero)} - {ln('n1', f'{all1}D', both)} - {ln('(n - n1)', f'{size - all1}D', both)})")
        best = counts.withColumn("g", g2).where(F.col("g") > SURE).orderBy(F.desc("g"), "term").limit(most).toPandas()
        known = np.sort(best["term"].to_numpy(np.int64))
    kept = F.array(*[F.lit(int(t)) for t in known]).cast("array<int>")
    rows = sample.select("y", (F.array_sort(F.array_intersect("t", kept)) if len(known) else F.array().cast("array<int>")).alias("t")).toPandas()
    drop_stored(sample)
    sets = [np.asarray(t, np.int64) for t in rows["t"]]
    order = sorted(range(len(sets)), key=lambda k: (sets[k].tobytes(), rows["y"].iloc[k]))  # the same whatever the partitions
    return fit([sets[k] for k in order], rows["y"].to_numpy(float)[order], prior, known, **how)
