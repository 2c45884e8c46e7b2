"""Fitting by Markov chain Monte Carlo over all states at once, distributed over the rows.

A sweep is one map over the rows (new categories in every view of every state, given weights and components), one aggregate
(sufficient statistics of all columns under all partitions, partial sums before the shuffle), and draws on the driver whose size
doesn't grow with the rows: column moves between views by their marginal likelihoods, with a fresh view as a further
candidate, weights, components, prior parameters and the partition processes. Row kernels: ``slice`` (exact: the stick is broken until
the rest is below the smallest slice variable of all rows, which an aggregate finds first), ``finite`` (weights with an empty
category to spare; approximate), and ``gibbs`` and ``sams`` (sequential, so they run in one process, for tables of at most MOST_LOCAL
rows). Column kernels: ``gibbs`` (each column given the others), ``finite`` and ``slice`` (given drawn weights of the views, with one fresh view)."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column as Column_
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.operators.likelihood import ln_cell
from polyview.plans import kernels
from polyview.plans.model import Model, State, View, category_sizes, suffstats
from polyview.plans.tables import drop_table, written
from polyview.sources.codebook import Codebook, Column, PriorProcess

DEFAULT = ("columns", "state_process", "rows", "view_process", "priors", "components")
_SLOW = ("view_process", "rows:sams", "view_process", "rows:sams", "view_process", "rows:slice", "components", "columns:gibbs", "state_process", "priors")
_FLAT = ("view_process", "rows:sams", "view_process", "rows:sams", "view_process", "components", "rows:slice", "components", "view_process", "priors")
_FAST = ("view_process", "rows:slice", "components", "priors", "columns:slice", "state_process")
SETS = {"default": DEFAULT, "sams": _SLOW, "flat": _FLAT, "fast": _FAST}
ROW_KERNELS, COLUMN_KERNELS = ("slice", "finite", "gibbs", "sams"), ("gibbs", "finite", "slice")
MOST_LOCAL = 200_000


@dataclass
class Handler:
    """Called during a run. Subclasses override the hooks; several handlers go into a list. The fields cover the usual cases: seconds
    until the run stops, a test that stops it, and a report of progress."""

    timeout: float | None = None
    stop: Callable[[int, Model], bool] | None = None
    progress: Callable[[int, int], None] | None = None

    def started(self, model: Model, n_iters: int) -> None:
        """Before the first sweep."""
        self.began = time.time()

    def state_started(self, state: int, model: Model) -> None:
        """Before the first sweep, for each state."""

    def state_updated(self, state: int, sweep: int, model: Model) -> None:
        """After each sweep, for each state."""

    def updated(self, sweep: int, n_iters: int, model: Model) -> None:
        """After each sweep, once all states are updated."""
        if self.progress:
            self.progress(sweep, n_iters)

    def over(self, sweep: int, model: Model) -> bool:
        """Whether to stop before the next sweep."""
        return self.timeout is not None and time.time() - self.began > self.timeout or self.stop is not None and self.stop(sweep, model)

    def state_over(self, state: int) -> bool:
        """Whether a state is to be left as it is from now on; the run goes on with the others."""
        return False

    def state_completed(self, state: int, model: Model) -> None:
        """After the last sweep, for each state."""

    def finished(self, model: Model) -> None:
        """When all is done, also after an error."""


@dataclass
class StateTimeout(Handler):
    """Leaves each state as it is after so many seconds; states advance together, so all of them then."""

    seconds: float = 60.0

    def state_over(self, state: int) -> bool:
        return time.time() - self.began > self.seconds


@dataclass
class Interrupt(Handler):
    """Stops the run after the sweep in which an interrupt (Ctrl-C) arrives, and keeps what was done."""

    def started(self, model: Model, n_iters: int) -> None:
        super().started(model, n_iters)
        self.hit = False
        try:
            self.before = signal.signal(signal.SIGINT, self._caught)
        except ValueError:  # signals reach the main thread only
            self.before = None

    def _caught(self, *_: object) -> None:
        self.hit = True

    def over(self, sweep: int, model: Model) -> bool:
        return self.hit or super().over(sweep, model)

    def finished(self, model: Model) -> None:
        if self.before is not None:
            signal.signal(signal.SIGINT, self.before)


def draw_process(p: PriorProcess, rng: np.random.Generator) -> dict:
    out = {"alpha": float(max(1e-3, rng.gamma(p.shape) / p.rate))}
    return out | {"d": float(np.clip(rng.beta(p.a, p.b), 1e-3, 0.95))} if p.kind == "pitman_yor" else out


def ln_partition(counts: np.ndarray, process: dict) -> float:
    counts = counts[counts > 0]
    return dist.ln_pyp(counts, process["alpha"], process["d"]) if "d" in process else dist.ln_crp(counts, process["alpha"])


def draw_prior(c: Column, rng: np.random.Generator) -> dict:
    if c.prior is not None:
        return dict(c.prior)
    h = c.hyper
    if c.ftype == "continuous":
        mean, var, ln = h.get("mean", 0.0), h.get("var", 1.0), max(1.0, float(np.log(max(2, h.get("n", 10)))))
        return {"m": float(rng.normal(mean, var**0.5)), "k": float(max(1e-3, rng.gamma(1.0))), "v": float(ln / rng.gamma(ln)), "s2": float(var / rng.gamma(ln))}
    if c.ftype == "count":
        return {"shape": float(max(1e-3, rng.gamma(2.0) / 2 * h.get("shape", 1.0))), "rate": float(max(1e-3, rng.gamma(2.0) / 2 * h.get("rate", 1.0)))}
    return {"alpha": float(1 / max(1e-3, rng.gamma(h.get("shape", 1.0)) / h.get("scale", 1.0)))}


def move_prior(c: Column, now: dict, s: dict, rng: np.random.Generator, steps: int = 30) -> dict:
    """Independence Metropolis steps with proposals from the hyper-prior."""
    if c.prior is not None:
        return now
    fit = float(dist.ln_marginal(c.ftype, now, s).sum())
    for _ in range(steps):
        new = draw_prior(c, rng)
        then = float(dist.ln_marginal(c.ftype, new, s).sum())
        if np.log(rng.random()) < then - fit:
            now, fit = new, then
    return now


def move_process(p: PriorProcess, now: dict, counts: np.ndarray, rng: np.random.Generator, steps: int = 100) -> dict:
    fit = ln_partition(counts, now)
    for _ in range(steps):
        new = draw_process(p, rng)
        then = ln_partition(counts, new)
        if np.log(rng.random()) < then - fit:
            now, fit = new, then
    return now


def sticks(process: dict, rng: np.random.Generator, least: float = 1e-3) -> np.ndarray:
    """Weights of a partition from its prior, until the rest is small."""
    out, rest, k = [], 1.0, 0
    while rest > least and len(out) < 4096:
        d = process.get("d", 0.0)
        b = rng.beta(1 - d, process["alpha"] + d * (k + 1))
        out.append(rest * b)
        rest, k = rest * (1 - b), k + 1
    out = np.array(out)
    return out / out.sum()


def _posterior(c: Column, prior: dict, s: dict, rng: np.random.Generator) -> dict:
    return dist.posterior_draw(c.ftype, prior, s, rng)


def _empty(c: Column, k: int) -> dict:
    return {"counts": np.zeros((k, len(c.values)))} if c.ftype == "categorical" else {n: np.zeros(k) for n in ("n", "mean", "ss", "sum", "ln_fact")}


def _keep(s: dict, keep: np.ndarray) -> dict:
    return {n: x[keep] for n, x in s.items()}


def _by_weights(w: np.ndarray, u: Column_) -> Column_:
    """The category that a number in [0, 1) falls into."""
    inside = F.array_position(F.transform(F.array(*[F.lit(float(x)) for x in np.cumsum(w)]), lambda x: x > u), True) - 1
    return F.when(inside >= 0, inside).otherwise(len(w) - 1).cast("int")


def _gibbs(scores: np.ndarray, rng: np.random.Generator) -> int:
    return int((scores + rng.gumbel(size=len(scores))).argmax())


class Chains:
    """The sampler's state between sweeps. remap: for each slot of the table's z, new labels by old ones, or None to drop it."""

    def __init__(self, model: Model, seed: int):
        self.model, self.seed, self.sweep = model, seed, 0
        self.sticks_of: dict[int, np.ndarray] = {}
        self.rng = np.random.default_rng([seed, 0xF17])

    def row_plan(self, kernel: str, least: dict[int, float]) -> list[dict]:
        """For each view of each state: weights (with a spare category, or the broken stick) and components. least: the smallest slice
        variable of each slot."""
        plan = []
        for s in self.model.states:
            for view in s.views:
                w = np.asarray(view.weights, float)
                if kernel == "finite":
                    more = np.array([max(self.rng.beta(view.process["alpha"] + view.process.get("d", 0.0) * len(w), max(1.0, view.sizes.sum())), 1e-300)])
                    full = np.concatenate([w * (1 - more.sum()) / max(w.sum(), 1e-300), more])
                else:
                    full = self.sticks_of[len(plan)] if len(plan) in self.sticks_of else w
                    full = np.concatenate([full, self._more(view.process, full, least.get(len(plan), 1.0))])
                spare = len(full) - len(w)
                params, present = {}, {}
                for j in view.cols:
                    c = self.model.codebook.columns[j]
                    new = _posterior(c, s.priors[j], _empty(c, spare), self.rng)
                    params[j] = {n: np.concatenate([x, new[n]]) for n, x in view.params[j].items()}
                    if c.mnar:
                        present[j] = {"p": np.concatenate([view.present[j]["p"], np.clip(self.rng.beta(0.5, 0.5, spare), 1e-6, 1 - 1e-6)])}
                plan.append({"view": View(view.cols, full, view.sizes, params, present), "known": len(w)})
        return plan

    def _more(self, process: dict, known: np.ndarray, least: float) -> list[float]:
        """Pieces of the stick beyond the known ones, until the rest is below ``least``."""
        d, rest, out = process.get("d", 0.0), 1.0 - float(known.sum()), []
        while rest >= least and rest > 0:
            if len(out) > kernels.MOST_PIECES:
                raise RuntimeError("the stick doesn't get shorter than the smallest slice variable")
            b = self.rng.beta(1 - d, process["alpha"] + d * (len(known) + len(out) + 1))
            out.append(rest * b)
            rest *= 1 - b
        return out

    def _slices(self, data: DataFrame) -> tuple[DataFrame, dict[int, float]]:
        """data with ``_u``, a number in (0, 1) for each slot of z, and the smallest slice variable of each slot. The weights of the
        occupied categories leave a rest for new ones here, by their sizes."""
        slots = [v for s in self.model.states for v in s.views]
        self.sticks_of = {}
        for k, v in enumerate(slots):
            d = v.process.get("d", 0.0)
            rest = self.rng.beta(v.process["alpha"] + d * len(v.weights), max(float(np.sum(v.sizes)) - d * len(v.weights), 1e-9))
            self.sticks_of[k] = np.asarray(v.weights, float) * (1 - rest) / max(np.sum(v.weights), 1e-300)
        unit = lambda k: (F.xxhash64("rix", F.lit(self.seed), F.lit(self.sweep), F.lit(k)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
        data = data.withColumn("_u", F.array(*[unit(k) for k in range(len(slots))]))
        table = F.array(*[F.array(*[F.lit(float(x)) for x in self.sticks_of[k]]) for k in range(len(slots))])
        cells = data.select(F.posexplode("z").alias("_s", "_k"), "_u")
        mins = cells.groupBy("_s").agg(F.min(F.get(F.get(table, F.col("_s")), F.col("_k")) * F.get("_u", F.col("_s"))).alias("m")).collect()  # a row a slot
        return data, {r["_s"]: float(r["m"]) for r in mins if r["m"] is not None}

    def moved(self, data: DataFrame, kernel: str, candidates: list[np.ndarray], frozen: set[int] = frozenset()) -> tuple[DataFrame, list[int]]:
        """data with new z, then one slot a state for its candidate view; the number of labels of each slot. The rows of frozen states
        stay where they are."""
        if kernel in kernels.KERNELS:
            return self._moved_here(data, kernel, candidates, frozen)
        columns = data.columns
        data, least = self._slices(data) if kernel == "slice" else (data, {})
        plan = self.row_plan(kernel, least)
        still = {k for k, s in enumerate(i for i, s in enumerate(self.model.states) for _ in s.views) if s in frozen}
        shared = data.sparkSession.sparkContext.broadcast((self.model.dataless(), plan, candidates))
        names, seed, sweep = self.model.codebook.column_names, self.seed, self.sweep

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, views, fresh = shared.value
            for b in batches:
                if not len(b):
                    continue
                rng = np.random.default_rng([seed, sweep, int(b["rix"].iloc[0])])
                old = np.array(b["z"].tolist(), dtype=np.int64).reshape(len(b), -1)
                z = np.zeros((len(b), len(views) + len(fresh)), np.int32)
                cells = {j: (b[names[j]].fillna(0).to_numpy(), b[names[j]].isna().to_numpy()) for j in range(len(names))}
                for slot, p in enumerate(views):
                    view = p["view"]
                    if slot in still:
                        z[:, slot] = old[:, slot]
                        continue
                    score = np.repeat(np.log(np.maximum(view.weights, 1e-300))[None], len(b), 0) if kernel == "finite" else np.zeros((len(b), len(view.weights)))
                    for j in view.cols:
                        score = score + ln_cell(model, view, j, *cells[j])
                    if kernel == "slice":
                        u = np.array([x[slot] for x in b["_u"]]) * view.weights[old[:, slot]]
                        z[:, slot] = kernels.sliced(score, view.weights, u, rng)
                    else:
                        z[:, slot] = (score + rng.gumbel(size=score.shape)).argmax(1)
                for k, w in enumerate(fresh):
                    z[:, len(views) + k] = rng.choice(len(w), len(b), p=w)
                yield b[columns].assign(z=list(z))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*[f"`{c}`" for c in columns]).schema)
        out = data.mapInPandas(run, kinds)
        return out, [len(p["view"].weights) for p in plan] + [len(w) for w in candidates]

    def _moved_here(self, data: DataFrame, kernel: str, candidates: list[np.ndarray], frozen: set[int]) -> tuple[DataFrame, list[int]]:
        """The same by a sequential kernel, on the driver; larger tables than MOST_LOCAL rows are an error."""
        book = self.model.codebook
        own = data.select("rix", "z", *[f"`{n}`" for n in book.column_names]).orderBy("rix").limit(MOST_LOCAL + 1).toPandas()
        if len(own) > MOST_LOCAL:
            raise ValueError(f"the {kernel} kernel moves one row after another; for more than {MOST_LOCAL} rows take the slice kernel")
        old = np.array(own["z"].tolist(), dtype=np.int64).reshape(len(own), -1)
        cells = {j: (own[n].fillna(0).to_numpy(float), own[n].isna().to_numpy()) for j, n in enumerate(book.column_names)}
        z, sizes, slot = np.zeros((len(own), self.model.n_slots + len(candidates)), np.int64), [], 0
        for k, s in enumerate(self.model.states):
            for view in s.views:
                if k in frozen or not len(own):
                    z[:, slot] = old[:, slot]
                else:
                    names, first = np.unique(old[:, slot], return_inverse=True)
                    p = kernels.Partition({j: book.columns[j] for j in view.cols}, {j: cells[j] for j in view.cols}, s.priors, view.process, first)
                    kernels.KERNELS[kernel](p, self.rng)
                    z[:, slot] = p.z
                sizes.append(max(len(view.weights), int(z[:, slot].max()) + 1 if len(own) else 0))
                slot += 1
        for k, w in enumerate(candidates):
            z[:, slot + k] = self.rng.choice(len(w), len(own), p=w)
        new = data.sparkSession.createDataFrame(pd.DataFrame({"_r": own["rix"], "_z": [x.tolist() for x in z]}), "_r long, _z array<int>") if len(own) else data.sparkSession.createDataFrame([], "_r long, _z array<int>")
        out = data.drop("z").join(new, F.col("rix") == F.col("_r")).withColumn("z", F.col("_z")).drop("_r", "_z")
        return out.select(*[f"`{c}`" for c in data.columns]), sizes + [len(w) for w in candidates]

    def step(self, data: DataFrame, transitions: tuple[str, ...], kernel: str, column_kernel: str = "gibbs", frozen: set[int] = frozenset()) -> DataFrame:
        """Some transitions: at most one move of the rows and one of the columns; returns the table with the new z, written once. Frozen
        states stay as they are."""
        self.sweep += 1
        book, states = self.model.codebook, self.model.states
        moving = "columns" in transitions and len(book.columns) > 1
        proposed = [draw_process(book.view_process, self.rng) for _ in states] if moving else []
        n = sum(float(np.sum(v.sizes)) for v in states[0].views[:1]) if moving else 0.0
        candidates = [sticks(p, self.rng, 1e-3 / max(1.0, n)) for p in proposed]
        if "rows" in transitions:
            new, sizes = self.moved(data, kernel, candidates, frozen)
        else:
            drawn = data.select("*", *[F.rand(self.seed + 31 * self.sweep + k).alias(f"_v{k}") for k in range(len(candidates))])
            new = drawn.withColumn("z", F.concat("z", F.array(*[_by_weights(w, F.col(f"_v{k}")) for k, w in enumerate(candidates)]))).select(*[f"`{c}`" for c in data.columns]) if candidates else data
            sizes = [len(v.weights) for s in states for v in s.views] + [len(w) for w in candidates]
        new = written(new, "rows")
        stats = suffstats(new, book, sizes)
        counts = category_sizes(new, sizes)
        slot, out_states, picks = 0, [], []
        for k, s in enumerate(states):
            slots = [slot + v for v in range(len(s.views))]
            slot += len(s.views)
            if k in frozen:
                out_states.append(s)
                picks += [(x, np.arange(sizes[x])) for x in slots]
                continue
            if moving:
                slots.append(sum(len(t.views) for t in states) + k)
            where = {j: slots[s.view_of(j)] for j in range(len(book.columns))}
            if moving:
                where = self._columns(s, where, slots, stats, column_kernel)
            used = [x for x in slots if x in set(where.values())]
            views = []
            for x in used:
                keep = np.flatnonzero(counts[x] > 0)
                if not len(keep):
                    keep = np.array([0])
                cols = [j for j in sorted(where) if where[j] == x]
                process = proposed[k] if moving and x == slots[-1] else s.views[slots.index(x)].process
                if "view_process" in transitions:
                    process = move_process(book.view_process, process, counts[x], self.rng)
                n = counts[x][keep]
                w = self.rng.dirichlet(np.maximum(n - process.get("d", 0.0), 1e-3))
                view = View(cols, w, n, process=process)
                for j in cols:
                    own = _keep(stats[x][j], keep)
                    if "priors" in transitions:
                        s.priors[j] = move_prior(book.columns[j], s.priors[j], own, self.rng)
                    view.params[j] = _posterior(book.columns[j], s.priors[j], own, self.rng)
                    if book.columns[j].mnar:
                        view.present[j] = dist.posterior_draw("presence", {}, _keep(stats[x][-1 - j], keep), self.rng)
                views.append(view)
                label = np.full(sizes[x], -1)
                label[keep] = np.arange(len(keep))
                picks.append((x, label))
            process = move_process(book.state_process, s.process, np.array([len(v.cols) for v in views], float), self.rng) if "state_process" in transitions else s.process
            fit = sum(float(dist.ln_marginal(book.columns[j].ftype, s.priors[j], stats[where[j]][j]).sum()) for j in where)
            prior = ln_partition(np.array([len(v.cols) for v in views], float), process) + sum(ln_partition(v.sizes, v.process) for v in views)
            out_states.append(State(views, process, s.priors, [*s.diagnostics, (fit, prior)]))
        # labels without gaps, and only the slots that are still used
        z = F.array(*[F.get(F.array(*[F.lit(int(x)) for x in label]), F.get("z", slot)) for slot, label in picks])
        self.model = Model(book, out_states)
        out = new.withColumn("z", z)
        out._written_at = new._written_at
        return out

    def _columns(self, s: State, where: dict[int, int], slots: list[int], stats: list[dict], kernel: str = "gibbs") -> dict[int, int]:
        """Columns to views by their marginal likelihoods there; the last slot is the fresh view until a column takes it. gibbs: one
        column after another, by the views' sizes; finite and slice: all at once, by drawn weights of the views."""
        alpha, d = s.process["alpha"], s.process.get("d", 0.0)
        where, was = dict(where), dict(where)
        sizes = np.array([sum(x == y for y in where.values()) for x in slots], float)
        drawn = np.zeros(len(slots))
        live = np.append(np.flatnonzero(sizes[:-1]), len(slots) - 1)
        drawn[live] = self.rng.dirichlet(np.append(np.maximum(sizes[live[:-1]] - d, 1e-3), alpha + d * (len(live) - 1)))
        for j in self.rng.permutation(len(where)).tolist():
            c = self.model.codebook.columns[j]
            others = [x for i, x in where.items() if i != j]
            least = self.rng.random() * drawn[slots.index(was[j])]
            scores = []
            for k, x in enumerate(slots):
                if kernel == "gibbs":
                    n = others.count(x)
                    prior = np.log(n - d) if n else np.log(alpha + d * len(set(others))) if x == slots[-1] or x == where[j] else -np.inf
                else:
                    prior = (0.0 if drawn[k] >= least else -np.inf) if kernel == "slice" else np.log(max(drawn[k], 1e-300))
                scores.append(prior + self._column_fit(s, j, stats[x]))
            where[j] = slots[_gibbs(np.array(scores), self.rng)]
        return where

    def _column_fit(self, s: State, j: int, stats: dict) -> float:
        c = self.model.codebook.columns[j]
        out = float(dist.ln_marginal(c.ftype, s.priors[j], stats[j]).sum())
        return out + float(dist.ln_marginal("presence", {}, stats[-1 - j]).sum()) if c.mnar else out


def start(book: Codebook, data: DataFrame, n_states: int = 8, seed: int = 0, flat: bool = False) -> Model:
    """States drawn from the prior: columns in views, and rows in categories by the views' sticks."""
    if n_states < 1:
        raise ValueError("at least one state is needed")
    rng = np.random.default_rng([seed, 0x57A7])
    states, weights = [], []
    for _ in range(n_states):
        process, groups = draw_process(book.state_process, rng), []
        for j in range(len(book.columns)):
            if flat and groups:
                groups[0].append(j)
                continue
            odds = np.array([*[len(g) for g in groups], process["alpha"]], float)
            k = rng.choice(len(odds), p=odds / odds.sum())
            groups.append([j]) if k == len(groups) else groups[k].append(j)
        views = []
        for cols in groups:
            p = draw_process(book.view_process, rng)
            w = sticks(p, rng, 0.02)
            views.append(View(cols, w, w, process=p))
            weights.append(w)
        priors = {j: draw_prior(c, rng) for j, c in enumerate(book.columns)}
        for v in views:
            for j in v.cols:
                c = book.columns[j]
                v.params[j] = _posterior(c, priors[j], _empty(c, len(v.weights)), rng)
                if c.mnar:
                    v.present[j] = {"p": np.clip(rng.beta(0.5, 0.5, len(v.weights)), 1e-6, 1 - 1e-6)}
        states.append(State(views, process, priors))
    def below(w: np.ndarray, k: int):
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in np.cumsum(w)[:-1]]), lambda x: x < F.col(f"_u{k}"))) if len(w) > 1 else F.lit(0)

    z = [below(w, k) for k, w in enumerate(weights)]
    data = data.select("*", *[F.rand(seed * 1009 + k).alias(f"_u{k}") for k in range(len(weights))])
    names = [c for c in data.columns if not c.startswith("_u")]
    return Model(book, states, written(data.select(*names, F.array(*z).alias("z")), "rows"))


def stages(transitions: tuple[str, ...], kernel: str, column_kernel: str) -> list[tuple[tuple[str, ...], str, str]]:
    """Transitions in order, cut so that each stage moves the rows once and the columns once at most. A kernel may be named
    with the transition (``rows:sams``)."""
    out: list[tuple[list[str], str, str]] = []
    for t in transitions:
        what, _, how = t.partition(":")
        if what not in DEFAULT:
            raise ValueError(f"unknown transition {what}")
        if not out or what in ("rows", "columns") and what in out[-1][0]:
            out.append(([], kernel, column_kernel))
        out[-1][0].append(what)
        if how:
            out[-1] = (out[-1][0], how if what == "rows" else out[-1][1], how if what == "columns" else out[-1][2])
    for _, rows, columns in out:
        if rows not in ROW_KERNELS:
            raise ValueError(f"unknown row kernel {rows}")
        if columns not in COLUMN_KERNELS:
            raise ValueError(f"unknown column kernel {columns}")
    return [(tuple(dict.fromkeys(x)), r, c) for x, r, c in out]


def update(model: Model, n_iters: int, transitions: tuple[str, ...] | str = "default", kernel: str = "slice", seed: int = 0, handler: Handler | list[Handler] | None = None, save: Callable[[int, Model], None] | None = None, checkpoint: int | None = None, column_kernel: str = "gibbs") -> Model:
    """n_iters sweeps of all states. transitions: the name of a set or their names in order, perhaps with kernels. save: called with the model
    after every ``checkpoint`` sweeps. A sweep with several moves of the rows records the diagnostics of the last alone."""
    if isinstance(transitions, str) and transitions not in SETS:
        raise ValueError(f"unknown set of transitions {transitions}; there are {', '.join(SETS)}")
    transitions = SETS[transitions] if isinstance(transitions, str) else tuple(transitions)
    if not transitions:
        raise ValueError("no transitions")
    plan = stages(transitions, kernel, column_kernel)
    if not model.codebook.columns or not model.states:
        return model
    handlers = handler if isinstance(handler, list) else [handler or Handler()]
    chains, data = Chains(model, seed), model.rows()
    for j, c in enumerate(model.codebook.columns):
        for s in model.states:
            s.priors.setdefault(j, draw_prior(c, chains.rng))
    kept, frozen, every = None, set(), range(len(model.states))
    for h in handlers:
        h.started(model, n_iters)
        for k in every:
            h.state_started(k, model)
    try:
        for sweep in range(1, n_iters + 1):
            before = [len(s.diagnostics) for s in chains.model.states]
            for own, rows, columns in plan:
                data = chains.step(data, own, rows, columns, frozen)
                drop_table(kept)
                kept = data
            for k, s in enumerate(chains.model.states):
                s.diagnostics[before[k] :] = s.diagnostics[-1:] if k not in frozen else []
            chains.model.data = data
            for h in handlers:
                for k in every:
                    if k not in frozen:
                        h.state_updated(k, sweep, chains.model)
                h.updated(sweep, n_iters, chains.model)
            if save and checkpoint and sweep % checkpoint == 0:
                save(sweep, chains.model)
            frozen |= {k for k in every if any(h.state_over(k) for h in handlers)}
            if len(frozen) == len(every) or any([h.over(sweep, chains.model) for h in handlers]):
                break
        out = Model(chains.model.codebook, chains.model.states, data)
        for h in handlers:
            for k in every:
                h.state_completed(k, out)
        return out
    finally:
        for h in handlers:
            h.finished(chains.model)


def cell_gibbs(model: Model, row: str | int, col: str | int, seed: int = 0) -> Model:
    """A column's view anew by Gibbs in every state, then the row's category in that view given all other rows. One pass over the
    statistics of the table, and a map that writes the row's label and the labels of a fresh view."""
    chains = Chains(model, seed)
    book, j = model.codebook, model.codebook.index(col)
    found = model.rows().where(model.where(row)).first()
    if found is None:
        raise IndexError(f"no row {row!r}")
    for i, c in enumerate(book.columns):
        for s in model.states:
            s.priors.setdefault(i, draw_prior(c, chains.rng))
    proposed = [draw_process(book.view_process, chains.rng) for _ in model.states]
    candidates = [sticks(p, chains.rng) for p in proposed]
    data = model.rows().select("*", *[F.rand(seed * 7919 + k).alias(f"_v{k}") for k in range(len(candidates))])
    data = written(data.withColumn("z", F.concat("z", F.array(*[_by_weights(w, F.col(f"_v{k}")) for k, w in enumerate(candidates)]))).drop(*[f"_v{k}" for k in range(len(candidates))]), "rows")
    found = data.where(F.col("rix") == found["rix"]).first()
    sizes = [len(v.weights) for s in model.states for v in s.views] + [len(w) for w in candidates]
    stats, counts = suffstats(data, book, sizes), category_sizes(data, sizes)
    states, picks, labels, slot = [], [], {}, 0
    for k, s in enumerate(model.states):
        slots = [*range(slot, slot + len(s.views)), model.n_slots + k]
        slot += len(s.views)
        where = {i: slots[s.view_of(i)] for i in range(len(book.columns))}
        alpha, d = s.process["alpha"], s.process.get("d", 0.0)
        others = [x for i, x in where.items() if i != j]
        odds = [(np.log(others.count(x) - d) if others.count(x) else np.log(alpha + d * len(set(others))) if x in (slots[-1], where[j]) else -np.inf) + chains._column_fit(s, j, stats[x]) for x in slots]
        where[j] = x = slots[_gibbs(np.array(odds), chains.rng)]
        process = lambda y: proposed[k] if y == slots[-1] else s.views[slots.index(y)].process  # noqa: B023, E731
        # the row, by the ratio of marginals with and without it
        cols, old = [i for i in sorted(where) if where[i] == x], found["z"][x]
        size = np.append(counts[x], 0.0)
        size[old] -= 1
        p = process(x)
        live = size > 0
        with np.errstate(divide="ignore"):
            score = np.log(np.maximum(size - p.get("d", 0.0), 0))
        free = int(np.flatnonzero(~live)[0])  # one empty category stands for all
        score[~live] = -np.inf
        score[free] = np.log(p["alpha"] + p.get("d", 0.0) * live.sum())
        for i in cols:
            score = score + _row_scores(book.columns[i], s.priors[i], {n: np.concatenate([y, np.zeros((1, *y.shape[1:]))]) for n, y in stats[x][i].items()}, found[book.columns[i].name], old)
        labels[x] = _gibbs(score, chains.rng)
        used = [y for y in slots if y in set(where.values())]
        views = []
        for y in used:
            n = np.append(counts[y], 0.0)
            if y == x:
                n[old] -= 1
                n[labels[x]] += 1
            keep = np.flatnonzero(n > 0)
            q = process(y)
            view = View([i for i in sorted(where) if where[i] == y], n[keep] / n.sum(), n[keep], process=q)
            for i in view.cols:
                own = {m: np.concatenate([v, np.zeros((1, *v.shape[1:]))])[keep] for m, v in stats[y][i].items()}
                view.params[i] = _posterior(book.columns[i], s.priors[i], own, chains.rng)
                if book.columns[i].mnar:
                    view.present[i] = dist.posterior_draw("presence", {}, {m: np.concatenate([v, np.zeros((1, *v.shape[1:]))])[keep] for m, v in stats[y][-1 - i].items()}, chains.rng)
            views.append(view)
            label = np.full(len(n), -1)
            label[keep] = np.arange(len(keep))
            picks.append((y, label))
        states.append(State(views, s.process, s.priors, s.diagnostics))
    is_row = F.col("rix") == found["rix"]
    z = F.array(*[F.get(F.array(*[F.lit(int(v)) for v in label]), F.when(is_row, F.lit(int(labels[y]))).otherwise(F.get("z", y)) if y in labels else F.get("z", y)) for y, label in picks])
    return Model(book, states, data.withColumn("z", z))


def _row_scores(c: Column, prior: dict, s: dict, value: object, old: int) -> np.ndarray:
    """ln predictive of one value in each category, the value being taken out of its own first."""
    if value is None:
        return np.zeros(len(next(iter(s.values()))))
    without = {n: x.copy() for n, x in s.items()}
    if c.ftype == "categorical":
        without["counts"][old, int(value)] -= 1
        more = {"counts": without["counts"].copy()}
        more["counts"][:, int(value)] += 1
    else:
        x = float(value)
        n = without["n"][old]
        rest = (n * without["mean"][old] - x) / (n - 1) if n > 1 else 0.0
        without["ss"][old] = max(0.0, without["ss"][old] - (x - without["mean"][old]) * (x - rest)) if n > 1 else 0.0
        without["mean"][old], without["n"][old] = rest, n - 1
        without["sum"][old] -= x
        ln = float(dist.gammaln(x + 1)) if c.ftype == "count" else 0.0
        without["ln_fact"][old] -= ln
        n = without["n"]
        mean = (n * without["mean"] + x) / (n + 1)
        more = {"n": n + 1, "mean": mean, "ss": without["ss"] + (x - without["mean"]) * (x - mean), "sum": without["sum"] + x, "ln_fact": without["ln_fact"] + ln}
    return dist.ln_marginal(c.ftype, prior, more) - dist.ln_marginal(c.ftype, prior, without)


def place_columns(model: Model, names: list[str], seed: int = 0) -> Model:
    """Views of the named columns by Gibbs, given where all others are, from one pass over their cells; components are drawn anew.
    For columns that have just got their values."""
    chains = Chains(model, seed + 17)
    book, slot, states = model.codebook, 0, []
    sizes = [len(v.weights) for s in model.states for v in s.views]
    stats = suffstats(model.rows(), book, sizes, dict.fromkeys(range(len(sizes)), [book.index(n) for n in names]))
    for s in model.states:
        views = [View(list(v.cols), v.weights, v.sizes, dict(v.params), dict(v.present), v.process) for v in s.views]
        for j in (book.index(n) for n in names):
            c = book.columns[j]
            s.priors.setdefault(j, draw_prior(c, chains.rng))
            for v in views:
                if j in v.cols:
                    v.cols.remove(j)
                    v.params.pop(j, None)
                    v.present.pop(j, None)
            d = s.process.get("d", 0.0)
            with np.errstate(divide="ignore"):
                odds = [np.log(max(len(v.cols) - d, 0.0)) + chains._column_fit(s, j, stats[slot + k]) for k, v in enumerate(views)]
            if not np.isfinite(odds).any():
                odds = [chains._column_fit(s, j, stats[slot + k]) for k in range(len(views))]
            k = _gibbs(np.array(odds), chains.rng)
            own = views[k]
            own.cols.append(j)
            own.params[j] = _posterior(c, s.priors[j], stats[slot + k][j], chains.rng)
            if c.mnar:
                own.present[j] = dist.posterior_draw("presence", {}, stats[slot + k][-1 - j], chains.rng)
        slot += len(views)
        states.append(State(views, s.process, s.priors, s.diagnostics))
    empty = any(not v.cols for s in states for v in s.views)
    if empty:  # a view that has lost its only column goes, with its place in z
        keep, slot = [], 0
        for s in states:
            keep += [slot + k for k, v in enumerate(s.views) if v.cols]
            slot += len(s.views)
            s.views = [v for v in s.views if v.cols]
        return Model(book, states, model.rows().withColumn("z", F.array(*[F.get("z", k) for k in keep])))
    return Model(book, states, model.data)


def flatten(model: Model, seed: int = 0) -> Model:
    """All columns in one view of each state, that of its first column, with components drawn anew."""
    rng = np.random.default_rng([seed, 9])
    slots, states, stats = [], [], suffstats(model.rows(), model.codebook, [len(v.weights) for s in model.states for v in s.views])
    for k, s in enumerate(model.states):
        v = s.view_of(0)
        view, slot = s.views[v], model.slot(k, v)
        one = View(list(range(len(model.codebook.columns))), view.weights, view.sizes, process=view.process)
        for j, c in enumerate(model.codebook.columns):
            s.priors.setdefault(j, draw_prior(c, rng))
            one.params[j] = _posterior(c, s.priors[j], stats[slot][j], rng)
            if c.mnar:
                one.present[j] = dist.posterior_draw("presence", {}, stats[slot][-1 - j], rng)
        states.append(State([one], s.process, s.priors, s.diagnostics))
        slots.append(slot)
    return Model(model.codebook, states, model.rows().withColumn("z", F.array(*[F.get("z", x) for x in slots])))
