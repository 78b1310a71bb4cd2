"""Linear classifiers with squared hinge loss: every label of every task in one fit.

Each label of a task is one output, a convex problem of its own: half the squared norm of its weights plus the sum of squared
hinge losses, bias included. All outputs descend side by side, each with its own steps: a step is one pass over the rows
in which every partition sums losses and gradients of all outputs, added up by one aggregation. Tasks of few terms sum their
curvature too and take Newton steps, each with a second pass for its length, some tens in all; the others take limited-memory BFGS steps, thousands where counts are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 12  # pairs of steps that a direction is made from
CURVATURE = 8_000_000  # entries of curvature that a pass may send the driver, of all tasks with Newton steps
#: Step lengths at which slopes along a Newton direction are summed; between two of them the step is interpolated.
STEPS = np.concatenate(([0.0], 2.0 ** np.arange(-24, 0.5, 0.5)))
PAIRS = 4_000_000  # pairs of a row's terms that are multiplied out at once


@dataclass
class _Descent:
    """One output's descent; ``trial`` is where losses are wanted next."""

    x: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    trial: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    pairs: list = field(default_factory=list)
    first: float = 0.0

    def __post_init__(self):
        self.trial = self.x

    def told(self, loss: float, grad: np.ndarray, tolerance: float) -> None:
        """Takes the trial point if its loss fell enough, else shortens the step."""
        if self.grad is not None:
            slope = self.step * float(self.grad @ self.direction)
            # Near the end losses differ by less than their sums are exact to.
            if loss > self.loss + 1e-4 * slope + 1e-11 * abs(self.loss) and self.step > 1e-8:
                self.step /= 2
                self.trial = self.x + self.step * self.direction
                return
            s, y = self.trial - self.x, grad - self.grad
            if s @ y > 0:
                self.pairs = [*self.pairs[-MEMORY + 1:], (s, y, 1 / float(s @ y))]
            stuck = self.step <= 1e-8
        else:
            self.first, stuck = float(np.linalg.norm(grad)), False
        self.x, self.loss, self.grad = self.trial, loss, grad
        # The problem is strongly convex, so the gradient's norm bounds the distance to its solution.
        if stuck or np.linalg.norm(grad) <= max(tolerance, 1e-9 * self.first):
            self.done = True
            return
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(self.pairs):
            alphas.append(rho * float(s @ q))
            q -= alphas[-1] * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(grad)))
        for (s, y, rho), alpha in zip(self.pairs, reversed(alphas)):
            q += (alpha - rho * float(y @ q)) * s
        self.direction, self.step = -q, 1.0
        self.trial = self.x + self.direction


@dataclass
class _Newton:
    """The Newton steps of a task's outputs, taken together; ``direction`` is set while a step's length is wanted."""

    x: np.ndarray
    done: np.ndarray
    direction: np.ndarray | None = None
    first: np.ndarray | None = None

    def bent(self, grad: np.ndarray, curvature: Callable[[int], np.ndarray], tolerance: float) -> None:
        """Takes the gradient (with the norm's) at ``x`` and the curvature by output, and sets out."""
        lengths = np.linalg.norm(grad, axis=0)
        self.first = lengths if self.first is None else self.first
        self.done |= lengths <= np.maximum(tolerance, 1e-9 * self.first)
        if not self.done.all():
            self.direction = np.zeros_like(self.x)
            for k in np.flatnonzero(~self.done):
                self.direction[:, k] = -np.linalg.solve(curvature(int(k)), grad[:, k])

    def reached(self, slopes: np.ndarray) -> None:
        """Goes to where the slope along each direction vanishes, from slopes (outputs x steps) but for the norm's."""
        x, d = self.x, self.direction
        slopes = slopes + (x * d).sum(0)[:, None] + (d * d).sum(0)[:, None] * STEPS
        for k in np.flatnonzero(~self.done):
            rising = np.flatnonzero(slopes[k] > 0)
            if not len(rising):
                step = 1.0
            elif rising[0] == 0:  # no way down is left that sums are exact enough to show
                self.done[k] = True
                continue
            else:
                a, b = rising[0] - 1, rising[0]
                step = STEPS[a] + (STEPS[b] - STEPS[a]) * slopes[k, a] / (slopes[k, a] - slopes[k, b])
            x[:, k] += step * d[:, k]
        self.direction = None


def margins(place: np.ndarray, at: np.ndarray, value: np.ndarray, n_rows: int, weights: np.ndarray) -> np.ndarray:
    """(rows x outputs) of sparse rows, given as row numbers, places and values; the last weight is the bias."""
    out = np.empty((n_rows, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(place, value * weights[at, k], n_rows) + weights[-1, k]
    return out


def _losses(rows: dict, weights: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Losses by output, and gradients (weights x outputs)."""
    m = margins(rows["place"], rows["at"], rows["value"], len(rows["total"]), weights)
    yes = rows["yes"]
    no = rows["total"][:, None] - yes
    short, over = np.maximum(0, 1 - m), np.maximum(0, 1 + m)
    slope = 2 * cost * (no * over - yes * short)
    grad = np.empty_like(weights)
    for k in range(weights.shape[1]):
        grad[:-1, k] = np.bincount(rows["at"], rows["value"] * slope[rows["place"], k], len(weights) - 1)
    grad[-1] = slope.sum(0)
    return cost * (yes * short ** 2 + no * over ** 2).sum(0), grad


def _curvature(rows: dict, weights: np.ndarray, cost: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, sums) of each output: the upper half of the second derivatives but for the norm's, by row * size + column, bias last."""
    m = margins(rows["place"], rows["at"], rows["value"], len(rows["total"]), weights)
    bent = 2 * cost * (rows["yes"] * (m < 1) + (rows["total"][:, None] - rows["yes"]) * (m > -1))
    size, n_rows = len(weights), len(m)
    # the bias is a term of value one in every row
    place = np.concatenate((rows["place"], np.arange(n_rows)))
    order = np.argsort(place, kind="stable")
    place, at, value = place[order], np.concatenate((rows["at"], np.full(n_rows, size - 1)))[order].astype(np.int64), np.concatenate((rows["value"], np.ones(n_rows)))[order]
    counts = np.bincount(place, minlength=n_rows)
    ends = np.cumsum(counts)
    groups = np.cumsum(counts.astype(np.int64) ** 2) // PAIRS
    sums: list[dict] = []
    for first in np.unique(groups, return_index=True)[1]:
        last = np.searchsorted(groups, groups[first], "right")
        own = slice(ends[first] - counts[first], ends[last - 1])
        many = counts[place[own]]
        left = np.repeat(np.arange(own.start, own.stop), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + (ends - counts)[place[left]]
        upper = at[left] <= at[right]
        left, right = left[upper], right[upper]
        slots, which = np.unique(at[left] * size + at[right], return_inverse=True)
        x = value[left] * value[right]
        sums.append({"slots": slots, "x": [np.bincount(which, x * bent[place[left], k], len(slots)) for k in range(weights.shape[1])]})
    slots, which = np.unique(np.concatenate([s["slots"] for s in sums]), return_inverse=True)
    for k in range(weights.shape[1]):
        yield slots, np.bincount(which, np.concatenate([s["x"][k] for s in sums]), len(slots))


def _slopes(rows: dict, weights: np.ndarray, direction: np.ndarray, cost: float) -> np.ndarray:
    """(outputs x steps): slopes of the losses along ``direction``."""
    m, d = (margins(rows["place"], rows["at"], rows["value"], len(rows["total"]), w) for w in (weights, direction))
    yes, no = rows["yes"], rows["total"][:, None] - rows["yes"]
    return np.stack([2 * cost * ((no * np.maximum(0, 1 + m + t * d) - yes * np.maximum(0, 1 - m - t * d)) * d).sum(0) for t in STEPS], 1)


def sparse_rows(batch: pa.RecordBatch, only: np.ndarray | None = None) -> dict:
    """Row numbers, places and values of the list columns ``at`` and ``value``."""
    if only is not None:
        batch = batch.filter(pa.array(only))
    sizes = np.array(batch.column("at").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return {"place": np.repeat(np.arange(batch.num_rows), sizes), "at": batch.column("at").flatten().to_numpy(zero_copy_only=False),
            "value": batch.column("value").flatten().to_numpy(zero_copy_only=False), "batch": batch}


def fit_outputs(rows: DataFrame, sizes: dict[int, tuple[int, int]], cost: float = 1.0, tolerance: float = 1e-4, passes: int = 5000) -> dict[int, np.ndarray]:
    """Weights (places + bias x labels) of every task, from rows (task int, at array<int>, value array<double>, label array<int>, n array<double>).

    ``sizes`` names each task's (places, labels); a row's ``n`` counts its occurrences under each of ``label``, so equal texts
    are one row. The weights, places x labels of all tasks, are what the driver holds and hands out each pass; rows never leave their partitions. Tasks
    with the smallest vocabularies, as far as :data:`CURVATURE` goes, send their outputs' curvature as well. A
    fit ends where every output's gradient is shorter than ``tolerance`` (or a billionth of its first); ``passes`` is far beyond.
    """
    spark = rows.sparkSession
    outputs = [(t, k) for t in sorted(sizes) for k in range(sizes[t][1])]
    offsets, end = {}, 0
    for t in sorted(sizes):
        offsets[t] = end
        end += (sizes[t][0] + 1) * sizes[t][1]
    newton, base, room = set(), {}, 0
    for t in sorted(sizes, key=lambda t: (sizes[t][1] * sizes[t][0] ** 2, t)):
        room += sizes[t][1] * (sizes[t][0] + 1) * (sizes[t][0] + 2) // 2
        if room <= CURVATURE:
            newton.add(t)
    top = end  # slots of curvature, and of slopes, follow those of the weights
    for t, k in outputs:
        if t in newton:
            base[t, k] = top
            top += max((sizes[t][0] + 1) ** 2, len(STEPS))
    descents = {(t, k): _Descent(np.zeros(sizes[t][0] + 1)) for t, k in outputs if t not in newton}
    steps = {t: _Newton(np.zeros((sizes[t][0] + 1, sizes[t][1])), np.zeros(sizes[t][1], bool)) for t in newton}
    for _ in range(passes):
        live = sorted({t for (t, k), d in descents.items() if not d.done} | {t for t, own in steps.items() if not own.done.all()})
        if not live:
            break
        now = {t: (steps[t].x, steps[t].direction) if t in newton else (np.stack([descents[t, k].trial for k in range(sizes[t][1])], 1), None) for t in live}
        told = spark.sparkContext.broadcast(now)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                tasks = batch.column("task").to_numpy()
                for t in np.unique(tasks):
                    if int(t) not in told.value:
                        continue
                    weights, direction = told.value[int(t)]
                    part = sparse_rows(batch, tasks == t)
                    own = part["batch"]
                    lengths = own.column("label").value_lengths().to_numpy(zero_copy_only=False)
                    owner, n = np.repeat(np.arange(own.num_rows), lengths), own.column("n").flatten().to_numpy()
                    part["yes"] = np.zeros((own.num_rows, weights.shape[1]))
                    np.add.at(part["yes"], (owner, own.column("label").flatten().to_numpy()), n)
                    part["total"] = part["yes"].sum(1)
                    if direction is not None:
                        for k, x in enumerate(_slopes(part, weights, direction, cost)):
                            yield pa.RecordBatch.from_arrays([pa.array(base[int(t), k] + np.arange(len(x))), pa.array(x)], names=["slot", "x"])
                        continue
                    loss, grad = _losses(part, weights, cost)
                    if int(t) in newton:
                        for k, (slots, x) in enumerate(_curvature(part, weights, cost)):
                            yield pa.RecordBatch.from_arrays([pa.array(slots + base[int(t), k], pa.int64()), pa.array(x)], names=["slot", "x"])
                    if t in sums:
                        sums[t][0] += loss
                        sums[t][1] += grad
                    else:
                        sums[t] = [loss, grad]
            for t, (loss, grad) in sums.items():
                flat = grad.ravel()
                used = np.flatnonzero(flat)
                first = sum(sizes[s][1] for s in sorted(sizes) if s < t)
                slots = np.concatenate((used + offsets[t], -1 - first - np.arange(len(loss))))
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.concatenate((flat[used], loss)))], names=["slot", "x"])

        found = rows.mapInArrow(summed, "slot long, x double").groupBy("slot").agg(F.sum("x").alias("x")).toArrow()
        told.destroy()
        slots, x = found["slot"].to_numpy(), found["x"].to_numpy()
        grads, losses = np.zeros(end), np.zeros(len(outputs))
        flat = (slots >= 0) & (slots < end)
        grads[slots[flat]] = x[flat]
        losses[-1 - slots[slots < 0]] = x[slots < 0]

        def sums_of(t: int, k: int, length: int) -> np.ndarray:
            met = (slots >= base[t, k]) & (slots < base[t, k] + length)
            out = np.zeros(length)
            out[slots[met] - base[t, k]] = x[met]
            return out

        def curvature(t: int, k: int) -> np.ndarray:
            size = sizes[t][0] + 1
            half = sums_of(t, k, size * size).reshape(size, size)
            return half + np.triu(half, 1).T + np.eye(size)

        own = {t: grads[offsets[t]:offsets[t] + (sizes[t][0] + 1) * sizes[t][1]].reshape(-1, sizes[t][1]) for t in live}
        for t in live:
            if t in newton and steps[t].direction is not None:
                steps[t].reached(np.stack([sums_of(t, k, len(STEPS)) for k in range(sizes[t][1])]))
            elif t in newton:
                steps[t].bent(own[t] + steps[t].x, lambda k, t=t: curvature(t, k), tolerance)
        for o, (t, k) in enumerate(outputs):
            if (t, k) in descents and not descents[t, k].done:
                d = descents[t, k]
                d.told(losses[o] + 0.5 * float(d.trial @ d.trial), own[t][:, k] + d.trial, tolerance)
    return {t: steps[t].x if t in newton else np.stack([descents[t, k].x for k in range(sizes[t][1])], 1) for t in sizes}
