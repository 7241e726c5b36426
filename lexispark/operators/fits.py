"""Fitting by whole passes over sparse rows: rows are packed once, each pass is one job that sums arrays by a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of one packed batch, whose rows of weights are looked up at once, which bounds the memory of a task.
ENTRIES = 32_000
#: Outputs up to which sums go column by column; bytes of partial sums up to which the driver adds them up itself.
FEW, GATHERED = 32, 128 << 20


def sparse(features: str | Column) -> Column:
    """A vector as a struct of type, size, indices and values, which Arrow can carry."""
    return F.unwrap_udt(F.col(features) if isinstance(features, str) else features)


def rows_of(col: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, place and value of each entry of a batch of vectors, and the number of rows."""
    row, place, value = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for i, (indices, values) in enumerate(zip(col["indices"], col["values"])):
        values = np.asarray(values, dtype=float)
        place.append(np.asarray(indices, dtype=int) if indices is not None else np.arange(len(values)))
        row.append(np.full(len(values), i))
        value.append(values)
    return np.concatenate(row), np.concatenate(place), np.concatenate(value), len(col)


@dataclass
class Rows:
    """Some rows of features: entries (row, place, value) in the order of rows, the number of each row's class, the order
    that sorts the entries by place, and how many times each row counts (once, if that is not given)."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    y: np.ndarray
    order: np.ndarray | None = None
    weight: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.y)

    def parts(self) -> Iterator[Rows]:
        """The rows in runs of some ENTRIES entries; a row stays whole."""
        ends = np.searchsorted(self.row, np.arange(len(self)), side="right")
        a = 0
        while a < len(self):
            begin = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, begin + ENTRIES, side="right")))
            some = slice(begin, ends[z - 1])
            yield Rows(self.row[some] - a, self.place[some], self.value[some], self.y[a:z], None, None if self.weight is None else self.weight[a:z])
            a = z

    def weighed(self, by_row: np.ndarray) -> np.ndarray:
        """by_row (rows by outputs), each row as often as it counts."""
        return by_row if self.weight is None else by_row * self.weight[:, None].astype(by_row.dtype)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The rows times a matrix of weights (places by outputs)."""
        if weights.shape[1] <= FEW:
            return np.stack([np.bincount(self.row, weights=self.value * w[self.place], minlength=len(self)) for w in weights.T], axis=1)
        out = np.zeros((len(self), weights.shape[1]), dtype=weights.dtype)
        if len(self.row):
            starts = np.flatnonzero(np.diff(self.row, prepend=-1))
            out[self.row[starts]] = np.add.reduceat(weights[self.place] * self.value[:, None].astype(weights.dtype), starts, axis=0)
        return out

    def back(self, by_row: np.ndarray, into: np.ndarray) -> None:
        """Add the transposed rows times by_row (rows by outputs) to `into` (places by outputs)."""
        if by_row.shape[1] <= FEW:
            for k in range(by_row.shape[1]):
                into[:, k] += np.bincount(self.place, weights=self.value * by_row[self.row, k], minlength=len(into))
        elif len(self.row):
            order = np.argsort(self.place, kind="stable") if self.order is None else self.order
            place = self.place[order]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            into[place[starts]] += np.add.reduceat(by_row[self.row[order]] * self.value[order][:, None].astype(by_row.dtype), starts, axis=0)


_PACKED = {"row": np.int32, "place": np.int32, "value": np.float32, "y": np.int32, "order": np.int32, "weight": np.float64}


@dataclass
class Packed:
    """Rows with a class, packed into few rows of binaries that are kept in memory or on disk: their number, the sorted
    classes, and the number of features. `frame` has as many partitions as are worth a task; close() lets the rows go. Where
    rows are `weighted`, `rows` is the sum of their weights."""

    frame: DataFrame
    kept: DataFrame
    tasks: int
    labels: list[str]
    width: int
    rows: int
    weighted: bool = False

    def close(self) -> None:
        self.kept.unpersist()


def packed(df: DataFrame, features: str, label: str, weight: str | None = None) -> Packed:
    """df packed for passes over it. Rows without a class are left out; values are kept in single precision. With `weight`,
    a column of whole numbers, a row stands for so many equal ones."""
    df = df.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    first = df.select(features).first()
    if first is None:
        raise ValueError("no rows to learn from")
    data = df.select(sparse(features).alias("v"), (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("int").alias("y"), *([] if weight is None else [F.col(weight).cast("double").alias("weight")]))
    data = data.select("v.indices", "v.values", "y", *([] if weight is None else ["weight"]))
    columns = [k for k in _PACKED if weight is not None or k != "weight"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, place, value, _ = rows_of(b)
            for x in Rows(row, place, value, b["y"].to_numpy(np.int32), None, None if weight is None else b["weight"].to_numpy()).parts():
                x.order = np.argsort(x.place, kind="stable")
                yield pd.DataFrame({k: [getattr(x, k).astype(kind).tobytes()] for k, kind in _PACKED.items() if k in columns})

    made = data.mapInPandas(run, ", ".join(f"{k} binary" for k in columns))
    most = df.sparkSession.sparkContext.defaultParallelism
    kept = made.coalesce(most).persist()
    entries = F.sum(F.octet_length("row") / 4).cast("long")
    n = kept.agg((F.sum(F.octet_length("y")) / 4).cast("long").alias("rows"), entries.alias("entries")).first()
    tasks = max(1, min(most, (n.entries or 0) // (6 * ENTRIES)))
    rows = n.rows if weight is None else int(df.agg(F.sum(weight)).first()[0] or 0)
    return Packed(kept.coalesce(tasks), kept, tasks, labels, first[0].size, rows, weight is not None)


def summed(data: Packed, sums: Callable[[Iterator[Rows]], np.ndarray], size: int, order: bool = False) -> np.ndarray:
    """sums(rows) of each partition, arrays of about `size` bytes, added up: one job, whatever the number of partitions. A
    task sends what is not zero. More than GATHERED bytes are added up by a tree in the executors. With `order` the rows
    have their entries' order by place."""
    columns = [k for k in _PACKED if (order or k != "order") and (data.weighted or k != "weight")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (Rows(**{k: np.frombuffer(r, _PACKED[k]) for k, r in zip(columns, x)}) for b in batches for x in zip(*(b[k] for k in columns)))
        out = sums(rows)
        at = np.flatnonzero(out)
        some = 2 * len(at) < len(out)
        yield pd.DataFrame({"kind": [out.dtype.str], "size": [len(out)], "at": [at.astype(np.int32).tobytes() if some else None], "sums": [(out[at] if some else out).tobytes()]})

    def added(total: np.ndarray | None, r) -> np.ndarray:
        own = np.frombuffer(r.sums, dtype=np.dtype(r.kind))
        total = np.zeros(r.size, own.dtype) if total is None else total
        if r["at"] is None:
            total += own
        else:
            total[np.frombuffer(r["at"], np.int32)] += own
        return total

    found, total = data.frame.select(*columns).mapInPandas(run, "kind string, size long, at binary, sums binary"), None
    if size * data.tasks > GATHERED:
        return found.rdd.map(lambda r: added(None, r)).treeReduce(np.add, depth=2)
    for r in found.collect():
        total = added(total, r)
    return total


class Descent:
    """L-BFGS of one function whose values and gradients are given from outside, trial by trial: `trial` is the next point
    to be tried; told() takes what was found there. Steps are halved until the value falls enough."""

    def __init__(self, start: np.ndarray, tolerance: float, history: int = 7):
        self.trial, self.x, self.tolerance, self.history = start, None, tolerance, history
        self.value, self.slope, self.done, self.steps = np.inf, None, False, 0
        self.past: list[tuple[np.ndarray, np.ndarray, float]] = []

    def told(self, value: float, slope: np.ndarray) -> None:
        if self.x is not None and value > self.value + 1e-4 * self.step * self.along:
            self.step *= 0.5
            if self.step < 1e-10:
                self.trial, self.done = self.x, True
            else:
                self.trial = self.x + self.step * self.direction
            return
        if self.x is not None:
            moved, bent = self.trial - self.x, slope - self.slope
            curve = float(moved @ bent)
            if curve > 1e-12 * float(bent @ bent):
                self.past = [*self.past, (moved, bent, curve)][-self.history :]
        fell = self.value - value
        self.x, self.value, self.slope, self.steps = self.trial, value, slope, self.steps + 1
        if np.abs(slope).max(initial=0.0) < self.tolerance or fell < self.tolerance * abs(value):
            self.done = True
            return
        q, scales = slope.copy(), []
        for moved, bent, curve in reversed(self.past):
            scales.append(float(moved @ q) / curve)
            q -= scales[-1] * bent
        if self.past:
            moved, bent, curve = self.past[-1]
            q *= curve / float(bent @ bent)
        for (moved, bent, curve), scale in zip(self.past, reversed(scales)):
            q += (scale - float(bent @ q) / curve) * moved
        self.direction, self.along = -q, -float(slope @ q)
        self.step = 1.0 if self.past else 1.0 / max(1.0, float(np.linalg.norm(slope)))
        self.trial = self.x + self.step * self.direction


def logistic_of_all(df: DataFrame, features: str, label: str, ridge: float = 0.001, rounds: int = 50, tolerance: float = 1e-6, weight: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """One-against-rest logistic regressions of all classes: (classes, weights, bias).

    Each class has a descent of its own, but all try their points in the same pass, so the number of jobs does not grow
    with the classes. Each minimises the mean of log(1 + exp(-margin)) plus ridge / 2 times the squared weights, the bias
    aside. The driver holds some 15 times the weights of all classes; a task sends them once. With `weight` a row counts
    so many times."""
    data = packed(df, features, label, weight)
    labels, width, total = data.labels, data.width, data.rows
    spark, number = df.sparkSession, len(labels)
    own = [Descent(np.zeros(width + 1), tolerance) for _ in labels]
    for _ in range(2 * rounds):
        at = [k for k in range(number) if not own[k].done and own[k].steps <= rounds]
        if not at:
            break
        sent = spark.sparkContext.broadcast((at, np.stack([own[k].trial for k in at], axis=1)))

        def sums(rows: Iterator[Rows], sent=sent) -> np.ndarray:
            at, points = sent.value
            weights, bias = np.ascontiguousarray(points[:-1]), points[-1]
            loss, slope, ends = np.zeros(len(at)), np.zeros_like(weights), np.zeros(len(at))
            for part in rows:
                margin = part.times(weights) + bias
                mine = part.y[:, None] == np.array(at)
                signed = np.where(mine, -margin, margin)
                loss += part.weighed(np.logaddexp(0.0, signed)).sum(axis=0)
                off = part.weighed(1 / (1 + np.exp(-np.clip(margin, -500, 500))) - mine)
                ends += off.sum(axis=0)
                part.back(off, slope)
            return np.concatenate([loss, slope.ravel(), ends])

        found = summed(data, sums, 8 * (width + 2) * len(at))
        loss, slope, ends = found[: len(at)] / total, found[len(at) : -len(at)].reshape(width, len(at)) / total, found[-len(at) :] / total
        for i, k in enumerate(at):
            w = own[k].trial[:-1]
            own[k].told(float(loss[i] + ridge / 2 * (w @ w)), np.append(slope[:, i] + ridge * w, ends[i]))
        sent.destroy()
    data.close()
    points = np.array([d.trial if d.x is None else d.x for d in own]).reshape(number, width + 1)
    return labels, points[:, :-1], points[:, -1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def forward(rows: Rows, first: np.ndarray, first_bias: np.ndarray, second: np.ndarray, second_bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden units of a network with one tanh layer, and its shares of the classes."""
    hidden = np.tanh(rows.times(first) + first_bias)
    return hidden, softmax(hidden @ second + second_bias)


def network_of_words(df: DataFrame, features: str, label: str, units: int = 209, rounds: int = 25, rate: float = 0.02, ridge: float = 1e-5, enough: float = 0.01, seed: int = 786, weight: str | None = None) -> tuple[list[str], list[np.ndarray]]:
    """A network with one layer of tanh units and a softmax, over all features: (classes, [first weights, first bias,
    second weights, second bias]).

    Rows stay sparse: a row costs its own entries times the units. Each round is one pass over all rows for the gradient
    of the mean loss, and one step of moments (Adam) of all weights on the driver, until the loss is under `enough`. Weights
    are in single precision: 54,000 words of 209 units are 45 MB, which each task gets and sends once a round, and the
    driver holds four times; 11,000 words take 9 MB. Counts of words enter as log(1 + count). With `weight` a row counts
    so many times."""
    data = packed(df, features, label, weight)
    labels, width, total = data.labels, data.width, data.rows
    spark, number = df.sparkSession, len(labels)
    rng = np.random.default_rng(seed)
    spread = lambda a, b, fan: rng.uniform(-1, 1, (a, b)).astype(np.float32) * np.float32(np.sqrt(6 / fan))
    # the few words that a row has are what a unit of the first layer adds up
    weights = [spread(width, units, 50 + units), np.zeros(units, np.float32), spread(units, number, units + number), np.zeros(number, np.float32)]
    sizes = np.cumsum([w.size for w in weights])
    flat = np.concatenate([w.ravel() for w in weights])
    shapes = [w.shape for w in weights]
    parts = lambda x: [p.reshape(s) for p, s in zip(np.split(x, sizes[:-1]), shapes)]
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(1, rounds + 1):
        sent = spark.sparkContext.broadcast(flat)

        def sums(rows: Iterator[Rows], sent=sent) -> np.ndarray:
            first, first_bias, second, second_bias = parts(sent.value)
            slope = np.zeros(len(sent.value) + 1, np.float32)
            down = parts(slope[:-1])
            for part in map(damped, rows):
                hidden, share = forward(part, first, first_bias, second, second_bias)
                every = np.arange(len(part))
                slope[-1] -= part.weighed(np.log(np.maximum(share[every, part.y], 1e-12))[:, None]).sum()
                share[every, part.y] -= 1
                share = part.weighed(share)
                back = (share @ second.T) * (1 - hidden**2)
                down[2] += hidden.T @ share
                down[3] += share.sum(axis=0)
                down[1] += back.sum(axis=0)
                part.back(back.astype(np.float32), down[0])
            return slope

        found = summed(data, sums, flat.nbytes, order=True) / np.float32(total)
        sent.destroy()
        if found[-1] < enough:
            break
        slope = found[:-1] + np.float32(ridge) * flat
        mean += np.float32(0.1) * (slope - mean)
        square += np.float32(0.001) * (slope * slope - square)
        flat = flat - np.float32(rate) * (mean / np.float32(1 - 0.9**turn)) / (np.sqrt(square / np.float32(1 - 0.999**turn)) + np.float32(1e-8))
    data.close()
    return labels, parts(flat)


def damped(rows: Rows) -> Rows:
    """Rows with log(1 + value) for values over 0."""
    return Rows(rows.row, rows.place, np.sign(rows.value) * np.log1p(np.abs(rows.value)), rows.y, rows.order, rows.weight)
