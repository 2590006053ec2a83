"""Autoencoder detector: rows the network reconstructs badly are flagged.

Every row is in one batch of ``batch_size`` rows in every epoch, and every batch makes a step.
A hash deals the rows to replicas of some ROUND_STEPS batches. In an epoch each replica takes
the steps of its batches from the same weights, inside the task that holds its rows; then
weights and the optimizer's memory are averaged by rows. The replicas follow from the number of
rows alone, so the losses and weights are the same whatever the number of tasks. Up to
ROUND_STEPS batches are one replica, that is plain descent batch by batch.

Batches of over BIG_BATCH rows are shared out instead: all tasks add up the gradients of their rows
at the same weights, and one step follows from the sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.arrow import row_array_function, row_function
from strayrow.functions.network import Network, Optimizer, check_choices
from strayrow.operators.base import RowModel, ThresholdRule
from strayrow.operators.frame import as_list, feature_columns, fit_rows
from strayrow.operators.threshold import contamination_threshold
from strayrow.operators.units import Units, deal

HIDDEN = (32, 16, 16, 32)
# Steps that a replica takes between averages, unless its rows are too many.
ROUND_STEPS = 256
REPLICA_ROWS = 65_536
# Replicas whose steps are computed together, where there are more units than this without it.
LANES = 16
LEAST_UNITS = 64
# Rows of a batch that is shared out among tasks, and those of it that make a work unit.
BIG_BATCH = 4096
BATCH_UNIT_ROWS = 64


@dataclass(frozen=True)
class Autoencoder(ThresholdRule, RowModel):
    key = "autoencoder"
    features: tuple[str, ...]
    network: Network
    weights: np.ndarray
    threshold: float = float("nan")
    losses: tuple[float, ...] = ()

    def score_column(self, cells: Sequence[Column]) -> Column:
        """Mean absolute error of the reconstruction."""
        network, weights = self.network, self.weights
        return row_function(
            lambda x: np.abs(network.predict(weights, x) - x).mean(axis=1), list(cells)
        )

    def reconstruct(
        self, df: DataFrame, id_col: str | Sequence[str], on_null: str = "error"
    ) -> DataFrame:
        """Id columns and ``reconstruction``, the network's output for the row."""
        network, weights = self.network, self.weights
        ids = [F.col(f"`{c}`") for c in as_list(id_col)]
        cells = df.select(*ids, *feature_columns(df, self.features, on_null))
        output = row_array_function(
            lambda x: network.predict(weights, x), [F.col(f"`{f}`") for f in self.features]
        )
        return cells.select(*ids, output.alias("reconstruction"))

    def state(self):
        n = self.network
        settings = {
            "features": list(self.features),
            "sizes": list(n.sizes),
            "activation": n.activation,
            "dropout": n.dropout,
            "loss": n.loss,
            "l1": n.l1,
            "l2": n.l2,
            "threshold": self.threshold,
        }
        return settings, {"weights": self.weights, "losses": np.array(self.losses)}, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        named = {k: settings[k] for k in ("activation", "dropout", "loss", "l1", "l2")}
        network = Network(tuple(settings["sizes"]), **named)
        return cls(
            tuple(settings["features"]),
            network,
            arrays["weights"],
            settings["threshold"],
            tuple(arrays["losses"].tolist()),
        )


def _replicas(n: int, batch_size: int) -> tuple[int, int]:
    """Number of work units for ``n`` rows, and replicas in each of them."""
    rows = min(ROUND_STEPS * batch_size, REPLICA_ROWS)
    replicas = math.ceil(n / rows)
    lanes = max(1, min(LANES, replicas // LEAST_UNITS, REPLICA_ROWS // rows))
    return math.ceil(replicas / lanes), lanes


def _batches(copies: np.ndarray, batch_size: int, rng: np.random.Generator) -> np.ndarray:
    """Places of the rows of every batch, in random order; -1 where a batch has fewer rows than others.

    Copies of a row count as rows. A row has at most ``batch_size`` of them, and its batch is the one
    where the first falls.
    """
    order = rng.permutation(len(copies))
    before = np.cumsum(copies[order]) - copies[order]
    batch = (before // batch_size).astype(np.int64)
    sizes = np.bincount(batch)
    within = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.full((len(sizes), sizes.max()), -1)
    places[batch, within] = order
    return places


def _train(
    x: np.ndarray, copies: np.ndarray, rng: np.random.Generator, network: Network, rule: Optimizer,
    state: np.ndarray, batch_size: int, lanes: int,
) -> np.ndarray:
    """An epoch of the replicas of a unit: number of rows, sum of their losses, and sum of the states by rows.

    A state holds the weights, the optimizer's memory and its two counters.
    """
    p = network.n_parameters
    weights = np.repeat(state[None, :p], lanes, axis=0)
    memory = np.repeat(state[p:-2].reshape(rule.slots, 1, p), lanes, axis=1)
    counters = np.repeat(state[None, -2:], lanes, axis=0)
    places = _batches(copies, batch_size, rng)
    rows, lost = np.zeros(lanes), 0.0
    for start in range(0, len(places), lanes):
        # the last batches may be fewer than the replicas
        at = places[start : start + lanes]
        some = len(at)
        w = np.where(at < 0, 0.0, copies[at])
        loss, grad = network.gradients(weights[:some], x[at], rng, w)
        of_batch = w.sum(axis=1)
        rows[:some] += of_batch
        lost += float(loss @ of_batch)
        held, counted = memory[:, :some], counters[0].copy()
        rule.step(weights[:some], grad, held, counted)
        counters[:some] = counted
    states = np.column_stack([weights, memory.swapaxes(0, 1).reshape(lanes, -1), counters])
    return np.concatenate([[rows.sum(), lost], rows @ states])


def _batch_gradient(
    units: Units, batch: int, network: Network, weights: np.ndarray, salt: tuple[int, ...]
) -> tuple[float, float, np.ndarray]:
    """Rows of a batch, the sum of their losses, and the mean gradient at the weights."""

    def add_up(x: np.ndarray, copies: np.ndarray, chunk: tuple[int, int]) -> np.ndarray:
        rng = np.random.default_rng([*salt, batch, *chunk])
        loss, grad = network.gradient(weights, x, rng, copies)
        n = copies.sum()
        return np.concatenate([[n, n * loss], n * grad])

    total = units.add_up(add_up, len(weights) + 2, batch)
    return total[0], total[1], total[2:] / max(total[0], 1.0)


def _held_loss(units: Units, part: int, network: Network, weights: np.ndarray) -> float | None:
    """Mean loss of the rows held out; None if there are none."""

    def add_up(x: np.ndarray, copies: np.ndarray, _) -> np.ndarray:
        return np.array([copies.sum(), network.loss_of(weights, x, copies)])

    n, loss = units.add_up(add_up, 2, part)
    return float(loss / n) if n else None


def _place(df: DataFrame, order_col: str) -> Column:
    """The order column as a number; dates and times as microseconds."""
    kind = df.schema[order_col].dataType
    column = F.col(f"`{order_col}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        since = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), column.cast("timestamp_ntz"))
        return since.cast("double")
    return column.cast("double")


def fit_network(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    hidden_neurons: Sequence[int] | None = None,
    dropout_rate: float = 0.2,
    activation: str = "elu",
    kernel_initializer: str = "glorot_uniform",
    l1: float = 0.0,
    l2: float = 0.0,
    loss_function: str = "mse",
    optimizer: str = "adam",
    epochs: int = 100,
    batch_size: int = 10,
    validation_split: float = 0.05,
    early_stopping: int | None = None,
    order_col: str | None = None,
    seed: int = 0,
) -> Autoencoder:
    """The detector without its threshold.

    ``validation_split`` holds rows out by the hash of their id, or the last rows by
    ``order_col`` if one is given. ``early_stopping`` is the number of epochs without
    a better validation loss after which training ends; a boolean has no effect.
    """
    features, ids = list(features), as_list(id_col)
    hidden = list(HIDDEN if hidden_neurons is None else hidden_neurons)
    check_choices(activation, kernel_initializer, loss_function, hidden)
    Optimizer(optimizer)
    if len(features) < min(hidden):
        raise ValueError("the smallest hidden layer has more neurons than there are features")
    if not 0.0 <= dropout_rate < 1.0 or not 0.0 <= validation_split < 1.0:
        raise ValueError("dropout_rate and validation_split lie between 0 and 1")
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be at least 1")
    patience = None
    if early_stopping is not None and not isinstance(early_stopping, bool):
        patience = int(early_stopping)

    n = df.count()
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    aside = F.lit(False)
    if validation_split > 0:
        if order_col is None:
            share = F.pmod(F.xxhash64(*ids, F.lit(seed), F.lit("aside")), F.lit(1 << 20))
            aside = share < int(validation_split * (1 << 20))
        else:
            place = _place(df, order_col)
            cut = contamination_threshold(
                df.select(place.alias("o")), "o", validation_split, n
            )
            aside = place > cut
    cells = [F.col(f"`{f}`") for f in features]
    named = [F.col(f"`{c}`") for c in ids]
    big = batch_size > BIG_BATCH
    # Parts are the big batches, or all rows that are trained on; rows held out are one more part.
    parts = math.ceil(n / batch_size) if big else 1
    batch = F.pmod(F.xxhash64(*named, *cells, F.lit(seed), F.lit("batch")), F.lit(parts))
    part = F.when(aside, F.lit(parts)).otherwise(batch)
    if big:
        units = deal(df, features, n, part, parts + 1, named, BATCH_UNIT_ROWS)
    else:
        count, lanes = _replicas(n, batch_size)
        units = deal(df, features, n, part, 2, named, count=count, most=batch_size)
    network = Network(
        (len(features), *hidden, len(features)), activation, dropout_rate, loss_function, l1, l2
    )
    weights = network.initial(kernel_initializer, seed)
    rule = Optimizer(optimizer)
    memory, counters = rule.initial(len(weights))
    losses: list[float] = []
    best, waited = math.inf, 0
    try:
        for epoch in range(epochs):
            # The held-out rows are scored with the weights that the epoch before ended with.
            held = _held_loss(units, parts, network, weights) if epoch and patience is not None else None
            if held is not None:
                best, waited = (held, 0) if held < best else (best, waited + 1)
                if waited >= max(patience, 1):
                    break
            trained = loss = 0.0
            if big:
                for number in np.random.default_rng([seed, epoch]).permutation(parts).tolist():
                    rows, lost, grad = _batch_gradient(units, number, network, weights, (seed, epoch))
                    if not rows:
                        continue
                    rule.step(weights, grad, memory, counters)
                    trained, loss = trained + rows, loss + lost
            else:
                state = np.concatenate([weights, memory.ravel(), counters])

                def epoch_of(x: np.ndarray, copies: np.ndarray, chunk: tuple[int, int]) -> np.ndarray:
                    rng = np.random.default_rng([seed, epoch, chunk[0]])
                    return _train(x, copies, rng, network, rule, state, batch_size, lanes)

                total = units.add_up(epoch_of, len(state) + 2, 0, chunk_rows=None)
                if total[0]:
                    trained, loss, state = total[0], total[1], total[2:] / total[0]
                    p = len(weights)
                    weights, memory, counters = state[:p], state[p:-2].reshape(memory.shape), state[-2:]
            losses.append(loss / max(trained, 1.0))
    finally:
        units.release()
    return Autoencoder(tuple(features), network, weights, losses=tuple(losses))


def fit_autoencoder(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    hidden_neurons: Sequence[int] | None = None,
    dropout_rate: float = 0.2,
    activation: str = "elu",
    kernel_initializer: str = "glorot_uniform",
    l1: float = 0.0,
    l2: float = 0.0,
    loss_function: str = "mse",
    optimizer: str = "adam",
    epochs: int = 100,
    batch_size: int = 10,
    validation_split: float = 0.05,
    contamination: float = 0.1,
    early_stopping: int | None = None,
    order_col: str | None = None,
    seed: int = 0,
    on_null: str = "error",
) -> Autoencoder:
    keep = list(dict.fromkeys([*as_list(id_col), *([order_col] if order_col else [])]))
    rows = fit_rows(df, keep, features, on_null)
    model = fit_network(
        rows, features, id_col, hidden_neurons, dropout_rate, activation, kernel_initializer,
        l1, l2, loss_function, optimizer, epochs, batch_size, validation_split,
        early_stopping, order_col, seed,
    )
    scores = rows.select(model.score_column([F.col(f"`{f}`") for f in features]).alias("score"))
    return replace(model, threshold=contamination_threshold(scores, "score", contamination))
