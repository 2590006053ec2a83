"""A small dense network on one flat parameter vector, trained batch by batch inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

# Names and constants a user can choose from.
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805
TRUNCATED_STD = 0.8796256610342398
LOSSES = ("mse", "mae")


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _negative(z):
    return np.minimum(z, 0.0)


# Value of the activation, and its derivative from the input z and the value a.
# The softmax mixes the units of a layer and is handled where it is used.
ACTIVATIONS = {
    "elu": (
        lambda z: np.where(z > 0, z, np.expm1(_negative(z))),
        lambda z, a: np.where(z > 0, 1.0, np.exp(_negative(z))),
    ),
    "softmax": (_softmax, None),
    "selu": (
        lambda z: SELU_SCALE * np.where(z > 0, z, SELU_ALPHA * np.expm1(_negative(z))),
        lambda z, a: SELU_SCALE * np.where(z > 0, 1.0, SELU_ALPHA * np.exp(_negative(z))),
    ),
    "softplus": (lambda z: np.logaddexp(0.0, z), lambda z, a: _sigmoid(z)),
    "softsign": (
        lambda z: z / (1.0 + np.abs(z)),
        lambda z, a: 1.0 / (1.0 + np.abs(z)) ** 2,
    ),
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z, a: 1.0 - a * a),
    "sigmoid": (_sigmoid, lambda z, a: a * (1.0 - a)),
    "hard_sigmoid": (
        lambda z: np.clip(0.2 * z + 0.5, 0.0, 1.0),
        lambda z, a: np.where(np.abs(z) < 2.5, 0.2, 0.0),
    ),
    "exponential": (np.exp, lambda z, a: a),
}


def _truncated(rng, std, shape):
    x = rng.standard_normal(shape)
    while (far := np.abs(x) > 2.0).any():
        x[far] = rng.standard_normal(int(far.sum()))
    return std * x


def _spread(kind: str, fan: str, scale: float):
    """Weights whose variance is ``scale`` over the number of inputs, or of inputs and outputs."""

    def make(rng, shape):
        n = shape[0] if fan == "in" else (shape[0] + shape[1]) / 2.0
        if kind == "uniform":
            limit = np.sqrt(3.0 * scale / n)
            return rng.uniform(-limit, limit, shape)
        return _truncated(rng, np.sqrt(scale / n) / TRUNCATED_STD, shape)

    return make


def _orthogonal(rng, shape):
    long = rng.standard_normal((max(shape), min(shape)))
    q, r = np.linalg.qr(long)
    q = q * np.sign(np.diag(r))
    return q if q.shape == tuple(shape) else q.T


INITIALIZERS = {
    "Zeros": lambda rng, shape: np.zeros(shape),
    "Ones": lambda rng, shape: np.ones(shape),
    "Constant": lambda rng, shape: np.zeros(shape),
    "RandomNormal": lambda rng, shape: 0.05 * rng.standard_normal(shape),
    "RandomUniform": lambda rng, shape: rng.uniform(-0.05, 0.05, shape),
    "TruncatedNormal": lambda rng, shape: _truncated(rng, 0.05, shape),
    "VarianceScaling": _spread("normal", "in", 1.0),
    "Orthogonal": _orthogonal,
    "Identity": lambda rng, shape: np.eye(*shape),
    "lecun_uniform": _spread("uniform", "in", 1.0),
    "glorot_normal": _spread("normal", "both", 1.0),
    "glorot_uniform": _spread("uniform", "both", 1.0),
    "he_normal": _spread("normal", "in", 2.0),
    "lecun_normal": _spread("normal", "in", 1.0),
    "he_uniform": _spread("uniform", "in", 2.0),
}


@dataclass(frozen=True)
class Network:
    """Layer sizes from input to output; the output layer is linear."""

    sizes: tuple[int, ...]
    activation: str
    dropout: float = 0.0
    loss: str = "mse"
    l1: float = 0.0
    l2: float = 0.0

    @property
    def n_parameters(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def initial(self, initializer: str, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            parts += [np.ravel(INITIALIZERS[initializer](rng, (a, b))), np.zeros(b)]
        return np.concatenate(parts).astype(float)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        value, _ = ACTIVATIONS[self.activation]
        *hidden, last = self.layers(flat)
        for w, b in hidden:
            x = value(x @ w + b)
        return x @ last[0] + last[1]

    def loss_of(self, flat: np.ndarray, x: np.ndarray, copies: np.ndarray | float = 1.0) -> float:
        """Sum over the rows and their copies of the mean loss of a row."""
        diff = self.predict(flat, x) - x
        each = diff * diff if self.loss == "mse" else np.abs(diff)
        return float((each.mean(axis=1) * copies).sum())

    def gradient(
        self,
        flat: np.ndarray,
        x: np.ndarray,
        rng: np.random.Generator | None = None,
        copies: np.ndarray | None = None,
    ) -> tuple[float, np.ndarray]:
        """Mean loss with the activity penalty, and its gradient; dropout only with ``rng``.

        ``copies`` counts how often every row occurs.
        """
        loss, grad = self.gradients(flat[None], x[None], rng, None if copies is None else copies[None])
        return float(loss[0]), grad[0]

    def gradients(
        self,
        flats: np.ndarray,
        x: np.ndarray,
        rng: np.random.Generator | None = None,
        copies: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`gradient` of several networks at once: weights (networks, parameters), rows
        (networks, rows, features) and copies (networks, rows). Rows with 0 copies are filling."""
        value, slope = ACTIVATIONS[self.activation]
        many, layers, at = len(flats), [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            layers.append((flats[:, at : at + a * b].reshape(many, a, b), flats[:, None, at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        c = np.ones((many, x.shape[1], 1)) if copies is None else copies[:, :, None]
        n = c.sum(axis=1, keepdims=True)
        n[n == 0] = 1.0
        penalised = self.l1 != 0 or self.l2 != 0
        inputs, seen, penalty = [x], [], 0.0
        for w, b in layers[:-1]:
            z = inputs[-1] @ w + b
            a = value(z)
            if penalised:
                penalty = penalty + (c * (self.l1 * np.abs(a) + self.l2 * a * a)).sum(axis=(1, 2)) / n[:, 0, 0]
            mask = None
            h = a
            if rng is not None and self.dropout > 0:
                mask = (rng.random(a.shape) >= self.dropout) / (1.0 - self.dropout)
                h = a * mask
            seen.append((z, a, mask))
            inputs.append(h)
        w, b = layers[-1]
        diff = inputs[-1] @ w + b - x
        size = n * x.shape[2]
        if self.loss == "mse":
            loss, back = (c * diff * diff).sum(axis=(1, 2)) / size[:, 0, 0], 2.0 * c * diff / size
        else:
            loss, back = (c * np.abs(diff)).sum(axis=(1, 2)) / size[:, 0, 0], c * np.sign(diff) / size
        parts = [back.sum(axis=1), (inputs[-1].swapaxes(1, 2) @ back).reshape(many, -1)]
        back = back @ w.swapaxes(1, 2)
        for (w, b), (z, a, mask), given in zip(
            reversed(layers[:-1]), reversed(seen), reversed(inputs[:-1])
        ):
            if mask is not None:
                back = back * mask
            if penalised:
                back = back + c * (self.l1 * np.sign(a) + 2.0 * self.l2 * a) / n
            if slope is None:
                back = a * (back - (back * a).sum(axis=2, keepdims=True))
            else:
                back = back * slope(z, a)
            parts += [back.sum(axis=1), (given.swapaxes(1, 2) @ back).reshape(many, -1)]
            back = back @ w.swapaxes(1, 2)
        return loss + penalty, np.concatenate(parts[::-1], axis=1)


EPS = 1e-7


class Optimizer:
    """Update rules with their usual settings; ``memory`` is averaged like the weights."""

    def __init__(self, name: str):
        if name not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {name!r}, choose from {', '.join(OPTIMIZERS)}")
        self.update, self.slots = OPTIMIZERS[name]

    def initial(self, n_parameters: int) -> tuple[np.ndarray, np.ndarray]:
        """Memory arrays, and the two numbers kept with them: steps taken, momentum product."""
        return np.zeros((self.slots, n_parameters)), np.array([0.0, 1.0])

    def step(self, flat, grad, memory, counters) -> None:
        counters[0] += 1.0
        self.update(flat, grad, memory, counters)


def _sgd(w, g, m, c):
    w -= 0.01 * g


def _rmsprop(w, g, m, c):
    m[0] += 0.1 * (g * g - m[0])
    w -= 0.001 * g / (np.sqrt(m[0]) + EPS)


def _adagrad(w, g, m, c):
    m[0] += g * g
    w -= 0.01 * g / (np.sqrt(m[0]) + EPS)


def _adadelta(w, g, m, c):
    m[0] += 0.05 * (g * g - m[0])
    move = g * np.sqrt(m[1] + EPS) / np.sqrt(m[0] + EPS)
    m[1] += 0.05 * (move * move - m[1])
    w -= move


def _adam(w, g, m, c):
    m[0] += 0.1 * (g - m[0])
    m[1] += 0.001 * (g * g - m[1])
    rate = 0.001 * np.sqrt(1.0 - 0.999 ** c[0]) / (1.0 - 0.9 ** c[0])
    w -= rate * m[0] / (np.sqrt(m[1]) + EPS)


def _adamax(w, g, m, c):
    m[0] += 0.1 * (g - m[0])
    np.maximum(0.999 * m[1], np.abs(g), out=m[1])
    w -= 0.002 / (1.0 - 0.9 ** c[0]) * m[0] / (m[1] + EPS)


def _nadam(w, g, m, c):
    now = 0.9 * (1.0 - 0.5 * 0.96 ** (c[0] * 0.004))
    after = 0.9 * (1.0 - 0.5 * 0.96 ** ((c[0] + 1.0) * 0.004))
    c[1] *= now
    m[0] += 0.1 * (g - m[0])
    m[1] += 0.001 * (g * g - m[1])
    mean = (1.0 - now) * g / (1.0 - c[1]) + after * m[0] / (1.0 - c[1] * after)
    w -= 0.002 * mean / (np.sqrt(m[1] / (1.0 - 0.999 ** c[0])) + EPS)


OPTIMIZERS = {
    "sgd": (_sgd, 0),
    "rmsprop": (_rmsprop, 1),
    "adagrad": (_adagrad, 1),
    "adadelta": (_adadelta, 2),
    "adam": (_adam, 2),
    "adamax": (_adamax, 2),
    "nadam": (_nadam, 2),
}


def check_choices(activation: str, initializer: str, loss: str, hidden: Sequence[int]) -> None:
    for name, known, what in (
        (activation, ACTIVATIONS, "activation"),
        (initializer, INITIALIZERS, "kernel initializer"),
        (loss, LOSSES, "loss"),
    ):
        if name not in known:
            raise ValueError(f"unknown {what} {name!r}, choose from {', '.join(known)}")
    if not hidden or list(hidden) != list(hidden)[::-1]:
        raise ValueError(f"hidden layers must read the same both ways: {list(hidden)}")
