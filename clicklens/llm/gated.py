"""A bidirectional gated recurrent network with attention pooling, forward and backward in numpy."""

from __future__ import annotations

import numpy as np

CELL = 8
EMBED = 8
BUCKETS = 1 << 14


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters: word and character-gram embeddings, two directions of gates, attention and output."""
    rng = np.random.default_rng(seed)

    def normal(scale: float, *shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": normal(0.1, BUCKETS, EMBED), "gram": normal(0.1, BUCKETS, EMBED)}
    for d in ("f", "b"):
        p["x" + d] = normal(0.3, 2 * EMBED, 3 * CELL)
        p["h" + d] = normal(0.3, CELL, 3 * CELL)
        p["c" + d] = np.zeros(3 * CELL, np.float32)
    p["look"] = normal(0.3, 2 * CELL)
    p["out"] = normal(0.3, 2 * CELL)
    p["bias"] = np.full(1, -1.0, np.float32)
    return p


def embed(p: dict, words: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Input vector of each distinct word: its own embedding beside the sum over its character grams."""
    out = np.zeros((len(words) + 1, 2 * EMBED), np.float32)  # the last row is the padding word
    if len(words):
        out[:-1, :EMBED] = p["word"][words]
        out[:-1, EMBED:] = np.add.reduceat(p["gram"][grams], starts, axis=0)
    return out


def _run(proj: np.ndarray, ids: np.ndarray, weights: np.ndarray, order: range, keep: bool) -> tuple:
    """States of one direction over ids (windows x steps); proj has the input part of the gates for each word."""
    n, steps = ids.shape
    h = np.zeros((n, CELL), np.float32)
    states = np.empty((steps, n, CELL), np.float32)
    trace = {}
    for t in order:
        x = proj[ids[:, t]]
        u = h @ weights
        zr = _sigmoid(x[:, : 2 * CELL] + u[:, : 2 * CELL])
        z, r = zr[:, :CELL], zr[:, CELL:]
        c = np.tanh(x[:, 2 * CELL :] + r * u[:, 2 * CELL :])
        if keep:
            trace[t] = (h, z, r, c, u[:, 2 * CELL :])
        h = c + z * (h - c)
        states[t] = h
    return states, trace


def logits(p: dict, vectors: np.ndarray, ids: np.ndarray, real: np.ndarray, keep: bool = False):
    """One logit per window; ``real`` marks the steps that are words and not padding."""
    steps = ids.shape[1]
    runs, traces = [], {}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        states, traces[d] = _run(vectors @ p["x" + d] + p["c" + d], ids, p["h" + d], order, keep)
        runs.append(states)
    states = np.concatenate(runs, axis=2)
    look = np.where(real.T, states @ p["look"], np.float32(-1e9))
    weight = np.exp(look - look.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnc->nc", weight, states)
    result = pooled @ p["out"] + p["bias"][0]
    return (result, (states, weight, pooled, traces)) if keep else result


def sliding_logits(
    p: dict, vectors: np.ndarray, sequence: np.ndarray, counted: np.ndarray, steps: int, block: int = 2048
) -> np.ndarray:
    """The logits of the windows of ``steps`` words from every place of a sequence on, as far as they fit.

    The same as ``logits`` over all of them. Windows lie in columns: those of step t are a slice of the sequence,
    so each word is looked up once a block. Attention needs two numbers of a state, its look and its share in
    the output, so no states are kept.
    """
    places = len(sequence) - steps + 1
    result = np.empty(max(places, 0), np.float32)
    # exp is faster than tanh: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 2 sigmoid(2 x) - 1.
    scaled = np.repeat(np.array([-1, -2], np.float32), [2 * CELL, CELL])
    sides = []
    for k, (d, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
        own = slice(k * CELL, (k + 1) * CELL)
        proj = np.ascontiguousarray(((vectors @ p["x" + d] + p["c" + d]) * scaled).T)
        weights = np.concatenate([(p["h" + d] * scaled).T, p["look"][None, own], p["out"][None, own]])
        sides.append((proj, np.ascontiguousarray(weights), order))
    with np.errstate(over="ignore"):  # the limits of the gates are right
        for first in range(0, places, block):
            n = min(block, places - first)
            part = slice(first, first + n + steps - 1)
            look, share = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
            h, u = np.empty((CELL, n), np.float32), np.empty((3 * CELL + 2, n), np.float32)
            zr, c = np.empty((2 * CELL, n), np.float32), np.empty((CELL, n), np.float32)
            for proj, weights, order in sides:
                x = proj[:, sequence[part]]
                h[:] = 0
                u[:] = 0
                for t in order:
                    np.add(x[: 2 * CELL, t : t + n], u[: 2 * CELL], out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[CELL:], u[2 * CELL : 3 * CELL], out=c)
                    c += x[2 * CELL :, t : t + n]
                    np.exp(c, out=c)
                    c += 1
                    np.divide(2, c, out=c)
                    c -= 1
                    h -= c
                    h *= zr[:CELL]
                    h += c
                    np.matmul(weights, h, out=u)
                    look[t] += u[3 * CELL]
                    share[t] += u[3 * CELL + 1]
            seen = counted[part]
            if not seen.all():
                for t in range(steps):
                    look[t, ~seen[t : t + n]] = -1e9
            look -= look.max(axis=0)
            np.exp(look, out=look)
            result[first : first + n] = (look * share).sum(axis=0) / look.sum(axis=0) + p["bias"][0]
    return result


def gradients(p: dict, vectors: np.ndarray, ids: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple:
    """Gradients of the mean logistic loss by parameter, and that of the input vectors of the words."""
    result, (states, weight, pooled, traces) = logits(p, vectors, ids, real, keep=True)
    n, steps = ids.shape
    d_result = ((_sigmoid(result) - target) / n).astype(np.float32)
    g = {"out": pooled.T @ d_result, "bias": d_result.sum(keepdims=True)}
    d_pooled = np.outer(d_result, p["out"])
    d_weight = np.einsum("nc,tnc->tn", d_pooled, states)
    d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_states = weight[:, :, None] * d_pooled + d_look[:, :, None] * p["look"]
    g["look"] = np.einsum("tn,tnc->c", d_look, states)
    d_vectors = np.zeros_like(vectors)
    for k, (d, order) in enumerate((("f", range(steps - 1, -1, -1)), ("b", range(steps)))):
        w, trace = p["h" + d], traces[d]
        g["h" + d] = np.zeros_like(w)
        d_proj = np.zeros((len(vectors), 3 * CELL), np.float32)
        d_h = np.zeros((n, CELL), np.float32)
        for t in order:
            h, z, r, c, uc = trace[t]
            d_h = d_h + d_states[t, :, k * CELL : (k + 1) * CELL]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (h - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(d_proj, ids[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
            g["h" + d] += h.T @ d_u
            d_h = d_h * z + d_u @ w.T
        g["x" + d] = vectors.T @ d_proj
        g["c" + d] = d_proj.sum(axis=0)
        d_vectors += d_proj @ p["x" + d].T
    return g, d_vectors


class Adam:
    """Adam over dense parameters, and over the touched rows of the embeddings."""

    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.step = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def tick(self) -> None:
        self.step += 1

    def apply(self, name: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        m = self.m[name][rows] = 0.9 * self.m[name][rows] + 0.1 * g
        v = self.v[name][rows] = 0.99 * self.v[name][rows] + 0.01 * g * g
        scale = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        self.p[name][rows] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
