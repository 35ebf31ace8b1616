"""A small linear-chain conditional random field in numpy: training and Viterbi decoding."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

FEATURES = 2**13
EPOCHS = 150
RATE = 0.1
PENALTY = 1e-3


@dataclass(frozen=True)
class Crf:
    labels: tuple[str, ...]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x next label
    first: np.ndarray  # label


def feature_number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _padded(chains: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers as chain x step x slot; the slot FEATURES weighs nothing."""
    steps = max(len(c) for c in chains)
    slots = max(len(t) for c in chains for t in c)
    out = np.full((len(chains), steps, slots), FEATURES, np.int32)
    for i, chain in enumerate(chains):
        for j, numbers in enumerate(chain):
            out[i, j, : len(numbers)] = numbers
    return out, np.array([len(c) for c in chains])


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis=axis, keepdims=True))).squeeze(axis)


def trained(chains: list[list[list[int]]], tags: list[list[str]]) -> Crf:
    """Weights of largest penalised likelihood, by a fixed number of gradient steps."""
    labels = ("O", *sorted({t for chain in tags for t in chain} - {"O"}))
    place = {label: i for i, label in enumerate(labels)}
    x, lengths = _padded(chains)
    n, steps, _ = x.shape
    k = len(labels)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    y = np.zeros((n, steps), np.int64)
    for i, chain in enumerate(tags):
        y[i, : len(chain)] = [place[t] for t in chain]
    gold = np.eye(k)[y] * inside[:, :, None]
    gold_moves = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
    theta = [np.zeros((FEATURES + 1, k)), np.zeros((k, k)), np.zeros(k)]
    squares = [np.zeros_like(t) for t in theta]
    # Features of real words only, and the words of each feature side by side.
    known = x[inside]
    order = np.argsort(known, axis=None, kind="stable")
    owners = order // known.shape[1]
    present, begins = np.unique(known.ravel()[order], return_index=True)
    for _ in range(EPOCHS):
        weights, moves, first = theta
        score = np.zeros((n, steps, k))
        score[inside] = weights[known].sum(axis=1)
        forward, backward = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        forward[:, 0] = score[:, 0] + first
        for t in range(1, steps):
            value = _sum_exp(forward[:, t - 1, :, None] + moves[None], 1) + score[:, t]
            forward[:, t] = np.where(inside[:, t, None], value, forward[:, t - 1])
        for t in range(steps - 2, -1, -1):
            value = _sum_exp(moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], value, 0.0)
        norm = _sum_exp(forward[:, -1], 1)
        chance = np.exp(forward + backward - norm[:, None, None]) * inside[:, :, None]
        pair = np.exp(
            forward[:, :-1, :, None] + moves[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        ) * inside[:, 1:, None, None]
        off = gold - chance
        up = np.zeros_like(weights)
        up[present] = np.add.reduceat(off[inside][owners], begins, axis=0)
        up[FEATURES] = 0.0
        slopes = [up, gold_moves - pair.sum(axis=(0, 1)), off[:, 0].sum(axis=0)]
        for value, slope, square in zip(theta, slopes, squares):
            slope -= PENALTY * n * value
            square += slope * slope
            value += RATE * slope / np.sqrt(square + 1e-8)
    return Crf(labels, *theta)


def decoded(chains: list[list[list[int]]], model: Crf) -> list[list[str]]:
    """Most probable labels of each chain (Viterbi), in batches of chains of like length."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    out: list[list[str]] = [[] for _ in chains]
    at = 0
    while at < len(order):
        stop = at + 1  # the longest chain of a batch is its last
        while stop < len(order) and (stop + 1 - at) * len(chains[order[stop]]) <= 40_000:
            stop += 1
        some = order[at:stop]
        at = stop
        x, lengths = _padded([chains[i] for i in some])
        score = model.weights[x[:, :, 0]]
        for slot in range(1, x.shape[2]):
            score += model.weights[x[:, :, slot]]
        best = score[:, 0] + model.first
        back = np.zeros(score.shape, np.int16)
        for t in range(1, score.shape[1]):
            reached = best[:, :, None] + model.moves[None]
            back[:, t] = reached.argmax(axis=1)
            on = (t < lengths)[:, None]
            best = np.where(on, reached.max(axis=1) + score[:, t], best)
        now = best.argmax(axis=1)
        path = np.zeros(score.shape[:2], np.int64)
        for t in range(score.shape[1] - 1, -1, -1):
            path[:, t] = now
            now = np.where((t < lengths) & (t > 0), back[np.arange(len(some)), t, now], now)
        for row, i in enumerate(some):
            out[i] = [model.labels[k] for k in path[row, : lengths[row]]]
    return out
