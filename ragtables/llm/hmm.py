"""Arithmetic of a hidden Markov model over many sequences at once: scaled forward and backward recursions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """start (K), moves (K, K), emissions (symbols, K): probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray


@dataclass
class Counts:
    """Expected counts in the shape of a model."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray


def _active(lengths: np.ndarray) -> np.ndarray:
    """For lengths in descending order: the number of sequences that have a place t, for every t."""
    longest = int(lengths[0]) if len(lengths) else 0
    return len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]


def log_likelihood(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of the probability of every sequence (1 symbol or more each), by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begin, active = starts[order], _active(lengths[order])
    emissions, moves = model.emissions, model.moves
    total = np.zeros(len(order))
    alpha = np.tile(model.start, (len(order), 1))
    for t, n in enumerate(active.tolist()):
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ moves) * emissions[symbols[begin[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[Counts, float]:
    """Baum-Welch counts of all sequences (1 symbol or more each) and the sum of their log likelihoods."""
    states = len(model.start)
    moves = model.moves.astype(np.float32)
    emissions = model.emissions.astype(np.float32)
    counts = Counts(np.zeros(states), np.zeros((states, states)), np.zeros(emissions.shape))
    order = np.argsort(-lengths, kind="stable")
    begin, active = starts[order], _active(lengths[order]).tolist()
    if not active:
        return counts, 0.0
    at = np.concatenate(([0], np.cumsum(active)))
    placed = np.empty(at[-1], np.int32)
    alphas = np.empty((at[-1], states), np.float32)
    scales = np.empty(at[-1], np.float32)
    alpha = np.tile(model.start.astype(np.float32), (len(order), 1))
    for t, n in enumerate(active):
        here = slice(at[t], at[t] + n)
        placed[here] = symbols[begin[:n] + t]
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ moves) * emissions[placed[here]]
        scales[here] = scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        alphas[here] = alpha
    beta = np.empty((0, states), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        here = slice(at[t], at[t] + n)
        beta = np.concatenate((beta, np.ones((n - len(beta), states), np.float32)))
        if t:
            ahead = emissions[placed[here]] * beta / scales[here][:, None]
            counts.moves += alphas[at[t - 1] : at[t - 1] + n].T @ ahead
            alphas[here] *= beta
            beta = ahead @ moves.T
        else:
            alphas[here] *= beta
    counts.moves *= model.moves
    counts.start += alphas[: active[0]].sum(axis=0, dtype=np.float64)
    for k in range(states):
        counts.emissions[:, k] = np.bincount(placed, weights=alphas[:, k], minlength=len(emissions))
    return counts, float(np.log(scales, dtype=np.float64).sum())


def estimate(counts: Counts, prior: np.ndarray, strength: float = 20.0) -> Model:
    """Model of the counts; emissions are drawn to ``prior`` (a distribution over symbols), the rest to the uniform."""
    start, moves = counts.start + 1.0, counts.moves + 1.0
    emissions = counts.emissions + strength * prior[:, None]
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def first_model(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prior: np.ndarray, states: int,
                rounds: int, seed: int = 7) -> Model:
    """Starting point from whole sequences: random states per sequence, then ``rounds`` of Baum-Welch."""
    rng = np.random.default_rng(seed)
    counts = Counts(np.ones(states), np.full((states, states), 1.0) + 50.0 * np.eye(states), np.zeros((len(prior), states)))
    for begin, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        np.add.at(counts.emissions[:, rng.integers(states)], symbols[begin : begin + n], 1.0)
    model = estimate(counts, prior)
    for _ in range(rounds):
        model = estimate(expected_counts(model, symbols, starts, lengths)[0], prior)
    return model
