"""Linear-chain conditional random field with two labels over sparse binary features."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """Weights: one per feature and label, one per pair of neighbouring labels, for each kind of step."""

    index: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))

    def to_json(self) -> str:
        return json.dumps([list(self.index), self.unary.tolist(), self.steps.tolist()])

    @classmethod
    def from_json(cls, text: str) -> Chain:
        names, unary, steps = json.loads(text)
        return cls({n: i for i, n in enumerate(names)}, np.array(unary).reshape(-1, 2), np.array(steps))

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), 2))
        for i, names in enumerate(features):
            known = [self.index[n] for n in names if n in self.index]
            if known:
                out[i] = self.unary[known].sum(axis=0)
        return out

    def decode(self, features: list[list[str]], kinds: list[int]) -> list[int]:
        """Most probable labels (Viterbi); ``kinds`` has the kind of the step into each place."""
        if not features:
            return []
        scores = self.scores(features).tolist()
        steps = self.steps.tolist()
        a, b = scores[0]
        back = []
        for (own_a, own_b), kind in zip(scores[1:], kinds[1:], strict=True):
            (aa, ab), (ba, bb) = steps[kind]
            to_a, to_b = (a + aa, b + ba), (a + ab, b + bb)
            back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
            a, b = max(to_a) + own_a, max(to_b) + own_b
        label = int(b > a)
        labels = [label]
        for pointers in reversed(back):
            label = pointers[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-5) -> Chain:
    """Chain of highest penalised likelihood for pages of (features, kinds of steps, labels), by Adam on the exact gradient.

    Chains are padded to one length and go through the forward and backward recursions together.
    """
    pages = [p for p in pages if p[2]]
    chain = Chain({n: i for i, n in enumerate(sorted({n for f, _, _ in pages for names in f for n in names}))})
    chain.unary = np.zeros((len(chain.index), 2))
    if not pages:
        return chain
    longest = max(len(p[2]) for p in pages)
    size = len(pages)
    used = np.zeros((size, longest), bool)
    labels = np.zeros((size, longest), np.int64)
    kinds = np.zeros((size, longest), np.int64)
    at, feature = [], []
    for i, (features, k, y) in enumerate(pages):
        used[i, : len(y)], labels[i, : len(y)], kinds[i, : len(y)] = True, y, k
        for t, names in enumerate(features):
            at += [i * longest + t] * len(names)
            feature += [chain.index[n] for n in names]
    at, feature = np.array(at, np.int64), np.array(feature, np.int64)
    gold = np.eye(2)[labels] * used[..., None]
    pairs = used[:, 1:]
    gold_steps = np.zeros((2, 2, 2))
    np.add.at(gold_steps, (kinds[:, 1:][pairs], labels[:, :-1][pairs], labels[:, 1:][pairs]), 1.0)
    weights = np.zeros(chain.unary.size + 8)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for number in range(1, rounds + 1):
        unary, steps = weights[:-8].reshape(-1, 2), weights[-8:].reshape(2, 2, 2)
        scores = np.stack([np.bincount(at, unary[feature, y], size * longest) for y in (0, 1)], axis=1).reshape(size, longest, 2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            forward[:, t] = scores[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + steps[kinds[:, t]], axis=1)
        for t in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(steps[kinds[:, t + 1]] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(used[:, t + 1, None], ahead, 0.0)
        last = used.sum(axis=1) - 1
        total = np.logaddexp.reduce(forward[np.arange(size), last], axis=1)
        marginal = np.exp(forward + backward - total[:, None, None]) * used[..., None]
        joint = np.exp(forward[:, :-1, :, None] + steps[kinds[:, 1:]] + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
                       - total[:, None, None, None]) * pairs[..., None, None]
        expected_steps = np.stack([joint[kinds[:, 1:] == k].sum(axis=0) for k in (0, 1)])
        error = (gold - marginal).reshape(-1, 2)
        gradient = np.concatenate((np.stack([np.bincount(feature, error[at, y], len(chain.index)) for y in (0, 1)], axis=1).reshape(-1),
                                   (gold_steps - expected_steps).reshape(-1))) / size - decay * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights + rate * (first / (1 - 0.9**number)) / (np.sqrt(second / (1 - 0.999**number)) + 1e-8)
    chain.unary, chain.steps = weights[:-8].reshape(-1, 2), weights[-8:].reshape(2, 2, 2)
    return chain
