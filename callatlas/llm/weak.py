"""Weak supervision: expectation-maximisation over the votes of overlapping labellers."""

from __future__ import annotations

import numpy as np

#: Votes: for, against, none.
VOTES = "+-."


def expectation_maximisation(patterns: dict[str, int], labellers: int, prior: float = 0.5, trust: float = 0.8, rounds: int = 100, least: tuple[float, float] = (0.0, 0.0), better: float = 0.0) -> tuple[np.ndarray, float, dict[str, float]]:
    """Reliabilities of labellers and posteriors of vote patterns, without true labels.

    patterns: votes, one character of VOTES a labeller, and how often they were cast together. Each class has its own
    chance that a labeller that votes is for it, given which the votes are independent; having no vote says nothing. To start
    with, a labeller is right with chance `trust`. Returns chances[class, labeller, vote] (class 1: for), the share of
    class 1, and each pattern's posterior of class 1. `least` bounds what a labeller's silence of its own kind can prove: the
    least chance of a vote for it in class 0, and of a vote for it in class 1. `better`, if above 0.5, holds every labeller to be
    better than chance: its votes are for in class 1, and against in class 0, with that chance at least, so that the classes
    can't change places. Patterns and their number are all that is needed of the rows, so counts of any size of corpus give the
    exact result.
    """
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    votes = np.array([[VOTES.index(c) for c in p] for p in names], int).reshape(len(names), labellers)
    onehot = np.eye(3)[votes]
    chances = np.empty((2, labellers, 3))
    chances[1] = (trust, 1 - trust, 1)
    chances[0] = (1 - trust, trust, 1)
    share, posterior = prior, np.full(len(names), prior)
    for _ in range(rounds if len(names) else 0):
        logs = [np.log(s) + np.einsum("plv,lv->p", onehot, np.log(c)) for s, c in ((1 - share, chances[0]), (share, chances[1]))]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for k, w in enumerate((n * (1 - posterior), n * posterior)):
            seen = np.einsum("p,plv->lv", w, onehot)[:, :2] + 0.1
            chances[k, :, :2] = seen / seen.sum(1, keepdims=True)
            chances[k, :, 0] = np.maximum(chances[k, :, 0], least[k])
            if better:
                chances[k, :, 0] = np.maximum(chances[k, :, 0], better) if k else np.minimum(chances[k, :, 0], 1 - better)
            chances[k, :, 1] = 1 - chances[k, :, 0]
        chances[:, :, :2] = np.clip(chances[:, :, :2], 1e-6, 1 - 1e-6)
        share = float(np.clip((n * posterior).sum() / n.sum(), 1e-6, 1 - 1e-6))
    return chances, share, dict(zip(names, posterior.tolist()))


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets (Adam, full batch)."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / max(weight.sum(), 1e-12)
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -50, 50))) - target) * weight
        g = np.append(error.astype(x.dtype) @ x + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)
