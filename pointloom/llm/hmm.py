"""Hidden Markov chains over word classes in numpy: scaled forward recursion and Baum-Welch counts for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Chain:
    """start[s], move[s, s'] and emit[class, s] probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @cached_property
    def by_state(self) -> np.ndarray:
        """Emissions in single precision, one row a state."""
        return np.ascontiguousarray(self.emit.T, np.float32)


def by_time(seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observations ordered by step, then by text, longest first; the number of texts at each step; where each step begins; the order of texts."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
    begin = np.concatenate([[0], np.cumsum(active)])
    starts = np.cumsum(lengths) - lengths
    step = np.arange(len(seq)) - np.repeat(starts, lengths)
    obs = np.empty(len(seq), dtype=np.int32)
    obs[begin[step] + np.repeat(rank, lengths)] = seq
    return obs, active, begin, order


def log10_likelihood(chain: Chain, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact log10 probability of each text's class sequence; seq holds the texts one after the other."""
    total = np.zeros(len(lengths))
    obs, active, begin, order = by_time(seq, lengths)
    a = None
    for t, n in enumerate(active.tolist()):
        e = chain.emit[obs[begin[t] : begin[t] + n]]
        a = e * chain.start if a is None else (a[:n] @ chain.move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(lengths))
    out[order] = total
    return out


@dataclass
class Counts:
    """Expected starts, moves and emissions, and the log10 likelihood of the texts; add() is the E-step over a block of texts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log10: float = 0.0

    @classmethod
    def zero(cls, states: int, classes: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)).T)

    def add(self, chain: Chain, seq: np.ndarray, lengths: np.ndarray) -> None:
        if len(seq):
            obs, active, *_ = by_time(seq, lengths)
            self.add_steps(chain, obs, active)

    def add_steps(self, chain: Chain, obs: np.ndarray, active: np.ndarray) -> None:
        """As add(), of texts that by_time() has put in order of steps."""
        obs, begin = obs.astype(np.intp), np.concatenate([[0], np.cumsum(active)])
        # one row a state, so that sums over states and products by them run along contiguous texts
        move, start = np.ascontiguousarray(chain.move.T, np.float32), chain.start.astype(np.float32)[:, None]
        back = np.ascontiguousarray(chain.move, np.float32)
        e = np.empty((len(start), len(obs)), dtype=np.float32)
        for row, of_class in zip(e, chain.by_state, strict=True):
            of_class.take(obs, out=row, mode="clip")
        alpha = np.empty_like(e)
        scale = np.empty(len(obs), dtype=np.float32)
        steps, begins = active.tolist(), begin.tolist()
        last = None
        for n, at in zip(steps, begins, strict=False):
            a, c, now = alpha[:, at : at + n], scale[at : at + n], e[:, at : at + n]
            if last is None:
                np.multiply(now, start, out=a)
            else:
                np.matmul(move, last[:, :n], out=a)
                np.multiply(a, now, out=a)
            np.add.reduce(a, axis=0, out=c)
            np.divide(a, c, out=a)
            last = a
        self.log10 += float(np.log10(scale).sum(dtype=np.float64))
        # e becomes emission times backward value over scale, alpha the probability of each state
        e /= scale
        moves, held = np.zeros(self.move.shape), np.empty((len(start), steps[0]), dtype=np.float32)
        w = e[:, begins[len(steps) - 1] : begins[len(steps)]]
        for t in range(len(steps) - 1, 0, -1):
            n, at = steps[t], begins[t - 1]
            a, b = alpha[:, at : at + n], held[:, :n]
            moves += a @ w.T
            np.matmul(back, w, out=b)
            np.multiply(a, b, out=a)
            w = e[:, at : at + steps[t - 1]]
            w[:, :n] *= b
        self.start += alpha[:, : steps[0]].sum(axis=1)
        self.move += moves * chain.move
        for s, row in enumerate(alpha):
            self.emit[:, s] += np.bincount(obs, row, len(self.emit))

    def chain(self, share: np.ndarray, weight: float = 20.0) -> Chain:
        """M-step. share: overall probability of each class, towards which each state's emissions are drawn by ``weight`` counts."""
        emit = self.emit + weight * share[:, None]
        move = self.move + 0.1
        start = self.start + 0.1
        return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_chain(share: np.ndarray, states: int, seed: int = 5) -> Chain:
    """A start that breaks the symmetry of the states: emissions disturbed at random, states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
