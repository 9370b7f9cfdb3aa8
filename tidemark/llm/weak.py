"""Weak supervision: how far to trust labellers that overlap and disagree, without labelled rows.

Votes are 1 (yes), 0 (no) or -1 (abstains, which says nothing). A model of independent labellers (Dawid and Skene's) is
fitted by expectation-maximisation over vote patterns and their counts: one class of yes, and one of no or several,
where texts fail in several ways of which each labeller sees but some. Nothing is held by hand: all chances are
estimated. Patterns are as few as labellers allow, whatever the number of rows, so the counts are all that the driver
needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOTES = (1, 0)


@dataclass(frozen=True)
class VoteModel:
    """priors of the classes, that of yes last, and by labeller and class the chance of each of VOTES, if it votes."""

    priors: np.ndarray
    chances: np.ndarray  # labellers x classes x 2 votes

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each class for each row of votes."""
        at = np.where(votes == 1, 0, np.where(votes == 0, 1, 2))
        logs = np.pad(np.log(self.chances), ((0, 0), (0, 0), (0, 1)))  # an abstention weighs nothing
        scores = np.log(self.priors)[None, :] + sum((logs[j][:, at[:, j]].T for j in range(at.shape[1])), np.zeros((len(at), len(self.priors))))
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of yes for each row of votes."""
        return self.classes(votes)[:, -1]

    def reliability(self) -> list[float]:
        """By labeller, the mean over yes and no of how often a vote that is no abstention is right."""
        no = self.priors[:-1] / self.priors[:-1].sum()
        return [float((no @ chances[:-1, 1] + chances[-1, 0]) / 2) for chances in self.chances]


def fit(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 500, smoothing: float = 1.0, kinds: tuple[tuple[int, ...], ...] = ((),)
) -> VoteModel:
    """EM from the share of yes votes. Labellers are taken to be better than chance at the start, which tells the classes
    apart. kinds: for each class of no the labellers whose no speaks for it at the start; one class needs none. No
    patterns at all give a model that knows nothing.
    """
    n_labellers, n_classes = votes.shape[1], len(kinds) + 1
    if not len(votes):
        return VoteModel(np.full(n_classes, 1 / n_classes), np.full((n_labellers, n_classes, 2), 1 / 2))
    cast = (votes >= 0).sum(axis=1)
    yes = np.where(cast > 0, (votes == 1).sum(axis=1) / np.maximum(cast, 1), 0.5) * 0.9 + 0.05
    spoken = np.stack([(votes[:, list(k)] == 0).sum(axis=1) + 0.1 for k in kinds], axis=1)
    belief = np.concatenate([(1 - yes)[:, None] * spoken / spoken.sum(axis=1, keepdims=True), yes[:, None]], axis=1)
    counts = counts.astype(float)
    model = None
    for _ in range(rounds):
        weight = counts[:, None] * belief
        chances = np.stack([(votes == v).T @ weight + smoothing for v in VOTES], axis=2)
        chances /= chances.sum(axis=2, keepdims=True)
        priors = np.maximum(weight.sum(axis=0) / counts.sum(), 1e-4)
        model = VoteModel(priors / priors.sum(), chances)
        now = model.classes(votes)
        if np.abs(now - belief).max() < 1e-7:
            break
        belief = now
    return model
