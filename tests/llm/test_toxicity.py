"""The label model against votes drawn from known accuracies and a known correlation."""

import numpy as np

from tenderline.llm.toxicity import LabelModel, logistic


def drawn(n=60_000, prior=0.3, seed=3):
    """Votes -1 or 1 of eight voters right with these chances, whatever the class; the last repeats the first in four of five cases."""
    rng = np.random.default_rng(seed)
    chance = np.array([0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.9])
    y = np.where(rng.random(n) < prior, 1, -1)
    votes = np.where(rng.random((n, 8)) < chance, y[:, None], -y[:, None])
    votes[:, 7] = np.where(rng.random(n) < 0.8, votes[:, 0], votes[:, 7])
    return y, votes, chance, prior


def test_accuracies_and_correlation_of_drawn_votes():
    y, votes, chance, prior = drawn()
    model = LabelModel(votes.mean(0), np.cov(votes.T, bias=True), prior)
    assert np.abs(model.accuracy - (2 * chance - 1)).max() < 0.06
    own = np.abs(model.correlation - np.diag(np.diag(model.correlation)))
    assert set(np.unravel_index(own.argmax(), own.shape)) == {0, 7} and own[0, 7] > 3 * np.delete(np.delete(own, 7, 0), 7, 1).max()


def test_posteriors_beat_the_best_voter_and_rise_with_the_share():
    y, votes, _, prior = drawn()
    p = LabelModel(votes.mean(0), np.cov(votes.T, bias=True), prior).posterior(votes.astype(float))
    right = ((p >= 0.5) == (y > 0)).mean()  # a linear posterior: about as good as the majority, which has a voter twice here
    assert right > 0.94 > ((votes == y[:, None]).mean(0)).max()
    # a linear posterior is too sure near the middle (the score's scale is fitted to labels later): shares rise with it, and hold at both ends
    shares = [(p[m].mean(), (y[m] > 0).mean()) for m in ((p >= low) & (p < low + 0.25) for low in np.arange(0, 1, 0.25))]
    assert all(a[1] < b[1] for a, b in zip(shares, shares[1:]))
    assert all(abs(shares[i][0] - shares[i][1]) < 0.08 for i in (0, -1))


def test_logistic_finds_known_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 3))
    w = np.array([1.5, -2.0, 0.5, -0.3])
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs(logistic(x, p, ridge=1e-6) - w).max() < 1e-3
