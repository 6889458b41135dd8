"""The label model finds what it is told nothing about."""

import tracemalloc

import numpy as np
import pytest

from verdigris.llm import toxicity


def voters(rng, truth, rates):
    return np.stack([rng.random(len(truth)) < np.where(truth, one, none) for one, none in rates], axis=1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_firing_rates_are_recovered_without_labels(seed):
    rng = np.random.default_rng(seed)
    truth = rng.random(6000) < 0.3
    rates = [(0.7, 0.05), (0.6, 0.1), (0.8, 0.15), (0.5, 0.02), (0.65, 0.08)]
    votes = voters(rng, truth, rates)
    model = toxicity.label_model(votes)
    assert abs(1 - model.rates[-1] - 0.3) < 0.06
    assert np.abs(model.toxic[:5] - [a for a, _ in rates]).max() < 0.1
    assert np.abs(model.clean[:5] - [b for _, b in rates]).max() < 0.06
    assert ((model.posteriors(votes) > 0.5) == truth).mean() > 0.93
    assert np.abs(model.correlation).max() < 0.3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_of_a_junk_voter_are_one_voter(seed):
    rng = np.random.default_rng(seed)
    truth = rng.random(4000) < 0.4
    useful = voters(rng, truth, [(0.75, 0.1)] * 5)
    junk = np.repeat(rng.random((4000, 1)) < 0.5, 5, axis=1)
    votes = np.hstack([junk, useful])
    model = toxicity.label_model(votes)
    assert ((model.posteriors(votes) > 0.5) == truth).mean() > 0.9
    assert model.share[:5].max() < 0.25
    assert abs(np.corrcoef(model.posteriors(votes), junk[:, 0])[0, 1]) < 0.15


def test_kinds_that_exclude_each_other_are_all_toxic():
    rng = np.random.default_rng(4)
    votes = np.zeros((3000, 12))
    votes[:100, :3], votes[100:200, 3:8], votes[200:260, 8:10] = 1, 1, 1
    votes[:260] *= rng.random((260, 12)) < 0.9
    votes[260:] = rng.random((2740, 12)) < 0.001
    found = toxicity.label_model(votes).posteriors(votes) > 0.5
    assert found[:260].mean() > 0.93 and found[260:].mean() < 0.01


def test_the_driver_holds_the_votes_once():
    """Votes are centred a portion of texts at a time, with the correlations of all of them."""
    rng = np.random.default_rng(4)
    votes = rng.random((20000, 100)) < rng.random(100)
    part, fires = rng.dirichlet(np.ones(3), len(votes)), rng.random((100, 3))
    whole = np.corrcoef(votes.astype(float), rowvar=False) - np.eye(100)
    found = toxicity._correlations(votes.astype(float), np.ones((len(votes), 1)), votes.mean(axis=0)[:, None])
    assert np.abs(found - whole).max() < 1e-9
    centred = votes - part @ fires.T
    cov = centred.T @ centred
    found = toxicity._correlations(votes.astype(float), part, fires)
    assert np.abs(found - (cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))) - np.eye(100))).max() < 1e-9
    tracemalloc.start()
    toxicity.label_model(votes, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * votes.size
