"""The search of best-fit packing on lengths for which best fit isn't good enough."""

import numpy as np
import pytest

from gaugelab.llm import packing


def hard(n=3000, seed=3):
    return np.sort(np.random.default_rng(seed).integers(820, 2100, n))[::-1].copy()


def whole(x, lengths, capacity=4096):
    return (x >= 0).all() and np.bincount(x, weights=lengths).max() <= capacity and len(np.unique(x)) == x.max() + 1


def test_search_beats_best_fit_decreasing():
    lengths = hard()
    plain, floor = packing.best_fit(lengths, 4096).max() + 1, packing.least_bins(lengths, 4096)
    rng = np.random.default_rng(1)
    pop = packing.first_population(lengths, 4096, packing.POPULATION, rng)
    out = packing.evolve(pop, lengths, 4096, 24, rng)
    assert all(whole(x, lengths) for x in out)
    fills = [packing.fitness(x, lengths, 4096) for x in out]
    assert fills == sorted(set(fills), reverse=True)  # best first, no two alike
    assert out[0].max() + 1 <= plain - 25 and out[0].max() + 1 <= 1.04 * floor


@pytest.mark.parametrize("seed", range(4))
def test_children_and_mutants_are_whole(seed):
    rng = np.random.default_rng(seed)
    for lengths in (hard(200, seed), np.sort(rng.integers(1, 4096, 150))[::-1].copy(), np.full(30, 2048), np.array([5]), np.array([4095, 1])):
        a, b = packing.first_population(lengths, 4096, 2, rng)
        for _ in range(5):
            a = packing.cross(a, b, lengths, 4096, rng)
            b = packing.mutate(b, lengths, 4096, rng)
            assert whole(a, lengths) and whole(b, lengths)


def test_packing_of_hard_lengths(spark):
    lengths = hard()
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(df).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(i, int(n)) for i, n in enumerate(lengths)]
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096
    assert len(fill) < packing.best_fit(lengths, 4096).max() + 1 - 20


def fewest(lengths, capacity):
    """By trying every bin for each length, the largest first; equal loads once."""
    best = len(lengths)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for load in set(loads):
            if load + lengths[k] <= capacity:
                i = loads.index(load)
                place(k + 1, [*loads[:i], load + lengths[k], *loads[i + 1 :]])
        place(k + 1, [*loads, lengths[k]])

    place(0, [])
    return best


def test_tiny_cases_against_exhaustive_search():
    """The search needs no more bins than the best of all packings, and sometimes fewer than best fit."""
    gained = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        capacity = int(rng.integers(20, 60))
        lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 11))) if seed % 2 else rng.integers(capacity // 5, capacity // 2 + 1, int(rng.integers(6, 13))))[::-1].copy()
        pop = packing.evolve(packing.first_population(lengths, capacity, packing.POPULATION, rng), lengths, capacity, 60, rng)
        got, want = pop[0].max() + 1, fewest(lengths.tolist(), capacity)
        assert whole(pop[0], lengths, capacity) and got == want, (seed, lengths, capacity)
        gained += packing.best_fit(lengths, capacity).max() + 1 > got
    assert gained > 0
