"""Operator 6's islands search where best fit alone does not reach the bound, with the parameters that the query uses."""

import random

from sonoglyph.llm import packing as P


def test_default_parameters_improve_on_best_fit():
    capacity, rng, length = 1000, random.Random(1), []
    for _ in range(20):  # three pieces of each bin fill it
        a = rng.randint(251, 380)
        b = rng.randint(251, (capacity - a) // 2)
        length += [a, b, capacity - a - b]
    first = P.best_fit(sorted(range(60), key=lambda p: -length[p]), length, [], capacity)
    found = P.evolve(length, [], capacity, 1, P.POPULATION, P.OFFSPRING)
    assert len(found) < len(first)
    assert sorted(p for _, ps in found for p in ps) == list(range(60))
    assert all(free == capacity - sum(length[p] for p in ps) >= 0 for free, ps in found)
