"""The set-similarity kernel against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.functions.setjoin import similar_sets


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1, max_size=10), max_size=25), st.sampled_from([0.3, 0.5, 0.6, 0.8, 1.0]))
def test_kernel_equals_brute_force(sets, t):
    sets = list(dict.fromkeys(sets))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= t - 1e-9}
    got = [tuple(sorted(p, reverse=True)) for p in similar_sets(sets, t)]
    assert len(got) == len(set(got)) and set(got) == want


def test_kernel_on_alike_sets():
    rng = random.Random(7)
    base = [frozenset(rng.sample(range(400), 30)) for _ in range(12)]
    sets = list(dict.fromkeys(frozenset([*rng.sample(sorted(b), len(b) - rng.randint(0, 5)), *rng.sample(range(400), rng.randint(0, 5))]) for b in base for _ in range(20)))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.6}
    assert {tuple(sorted(p, reverse=True)) for p in similar_sets(sets, 0.6)} == want
