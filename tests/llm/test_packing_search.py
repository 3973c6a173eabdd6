import random
from collections import Counter

import pytest

from tarnwork.llm.packing import best_fit, lower_bound, search, solve


def least(sizes, capacity):
    """Fewest containers, over all subsets."""
    dp = [(0, capacity)] + [(len(sizes) + 1, 0)] * (2 ** len(sizes) - 1)
    for m in range(1, len(dp)):
        for i, s in enumerate(sizes):
            if m >> i & 1:
                k, used = dp[m ^ 1 << i]
                dp[m] = min(dp[m], (k, used + s) if used + s <= capacity else (k + 1, s))
    return dp[-1][0]


def bins(patterns):
    return sum(p.times for p in patterns)


@pytest.mark.parametrize(
    "capacity, sizes, want",
    [
        (50, [39, 36, 30, 22, 19, 18, 10, 9, 6, 5, 5, 1], 4),
        (100, [57, 46, 39, 37, 32, 25, 22, 19, 9, 9, 3, 2], 3),
        (100, [74, 71, 52, 52, 44, 38, 31, 30, 26, 19, 17, 17, 12, 10, 7], 5),
    ],
)
def test_search_goes_back_over_fillings(capacity, sizes, want):
    hist = dict(Counter(sizes))
    assert bins(best_fit(hist, capacity)) > want == bins(solve(hist, capacity))


def test_search_is_optimal_on_small_tables():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([20, 50, 100])
        sizes = [rng.randint(1, capacity * rng.choice([3, 5, 10]) // 10) for _ in range(rng.randint(3, 10))]
        hist, want = dict(Counter(sizes)), least(sizes, capacity)
        got, proven = search(hist, capacity, best_fit(hist, capacity))
        assert lower_bound(hist, capacity) <= want == bins(got) == bins(solve(hist, capacity)) and proven
