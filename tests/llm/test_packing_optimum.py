import random
from collections import Counter
from functools import lru_cache

import pytest

from grainfold.llm import packing


def fewest(lengths, capacity):
    """The exact optimum, by subsets: (bins, largest fill of the last one)."""
    lengths = tuple(lengths)

    @lru_cache(None)
    def best(used):
        if not used:
            return 1, 0
        out = (len(lengths) + 1, 0)
        for i, w in enumerate(lengths):
            if used >> i & 1:
                bins, fill = best(used & ~(1 << i))
                out = min(out, (bins, fill + w) if fill + w <= capacity else (bins + 1, w))
        return out

    return best((1 << len(lengths)) - 1)[0] if lengths else 0


def instances(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        capacity = rnd.choice([7, 10, 16, 24])
        low = rnd.choice([1, capacity // 5, capacity // 3])
        yield capacity, [rnd.randint(max(1, low), capacity) for _ in range(rnd.randint(0, 10))]


def test_fixed_sets_leave_the_optimum_as_it_is():
    reduced = 0
    for capacity, lengths in instances(400, 1):
        count = [0] * (capacity + 1)
        for w in lengths:
            count[w] += 1
        fixed = packing.reduce_by_dominance(count, capacity)
        left = [w for w, n in enumerate(count) for _ in range(n)]
        used = Counter(left)
        for times, ws in fixed:
            assert times > 0 and sum(ws) <= capacity
            for w in ws:
                used[w] += times
        assert used == Counter(lengths)
        assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(lengths, capacity), (capacity, lengths)
        reduced += len(lengths) - len(left)
    assert reduced > 500


def test_packing_is_nearly_always_optimal():
    over = 0
    for capacity, lengths in instances(400, 2):
        bins, best = sum(t for t, _ in packing.pack(Counter(lengths), capacity)), fewest(lengths, capacity)
        assert best <= bins <= best + 1
        over += bins > best
    assert over <= 8


def test_lengths_are_checked():
    for wrong in ({0: 1}, {11: 2}):
        with pytest.raises(ValueError):
            packing.pack(wrong, 10)
    assert packing.pack({}, 10) == []
