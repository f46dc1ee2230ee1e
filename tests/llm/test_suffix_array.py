import random

import numpy as np
import pytest

from grainfold.llm.suffix_array import induce_ranks, permuted_common_prefixes, suffix_array


def brute(s):
    return sorted(range(len(s)), key=lambda i: list(s[i:]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 200])
@pytest.mark.parametrize("offset", [0, 1000])
def test_suffix_array_equals_sorting(letters, offset):
    rnd = random.Random(letters)
    for n in [1, 2, 3, 5, 17, 60, 150, 400]:
        for _ in range(6):
            s = [rnd.randint(1, letters) + offset for _ in range(n)]
            if rnd.random() < 0.5 and n > 8:
                s[n // 2 :] = s[: n - n // 2]
            s = np.array([*s, 0])
            assert suffix_array(s).tolist() == brute(s.tolist())


def test_common_prefixes():
    rnd = random.Random(1)
    for _ in range(30):
        t = np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 150))] * 2 + [0], np.uint8)
        sa = suffix_array(t.astype(np.int64))
        got = permuted_common_prefixes(t, sa)
        for x, y in zip(sa[1:], sa[:-1]):
            k = 0
            while max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert got[x] == k
        assert got[sa[0]] == 0
