import random

import numpy as np

from driftlab.llm.grouping import suffix_order


def brute(t, problem):
    n = len(t)
    ends = [next(k for k in range(i, n) if t[k] == 0) for i in range(n)]
    return sorted(range(n), key=lambda i: (problem[i], list(t[i : ends[i]]) + [0], ends[i]))


def test_random_problems_match_sorting():
    r = random.Random(1)
    for trial in range(150):
        t, problem = [], []
        letters = r.choice((1, 2, 3, 20))
        for p in range(r.randint(1, 6)):
            for _ in range(r.randint(1, 4)):
                kind = r.random()
                if kind < 0.3:
                    unit = [r.randint(1, letters) for _ in range(r.randint(1, 4))]
                    s = (unit * 20)[: r.randint(0, 40)]
                else:
                    s = [r.randint(1, letters) for _ in range(r.randint(0, 40))]
                t += [*s, 0]
                problem += [p] * (len(s) + 1)
        t, problem = np.array(t), np.array(problem)
        assert suffix_order(t, problem).tolist() == brute(t, problem), trial


def test_fibonacci_and_long_runs():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    for s in (b, [1] * 500, [3, 2, 1] * 100, list(range(1, 200)), list(range(200, 0, -1))):
        t = np.array([*s, 0])
        assert suffix_order(t, np.zeros(len(t), int)).tolist() == brute(t, [0] * len(t))


def test_large_numbers():
    r = random.Random(2)
    for top in (1 << 32, 1 << 61):
        t = [x for _ in range(40) for x in [*(r.choice((1, 256, top - 1, top)) for _ in range(r.randint(0, 6))), 0]]
        problem = np.cumsum(np.append(0, np.array(t[:-1]) == 0)) // 4
        assert suffix_order(np.array(t), problem).tolist() == brute(t, problem.tolist())


def test_nothing():
    assert len(suffix_order(np.zeros(0, int), np.zeros(0, int))) == 0
