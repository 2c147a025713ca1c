import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.operators.select import best_rows, greedy, node_key, similarity_raises, term_weights
from themeloom.plans import catalogue


def naive(costs, covers, weights, budget, lam=0.5):
    def run(per_word):
        seen, value, left, took, out = [0] * len(weights), 0.0, budget, [], set()
        while True:
            best = None
            for i in range(len(costs)):
                if i in out or i in took:
                    continue
                if costs[i] > left:
                    continue
                g = (1 - lam) * sum(weights[v] * lam ** seen[v] for v in covers[i])
                if g > 0 and (best is None or (g / costs[i] if per_word else g) > best[0]):
                    best = ((g / costs[i] if per_word else g), i, g)
            if best is None:
                return value, took, left
            _, i, g = best
            took.append(i)
            value, left = value + g, left - costs[i]
            for v in covers[i]:
                seen[v] += 1

    a, b = run(True), run(False)
    _, took, left = b if b[0] > a[0] else a
    out = set(took)
    for i, c in enumerate(costs):
        if i not in out and c <= left:
            out.add(i)
            left -= c
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_lazy_equals_naive(data):
    n, m = data.draw(st.integers(1, 8)), data.draw(st.integers(1, 5))
    costs = data.draw(st.lists(st.integers(1, 9), min_size=n, max_size=n))
    covers = data.draw(st.lists(st.lists(st.integers(0, m - 1), unique=True), min_size=n, max_size=n))
    weights = data.draw(st.lists(st.sampled_from([0.125, 0.25, 0.5, 1.0]), min_size=m, max_size=m))
    budget = data.draw(st.integers(0, 30))
    assert greedy(costs, covers, weights, budget) == naive(costs, covers, weights, budget)


def test_words_stay_within_budget(spark, data):
    rows = catalogue.queries()["coverage_select"](spark, data).collect()
    assert rows and all(r.words_used <= r.budget for r in rows)


def plain_rows(costs, raises, weights, starts, budget, lam):
    """Always the unit of the largest gain, worked out anew from the objective's value before and after."""
    worth = lambda level: sum(w * (1 - lam**x) for w, x in zip(weights, level))

    def after(level, i):
        level = list(level)
        for v, by in raises[i]:
            level[v] += by
        return level

    def run(per_word):
        level, left, took = list(starts), budget, []
        while True:
            gains = [(round((worth(after(level, i)) - worth(level)) / (costs[i] if per_word else 1), 9), -i) for i in range(len(costs)) if i not in took and costs[i] <= left]
            gains = [g for g in gains if g[0] > 0]
            if not gains:
                return round(worth(level) - worth(starts), 9), took, left
            i = -max(gains)[1]
            took.append(i)
            level, left = after(level, i), left - costs[i]

    a, b = run(True), run(False)
    _, took, left = b if b[0] > a[0] else a
    out = set(took)
    for i, c in enumerate(costs):
        if i not in out and c <= left:
            out.add(i)
            left -= c
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_rows_with_levels_equal_a_plain_greedy(data):
    n, m = data.draw(st.integers(1, 7)), data.draw(st.integers(1, 4))
    costs = data.draw(st.lists(st.sampled_from([1, 2, 4, 8]), min_size=n, max_size=n))
    raises = data.draw(st.lists(st.dictionaries(st.integers(0, m - 1), st.sampled_from([1.0, 2.0]), max_size=m).map(lambda x: sorted(x.items())), min_size=n, max_size=n))
    weights = data.draw(st.lists(st.sampled_from([0.125, 0.5, 1.0]), min_size=m, max_size=m))
    starts = data.draw(st.lists(st.sampled_from([0.0, 1.0, 2.0]), min_size=m, max_size=m))
    budget = data.draw(st.integers(0, 25))
    assert best_rows(costs, raises, weights, starts, budget, 0.5).rows == plain_rows(costs, raises, weights, starts, budget, 0.5)


def test_query_masses():
    held = [{"river", "town"}, {"river"}, {"hall"}, set()]
    got = term_weights(held, {"river", "towns", "xyz"}, {"towns": "town"}, 2.0)
    s = {"river": math.log(5 / 3), "towns": math.log(5 / 2)}
    share = sum(s.values()) / (3 * math.log(5 / 2))
    assert {w: (round(x, 9), at) for w, (x, at) in got.items()} == {w: (round(2.0 * share * s[w] / sum(s.values()), 9), at) for w, at in (("river", [0, 1]), ("towns", [0]))}
    assert term_weights(held, set(), {}, 1.0) == {}
    near, costs = np.array([0.1, 0.5, 0.9, -1.0]), np.array([10.0, 10, 20, 10])
    above = np.array([0.0, 0.2, 0.6, 0]) / 0.6
    assert np.allclose(similarity_raises(near, costs, 25), above * costs / ((above * costs).sum() * 25 / 50))
    assert node_key(["b", "a"]) == node_key(["a", "b"])


def test_query_select_returns_what_it_showed(spark, data):
    rows = catalogue.queries()["query_select"](spark, data).collect()
    assert rows and all(r.words_used <= r.budget and r.n_gained <= r.n_selected for r in rows)
    assert any(r.n_terms_active for r in rows) and any(r.coverage > 1 for r in rows)
