from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blurframe.hierarchy import Hierarchy
from blurframe.operators.items import HierarchyCut, SetMerge, exact_ul, ul_readable
from blurframe.operators.merge import btd_groups, btd_value, class_ul, dense_ranks
from blurframe.schema import Params

H = Hierarchy.from_lines(["*:A,B", "A:a1,a2", "B:b1,b2"])


def baskets(*rows):
    return sorted(Counter(tuple(sorted(H.ids[x] for x in r)) for r in rows).items())


def after(goes, *rows):
    return [{H.labels[goes[H.ids[x]]] for x in r} for r in rows]


def test_cut_lifts_rare_items():
    rows = [["a1"], ["a2"], ["b1"], ["b1"]]
    goes = HierarchyCut(H, 2, 1)(baskets(*rows))
    assert after(goes, *rows) == [{"A"}, {"A"}, {"b1"}, {"b1"}]
    assert class_ul(baskets(*rows), H, Params(k=2, m=1)) == 6
    assert float(ul_readable(6, 4, 4)) == 0.1


def test_shrinking_sets_go_to_the_root_in_reference_mode():
    rows = [["a1", "a2"], ["a1"], ["a2"], ["b1"], ["b1"]]
    assert after(HierarchyCut(H, 2, 2)(baskets(*rows)), *rows) == [{"*"}] * 5
    assert class_ul(baskets(*rows), H, Params(k=2, m=2)) == 75
    assert after(HierarchyCut(H, 2, 2, "strict")(baskets(*rows)), *rows) == [{"A"}] * 3 + [{"b1"}] * 2
    assert class_ul(baskets(*rows), H, Params(k=2, m=2, mode="strict")) == 9


def test_sets_merge_with_the_cheapest_partner():
    rows = [((1,), 1), ((2,), 1), ((3,), 2)]
    assert SetMerge(2, 1)(rows) == {1: (1, 2), 2: (1, 2), 3: (3,)}
    assert class_ul(rows, H, Params(k=2, m=1, ul="pcta")) == 6


def test_sets_give_up_below_k():
    assert SetMerge(3, 2)([((1, 2), 1)]) == {1: (1, 2), 2: (1, 2)}
    assert class_ul([((1, 2), 1)], H, Params(k=3, m=2, ul="pcta")) == 3


def test_large_sets_do_not_overflow():
    items = tuple(range(80))
    assert class_ul([(items, 1)], H, Params(k=2, m=1, ul="pcta")) == 2**80 - 1
    assert exact_ul([(130, 3)]) == 3 * (2**130 - 1)


def test_distances_and_ranks():
    f = frozenset
    assert btd_value(f([1, 2]), f([2, 3])) == 4.5
    assert btd_value(f([1, 2]), f([1, 2])) == pytest.approx(2 / 3)
    assert btd_value(f([1]), f([2])) == 6
    assert btd_groups(Counter({(1, 2): 1}), Counter({(2, 3): 1, (1, 2): 1})) == 4.5
    ncp, far = dense_ranks({"X": 0.1, "Y": 0.1, "Z": 0.3}), dense_ranks({"X": 5, "Y": 2, "Z": 9})
    assert sorted(ncp, key=lambda i: ncp[i] + far[i]) == ["Y", "X", "Z"]


@st.composite
def classes(draw):
    leaves = H.leaves()
    rows = draw(st.lists(st.sets(st.sampled_from(leaves), min_size=0, max_size=4), min_size=1, max_size=14))
    return sorted(Counter(tuple(sorted(r)) for r in rows).items())


@settings(max_examples=120, deadline=None)
@given(classes(), st.integers(1, 4), st.integers(1, 3), st.sampled_from(["reference", "strict"]))
def test_cut_reaches_k_or_root(rows, k, m, mode):
    """Sets of up to m items reach k unless some item had to go to the root."""
    goes = HierarchyCut(H, k, m, mode)(rows)
    assert all(y in H.path(x) for x, y in goes.items())
    support = Counter()
    for items, n in rows:
        for size in range(1, m + 1):
            support.update({c: n for c in combinations(sorted({goes[x] for x in items}), size)})
    filled = sum(n for items, n in rows if items)
    if H.root not in goes.values():
        assert all(n >= k for n in support.values())
    elif mode == "reference" or filled < k:
        assert set(goes.values()) == {H.root}


@settings(max_examples=120, deadline=None)
@given(classes(), st.integers(1, 4), st.integers(1, 3))
def test_sets_reach_k_or_merge_all(rows, k, m):
    of = SetMerge(k, m)(rows)
    assert all(x in s for x, s in of.items()) and all(of[y] == s for s in of.values() for y in s)
    support = Counter()
    for items, n in rows:
        for size in range(1, m + 1):
            support.update({c: n for c in combinations(sorted({of[x] for x in items}), size)})
    if len(set(of.values())) > 1:
        assert all(n >= k for n in support.values())
