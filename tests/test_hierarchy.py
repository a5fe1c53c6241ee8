import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blurframe.hierarchy import Hierarchy
from blurframe.schema import Params, RTSchema, SchemaError

LINES = ["*:A,B", "A:a1,a2", "B:b1,b2"]


@pytest.fixture
def h():
    return Hierarchy.from_lines(LINES, "basket")


def test_shape_and_costs(h):
    node = h.ids
    assert (h.size, h.n_leaves, h.labels[h.root]) == (7, 4, "*")
    assert [h.depth(node[x]) for x in ("*", "A", "a1")] == [0, 1, 2]
    assert [h.leaf_frac(node[x]) for x in ("*", "A", "a1")] == [1.0, 0.5, 0.0]
    assert [h.ul_weight(node[x]) for x in ("*", "A", "a1")] == [15, 3, 0]
    assert h.labels[h.lca(node["a1"], node["a2"])] == "A"
    assert h.labels[h.lca(node["a1"], node["b1"])] == "*"
    assert h.labels[h.lca(node["a1"], node["A"])] == "A"
    assert h.related(node["a1"], node["A"]) and not h.related(node["a1"], node["a2"]) and not h.related(node["A"], node["B"])
    assert h.cut(node["A"]) == ([node["a1"], node["a2"]], node["A"]) and h.cut(node["a1"]) is None
    assert h.crawl_up(node["a1"]) == [node["*"], node["A"]]
    assert h.leaves() == [node[x] for x in ("a1", "a2", "b1", "b2")]
    assert h.crawl_down(h.root, leaves_only=True) == h.leaves()
    assert h.inner_nodes() == [node[x] for x in ("*", "A", "B")]


def test_bad_trees():
    with pytest.raises(SchemaError, match="one root"):
        Hierarchy.from_lines(["x:a", "y:b"])
    with pytest.raises(SchemaError):
        Hierarchy([("a", "b"), ("b", "a")])
    with pytest.raises(SchemaError):
        Hierarchy([("r", "a"), ("b", "c"), ("c", "b")])
    with pytest.raises(SchemaError, match="empty"):
        Hierarchy.from_lines([])


def test_inner_node_with_one_child():
    h = Hierarchy.from_lines(["*:A,B", "A:a1", "B:b1,b2"])
    assert h.leaf_counts[h.ids["A"]] == 1 and h.leaf_frac(h.ids["A"]) == pytest.approx(1 / 3)


def test_unbalanced_levels():
    h = Hierarchy.from_lines(["*:A,x", "A:a1,a2"])
    x = h.ids["x"]
    assert h.levels(x) == [0, x, -1 - x]
    assert h.levels(h.ids["a1"])[-1] == h.ids["a1"]


@st.composite
def trees(draw):
    n = draw(st.integers(2, 25))
    return Hierarchy([(f"v{draw(st.integers(0, i - 1))}", f"v{i}") for i in range(1, n)])


@settings(max_examples=60, deadline=None)
@given(trees(), st.data())
def test_lca_properties(h, data):
    a, b = (data.draw(st.integers(0, h.size - 1)) for _ in "ab")
    up = h.lca(a, b)
    assert up == h.lca(b, a) and up in h.path(a) and up in h.path(b)
    assert h.related(a, b) == (a in h.path(b) or b in h.path(a))
    assert max(h.leaf_frac(a), h.leaf_frac(b)) <= h.leaf_frac(up)
    for node in range(h.size):
        assert h.leaf_counts[node] == (0 if h.is_leaf(node) else len(h.crawl_down(node, leaves_only=True)))
    la, lb = h.levels(a), h.levels(b)
    deepest = [x for x, y in zip(la, lb) if x == y][-1]
    assert (deepest if deepest >= 0 else -1 - deepest) == up


def test_schema_header():
    s = RTSchema.from_header("age#n,city#c,basket#t")
    assert (s.numeric, s.categorical, s.items, s.n_relational) == (["age"], ["city"], "basket", 2)
    assert RTSchema.from_order("nct").columns == (("n0", "n"), ("c1", "c"), ("t2", "t"))
    for bad in ("age,city#c", "a#n,b#c", "a#n,a#c,t#t", "a#x,t#t", "a#t,b#t"):
        with pytest.raises(SchemaError):
            RTSchema.from_header(bad)
    with pytest.raises(SchemaError):
        RTSchema((("a", "n"), ("t", "t")), {"zz": 1.0})


def test_params():
    p = Params(k=10, rd=0.7)
    assert p.conflicts == 5 and p.scaled(100, 7, 4) == (pytest.approx(490), 0)
    assert Params(td=0.5).scaled(4, 1, 4)[1] == 30
    for bad in ({"k": 0}, {"ul": "x"}, {"rd": 2}, {"max_merges": 0}, {"min_tree": 3, "max_tree": 2}, {"mode": "x"}):
        with pytest.raises(SchemaError):
            Params(**bad)
