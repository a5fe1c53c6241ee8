import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blurframe.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "a", "b", "c", "d", "e", "f", "g"]), st.integers(0, 10_000), min_size=1))
def test_targets(sizes):
    out = mixing.targets(sizes)
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    assert sum(out.values()) == pytest.approx(sum(sizes.values()))
    free = [s for s in names if out[s] < 3 * sizes[s] - 1e-6]
    assert all(out[s] <= 3 * sizes[s] + 1e-6 for s in names)
    # those below their cap share by weight, and nobody at the cap would get less by weight
    for a in free:
        for b in names:
            assert out[b] / weight[b] <= out[a] / weight[a] + 1e-6 or b not in free
            assert out[b] / weight[b] <= out[a] / weight[a] + 1e-6


def check(rows, sizes_by_source):
    for s, rs in sizes_by_source.items():
        target = rs[0]["target"]
        assert sum(r["taken"] for r in rs) == int(target) if any(r["size"] for r in rs) else True
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rs)
        epochs = int(target // rs[0]["source_size"]) if rs[0]["source_size"] else 0
        assert sum(0 < r["taken"] - epochs * r["size"] < r["size"] for r in rs) <= 1  # one document at the cut


def test_mix(docs, odd):
    texts = ["w " * n for n in range(1, 60)] + odd
    sources = [["a", "b", "c", None, "big"][i % 5] if i > 40 else "big" for i in range(len(texts))]
    df = docs(texts, sources)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(sources[r["doc_id"]], []).append(r)
    check(rows, by)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(docs([])).count() == 0


def test_draw(docs):
    texts = [f"d{i} " + "w " * i for i in range(20)]
    df = docs(texts, ["a" if i % 4 else "b" for i in range(20)])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    out = mixing.draw(df)
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split()
    assert got == {d: t for d, t in taken.items() if t} and out.columns == df.columns
