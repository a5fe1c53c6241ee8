import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blurframe.llm import passages


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_compact_windows_cover_every_subsequence_once(values, length):
    array = np.array(values, dtype=np.uint64)
    found = list(zip(*passages.compact_windows(array, length)))
    for i in range(len(values)):
        for j in range(i + length, len(values) + 1):
            own = [(a, c, b) for a, c, b in found if a <= i <= c < j <= b]
            assert len(own) == 1 and values[own[0][1]] == min(values[i:j])


@given(st.binary(max_size=80))
def test_word_hashes(text):
    """Equal words have equal hashes, and others have others."""
    hashes, starts = passages.word_hashes(text)
    split = text.lower().split()
    assert len(hashes) == len(split) and all(text.lower()[i : i + len(w)] == w for i, w in zip(starts, split))
    assert len(set(zip(hashes.tolist(), split))) == len(set(split)) == len(set(hashes.tolist()))


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def linked(rows):
    """The documents of a class, joined: a function to their representative, and the documents of the result."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        parent[find((r["rep_doc_id"], r["rep_start"]))] = find(r["doc_id"])
    return find


def near(a, b):
    """Whether two word lists of which each word stands in one place hold near passages, by brute force over their parts."""
    place = {w: i for i, w in enumerate(b)}
    sa, sb = ([tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (a, b))
    ends = [(i, place[w]) for i, w in enumerate(a) if w in place]
    known, shared = set(sb), [0]
    for s in sa:
        shared.append(shared[-1] + (s in known))
    if shared[-1] < 41:
        return False
    for i, j in ends:
        for i2, j2 in ends:
            n, m = i2 - i + 1, j2 - j + 1
            if min(n, m) >= 50:
                both = shared[i2 - 3] - shared[i]
                if 10 * both >= 8 * (n - 4 + m - 4 - both):
                    return True
    return False


def brute_components(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if near(texts[i], texts[j])]
    for i, j in links:
        parent[find(i)] = find(j)
    return find, links


def test_repeated_passages_are_found(docs):
    rng = random.Random(1)
    shared = words(rng, 60)
    near = list(shared) + words(rng, 40)
    changed = list(near)
    changed[30] = "changed"
    texts = [words(rng, 300) for _ in range(30)]
    for i in range(3):
        texts[i] = words(rng, 100) + shared + words(rng, 80)
    texts[3] = words(rng, 50) + near + words(rng, 50)
    texts[4] = words(rng, 120) + changed + words(rng, 9)
    texts[5] = list(texts[6])
    texts[7] = words(rng, 60) + shared[:44] + words(rng, 60)  # too short
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts] + [None, "", "short text", "short text"])).collect()
    find = linked(rows)
    assert find(0) == find(1) == find(2) == find(3) == find(4) and find(5) == find(6) != find(0)
    assert {r["doc_id"] for r in rows} == set(range(7))
    for r in rows:
        text, other = ([w for w in texts[d][s : s + r["n_words"]]] for d, s in ((r["doc_id"], r["start"]), (r["rep_doc_id"], r["rep_start"])))
        assert len(text) == r["n_words"] >= 50
        if r["kind"] == "copy":
            assert text == other and r["doc_id"] in (5, 6)
        elif r["doc_id"] in (0, 1, 2):
            assert abs(r["start"] - 100) <= 2 and abs(r["n_words"] - 60) <= 2
    assert {r["doc_id"] for r in rows if r["kind"] == "copy"} == {5, 6}


@pytest.mark.parametrize("line", [20, 55])
def test_crowds(docs, line):
    """A passage in many documents is linked throughout; a common line that is too short links nobody."""
    rng = random.Random(line)
    common, other = words(rng, line), words(rng, 70)
    texts = [words(rng, 90) + common + words(rng, 90) for _ in range(40)]
    for i in (3, 20, 39):
        texts[i] = texts[i] + other + words(rng, 20)
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    find = linked(rows)
    assert find(3) == find(20) == find(39)
    assert len({find(i) for i in range(40)}) == (1 if line > 50 else 38)
    assert len(rows) == (43 if line > 50 else 3)


def test_repeats_within_a_document(docs):
    rng = random.Random(9)
    passage = words(rng, 30) + ["x"] * 10 + words(rng, 30)
    texts = [passage + words(rng, 40) + passage, words(rng, 20) + passage, ["same", "line"] * 100]
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    assert {r["doc_id"] for r in rows} == {0, 1} and linked(rows)(0) == linked(rows)(1)
    assert sorted(r["start"] for r in rows if r["doc_id"] == 0) == [0, 110]
    assert passages.repeated_passages(docs([])).count() == 0


def test_one_word_over_and_over(docs):
    """Repeated words make few windows, and equal runs of them are found."""
    texts = [["w"] * 3000, ["a"] * 9 + ["w"] * 80 + ["b"] * 9, ["w"] * 40 + ["c"] * 20, ["one", "two", "three"] * 5000]
    nodes = passages.nodes_of([" ".join(t).encode() for t in texts], np.arange(4))
    assert len(nodes["c"]) < 200
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    assert {r["doc_id"] for r in rows} == {0, 1}


def test_long_copies_and_long_texts(docs):
    """Lengths of long copies and of long near texts are whole."""
    rng = random.Random(2)
    long = words(rng, 120_000, 10**6)
    almost = list(long)
    for i in range(500, len(almost), 1000):
        almost[i] = "other"
    rows = passages.repeated_passages(docs([" ".join(t) for t in (long, long, almost)])).collect()
    assert {(r["doc_id"], r["n_words"]) for r in rows if r["kind"] == "copy"} == {(0, 120_000), (1, 120_000)}
    whole = [r for r in rows if r["kind"] == "passage"]
    assert {r["doc_id"] for r in whole} == {0, 2} and sum(r["n_words"] for r in whole) > 2 * 119_000


def test_odd_rows(spark, docs):
    """Null ids, repeated rows, one id with two texts, and columns of the input that clash."""
    rng = random.Random(3)
    shared = " ".join(words(rng, 80))
    x, y = " ".join(words(rng, 100)), " ".join(words(rng, 100))
    table = docs([shared + " " + x, shared + " " + y, shared, shared + " " + x, y], ids=[1, 2, None, 1, 1])
    for name in ("sig", "start", "value", "rep_doc_id", "id", "words", "own", "kind"):
        table = table.withColumn(name, table["lang"])
    rows = passages.repeated_passages(table).collect()
    assert {(r["doc_id"], r["n_words"]) for r in rows} == {(1, 100), (2, 80), (2, 100)}
    assert len({linked(rows)(d) for d in (1, 2)}) == 1


CHANGES = {"substitute": lambda w, a: ["new"], "insert": lambda w, a: ["new", w], "insert3": lambda w, a: ["new", "newer", "newest", w], "delete": lambda w, a: []}


def around(text, centre):
    hashes = (passages.word_hashes(" ".join(text).encode())[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    zeros = np.zeros(passages.AROUND, np.uint32)
    return np.concatenate([zeros, hashes, zeros])[centre : centre + 2 * passages.AROUND + 5][None]


@pytest.mark.parametrize("change", CHANGES)
def test_one_change_anywhere(change):
    """Passages of 50 to 100 words with a change at every place are verified at the centre of their longest run, as brute force says."""
    wrong = []
    for n in (50, 55, 64, 80, 100):
        for at in range(1, n - 1, 3):
            a = [f"p{i}" for i in range(n)]
            b = a[:at] + CHANGES[change](a[at], a) + a[at + 1 :]
            x, y = ([f"{s}{i}" for i in range(100)] + t + [f"{s}{i}" for i in range(100, 200)] for s, t in (("l", a), ("r", b)))
            # the longest run is before or after the change
            later = at + (change != "insert" and change != "insert3")
            i, n_run = max((100, at - 4), (100 + later, n - later - 4), key=lambda run: run[1])
            j = i + (len(b) - len(a) if i > 100 else 0)
            expected = near(x[80:-80], y[80:-80])
            if n_run < passages.RUN:
                assert not expected
                continue
            for k in (0, n_run // 2, n_run - 1):
                p, q = around(x, i + k), around(y, j + k)
                found = passages.match(p, q)[0][0]
                shifted = passages.match_shifted(p, q)
                if found:
                    assert shifted[0][0]
                if shifted[0][0]:
                    lx, rx, ly, ry, shared = (int(v[0]) for v in shifted[1:])
                    u, v = ({tuple(t[m : m + 5]) for m in range(c + f - passages.AROUND, c + l + 1 - passages.AROUND)} for t, c, f, l in ((x, i + k, lx, rx), (y, j + k, ly, ry)))
                    assert len(u & v) == shared and shared >= 0.8 * len(u | v)
                if bool(shifted[0][0]) != expected:
                    wrong.append((n, at, k, expected))
    assert wrong == []


@pytest.mark.parametrize("n", [12, 40, 100])
def test_crowds_of_near_copies(docs, n):
    """Texts that carry one passage with words changed in each have the components of all pairs compared by brute force."""
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(n):
        own = list(passage)
        for at in rng.sample(range(60), rng.choice([1, 1, 2])):
            own[at] = f"c{i}x{at}"
        texts.append([f"a{i}x{j}" for j in range(40)] + own + [f"b{i}x{j}" for j in range(40)])
    expected, links = brute_components(texts)
    assert len(links) > n
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    find = linked(rows)
    assert all(find(i) == find(j) for i, j in links)
    assert len({find(i) for i in range(n)}) == len({expected(i) for i in range(n)})


def test_a_mixed_corpus(docs):
    """Every near pair by brute force is in one class: changes of all kinds, passages of 50 to 150 words, and texts without any."""
    rng = random.Random(5)
    texts = [[f"t{i}x{j}" for j in range(rng.randrange(40, 200))] for i in range(60)]
    for k in range(20):
        passage = [f"q{k}x{j}" for j in range(rng.randrange(45, 150))]
        for i in rng.sample(range(60), rng.randrange(2, 5)):
            own = list(passage)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + 1] = CHANGES[rng.choice(list(CHANGES))](own[at], own)
            own = [w if w[0] == "q" else f"{w}{i}x{k}x{n}" for n, w in enumerate(own)]
            cut = rng.randrange(len(texts[i]))
            texts[i] = texts[i][:cut] + own + texts[i][cut:]
    expected, links = brute_components(texts)
    rows = passages.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    find = linked(rows)
    lost = [x for x in links if find(x[0]) != find(x[1])]
    assert len(links) > 30 and lost == []
    assert {x for link in links for x in link} == {r["doc_id"] for r in rows}


@pytest.mark.parametrize("block", [64, 1 << 15])
def test_near_links_in_a_crowd(docs, monkeypatch, block):
    """Texts are linked that are near each other only, not near the first texts of their crowd, and have no 50 equal words."""
    monkeypatch.setattr(passages, "BLOCK", block, raising=False)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(96)]
    beside = lambda: words(rng, 30, 10**9)
    # quotes of 40 words are in the same groups and near nobody
    quotes = [beside() + passage[i : i + 40] + beside() for i in range(57) for _ in range(3)]
    near = [beside() + passage[:i] + beside()[:1] + passage[i + 1 :] + beside() for i in (46, 47, 48, 49) * 4]
    rows = passages.repeated_passages(docs([" ".join(t) for t in quotes + near])).collect()
    find = linked(rows)
    assert len({find(171 + i) for i in range(16)}) == 1
    assert {r["doc_id"] for r in rows} == set(range(171, 187))
