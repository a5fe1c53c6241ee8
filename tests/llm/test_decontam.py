import random
import re

import pytest

from blurframe.llm import decontam

WORD = re.compile(decontam.WORD_RE)


def slow(texts, items):
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(win) for win in windows}:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(docs, spark, texts, items, limit=decontam.BROADCAST_ROWS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.overlap(docs(texts), bench, limit=limit).collect()}
    assert len(rows) == len(texts)
    return [(rows[i]["n_words"], rows[i]["n_hit"], [int(x) for x in rows[i]["items"]], rows[i]["contaminated"]) for i in range(len(texts))]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_ROWS, 0])
def test_brute_force(docs, spark, odd, limit):
    """Against every window of every text; a benchmark beyond the limit is shuffled."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 12, 13, 14, 20, 40]))) for i in range(30)]
    items += [(100, items[3][1]), (101, None), (102, "?!"), (103, "one"), (104, "a a a")]
    texts = odd[:-1] + [some(rng.randint(0, 80)) for _ in range(60)]
    texts += [f"{some(20)}, {t.upper()} {some(3)}!" for _, t in items[:20] if t]
    got, want = run(docs, spark, texts, items, limit), slow(texts, items)
    assert [(a, b, sorted(c), d) for a, b, c, d in got] == [(a, b, sorted(c), d) for a, b, c, d in want]


def test_empty_tables(docs, spark):
    assert run(docs, spark, ["one two", None], []) == [(2, 0, [], False), (0, 0, [], False)]
    assert decontam.overlap(docs([]), spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 0


def test_keep_clean(docs, spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = docs([passage, "clean text", f"{passage} " + "word " * 500, None])
    kept = decontam.keep_clean(df, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == df.columns


def test_no_python_in_the_plan(docs, spark):
    plan = decontam.overlap(docs(["a b c"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
