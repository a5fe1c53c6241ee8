import pytest
from pyspark.sql import functions as F

from blurframe.functions import btd, gain, interval_text, lca_of_paths, related_paths
from blurframe.hierarchy import Hierarchy
from blurframe.operators import cluster, items, merge, verify
from blurframe.operators.encode import check_domains, decode, dictionary, domains, encode, missing_values
from blurframe.operators.generalize import coalesce_classes, dataset_ncp, generalize, group_ncp, group_table, relational_columns, row_ncp
from blurframe.operators.neighbors import PairCost, nearest
from blurframe.plans import fixture, pipeline
from blurframe.schema import Params, RTSchema, SchemaError

CITY = Hierarchy.from_lines(["*:north,south", "north:n1,n2", "south:s1,s2"], "city")
BASKET = Hierarchy.from_lines(["*:A,B", "A:a1,a2", "B:b1,b2"], "basket")
SCHEMA = RTSchema.from_header("age#n,city#c,basket#t")
HS = {"city": CITY, "basket": BASKET}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 20.0, "n1", ["a1", "b1"]), (2, 40.0, "s1", ["a2"]), (3, 20.0, "n2", ["a1", "a1", " "]), (4, 40.0, "n2", [])]
    return spark.createDataFrame(rows, "row_id long, age double, city string, basket array<string>")


def test_encode_decode(spark, small):
    e = encode(small, SCHEMA, HS)
    back = {r["row_id"]: r for r in decode(e, SCHEMA, HS).collect()}
    assert (back[1]["age"], back[1]["city"], back[1]["basket"]) == ("20", "n1", ["a1", "b1"])
    assert back[3]["basket"] == ["a1"] and back[4]["basket"] == []
    bad = small.union(spark.createDataFrame([(9, 1.0, "zz", ["q"])], small.schema))
    assert {(r["attr"], r["value"]) for r in missing_values(bad, SCHEMA, HS).collect()} == {("city", "zz"), ("basket", "q")}
    with pytest.raises(SchemaError, match="zz"):
        encode(bad, SCHEMA, HS)
    assert {r["value"]: r["id"] for r in dictionary(small, "city").collect()} == {"n1": 0, "n2": 1, "s1": 2}


def test_pair_losses(spark, small):
    e = encode(small, SCHEMA, HS)
    cost = PairCost.make(SCHEMA, HS, {"age": 100.0})
    found = {(r["center"], r["id"]): r["cost"] for r in nearest(e, e, cost, 4).collect()}
    assert found[1, 2] == pytest.approx(1.2) and found[1, 4] == pytest.approx(0.7) and found[1, 1] == 0
    assert all(found[a, b] == pytest.approx(found[b, a]) for a, b in found)
    one = {(r["center"], r["id"]) for r in nearest(e, e, cost, 1, exclude={1}).collect()}
    assert (1, 3) in one and not any(i == 1 for _, i in one)


def test_group_losses(spark, small):
    e = encode(small, SCHEMA, HS).where("row_id <= 2").withColumn("group_id", F.lit(7).cast("long"))
    g = group_ncp(group_table(e, SCHEMA, HS), SCHEMA, HS, {"age": 100.0})
    row = g.first()
    assert (row["c_city"], row["n_age_lo"], row["n_age_hi"]) == (CITY.root, 20, 40) and row["ncp"] == pytest.approx(2.4)
    assert dataset_ncp(g, SCHEMA).first()["ncp_readable"] == pytest.approx(0.6)
    assert group_ncp(group_table(e, SCHEMA, HS), SCHEMA, HS, {"age": 100.0}, serial_rows=2).first()["ncp"] == pytest.approx(1.2)
    one = generalize(e, SCHEMA, HS).select(row_ncp(SCHEMA, HS, {"age": 0.0}).alias("x")).first()
    assert one["x"] == 1.0  # a domain of one point costs nothing


def test_expressions(spark):
    df = spark.createDataFrame([([1, 2], [2, 3], 20.0, 20.0), ([1], [2], 20.5, 20.5), ([1, 2], [1, 2], 20.0, 40.5)], "a array<int>, b array<int>, lo double, hi double")
    assert [r[0] for r in df.select(btd(F.col("a"), F.col("b"))).collect()] == [4.5, 6.0, pytest.approx(2 / 3)]
    assert [r[0] for r in df.select(interval_text(F.col("lo"), F.col("hi"))).collect()] == ["20", "20.5", "20-40.5"]
    assert [r[0] for r in df.select(gain(F.lit(-3.0), F.lit(0.0)), gain(F.lit(-3.0), F.lit(2.0))).limit(1).collect()] == [1e11]
    assert df.select(gain(F.lit(-3.0), F.lit(0.0), "strict")).first()[0] == -1e11
    p = BASKET.to_df(spark)
    a, b = p.where("label = 'a1'").alias("a"), p.where("label = 'A'").alias("b")
    row = a.crossJoin(b).select(lca_of_paths(F.col("a.path"), F.col("b.path")), related_paths(F.col("a.path"), F.col("a.node"), F.col("b.path"), F.col("b.node"))).first()
    assert row[0] == BASKET.ids["A"] and row[1]


def test_domains(spark, small):
    e = encode(small, SCHEMA, HS)
    assert domains(e, SCHEMA) == {"age": 20.0} and domains(e, SCHEMA, {"age": (0, 100)}) == {"age": 100.0}
    check_domains(e, {"age": (0, 100)})
    with pytest.raises(SchemaError):
        check_domains(e, {"age": (0, 30)})


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return fixture.load(spark, sf_dir)


def check_groups(names, encoded, k):
    assert names.count() == encoded.count() and names.select("row_id").distinct().count() == encoded.count()
    assert names.groupBy("group_id").count().where(F.col("count") < k).isEmpty()


@pytest.mark.parametrize("make", [cluster.cluster_blocks, cluster.cluster_rounds])
def test_clusters_have_k_rows(spark, orders, make):
    e = orders.encoded.drop("group_id")
    names = make(e, orders.schema, orders.hierarchies, Params(k=10, max_clusters=60))
    check_groups(names, e, 10)
    again = make(e.repartition(3), orders.schema, orders.hierarchies, Params(k=10, max_clusters=60))
    assert sorted(map(tuple, names.collect())) == sorted(map(tuple, again.collect()))


def test_cluster_edges(spark, small):
    e = encode(small, SCHEMA, HS)
    with pytest.raises(SchemaError):
        cluster.cluster_rounds(e, SCHEMA, HS, Params(k=5))
    with pytest.raises(SchemaError):
        cluster.cluster_blocks(e, SCHEMA, HS, Params(k=5))
    same = e.union(e.withColumn("row_id", F.col("row_id") + 10)).withColumn("c_city", F.lit(CITY.ids["n1"])).withColumn("n_age_lo", F.lit(1.0)).withColumn("n_age_hi", F.lit(1.0))
    for make in (cluster.cluster_rounds, cluster.cluster_blocks):
        check_groups(make(same, SCHEMA, HS, Params(k=3)), same, 3)
    assert cluster.next_count(100, 19, 100) == 50 and cluster.next_count(100, 100, 100) == 101 and cluster.next_count(100, 60, 100) == 99


@pytest.mark.parametrize("ul", ["hierarchy", "pcta"])
def test_pipeline_guarantees(spark, orders, ul):
    e = orders.encoded.drop("group_id")
    p = Params(k=10, m=2, ul=ul, rd=0.5, max_merges=20)
    done = pipeline.anonymize(e, orders.schema, orders.hierarchies, p, merging="quick", max_rounds=1)
    keys = relational_columns(orders.schema)
    assert done.n_rows == e.count() and 0 <= done.ncp <= 1 and 0 <= done.ul <= 1
    assert verify.lost_rows(e, done.rows).isEmpty()
    assert verify.k_violations(done.rows, keys, 10).isEmpty()
    assert verify.not_covered(e, done.rows, orders.schema, orders.hierarchies).isEmpty()
    if ul == "hierarchy":
        assert verify.km_violations(done.rows, keys, 10, 2).where("NOT hopeless").isEmpty()
        assert verify.items_not_covered(e, done.rows, orders.hierarchies["basket"]).isEmpty()
    else:
        assert verify.set_km_violations(done.rows, keys, 10, 2).where("NOT hopeless").isEmpty()


def test_merging(spark, orders):
    e = orders.encoded.withColumn("group_id", (F.col("c_nation") % 6).cast("long"))
    domain = domains(e, orders.schema)
    before = group_ncp(group_table(e, orders.schema, orders.hierarchies), orders.schema, orders.hierarchies, domain).agg(F.sum("ncp")).first()[0]
    log = merge.MergeLog()
    out = merge.quick_merge(e, orders.schema, orders.hierarchies, Params(k=10, rd=1.0, max_merges=2), domain, log, max_rounds=2)
    assert out.count() == e.count() and out.select("group_id").distinct().count() < 6 and log.rounds[-1][0] >= before
    loss = group_ncp(group_table(out, orders.schema, orders.hierarchies), orders.schema, orders.hierarchies, domain).agg(F.sum("ncp")).first()[0]
    assert loss == pytest.approx(log.rounds[-1][0])
    log = merge.MergeLog()
    fine = orders.encoded.withColumn("group_id", (F.col("c_nation") * 10 + F.col("c_priority")).cast("long"))
    out = merge.merge_rounds(fine, orders.schema, orders.hierarchies, Params(k=10, rd=1.0, max_merges=10), domain, log, max_rounds=2)
    ul = merge.exact_total(merge.group_ul(out, orders.hierarchies["basket"], Params(k=10)))
    assert ul == log.rounds[-1][1] and out.count() == e.count()


@pytest.mark.parametrize("order,bound", merge.VARIANTS)
def test_serial_merging(spark, small, order, bound):
    rows = small.union(small.withColumn("row_id", F.col("row_id") + 10)).union(small.withColumn("row_id", F.col("row_id") + 20))
    e = encode(rows, SCHEMA, HS).withColumn("group_id", F.col("row_id") % 6)
    run = merge.SerialMerger(SCHEMA, HS, {"age": 100.0}, Params(k=2, m=1), order, bound, 1.0 if bound == "ncp" else 0.0)
    out = run(e)
    assert out.count() == 12
    if bound == "ncp":
        total = group_ncp(group_table(out, SCHEMA, HS), SCHEMA, HS, {"age": 100.0}, serial_rows=12).agg(F.sum("ncp")).first()[0]
        assert total <= 1.0 and out.select("group_id").distinct().count() < 6


def test_bounds_and_tuning(spark, orders):
    e = orders.encoded.drop("group_id")
    few = e.where("row_id < 600")
    out = pipeline.rum_bound(few, orders.schema, orders.hierarchies, Params(k=10, m=1), 2.3)
    assert verify.k_violations(out, relational_columns(orders.schema), 10).isEmpty()
    assert pipeline.tum_bound(few, orders.schema, orders.hierarchies, Params(k=10, m=1), 0.0).count() == few.count()
    with pytest.raises(pipeline.BoundMissed):
        pipeline.rum_bound(few, orders.schema, orders.hierarchies, Params(k=10, m=1), 1e-6)
    assert [s for s, _ in pipeline.sweep(lambda n: 1000.0 + n, 100, 1.0, 2000)][:2] == [100, 200]
    assert pipeline.tune_centers(few, orders.schema, orders.hierarchies, Params(k=5), 5, 1e9, 10)


def test_rules_in_order(spark):
    b = BASKET.ids
    df = spark.createDataFrame([([b["a1"], b["b1"]],), ([b["b2"]],)], "items array<int>")
    out = [r[0] for r in df.select(items.apply_rules(F.col("items"), [BASKET.cut(b["A"]), BASKET.cut(b["B"])])).collect()]
    assert out == [sorted([b["A"], b["B"]]), [b["B"]]]
    assert coalesce_classes(spark.createDataFrame([(1, 5, 1.0, 1.0, 0), (2, 3, 1.0, 1.0, 0)], "row_id long, group_id long, n_age_lo double, n_age_hi double, c_city int"), SCHEMA).select("group_id").distinct().collect()[0][0] == 3


def test_blocks_do_not_depend_on_partitions(spark, orders):
    e = orders.encoded.drop("group_id")
    made = [cluster.cluster_blocks(x, orders.schema, orders.hierarchies, Params(k=10), block_rows=100) for x in (e, e.repartition(7))]
    check_groups(made[0], e, 10)
    assert sorted(map(tuple, made[0].collect())) == sorted(map(tuple, made[1].collect()))


def test_serial_leftovers_weigh_by_rows(spark):
    """The second leftover goes where loss times rows is least: 65/115 x 3 = 195/115 against 50/115 x 4 = 200/115."""
    schema = RTSchema.from_header("age#n,basket#t")
    rows = [(1, 0.0), (2, 0.0), (3, 0.0), (4, 115.0), (5, 115.0), (6, 115.0), (7, 0.0), (8, 50.0)]
    df = spark.createDataFrame([(i, x, ["a1"]) for i, x in rows], "row_id long, age double, basket array<string>")
    names = cluster.serial_groups(encode(df, schema, HS), schema, HS, Params(k=3))
    assert {r["row_id"]: r["group_id"] for r in names.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 6: 4, 8: 4}


def test_serial_clustering_refuses_large_tables(spark, orders, monkeypatch):
    monkeypatch.setattr(cluster, "SERIAL_ROWS", 100)
    with pytest.raises(SchemaError, match="over 100 rows"):
        pipeline.rum_bound(orders.encoded.drop("group_id"), orders.schema, orders.hierarchies, Params(k=10), 9.0)


def test_merging_with_many_items(spark):
    """Item losses beyond any decimal: a hierarchy of 200 leaves."""
    wide = Hierarchy.from_lines(["*:A,B", "A:" + ",".join(f"a{i}" for i in range(100)), "B:" + ",".join(f"b{i}" for i in range(100))], "basket")
    hs = {"city": CITY, "basket": wide}
    rows = [(i, float(i % 7), ["n1", "n2", "s1"][i % 3], [f"a{i}", f"b{i % 5}"]) for i in range(60)]
    e = encode(spark.createDataFrame(rows, "row_id long, age double, city string, basket array<string>"), SCHEMA, hs).withColumn("group_id", F.col("row_id") % 12)
    params = Params(k=3, m=1, max_merges=4)
    losses = merge.group_ul(e, wide, params)
    assert merge.exact_total(losses) == sum(int(r["ul"]) for r in losses.collect()) > 10**30
    log = merge.MergeLog()
    out = merge.merge_rounds(e, SCHEMA, hs, params, domains(e, SCHEMA), log)
    assert merge.exact_total(merge.group_ul(out, wide, params)) == log.rounds[-1][1] <= merge.exact_total(losses)
    assert out.count() == 60


def test_serial_scaling(spark):
    """Two rows at node A of a hierarchy of four leaves: (3 + 3) / 15 over two rows; as sets the same."""
    b = BASKET.ids
    df = spark.createDataFrame([(1, 7, [b["A"]]), (2, 7, [b["A"]])], "row_id long, group_id long, items array<int>")
    assert items.ul_serial(df, BASKET, 2).first()["ul"] == "0." + "2" + "0" * 199
    sets = spark.createDataFrame([(1, 7, [[b["a1"], b["a2"]], [b["b1"]]]), (2, 7, [])], "row_id long, group_id long, item_sets array<array<int>>")
    assert items.ul_serial(sets, BASKET, 2).first()["ul"] == "0." + "1" + "0" * 199


def test_places_and_ranks(spark):
    from blurframe.operators.order import dense_ranks, numbered

    df = spark.createDataFrame([(i * 7 % 100, i % 5) for i in range(100)], "x long, y long").repartition(6)
    assert all(r["x"] == r["place"] for r in numbered(df, ["x"]).collect())
    assert all(r["rank"] == r["y"] + 1 for r in dense_ranks(df, "y", "rank").collect())
    assert numbered(df.limit(0), ["x"]).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from blurframe import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session)


def test_group_distance_by_brute_force():
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(30):
        groups = [Counter(tuple(sorted(rng.sample(range(8), rng.randrange(0, 5)))) for _ in range(rng.randrange(0, 8))) for _ in range(2)]
        rows = [frozenset(s) for g in groups for s in g.elements()]
        assert merge.btd_groups(*groups) == max((merge.btd_value(x, y) for x, y in combinations(rows, 2)), default=0.0)
