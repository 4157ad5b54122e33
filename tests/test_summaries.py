"""E1-E10, E14, E15, D13-D15 on a hand-computed three-group set."""
import math

import pytest
from pyspark.sql import functions as F

from corpusgrove.operators import assign, reports, summarise


def three_groups(spark):
    rows = [
        # group 0: square around (0, 0)
        (0, "g0 a", [1.0, 0.0], 0), (1, "g0 b", [-1.0, 0.0], 0), (2, "g0 c", [0.0, 1.0], 0),
        (3, "g0 d", [0.0, -1.0], 0), (4, "g0 centre", [0.0, 0.0], 0),
        # group 1: line at y = 10, tie for representative between 5 and 6
        (5, "g1 a", [9.0, 10.0], 1), (6, "g1 b", [11.0, 10.0], 1),
        # group 3 (key gap on purpose): identical points, radius 0
        (7, "g3 a", [20.0, 0.0], 3), (8, "g3 b", [20.0, 0.0], 3),
        # noise
        (9, "noise", [50.0, 50.0], -1),
    ]
    return spark.createDataFrame([(i, t, v, v[0], v[1], g, "train", f"src{i % 2}") for i, t, v, g in rows],
                                 "row_id long, text string, reduced array<double>, x double, y double, "
                                 "predict int, set string, ref string")


def test_summaries(spark):
    df = three_groups(spark)
    s = {r["group"]: r for r in summarise.group_summaries(df, dim=2).collect()}
    assert set(s) == {0, 1, 3}
    assert s[0]["count"] == 5 and s[0]["mean"] == [0.0, 0.0]
    assert s[0]["repr_id"] == 4 and s[0]["distance"] == pytest.approx(1.0)
    assert s[1]["mean"] == [10.0, 10.0] and s[1]["repr_id"] == 5  # tie -> lowest id
    assert s[1]["distance"] == pytest.approx(0.0)
    assert s[3]["distance"] == 0.0 and s[3]["rel_size"] is None  # min radius is 0 -> NULL
    st = summarise.group_stats(df, summarise.group_summaries(df, dim=2), 2).first()
    assert (st["num_group"], st["no_group"], st["has_group"]) == (3, 1, 9)
    cx, cy = (0 + 10 + 20) / 3, (0 + 10 + 0) / 3
    far = max(math.dist((0, 0), (cx, cy)), math.dist((10, 10), (cx, cy)), math.dist((20, 0), (cx, cy)))
    assert st["max_distance"] == pytest.approx(2 * far)


def test_nearest_and_score(spark):
    df = three_groups(spark)
    summ = summarise.group_summaries(df, dim=2).cache()
    new = spark.createDataFrame([(100, [0.5, 0.0]), (101, [10.0, 9.0]), (102, [30.0, 30.0])],
                                "row_id long, reduced array<double>")
    near = {r["row_id"]: (r["predict"], r["distance"]) for r in assign.assign_nearest(new, summ).collect()}
    assert near[100] == (0, pytest.approx(0.5)) and near[101][0] == 1
    sc = {r["row_id"]: r for r in assign.confidence(assign.score_rows(new, summ)).collect()}
    assert sc[100]["predict"] == 0 and sc[100]["choice2"] in (1, 3)
    assert sc[101]["predict"] == -1  # 1.0 > radius 0 of group 1
    assert sc[102]["predict"] == -1 and sc[102]["choice3"] is not None
    assert sc[100]["confidence"] == pytest.approx(0.5)


def test_blocked_path_equals_broadcast(spark):
    df = three_groups(spark)
    summ = summarise.group_summaries(df, dim=2).cache()
    rows = df.select("row_id", "reduced")
    a = {r["row_id"]: [t["g"] for t in r["top"]] for r in assign.nearest_groups(rows, summ, k=2).collect()}
    b = {r["row_id"]: [t["g"] for t in r["top"]]
         for r in assign.nearest_groups(rows, summ, k=2, budget=0, block_size=1, salt=3).collect()}
    assert a == b


def test_neighbours_and_similarity(spark):
    df = three_groups(spark)
    summ = summarise.group_summaries(df, dim=2).cache()
    stats = summarise.group_stats(df, summ, 2)
    nb = reports.group_neighbours(summ, 0, stats).collect()
    assert [r["group"] for r in nb] == [1, 3]  # itself excluded by id
    with pytest.raises(ValueError):
        reports.group_neighbours(summ, -1, stats)
    sim = {r["row_id"]: r["similarity"] for r in
           reports.text_similarity(df, [0, 4, 9], 4, stats, clamp=True).collect()}
    assert sim[4] == pytest.approx(1.0) and 0.0 <= sim[9] <= 1.0


def test_scatter_cap(spark):
    df = three_groups(spark)
    out = reports.scatter_sample(df, cap=4)
    counts = {r["predict"]: r["n"] for r in out.groupBy("predict").agg(F.count("*").alias("n")).collect()}
    # 10 rows > cap 4 -> max(3, 4 // 3) = 3 rows per group by id
    assert counts == {0: 3, 1: 2, 3: 2, -1: 1}
    assert sorted(r["id"] for r in out.where("predict = 0").collect()) == [0, 1, 2]


def test_score_without_groups_gives_nulls(spark):
    from corpusgrove.operators import assign
    rows = spark.createDataFrame([(1, [0.0, 1.0])], "row_id long, reduced array<double>")
    none = spark.createDataFrame([], "group int, mean array<double>, distance double")
    got = assign.score_rows(rows, none).first()
    assert got["predict"] == -1 and got["choice1"] is None and got["distance"] is None
    assert assign.assign_nearest(rows, none).first()["predict"] is None


def brute_nearest(rows, cents, k):
    return {i: [g for _, g in sorted((math.dist(v, m), g) for g, m in cents)[:k]] for i, v in rows}


def test_pruned_block_join_equals_brute_force_and_prunes(spark):
    from corpusgrove.operators import neighbours
    rng = __import__("random").Random(5)
    # lines of centroids far apart; every tenth one repeated under another id (ties)
    cents = [(g, [float(100 * (g % 20)) + g / 1000, float(g // 20)]) for g in range(400)]
    cents += [(1000 + g, m) for g, m in cents if g % 10 == 0]
    rows = [(i, [100.0 * rng.randrange(20) + rng.random(), 20 * rng.random()]) for i in range(300)]
    rows += [(900 + i, cents[i][1]) for i in range(0, 400, 40)]
    want = brute_nearest(rows, cents, 3)
    df = spark.createDataFrame(rows, "row_id long, reduced array<double>")
    cd = spark.createDataFrame([(g, m, 1.0) for g, m in cents], "group int, mean array<double>, distance double")
    got = {r["row_id"]: r["top"] for r in assign.nearest_groups(df, cd, k=3, budget=0, block_size=8).collect()}
    assert {i: [t["g"] for t in top] for i, top in got.items()} == want
    assert all(t["r"] == 1.0 for top in got.values() for t in top)
    # copies of a row: blocks that the bound allows, out of all blocks
    index = neighbours.point_index(cd.select(F.col("group").cast("long").alias("row_id"), "mean"), "mean", cell_size=8)
    bound = spark.createDataFrame([(i, v, sorted(math.dist(v, m) for _, m in cents)[2]) for i, v in rows], "row_id long, _v array<double>, r double")
    blocks = index.cells.select("cell", "sub").distinct().count()
    assert blocks >= 40 and neighbours._reachable(index, bound).count() < 0.2 * blocks * len(rows)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "braycurtis"])
def test_null_and_repeated_rows_in_every_path(spark, metric):
    cd = spark.createDataFrame([(g, [float(g + 1), float(g * g)]) for g in range(30)], "group int, mean array<double>")
    df = spark.createDataFrame([(None, [3.0, 4.0]), (None, [9.0, 1.0]), (1, [5.0, 5.0]), (1, [20.0, 400.0]), (2, None)], "row_id long, reduced array<double>")

    def tops(**kw):
        return sorted(((r["row_id"], r["reduced"], [t["g"] for t in r["top"]]) for r in assign.nearest_groups(df, cd, k=4, metric=metric, **kw).collect()), key=str)

    assert tops() == tops(budget=0, block_size=4)
    assert (2, None, []) in tops(budget=0, block_size=4) and len(tops(budget=0)) == 5


def test_queries_of_a_hot_block_are_dealt_to_several_tasks(spark, monkeypatch):
    from corpusgrove.operators import neighbours
    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", 16)
    cents = [(g, [float(g), 0.0]) for g in range(40)]
    df = spark.createDataFrame([(i, [7.1, 0.0]) for i in range(200)], "row_id long, reduced array<double>")
    index = neighbours.point_index(spark.createDataFrame(cents, "row_id long, mean array<double>"), "mean", cell_size=8)
    sizes = []
    run = neighbours._brute_force(2, index.metric, own=False)

    def watched(pdf):
        out = run(pdf)
        return out.assign(nbr=len(pdf)) if len(out) else out

    q = df.select("row_id", index.metric.prepared("reduced").alias("_v"), F.lit(1.0).alias("r"))
    got = neighbours._groups(index.cells.select("row_id", "_v", "cell", "sub"), neighbours._reachable(index, q), watched, split=True)
    sizes = [r["nbr"] for r in got.select("nbr").distinct().collect()]
    assert max(sizes) < 80  # 200 queries of one block, in pieces of about 16
    got = assign.nearest_groups(df, spark.createDataFrame(cents, "group int, mean array<double>"), k=2, budget=0, block_size=8)
    assert {tuple(t["g"] for t in r["top"]) for r in got.collect()} == {(7, 8)} and got.count() == 200
