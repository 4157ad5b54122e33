"""Steps whose work must not grow faster than the input: spanning-tree rounds, tree descents, JSON documents."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrove.functions.materialize import materialize, release, tidy
from corpusgrove.operators import density, neighbours
from corpusgrove.plans import catalog, pipeline


def _points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "row_id long, reduced array<double>")


def _tree_weight(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, k]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    best, out, total = w[0].copy(), np.ones(len(x), bool), 0.0
    out[0] = False
    while out.any():
        i = np.flatnonzero(out)[best[out].argmin()]
        total, out[i] = total + best[i], False
        best = np.minimum(best, w[i])
    return total


@pytest.mark.parametrize("copies", [1, 3])
def test_spanning_tree_searches_only_what_the_lists_leave_open(spark, monkeypatch, copies):
    x = np.random.default_rng(3).normal(size=(150 // copies, 8))
    x = np.concatenate([x] * copies)
    asked, search = [], density.foreign_neighbours
    monkeypatch.setattr(density, "foreign_neighbours", lambda index, labelled, queries, alpha=1.0: asked.append(queries.count()) or search(index, labelled, queries, alpha))
    mst = density.mutual_reachability_mst(_points(spark, x), 3)
    n, total = mst.agg(F.count("w"), F.sum("w")).first()
    assert n == len(x) - 1 and abs(total - _tree_weight(x, 3)) < 1e-9
    assert sum(asked) < len(x) // 4


def test_spanning_tree_of_far_groups_larger_than_a_list(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)) + at for at in (0.0, 50.0, 300.0)])
    total = density.mutual_reachability_mst(_points(spark, x), 4).agg(F.sum("w")).first()[0]
    assert abs(total - _tree_weight(x, 4)) < 1e-8


def test_rows_of_a_node_go_down_in_several_tasks(spark):
    x = np.random.default_rng(5).normal(size=(200, 4))
    index = neighbours.point_index(_points(spark, x), cell_size=8)
    rows = neighbours._descend(_points(spark, x).select("row_id", F.col("reduced").alias("_v")), index.levels[:1], index.metric)
    kids = index.levels[0].select(F.explode("kids").alias("k")).select("k.id", "k.c").collect()
    c, ids = np.array([k["c"] for k in kids]), np.array([k["id"] for k in kids])
    for r in rows.collect():
        d = np.sqrt(((c - x[r["row_id"]]) ** 2).sum(1))
        assert r["node"] == ids[d == d.min()].min() and abs(r["path"][0]["d"] - d.min()) < 1e-12
    assert "salt" in rows._jdf.queryExecution().toString()


def test_single_precision_screen_leaves_no_pair_out():
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=(300, 16)) * 1e-3 + 100])
    q = np.concatenate([c[::7], rng.normal(size=(50, 16)) + 100])
    d2 = ((q[:, None] - c[None]) ** 2).sum(-1)
    most = np.sort(d2, axis=1)[:, 5]
    got = neighbours.Metric().within(q, c, most)
    assert set(np.flatnonzero((d2 <= most[:, None]).ravel())) <= set(got)
    assert neighbours.Metric().within(q, c, np.full(len(q), np.inf)) is None


def test_json_documents_follow_the_size_of_the_rows(spark, tmp_path, monkeypatch):
    from corpusgrove.sources import files
    monkeypatch.setattr(catalog, "JSON_DOCUMENT_BYTES", 2000)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = str(tmp_path / "array")
    catalog._as_documents_of_json(rows.select(F.to_json(F.struct("doc_id", "text"))), path, "[", "]")
    assert max(f.stat().st_size for f in (tmp_path / "array").glob("*.txt")) < 6000
    back = files.read_json_roles(spark, path, {"ref": "doc_id", "text": "text"})
    assert sorted((int(r["ref"]), r["text"]) for r in back.collect()) == [(i, f"text {i}") for i in range(400)]


def test_what_tiles_find_is_merged_a_few_times(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 4)).round(1)  # with ties
    q = neighbours._Side(x, np.arange(1000), None, None, np.full(1000, np.inf))
    merged, keep = [], neighbours._keep_best
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "_keep_best", lambda *a: merged.append(1) or keep(*a))
    for metric in ("euclidean", "manhattan"):
        merged.clear()
        got = {}
        for part in neighbours._search(q, q, 3, neighbours.Metric(metric), 1.0, True):
            for r in part.itertuples():
                got.setdefault(r.row_id, []).append((round(r.d, 9), r.nbr))
        assert len(merged) <= 24  # of 63 tiles or more
        diff = x[:, None] - x[None]
        d = np.sqrt((diff ** 2).sum(-1)) if metric == "euclidean" else np.abs(diff).sum(-1)
        np.fill_diagonal(d, np.inf)
        assert all([v[0] for v in got[i]] == np.sort(d[i])[:3].round(9).tolist() for i in range(len(x)))
        assert all(abs(d[i, j] - v) < 1e-8 for i, some in got.items() for v, j in some)


def test_spanning_tree_rounds_keep_only_edges_between_components(spark, monkeypatch):
    x, seen, between = np.random.default_rng(8).normal(size=(120, 3)), [], density._between
    def logged(edges, comp, how="inner"):
        out = between(edges, comp, how)
        if how == "left":
            seen.append(out.count())
        return out
    monkeypatch.setattr(density, "_between", logged)
    total = density.mutual_reachability_mst(_points(spark, x), 3).agg(F.sum("w")).first()[0]
    assert abs(total - _tree_weight(x, 3)) < 1e-9
    assert seen[-1] == 0 and seen == sorted(seen, reverse=True) and seen[0] < 360


def test_density_prediction_uses_a_given_index(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(60, 3))
    train = _points(spark, x[:50]).withColumn("predict", F.col("row_id").cast("int") % 3)
    new = _points(spark, x[50:])
    index = neighbours.point_index(train)
    core = density.core_distances(neighbours.knn_graph(train, 5, index=index), 5)
    want = {r["row_id"]: r["predict"] for r in density.predict_density(train, new, core).collect()}

    def build(*a, **b):
        raise AssertionError("the train rows are indexed again")
    monkeypatch.setattr(density, "point_index", build)
    assert {r["row_id"]: r["predict"] for r in density.predict_density(train, new, core, index=index).collect()} == want


@pytest.fixture()
def tables(monkeypatch, tmp_dir):
    """The stored tables in a folder of the test's own."""
    monkeypatch.setattr(sys.modules[materialize.__module__], "ensure_checkpoint_dir", lambda spark: tmp_dir)
    at = os.path.join(tmp_dir, "tables")
    return lambda: {t: os.path.join(at, t) for t in os.listdir(at)} if os.path.isdir(at) else {}


def _read(*frames):
    return {os.path.basename(os.path.dirname(f)) for df in frames for f in df.inputFiles()}


def test_training_leaves_the_tables_of_the_model_only(spark, tables, monkeypatch):
    words = np.random.default_rng(0).integers(0, 30, (80, 12)) + 40 * (np.arange(80)[:, None] % 3)
    rows = [(i, " ".join(f"w{x}" for x in w), "dev" if i % 8 == 0 else "train") for i, w in enumerate(words)]
    corpus = spark.createDataFrame(rows, "row_id long, text string, set string")
    most, stored = [], pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df: (stored(df), most.append([t for t in tables().values() if "text" in spark.read.parquet(t).columns]))[0])
    bundle = pipeline.train(pipeline.create_model({"clustering": {"min_cluster_size": 5}}), corpus)
    assert tables().keys() == _read(*bundle.tables.values())
    assert max(map(len, most)) <= 2  # texts: a stage's table and the one before it
    assert bundle["corpus"].count() == 80 and bundle["corpus"].where("set = 'train' and predict is null").count() == 0


def test_tidy_keeps_what_the_result_reads(spark, tables):
    kept = []

    @tidy
    def inner():
        first, second = materialize(spark.range(3)), materialize(spark.range(3, 5))
        kept.append(materialize(spark.range(7), outer_table))
        return second.union(materialize(first.where("id > 0")))

    outer_table = materialize(spark.range(1))
    got = inner()
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4] and kept[0].count() == 7
    assert tables().keys() == _read(got, outer_table, kept[0]) and len(tables()) == 4
    release(kept[0], got)  # got is no table of its own
    assert tables().keys() == _read(got, outer_table)


def test_an_index_outlives_the_search_that_orders_it(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WALK_PAIRS", 0)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    index = neighbours.point_index(_points(spark, np.random.default_rng(1).normal(size=(90, 3))), cell_size=16)
    first = density._only(neighbours.knn_graph, None, 3, index=index)
    assert density._only(neighbours.knn_graph, None, 3, index=index).exceptAll(first).count() == 0
