"""B1-B9, A6, A7 on a tiny corpus."""
from pyspark.sql import functions as F

from corpusgrove.operators import curate


def first_load(spark):
    return spark.createDataFrame([
        ("a", "2024-01-01 10:00:00", "train"),
        ("b", "not a date", "dev"),
        (None, "2024-01-02", None),
        ("a", "2024-01-03", "other"),
        ("c", "2024-01-04", "dev"),
        ("c", "2024-01-05", "dev"),
    ], "text string, ts string, set string")


def test_append_dedupe_and_ids(spark):
    c = curate.append_rows(None, first_load(spark))
    rows = sorted((r["row_id"], r["text"], r["set"]) for r in c.collect())
    # null text dropped, the second "a" (routed to train) deduped, dev not deduped
    assert rows == [(0, "a", "train"), (1, "b", "dev"), (3, "c", "dev"), (4, "c", "dev")]
    bad = c.where(F.col("text") == "b").first()
    assert bad["ts"] is None
    again = curate.append_rows(c, spark.createDataFrame([("a", None), ("d", None)], "text string, set string"))
    rows2 = sorted((r["row_id"], r["text"]) for r in again.where(F.col("set") == "train").collect())
    assert rows2 == [(0, "a"), (6, "d")]  # existing row wins, ids continue after the max


def corpus(spark):
    return curate.conform(spark.createDataFrame(
        [(i, f"t{i}", "train" if i < 4 else "dev", i % 3, float(i)) for i in range(6)],
        "row_id long, text string, set string, predict int, distance double"))


def test_delete_copy_move(spark):
    c = corpus(spark)
    assert sorted(r["row_id"] for r in curate.delete_rows(c, [1, 4], "train").collect()) == [0, 2, 3, 4, 5]
    cp = curate.copy_rows(c, [1, 2], to="dev")
    assert cp.where(F.col("set") == "dev").count() == 4
    mv = curate.move_rows(c, [1, 5], to="dev")
    sets = {r["row_id"]: r["set"] for r in mv.collect()}
    assert sets[1] == "dev" and sets[5] == "dev" and sets[0] == "train"


def test_clear_and_reset(spark):
    c = corpus(spark)
    assert curate.clear_set(c, "dev").count() == 4
    r = curate.reset_columns(c, "dev", predict=True)
    dev = r.where(F.col("set") == "dev").collect()
    assert all(x["predict"] is None and x["distance"] is None for x in dev)
    tr = r.where(F.col("set") == "train").collect()
    assert all(x["predict"] is not None for x in tr)


def test_contiguous_ids(spark):
    from corpusgrove.operators.ids import contiguous_ids
    df = spark.range(0, 1000, numPartitions=7).withColumn("v", F.col("id") * 2)
    out = contiguous_ids(df.orderBy(F.col("v").desc()), "rid")
    got = sorted((r["rid"], r["v"]) for r in out.collect())
    assert [g[0] for g in got] == list(range(1000))
    assert got[0][1] == 1998
