"""Sources and sinks with edge-case files."""
import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrove.sources import bundle as B
from corpusgrove.sources import files
from corpusgrove.sources.python_sources import encode_npy

EDGE_TEXTS = ['He said "hi"', "back\\slash", "two\nlines", "#leading hash", "inner # hash",
              "  padded  ", "NA"]


def test_csv_by_role_multiline(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write('2024-01-01,"line one\nline two",src1,dev\n')
        fh.write('bad date,"plain",src2,train\n')
        fh.write('2024-01-03,"say ""x""",src3,\n')
    df = files.read_csv_roles(spark, p, {"text": 1, "ts": 0, "ref": 2, "set": 3, "target": "fixed:1"})
    rows = {r["ref"]: r for r in df.collect()}
    assert rows["src1"]["text"] == "line one\nline two"
    assert rows["src2"]["ts"] is None and rows["src3"]["text"] == 'say "x"'
    assert all(r["target"] == 1 for r in rows.values())


def test_two_roles_one_column(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.csv")
    with open(p, "w") as fh:
        fh.write("a,7\nb,8\n")
    df = files.read_csv_roles(spark, p, {"text": 0, "ref": 1, "predict": 1})
    assert sorted((r["text"], r["ref"], r["predict"]) for r in df.collect()) == [("a", "7", 7), ("b", "8", 8)]


def test_csv_skip_first(spark, tmp_dir):
    p = os.path.join(tmp_dir, "skip.csv")
    with open(p, "w") as fh:
        fh.write("junk line\nheader,x\n\"multi\nline\",1\nplain,2\n")
    df = files.read_csv_roles(spark, p, {"text": 0, "predict": 1}, skip_first=2)
    assert sorted(r["text"] for r in df.collect()) == ["multi\nline", "plain"]


def test_export_round_trip(spark, tmp_dir):
    from corpusgrove.operators.curate import append_rows
    src = spark.createDataFrame([(t, "dev" if i % 2 else "train") for i, t in enumerate(EDGE_TEXTS)],
                                "text string, set string")
    corpus = append_rows(None, src, dedupe_sets=())
    out = files.export_csv(corpus, os.path.join(tmp_dir, "export"))
    assert files.is_export(out)
    back = files.read_export(spark, out)
    assert sorted(r["text"] for r in back.collect()) == sorted(EDGE_TEXTS)
    single = files.export_csv(corpus, os.path.join(tmp_dir, "export.csv"), single_file=True)
    assert files.is_export(single)
    back2 = files.read_export(spark, single)
    assert sorted(r["text"] for r in back2.collect()) == sorted(EDGE_TEXTS)


def test_json_layouts(spark, tmp_dir):
    recs = [{"body": "x one", "src": "a"}, {"body": "x two", "src": "b"}]
    lines = os.path.join(tmp_dir, "l.json")
    with open(lines, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    arr = os.path.join(tmp_dir, "a.json")
    with open(arr, "w") as fh:
        json.dump(recs, fh, indent=1)
    keyed = os.path.join(tmp_dir, "k.json")
    with open(keyed, "w") as fh:
        json.dump({str(i): r for i, r in enumerate(recs)}, fh)
    for p in (lines, arr, keyed):
        df = files.read_json_roles(spark, p, {"text": "body", "ref": "src"})
        assert sorted((r["text"], r["ref"]) for r in df.collect()) == [("x one", "a"), ("x two", "b")], p


def test_sqlite_with_blobs(spark, tmp_dir):
    p = os.path.join(tmp_dir, "d.sqlite3")
    con = sqlite3.connect(p)
    con.execute('CREATE TABLE dataset ("the text" TEXT, emb BLOB, ts TEXT, "set" TEXT)')
    for i in range(7):
        con.execute("INSERT INTO dataset VALUES (?, ?, ?, ?)",
                    (f"t{i}", encode_npy(np.arange(3, dtype=np.float32) + i), "2024-01-0%d" % (i + 1),
                     "dev" if i == 3 else "train"))
    con.execute("DELETE FROM dataset WHERE rowid IN (2, 5)")  # rowid gaps
    con.commit()
    con.close()
    df = files.read_sqlite_roles(spark, p, {"text": "the text", "embedding": "emb", "ts": "ts", "set": "set"},
                                 rows_per_partition=2)
    rows = sorted(df.collect(), key=lambda r: r["text"])
    assert [r["text"] for r in rows] == ["t0", "t2", "t3", "t5", "t6"]
    assert rows[1]["embedding"] == [2.0, 3.0, 4.0]
    corpus = files.load_dataset(spark, None, p, roles={"text": "the text", "embedding": "emb", "set": "set"})
    assert corpus.where(F.col("set") == "dev").count() == 1


@pytest.mark.parametrize("max_intervals", [4, 100_000])
def test_sqlite_ranges_follow_the_rows(tmp_dir, max_intervals):
    from corpusgrove.sources.python_sources import rowid_ranges
    rng = np.random.default_rng(1)
    ids = {"dense": range(1, 1001), "ends": [-(1 << 62), 0, (1 << 62)], "one": [1 << 61], "none": [],
           "far": sorted({int(x) for x in rng.integers(0, 1 << 62, 1000)}),
           "mixed": [*range(500), *[int(x) for x in sorted(rng.integers(1 << 40, 1 << 62, 300))], *range((1 << 62) + 5, (1 << 62) + 205)]}
    con = sqlite3.connect(os.path.join(tmp_dir, "r.sqlite3"))
    for name, keys in ids.items():
        con.execute(f"CREATE TABLE {name} (k INTEGER PRIMARY KEY, v TEXT)")
        con.executemany(f"INSERT INTO {name} VALUES (?, 'x')", [(k,) for k in keys])
        got = rowid_ranges(con, name, 10, max_intervals)
        held = [sum(a <= k <= b for k in keys) for a, b in got]
        assert sum(held) == len(keys) and all(0 < n <= 10 for n in held), name
        assert all(p[1] < q[0] for p, q in zip(got, got[1:])), name
        # two neighbours hold more than a step by width or by count; a dense run is cut at most twice too often
        assert len(got) <= 4 * len(keys) / 10 + 2, (name, len(got))
    con.close()


def test_export_of_odd_texts_through_spark(spark, tmp_dir):
    from corpusgrove.operators.curate import conform
    texts = ["# no comment", "two\nlines", 'a "quote", and a comma', "  padded  ", "plain", "back\\slash"]
    corpus = conform(spark.createDataFrame([(i, t, "train") for i, t in enumerate(texts)], "row_id long, text string, set string"))
    for single in (False, True):
        path = files.export_csv(corpus, os.path.join(tmp_dir, f"e{single}"), single_file=single)
        path = files.export_csv(corpus, path, single_file=single)  # once more over the first
        assert files.is_export(path) and os.path.isfile(path) == single
        assert sorted(r["text"] for r in files.read_export(spark, path).collect()) == sorted(texts), single
    assert not [p for p in os.listdir(tmp_dir) if ".parts" in p]
    other = os.path.join(tmp_dir, "other.csv")
    corpus.select("text").write.csv(other)
    assert not files.is_export(other)


def test_bundle_and_catalogue(spark, tmp_dir):
    from corpusgrove.operators.curate import conform
    corpus = conform(spark.createDataFrame([(0, "a", "train"), (1, "b", "dev")], "row_id long, text string, set string"))
    b = B.Bundle(name="m1", tables={"corpus": corpus})
    cat = B.Catalogue(spark, os.path.join(tmp_dir, "cat"))
    cat.save(b)
    assert [r["name"] for r in cat.list().collect()] == ["m1"]
    assert cat.load("m1")["corpus"].count() == 2
    cat.delete("m1")
    assert cat.list().count() == 0
    with pytest.raises(ValueError):
        B.check_name("../etc")
    assert B.default_name().startswith("model-")


def test_preview(spark):
    df = spark.range(100)
    assert files.preview(df).count() == 5


def test_skip_first_keeps_comment_lines_inside_texts(spark, tmp_dir):
    p = os.path.join(tmp_dir, "c.csv")
    with open(p, "w") as fh:
        fh.write('tag\n#a comment\n"one\n#two\nthree",1\nshort\n"x",2,more,NA\n')
    df = files.read_csv_roles(spark, p, {"text": 0, "predict": 1, "ref": 3}, skip_first=1, comment="#", na_values="NA")
    assert sorted((r["text"], r["predict"], r["ref"]) for r in df.collect()) == [
        ("one\n#two\nthree", 1, None), ("short", None, None), ("x", 2, None)]


@pytest.mark.parametrize("layout", ["lines", "array", "keyed"])
def test_json_layout_is_found_beyond_4096_characters(spark, tmp_dir, layout):
    rows = [{"body": "w " * 5000}, {"body": "b", "ref": "r1"}, {"body": "c", "ref": 7}]
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows, indent=1),
            "keyed": json.dumps({str(i): r for i, r in enumerate(rows)})}[layout]
    p = os.path.join(tmp_dir, "x.json")
    with open(p, "w") as fh:
        fh.write(text)
    assert files.json_layout(spark, p) == layout
    got = sorted((r["text"], r["ref"]) for r in files.read_json_roles(spark, p, {"text": "body", "ref": "ref"}).collect())
    assert got == [("b", "r1"), ("c", "7"), ("w " * 5000, None)]


def test_single_json_line_stays_a_line(spark, tmp_dir):
    p = os.path.join(tmp_dir, "one.json")
    with open(p, "w") as fh:
        fh.write(json.dumps({"body": "x" * 9000, "ref": "a"}) + "\n")
    assert files.json_layout(spark, p) == "lines"


def test_npy_blob_fallbacks(spark):
    from corpusgrove.sources.python_sources import decode_npy, encode_npy
    blobs = [encode_npy([1.0, 2.0]), b"12", b"1.5", b"raw", b"", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary")
    got = {r["i"]: r["v"] for r in df.select("i", decode_npy("b").alias("v")).collect()}
    assert got == {0: [1.0, 2.0], 1: [12.0], 2: [1.5], 3: None, 4: None, 5: None}


def test_rows_are_numbered_file_by_file(spark, tmp_path):
    """The second file is the largest, so Spark reads it first."""
    from corpusgrove.sources import files
    for name, n in (("a", 3), ("b", 4000), ("c", 2)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i},x\n" for i in range(n)))
    got = files.load_dataset(spark, None, str(tmp_path), "csv", {"text": 0}).select("row_id", "text").orderBy("row_id").collect()
    assert [r["text"] for r in got] == [f"{n}{i}" for n, k in (("a", 3), ("b", 4000), ("c", 2)) for i in range(k)]


def test_json_folders(spark, tmp_path):
    from corpusgrove.sources import files
    (tmp_path / "k").mkdir()
    (tmp_path / "k/1.json").write_text('{"7": {"text": "a"}}')
    (tmp_path / "k/2.json").write_text('{"8": {"text": "b"}, "9": {"text": "c"}}')
    (tmp_path / "l").mkdir()
    (tmp_path / "l/1.json").write_text('{"text": "a"}\n{"text": "b"}')
    (tmp_path / "l/2.json").write_text('{"text": "c"}')
    assert files.json_layout(spark, str(tmp_path / "k")) == "keyed" and files.json_layout(spark, str(tmp_path / "l")) == "lines"
    for folder in ("k", "l"):
        got = files.load_dataset(spark, None, str(tmp_path / folder), "json", {"text": "text"})
        assert [r["text"] for r in got.orderBy("row_id").collect()] == ["a", "b", "c"]
