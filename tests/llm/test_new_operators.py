"""Operators 11 to 13 against brute force, with hot keys spread over tasks and the defined edge cases."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrove.llm import embedding_dedup, lexical_search, prefix_trie

from .conftest import LOWER

CONV = "conv_id long, turn long, role string, text string, depth long, c long, pid int"


# ---------------------------------------------------------------- 11
def brute_trie(rows, rebuilt=True):
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            own[r[0]].append((r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = collections.defaultdict(list)
    for c, turns in own.items():
        if rebuilt:
            h = zlib.crc32(str(c).encode()) % 9
            turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append((c, d == len(turns)))
    kids = collections.defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out, sums = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        members = nodes[path]
        saved = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        leaves, total = (0 if kids[path] else 1), saved
        for k in kids[path]:
            leaves, total = leaves + sums[k][0], total + sums[k][1]
        sums[path] = leaves, total
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        out[min(members)[0], len(path)] = (min(nodes[path[:-1]])[0] if path else None, len(members), len(kids[path]), leaves, total, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def make(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONV).repartition(parts)


def test_trie_of_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None])) for c in range(-12, 30) if c % 7 for t in range(rng.randint(1, 12))]
    rows += [(7, None, "user", "x"), (7, None, "user", "x"), (12, 3, "bot", "same"), (12, 3, "bot", "same"), (None, 1, "user", "lost"), (2 ** 63 - 1, 0, "user", "far"), (-2 ** 63, 0, "user", "far")]
    assert trie(prefix_trie.rebuilt_trie(make(spark, rows))) == brute_trie(rows)


def test_trie_with_one_conversation_over_many_tasks(spark):
    """A third of the rows in one conversation, many equal conversations, and a chain of 700 nodes."""
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(700)]
    rows += [(c, t, "user", f"hello {t}") for c in range(100, 300) for t in range(3)]
    rows += [(c, 0, "user", f"{c}" * 9) for c in range(400, 700)]
    df = make(spark, rows, 8)
    keys = prefix_trie.materialize(prefix_trie.turn_keys(df))
    assert prefix_trie._scan(keys, ["turn", "md5"]).where("conv_id = 5").agg(F.max("pos"), F.sum(F.col("last").cast("int"))).first() == (700, 1)
    assert trie(prefix_trie.rebuilt_trie(df)) == brute_trie(rows)


def test_trie_edges(spark):
    empty = make(spark, [], 1)
    assert prefix_trie.rebuilt_trie(empty).collect() == []
    only_null = make(spark, [(None, 0, "user", "x")], 1)
    assert prefix_trie.rebuilt_trie(only_null).collect() == []
    rows = [(0, 0, "u", "x" * 500_000), (1, 0, "u", "x" * 500_000)]
    assert trie(prefix_trie.conversation_trie(make(spark, rows))) == brute_trie(rows, rebuilt=False)


def test_subtree_sums(spark):
    """Chains, stars, combs and random trees in one forest."""
    n, rng, rows, want = 150, random.Random(1), [], {}
    shapes = [lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: i - 1 if i % 2 else max(0, i - 2), lambda i: None if i % 50 == 0 else rng.randrange(i - i % 50, i)]
    for k, up in enumerate(shapes):
        parent = [None] + [up(i) for i in range(1, n)]
        sums = np.array([[1, i * i] for i in range(n)])
        for i in range(n - 1, 0, -1):
            if parent[i] is not None:
                sums[parent[i]] += sums[i]
        rows += [(i, k, p, None if p is None else k, 1, i * i) for i, p in enumerate(parent)]
        want |= {(i, k): v for i, v in enumerate(sums.tolist())}
    df = spark.createDataFrame(rows, "c long, d long, pc long, pd long, size long, sq long")
    assert {(r["c"], r["d"]): [r["size"], r["sq"]] for r in prefix_trie.subtree_sums(df, ["size", "sq"]).collect()} == want


# ---------------------------------------------------------------- 12
def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [b for b in bags if b[1]]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    out = []
    for i, want in wanted.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t in want if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_search_equals_brute_force(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = brute_search(rows, items)
    assert found(lexical_search.search(docs.repartition(5), bench)) == want
    assert found(lexical_search.search(docs, bench, max_postings=100)) == want


def test_search_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "the SAME line", 5.0), (1, "enough", 5.0), (2, None, 5.0), (3, "?!", 5.0), (None, "word", 5.0), (4, "É w1x1 a", 5.0)], "item_id long, text string, score double")
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    for k in (1, 2, 10):
        assert found(lexical_search.search(edges, bench, k=k)) == brute_search(rows, items, k)
    assert lexical_search.search(empty, bench).collect() == []
    assert lexical_search.search(edges, bench.where("false")).collect() == []


def test_index_tells_equal_first_hashes_apart():
    h, g, item = (np.array(x) for x in ([5, 5, 5, 9, 9], [1, 2, 2, 7, 7], [0, 0, 1, 1, 2]))
    index = lexical_search.ItemIndex(item, h, g)
    asked = np.array([[5, 2], [5, 3], [9, 7], [9, 8], [5, 1], [4, 1], [10, 1]])
    place, term = index.find(asked[:, 0], lambda p: asked[p, 1])
    assert [(p, index.posting[index.bounds[t]:index.bounds[t + 1]].tolist()) for p, t in zip(place.tolist(), term.tolist())] == [(0, [0, 1]), (2, [1, 2]), (4, [0])]


# ---------------------------------------------------------------- 13
def brute_links(rows, least=0.95):
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, links = len(rows), collections.defaultdict(set)
    for i in range(n):
        for j in range(i):
            (a, v), (b, w) = rows[i], rows[j]
            if a is None or b is None or not fit(v) or not fit(w) or len(v) != len(w):
                continue
            v, w = np.array(v, float), np.array(w, float)
            if v @ w / math.sqrt((v @ v) * (w @ w)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), c, rows[i][0] is None or rows[i][0] == c))
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, key string, pos long").repartition(3)


def joined(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [16, 64])
def test_embedding_join_equals_brute_force(spark, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 12))
    x[40:80] = x[0] + 0.25 * rng.normal(size=(40, 12))  # a family, in part linked
    x[80:140] = x[1]  # copies
    x[140:170] = x[2] * rng.uniform(0.5, 9, size=(30, 1)) + 1e-9 * rng.normal(size=(30, 12))
    rows = [(1000 - 3 * i, v.tolist()) for i, v in enumerate(x)]
    got = embedding_dedup.near_vectors(vectors(spark, rows), block_rows=size, tile=2, fan=2)
    assert joined(got) == brute_links(rows)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [2.0, 4.0]), (7, [-1.0, 2.0]), (8, [1.0, 2.0]),
            (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [1e200, 2e200]), (11, [1e-200, 2e-200]), (12, [-0.0, 5.0]), (13, [0.0, 5.0])]
    rows = [(i, v) for i, v in rows]
    got, want = joined(embedding_dedup.near_vectors(vectors(spark, rows))), brute_links([r for r in rows if r[0] not in (10, 11)])
    ten = {r[0]: r for r in got if r[0] in (10, 11)}
    assert ten[10] == (10, 4, 7, False) and ten[11] == (11, 4, 7, False)  # squares that overflow or vanish still have a direction
    plain = {r for r in want if r[0] not in (7, 8)}
    assert plain <= set(got) and len(got) == len(rows)
    assert [r for r in got if r[0] == 8] == [(8, 4, 7, False)]
    assert embedding_dedup.near_vectors(vectors(spark, rows).where("false")).collect() == []
    assert joined(embedding_dedup.near_vectors(vectors(spark, [(3, [0.0])]))) == [(3, 0, 3, True)]


def test_distant_blocks_are_skipped(spark):
    """Sixteen far groups: most of the block pairs never meet."""
    rng = np.random.default_rng(5)
    centre = np.repeat(np.eye(16), 64, axis=0)
    x = centre + 0.01 * rng.normal(size=centre.shape)
    df = vectors(spark, list(enumerate(x.tolist())))
    classes = embedding_dedup.vector_rows(df).groupBy("key", "vec").agg(F.count(F.lit(1)).alias("n"))
    mean, axes = embedding_dedup.principal_axes(classes, 16, 12)
    eps = math.sqrt(0.1)
    blocks, _ = embedding_dedup._blocks(classes, mean, axes, eps, 32)
    n = embedding_dedup.block_pairs(blocks, 32, eps).count()
    assert 32 <= n < 32 * 33 / 4
    got = embedding_dedup.near_vectors(df, block_rows=32)
    assert got.select("component_id").distinct().count() == 16 and got.where("n_links <> 63").count() == 0
