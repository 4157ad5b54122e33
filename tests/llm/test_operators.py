"""The numbered operators against brute force on whole small tables."""
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrove.llm import (components, decontaminate, host_rules, langid, licenses, line_dedup, near_dedup, packing, quality, substring_dedup,
                             tokens, toxicity)
from corpusgrove.llm.util import held_out

from .conftest import LOWER, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}


# ---------------------------------------------------------------- 1
def brute_windows(rows, k):
    split = {d: words(t) for d, t in rows.items()}
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - k + 1):
            first.setdefault(tuple(split[d][i:i + k]), d)
    out = {}
    for d, w in split.items():
        gone = {p for i in range(len(w) - k + 1) if first[tuple(w[i:i + k])] < d for p in range(i, i + k)}
        out[d] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("k", [50, 5])
def test_substring_dedup_equals_brute_force(docs, k):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs, window=k).collect()}
    assert got == brute_windows(texts(docs), k)


def test_sketch_never_undercounts(docs):
    """With very few counters everything is suspected, and the result is the same."""
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs, window=8, depth=1).collect()}
    assert got == {d: v[1] for d, v in brute_windows(texts(docs), 8).items()}


# ---------------------------------------------------------------- 2, 6, 7: held-out accuracy
def test_classifiers_hold_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.fit(docs, labels.where(held_out("doc_id", 5) != 0))
    t = m.score(docs).join(labels, "doc_id").where(held_out("doc_id", 5) == 0)
    r = t.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.5).cast("int"))), F.avg(F.when(F.col("toxic") == 0, (F.col("score") >= 0.5).cast("int")))).first()
    assert r[0] > 0.8 and r[1] < 0.02
    m = quality.fit(docs, labels.where(held_out("doc_id", 4) != 2))
    q = m.score(docs).join(labels, "doc_id").where(held_out("doc_id", 4) == 2)
    assert q.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.97
    m = langid.fit(docs.where(held_out("doc_id", 5) != 0))
    p = m.predict(docs, carry=("lang",)).where(held_out("doc_id", 5) == 0)
    assert p.agg(F.avg((F.col("lang_pred") == F.col("rest.lang")).cast("int"))).first()[0] > 0.98


def test_grammar_scores_clauses():
    run = toxicity.clause_weights
    kind = lambda s, w: dict(zip(toxicity.KINDS, run(s.split(), w)))
    assert kind("other insult", [0, 2.0])["bare"] == 2
    assert kind("insult other target", [2.0, 0, 0])["targeted"] == 2
    assert kind("target negation insult", [0, 0, 2.0])["negated"] == 2
    assert kind("negation other other other other insult", [0, 0, 0, 0, 0, 2.0])["bare"] == 2
    assert kind("report other insult target", [0, 0, 2.0, 0])["reported"] == 2
    assert kind("target threat", [0, 3.0])["threat"] == 3


def test_isotonic_is_monotone_and_least_squares():
    x, y = quality.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert list(y) == [0, 0.5, 1] and list(x) == [1, 2.5, 4]


# ---------------------------------------------------------------- 3
def test_host_rules_equal_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert sorted(map(tuple, host_rules.host_rules(docs).collect())) == sorted(con.execute(host_rules.ORACLE_SQL).fetchall())


def test_bad_host_is_rejected_and_small_one_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(50)] + [(100, good, "bad"), (101, "short", "tiny")] + [(200 + i, good, f"ok{i % 3}") for i in range(90)]
    got = {r["doc_id"]: r["kept"] for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100] is False and got[200] and all(got[200 + i] for i in range(90))
    hosts = {r["host"]: r for r in host_rules.host_verdicts(spark.createDataFrame([(f"h{i % 9}" if i < 900 else "tiny", i % 10 == 0 or i >= 900) for i in range(901)], "host string, failed boolean")).collect()}
    assert not hosts["tiny"]["host_failed"]  # one failure of one is not enough
    # one document per host, one in ten fails: that is chance, not hosts that differ
    alone = host_rules.host_verdicts(spark.createDataFrame([(str(i), i % 10 == 0) for i in range(1000)], "host string, failed boolean"))
    assert alone.where("host_failed").count() == 0 and alone.agg(F.max("rate")).first()[0] < 0.12


# ---------------------------------------------------------------- 4
def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = collections.defaultdict(set)
    split = {d: (t or "").split("\n") for d, t in rows.items()}
    for d, ls in split.items():
        for x in ls:
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    out = {}
    for d, ls in split.items():
        kept = [x for x in ls if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def test_one_id_with_two_texts(spark):
    """Each row loses its own lines, and a line of both counts once for the id."""
    a, b = "the first line that repeats", "the second line that repeats"
    rows = [(1, f"{a}\nkeep me please, I am unique"), (1, f"x\ny\n{b}\nanother line that is unique"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}"), (1, None), (1, f"{a}\nkeep me please, I am unique")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 0, ""), (1, 2, 1, "keep me please, I am unique"), (1, 2, 1, "keep me please, I am unique"), (1, 4, 1, "x\ny\nanother line that is unique"), (2, 2, 2, ""), (3, 2, 0, f"{a}\n{b}")]


def test_filters_change_in_touched_shards_only(spark):
    make = lambda ids: spark.createDataFrame([(i, f"a line of enough length, number {i}") for i in ids], "doc_id long, text string")
    data = lambda ix: {r["shard"]: bytes(r["data"]) for r in ix.filters.collect()}
    keys = lambda ix: {(r["shard"], r["k1"]) for r in ix.counts.collect()}
    one = line_dedup.LineIndex.empty(spark, 64).insert(make(range(300))).settled()
    two = one.insert(make([1000])).settled()
    (shard, key), = keys(two) - keys(one)
    before, after = data(one), data(two)
    assert {s for s in after if after[s] != before.get(s)} == {shard}
    assert line_dedup.CuckooFilter.from_bytes(after[shard]).contains(np.array([key]).view(np.uint64)).all()
    assert len(after[shard]) == len(before[shard])  # the stored filter took the key; none was built
    three = two.delete(spark.createDataFrame([(1000,)], "doc_id long")).settled()
    assert keys(three) == keys(one) and {s for s in after if data(three)[s] != after[s]} == {shard}
    assert sum(np.count_nonzero(np.frombuffer(d, np.uint16)) for d in data(three).values()) == 300
    # filters that are full are built anew, and lose nothing
    many = one.insert(make(range(300, 3000))).settled()
    assert all(line_dedup.CuckooFilter.from_bytes(d).contains(np.array([k for s2, k in keys(many) if s2 == s]).view(np.uint64)).all() for s, d in data(many).items())


def test_line_dedup_equals_brute_force(docs, edges):
    rows = docs.unionByName(edges.where("doc_id >= 10").withColumn("doc_id", F.col("doc_id") + 100_000).select(docs.columns))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_dedup(rows).collect()}
    assert got == brute_lines(texts(rows))


def test_line_index_deletes_documents_again(spark, docs):
    even = docs.where("doc_id % 2 = 0")
    index = line_dedup.LineIndex.empty(spark, 4).insert(even).insert(docs.where("doc_id % 2 = 1"))
    back = index.delete(docs.where("doc_id % 2 = 1"))
    fresh = line_dedup.LineIndex.empty(spark, 4).insert(even)
    cols = ["k1", "k2", "n_docs", "max_doc"]
    assert sorted(map(tuple, back.counts.select(cols).collect())) == sorted(map(tuple, fresh.counts.select(cols).collect()))
    assert {r["doc_id"]: tuple(r)[1:] for r in back.apply(even).collect()} == brute_lines(texts(even))


def test_cuckoo_filter_keeps_every_key_and_forgets_deleted_ones():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    f = line_dedup.CuckooFilter.from_bytes(line_dedup.CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


# ---------------------------------------------------------------- 5
def test_decontamination_finds_planted_and_paraphrased_items(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    w = item["text"].split()
    filler = docs.where("length(text) > 800").first()["text"].split()[:100]
    plant = lambda x: " ".join(filler[:50] + x + filler[50:])
    changed = [x if k % 8 else "changed" for k, x in enumerate(w)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(900_001, plant(w)), (900_002, plant(changed)), (900_003, " ".join(filler)), (900_004, plant(w).upper())], "doc_id long, text string"))
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(rows, bench).collect()}
    assert {(900_001, item["item_id"]), (900_002, item["item_id"]), (900_004, item["item_id"])} <= hits
    # brute force: documents that hold a whole item word by word, and no others but the paraphrase
    norm = lambda t: " " + " ".join(__import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) + " "
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in rows.collect() for i, t in items if t in norm(r["text"])}
    assert want <= hits and hits - want == {(900_002, item["item_id"])}


def test_decontamination_equals_brute_force_on_short_long_and_paraphrased_items(spark, docs):
    """All windows of twice the item's length, for items of 3 to 600 words, whole or with 50 to 75 % of the words kept."""
    rng = np.random.default_rng(3)
    bench = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    pool = " ".join(r["text"] for r in docs.where("length(text) > 800").orderBy("doc_id").limit(30).collect()).split()
    draw = lambda n: [pool[i] for i in rng.integers(0, len(pool), n)]
    items = bench + [" ".join(draw(n)) for n in (3, 4, 5, 6, 8, 10, 100, 200, 300, 400, 600)]
    rows = []
    for t in items:
        for keep in (1.0, 0.75, 0.65, 0.55):
            w = t.split()
            lost = set(rng.permutation(len(w))[:round(len(w) * (1 - keep))].tolist())
            other = draw(len(w))
            rows.append(" ".join(draw(60) + [other[i] if i in lost else x for i, x in enumerate(w)] + draw(60)))
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"),
                                                                                 spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    split, want = [decontaminate._one(t).tolist() for t in rows], set()
    for i, t in enumerate(items):
        a, answer = decontaminate._one(t).tolist(), decontaminate._answer(t)
        marks, m = decontaminate._marks(a), len(a)
        for d, w in enumerate(split):
            for s in range(max(1, len(w) - 2 * m + 1)):
                if len(marks.keys() & set(w[s:s + 2 * m])) < 2:
                    continue
                share = decontaminate.lcs(a, w[s:s + 2 * m], marks) / m
                if share >= 0.75 or share >= 0.5 and decontaminate.lcs(answer, w[s:s + 2 * m]) / len(answer) >= 0.8:
                    want.add((d, i))
                    break
    assert len(want) >= 2 * len(items) and hits == want


def test_decontamination_draws_rows_without_ids_and_copies_one_by_one(spark):
    rows = [(None, f"text {i}") for i in range(2_000)] + [(None, "the same")] * 2_000 + [(7, "again")] * 2_000
    for share in (0.05, 0.2, 0.5):
        n = decontaminate._drawn(spark.createDataFrame(rows, "doc_id long, text string"), share).count()
        assert abs(n - share * 2_002) < 0.25 * share * 2_002


def test_decontamination_fits_its_space_on_every_passage_of_all_documents(spark, monkeypatch):
    rng, got, fit = np.random.default_rng(4), [], decontaminate.fit_space
    monkeypatch.setattr(decontaminate, "fit_space", lambda counted, *a, **k: got.append(counted) or fit(counted, *a, **k))
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('word', id % 50, ' text', id % 7) as text")
    items = spark.createDataFrame([(1, "word1 text1 word2")], "item_id long, text string")
    decontaminate.find_contaminated(docs, items)
    assert got[0].where("columns is not null").count() == 12_001

    rows = ["", "one", " ".join(f"w{x}" for x in rng.integers(0, 40, 150)), "two two one", "two two one", None] + [" ".join(f"w{x}" for x in rng.integers(0, 400, 64)) for _ in range(30)]
    counted = decontaminate._counted(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))
    split = [decontaminate._column(decontaminate._one(t or "")) for t in rows]
    df = np.zeros(decontaminate.COLUMNS, int)
    for c in split:
        df[np.unique(c)] += 1
    assert (decontaminate.document_frequency(counted) == df).all()
    a = np.array([np.bincount(c[k:k + 64], minlength=decontaminate.COLUMNS) for c in split for k in range(0, len(c), 64)]) * (idf := rng.random(decontaminate.COLUMNS) + 0.1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    m = rng.normal(size=(decontaminate.COLUMNS, 5))
    for transposed, want in ((True, a.T @ (a @ m)), (False, (a @ m).T @ (a @ m))):
        assert np.allclose(decontaminate._summed(counted, idf, m, transposed), want, rtol=1e-4, atol=1e-4)


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 17).tolist()
        t = [[0] * 18 for _ in range(13)]
        for i in range(12):
            for j in range(17):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[12][17]


# ---------------------------------------------------------------- 8
def test_licence_base_equals_brute_force(docs):
    import re
    got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scan(docs).collect()}
    for d, t in texts(docs).items():
        w, at, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            at += hits
            found |= {label} if hits else set()
        assert got[d] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))


def test_template_markup(spark):
    t = {"x": ["Alpha beta [[gamma]] {{2}} delta"]}
    rows = [(1, "alpha, BETA delta"), (2, "alpha beta gamma one two delta"), (3, "alpha beta one two three delta"), (4, "alpha gamma beta delta"), (5, "alpha beta gamma")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}, t).collect()}
    assert got == {1: "x", 2: "x", 3: "", 4: "", 5: ""}
    with pytest.raises(ValueError):
        licenses.Automaton("{{3}} alpha")


# ---------------------------------------------------------------- 9
def test_packing_is_an_exact_round_trip(docs, edges):
    from tokenizers import Tokenizer
    rows = docs.select("doc_id", "text").unionByName(edges.where("doc_id in (1, 2, 3, 4, 8, 9)").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4") for d, t in texts(rows).items()}
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(rows).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded < 0.05 * total


# ---------------------------------------------------------------- 10
def brute_components(rows):
    sets = {}
    for d, t in rows.items():
        w = words((t or "").translate(LOWER))
        sets[d] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates_equal_brute_force(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(texts(docs))


def test_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    """A chain of near copies and strangers around it, in tiles much smaller than the group."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(1, 16)), replace=False):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- kernels
def test_words_and_hashes():
    import pyarrow as pa
    rows = ["", None, " a  b\n", "É x", "a", "b" * 300]
    buf, off = tokens.flat(pa.array(rows))
    starts, ends, first = tokens.words(buf, off)
    raw = buf.tobytes()
    assert [[raw[s:e].decode() for s, e in zip(starts[a:z], ends[a:z])] for a, z in zip(first[:-1], first[1:])] == [words(r) for r in rows]
    h = tokens.span_hash(buf, starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 5


# ---------------------------------------------------------------- 2, read by plain Python
def plain_words(clause):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+(?:'[0-9a-z\x80-\U0010ffff]+)*", clause)


def brute_features(text, lexicon):
    """Clause weights by rules over positions, without transducers."""
    plain = (text or "").lower().translate(str.maketrans(toxicity.MARKS))
    total = dict.fromkeys(toxicity.KINDS, 0.0)

    def symbol(word):
        hits = [lexicon.words[word]] if word in lexicon.words else []
        hits += [v for s, v in lexicon.stems.items() if len(word.encode()) > len(s.encode()) and word.startswith(s)]
        return max(((w, k) for k, w in hits), default=(0.0, "other"))

    for clause in re.split(r"[.,;:!?\n]", plain):
        seen = [symbol(w) for w in plain_words(clause)]
        kinds = [k for _, k in seen]
        for i, (w, k) in enumerate(seen):
            if k not in ("insult", "threat"):
                continue
            before = kinds[max(0, i - toxicity.REACH):i]
            if k == "insult" and "intense" in before:
                w *= toxicity.INTENSIFIED
            if k == "threat" and "modal" in before:
                w *= toxicity.ANNOUNCED
            out = "targeted" if k == "insult" and "target" in kinds else "bare" if k == "insult" else "threat"
            if "report" in kinds[:i]:
                out = "reported"
            elif "negation" in before:
                out = "negated"
            elif out == "threat" and "target" not in kinds:
                w *= 0.5
            total[out] += w
    return [total[k] for k in toxicity.KINDS]


TYPOGRAPHIC = ["you “idiot”", "'idiot' you", "YOU – IDIOT…such an idiot", "ты ДУРАК", "isn’t an idiot", "¡idiota! I will kill you", "you idiot’", "’idiot",
               "he said: idiot", "he said idiot you", "they will never kill you", "not a b c d idiot", "you idiot,kill", "", None, "'", "''", "a'", "'a"]


def test_features_equal_a_plain_reader(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    learned = toxicity.fit(docs, labels)
    lexicon = toxicity._Lexicon({**learned.lexicon.words, "idiot": ("insult", 2.0), "дурак": ("insult", 2.5), "ты": ("target", 0.0)},
                                {**learned.lexicon.stems, "idio": ("insult", 1.5)})
    model = toxicity.ToxicityModel(lexicon, toxicity.PRIOR)
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(TYPOGRAPHIC)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: [r[k] for k in toxicity.KINDS] for r in model.score(rows).collect()}
    assert got.keys() == text.keys()
    for d, t in text.items():
        assert got[d] == pytest.approx(brute_features(t, lexicon)), t
    by = {t: dict(zip(toxicity.KINDS, got[10**9 + i])) for i, t in enumerate(TYPOGRAPHIC)}
    assert by["you “idiot”"]["targeted"] == 2 and by["ты ДУРАК"]["targeted"] == 2.5 and by["isn’t an idiot"]["negated"] == 2
    assert by["¡idiota! I will kill you"]["threat"] == 4.5


def test_threats_are_learned_from_what_follows_a_modal(spark):
    rows = [(i, "i will zorgle all of it" if i % 4 == 0 else "plain words of a clean text") for i in range(400)]
    docs = spark.createDataFrame([(i, t + (" you snorf" if i % 4 == 0 else "")) for i, t in rows], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    words = toxicity.fit(docs, labels).lexicon.words
    assert words["zorgle"][0] == "threat" and words["snorf"][0] == "insult"


# ---------------------------------------------------------------- 1 and 10: ids and signatures
def test_rows_without_id_keep_their_words_outside_of_blocks(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text)] * 50 + [(None, None), (3, text), (7, text)], "doc_id long, text string")
    got = substring_dedup.substring_dedup(df)
    assert got.where("doc_id is null and n_words = 80 and n_removed = 0").where(F.col("kept_text") == text).count() == 50
    assert got.where("doc_id is null and n_words = 0 and kept_text = ''").count() == 1
    assert {r["doc_id"]: r["n_removed"] for r in got.where("doc_id is not null").collect()} == {3: 0, 7: 80}


def test_shadow_never_rejects_within_the_signature_distance():
    assert near_dedup.SHADOW_LIMIT == near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
