"""Plain Python or NumPy versions of the learned operators, the licence templates and
every pipeline stage, on whole small tables."""
import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgrove.llm import decontaminate, langid, licenses, packing, quality, tokens
from corpusgrove.llm.util import drawn, held_out

from .conftest import LOWER, words
from .test_operators import brute_components, brute_lines, texts

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 7
def plain_ngrams(text):
    """Hash columns of all 1- to 3-grams, read one by one: blanks stand for runs of other
    characters, and a text has an edge before its first and behind its last character."""
    c = ["^", *[x if x.isalpha() else " " for x in (text or "").replace("\0", " ").lower()], "^"]
    out = []
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            g = c[i:i + n]
            blank = [not x.isalpha() for x in g]
            if all(blank) or any(p and q for p, q in zip(blank, blank[1:])) or n == 3 and g[1] == "^":
                continue
            h = n
            for x in g:
                h = (h * 0x9E3779B97F4A7C15 + (0 if x == "^" else 32 if x == " " else ord(x))) % (1 << 64)
            out.append(h)
    mixed = tokens.mix(np.array(out, np.uint64)) if out else np.zeros(0, np.uint64)
    return [int(h) * langid.DIMS >> 64 for h in mixed]


def plain_bayes(train):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in train:
        counts[lang].update(plain_ngrams(text))
    table = {}
    for lang, c in counts.items():
        total = sum(c.values()) + langid.SMOOTHING * langid.DIMS
        table[lang] = (collections.defaultdict(lambda t=total: math.log(langid.SMOOTHING / t), {k: math.log((v + langid.SMOOTHING) / total) for k, v in c.items()}))
    langs = sorted(table)

    def predict(text):
        cols = plain_ngrams(text)
        if not any(x.isalpha() for x in (text or "").lower()) or not langs:
            return "und", 0.0
        share = min(1.0, langid.EVIDENCE / len(cols))
        totals = [share * sum(table[k][c] for c in cols) for k in langs]
        best = max(range(len(langs)), key=totals.__getitem__)
        return langs[best], 1 / sum(math.exp(t - totals[best]) for t in totals)
    return predict


def test_language_equals_a_plain_naive_bayes(docs, edges):
    model = langid.fit(docs.where(held_out("doc_id", 5) != 0))
    predict = plain_bayes([(r["lang"], r["text"]) for r in docs.collect() if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5])
    both = docs.select("doc_id", "text").unionByName(edges.select((F.coalesce("doc_id", F.lit(99)) + 500_000).alias("doc_id"), "text"))
    got = collections.defaultdict(set)
    for r in model.predict(both).collect():
        got[r["doc_id"]].add((r["lang_pred"], round(r["score"], 4)))
    for r in both.collect():
        lang, score = predict(r["text"])
        assert any(g[0] == lang and abs(g[1] - score) < 1e-3 for g in got[r["doc_id"]]), (r["doc_id"], lang, score, got[r["doc_id"]])


# ---------------------------------------------------------------- 6
def plain_statistics(text):
    text = text or ""
    w, n = words(text), max(1, len(words(text)))
    chars = max(1, sum(x not in " \t\n\v\f\r" for x in text))
    keys = [k for k in (x.strip(" \t\n\v\f\r").translate(LOWER) for x in text.split("\n")) if k]
    of = lambda signs: sum(x in signs for x in text)
    symbols = "#*$%&|<>{}[]=+_~^\\@"
    shout = sum(sum("A" <= x <= "Z" for x in v) > 1 and not any("a" <= x <= "z" for x in v) for v in w)
    return [math.log1p(len(w)), math.log1p(len(keys)), min(chars / n, 40), math.sqrt(of(symbols) / chars), math.sqrt(of("!") / chars), math.sqrt(of("|") / chars),
            sum("A" <= x <= "Z" for x in text) / chars, math.sqrt(of("0123456789") / chars), sum(ord(x) > 127 for x in text) / chars, min(len(set(w)) / n, 1),
            sum(p == q for p, q in zip(w, w[1:])) / n, (len(keys) - len(set(keys))) / max(1, len(keys)), sum(v[-1] in symbols for v in w) / n, shout / n,
            math.sqrt(of(".,;:!?") / chars)]


def least_squares_steps(y, weight):
    """The isotonic fit by its min-max formula."""
    n = len(y)
    mean = [[np.average(y[i:j + 1], weights=weight[i:j + 1]) if j >= i else np.inf for j in range(n)] for i in range(n)]
    return np.array([max(min(mean[i][j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


def test_quality_equals_normal_equations_in_numpy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(held_out("doc_id", 4) != 2)
    got = {r["doc_id"]: r["score"] for r in quality.fit(docs, labels).score(docs).collect()}
    ids, stats = zip(*[(r["doc_id"], plain_statistics(r["text"])) for r in docs.collect()])
    stats = dict(zip(ids, np.array(stats)))
    picked, _, rate = drawn(labels, "quality", "doc_id", {0: quality.MAX_TRAIN_DOCS // 2, 1: quality.MAX_TRAIN_DOCS // 2}, 6)
    rows = [(r["doc_id"], r["y"], r["h"] % 5) for r in picked.collect() if r["doc_id"] in stats]
    s, y, part = np.array([stats[d] for d, _, _ in rows]), np.array([v for _, v, _ in rows], float), np.array([p for _, _, p in rows])
    mean, scale = s.mean(0), s.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(s.shape[1], quality.FEATURES)) / math.sqrt(s.shape[1])
    phase = rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(x):
        z = np.clip((x - mean) / scale, -8, 8)
        return np.column_stack([np.ones(len(z)), math.sqrt(2 / quality.FEATURES) * np.cos(z @ w + phase)])

    f = features(s[part > 0])
    penalty = np.diag([1e-6] + [quality.RIDGE] * quality.FEATURES)
    beta = np.linalg.solve(f.T @ f + penalty, f.T @ y[part > 0])
    x, v = features(s[part == 0]) @ beta, y[part == 0]
    order = np.argsort(x, kind="stable")
    x, v = x[order], v[order]
    weight = np.where(v > 0, 1 / rate[1], 1 / rate[0])
    fit = least_squares_steps(v, weight)
    cuts = np.flatnonzero(np.concatenate([[True], np.abs(np.diff(fit)) > 1e-12, [True]]))
    blocks = list(zip(cuts[:-1], cuts[1:]))
    knots = [np.average(x[a:b], weights=weight[a:b]) for a, b in blocks]
    for d, row in stats.items():
        want = np.clip(np.interp(features(row[None])[0] @ beta, knots, [fit[a] for a, _ in blocks]), 0, 1)
        assert got[d] == pytest.approx(want, abs=1e-6), d


# ---------------------------------------------------------------- 8
def template_pattern(template):
    out = []
    for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template.translate(LOWER)):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part.startswith("{{"):
            out.append(r"(?:\S+ ){0,%s}" % part[2:-2])
        else:
            out += [re.escape(x) + " " for x in licence_words(part)]
    return re.compile(r"(?<!\S)" + "".join(out))


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_templates_equal_regular_expressions(spark, docs):
    rng = np.random.default_rng(8)
    rows = list(texts(docs).items())
    for k, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts):
        for v in range(8):
            # optional parts in or out, replaceable ones with as many words as may stand there, or one too many
            full = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", t)
            full = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(["thing"] * int(rng.integers(0, int(m[1]) + 2))), full)
            w = full.split()
            if v % 4 == 3:  # a mandatory word is lost, doubled or changed
                i = int(rng.integers(0, len(w)))
                w[i:i + 1] = [[], [w[i], w[i]], ["other"]][int(rng.integers(0, 3))]
            rows.append((1_000_000 + 100 * k + v, "see the notice. " + " ".join(w).upper() + " and so on"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    patterns = [(template_pattern(t), label) for label, ts in licenses.TEMPLATES.items() for t in ts]
    with_template = 0
    for d, t in rows:
        line = "".join(x + " " for x in licence_words(t))
        base = {label for p, label in licenses.PHRASES.items() if " " + p + " " in " " + line}
        more = {label for p, label in patterns if p.search(line)}
        with_template += bool(more)
        assert got[d] == (",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0), (d, t)
    assert 50 < with_template < len(rows) - 20


# ---------------------------------------------------------------- pipeline
def plain_language_id(rows, spark):
    predict = plain_bayes([(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5])
    out = []
    for r in rows:
        lang, score = predict(r["text"])
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            out.append(tuple(r))
    return out


def plain_line_dedup(rows, spark):
    kept = brute_lines({r["doc_id"]: r["text"] for r in rows})
    return [(r["doc_id"], kept[r["doc_id"]][2], r["lang"], r["source"], len(kept[r["doc_id"]][2])) for r in rows]


def plain_near_dedup(rows, spark):
    found = brute_components({r["doc_id"]: r["text"] for r in rows})
    return [tuple(r) for r in rows if found[r["doc_id"]][2]]


def plain_decontamination(rows, spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [(decontaminate._one(t).tolist(), decontaminate._answer(t)) for t in items]
    out = []
    for r in rows:
        w = decontaminate._one(r["text"] or "").tolist()
        held = set(w)

        def holds(a, answer):
            m = len(a)
            if not m or 2 * sum(x in held for x in a) < m:  # no window can keep half of the words
                return False
            marks = decontaminate._marks(a)
            for s in range(max(1, len(w) - 2 * m + 1)):
                part = w[s:s + 2 * m]
                if 2 * sum((collections.Counter(a) & collections.Counter(part)).values()) < m:
                    continue
                share = decontaminate.lcs(a, part, marks) / m
                if share >= 0.75 or share >= 0.5 and decontaminate.lcs(answer, part) / len(answer) >= 0.8:
                    return True
            return False

        if not any(holds(a, answer) for a, answer in items):
            out.append(tuple(r))
    return out


def plain_packing(rows, spark):
    """What each document's pieces must add up to."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    return {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END_ID] for r in rows}


def test_every_stage_equals_its_plain_version(spark, docs):
    """Each stage on what the one before kept; the last by an exact round trip."""
    plain = {"language_id": plain_language_id, "line_dedup": plain_line_dedup, "near_dedup": plain_near_dedup, "decontamination": plain_decontamination}
    extra = [(900_001, "1234 5678", None, "s", 9), (900_002, "", "en", "s", 0)]  # no letter: language ID lets them go
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    extra.append((900_003, "some words before it " + bench + " and some after it", "en", "s", 0))
    at = docs.select(*corpus_pipeline.COLUMNS).where("doc_id is not null").unionByName(spark.createDataFrame(extra, docs.select(*corpus_pipeline.COLUMNS).schema))
    lost = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = at.collect()
        out = corpus_pipeline.materialize(stage(spark, at, SF))
        got, want = [tuple(r) for r in out.select(*corpus_pipeline.COLUMNS).collect()], plain[name](rows, spark)
        assert sorted(got, key=str) == sorted(want, key=str), name
        lost[name] = {r["doc_id"] for r in rows} - {r[0] for r in got}
        at = out
    assert {900_001, 900_002} <= lost["language_id"] and lost["near_dedup"] and 900_003 in lost["decontamination"]
    want, pieces = plain_packing(at.collect(), spark), collections.defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, at, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        here = 0
        for start, length, crc in sorted(pieces[d]):
            assert start == here and crc == zlib.crc32(np.array(ids[here:here + length], "<u4").tobytes())
            here += length
        assert here == len(ids)
