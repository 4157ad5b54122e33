"""Operator 2: toxicity by a weighted finite-state pattern grammar.

A text is lower-cased (Unicode), typographic marks become ASCII ones (``MARKS``),
and it is read clause by clause (clauses end at ``. , ; : ! ?`` and line breaks).
Learning and scoring cut words by the same rule. Every word becomes a symbol:
insult, threat, target, negation, report, intensifier, modal, or other. Five
weighted transducers rewrite the symbols and are composed to one machine: insult
raises the weight after an intensifier, threat raises it after a modal ("will"),
negation turns a following insult or threat into a negated one, reported speech
marks the rest of the clause as quoted, and target joins an insult with the person
addressed earlier in the clause (one addressed later is seen at the clause's end).
The machine emits what a clause holds. A text's score is a logistic function
of the summed weights by kind, so a negated or quoted insult counts less than
one aimed at somebody.

The lexicon (whole words, and stems of ``STEMS`` characters for longer words) is
learned from labelled rows: a bounded sample (``max_train_docs``, by a hash of the id)
gives document frequencies in toxic and clean texts, and entries with strong
log odds become weighted, all of them. An entry that mostly follows a modal in toxic
texts is a threat, any other an insult. Function words of the grammar and a first
list of threats are fixed values. The logistic weights start from ``PRIOR`` and move
as far as the labels support.

Null or empty text: no clause, the score of the bias alone. Without labels of
both kinds the lexicon is empty and only threats match. Null ids, ties and
repeated rows are scored one by one; long texts are read whole. Columns other than
id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, drawn, materialize

MAX_TRAIN_DOCS = 20_000
STEMS = (4, 5, 6)
#: likelihood ratio (G squared) that an entry needs; a chance one among millions of entries stays below
MIN_EVIDENCE = 30.0
MIN_LOG_ODDS = 2.0

# Function words of the grammar in English, German, French, Spanish.
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta vous votre usted tú ti tus".split()
NEGATIONS = "not no never isn't aren't wasn't don't without nicht kein keine nie ne pas jamais aucun sin nunca ni".split()
REPORTS = "said says say called calls wrote quoted quote claimed told allegedly sagte schrieb nannte dit appelé écrit dijo escribió llamó".split()
THREATS = "kill hurt destroy murder stab shoot attack töten umbringen schlagen tuer frapper matar golpear".split()

INTENSIFIERS = "such so total complete utter absolute absoluter völliger totaler so ein tellement espèce vrai tan completo".split()
MODALS = "will gonna going shall should must i'll we'll werde werden wird soll sollte vais va allons dois voy vamos debe".split()
_MODAL = frozenset(MODALS)

KINDS = ("bare", "targeted", "threat", "negated", "reported")
#: bias and weight by kind before any label was seen
PRIOR = np.array([-3.0, 2.0, 3.0, 2.0, 0.3, 0.4])
#: words after a negation, intensifier or modal that it reaches, when nothing ends the clause
REACH = 3
#: factors of the weight of an insult after an intensifier, of a threat after a modal
INTENSIFIED, ANNOUNCED = 1.25, 1.5


class Transducer:
    """Weighted finite-state machine: arcs[(state, symbol)] = (next state, output, factor).
    A symbol without an arc is passed on with factor 1, to the state given by ``rest``."""

    def __init__(self, start, arcs: dict, rest: dict | None = None):
        self.start, self.arcs, self.rest = start, arcs, rest or {}

    def step(self, state, symbol):
        got = self.arcs.get((state, symbol))
        return got if got is not None else (self.rest.get(state, state), symbol, 1.0)

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: the outputs of this machine are the inputs of ``after``, factors multiply."""
        return _Composed(self, after)

    def run(self, symbols):
        state = self.start
        for s in symbols:
            state, out, factor = self.step(state, s)
            yield out, factor


class _Composed(Transducer):
    def __init__(self, a: Transducer, b: Transducer):
        super().__init__((a.start, b.start), {})
        self.a, self.b = a, b

    def step(self, state, symbol):
        key = (state, symbol)
        got = self.arcs.get(key)
        if got is None:  # arcs of the product are made when first met
            x, mid, f = self.a.step(state[0], symbol)
            y, out, g = self.b.step(state[1], mid)
            got = self.arcs[key] = ((x, y), out, f * g)
        return got


def _within_reach(opener: str, arcs: dict) -> Transducer:
    """``opener`` opens REACH words in which the arcs given by symbol apply."""
    full = {(k, opener): (REACH, "other", 1.0) for k in range(REACH + 1)}
    for k in range(1, REACH + 1):
        full |= {(k, s): (k - 1, out, factor) for s, (out, factor) in arcs.items()}
    return Transducer(0, full, {k: k - 1 for k in range(1, REACH + 1)})


def grammar() -> Transducer:
    """insult, threat, negation, reported speech and target, composed in this order."""
    insult = _within_reach("intense", {"insult": ("insult", INTENSIFIED)})
    threat = _within_reach("modal", {"threat": ("threat", ANNOUNCED)})
    negation = _within_reach("negation", {"insult": ("negated", 1.0), "threat": ("negated", 1.0)})
    arcs = {(k, "report"): (1, "other", 1.0) for k in (0, 1)}
    arcs |= {(1, s): (1, "reported", 1.0) for s in ("insult", "threat", "negated")}
    reported = Transducer(0, arcs)
    # a target that follows an insult is seen at the clause's end
    arcs = {(s, "target"): (1, "target", 1.0) for s in (0, 1)}
    arcs |= {(1, "insult"): (1, "targeted", 1.0), (0, "insult"): (0, "bare", 1.0)}
    return insult @ threat @ negation @ reported @ Transducer(0, arcs)


_GRAMMAR = grammar()


def clause_weights(symbols: list[str], weights: list[float]) -> np.ndarray:
    """Summed weights of one clause by kind."""
    f = np.zeros(len(KINDS))
    out = list(_GRAMMAR.run(symbols))
    aimed = any(o == "target" for o, _ in out)
    for (o, factor), w in zip(out, weights):
        if o == "bare" and aimed:
            o = "targeted"
        if o == "threat" and not aimed:
            factor *= 0.5
        if o in KINDS:
            f[KINDS.index(o)] += w * factor
    return f


# Typographic marks and what they are read as. Every other character beyond ASCII belongs to a word.
MARKS = {"’": "'", "‘": "'", "ʼ": "'", "…": ".", "。": ".", "．": ".", "！": "!", "？": "?", "，": ",", "、": ",", "；": ";", "：": ":"}
MARKS |= dict.fromkeys("“”„‟«»‹›‚–—―‐‑‒−•·¡¿§©®°×÷（）「」『』【】《》\u00a0\u2002\u2003\u2009\u200b\u202f\u3000\ufeff", " ")


def plain(text: str | Column) -> Column:
    """The text as learning and scoring read it: Unicode lower case, typographic marks as ASCII."""
    return F.translate(F.lower(text), "".join(MARKS), "".join(MARKS.values()))


# letters, digits and every byte of a longer character
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n")] = True


def _words(x: np.ndarray, off: np.ndarray):
    """Words of each row of plain text; an apostrophe belongs to a word between two of its letters."""
    inside = _WORD[x]
    joint = np.zeros(len(x), bool)
    if len(x) > 2:
        joint[1:-1] = (x[1:-1] == 39) & inside[:-2] & inside[2:]
    joint[off[:-1][off[:-1] < len(x)]] = False
    joint[off[1:][off[1:] > 0] - 1] = False
    return T.runs(inside | joint, off)


@dataclass(frozen=True)
class _Lexicon:
    """Hash tables of words and byte stems with their symbol and weight."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, tuple[str, float]]

    def tables(self):
        by_len: dict[int, list] = {0: [(w, *v) for w, v in self.words.items()]}
        for s, v in self.stems.items():
            by_len.setdefault(len(s.encode()), []).append((s, *v))
        out = []
        for n, rows in sorted(by_len.items()):
            raw = [r[0].encode() for r in rows]
            off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            buf = np.frombuffer(b"".join(raw), np.uint8)
            h = T.span_hash(buf, off[:-1], off[1:]) if rows else np.zeros(0, np.uint64)
            o = np.argsort(h)
            out.append((n, h[o], [rows[k][1] for k in o], np.array([rows[k][2] for k in o], float)))
        return out


def _features(x, off, tables):
    """Kind weights of each row of plain text."""
    n_rows = len(off) - 1
    f = np.zeros((n_rows, len(KINDS)))
    starts, ends, first = _words(x, off)
    if not len(starts):
        return f
    hit_at, hit_symbol, hit_weight = [], [], []
    for n, h, symbols, weights in tables:
        if not len(h):
            continue
        if n:
            at = np.flatnonzero(ends - starts > n)
            got = T.span_hash(x, starts[at], starts[at] + n)
        else:
            at, got = np.arange(len(starts)), T.span_hash(x, starts, ends)
        seen = np.zeros(1 << 16, bool)
        seen[(h >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(got >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(h, got[maybe])
        k[k == len(h)] = 0
        ok = h[k] == got[maybe]
        hit_at.append(at[maybe[ok]])
        hit_symbol.extend(symbols[j] for j in k[ok])
        hit_weight.append(weights[k[ok]])
    at, weight = np.concatenate(hit_at), np.concatenate(hit_weight)
    found: dict[int, tuple[str, float]] = {}
    for a, s, w in zip(at.tolist(), hit_symbol, weight.tolist()):
        old = found.get(a)
        # a learned entry goes before a function word, the heavier before the lighter
        if old is None or (w, s) > (old[1], old[0]):
            found[a] = (s, w)
    # clauses: words between breaks of one row
    row = T.owner(first)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[x])])
    clause = breaks[starts]
    for a in sorted(k for k, v in found.items() if v[0] in ("insult", "threat")):
        if found[a][0] == "done":
            continue
        lo = hi = a
        while lo > 0 and row[lo - 1] == row[a] and clause[lo - 1] == clause[a]:
            lo -= 1
        while hi + 1 < len(row) and row[hi + 1] == row[a] and clause[hi + 1] == clause[a]:
            hi += 1
        part = [found.get(k, ("other", 0.0)) for k in range(lo, hi + 1)]
        f[row[a]] += clause_weights([p[0] for p in part], [p[1] for p in part])
        for k in range(a, hi + 1):
            if k in found and found[k][0] in ("insult", "threat"):
                found[k] = ("done", 0.0)
    return f


def _feature_rows(b: pa.RecordBatch, tables) -> np.ndarray:
    buf, off = T.flat(b.column(1))
    f = [np.zeros((0, len(KINDS)))]
    for i, j in T.slices(off):
        f.append(_features(buf[off[i]:off[j]], off[i:j + 1] - off[i], tables))
    return np.concatenate(f)


_DF = "entry string, toxic long, clean long, announced long"


def _entries(word: str) -> list[str]:
    """The word and its stems (marked ``*``) as lexicon entries."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def _document_frequency(b: pa.RecordBatch):
    """Documents by entry: toxic, clean, and toxic ones where a modal stands at most REACH words before."""
    toxic, clean, announced = Counter(), Counter(), Counter()
    buf, off = T.flat(b.column(0))
    labels = b.column(1).to_pylist()
    for i, j in T.slices(off):
        x, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        starts, ends, first = _words(x, o)
        raw = x.tobytes()
        for r in range(j - i):
            words = [raw[s:e].decode() for s, e in zip(starts[first[r]:first[r + 1]].tolist(), ends[first[r]:first[r + 1]].tolist())]
            entries = {e for w in set(words) for e in _entries(w)}
            (toxic if labels[i + r] else clean).update(entries)
            if labels[i + r]:
                near = {k + d for k, w in enumerate(words) if w in _MODAL for d in range(1, REACH + 1)}
                announced.update({e for k in near if k < len(words) for e in _entries(words[k])})
    entries = list(toxic.keys() | clean.keys())
    count = lambda c: pa.array([c[e] for e in entries], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), count(toxic), count(clean), count(announced)],
                                     names=["entry", "toxic", "clean", "announced"])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: _Lexicon
    weights: np.ndarray

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: doc_id, score, and the clause weights by kind."""
        sent = docs.sparkSession.sparkContext.broadcast((self.lexicon.tables(), self.weights))

        def run(b: pa.RecordBatch):
            tables, weights = sent.value
            f = _feature_rows(b, tables)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + np.log1p(f) @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), *[pa.array(f[:, k].copy()) for k in range(len(KINDS))]], names=["doc_id", "score", *KINDS])

        return arrow_map(docs.select(F.col(id_col).cast("long"), plain(F.col(text_col).cast("string")).alias("text")), run,
                         "doc_id long, score double, " + ", ".join(f"{k} double" for k in KINDS))


def _logistic(f: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised likelihood; the penalty pulls to the prior."""
    x = np.column_stack([np.ones(len(f)), f])
    w = prior.copy()
    pull = np.array([0.01] + [strength] * (len(prior) - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train_docs: int = MAX_TRAIN_DOCS) -> ToxicityModel:
    """Learns lexicon and weights from at most about ``max_train_docs`` labelled
    rows, drawn by a hash of the id, up to a quarter of them toxic."""
    picked, sizes, rate = drawn(labels, label_col, id_col, {0: max_train_docs * 3 // 4, 1: max_train_docs // 4}, 2)
    # the draw is bounded by max_train_docs, so it may be sent to every task
    sample = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), plain(F.col(text_col).cast("string")).alias("text"))
                         .join(F.broadcast(picked), "doc_id").select("text", "y").repartition(16))
    n1, n0 = sizes.get(1, 0) * rate.get(1, 0.0), sizes.get(0, 0) * rate.get(0, 0.0)
    df = arrow_map(sample, _document_frequency, _DF).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("announced").alias("announced"))
    odds = F.log((F.col("toxic") + 0.5) / max(n1, 1)) - F.log((F.col("clean") + 0.5) / max(n0, 1))
    share = max(n1, 1e-9) / max(n0 + n1, 1e-9)
    both = F.col("toxic") + F.col("clean")
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / both / share)
                    + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both / max(1 - share, 1e-9))).otherwise(0))
    best = (df.withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & (evidence >= MIN_EVIDENCE))
            .orderBy(F.desc("toxic"), "entry").collect())  # as many as the bounded sample bears out
    words, stems = {}, {}
    for r in best:
        kind = "threat" if 2 * r["announced"] >= r["toxic"] else "insult"
        if r["entry"].endswith("*"):
            stems[r["entry"][:-1]] = (kind, r["odds"])
        else:
            words[r["entry"]] = (kind, r["odds"])
    for s in list(stems):  # a shorter stem that is as telling makes a longer one needless
        if any(s[:n] in stems and stems[s[:n]][1] >= stems[s][1] - 1 for n in STEMS if n < len(s)):
            del stems[s]
    for symbol, listed in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("intense", INTENSIFIERS), ("modal", MODALS), ("threat", THREATS)):
        for w in listed:
            words.setdefault(w, (symbol, 3.0 if symbol == "threat" else 0.0))
    lexicon = _Lexicon(words, stems)
    if not n0 or not n1:
        return ToxicityModel(lexicon, PRIOR)
    tables = lexicon.tables()

    def run(b: pa.RecordBatch):
        f = _feature_rows(pa.RecordBatch.from_arrays([b.column(1), b.column(0)], names=["y", "text"]), tables)
        yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.float64()), *[pa.array(f[:, k].copy()) for k in range(len(KINDS))]], names=["y", *KINDS])

    got = arrow_map(sample, run, "y double, " + ", ".join(f"{k} double" for k in KINDS)).toPandas().to_numpy()
    weights = _logistic(np.log1p(got[:, 1:]), got[:, 0], PRIOR)
    # undo the sample's balance: prior odds of the labels as they are
    weights[0] += np.log(sizes[1] / sizes[0]) - np.log(n1 / n0)
    return ToxicityModel(lexicon, weights)
