"""Operator 3: quality rules by document and by host, in DataFrame functions only.

Each document is measured by row-local expressions (no shuffle of texts). A
document fails a rule if it has fewer than 50 words, more than half of its words
repeat, more than one symbol per ``SYMBOL_WORDS`` words, or a third of its lines
or more are duplicates. Failures are summed by host (``source``), with
partial sums first, so a host with a third of all rows is one row per task. The rates are
shrunk with a beta prior fitted to the hosts by moments. The variance of the rates is in
part the chance of few documents: with rate m and n documents it is m * (1 - m) *
(1 / n + (1 - 1 / n) * r), where r = 1 / (strength + 1) is what the hosts themselves differ
by. So hosts that differ no more than chance would have it get the strongest prior. A host fails if its shrunk rate is above ``HOST_LIMIT``. The
verdicts are joined back to the measures. Texts take no part in the join.

Null text: no words, so it fails. Null host: no host verdict. Null ids and
repeated rows are judged one by one. With fewer than two hosts the prior is
beta(1, 1). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_WORDS = 2
HOST_LIMIT = 0.6

_SPACE = " \t\n\x0b\x0c\r"


def _n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice."""
    n = F.size(words)
    h = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        # neighbours in hash order are equal
        return F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        return F.aggregate(F.transform(p, lambda x, i: F.when(i < last, F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(3)), F.lit(0), lambda a, b: a + b)

    at = _let(pairs, lambda s: F.array_sort(F.transform(twice(s), lambda e: e["i"])))
    some = _let(h, lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(F.coalesce(some, F.lit(False)), _let(at, covered)).otherwise(0).cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    measures = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                              _n_repeat_words(w).alias("n_repeat_words")))
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), measures.alias("m"), dup.alias("l"),
                        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
            .select("doc_id", "host", "m.n_words", "m.word_chars", "n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.n_lines"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, documents, failures, shrunk rate, verdict."""
    hosts = (measured.where("host is not null").groupBy("host")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k")))
    rate = F.col("k") / F.col("n")
    # three numbers describe the hosts, however many there are
    m, v, n, chance = hosts.agg(F.avg(rate), F.var_pop(rate), F.count(F.lit(1)), F.avg(1 / F.col("n"))).first()
    inner = n >= 2 and 0 < m < 1
    # hosts of one document each tell nothing of how hosts differ
    r = (v / (m * (1 - m)) - chance) / (1 - chance) if inner and chance < 1 else 0.0
    strength = (max(1.0, min(1000.0, 1 / r - 1)) if r > 0 else 1000.0) if inner else 2.0
    a = (m if inner else 0.5) * strength
    return hosts.withColumn("rate", (F.col("k") + a) / (F.col("n") + strength)).withColumn("host_failed", F.col("rate") > limit)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    failed = base | (SYMBOL_WORDS * F.col("n_symbols") > F.col("n_words")) | ((3 * F.col("n_dup_lines") >= F.col("n_lines")) & (F.col("n_dup_lines") > 0))
    measured = materialize(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base).withColumn("failed", failed))
    verdicts = host_verdicts(measured, limit).select("host", "host_failed")
    return measured.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), base AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM w
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id
), m AS (
  SELECT b.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM base b LEFT JOIN rep r USING (doc_id)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
), g AS (
  SELECT *, (base_failed OR 2 * n_symbols > n_words OR (3 * n_dup_lines >= n_lines AND n_dup_lines > 0)) AS failed FROM f
), hosts AS (
  SELECT source, count(*) AS n, sum(failed::INT) AS k FROM g WHERE source IS NOT NULL GROUP BY source
), mo AS (
  SELECT avg(k / n) AS m, coalesce(var_pop(k / n), 0) AS v, avg(1 / n) AS chance, count(*) AS hosts FROM hosts
), differ AS (
  SELECT *, (hosts >= 2 AND m > 0 AND m < 1) AS inside, CASE WHEN hosts >= 2 AND m > 0 AND m < 1 AND chance < 1 THEN (v / (m * (1 - m)) - chance) / (1 - chance) ELSE 0 END AS r FROM mo
), prior AS (
  SELECT CASE WHEN NOT coalesce(inside, false) THEN 2.0 WHEN r > 0 THEN greatest(1.0, least(1000.0, 1 / r - 1)) ELSE 1000.0 END AS s,
         CASE WHEN coalesce(inside, false) THEN m ELSE 0.5 END AS c FROM differ
), bad AS (
  SELECT source FROM hosts, prior WHERE (k + c * s) / (n + s) > 0.6
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad))) AS kept
FROM g
"""
