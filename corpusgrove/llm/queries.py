"""Registered queries of the numbered operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, embedding_dedup, host_rules, langid, lexical_search, licenses, line_dedup, near_dedup, packing, prefix_trie, quality,
               substring_dedup, toxicity)
from .util import held_out, load


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _training(spark: SparkSession, sf_dir: str, m: int, apart: int) -> DataFrame:
    return load(spark, sf_dir, "labels").where(held_out("doc_id", m) != apart)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = toxicity.fit(docs, _training(spark, sf_dir, 5, 0)).score(docs)
    return out.select("doc_id", (held_out("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *toxicity.KINDS)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = quality.fit(docs, _training(spark, sf_dir, 4, 2)).score(docs)
    return out.select("doc_id", (held_out("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = langid.fit(docs.where(held_out("doc_id", 5) != 0)).predict(docs)
    return out.select("doc_id", (held_out("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(load(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_host_rules, op4_line_dedup, op5_decontamination, op6_quality,
                                   op7_language, op8_licenses, op9_packing, op10_near_dedup, op11_prefix_trie, op12_lexical_search, op13_embedding_dedup)}

_SPACE = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op1_substring_dedup": rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(win)) AS m FROM g) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits) GROUP BY doc_id
), pos AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), cut AS (
  SELECT doc_id, unnest(ps) AS p FROM gone
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op3_host_rules": host_rules.ORACLE_SQL,
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.doc_id, k.p, k.line, (r.keeper IS NOT NULL AND r.keeper <> k.doc_id) AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
""",
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 1)
  UNION ALL SELECT doc_id, words[1] FROM w WHERE len(words) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), e AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON reach.r = e.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, (d.doc_id = min(r)) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
""",
    "op11_prefix_trie": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM k
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM t
), bits AS (
  SELECT i::BIGINT AS v, i AS n, 0 AS step FROM range(256) r(i)
  UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n, step + 1 FROM bits WHERE step < 8
), tab AS (
  SELECT n, v FROM bits WHERE step = 8
), crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS v FROM c
  UNION ALL SELECT conv_id, s, i + 1, xor(crc.v >> 8, tab.v) FROM crc JOIN tab ON tab.n = xor(crc.v, ascii(substr(s, i, 1))) & 255 WHERE i <= length(s)
), h AS (
  SELECT conv_id, base, xor(v, 4294967295) % 9 AS h FROM crc JOIN c USING (conv_id) WHERE i = length(s) + 1
), r AS (
  SELECT h.conv_id, t.pos, t.k, t.b FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, t.k, t.b FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h
), p AS (
  SELECT conv_id, b, row_number() OVER w AS d, string_agg(k, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM h
), q AS (
  SELECT conv_id, b, d, md5(path) AS path FROM p
), e AS (
  SELECT q.*, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM q
), node AS (
  SELECT d, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY d, path
), kids AS (
  SELECT d - 1 AS d, up AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
), under AS (
  SELECT DISTINCT a.d, a.path, b.d AS d2, b.path AS path2 FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.d <= b.d
), sums AS (
  SELECT under.d, under.path, sum((kids.n IS NULL)::INT) AS n_leaves, sum((node.n_convs - 1) * node.b) AS saved
  FROM under JOIN node ON node.d = d2 AND node.path = path2 LEFT JOIN kids ON kids.d = d2 AND kids.path = path2 GROUP BY 1, 2
)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN sums USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN node up ON up.d = node.d - 1 AND up.path = node.up
""",
    "op12_lexical_search": r"""
WITH t AS (
  SELECT doc_id, unnest(terms) AS term, len(terms) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), f AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM t GROUP BY doc_id, term
), s AS (
  SELECT count(DISTINCT doc_id)::BIGINT AS nd, count(*)::BIGINT AS l FROM t
), d AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, nd
), r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN d USING (term), s GROUP BY item_id, doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT * FROM k WHERE rank <= 10
""",
    "op13_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), e AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT vec_id, vec_id AS r FROM v
  UNION SELECT reach.vec_id, e.y FROM reach JOIN e ON reach.r = e.x
), n AS (
  SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x
)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r) AS component_id, (vec_id = min(r)) AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
""",
}
