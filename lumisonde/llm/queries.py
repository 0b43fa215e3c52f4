"""The registered queries of the text operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.llm import dom_extraction, ffd_packing, hamming_topk, hard_negatives, line_winnow, lsm_dedup, maxent_lm, merkle_manifest, pii, piece_lattice, rule_quality, simhash_trie, url_templates
from lumisonde.session import shipped, table

Query = Callable[[SparkSession, str], DataFrame]


#: Rules of the url query, before the tree's verdict.
URL_RULES: list[url_templates.Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@shipped
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages, URL_RULES).drop("url")


@shipped
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_lattice.encode(table(spark, sf_dir, "documents"), vocabulary, digest=True)


@shipped
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~rule_quality.held_out())
    scored = rule_quality.score_with(rule_quality.fit(docs, labels), docs)
    return scored.select("doc_id", rule_quality.held_out().alias("held_out"), "score", (F.col("score") >= rule_quality.KEEP).cast("int").alias("predicted"))


@shipped
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return maxent_lm.score(docs, maxent_lm.fit(docs.where(~maxent_lm.held_out())))


@shipped
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.components(table(spark, sf_dir, "documents"))


@shipped
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_winnow.dedup_lines(docs, count_into="lines_deleted")


@shipped
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@shipped
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@shipped
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.dedup(table(spark, sf_dir, "documents"))


@shipped
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@shipped
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@shipped
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return dom_extraction.extract(pages, dom_extraction.fit(pages))


@shipped
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_urls, op2_pieces, op3_quality, op4_lm_score, op5_simhash, op6_lines, op7_personal_data, op8_top_k, op9_exact_dedup, op10_packing, op11_hard_negatives, op12_main_text, op13_manifest)
}

OP6_SQL = """
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, pos, md5(line) AS lh,
         len(regexp_split_to_array(line, ' +')) AS n
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE text <> '')
  WHERE line <> ''),
b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - n AS s FROM l),
g0 AS (SELECT doc_id, i, s, sum(n) OVER w AS size, list(upper(lh)) OVER w AS g FROM b
       WINDOW w AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING)),
g AS (SELECT doc_id, i, s, md5(array_to_string(g, ',')) AS gram FROM g0 WHERE size >= 25),
m AS (SELECT doc_id, min(gram || lpad(CAST(1000000000 - i AS VARCHAR), 10, '0'))
             OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS x FROM g),
sel AS (SELECT DISTINCT doc_id, 1000000000 - CAST(substr(x, 33) AS BIGINT) AS i, substr(x, 1, 32) AS gram FROM m),
f AS (SELECT gram, doc_id AS fid, i AS fi FROM sel QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) = 1),
seeds AS (SELECT s.doc_id, s.i, f.fid, s.i - f.fi AS diag FROM sel s JOIN f USING (gram) WHERE (s.doc_id, s.i) > (f.fid, f.fi)),
near AS (SELECT DISTINCT doc_id, fid, diag FROM seeds),
eq AS (SELECT n.doc_id, n.fid, n.diag, a.i, a.pos FROM near n
       JOIN l a ON a.doc_id = n.doc_id
       JOIN l o ON o.doc_id = n.fid AND o.i = a.i - n.diag AND o.lh = a.lh),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, fid, diag ORDER BY i) AS run FROM eq),
hit AS (SELECT DISTINCT r.doc_id, r.fid, r.diag, r.run FROM r JOIN seeds s ON s.doc_id = r.doc_id AND s.fid = r.fid AND s.diag = r.diag AND s.i = r.i),
gone AS (SELECT DISTINCT r.doc_id, r.pos FROM r JOIN hit h ON h.doc_id = r.doc_id AND h.fid = r.fid AND h.diag = r.diag AND h.run = r.run),
p AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN p.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, j: NOT list_contains(p.gone, j - 1)), chr(10)) END AS text,
       coalesce(len(p.gone), 0) AS lines_deleted
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.b, e.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance
      FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""

OP11_SQL = """
WITH v AS (
  SELECT DISTINCT ON (vec_id) vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(greatest(least(CAST(x AS DOUBLE) * 256, 16777216), -16777216)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ORDER BY vec_id, label, x),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""

OP13_SQL = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
                lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1]), 4294967295), 4294967295) % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed_text
  FROM documents, bits),
f AS (
  SELECT doc_id, source,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(changed_text) || ':' || changed_text, '-') AS changed_tail
  FROM d),
h AS (SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || changed_tail) AS changed FROM f),
s AS (SELECT source, n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) AS tree, count(*) OVER () AS sources
      FROM (SELECT source, count(*) AS n FROM h GROUP BY source)),
l AS (SELECT h.doc_id, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS pos, s.n, s.sources, h.leaf, h.changed
      FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 16, n),
tops AS (
  SELECT 0 AS level, n.tree - 1 AS pos, s.sources AS n, n.digest FROM nodes n JOIN s ON s.tree = n.tree WHERE n.n = 1
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
low AS (
  SELECT l.tree, l.pos, o.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < o.pos), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > o.pos), '') AS r
  FROM l JOIN nodes o ON o.tree = l.tree AND o.n > 1 AND o.pos = l.pos >> (4 * o.level)
  JOIN nodes x ON x.tree = o.tree AND x.level = o.level AND x.pos >> 4 = o.pos >> 4
  GROUP BY l.tree, l.pos, o.level, o.pos),
high AS (
  SELECT s.tree, o.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < o.pos), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > o.pos), '') AS r
  FROM s JOIN tops o ON o.n > 1 AND o.pos = (s.tree - 1) >> (4 * o.level)
  JOIN tops x ON x.level = o.level AND x.pos >> 4 = o.pos >> 4
  GROUP BY s.tree, o.level, o.pos),
p AS (
  SELECT l.doc_id, l.tree, l.leaf, l.changed, coalesce(a.steps, []) || coalesce(b.steps, []) AS steps
  FROM l
  LEFT JOIN (SELECT tree, pos, list({'l': l, 'r': r} ORDER BY level) AS steps FROM low GROUP BY tree, pos) a ON a.tree = l.tree AND a.pos = l.pos
  LEFT JOIN (SELECT tree, list({'l': l, 'r': r} ORDER BY level) AS steps FROM high GROUP BY tree) b ON b.tree = l.tree),
o AS (
  SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root,
         sha256(array_to_string(list_transform(p.steps, lambda x: x.l || x.r), '')) AS proof_sha256,
         list_reduce(p.steps, lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}, {'l': p.changed, 'r': ''}).l AS folded_root
  FROM p JOIN (SELECT tree, digest FROM nodes WHERE n = 1) t ON t.tree = p.tree, (SELECT digest FROM tops WHERE n = 1) r)
SELECT *, folded_root = root AS verified FROM o
"""

ORACLE: dict[str, str] = {"op8_top_k": OP8_SQL, "op6_lines": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_manifest": OP13_SQL}
