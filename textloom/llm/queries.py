"""The queries of this subpackage, by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lines, minhash, packing, pieces, prefix_trie, quality_model, quality_rules, radix, secrets, suffix, tokens
from ._common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with base counts, spans and verdicts. Null texts count as empty."""
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices that documents contain."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates by two-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exact or edited."""
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates, dropped from all documents but the first; what is left as a digest."""
    return lines.drop_template_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under 50-byte strings of earlier documents, removed; what is left as a digest."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy pieces of all documents."""
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels of those that are not held out."""
    return quality_model.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances from the language and the verdict of all documents."""
    return quality_rules.judge_quality(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of power-of-two length, each a sequence of its own."""
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each anchor and positive; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return radix.mine_hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another."""
    turns, lengths, scratch = prefix_trie.rebuilt_conversations(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(turns, lengths, scratch)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces all documents have, and digests of their ids and of what these decode to."""
    out = pieces.encode_pieces(read(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_licenses, op3_near_duplicates, op4_decontamination, op5_line_dedup, op6_suffix_dedup, op7_token_counts, op8_quality_classifier, op9_quality_rules, op10_packing, op11_hard_negatives, op12_prefix_trie, op13_sentencepiece)
}


def _licenses_sql() -> str:
    quoted = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    cut = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    each = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))"
    return f"""
WITH t AS (SELECT * FROM (VALUES {quoted}) v(template, license, text)),
tw AS (SELECT template, license, {cut.format('text')} AS w FROM t),
ts AS (SELECT template, license, len({each}) AS n_template, unnest({each}) AS s FROM tw),
dw AS (SELECT row_number() OVER () AS r, doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT r, doc_id, unnest({each}) AS s FROM dw WHERE len(w) > 0),
m AS (SELECT r, doc_id, template, license, n_template, count(*) AS n_matched FROM ds JOIN ts USING (s) GROUP BY ALL)
SELECT doc_id, template, license, n_matched, n_template FROM m WHERE 100 * n_matched >= 80 * n_template"""


_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
m AS (SELECT r, doc_id, k, line, string_split(trim(regexp_replace(regexp_replace(' ' || line, '([\s])[^\s0-9@]*[0-9@][^\s]*', '\1<*>', 'g'), '[ \t\r\f\x0b]+', ' ', 'g')), ' ') AS t, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) = '' AS blank FROM l),
h AS (SELECT *, len(t) AS n, ((len(t) - 2) // 2)::INT AS half, len(list_filter(t, lambda x: x <> '<*>')) AS c FROM m WHERE NOT blank),
halves AS (SELECT r, doc_id, k, n, '1:' AS kind, t[1:2+half] AS part FROM h WHERE n >= 12 UNION ALL SELECT r, doc_id, k, n, '2:', list_concat(t[1:2], t[3+half:]) FROM h WHERE n >= 12),
keys AS (
  SELECT r, doc_id, k, CASE WHEN 4 * c >= n THEN '0:' || n || ':' || array_to_string(t, ' ') ELSE '3:' || line END AS key, n > 50 AS long FROM h
  UNION ALL SELECT r, doc_id, k, kind || n || ':' || array_to_string(part, ' '), FALSE FROM halves WHERE 4 * len(list_filter(part, lambda x: x <> '<*>')) >= len(part)
  UNION ALL SELECT r, doc_id, k, '0:' || n || ':' || array_to_string(list_concat(list_concat(t[1:p-1], ['<*>']), t[p+1:]), ' '), FALSE FROM (SELECT *, unnest(list_filter(range(1, n + 1), lambda p: t[p] <> '<*>')) AS p FROM h WHERE n < 12 AND c > 4)),
rec AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END),
gone AS (SELECT DISTINCT r, k FROM keys JOIN rec USING (key) WHERE doc_id <> first)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, md5(coalesce(string_agg(CASE WHEN g.k IS NULL THEN line END, chr(10) ORDER BY l.k), '')) AS kept_md5
FROM l LEFT JOIN gone g ON l.r = g.r AND l.k = g.k GROUP BY l.r"""

# crc32 bit by bit: a byte goes in, then eight shifts.
_TRIE_SQL = r"""
WITH n AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, k, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM n),
o AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(steps, lambda x: x::BIGINT)), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h FROM o),
c AS (SELECT h.*, least(h.h, coalesce(p.n, 0)) AS taken FROM h LEFT JOIN (SELECT conv_id AS base, n FROM h) p USING (base)),
s AS (
  SELECT conv_id, pos AS depth, k, b FROM c JOIN (SELECT conv_id AS base, pos, k, b FROM t) x USING (base) WHERE pos <= taken
  UNION ALL SELECT conv_id, pos - h + taken, k, b FROM c JOIN t USING (conv_id) WHERE pos > h),
q AS (SELECT c.conv_id, coalesce(ks, []) AS ks, coalesce(bs, []) AS bs FROM c LEFT JOIN (SELECT conv_id, list(k ORDER BY depth) AS ks, list(b ORDER BY depth) AS bs FROM s GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, ks, bs, unnest(range(0, len(ks) + 1)) AS d FROM q),
g AS (SELECT d, ks[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(bs[d]) END * (count(*) - 1) AS own, coalesce(string_agg(CASE WHEN len(ks) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY d, p),
k AS (SELECT p[1:d-1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
u AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p)),
a AS (SELECT p[1:e] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM u) GROUP BY 1)
SELECT u.conv_id, u.d AS depth, v.conv_id AS parent_conv_id, u.n_convs, u.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN a USING (p) LEFT JOIN g v ON u.d > 0 AND v.p = u.p[1:u.d-1]"""

_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same AND a <> b),
n AS (SELECT a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s USING (a) WHERE p.r <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS "rank", n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""

ORACLES: dict[str, str] = {"op2_licenses": _licenses_sql(), "op5_line_dedup": _LINES_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_prefix_trie": _TRIE_SQL}
