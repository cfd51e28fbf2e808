"""The registered queries of the text operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.llm.chat import format_report
from flowmine.llm.common import table
from flowmine.llm.language_model import score_report
from flowmine.llm.licenses import TEMPLATES, scan
from flowmine.llm.lines import dedup_report
from flowmine.llm.mixing import mix_report
from flowmine.llm.quality import quality_report
from flowmine.llm.ranked import search
from flowmine.llm.sentencepieces import encode
from flowmine.llm.substrings import removal_report
from flowmine.llm.vectors import near_duplicate_vectors
from flowmine.llm.warc import archive_report
from flowmine.llm.whitening import whitening_report
from flowmine.llm.simhash import near_duplicates
from flowmine.llm.registry import QUERIES, SQL, query  # noqa: F401

W = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM hits) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS letter_words,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i-1])) AS run_words,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
c AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM m),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15
       OR n_dup_lines * 10 > n_lines * 3 OR letter_words * 10 < n_words * 7 OR run_words * 10 > n_words * 3) AS kept
FROM b
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and the cascade's verdict for every document."""
    return quality_report(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM later)),
gone_list AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone_list.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone_list USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window of 20 words, for every document."""
    return removal_report(table(spark, sf_dir, "documents")).drop("intervals")


MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS size, md5('17:' || doc_id) AS key
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    2 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, coalesce(least(CAST(cap AS DOUBLE),
    (max(level) FILTER (cap > level * weight) OVER ()) * weight), CAST(cap AS DOUBLE)) AS target FROM l),
g AS (
  SELECT *, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) // greatest(source_size, 1) AS epochs,
    CAST(floor(target + 0.5::DOUBLE) AS BIGINT) % greatest(source_size, 1) AS rest FROM t),
p AS (
  SELECT d.*, g.source_size, g.target, g.epochs, g.rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""


@query("op3_source_mix", MIXING_SQL)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    return mix_report(table(spark, sf_dir, "documents"))


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and next best segmentations of every document, and whether decoding gives the text back."""
    return encode(table(spark, sf_dir, "documents"))


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word unigram and subword lattice scores of every document."""
    return score_report(table(spark, sf_dir, "documents"))


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(comp.m, vec_id)) AS component_id,
  vec_id <= coalesce(comp.m, vec_id) AS kept
FROM embeddings LEFT JOIN deg ON vec_id = deg.a LEFT JOIN comp ON vec_id = comp.a
"""


@query("op9_embedding_near_dedup", VECTOR_SQL)
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


@query("op8_chat_format", CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), trap.alias("text"))
    return format_report(turns.unionByName(extra))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    ((strpos('0123456789abcdef', h[5 * i // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', h[5 * i // 4 + 2]) - 1)
    // [8, 4, 2, 1][5 * i % 4 + 1]) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return archive_report(table(spark, sf_dir, "pages"))

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
LICENSE_SQL = rf"""
WITH t AS (
  SELECT name, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM (VALUES {_TEMPLATE_ROWS}) v(name, text)),
ts AS (
  SELECT DISTINCT name, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT name, string_split(s, ' ') AS w, unnest(range(1, len(string_split(s, ' ')) - 3)) AS i FROM t)),
d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM documents),
ds AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, string_split(s, ' ') AS w, unnest(range(1, len(string_split(s, ' ')) - 3)) AS i FROM d)),
n AS (SELECT name, count(*) AS n FROM ts GROUP BY name)
SELECT doc_id, name AS license, CAST(count(DISTINCT g) AS DOUBLE) / CAST(any_value(n) AS DOUBLE) AS containment,
  CAST(min(i) - 1 AS BIGINT) AS first_word, CAST(max(i) + 3 AS BIGINT) AS last_word
FROM ds JOIN ts USING (g) JOIN n USING (name)
GROUP BY doc_id, name HAVING CAST(count(DISTINCT g) AS DOUBLE) / CAST(any_value(n) AS DOUBLE) >= 0.8::DOUBLE
"""


@query("op4_license_scan", LICENSE_SQL)
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices that documents contain."""
    return scan(table(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM s),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
twice AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, twice.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN twice ON k.key = twice.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op11_line_dedup", LINE_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to an earlier one."""
    return dedup_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS tokens FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (
  SELECT doc_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tokens))) AS impact
  FROM tf JOIN df USING (term), n),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query("op12_ranked_search", RANKED_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 strongest components of its table, scaled to unit variance."""
    return whitening_report(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
