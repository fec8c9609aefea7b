"""The operators applied to the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlloom.llm import context_tree, decontaminate, language_id, license_scan, line_dedup, mixing, ngram_join, quality, vantage_point, warc
from urlloom.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no", "position")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = language_id.predict(docs, language_id.train_profiles(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered_rates(docs))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))


def op8_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_point.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 10, 0)
    found = context_tree.score(docs, docs.filter(~out))
    return found.withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 5, 0)
    labels = _table(spark, sf_dir, "labels").filter(~out)
    found = quality.train_and_score(_table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_license_scan": op2_license_scan,
    "op3_rank_order_language_id": op3_rank_order_language_id,
    "op4_spaced_seed_decontamination": op4_spaced_seed_decontamination,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_vantage_point_neighbours": op8_vantage_point_neighbours,
    "op9_context_tree_weighting": op9_context_tree_weighting,
    "op10_fourier_quality": op10_fourier_quality,
}

_OP5_SQL = f"""
WITH sizes AS (
  SELECT source, greatest(sum(coalesce(strlen(text), 0))::BIGINT, 1) AS size FROM {{docs}} GROUP BY source
), totals AS (
  SELECT sum(size)::BIGINT AS all_size, sum(pow(size::DOUBLE, {mixing.TEMPERATURE})) AS all_power FROM sizes
), rates AS (
  SELECT source, pow(size::DOUBLE, {mixing.TEMPERATURE}) / all_power * all_size / size AS rate FROM sizes, totals
), drawn AS (
  SELECT d.*, r.rate,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM {{docs}} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT *, len(list_filter(
    list_transform(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT), lambda k:
      list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1))))),
    lambda c: c <= u)) AS copies
  FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM counted
"""

_OP7_SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS row_no, *, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{docs}}
), keyed AS (
  SELECT *, list_transform(lines, lambda l: nullif(trim(l, ' ' || chr(9) || chr(13)), '')) AS line_keys FROM pages
), hosts AS (
  SELECT source, count(*) AS host_pages FROM pages GROUP BY source
), counts AS (
  SELECT source, line_key, count(*) AS line_pages
  FROM (SELECT source, unnest(list_distinct(line_keys)) AS line_key FROM keyed) GROUP BY ALL
), flagged AS (
  SELECT c.source, list(line_key) AS drop_keys
  FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE line_key IS NOT NULL AND line_pages > 1 AND line_pages > {line_dedup.RATIO}::DOUBLE * host_pages
  GROUP BY c.source
), cut AS (
  SELECT k.*, list_filter(lines, lambda l, i: line_keys[i] IS NULL OR NOT list_contains(coalesce(drop_keys, []), line_keys[i])) AS kept
  FROM keyed k LEFT JOIN flagged f ON k.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text, lang, source, n_chars,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END::BIGINT AS n_dropped
FROM cut
"""

_OP6_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM {{docs}}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {ngram_join.SHINGLE} + 2), lambda i: array_to_string(w[i : i + {ngram_join.SHINGLE} - 1], ' '))) END AS s
  FROM worded
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {ngram_join.PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM {{docs}} UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), roots AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id FROM sets s JOIN roots r ON s.doc_id = r.u
"""

_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {vectors}
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) AS length FROM v
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(c.e, q.e), lambda z: z[1] * z[2]), lambda s, x: s + x) / (c.length * q.length) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

_OP1_SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {pages}
), d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(h, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INTEGER) % 32 + 1, 1)), '') AS payload_digest,
    regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)) AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to, url_key, captured, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS capture_no,
       row_number() OVER (ORDER BY url_key, captured, page_id) AS position
FROM k
"""

#: CRC-32 of an id's digits, bit by bit: each byte is followed by eight steps.
_CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)"""

_OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce({_CRC32_SQL} % 4 = 2, false) AS held_out,
         lower(' ' || trim(regexp_replace(text, '[^\\p{{{{L}}}}]+', ' ', 'g')) || ' ') AS t
  FROM {{docs}}
), points AS (
  SELECT row_no, list_transform(string_split(t, ''), lambda ch: unicode(ch)::BIGINT) AS c FROM docs WHERE length(t) > 2
), windowed AS (
  SELECT row_no, unnest(list_zip(c, c[2:], c[3:])) AS z FROM points
), grams AS (
  SELECT row_no, z[1] AS g FROM windowed WHERE z[1] <> 32
  UNION ALL SELECT row_no, z[1] * 2097152 + z[2] FROM windowed WHERE z[2] IS NOT NULL
  UNION ALL SELECT row_no, (z[1] * 2097152 + z[2]) * 2097152 + z[3] FROM windowed WHERE z[3] IS NOT NULL AND z[2] <> 32
), counted AS (
  SELECT row_no, g, count(*) AS n FROM grams GROUP BY ALL
), own AS (
  SELECT row_no, g, row_number() OVER (PARTITION BY row_no ORDER BY n DESC, g) AS r FROM counted QUALIFY r <= {language_id.PROFILE}
), trained AS (
  SELECT lang, g, sum(n) AS n FROM counted JOIN docs USING (row_no) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL
), profiles AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r FROM trained QUALIFY r <= {language_id.PROFILE}
), sums AS (
  SELECT o.row_no, l.lang, sum(coalesce(abs(p.r - o.r), {language_id.PROFILE}))::DOUBLE AS away
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = o.g GROUP BY ALL
), best AS (
  SELECT row_no, lang, away, lead(away) OVER (PARTITION BY row_no ORDER BY away, lang) AS second
  FROM sums QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY away, lang) = 1
)
SELECT doc_id, held_out, coalesce(b.lang, '{language_id.UNKNOWN}') AS lang_pred,
       CASE WHEN b.lang IS NULL THEN 0 WHEN second IS NULL THEN 1 WHEN second = 0 THEN 0.5 ELSE 1 - 0.5::DOUBLE * away / second END::DOUBLE AS score
FROM docs d LEFT JOIN best b USING (row_no)
"""

#: Lays every item over every document along each diagonal with enough equal words; no seeds.
_OP4_SQL = f"""
WITH split AS (
  SELECT true AS is_doc, doc_id AS id, row_number() OVER () AS row_no, text FROM {{docs}}
  UNION ALL SELECT false, item_id, row_number() OVER (), text FROM {{items}}
), worded AS (
  SELECT is_doc, id, row_no, list_filter(list_transform(string_split_regex(lower(text), '[\\s\\p{{{{Z}}}}\\x0B\\x1C-\\x1F\\x85]+'),
    lambda x: trim(x, '{{edges}}')), lambda x: x <> '') AS w
  FROM split
), words AS (
  SELECT is_doc, id, row_no, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM worded
), equal AS (
  SELECT d.id AS doc_id, d.row_no AS doc_row, i.id AS item_id, i.row_no AS item_row, i.n, d.pos, d.pos - i.pos AS shift
  FROM words d JOIN words i ON d.is_doc AND NOT i.is_doc AND d.word = i.word
), needed AS (
  SELECT *, least({decontaminate.MIN_MATCHED}, (4 * n + 4) // 5) AS least_matched FROM equal
), laid AS (
  SELECT * FROM needed QUALIFY count(*) OVER (PARTITION BY doc_row, item_row, shift) >= least_matched
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_row, item_row, shift ORDER BY pos) AS k FROM laid
), stretches AS (
  SELECT a.doc_id, a.item_id, a.item_row, a.pos AS start, a.pos - a.shift AS item_start, b.pos - a.pos + 1 AS words, b.k - a.k + 1 AS matched
  FROM numbered a JOIN numbered b ON a.doc_row = b.doc_row AND a.item_row = b.item_row AND a.shift = b.shift AND a.k <= b.k
  WHERE b.k - a.k + 1 >= a.least_matched AND 5 * (b.k - a.k + 1) >= 4 * (b.pos - a.pos + 1)
)
SELECT doc_id, item_id, start::BIGINT AS start, item_start::BIGINT AS item_start, words::BIGINT AS words, matched::BIGINT AS matched
FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id, item_row ORDER BY matched DESC, words, start, item_start) = 1
"""

ORACLE_SQL = {
    "op1_warc_index_merge": _OP1_SQL.format(pages="pages"),
    "op3_rank_order_language_id": _OP3_SQL.format(docs="documents"),
    "op4_spaced_seed_decontamination": _OP4_SQL.format(docs="documents", items="benchmark", edges=decontaminate.EDGES.replace("'", "''")),
    "op5_poisson_mixing": _OP5_SQL.format(docs="documents"),
    "op6_ngram_jaccard_join": _OP6_SQL.format(docs="documents"),
    "op8_vantage_point_neighbours": _OP8_SQL.format(vectors="embeddings"),
    "op7_line_dedup": _OP7_SQL.format(docs="documents"),
}
