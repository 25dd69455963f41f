"""The queries of the corpus operators over the supplied tables, and their SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import decontaminate, impact_search, katz, language_id, license_scan, line_dedup, mixing, ngram_join, phrases, secret_scan, token_counts, url_filter, vp_search
from dosewise.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"  # a run of its own: nothing is known before
    found = secret_scan.scan_versions(_table(spark, sf_dir, "documents"), ["doc_id"], ledger=ledger)
    return found.select(
        "doc_id",
        *[secret_scan.counted(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(F.col("spans"), ("assign", "access", "hex")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


# Spans of a kind: matches stand between the pieces that they split the text into, so lengths give places, in code points.
OP1_SQL = r"""
WITH kinds(place, kind, pattern, least) AS (VALUES
  (1, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 8),
  (2, 'access', 'AKIA[A-Z0-9]+', 16),
  (3, 'hex', '[0-9a-f]+', 32),
  (4, 'pem', '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0),
  (5, 'forge', 'gh[pousr]_[A-Za-z0-9]+', 40)),
cut AS (
  SELECT doc_id, place, kind, least, regexp_extract_all(t, pattern) AS m, regexp_split_to_array(t, pattern) AS pieces
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) CROSS JOIN kinds WHERE regexp_matches(t, pattern)),
each AS (
  SELECT doc_id, place, kind, least, unnest(m) AS hit, unnest(list_resize(pieces, len(m))) AS piece, generate_subscripts(m, 1) AS i FROM cut),
placed AS (
  SELECT doc_id, place, kind, least, hit, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM each),
spans AS (
  SELECT doc_id, place, kind, stop - length(hit) AS start, stop FROM placed
  WHERE length(CASE kind WHEN 'assign' THEN regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) FILTER (place <= 3), '')) AS base_sha256,
       coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) FILTER (place IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


#: (host, path, verdict)
URL_RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH found AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM found),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
rules(h, p, verdict) AS (VALUES ('com', 'en/', 'block'), ('example.com', 'en/7', 'allow'), ('net', 'de/', 'allow'), ('example.net', 'de/8', 'block'), ('org', 'es/', 'block')),
fits AS (
  SELECT page_id, first(h || '/' || p ORDER BY length(h || '/' || p) DESC) AS rule, first(rules.verdict ORDER BY length(h || '/' || p) DESC) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, '/' || p) GROUP BY page_id, host, path)
SELECT parts.page_id, host, path, rule, coalesce(fits.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))


# Sets as sorted lists of shingles, one of each class; pairs that share a shingle, counted; ids reachable over links.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS s
  FROM words),
classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS (SELECT rep, n, unnest(s) AS g FROM classes),
shared AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM held a JOIN held b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
comps AS (SELECT a AS rep, least(a, min(b)) AS comp FROM reach GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(rep, doc_id) AS class_id, coalesce(comp, rep, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN comps USING (rep)
"""


def op4_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vp_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, tilt=F.sqrt).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = token_counts.TOKENIZER) -> DataFrame:
    """Every document's tokens in the token files of `documents`: its file's number, its place there, where it begins and its count."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    at = token_counts.write_with_places(docs, path, "doc_id", tokenizer=tokenizer)
    found = token_counts.with_columns(token_counts.document_tokens(spark, path, pattern="part-*"), at)
    return found.select("doc_id", "file_no", "ordinal", "start", "n_tokens", "closed")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH held AS (
  SELECT doc_id, w, len(w)::BIGINT AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL)
  WHERE len(w) > 0),
sizes AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


def op12_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, w, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found)),
scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.size = c.k JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.size = c.size - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, phrase, max(a) AS held
  FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM found WHERE size = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM found WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.phrase = best.phrase AND best.size = 2 WHERE held IS NULL OR 100 * held < 50 * a)
SELECT kept.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::INTEGER AS rank FROM kept) kept JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_url_filter": op2_url_filter,
        "op3_ngram_join": op3_ngram_join,
        "op4_vp_search": op4_vp_search,
        "op5_line_dedup": op5_line_dedup,
        "op6_mixing": op6_mixing,
        "op7_token_counts": op7_token_counts,
        "op8_decontaminate": op8_decontaminate,
        "op9_license_scan": op9_license_scan,
        "op10_language_id": op10_language_id,
        "op11_impact_search": op11_impact_search,
        "op12_katz_score": op12_katz_score,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_ngram_join": OP3_SQL, "op11_impact_search": OP11_SQL, "op13_phrases": OP13_SQL}
