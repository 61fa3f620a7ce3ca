"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import ann, common, decontam, langid, licenses, negatives, pieces, quality, repair, repeats, secrets, simhash, tokenfiles, urlfilter
from tallywatch.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.similar_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "tokens")
    shards = tokenfiles.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_store(spark, folder, shards)


@query("op6_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in secrets.KINDS), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans")
    )


_URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts),
urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""


@query("op7_url_filter", _URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_NEAREST_SQL = """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op10_nearest_codes", _NEAREST_SQL)
def nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest_codes(rows, rows.where(F.col("vec_id") % 100 == 0), 10).drop("compared")


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_OVERLAP_SQL = f"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at, len(w) AS n FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)),
b AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at, len(w) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) >= 5),
laid AS (
  SELECT doc_id, item_id, d.at - b.at AS shift, b.at AS place, least(13, b.n) AS w, least(b.n, d.n - (d.at - b.at)) AS high
  FROM d JOIN b ON d.word = b.word),
-- Only places with enough agreeing words within 12 places can lie in a window that counts.
dense AS (
  SELECT DISTINCT doc_id, item_id, shift, w, high, place FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY place RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM laid)
  WHERE near >= CASE WHEN w < 13 THEN w ELSE 11 END),
starts AS (
  SELECT DISTINCT doc_id, item_id, shift, w, s FROM (
    SELECT doc_id, item_id, shift, w, high, unnest(range(greatest(place - 12, 0, -shift), place + 1)) AS s FROM dense) WHERE s + w <= high),
counted AS (
  SELECT x.doc_id, x.item_id, x.shift, x.s, x.w, count(*) AS same
  FROM starts x JOIN laid l ON x.doc_id = l.doc_id AND x.item_id = l.item_id AND x.shift = l.shift AND l.place BETWEEN x.s AND x.s + x.w - 1
  GROUP BY ALL)
SELECT doc_id, item_id, min(shift + s)::INTEGER AS first_word, max(shift + s + w)::INTEGER AS end_word, max(same)::INTEGER AS best
FROM counted WHERE same >= CASE WHEN w < 13 THEN w ELSE 11 END GROUP BY doc_id, item_id
"""


@query("op2_benchmark_overlaps", _OVERLAP_SQL)
def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "end_word", "best")


@query("op4_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (common.fold("doc_id", 3) == 1).alias("held_out"))
    models = langid.fit(docs.where("NOT held_out").select("lang", "text"))
    found = common.written(langid.identify(docs, models).drop("text"), "languages")
    limits = found.where("NOT held_out AND lang = lang_pred")
    return langid.calibrated(found, limits).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


@query("op9_quality_scores")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.fold("doc_id", 5) == 0
    model = quality.train(docs.select("doc_id", "text").where(~held_out), labels.where(~held_out))
    return quality.add_scores(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted", "passages", "top_passage")


@query("op3_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    # Written between the two, so that a task has one Python worker at a time.
    coded = common.written(coded.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "piece_ids"), "piece-ids")
    decoded = F.sha2("decoded", 256)
    return pieces.decode(coded, path).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        decoded.alias("decoded_sha256"),
        (decoded == F.col("text_sha256")).alias("same_text"),
    )


@query("op8_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    repaired = repair.repair(repair.damaged(original))
    return repair.digest(original, repaired)


_NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
    list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i]), lambda x, y: x + y)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scores s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


_LICENSE_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_LICENSE_SQL = f"""
WITH templates(label, body) AS (VALUES {", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES)}),
t AS (SELECT row_number() OVER () AS tid, label, list_distinct(w) AS w FROM (SELECT label, {_LICENSE_WORDS.format("body")} AS w FROM templates)),
tw AS (SELECT tid, label, len(w) AS size, unnest(w) AS word FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LICENSE_WORDS.format("text")} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
placed AS (SELECT r, word, unnest([pos // 32, pos // 32 - 1]) AS block FROM dw WHERE word IN (SELECT word FROM tw)),
met AS (
  SELECT r, label, size, block, tid, count(DISTINCT word) AS shared
  FROM placed JOIN tw USING (word) WHERE block >= 0 GROUP BY ALL HAVING count(DISTINCT word) >= ceil(size * {licenses.THRESHOLD} - 1e-9)),
found AS (SELECT r, list(DISTINCT label) AS found, max(shared::DOUBLE / size) AS part FROM met GROUP BY r),
base AS (
  SELECT r, label, pos FROM (
    SELECT r, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM dw WINDOW w AS (PARTITION BY r ORDER BY pos))
  JOIN (VALUES ('cc', 'by', NULL, 'cc-by'), ('general', 'public', 'license', 'gpl'), ('all', 'rights', 'reserved', 'reserved')) p(a, b, c, label)
    ON word = a AND second = b AND (c IS NULL OR third = c)),
places AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""


@query("op13_license_scan", _LICENSE_SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))
