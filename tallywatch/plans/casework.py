"""Queries: case corpus, document jobs, retrieval, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.operators import chunking, corpus, evidence, retrieve
from tallywatch.plans import inputs
from tallywatch.plans.inputs import CTE_DECIDED, CTE_TX
from tallywatch.plans.operations import CTE_LEDGER, _results, ledger
from tallywatch.plans.registry import query, table
from tallywatch.schema import CSV_COLUMNS

_TEXT_COLUMNS = [c for c in CSV_COLUMNS if c != "isFlaggedFraud"]


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction view as all-text CSV rows; the event id is the row ordinal."""
    return inputs.transactions(spark, sf_dir).select(
        *[F.col(c).cast("string").alias(c) for c in _TEXT_COLUMNS], F.col("event_id").alias("source_row_id"))


_DELTA = """CASE WHEN greatest(length(split_part(newbalanceOrig::VARCHAR, '.', 2)), length(split_part(oldbalanceOrg::VARCHAR, '.', 2))) <= 1
  THEN printf('%.1f', round(newbalanceOrig - oldbalanceOrg, 2) + 0.0) ELSE printf('%.2f', round(newbalanceOrig - oldbalanceOrg, 2) + 0.0) END"""
CTE_CASES = CTE_TX + f""", cases AS (SELECT *, CASE WHEN isFraud = 1 THEN 'fraud' ELSE 'normal' END AS label,
  sha256(event_id::VARCHAR) AS h, {_DELTA} AS delta,
  concat('Historical PaySim ', CASE WHEN isFraud = 1 THEN 'Fraud' ELSE 'Normal' END, ' Case', chr(10), 'Step: ', step, chr(10),
  'Transaction type: ', type, chr(10), 'Amount: ', amount, chr(10), 'Origin account: ', nameOrig, chr(10),
  'Origin balance before: ', oldbalanceOrg, chr(10), 'Origin balance after: ', newbalanceOrig, chr(10),
  'Destination account: ', nameDest, chr(10), 'Destination balance before: ', oldbalanceDest, chr(10),
  'Destination balance after: ', newbalanceDest, chr(10), 'Fraud label: ', CASE WHEN isFraud = 1 THEN 'FRAUD' ELSE 'NORMAL' END,
  chr(10), 'Observed transactional characteristics: ', CASE
    WHEN oldbalanceOrg > 0 AND newbalanceOrig = 0 THEN 'Origin account balance was depleted to zero after the transaction.'
    WHEN oldbalanceOrg = 0 AND newbalanceOrig = 0 THEN 'Origin account had zero balance before and after the transaction.'
    WHEN oldbalanceOrg = newbalanceOrig THEN concat('Origin account balance was unchanged at ', oldbalanceOrg, ' before and after the transaction.')
    WHEN newbalanceOrig < oldbalanceOrg THEN concat('Origin account balance decreased from ', oldbalanceOrg, ' to ', newbalanceOrig, '.')
    ELSE concat('Origin account balance increased from ', oldbalanceOrg, ' to ', newbalanceOrig, '.') END,
  chr(10), 'Observed transactional characteristics: ', CASE
    WHEN newbalanceDest > oldbalanceDest THEN concat('Destination account balance increased from ', oldbalanceDest, ' to ', newbalanceDest, '.')
    WHEN newbalanceDest = oldbalanceDest THEN concat('Destination account balance was unchanged at ', oldbalanceDest, '.')
    ELSE concat('Destination account balance decreased from ', oldbalanceDest, ' to ', newbalanceDest, '.') END) AS text FROM tx)"""


@query("case_documents", f"""WITH {CTE_CASES}
SELECT concat('paysim_', label, '_', h) AS document_id, text, label, type AS transaction_type, event_id::VARCHAR AS source_row_id,
  oldbalanceOrg > 0 AND newbalanceOrig = 0 AS origin_balance_depleted, oldbalanceOrg = newbalanceOrig AS origin_balance_unchanged,
  delta AS balance_change_amount, newbalanceDest > oldbalanceDest AS destination_balance_increased FROM cases""")
def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_rows(spark, sf_dir)
    both = corpus.case_documents(corpus.fraud_rows(rows), "fraud").unionByName(
        corpus.case_documents(rows.where(~corpus.is_fraud_row()), "normal"))
    return both.select("document_id", "text", "metadata.label", "metadata.transaction_type", "metadata.source_row_id",
                       "metadata.origin_balance_depleted", "metadata.origin_balance_unchanged",
                       "metadata.balance_change_amount", "metadata.destination_balance_increased")


_DIGEST = "sha256(concat_ws('|', step, type, nameOrig, nameDest, amount, event_id + 1))"


@query("sampled_normal_cases", f"""WITH {CTE_TX}
SELECT event_id AS source_row_id, {_DIGEST} AS digest FROM tx WHERE isFraud = 0 ORDER BY digest LIMIT 2000""")
def sampled_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.sampled_normal_rows(corpus_rows(spark, sf_dir), 2000)
    return kept.select("source_row_id", corpus.sample_digest(F.col("source_row_id")).alias("digest"))


@query("fraud_linked_accounts", f"""WITH {CTE_TX}
SELECT nameOrig AS account FROM tx WHERE isFraud = 1 UNION SELECT nameDest FROM tx WHERE isFraud = 1""")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fraud_linked_accounts(corpus_rows(spark, sf_dir))


_PROFILES = f"""{CTE_TX}, sides AS (
SELECT nameOrig AS account, 'origin' AS role, 0 AS side, * FROM tx UNION ALL SELECT nameDest, 'destination', 1, * FROM tx),
linked AS (SELECT nameOrig AS account FROM tx WHERE isFraud = 1 UNION SELECT nameDest FROM tx WHERE isFraud = 1),
mine AS (SELECT * FROM sides SEMI JOIN linked USING (account)), types AS (
SELECT account, string_agg('"' || type || '": ' || n, ', ' ORDER BY type) AS types FROM (
  SELECT account, type, count(*) AS n FROM mine GROUP BY 1, 2) GROUP BY account), prof AS (
SELECT account, count(*) AS transaction_count, sum(isFraud)::BIGINT AS fraud_transaction_count, sum(amount) AS total_amount,
  min(step) AS first_step, max(step) AS last_step, arg_max(role, event_id * 2 + side) AS role FROM mine GROUP BY account)"""


@query("account_profiles", f"""WITH {_PROFILES}
SELECT account, transaction_count, fraud_transaction_count, round(total_amount, 2) AS total_amount, first_step, last_step,
  role, types FROM prof JOIN types USING (account)""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.account_profiles(corpus_rows(spark, sf_dir))
    types = F.array_join(F.transform("types", lambda t: F.concat(F.lit('"'), t["type"], F.lit('": '), t["n"])), ", ")
    return out.withColumns({"types": types, "total_amount": F.round("total_amount", 2)})


@query("profile_documents", f"""WITH {_PROFILES}
SELECT concat('paysim_account_', sha256(account)) AS document_id, concat('PaySim account behavior profile', chr(10), 'Account: ',
  account, chr(10), 'Observed role: ', role, chr(10), 'Transactions: ', transaction_count, chr(10),
  'Fraud-labeled transactions: ', fraud_transaction_count, chr(10), 'Total observed amount: ',
  printf('%.2f', round(total_amount, 2)), chr(10), 'Transaction types: {{', types, '}}', chr(10), 'Observed step range: ',
  first_step, ' to ', last_step) AS text FROM prof JOIN types USING (account) ORDER BY account LIMIT 50000""")
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile_documents(corpus_rows(spark, sf_dir)).select("document_id", "text")


def _corpus_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = corpus_rows(spark, sf_dir)
    return (rows, corpus.fraud_rows(rows), corpus.sampled_normal_rows(rows),
            corpus.profile_documents(rows))


_COUNTS = f"""(SELECT count(*) FROM tx) AS rows_processed, (SELECT count(*) FROM tx WHERE isFraud = 1) AS fraud_documents,
  least(10000, (SELECT count(*) FROM tx WHERE isFraud = 0)) AS normal_documents,
  least(50000, (SELECT count(*) FROM prof)) AS account_profiles"""


@query("corpus_counts", f"WITH {_PROFILES} SELECT {_COUNTS}")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_counts(*_corpus_parts(spark, sf_dir))


# Chunks of plain text without headings or blank lines: slices of 700 words, each after
# the first led by the last 100 words before it.
CTE_CHUNKS = r"""w AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS body
FROM documents), s AS (SELECT doc_id, body, regexp_split_to_array(body, '\s+') AS words FROM w WHERE body <> ''), c AS (
SELECT doc_id, body, words, len(words) AS n, unnest(range(0, greatest((len(words) + 699) // 700, 1))) AS i FROM s), chunks AS (
SELECT doc_id, i::INT AS chunk_index, CASE WHEN n <= 700 THEN regexp_replace(body, '\n{3,}', chr(10) || chr(10), 'g')
  WHEN i = 0 THEN array_to_string(words[1:700], ' ')
  ELSE array_to_string(words[i * 700 - 99:i * 700], ' ') || chr(10) || chr(10) || array_to_string(words[i * 700 + 1:i * 700 + 700], ' ')
  END AS chunk FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents", heavy=True), "doc_id")


@query("document_chunks", f"""WITH {CTE_CHUNKS} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, length(chunk) AS chars,
  concat('knowledge_', sha256(concat('doc/', doc_id, chunk_index, chunk))) AS document_id FROM chunks""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return _chunks(spark, sf_dir).select(
        "doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.char_length("chunk").cast("long").alias("chars"),
        chunking.chunk_id(path, F.col("chunk_index"), F.col("chunk")).alias("document_id"))


_FOLDERS = [*chunking.TOPICS, "00_metadata", "notes"]
_FOLDER_SQL = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS)) + " END"
_PATH_SQL = f"""concat({_FOLDER_SQL}, CASE WHEN doc_id % 9 = 0 THEN '/Historical' ELSE '' END, '/',
  CASE WHEN doc_id % 10 = 0 THEN 'pwc_' WHEN doc_id % 10 = 1 THEN 'RBI_' ELSE '' END, source, '_', doc_id, '.md')"""
_KIND_SQL = "CASE doc_id % 4 WHEN 0 THEN 'secondary_analysis' WHEN 1 THEN 'primary_regulatory' END"
_PUBLISHER_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'House of Notes' END"


@query("knowledge_metadata", f"""WITH p AS (SELECT doc_id, {_PATH_SQL} AS relative_path, {_KIND_SQL} AS kind,
  {_PUBLISHER_SQL} AS publisher FROM documents), q AS (SELECT *, split_part(relative_path, '/', 1) AS top,
  split_part(relative_path, '/', -1) AS file, relative_path LIKE '%/Historical/%' AS hist FROM p), v AS (
SELECT *, CASE WHEN hist THEN 'historical' WHEN relative_path LIKE '%2024%' OR top LIKE '01_rbi%' THEN '2024'
  ELSE 'unspecified' END AS version FROM q), t(folder, name) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in chunking.TOPICS.items())})
SELECT doc_id, relative_path, CASE WHEN hist THEN 'historical_reference' ELSE coalesce(kind, 'regulatory_knowledge') END AS source_type,
  CASE WHEN hist THEN 'historical_guidance' ELSE coalesce(name, 'fraud_knowledge') END AS document_type,
  coalesce(name, CASE WHEN top = '00_metadata' THEN 'metadata_policy' ELSE top END) AS topic,
  coalesce(publisher, CASE WHEN file ILIKE '%rbi%' OR hist THEN 'RBI' WHEN relative_path ILIKE '%pwc%' THEN 'PwC'
    ELSE 'knowledge_base' END) AS authority, version,
  CASE WHEN hist THEN 'historical' WHEN version = '2024' AND coalesce(kind, '') <> 'secondary_analysis' THEN 'current'
    ELSE 'reference' END AS status, concat(doc_id, ', ', doc_id + 1) AS source_pages
FROM v LEFT JOIN t ON folder = top""")
def knowledge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "source", "text")
    written = docs.withColumns({
        "relative_path": F.expr(_PATH_SQL),
        "text": F.concat_ws(
            "\n", F.lit("---"), F.concat(F.lit("source_type: "), F.expr(_KIND_SQL)),
            F.concat(F.lit('publisher: "'), F.expr(_PUBLISHER_SQL), F.lit('"')),
            F.concat(F.lit("source_pages: ["), "doc_id", F.lit(", "), F.col("doc_id") + 1, F.lit("]")),
            F.lit("---"), F.col("text"))})
    return chunking.knowledge_metadata(written).select(
        "doc_id", "relative_path", "source_type", "document_type", "topic", "authority", "version", "status", "source_pages")


@query("changed_documents", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'changed' END AS change
FROM documents WHERE lang = 'en' OR (n_chars > 800 AND upper(text) <> text)""")
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store lacks the English documents and holds long ones in another form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    stored = docs.where("lang <> 'en'").select(
        "doc_id", F.when(F.col("n_chars") > 800, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return corpus.changed_documents(docs, stored, key="doc_id").select("doc_id", "change")


@query("pruned_documents", """SELECT doc_id, source AS source_type FROM documents
WHERE NOT (source = (SELECT min(source) FROM documents) AND lang <> 'en')""")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("source_type"))
    managed = docs.agg(F.min("source_type")).first()[0]
    kept = corpus.pruned_documents(docs, docs.where("lang = 'en'"), managed, key="doc_id")
    return kept.select("doc_id", "source_type")


@query("build_manifest", f"""WITH {_PROFILES}, {CTE_CHUNKS}
SELECT {_COUNTS}, (SELECT count(DISTINCT doc_id) FROM chunks) AS knowledge_files,
  (SELECT count(*) FROM chunks) AS knowledge_chunks, 700 AS setting_chunk_words, 100 AS setting_overlap_words""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.corpus_counts(*_corpus_parts(spark, sf_dir))
    chunks = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "relative_path")
    return corpus.build_manifest(counts, chunks, chunk_words=chunking.CHUNK_WORDS, overlap_words=chunking.OVERLAP_WORDS)


# Query vectors: the mean vector of each label, so the batch of queries stays as small as the label set.
CTE_NEAR = """dims AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label, list(m ORDER BY pos) AS vector FROM (SELECT label, pos, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
dist AS (SELECT cent.label AS query_id, vec_id AS document_id, embeddings.label,
  1 - list_cosine_similarity(cent.vector, embedding::DOUBLE[]) AS distance FROM cent, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS rank FROM dist)"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")).select(
        F.col("label").alias("query_id"), "vector")


def near(spark: SparkSession, sf_dir: str, k: int, per: str | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"), "label")
    return retrieve.nearest_neighbors(centroids(spark, sf_dir), vectors, k, per)


@query("nearest_vectors", f"""WITH {CTE_NEAR}
SELECT query_id, document_id, round(distance, 6) AS distance, rank::INT AS rank FROM near WHERE rank <= 15""")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 15).withColumn("distance", F.round("distance", 6))


@query("nearest_vectors_per_label", f"""WITH {CTE_NEAR}
SELECT query_id, label, document_id, round(distance, 6) AS distance FROM dist
QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY distance, document_id) <= 2""")
def nearest_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 2, "label").withColumn("distance", F.round("distance", 6)).drop("rank")


@query("nearest_within_distance", f"""WITH {CTE_NEAR}
SELECT query_id, document_id FROM near WHERE rank <= 15 AND distance <= 0.7""")
def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywatch.operators.validate import within_distance

    return within_distance(near(spark, sf_dir, 15), 0.7).select("query_id", "document_id")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"), "label")
    return vectors.where("document_id % 50 = 0").select(F.col("document_id").alias("query_id"), "vector"), vectors


# Every 50th vector asks for its nearest among all; it finds itself first.
CTE_ASKED = """asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 50 = 0),
found AS (SELECT query_id, vec_id AS document_id, 1 - list_cosine_similarity(vector, embedding::DOUBLE[]) AS distance FROM asked, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS rank FROM found)"""


@query("neighbours_of_vectors", f"""WITH {CTE_ASKED}
SELECT query_id, document_id, round(distance, 6) AS distance, rank::INT AS rank FROM ranked WHERE rank <= 10""")
def neighbours_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, vectors = _asked_vectors(spark, sf_dir)
    return retrieve.nearest_neighbors(asked, vectors, 10).withColumn("distance", F.round(F.abs("distance"), 6))


@query("hashed_neighbours_recall", f"""WITH {CTE_ASKED}
SELECT (SELECT count(*) FROM asked) AS queries, count(*) AS true_neighbours, true AS recall_reached, 0::BIGINT AS wrong_distances
FROM ranked WHERE rank <= 10""")
def hashed_neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hyperplane tables find 0.9 of the exact neighbours, with the same distances."""
    asked, vectors = _asked_vectors(spark, sf_dir)
    exact = retrieve.nearest_neighbors(asked, vectors, 10).select("query_id", "document_id", "distance")
    hashed = retrieve.hashed_neighbors(asked, vectors, 10).select("query_id", "document_id", F.col("distance").alias("hashed"))
    both = exact.join(hashed, ["query_id", "document_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("true_neighbours"),
                    (F.count("hashed") >= 0.9 * F.count("*")).alias("recall_reached"),
                    F.count_if(F.col("hashed") != F.col("distance")).alias("wrong_distances"))


@query("deduplicated_candidates", """SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role""")
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lit("").alias("preferred"))
    return retrieve.deduplicate(rows, ["conv_id"], ["preferred", "role"], "turn").select("conv_id", "role", "turn")


_META = """CASE document_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'historical' ELSE 'reference' END AS status,
  document_id % 3 = 0 AS current_authority, CASE WHEN document_id % 2 = 0 THEN 'RBI' ELSE 'PwC' END AS authority,
  CASE document_id % 4 WHEN 0 THEN 'primary_regulatory' WHEN 1 THEN 'secondary_analysis' WHEN 2 THEN 'historical_reference'
    ELSE 'regulatory_knowledge' END AS source_type"""


def _with_metadata(df: DataFrame) -> DataFrame:
    fields = df.selectExpr("*", *[part for part in _split_select(_META)])
    return fields.withColumn("metadata", F.struct("status", "current_authority", "authority", "source_type")).drop(
        "status", "current_authority", "authority", "source_type")


def _split_select(text: str) -> list[str]:
    """Top-level expressions of a select list that holds no nested commas."""
    return [part.strip() for part in text.split(",")]


@query("ranked_knowledge", f"""WITH {CTE_NEAR}, m AS (SELECT *, {_META} FROM near WHERE rank <= 15), p AS (
SELECT *, CASE WHEN status = 'current' AND authority = 'RBI' AND source_type = 'primary_regulatory' THEN 0
  WHEN status = 'current' THEN 1 WHEN source_type = 'secondary_analysis' THEN 2
  WHEN status = 'historical' OR source_type = 'historical_reference' THEN 3 ELSE 2 END AS metadata_priority FROM m)
SELECT query_id, document_id, metadata_priority FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY metadata_priority, distance, document_id::VARCHAR) <= 5""")
def ranked_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.rank_knowledge(_with_metadata(near(spark, sf_dir, 15)))
    return out.select("query_id", "document_id", "metadata_priority")


def _case_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each label's alert: nearest vectors, with the transaction of the same number as the case."""
    rows = inputs.transactions(spark, sf_dir)
    cases = corpus.case_documents(corpus_rows(spark, sf_dir), "normal").select(
        F.col("metadata.source_row_id").cast("long").alias("document_id"), "text", "metadata")
    alert = rows.select(
        F.col("event_id").cast("int").alias("query_id"), F.col("transaction_id").alias("alert_id"),
        F.col("type").alias("transaction_type"), "amount", F.col("oldbalanceOrg").alias("old_balance_orig"),
        F.col("newbalanceOrig").alias("new_balance_orig"), F.col("oldbalanceDest").alias("old_balance_dest"),
        F.col("newbalanceDest").alias("new_balance_dest"))
    found = near(spark, sf_dir, 15)
    return found.join(cases, "document_id").join(alert, "query_id").withColumn(
        "source_row_id", F.col("document_id").cast("string"))


@query("ranked_cases", f"""WITH {CTE_TX}, {CTE_NEAR}, j AS (
SELECT a.transaction_id AS alert_id, n.document_id, n.distance, a.type = c.type AS same_type,
  CASE WHEN greatest(a.amount, c.amount) > 0 THEN greatest(a.amount, c.amount) / greatest(least(a.amount, c.amount), 1e-12)
    ELSE 1 END AS amount_ratio,
  ((c.oldbalanceOrg > 0 AND c.newbalanceOrig = 0) = (a.oldbalanceOrg > 0 AND a.newbalanceOrig = 0))::INT
  + ((c.oldbalanceOrg = c.newbalanceOrig) = (a.oldbalanceOrg = a.newbalanceOrig))::INT
  + ((c.newbalanceDest > c.oldbalanceDest) = (a.newbalanceDest > a.oldbalanceDest))::INT
  + ((c.newbalanceDest = c.oldbalanceDest) = (a.newbalanceDest = a.oldbalanceDest))::INT
  + (sign(round(c.newbalanceOrig - c.oldbalanceOrg, 2)) = sign(round(a.newbalanceOrig - a.oldbalanceOrg, 2)))::INT AS hits
FROM near n JOIN tx a ON a.event_id = n.query_id JOIN tx c ON c.event_id = n.document_id WHERE n.rank <= 15)
SELECT alert_id, document_id, same_type AS same_transaction_type, amount_ratio <= 2 AS similar_amount_range,
  round(hits / 5, 6) AS balance_match_score, round(amount_ratio, 6) AS amount_ratio FROM j
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY same_type DESC, amount_ratio <= 2 DESC, hits DESC, distance,
  document_id::VARCHAR) <= 5""")
def ranked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.rank_cases(_case_candidates(spark, sf_dir))
    return out.select("alert_id", "document_id", "same_transaction_type", "similar_amount_range",
                      F.round("balance_match_score", 6).alias("balance_match_score"),
                      F.round("amount_ratio", 6).alias("amount_ratio"))


@query("recent_per_account", f"""WITH {CTE_TX}
SELECT nameOrig AS name_orig, transaction_id FROM tx
QUALIFY row_number() OVER (PARTITION BY nameOrig ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id) <= 20""")
def recent_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.transactions(spark, sf_dir).select(
        F.col("nameOrig").alias("name_orig"), "transaction_id", "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"))
    return retrieve.rank_recent(rows, ["name_orig"], ["transaction_id"], 20, "event_id").select(
        "name_orig", "transaction_id")


def _history(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Account evidence of all alerts, or of a row for each question of ``asked`` (conv_id) about the alert of that event.

    ``marks`` are joined by alert_id while the rows are narrow, before the lists come to them.
    """
    rows = ledger(spark, sf_dir).withColumnsRenamed({"nameOrig": "name_orig", "generated_at": "event_time"})
    alerts = rows.where("alert_id IS NOT NULL").select(
        "alert_id", "transaction_id", "name_orig", "event_time", "event_id", "risk_level", "amount", "final_prediction")
    stored = rows.where("processing_status = 'LOW_RISK'").select("name_orig", "transaction_id", "event_time", "amount")
    about = alerts if asked is None else asked.join(alerts, F.col("conv_id") == F.col("event_id"))
    about = about if marks is None else about.join(marks, "alert_id")
    return evidence.account_evidence(about, stored, alerts, _results(spark, sf_dir))


CTE_HISTORY = f"""{CTE_LEDGER}, alerts AS (SELECT * FROM ledger WHERE alert_id IS NOT NULL), rt AS (
SELECT nameOrig, string_agg(transaction_id, ',' ORDER BY r) AS tx_ids, count(*) AS tx_n FROM (SELECT *, row_number() OVER (
  PARTITION BY nameOrig ORDER BY generated_at DESC, transaction_id) AS r FROM ledger WHERE processing_status = 'LOW_RISK')
WHERE r <= 20 GROUP BY nameOrig), na AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nameOrig ORDER BY generated_at DESC, alert_id) AS r FROM alerts) WHERE r <= 10),
ra AS (SELECT a.alert_id, n.alert_id AS other, n.event_id AS other_event, n.risk_level AS other_level, r FROM alerts a JOIN na n USING (nameOrig)
  WHERE n.alert_id <> a.alert_id), ids AS (
SELECT alert_id, event_id AS e, risk_level AS level FROM alerts UNION SELECT alert_id, other_event, other_level FROM ra), inv AS (
SELECT alert_id, e * 10 + v AS made, concat('INV-', CASE v WHEN 0 THEN 'a' ELSE 'b' END, '-', e) AS iid
FROM ids, range(2) q(v) WHERE level <> 'L5'), li AS (
SELECT alert_id, string_agg(iid, ',' ORDER BY made DESC) AS investigation_ids, count(*) AS inv_n FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY made DESC) AS r FROM inv) WHERE r <= 10 GROUP BY 1), la AS (
SELECT alert_id, string_agg(other, ',' ORDER BY r) AS alert_ids, count(*) AS alert_n FROM ra GROUP BY 1), hist AS (
SELECT a.*, coalesce(tx_ids, '') AS tx_ids, coalesce(alert_ids, '') AS alert_ids, coalesce(investigation_ids, '') AS investigation_ids,
  coalesce(tx_n, 0) AS tx_n, coalesce(alert_n, 0) AS alert_n, coalesce(inv_n, 0) AS inv_n
FROM alerts a LEFT JOIN rt USING (nameOrig) LEFT JOIN la USING (alert_id) LEFT JOIN li USING (alert_id))"""


@query("account_evidence", f"WITH {CTE_HISTORY} SELECT alert_id, tx_ids, alert_ids, investigation_ids FROM hist")
def account_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(
        "alert_id", F.array_join("recent_transactions.transaction_id", ",").alias("tx_ids"),
        F.array_join("recent_alerts.alert_id", ",").alias("alert_ids"),
        F.array_join("previous_investigations.investigation_id", ",").alias("investigation_ids"))


@query("missing_evidence", f"""WITH {CTE_HISTORY}
SELECT alert_id, concat_ws('|', CASE WHEN tx_n = 0 THEN 'No relevant account history was retrieved from Cassandra.' END,
  CASE WHEN alert_n = 0 THEN 'No previous alerts were retrieved.' END,
  CASE WHEN inv_n = 0 THEN 'No previous investigations were retrieved.' END) AS missing FROM hist""")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("alert_id", F.array_join(evidence.missing_evidence(), "|").alias("missing"))


def contexts(spark: SparkSession, sf_dir: str, marks: DataFrame | None = None) -> DataFrame:
    """Alert contexts: account lists plus the retrieved items of the alert's label, and the columns of ``marks`` by alert_id."""
    found = near(spark, sf_dir, 5)
    listed = found.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda r: F.struct(
            F.concat(F.lit("K"), r["document_id"]).alias("document_id"), F.lit("text").alias("text"))).alias("knowledge"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda r: F.struct(
            F.concat(F.lit("P"), r["document_id"]).alias("document_id"), F.lit("text").alias("text"),
            F.when(r["document_id"] % 2 == 0, "fraud").otherwise("normal").alias("label"))).alias("cases"))
    kept = [] if marks is None else [c for c in marks.columns if c != "alert_id"]
    alerts = _history(spark, sf_dir, marks=marks).withColumn("query_id", (F.col("event_id") % 12).cast("int"))
    # One row a label: sent to the alerts, whose rows are wide by now.
    return evidence.evidence_context(alerts.join(F.broadcast(listed), "query_id", "left"), kept)


_LISTED = """listed AS (SELECT query_id, string_agg(concat('K', document_id), ',' ORDER BY rank) AS knowledge_ids,
  string_agg(concat('P', document_id), ',' ORDER BY document_id % 2, rank) AS case_ids,
  count(*) FILTER (document_id % 2 = 0) AS fraud_n, count(*) AS n FROM near WHERE rank <= 5 GROUP BY query_id)"""


@query("evidence_contexts", f"""WITH {CTE_HISTORY}, {CTE_NEAR}, {_LISTED}
SELECT alert_id, 1 + tx_n + alert_n + inv_n + 2 * coalesce(n, 0) AS total_evidence_items, coalesce(fraud_n, 0) AS fraud_cases,
  coalesce(knowledge_ids, '') AS knowledge_ids, coalesce(case_ids, '') AS case_ids,
  CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS cases_status,
  CASE WHEN tx_n > 0 AND alert_n > 0 AND inv_n > 0 AND n IS NOT NULL THEN 'completed' ELSE 'partial' END AS investigation_status
FROM hist LEFT JOIN listed ON query_id = event_id % 12""")
def evidence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywatch.operators.quality import investigation_status

    out = contexts(spark, sf_dir)
    return out.select(
        "alert_id", F.col("evidence_summary.total_evidence_items").cast("long").alias("total_evidence_items"),
        F.size("historical_paysim_context.fraud_cases").cast("long").alias("fraud_cases"),
        F.array_join("evidence_summary.knowledge_document_ids", ",").alias("knowledge_ids"),
        F.array_join("evidence_summary.paysim_document_ids", ",").alias("case_ids"),
        F.col("retrieval_status.paysim_cases").alias("cases_status"), investigation_status().alias("investigation_status"))


@query("evidence_catalogue", f"""WITH {CTE_HISTORY}, {CTE_NEAR}, e AS (
SELECT alert_id, 0 AS o, transaction_id AS source_id, 'live_transaction' AS source_type FROM hist
UNION ALL SELECT alert_id, 1, alert_id, 'live_transaction' FROM hist
UNION ALL SELECT alert_id, 2, 'model-output:' || transaction_id, 'model_output' FROM hist
UNION ALL SELECT alert_id, 3, unnest(string_split(tx_ids, ',')), 'cassandra_history' FROM hist WHERE tx_ids <> ''
UNION ALL SELECT alert_id, 4, concat('TXN-', other_event), 'cassandra_history' FROM ra
UNION ALL SELECT DISTINCT alert_id, 5, other, 'cassandra_history' FROM (
  SELECT alert_id, unnest(string_split(investigation_ids, ',')) AS iid FROM hist WHERE investigation_ids <> '') x
  JOIN (SELECT alert_id AS other, event_id FROM alerts) y ON y.event_id = split_part(iid, '-', 3)::BIGINT
UNION ALL SELECT alert_id, 6, concat('K', document_id), 'rbi_knowledge' FROM hist JOIN near ON query_id = event_id % 12 AND rank <= 5
UNION ALL SELECT alert_id, 7, concat('P', document_id), CASE WHEN document_id % 2 = 0 THEN 'paysim_fraud' ELSE 'paysim_normal' END
  FROM hist JOIN near ON query_id = event_id % 12 AND rank <= 5)
SELECT alert_id, source_id, arg_max(source_type, o) AS source_type FROM e GROUP BY 1, 2""")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_catalogue(contexts(spark, sf_dir))


@query("checked_citations", f"""WITH {CTE_LEDGER}, {CTE_NEAR}
SELECT alert_id, concat('P', document_id) AS source_id, 'paysim_fraud' AS source_type,
  CASE WHEN document_id % 2 = 0 THEN 'kept' ELSE 'rejected' END AS verdict
FROM ledger JOIN near ON query_id = event_id % 12 AND rank <= 5 WHERE alert_id IS NOT NULL""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert cites all its cases as fraud; only the ones labelled so stand."""
    listed = contexts(spark, sf_dir)
    cited = listed.select("alert_id", F.explode("evidence_summary.paysim_document_ids").alias("source_id"),
                          F.lit("paysim_fraud").alias("source_type"))
    kept, rejected = evidence.checked_citations(cited, evidence.evidence_catalogue(listed))
    return kept.withColumn("verdict", F.lit("kept")).unionByName(rejected.withColumn("verdict", F.lit("rejected")))


def _alert_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decided(spark, sf_dir).withColumnsRenamed({
        "type": "transaction_type", "oldbalanceOrg": "old_balance_orig", "newbalanceOrig": "new_balance_orig",
        "oldbalanceDest": "old_balance_dest", "newbalanceDest": "new_balance_dest"})


@query("retrieval_query_texts", f"""WITH {CTE_DECIDED}, d AS (SELECT *, {_DELTA} AS delta FROM decided)
SELECT transaction_id, concat('transaction type ', type, '; risk level ', risk_level, '; anomaly score ', anomaly_score::DECIMAL(10,6),
  '; risk action ', risk_action, '; origin balance changed from ', oldbalanceOrg, ' to ', newbalanceOrig, ' (change ', delta, ')',
  '; decision path ', final_decision_path, '; final risk action ', final_risk_action,
  '. Retrieve applicable RBI and domain guidance on EWS and RFA, transaction monitoring, fraud investigation, fraud classification',
  CASE WHEN type <> 'CASH_IN' THEN ', digital banking and payment fraud' ELSE '' END,
  '. Treat alert fields as observed evidence.') AS knowledge_query,
  concat('Historical PaySim examples with similar transaction characteristics; transaction type ', type, '; amount ', amount,
  '; risk level ', risk_level, '; anomaly score ', anomaly_score::DECIMAL(10,6),
  CASE WHEN xgboost_probability IS NULL THEN '' ELSE concat('; XGBoost probability ', xgboost_probability::DECIMAL(10,6)) END,
  '; decision path ', final_decision_path, '; origin balance from ', oldbalanceOrg, ' to ', newbalanceOrig,
  '; destination balance from ', oldbalanceDest, ' to ', newbalanceDest,
  '; Synthetic historical reference only; labels do not establish the status of the live alert.') AS case_query
FROM d""")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Engines print small doubles differently, so scores go in as decimals.
    df = _alert_fields(spark, sf_dir).withColumns({
        c: F.col(c).cast("decimal(10,6)") for c in ("anomaly_score", "xgboost_probability")})
    return df.select("transaction_id", evidence.knowledge_query_text(df).alias("knowledge_query"),
                     evidence.case_query_text(df).alias("case_query"))


@query("live_behavior_sentences", f"""WITH {CTE_TX}
SELECT transaction_id, concat('The current ', type, ' transaction for amount ', amount,
  CASE WHEN oldbalanceOrg <> newbalanceOrig OR oldbalanceDest <> newbalanceDest THEN ' has ' ELSE '' END,
  concat_ws(' and ', CASE WHEN oldbalanceOrg <> newbalanceOrig THEN concat('origin balance moved from ', oldbalanceOrg, ' to ', newbalanceOrig) END,
    CASE WHEN oldbalanceDest <> newbalanceDest THEN concat('destination balance moved from ', oldbalanceDest, ' to ', newbalanceDest) END),
  '.') AS sentence FROM tx""")
def live_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.transactions(spark, sf_dir).withColumnsRenamed({
        "type": "transaction_type", "oldbalanceOrg": "old_balance_orig", "newbalanceOrig": "new_balance_orig",
        "oldbalanceDest": "old_balance_dest", "newbalanceDest": "new_balance_dest"})
    return df.select("transaction_id", evidence.live_behavior_sentence().alias("sentence"))


@query("case_comparison_sentences", f"""WITH {CTE_CASES}
SELECT event_id::VARCHAR AS source_row_id, concat('Synthetic PaySim ', label, ' reference; transaction type ', type,
  '; recorded amount ', amount, CASE WHEN b <> '' THEN concat('; observed ', b) ELSE '' END,
  '. Similarity does not establish fraud in the current alert.') AS sentence FROM (
SELECT *, concat_ws(' and ', CASE WHEN text LIKE '%rigin account balance decreased%' AND lower(text) LIKE '%origin balance decreased%'
    OR delta NOT IN ('0', '0.0') THEN 'origin balance decreased' END,
  CASE WHEN newbalanceDest > oldbalanceDest THEN 'destination balance increased' END) AS b FROM cases)""")
def comparison_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_rows(spark, sf_dir)
    both = corpus.case_documents(corpus.fraud_rows(rows), "fraud").unionByName(
        corpus.case_documents(rows.where(~corpus.is_fraud_row()), "normal"))
    return both.select("metadata.source_row_id", evidence.case_comparison_sentence().alias("sentence"))


_QUESTION = """concat(CASE turn % 6 WHEN 0 THEN 'What does the Reserve Bank say? ' WHEN 1 THEN 'Any similar cases? '
  WHEN 2 THEN 'Show prior activity. ' WHEN 3 THEN 'Why was this flagged? ' WHEN 4 THEN 'EWS list? ' ELSE '' END, text)"""


@query("question_intents", f"""WITH q AS (SELECT conv_id, turn, lower({_QUESTION}) AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(f, '\\brbi\\b|reserve bank|regulat|early.warning|(?:\\bews\\b)|\\brfa\\b') THEN 'regulatory'
  WHEN regexp_matches(f, 'historical|historically|paysim|synthetic|compare|similar cases|past cases') THEN 'historical'
  WHEN regexp_matches(f, 'account|previous|prior|before|history') THEN 'account'
  WHEN regexp_matches(f, 'transaction|alert|flagged|risk|decision|fraud') THEN 'transaction' ELSE 'general' END AS intent FROM q""")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").withColumn("question", F.expr(_QUESTION))
    return df.select("conv_id", "turn", evidence.question_intent("question").alias("intent"))


@query("selected_evidence", f"""WITH {CTE_NEAR}, c AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'regulatory'
  WHEN 4 THEN 'regulatory' WHEN 1 THEN 'historical' WHEN 2 THEN 'account' ELSE 'transaction' END AS intent,
  conv_id % 10 AS query_id FROM conversations), m AS (SELECT *, {_META} FROM near WHERE rank <= 15), r AS (
SELECT conv_id, turn, intent, document_id, rank, source_type, authority FROM c LEFT JOIN m USING (query_id)), k AS (
SELECT conv_id, turn, string_agg(document_id::VARCHAR, ',' ORDER BY rank) AS ids FROM (SELECT * FROM r WHERE intent <> 'account'
  AND (intent <> 'regulatory' OR (authority = 'RBI' AND source_type = 'primary_regulatory'))
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank) <= 3) GROUP BY 1, 2), p AS (
SELECT conv_id, turn, string_agg(document_id::VARCHAR, ',' ORDER BY document_id % 2, rank) AS ids FROM (
  SELECT * FROM r WHERE intent IN ('historical', 'transaction')
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, document_id % 2 ORDER BY rank) <= 2) GROUP BY 1, 2)
SELECT c.conv_id, c.turn, c.intent, coalesce(k.ids, '') AS knowledge_ids, coalesce(p.ids, '') AS case_ids
FROM c LEFT JOIN k USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)""")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = "CASE turn % 6 WHEN 0 THEN 'Reserve Bank' WHEN 1 THEN 'similar cases' WHEN 2 THEN 'prior' WHEN 3 THEN 'flagged' WHEN 4 THEN 'EWS list' ELSE 'hello' END"
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(prompt).alias("question"), (F.col("conv_id") % 10).cast("int").alias("query_id"))
    found = _with_metadata(near(spark, sf_dir, 15)).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document_id", "metadata"))).alias("items"))
    lists = found.select(
        "query_id",
        F.transform("items", lambda i: F.struct(
            i["document_id"].alias("document_id"), F.lit("text").alias("text"), i["metadata"]["authority"].alias("authority"),
            i["metadata"]["source_type"].alias("source_type"))).alias("knowledge"),
        F.transform("items", lambda i: F.struct(
            i["document_id"].alias("document_id"), F.lit("text").alias("text"),
            F.when(i["document_id"] % 2 == 0, "fraud").otherwise("normal").alias("label"))).alias("cases"))
    out = evidence.select_evidence(asked.join(lists, "query_id", "left"))
    return out.select(
        "conv_id", "turn", "intent", F.coalesce(F.array_join("knowledge.document_id", ","), F.lit("")).alias("knowledge_ids"),
        F.coalesce(F.array_join("cases.document_id", ","), F.lit("")).alias("case_ids"))


@query("history_evidence", f"""WITH {CTE_HISTORY}, q AS (SELECT conv_id, turn, lower({_QUESTION}) AS f FROM conversations), asked AS (
SELECT conv_id, turn, CASE WHEN regexp_matches(f, '\\brbi\\b|reserve bank|regulat|early.warning|(?:\\bews\\b)|\\brfa\\b') THEN 'regulatory'
  WHEN regexp_matches(f, 'historical|historically|paysim|synthetic|compare|similar cases|past cases') THEN 'historical'
  WHEN regexp_matches(f, 'account|previous|prior|before|history') THEN 'account' ELSE 'transaction' END AS intent FROM q), named AS (
SELECT h.event_id, tx_n + alert_n + inv_n AS n, list_filter([split_part(tx_ids, ',', 1), split_part(tx_ids, ',', 2), other.transaction_id, inv.alert_id],
  lambda s: s <> '' AND s <> h.transaction_id) AS ids
FROM hist h LEFT JOIN alerts other ON other.alert_id = split_part(alert_ids, ',', 1)
LEFT JOIN alerts inv ON inv.event_id = TRY_CAST(split_part(split_part(investigation_ids, ',', 1), '-', 3) AS BIGINT))
SELECT conv_id, turn, event_id, intent, CASE WHEN intent <> 'regulatory' THEN array_to_string(ids, ',') ELSE '' END AS history_ids,
  CASE WHEN intent <> 'regulatory' THEN len(ids) ELSE 0 END AS history_facts,
  intent <> 'regulatory' AND n = 0 AS history_missing
FROM asked JOIN named ON named.event_id = conv_id""")
def history_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_QUESTION).alias("question"))
    none = F.array().cast("array<struct<document_id:string,text:string,authority:string,source_type:string,label:string>>")
    # Only alerts that are asked about get their lists.
    out = evidence.select_evidence(_history(spark, sf_dir, asked).withColumns({"knowledge": none, "cases": none}))
    ids = F.coalesce("history.source_id", F.array().cast("array<string>"))
    return out.select(
        "conv_id", "turn", "event_id", "intent", F.array_join(ids, ",").alias("history_ids"),
        F.coalesce(F.size(F.filter("history", lambda h: F.get_json_object(h["content"], "$.event_time").isNotNull()
                                   | F.get_json_object(h["content"], "$.investigation_id").isNotNull())), F.lit(0)).cast("long").alias("history_facts"),
        F.array_contains("missing", evidence.NO_HISTORY).alias("history_missing"))
