"""Evidence for alerts: account history, context documents, catalogues, citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallywatch.functions.bound import bound
from tallywatch.functions.text import decimal_difference, labelled, present
from tallywatch.session import scratch_dir

# History limits.
RECENT_TRANSACTIONS = 20
RECENT_ALERTS = 10
RECENT_INVESTIGATIONS = 10
DIGITAL_TYPES = ["TRANSFER", "CASH_OUT", "CASHOUT", "PAYMENT", "DEBIT"]
KNOWLEDGE_TOPICS = ["EWS and RFA", "transaction monitoring", "fraud investigation", "fraud classification"]
#: Ids that may be broadcast: about 100 MB as a hash table.
BROADCAST_KEYS = 500_000
MODEL_FIELDS = ["anomaly_score", "risk_level", "risk_action", "xgboost_probability", "xgboost_prediction",
                "final_prediction", "final_decision_path", "final_risk_action", "model_version"]


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column], limit: int, fields: Sequence[str], name: str) -> DataFrame:
    """An array of the newest ``limit`` records per key, newest first.

    The rank limit applies before the shuffle, so a busy key sends ``limit``
    rows per task.
    """
    newest = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias(name))
    return listed.withColumn(name, F.transform(name, lambda r: F.struct(*[r[f].alias(f) for f in fields])))


def account_evidence(alerts: DataFrame, transactions: DataFrame, alert_table: DataFrame, investigations: DataFrame,
                     transaction_fields: Sequence[str] = ("transaction_id", "event_time", "amount"),
                     alert_fields: Sequence[str] = ("alert_id", "transaction_id", "event_time", "risk_level"),
                     investigation_fields: Sequence[str] = ("investigation_id", "alert_id", "generated_at"),
                     ) -> DataFrame:
    """Recent transactions, other recent alerts and their investigations per alert.

    History is reduced to a short list per account first; only lists are joined
    to the alerts. An alert without an account keeps empty lists and a note.
    The lists of the account come last: a row is wide from then on and is not shuffled again.
    """
    tx = latest_per_key(transactions, "name_orig", [F.col("event_time").desc(), F.col("transaction_id")],
                        RECENT_TRANSACTIONS, transaction_fields, "recent_transactions")
    near = latest_per_key(alert_table, "name_orig", [F.col("event_time").desc(), F.col("alert_id")],
                          RECENT_ALERTS, alert_fields, "_near")
    results = latest_per_key(investigations, "alert_id", [F.col("generated_at").desc(), F.col("investigation_id")],
                             RECENT_INVESTIGATIONS, investigation_fields, "_results")
    # Results of the listed alerts are gathered once per account, not once per alert of it.
    about = near.select("name_orig", F.explode("_near.alert_id").alias("alert_id")).join(results, "alert_id")
    told = about.groupBy("name_orig").agg(F.flatten(F.collect_list("_results")).alias("_told"))
    lists = tx.unionByName(near, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    names = ["recent_transactions", "_near", "_told"]
    account = lists.groupBy("name_orig").agg(*[F.any_value(c, ignoreNulls=F.lit(True)).alias(c) for c in names])
    joined = alerts.join(results, "alert_id", "left").join(account, "name_orig", "left")
    mine = F.filter("_near", lambda r: (r["alert_id"] == F.col("alert_id")) | (
        r["transaction_id"] == F.col("transaction_id")))
    current = F.when(F.size(mine) > 0, mine[0]["alert_id"]).otherwise(F.col("alert_id"))
    found = joined.withColumn("_current", current).withColumns({
        "recent_transactions": F.coalesce("recent_transactions", F.array()),
        "recent_alerts": F.coalesce(F.filter("_near", lambda r: r["alert_id"] != F.col("_current")), F.array()),
    })
    wanted = F.array_union(F.array("_current"), F.col("recent_alerts.alert_id"))
    shared = F.filter(F.coalesce("_told", F.array()), lambda r: F.array_contains(wanted, r["alert_id"]))
    own = F.when(F.col("_current") == F.col("alert_id"), F.col("_results"))
    newest_first = F.slice(F.array_sort(
        F.array_distinct(F.concat(shared, F.coalesce(own, F.array()))),
        lambda a, b: F.when(a["generated_at"] > b["generated_at"], -1).when(a["generated_at"] < b["generated_at"], 1)
        .when(a["investigation_id"] < b["investigation_id"], -1).when(a["investigation_id"] > b["investigation_id"], 1)
        .otherwise(0)), 1, RECENT_INVESTIGATIONS)
    found = found.withColumn("previous_investigations", newest_first).drop("_told", "_results")
    return found.drop("_near", "_current").withColumns({
        "retrieval_note": F.when(present(F.col("name_orig")).isNull(),
                                 "origin account missing; account history skipped"),
    })


def knowledge_query_text(df: DataFrame) -> Column:
    """Retrieval text that states only fields the alert carries."""

    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    old, new = field("old_balance_orig").cast("string"), field("new_balance_orig").cast("string")
    balance = F.when(old.isNotNull() & new.isNotNull(), F.concat(
        F.lit("origin balance changed from "), old, F.lit(" to "), new, F.lit(" (change "),
        decimal_difference(new, old), F.lit(")")))
    said = F.concat_ws(
        "; ", labelled("transaction type", field("transaction_type")), labelled("risk level", field("risk_level")),
        labelled("anomaly score", field("anomaly_score")), labelled("risk action", field("risk_action")),
        labelled("alert reason", field("alert_reason")), balance,
        labelled("decision path", field("final_decision_path")),
        labelled("final risk action", field("final_risk_action")))
    digital = F.upper(F.coalesce(field("transaction_type"), F.lit(""))).isin(DIGITAL_TYPES)
    topics = F.concat_ws(", ", *[F.lit(t) for t in KNOWLEDGE_TOPICS],
                         F.when(digital, F.lit("digital banking and payment fraud")))
    return F.concat(F.when(said == "", "fraud alert").otherwise(said),
                    F.lit(". Retrieve applicable RBI and domain guidance on "), topics,
                    F.lit(". Treat alert fields as observed evidence."))


def case_query_text(df: DataFrame) -> Column:
    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def moved(label: str, old: str, new: str) -> Column:
        return F.concat(F.lit(f"{label} from "), field(old).cast("string"), F.lit(" to "), field(new).cast("string"))

    def kept(label: str, name: str) -> Column:
        return F.concat(F.lit(f"{label} "), field(name).cast("string"))

    return F.concat_ws(
        "; ", F.lit("Historical PaySim examples with similar transaction characteristics"),
        labelled("transaction type", field("transaction_type")), kept("amount", "amount"),
        kept("risk level", "risk_level"), kept("anomaly score", "anomaly_score"),
        kept("XGBoost probability", "xgboost_probability"), kept("decision path", "final_decision_path"),
        moved("origin balance", "old_balance_orig", "new_balance_orig"),
        moved("destination balance", "old_balance_dest", "new_balance_dest"),
        F.lit("Synthetic historical reference only; labels do not establish the status of the live alert."))


def missing_evidence() -> Column:
    """Sentences for the kinds of account evidence that are absent."""

    def absent(name: str, sentence: str) -> Column:
        return F.when(F.coalesce(F.size(name), F.lit(0)) <= 0, F.lit(sentence))

    return F.array_compact(F.array(
        absent("recent_transactions", "No relevant account history was retrieved from Cassandra."),
        absent("recent_alerts", "No previous alerts were retrieved."),
        absent("previous_investigations", "No previous investigations were retrieved.")))


def source_status(account: Column, knowledge: Column, cases: Column) -> Column:
    """Status per evidence source. A source that delivered no table row has failed."""

    def status(value: Column) -> Column:
        return F.when(value.isNotNull(), "success").otherwise("failed")

    return F.struct(
        F.when(account.isNull(), "failed").when(present(F.col("name_orig")).isNull(), "partial")
        .otherwise("success").alias("cassandra"),
        status(knowledge).alias("fraud_knowledge"), status(cases).alias("paysim_cases"))


def evidence_context(df: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Nested context per alert from the account lists, ``knowledge`` and ``cases`` arrays.

    ``knowledge`` items carry document_id and text, ``cases`` items document_id,
    text and label. Everything a list holds is bounded by the retrieval limits.
    The ``kept`` columns of ``df`` follow as they are.
    """
    def is_fraud(case: Column) -> Column:
        return F.lower(case["label"].cast("string")).isin("fraud", "1", "true")

    status = source_status(F.col("recent_transactions"), F.col("knowledge"), F.col("cases"))
    lists = df.withColumns({
        "retrieval_status": status,
        "knowledge": F.coalesce("knowledge", F.array()), "cases": F.coalesce("cases", F.array()),
    }).withColumns({
        "fraud_cases": F.filter("cases", is_fraud),
        "normal_cases": F.filter("cases", lambda c: ~F.coalesce(is_fraud(c), F.lit(False))),
    })
    model = [c for c in MODEL_FIELDS if c in df.columns]
    sizes = {name: F.size(column) for name, column in (
        ("recent_transaction_count", "recent_transactions"), ("recent_alert_count", "recent_alerts"),
        ("investigation_count", "previous_investigations"), ("knowledge_count", "knowledge"),
        ("paysim_case_count", "cases"))}
    total = F.lit(1)
    for size in sizes.values():
        total = total + size
    return lists.select(
        "alert_id", F.lit("1.0").alias("context_version"),
        F.struct("alert_id", "transaction_id", "name_orig").alias("alert"),
        F.struct("recent_transactions", "recent_alerts", "previous_investigations").alias("live_account_context"),
        F.col("knowledge").alias("regulatory_context"),
        F.struct("fraud_cases", "normal_cases").alias("historical_paysim_context"),
        F.struct(*model).alias("model_output"), "retrieval_status",
        missing_evidence().alias("missing_evidence"),
        F.struct(
            F.lit(1).alias("current_alert_count"), *[size.alias(name) for name, size in sizes.items()],
            total.alias("total_evidence_items"),
            F.col("knowledge.document_id").alias("knowledge_document_ids"),
            F.concat(F.col("fraud_cases.document_id"), F.col("normal_cases.document_id")).alias("paysim_document_ids"),
            F.col("recent_transactions.transaction_id").alias("cassandra_transaction_ids"),
            F.col("recent_alerts.alert_id").alias("cassandra_alert_ids"),
            F.col("previous_investigations.investigation_id").alias("cassandra_investigation_ids"),
            F.lit("deterministic_retrieval_inventory").alias("summary_type")).alias("evidence_summary"), *kept)


def evidence_catalogue(contexts: DataFrame) -> DataFrame:
    """(alert_id, source_id, source_type); a later source overrides an earlier one."""

    def entry(order: int, source_id: Column, kind: Column | str) -> Column:
        return F.struct(F.lit(order).alias("source_order"), source_id.cast("string").alias("source_id"),
                        (F.lit(kind) if isinstance(kind, str) else kind).alias("source_type"))

    alert = F.col("alert")
    own = F.array(
        entry(0, alert["transaction_id"], "live_transaction"), entry(1, alert["alert_id"], "live_transaction"),
        entry(2, F.concat(F.lit("model-output:"), alert["transaction_id"]), "model_output"),
        entry(2, F.when(present(alert["transaction_id"]).isNull() & present(alert["alert_id"]).isNull(),
                        F.lit("current-alert")), "live_transaction"))
    live = F.col("live_account_context")
    lists = [
        own,
        F.transform(live["recent_transactions"], lambda r: entry(3, r["transaction_id"], "cassandra_history")),
        F.transform(live["recent_alerts"], lambda r: entry(
            4, F.coalesce(present(r["transaction_id"]), present(r["alert_id"])), "cassandra_history")),
        F.transform(live["previous_investigations"], lambda r: entry(
            5, F.coalesce(present(r["alert_id"]), present(r["investigation_id"])), "cassandra_history")),
        F.transform("regulatory_context", lambda r: entry(6, r["document_id"], "rbi_knowledge")),
        F.transform(F.col("historical_paysim_context")["fraud_cases"], lambda r: entry(7, r["document_id"], F.when(
            F.lower(r["label"].cast("string")) == "fraud", "paysim_fraud").otherwise("paysim_normal"))),
        F.transform(F.col("historical_paysim_context")["normal_cases"], lambda r: entry(
            8, r["document_id"], "paysim_normal")),
    ]
    named = F.filter(F.concat(*lists), lambda e: present(e["source_id"]).isNotNull())
    ordered = F.sort_array(F.transform(named, lambda e: F.struct(e["source_id"], e["source_order"], e["source_type"])))
    latest = bound(ordered, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["source_id"] != e["source_id"], F.lit(True))))

    def entries(rows: DataFrame) -> DataFrame:
        return rows.select("alert_id", F.inline(latest))

    # The sources of an alert stand in its row; only rows that share their alert's id have to meet.
    again = _scratch_table(contexts.groupBy("alert_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("alert_id").alias("_again")), "repeated-alerts")
    shared = again.count()
    if not shared:
        return entries(contexts).select("alert_id", "source_id", "source_type")
    met, rest = contexts, None
    if shared <= BROADCAST_KEYS:
        same = F.col("alert_id").eqNullSafe(F.col("_again"))
        met, rest = contexts.join(F.broadcast(again), same, "left_semi"), contexts.join(F.broadcast(again), same, "left_anti")
    grouped = entries(met).groupBy("alert_id", "source_id").agg(F.max_by("source_type", "source_order").alias("source_type"))
    return grouped if rest is None else grouped.unionByName(entries(rest).select("alert_id", "source_id", "source_type"))


def _scratch_table(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the scratch folder, so that they are worked out once."""
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checked_citations(citations: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations whose id exists with the same source type, the rest).

    Of the catalogue, only sources that some alert cites are brought to the citations, if these are few enough to be sent to it.
    """
    keys = ["alert_id", "source_id", "source_type"]
    cited = _scratch_table(citations.select("source_id", "source_type").distinct(), "cited-sources")
    known = catalogue.select(*keys)
    if cited.count() <= BROADCAST_KEYS:
        known = known.join(F.broadcast(cited), ["source_id", "source_type"], "left_semi")
    flag = "_known" + "_" * max(map(len, citations.columns))
    # Written, so that the catalogue is worked out and shuffled once for both results.
    marked = _scratch_table(citations.join(known.distinct().withColumn(flag, F.lit(True)), keys, "left"), "checked-citations")
    return marked.where(F.col(flag).isNotNull()).drop(flag), marked.where(F.col(flag).isNull()).drop(flag)


def live_behavior_sentence() -> Column:
    def movement(label: str, old: str, new: str) -> Column:
        before, after = F.col(old), F.col(new)
        return F.when(before != after, F.concat(
            F.lit(f"{label} balance moved from "), before.cast("string"), F.lit(" to "), after.cast("string")))

    moves = F.concat_ws(" and ", movement("origin", "old_balance_orig", "new_balance_orig"),
                        movement("destination", "old_balance_dest", "new_balance_dest"))
    amount = F.coalesce(F.concat(F.lit(" for amount "), F.col("amount").cast("string")), F.lit(""))
    return F.concat(F.lit("The current "), F.coalesce(F.col("transaction_type"), F.lit("transaction")),
                    F.lit(" transaction"), amount,
                    F.when(moves != "", F.concat(F.lit(" has "), moves)).otherwise(""), F.lit("."))


def case_comparison_sentence(text: str = "text", metadata: str = "metadata") -> Column:
    """Sentence over the fields a historical case states about itself."""
    meta = F.col(metadata)
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    change = F.coalesce(meta["balance_change_amount"].cast("string"), F.lit("0"))
    decreased = F.contains(body, F.lit("origin balance decreased")) | ~change.isin("0", "0.0")
    increased = F.contains(body, F.lit("destination balance increased")) | F.coalesce(
        meta["destination_balance_increased"], F.lit(False))
    behaviors = F.concat_ws(" and ", F.when(decreased, "origin balance decreased"),
                            F.when(increased, "destination balance increased"))
    label = F.coalesce(F.nullif(F.lower(meta["label"]), F.lit("")), F.lit("unlabeled"))
    return F.concat(F.concat_ws(
        "; ", F.concat(F.lit("Synthetic PaySim "), label, F.lit(" reference")),
        F.concat(F.lit("transaction type "), meta["transaction_type"]),
        F.concat(F.lit("recorded amount "), meta["amount"].cast("string")),
        F.when(behaviors != "", F.concat(F.lit("observed "), behaviors))),
        F.lit(". Similarity does not establish fraud in the current alert."))


# Question classes in the order they are tried, and their evidence limits.
INTENT_PATTERNS = {
    "regulatory": r"\brbi\b|reserve bank|regulat|early.warning|(?:\bews\b)|\brfa\b",
    "historical": r"historical|historically|paysim|synthetic|compare|similar cases|past cases",
    "account": r"account|previous|prior|before|history",
    "transaction": r"transaction|alert|flagged|risk|decision|fraud",
}
EVIDENCE_LIMITS = {"recent_transactions": 2, "recent_alerts": 1, "previous_investigations": 1, "knowledge": 3, "cases": 2}
KNOWLEDGE_TEXT_CHARS = 1200
CASE_TEXT_CHARS = 1000


#: Fields of a history item that an answer may quote, and the ids of which the first one names it: fixed values.
HISTORY_FACTS = (
    "transaction_id", "alert_id", "event_time", "transaction_type", "amount", "name_orig", "name_dest", "old_balance_orig",
    "new_balance_orig", "old_balance_dest", "new_balance_dest", "risk_level", "risk_action", "anomaly_score", "xgboost_probability",
    "xgboost_prediction", "final_prediction", "final_decision_path", "model_version", "investigation_id", "investigation_status", "status",
)
HISTORY_IDS = ("transaction_id", "alert_id", "investigation_id")
HISTORY_TEXTS, HISTORY_TEXT_CHARS, HISTORY_POINTS = ("investigation_summary", "risk_reasoning"), 800, 3
NO_HISTORY = "No relevant history was retrieved."
NO_KNOWLEDGE = "No relevant regulatory/domain evidence was retrieved."
NO_CASES = "No synthetic PaySim {} cases were retrieved."


def question_intent(question: str | Column) -> Column:
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    chain = F
    for name, pattern in INTENT_PATTERNS.items():
        chain = chain.when(text.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit("general"))


def select_evidence(df: DataFrame, question: str = "question", limits: Mapping[str, int] = EVIDENCE_LIMITS) -> DataFrame:
    """Evidence lists an answer may use, by question class.

    ``knowledge`` items carry authority and source_type; a regulatory question
    keeps primary texts of the regulator only. ``cases`` keep two per label.
    ``history`` has source_id and content (JSON of the facts that are present) of the account's listed items, without those that
    lack an id or are the current transaction (``transaction_id``, if there is such a column). ``missing`` says in sentences what
    was looked for in vain. A list that the question's class does not use is null.
    """
    intent = F.col("intent")
    uses_history = intent.isin("transaction", "historical", "account")
    uses_knowledge, uses_cases = intent.isin("transaction", "historical", "regulatory"), intent.isin("transaction", "historical")

    def primary(item: Column) -> Column:
        return (F.lower(item["authority"]) == "rbi") & (F.lower(item["source_type"]) == "primary_regulatory")

    def clipped(items: Column, chars: int) -> Column:
        return F.transform(items, lambda i: i.withField("text", F.substring(i["text"], 1, chars)))

    def labelled_cases(fraud: bool) -> Column:
        wanted = F.filter("cases", lambda c: F.lower(c["label"].cast("string")).isin("fraud", "1", "true") == fraud)
        return F.slice(wanted, 1, limits["cases"])

    allowed = F.when(intent == "regulatory", F.filter("knowledge", primary)).otherwise(F.col("knowledge"))
    asked = question_intent(question)
    # A general question about a transaction is answered like a transaction question.
    chosen = df.withColumn("intent", F.when(asked == "general", "transaction").otherwise(asked))
    listed = [name for name in ("recent_transactions", "recent_alerts", "previous_investigations") if name in df.columns]
    items = F.concat(*[_history_items(df, name, limits[name]) for name in listed]) if listed else None
    history = {}
    if items is not None:
        current = F.col("transaction_id").cast("string") if "transaction_id" in df.columns else F.lit(None).cast("string")
        named = F.filter(items, lambda i: i["source_id"].isNotNull() & ~F.coalesce(i["source_id"] == current, F.lit(False)))
        history = {"history": F.when(uses_history, named)}

    def sentence(used: Column, found: Column, text: str) -> Column:
        return F.when(used & (F.coalesce(found, F.lit(0)) <= 0), F.lit(text))

    chosen = chosen.withColumns({
        **{name: F.when(uses_history, F.slice(name, 1, limits[name])) for name in listed}, **history,
        "knowledge": F.when(uses_knowledge, clipped(F.slice(allowed, 1, limits["knowledge"]), KNOWLEDGE_TEXT_CHARS)),
        "cases": F.when(uses_cases, clipped(F.concat(labelled_cases(True), labelled_cases(False)), CASE_TEXT_CHARS)),
    })
    # Items count as retrieved before those without a name are left out.
    retrieved = sum((F.coalesce(F.size(name), F.lit(0)) for name in listed), F.lit(0))
    labels = F.transform("cases", lambda c: F.lower(c["label"].cast("string")).isin("fraud", "1", "true"))
    sentences = [sentence(uses_history, F.greatest(retrieved, F.lit(0)), NO_HISTORY)] if listed else []
    sentences += [sentence(uses_knowledge, F.size("knowledge"), NO_KNOWLEDGE)]
    sentences += [sentence(uses_cases, F.size(F.filter(labels, lambda x: F.coalesce(x, F.lit(False)) == fraud)), NO_CASES.format(name))
                  for name, fraud in (("fraud", True), ("normal", False))]
    return chosen.withColumn("missing", F.array_compact(F.array(*sentences)))


def _history_items(df: DataFrame, name: str, most: int) -> Column:
    """The first ``most`` items of the list ``name`` as (source_id, content)."""
    fields = df.schema[name].dataType.elementType

    def facts(item: Column) -> Column:
        values = [item[f].alias(f) for f in HISTORY_FACTS if f in fields.names]
        values += [F.nullif(F.substring(item[f].cast("string"), 1, HISTORY_TEXT_CHARS), F.lit("")).alias(f)
                   for f in HISTORY_TEXTS if f in fields.names]
        if "recommended_review_points" in fields.names:
            points = item["recommended_review_points"]
            listed = isinstance(fields["recommended_review_points"].dataType, T.ArrayType)
            values.append((F.slice(points, 1, HISTORY_POINTS) if listed else F.substring(points.cast("string"), 1, HISTORY_TEXT_CHARS))
                          .alias("recommended_review_points"))
        return F.to_json(F.struct(*values)) if values else F.lit("{}")

    def item(row: Column) -> Column:
        ids = [F.nullif(row[f].cast("string"), F.lit("")) for f in HISTORY_IDS if f in fields.names]
        return F.struct(F.coalesce(*ids, F.lit(None).cast("string")).alias("source_id"), facts(row).alias("content"))

    return F.coalesce(F.transform(F.slice(name, 1, most), item), F.array().cast("array<struct<source_id:string,content:string>>"))
