"""Case corpus: one document per chosen transaction, one profile per linked account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.ids import content_id
from tallywatch.functions.text import as_decimal, decimal_difference, present
from tallywatch.operators.ordered import leading_rows

# Field titles, phrases and sizes of the corpus.
FIELD_TITLES = {
    "step": "Step", "type": "Transaction type", "amount": "Amount", "nameOrig": "Origin account",
    "oldbalanceOrg": "Origin balance before", "newbalanceOrig": "Origin balance after",
    "nameDest": "Destination account", "oldbalanceDest": "Destination balance before",
    "newbalanceDest": "Destination balance after", "isFraud": "Fraud label",
    "isFlaggedFraud": "Flagged by source dataset",
}
OBSERVED = "Observed transactional characteristics: "
MAX_NORMAL_CASES = 10_000
MAX_ACCOUNT_PROFILES = 50_000


def _line(name: str, title: str) -> Column:
    value = present(F.col(name))
    if name == "isFraud":
        value = F.when(value.isNotNull(), F.when(as_decimal(value) == 1, "FRAUD").otherwise("NORMAL"))
    return F.concat(F.lit(f"{title}: "), value)


def _origin_phrase(old: Column, new: Column) -> Column:
    before, after = as_decimal(old), as_decimal(new)
    said = (
        F.when((before > 0) & (after == 0), F.lit("was depleted to zero after the transaction."))
        .when((before == 0) & (after == 0), F.lit("had zero balance before and after the transaction."))
        .when(before == after, F.concat(F.lit("was unchanged at "), old, F.lit(" before and after the transaction.")))
        .when(after < before, F.concat(F.lit("decreased from "), old, F.lit(" to "), new, F.lit(".")))
        .when(after > before, F.concat(F.lit("increased from "), old, F.lit(" to "), new, F.lit(".")))
    )
    subject = F.when((before == 0) & (after == 0), "Origin account ").otherwise("Origin account balance ")
    return F.concat(F.lit(OBSERVED), subject, said)


def _destination_phrase(old: Column, new: Column) -> Column:
    before, after = as_decimal(old), as_decimal(new)
    said = (
        F.when(after > before, F.concat(F.lit("increased from "), old, F.lit(" to "), new))
        .when(after == before, F.concat(F.lit("was unchanged at "), old))
        .when(after < before, F.concat(F.lit("decreased from "), old, F.lit(" to "), new))
    )
    return F.concat(F.lit(OBSERVED + "Destination account balance "), said, F.lit("."))


def case_documents(df: DataFrame, label: str) -> DataFrame:
    """Text and metadata of each row; absent fields leave no trace.

    Columns are the CSV columns as text plus ``source_row_id``.
    """
    have = [name for name in FIELD_TITLES if name in df.columns]
    columns = {name: present(F.col(name)) if name in have else F.lit(None).cast("string") for name in FIELD_TITLES}
    old_o, new_o = columns["oldbalanceOrg"], columns["newbalanceOrig"]
    old_d, new_d = columns["oldbalanceDest"], columns["newbalanceDest"]
    title = f"Historical PaySim {'Fraud' if label == 'fraud' else 'Normal'} Case"
    body = F.concat_ws("\n", F.lit(title), *[_line(name, FIELD_TITLES[name]) for name in have],
                       _origin_phrase(old_o, new_o), _destination_phrase(old_d, new_d))
    a, b, c, d = as_decimal(old_o), as_decimal(new_o), as_decimal(old_d), as_decimal(new_d)
    metadata = F.struct(
        F.lit("paysim").alias("source_type"),
        F.lit("fraud_case" if label == "fraud" else "normal_case").alias("document_type"),
        F.lit("PaySim").alias("dataset"), F.lit(label).alias("label"),
        F.coalesce(columns["type"], F.lit("unknown")).alias("transaction_type"),
        F.col("source_row_id").cast("string").alias("source_row_id"),
        columns["isFraud"].alias("isFraud"), columns["step"].alias("step"), columns["amount"].alias("amount"),
        ((a > 0) & (b == 0)).alias("origin_balance_depleted"), (a == b).alias("origin_balance_unchanged"),
        F.when(a.isNotNull() & b.isNotNull(), decimal_difference(new_o, old_o)).alias("balance_change_amount"),
        (d > c).alias("destination_balance_increased"), (d == c).alias("destination_balance_unchanged"))
    return df.select(
        content_id(f"paysim_{label}", F.col("source_row_id")).alias("document_id"), body.alias("text"),
        metadata.alias("metadata"))


def is_fraud_row(name: str = "isFraud") -> Column:
    return F.coalesce(F.col(name).try_cast("double").cast("int") == 1, F.lit(False))


def sample_digest(ordinal: Column) -> Column:
    """Hash that decides which normal rows are kept; ``ordinal`` counts rows from 0."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("step", "type", "nameOrig", "nameDest", "amount")]
    return F.sha2(F.concat_ws("|", *parts, (ordinal.cast("long") + 1).cast("string")), 256)


def sampled_normal_rows(df: DataFrame, k: int = MAX_NORMAL_CASES, ordinal: str = "source_row_id") -> DataFrame:
    """The k normal rows with the smallest hash: the same rows in any input order."""
    if k <= 0:
        return df.limit(0)
    hashed = df.where(~is_fraud_row()).withColumn("_digest", sample_digest(F.col(ordinal)))
    # The first 13 hex digits fit a double exactly and grow with the digest.
    position = F.conv(F.substring("_digest", 1, 13), 16, 10).cast("long")
    return leading_rows(hashed, "_digest", k, position=position).drop("_digest")


def fraud_rows(df: DataFrame) -> DataFrame:
    return df.where(is_fraud_row())


def fraud_linked_accounts(df: DataFrame) -> DataFrame:
    """Both ends of every fraud row."""
    ends = F.explode(F.array(F.col("nameOrig"), F.col("nameDest"))).alias("account")
    return fraud_rows(df).select(ends).where(present(F.col("account")).isNotNull()).distinct()


def account_profiles(df: DataFrame, ordinal: str = "source_row_id") -> DataFrame:
    """Totals per fraud-linked account over every row in which it takes part.

    An account is linked exactly when one of its own rows is fraud, so the link
    is a condition on the aggregate and needs no join. Rows merge per account
    and type before the shuffle; a row to oneself counts twice.
    """
    sides = F.array(
        F.struct(F.col("nameOrig").alias("account"), F.lit("origin").alias("role"), F.lit(0).alias("side")),
        F.struct(F.col("nameDest").alias("account"), F.lit("destination").alias("role"), F.lit(1).alias("side")))
    money, step = F.col("amount").try_cast("double"), F.col("step").try_cast("int")
    entries = df.select(
        F.col("type").cast("string").alias("type"), money.alias("amount"), step.alias("step"),
        is_fraud_row().cast("long").alias("fraud"), F.col(ordinal).cast("long").alias("ordinal"), F.inline(sides))
    per_type = entries.where(F.col("account").isNotNull()).groupBy("account", "type").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("fraud").alias("fraud"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.max(F.struct("ordinal", "side", "role")).alias("last"))
    return per_type.groupBy("account").agg(
        F.sum("n").alias("transaction_count"), F.sum("fraud").alias("fraud_transaction_count"),
        F.sum("amount").alias("total_amount"), F.min("first_step").alias("first_step"),
        F.max("last_step").alias("last_step"), F.max("last")["role"].alias("role"),
        F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"),
    ).where("fraud_transaction_count > 0")


def profile_documents(df: DataFrame, limit: int = MAX_ACCOUNT_PROFILES, ordinal: str = "source_row_id") -> DataFrame:
    """Profile texts of the first accounts by name."""
    # The first six bytes as a number grow with the name in byte order.
    prefix = F.rpad(F.hex(F.substring(F.encode("account", "UTF-8"), 1, 6)), 12, "0")
    chosen = leading_rows(account_profiles(df, ordinal), "account", limit, position=F.conv(prefix, 16, 10).cast("long"))
    types = F.array_join(F.transform("types", lambda t: F.concat(
        F.lit('"'), t["type"], F.lit('": '), t["n"].cast("string"))), ", ")
    amount = F.round("total_amount", 2).cast("decimal(38,2)").cast("string")
    body = F.concat(
        F.lit("PaySim account behavior profile\nAccount: "), F.col("account"),
        F.lit("\nObserved role: "), F.col("role"), F.lit("\nTransactions: "), F.col("transaction_count").cast("string"),
        F.lit("\nFraud-labeled transactions: "), F.col("fraud_transaction_count").cast("string"),
        F.lit("\nTotal observed amount: "), amount, F.lit("\nTransaction types: {"), types,
        F.lit("}\nObserved step range: "), F.col("first_step").cast("string"), F.lit(" to "),
        F.col("last_step").cast("string"))
    return chosen.select(
        content_id("paysim_account", F.col("account")).alias("document_id"), body.alias("text"),
        F.struct(F.lit("paysim").alias("source_type"), F.lit("account_behavior_profile").alias("document_type"),
                 F.lit("PaySim").alias("dataset"), F.col("account").alias("account_id"), "transaction_count",
                 "fraud_transaction_count", "total_amount", "first_step", "last_step").alias("metadata"))


def changed_documents(produced: DataFrame, stored: DataFrame, key: str = "document_id",
                      compared: tuple[str, ...] = ("text",)) -> DataFrame:
    """Produced documents that are new or differ from the stored ones."""
    old = stored.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in compared], F.lit(True).alias("_stored"))
    same = F.col("_stored").isNotNull()
    for name in compared:
        same = same & F.col(name).eqNullSafe(F.col(f"_old_{name}"))
    return (produced.join(old, key, "left")
            .withColumn("change", F.when(F.col("_stored").isNull(), "new").when(~same, "changed"))
            .where(F.col("change").isNotNull()).select(*produced.columns, "change"))


def pruned_documents(stored: DataFrame, produced: DataFrame, source_type: str, key: str = "document_id") -> DataFrame:
    """Stored documents without those of this source that are no longer produced."""
    gone = stored.where(F.col("source_type") == source_type).join(produced.select(key), key, "left_anti").select(key)
    return stored.join(gone, key, "left_anti")


def corpus_counts(rows: DataFrame, fraud: DataFrame, normal: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sizes of the built tables as one row."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in (
        ("rows_processed", rows), ("fraud_documents", fraud), ("normal_documents", normal),
        ("account_profiles", profiles))]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


def build_manifest(counts: DataFrame, chunks: DataFrame, **settings: object) -> DataFrame:
    """Counts of files, chunks and corpus tables with the settings used."""
    chunk_row = chunks.agg(F.count_distinct("relative_path").alias("knowledge_files"),
                           F.count("*").alias("knowledge_chunks"))
    both = counts.unionByName(chunk_row, allowMissingColumns=True)
    row = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
    return row.withColumns({f"setting_{name}": F.lit(value) for name, value in settings.items()})
