"""Checks over stored results and generated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.operators.validate import violations

# Contract of a result document.
PAYLOAD_KEYS = ["investigation_summary", "evidence", "risk_factors", "counter_evidence", "missing_evidence",
                "historical_comparison", "regulatory_references", "uncertainties", "recommended_review_points"]
RESULT_ONLY_KEYS = ["alert_assessment", "investigation_id", "alert_id", "transaction_id", "generated_at",
                    "investigation_status", "llm_model", "rag_version"]
OPTIONAL_RESULT_KEYS = ["error_category", "missing_key", "invalid_field"]
STRING_LISTS = ["risk_factors", "counter_evidence", "missing_evidence", "uncertainties", "recommended_review_points"]
SOURCE_TYPES = ["live_transaction", "cassandra_history", "model_output", "rbi_knowledge", "paysim_fraud",
                "paysim_normal", "missing_evidence"]
RESULT_STATUSES = ["completed", "partial", "insufficient_evidence", "failed"]
ASSESSMENT_KEYS = ["risk_level", "model_prediction", "anomaly_score", "xgboost_probability", "decision_path"]
REFERENCE_KEYS = ["source_id", "source_file", "source_pages", "authority", "status", "reference"]
CASE_GROUPS = ["fraud_cases", "normal_cases"]


def _get(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    """STRING, OBJECT<…>, ARRAY<…>, VOID (a JSON null) …; null when absent."""
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(_kind(value), F.lit(kind)), F.lit(False))


def _items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))


def _bad_evidence(item: Column) -> Column:
    source_type = _text(item, "source_type")
    return (~_is(item, "OBJECT") | ~F.coalesce(source_type.isin(SOURCE_TYPES), F.lit(False))
            | (F.coalesce(_text(item, "source_id"), F.lit("")) == "") | ~_is(_get(item, "finding"), "STRING"))


def _without(item: Column, keys: Sequence[str], strings: bool) -> Column:
    """Not an object, or one of the keys is absent (or not a string)."""
    bad = ~_is(item, "OBJECT")
    for key in keys:
        value = _get(item, key)
        bad = bad | (~_is(value, "STRING") if strings else value.isNull())
    return bad


def _parsed(df: DataFrame, json: str) -> DataFrame:
    """Parse once; the rules read the parsed column many times."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    groups = F.json_object_keys(F.get_json_object(json, "$.historical_comparison"))
    return df.withColumns({"_doc": F.try_parse_json(json), "_keys": keys,
                           "_groups": F.coalesce(groups, F.array().cast("array<string>"))})


def _shape_rules(doc: Column, keys: Column, required: Sequence[str], allowed: Sequence[str], stored: bool) -> dict[str, Column]:
    is_object = _is(doc, "OBJECT")
    rules: dict[str, Column] = {"root": ~is_object}
    rules["unsupported_key"] = is_object & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0)
    for key in required:
        rules[f"missing:{key}"] = is_object & ~F.array_contains(keys, key)
    here = lambda key: F.array_contains(keys, key)  # noqa: E731 - one-line predicate
    summary = _get(doc, "investigation_summary")
    rules["invalid:investigation_summary"] = here("investigation_summary") & (
        ~_is(summary, "STRING") | _blank(_text(doc, "investigation_summary")))
    for key in (*STRING_LISTS, "evidence", "regulatory_references"):
        rules[f"not_array:{key}"] = here(key) & ~_is(_get(doc, key), "ARRAY")
    for key in STRING_LISTS:
        def bad_text(item: Column) -> Column:
            wrong = ~_is(item, "STRING")
            return wrong | _blank(F.try_variant_get(item, "$", "string")) if stored else wrong

        rules[f"not_strings:{key}"] = F.exists(_items(_get(doc, key)), bad_text)
    comparison = _get(doc, "historical_comparison")
    # A generated payload may hold more groups, a stored result may not.
    wrong_group = F.lit(stored) & (F.size(F.array_except("_groups", F.array(*[F.lit(g) for g in CASE_GROUPS]))) > 0)
    for group in CASE_GROUPS:
        wrong_group = wrong_group | ~_is(_get(comparison, group), "ARRAY")
    rules["invalid:historical_comparison"] = here("historical_comparison") & (~_is(comparison, "OBJECT") | wrong_group)
    for group in CASE_GROUPS:
        rules[f"invalid:historical_comparison.{group}"] = F.exists(
            _items(_get(comparison, group)), lambda i: _without(i, ["source_id", "comparison"], not stored))
    rules["invalid:evidence"] = F.exists(_items(_get(doc, "evidence")), _bad_evidence)
    reference_keys = REFERENCE_KEYS if stored else ["source_id", "reference"]
    rules["invalid:regulatory_references"] = F.exists(
        _items(_get(doc, "regulatory_references")), lambda i: _without(i, reference_keys, not stored))
    return rules


def check_payloads(df: DataFrame, json: str) -> DataFrame:
    """Adds ``violations``: every rule that a generated payload breaks, in rule order."""
    rules = _shape_rules(F.col("_doc"), F.col("_keys"), PAYLOAD_KEYS, PAYLOAD_KEYS, stored=False)
    return _parsed(df, json).withColumn("violations", violations(rules)).drop("_doc", "_keys", "_groups")


def check_results(df: DataFrame, json: str) -> DataFrame:
    """Adds ``violations`` of a stored result: keys, status set and nested shapes."""
    doc = F.col("_doc")
    required = [*PAYLOAD_KEYS, *RESULT_ONLY_KEYS]
    rules = _shape_rules(doc, F.col("_keys"), required, [*required, *OPTIONAL_RESULT_KEYS], stored=True)
    # A key with a JSON null is there, and null is no valid value.
    here = lambda key: F.array_contains("_keys", key)  # noqa: E731 - one-line predicate
    known = F.coalesce(_text(doc, "investigation_status").isin(RESULT_STATUSES), F.lit(False))
    rules["invalid:investigation_status"] = here("investigation_status") & ~known
    assessment = _get(doc, "alert_assessment")
    rules["invalid:alert_assessment"] = here("alert_assessment") & _without(assessment, ASSESSMENT_KEYS, False)
    return _parsed(df, json).withColumn("violations", violations(rules)).drop("_doc", "_keys", "_groups")


def investigation_status(status: str = "retrieval_status", missing: str = "missing_evidence") -> Column:
    """completed when every source delivered and nothing is missing."""
    values = F.array(*[F.col(f"{status}.{name}") for name in ("cassandra", "fraud_knowledge", "paysim_cases")])
    complete = F.forall(values, lambda v: v == "success") & (F.size(missing) == 0)
    return F.when(complete, "completed").when(
        F.exists(values, lambda v: v == "success"), "partial").otherwise("insufficient_evidence")


# Patterns and replacement texts of the claim checks.
UNSAFE_CLAIM = (
    r"(?i)(?:paysim|similarity|similar case|xgboost probability|model probability|model output).{0,100}"
    r"(?:proves?|confirms?|establishes?|demonstrates?).{0,60}fraud"
    r"|(?:fraud).{0,60}(?:proven|confirmed|established).{0,60}(?:paysim|similarity|probability|model)")
REGULATOR_CLAIM = (
    r"(?i)(?:RBI|Reserve Bank of India).{0,180}(?:balance|origin|destination|decrease|increase).{0,100}"
    r"(?:suspicious|fraud|indicator|pattern)"
    r"|(?:balance|origin|destination).{0,100}(?:RBI|Reserve Bank of India).{0,100}"
    r"(?:prescribed|defines?|says|states|indicator)")
CUSTOMER_TERMS = ["occupation", "located in", "location", "city", "kyc status", "kyc verified", "ip address", "device id",
                  "customer intent", "transaction purpose", "beneficiary relationship", "law enforcement confirmed"]
HISTORICAL_MENTION = r"(?i)paysim|historical case|historical transaction"
MODEL_VALUE = r"(?i)(anomaly[_ ]score|xgboost[_ ]probability|risk[_ ]level|final[_ ]prediction|decision[_ ]path)"
BALANCE_CONCEPT = r"(?i)balance|origin|destination"
SOFTENED = {
    r"(?i)no previous alerts exist": "no previous alerts were retrieved",
    r"(?i)no previous investigations exist": "no previous investigations were retrieved",
    r"(?i)the account has no history": "no relevant account history was retrieved from Cassandra",
    r"(?i)no account history exists": "no relevant account history was retrieved from Cassandra",
}
WITHHELD_PROOF = ("Claim withheld: model output and synthetic PaySim similarity are not proof. "
                  "Validate against source evidence.")
WITHHELD_SUMMARY = ("The available model signals and synthetic historical similarities are contextual only. They do not "
                    "establish fraud; review the live evidence and resolve the listed uncertainties.")
WITHHELD_CUSTOMER = "Claim withheld: no supporting customer/account detail was retrieved."
WITHHELD_LEAK = "Claim withheld: current alert model outputs cannot be attributed to historical PaySim cases."
WITHHELD_REGULATOR = (
    "Regulatory fact: the retrieved RBI text covers EWS/RFA and transaction monitoring. Investigation inference: the "
    "observed balance movements may be reviewed, but the retrieved text does not define this exact pattern as an "
    "RBI-prescribed indicator.")
ANSWER_FLAGS = {
    "occupation": r"(?i)\b(?:works as|occupation is|is employed as|customer is a)\b",
    "device": r"(?i)\b(?:uses an? (?:iphone|android|device)|device (?:is|was))\b",
    "ip_address": r"(?i)\b(?:ip(?: address)? is|ip address:?)\s*\d{1,3}(?:\.\d{1,3}){3}\b",
    "historical_score": r"(?i)\b(?:paysim|historical case).{0,40}(?:score was|anomaly score)\s*[:=]?\s*\d",
    "definitive_fraud": r"(?i)\b(?:definitely|certainly|proves?) fraud\b",
}
STOP_WORDS = """about after again also and are because been before case does evidence from historical how into this that
the their there these they through what when where which with would your""".split()
ABSENCE_PHRASES = ["not present", "not available", "no relevant", "not retrieved", "missing evidence"]


def soften_claims(text: Column) -> Column:
    for pattern, replacement in SOFTENED.items():
        text = F.regexp_replace(text, pattern, replacement)
    return text


def claim_flags(text: Column, sources: Column, case_fields: Column, regulatory_text: Column) -> dict[str, Column]:
    """Unsupported claims in a text, each as a boolean.

    ``sources`` is the live evidence as text, ``case_fields`` the names of fields
    the historical cases carry, ``regulatory_text`` the retrieved regulatory text.
    """
    folded, known = F.lower(text), F.lower(F.coalesce(sources, F.lit("")))
    customer = F.lit(False)
    for term in CUSTOMER_TERMS:
        customer = customer | (F.contains(folded, F.lit(term)) & ~F.contains(known, F.lit(term)))
    named = F.replace(F.lower(F.regexp_extract(text, MODEL_VALUE, 1)), F.lit(" "), F.lit("_"))
    carried = F.coalesce(F.array_contains(case_fields, named), F.lit(False)) | (
        (named == "decision_path") & F.coalesce(F.array_contains(case_fields, "final_decision_path"), F.lit(False)))
    supported = F.coalesce(regulatory_text, F.lit("")).rlike(BALANCE_CONCEPT) & text.rlike(BALANCE_CONCEPT)
    # One pass finds whether any term occurs at all; most texts stop there.
    customer = folded.rlike("|".join(CUSTOMER_TERMS)) & customer
    return {
        "proof_claim": text.rlike(UNSAFE_CLAIM),
        "customer_claim": customer,
        "model_leak": text.rlike(HISTORICAL_MENTION) & (named != "") & ~carried,
        "regulator_claim": text.rlike(REGULATOR_CLAIM) & ~supported,
    }


def guarded_claim(text: Column, sources: Column, case_fields: Column, regulatory_text: Column,
                  summary: bool = False) -> Column:
    """The text with unsupported claims withheld; checks run in a fixed order."""
    none = F.lit(False)
    proof = F.lit(WITHHELD_SUMMARY if summary else WITHHELD_PROOF)
    soft = soften_claims(text)
    first = F.when(soft.rlike(UNSAFE_CLAIM), proof).otherwise(soft)
    leak = claim_flags(first, sources, case_fields, regulatory_text)["model_leak"]
    second = first if summary else F.when(leak, WITHHELD_LEAK).otherwise(first)
    regulator = claim_flags(second, sources, case_fields, regulatory_text)["regulator_claim"]
    third = F.when(regulator, WITHHELD_REGULATOR).otherwise(second)
    customer = claim_flags(third, sources, case_fields, regulatory_text)["customer_claim"]
    return F.when(F.coalesce(customer, none), WITHHELD_CUSTOMER).otherwise(third)


def keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def number_literals(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?U)((?<!\w)[-+]?\d+(?:\.\d+)?(?!\w))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"^\++", "")))


def assess_answers(df: DataFrame, question: str = "question", answer: str = "answer", evidence: str = "evidence_text",
                   cited: str = "cited", missing: str = "missing") -> DataFrame:
    """Keyword overlap, numeric grounding, attribution and absence wording per answer.

    ``cited`` holds structs with source_id and source_type, ``missing`` the
    missing-evidence sentences of the answer.
    """
    asked, said = keywords(F.col(question)), keywords(F.col(answer))
    numbers, known = number_literals(F.col(answer)), number_literals(F.coalesce(F.col(evidence), F.lit("")))
    complete = F.filter(cited, lambda c: (F.coalesce(c["source_id"], F.lit("")) != "")
                        & (F.coalesce(c["source_type"], F.lit("")) != ""))
    folded = F.lower(answer)
    admits = F.lit(False)
    for phrase in ABSENCE_PHRASES:
        admits = admits | F.contains(folded, F.lit(phrase))
    return df.withColumns({
        "relevance_keyword_overlap": F.round(
            F.size(F.array_intersect(said, asked)) / F.greatest(F.size(asked), F.lit(1)), 4),
        "numeric_grounding_fraction": F.round(F.when(
            F.size(numbers) > 0, F.size(F.array_intersect(numbers, known)) / F.size(numbers)).otherwise(1.0), 4),
        "source_attribution_completeness": F.round(
            F.size(complete) / F.greatest(F.size(cited), F.lit(1)), 4),
        "missing_evidence_acknowledged": F.when(F.size(missing) > 0, admits.cast("double")),
        "unsupported_claim_flags": violations({name: F.col(answer).rlike(p) for name, p in ANSWER_FLAGS.items()}),
    })
