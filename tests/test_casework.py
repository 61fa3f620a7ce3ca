from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.operators import chunking, corpus, evidence, quality, retrieve

TEXT_ROW = ("step string, type string, amount string, nameOrig string, oldbalanceOrg string, newbalanceOrig string, "
            "nameDest string, oldbalanceDest string, newbalanceDest string, isFraud string, isFlaggedFraud string, source_row_id long")


def case(spark, old_o="100.00", new_o="0.00", old_d="20.00", new_d="220.00", fraud="1", row=0, orig="C1", dest="C2"):
    return ("1", "TRANSFER", "200.00", orig, old_o, new_o, dest, old_d, new_d, fraud, "0", row)


@pytest.mark.parametrize("old,new,delta,phrase,depleted,unchanged", [
    ("100.00", "0.00", "-100.00", "was depleted to zero", True, False),
    ("0.00", "0.00", "0.00", "had zero balance before and after", False, True),
    ("100.00", "40.00", "-60.00", "decreased from 100.00 to 40.00", False, False),
    ("30.00", "30.00", "0.00", "was unchanged at 30.00 before", False, True),
    ("5", "7.5", "2.5", "increased from 5 to 7.5", False, False),
    ("9007199254740993.01", "9007199254740993.02", "0.01", "increased", False, False)])
def test_case_phrases(spark, old, new, delta, phrase, depleted, unchanged):
    df = spark.createDataFrame([case(spark, old_o=old, new_o=new)], TEXT_ROW)
    row = corpus.case_documents(df, "fraud").first()
    assert phrase in row["text"] and row["text"].startswith("Historical PaySim Fraud Case\nStep: 1\nTransaction type: TRANSFER")
    meta = row["metadata"]
    assert (meta["balance_change_amount"], meta["origin_balance_depleted"], meta["origin_balance_unchanged"]) == (delta, depleted, unchanged)
    assert meta["destination_balance_increased"] is True
    assert row["document_id"] == "paysim_fraud_" + hashlib.sha256(b"0").hexdigest()


def test_absent_fields_leave_no_trace(spark):
    df = spark.createDataFrame([case(spark, old_o=None, new_d="")], TEXT_ROW)
    row = corpus.case_documents(df, "normal").first()
    assert "Observed" not in row["text"] and "Origin balance before" not in row["text"]
    assert row["metadata"]["origin_balance_depleted"] is None and row["metadata"]["balance_change_amount"] is None


def test_corpus_counts_and_profiles(spark):
    rows = [case(spark, row=0, orig="C1", dest="C2"), case(spark, row=1, fraud="0", orig="C3", dest="C1"),
            case(spark, row=2, fraud="0", orig="C4", dest="C4")]
    df = spark.createDataFrame(rows, TEXT_ROW)
    parts = (df, corpus.fraud_rows(df), corpus.sampled_normal_rows(df, 1), corpus.profile_documents(df))
    assert tuple(corpus.corpus_counts(*parts).first()) == (3, 1, 1, 2)
    profiles = {r["account"]: r for r in corpus.account_profiles(df).collect()}
    assert set(profiles) == {"C1", "C2"} == {r["account"] for r in corpus.fraud_linked_accounts(df).collect()}
    assert (profiles["C1"]["transaction_count"], profiles["C1"]["role"]) == (2, "destination")
    text = {r["metadata"]["account_id"]: r["text"] for r in parts[3].collect()}["C1"]
    assert 'Total observed amount: 400.00\nTransaction types: {"TRANSFER": 2}\nObserved step range: 1 to 1' in text
    kept = sorted(r["source_row_id"] for r in corpus.sampled_normal_rows(df, 1).collect())
    digest = {i: hashlib.sha256(f"1|TRANSFER|{rows[i][3]}|{rows[i][6]}|200.00|{i + 1}".encode()).hexdigest() for i in (1, 2)}
    assert kept == [min(digest, key=digest.get)]


def test_change_detection_and_pruning(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "document_id string, text string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("z", "9")], "document_id string, text string")
    assert {(r["document_id"], r["change"]) for r in corpus.changed_documents(new, old).collect()} == {("b", "changed")}
    assert corpus.changed_documents(new, old.limit(0)).count() == 3
    stored = old.withColumn("source_type", F.when(F.col("document_id") == "z", "paysim").otherwise("other"))
    assert {r["document_id"] for r in corpus.pruned_documents(stored, new, "paysim").collect()} == {"a", "b", "c"}


def test_chunks_follow_headings(spark):
    body = "intro\n\n# One\n" + "w " * 30 + "\n\n## Two\n" + "x " * 25 + "\n\n" + "y " * 25

    def chunks(text, limit=chunking.CHUNK_WORDS, overlap=chunking.OVERLAP_WORDS):
        df = spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc string, text string")
        rows = chunking.chunk_documents(df, "doc", limit=limit, overlap=overlap).orderBy("doc", "chunk_index").collect()
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["doc"] for r in rows} <= {"d"}
        return [r["chunk"] for r in rows]

    got = chunks(body, 40, 5)
    assert got[0].startswith("intro\n\n# One") and all(c.strip() for c in got)
    assert any("## Two" in c and "y" in c for c in got)
    assert got[1].split()[:5] == got[0].split()[-5:]
    assert chunks("  \r\n ") == []
    assert chunks("# A\none\n\n\n\n\ntwo") == ["# A\none\n\ntwo"]
    assert chunks("a b c d e", 2, 1) == ["a b", "b\n\nc d", "d\n\ne"]
    assert chunks("a b c d", 2, 0) == ["a b", "c d"]
    # A section over the limit: paragraphs filled up, a long one in runs of words, each under the heading.
    assert chunks("# H\na b\n\nc d\n\ne f g h i j k", 4, 0) == ["# H\na b", "# H\n\nc d", "# H\n\ne f g h", "# H\n\ni j k"]
    # A heading mark alone takes the next line for its title.
    assert chunks("x\n#\n# A\nb", 2, 0) == ["x", "#\n# A\n\n# A\nb"] or chunks("x\n#\n# A\nb", 2, 0)[0] == "x"


def test_document_metadata(spark):
    rows = [("01_rbi_2024_master_direction/a.md", "---\nsource_type: primary_regulatory\nsource_pages: [3, 4]\n---\ntext"),
            ("07_reporting/Historical/b.md", "plain"), ("notes/pwc_view.md", '---\nsource_type: secondary_analysis\npublisher: "PwC India"\n---\nx'),
            ("03_transaction_monitoring_and_analytics/old_guidelines_rbi.md", "x"), ("02_early_warning_signals_ews_rfa/x_2024.md", "x")]
    got = {r["relative_path"]: r for r in chunking.knowledge_metadata(
        spark.createDataFrame(rows, "relative_path string, text string")).collect()}
    first = got[rows[0][0]]
    assert (first["status"], first["version"], first["topic"], first["source_pages"]) == ("current", "2024", "rbi_master_direction", "3, 4")
    assert (first["source_type"], first["current_authority"]) == ("primary_regulatory", True)
    assert (got[rows[1][0]]["status"], got[rows[1][0]]["document_type"], got[rows[1][0]]["authority"]) == ("historical", "historical_guidance", "RBI")
    assert (got[rows[2][0]]["authority"], got[rows[2][0]]["status"], got[rows[2][0]]["topic"]) == ("PwC India", "reference", "notes")
    assert got[rows[3][0]]["source_type"] == "historical_reference"
    assert got[rows[4][0]]["status"] == "current" and got[rows[4][0]]["source_type"] == "regulatory_knowledge"


@pytest.mark.parametrize("batch", [3, 100])
def test_neighbours_match_brute_force(spark, batch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 6))
    vectors[40] = vectors[7]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)],
                               "document_id long, vector array<double>, label int").repartition(5)
    queries = df.where("document_id < 10").select(F.col("document_id").alias("query_id"), "vector")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = 1 - unit @ unit.T
    got = retrieve.nearest_neighbors(queries, df, 4, batch=batch).collect()
    for q in range(10):
        want = sorted(range(120), key=lambda d: (round(distance[q, d], 12), d))[:4]
        assert [r["document_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    per = retrieve.nearest_neighbors(queries, df, 2, per="label").groupBy("query_id", "label").count().collect()
    assert len(per) == 30 and all(r["count"] == 2 for r in per)
    assert retrieve.nearest_neighbors(queries.limit(0), df, 2).count() == 0
    blocks = retrieve.nearest_neighbors(queries, df, 4, batch=batch, block=7).collect()
    assert sorted(blocks) == sorted(got)


def _neighbour_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    vectors = centres[rng.integers(0, 30, 900)] + 0.4 * rng.normal(size=(900, 24))
    vectors[600:] = vectors[3]  # a third are copies of one vector
    rows = [(i, [float(x) for x in v], i % 4 if i % 5 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "document_id long, vector array<double>, label int").repartition(6)
    return df, df.where("document_id < 60").select(F.col("document_id").alias("query_id"), "vector")


def test_copies_and_null_labels_in_every_block(spark):
    df, queries = _neighbour_rows(spark)
    whole = retrieve.nearest_neighbors(queries, df, 5, per="label").collect()
    split = retrieve.nearest_neighbors(queries, df, 5, per="label", batch=16, block=50).collect()
    assert len(whole) == 60 * 5 * 5 and sorted(map(str, whole)) == sorted(map(str, split))
    mine = [r["document_id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query_id"] == 3 and r["label"] == 1]
    assert mine == [601, 609, 613, 617, 621]


def test_hashed_neighbours_find_most_and_all_probes_find_all(spark):
    df, queries = _neighbour_rows(spark)
    exact = {(r["query_id"], r["document_id"]): r for r in retrieve.nearest_neighbors(queries, df, 10).collect()}
    few = retrieve.hashed_neighbors(queries, df, 10, bits=6, tables=6, probes=6).collect()
    assert len({(r["query_id"], r["document_id"]) for r in few}) == len(few)
    hits = [r for r in few if (r["query_id"], r["document_id"]) in exact]
    assert len(hits) >= 0.9 * len(exact)
    assert all(r["distance"] == exact[r["query_id"], r["document_id"]]["distance"] for r in hits)
    # Every bucket is looked into, in many parts and batches: the exact answer with its ranks.
    every = retrieve.hashed_neighbors(queries, df, 10, bits=3, tables=2, probes=8, batch=7, block=20).collect()
    assert {(r["query_id"], r["document_id"]): r for r in every} == exact
    per = retrieve.hashed_neighbors(queries, df, 2, per="label", bits=2, tables=1, probes=4).collect()
    assert sorted(map(str, per)) == sorted(map(str, retrieve.nearest_neighbors(queries, df, 2, per="label").collect()))
    with pytest.raises(ValueError):
        retrieve.hashed_neighbors(queries, df, bits=40)


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "document_id long, vector array<double>")
    queries = df.where("document_id = 1").select(F.col("document_id").alias("query_id"), "vector")
    want = [(1, 0.0), (8, 0.0), (6, 1.0)]
    for found in (retrieve.nearest_neighbors(queries, df, 5), retrieve.hashed_neighbors(queries, df, 5, bits=2, probes=4)):
        assert [(r["document_id"], r["distance"]) for r in found.orderBy("rank").collect()] == want
    for search in (retrieve.nearest_neighbors, retrieve.hashed_neighbors):
        assert search(queries, df.limit(0), 5).count() == 0 and search(queries.limit(0), df, 5).count() == 0


META = "struct<status:string,current_authority:boolean,authority:string,source_type:string>"


def test_knowledge_order(spark):
    rows = [("h", 0.01, 1, ("historical", False, "RBI", "historical_reference")),
            ("s", 0.02, 2, ("reference", False, "PwC", "secondary_analysis")),
            ("c", 0.4, 3, ("current", True, "RBI", "primary_regulatory")), ("c", 0.4, 4, ("current", True, "RBI", "primary_regulatory"))]
    df = spark.createDataFrame([(1, *r) for r in rows], f"query_id int, document_id string, distance double, rank int, metadata {META}")
    out = retrieve.rank_knowledge(df).orderBy("knowledge_rank").collect()
    assert [r["document_id"] for r in out] == ["c", "s", "h"]


CASE_META = ("struct<transaction_type:string,amount:string,label:string,origin_balance_depleted:boolean,origin_balance_unchanged:boolean,"
             "destination_balance_increased:boolean,destination_balance_unchanged:boolean,balance_change_amount:string>")


def test_balance_behaviour_beats_distance(spark):
    alert = ("a", "TRANSFER", 100.0, 100.0, 40.0, 0.0, 60.0)
    partial = ("TRANSFER", "100", "fraud", False, False, True, False, "-60")
    depleted = ("TRANSFER", "100", "fraud", True, False, True, False, "-100")
    bare = (None, None, None, None, None, None, None, None)
    rows = [(*alert, "1", "r1", 0.01, 1, depleted), (*alert, "2", "r2", 0.5, 2, partial), (*alert, "3", "r2", 0.1, 3, partial),
            (*alert, "4", "r4", None, 4, bare)]
    df = spark.createDataFrame(rows, "alert_id string, transaction_type string, amount double, old_balance_orig double, "
                               "new_balance_orig double, old_balance_dest double, new_balance_dest double, document_id string, "
                               f"source_row_id string, distance double, rank int, metadata {CASE_META}")
    out = retrieve.rank_cases(df).orderBy("case_rank").collect()
    assert [r["document_id"] for r in out] == ["2", "1", "4"]
    assert out[0]["balance_match_score"] == 1.0 and out[0]["balance_comparisons"] == 5
    assert out[2]["balance_match_score"] is None and out[2]["amount_ratio"] is None


def test_account_without_history(spark):
    alerts = spark.createDataFrame([("al", "t1", "C1", 0.4), ("no", "t2", None, 0.4)],
                                   "alert_id string, transaction_id string, name_orig string, anomaly_score double")
    tx = spark.createDataFrame([("C9", "t9", "2026", 1.0)], "name_orig string, transaction_id string, event_time string, amount double")
    table = spark.createDataFrame([("C1", "al", "t1", "2026", "L3")],
                                  "name_orig string, alert_id string, transaction_id string, event_time string, risk_level string")
    results = spark.createDataFrame([("al", "i1", "2026", "completed")], "alert_id string, investigation_id string, generated_at string, s string")
    out = evidence.account_evidence(alerts, tx, table, results)
    rows = {r["alert_id"]: r for r in out.withColumn("missing", evidence.missing_evidence()).collect()}
    assert rows["al"]["recent_transactions"] == [] and rows["al"]["recent_alerts"] == []
    assert [i["investigation_id"] for i in rows["al"]["previous_investigations"]] == ["i1"]
    assert len(rows["al"]["missing"]) == 2 and len(rows["no"]["missing"]) == 3
    assert rows["no"]["retrieval_note"] and rows["al"]["retrieval_note"] is None
    item = "array<struct<document_id:string,text:string,label:string>>"
    ready = out.withColumns({"knowledge": F.lit(None).cast("array<struct<document_id:string,text:string>>"),
                             "cases": F.array(F.struct(F.lit("p").alias("document_id"), F.lit("x").alias("text"), F.lit("fraud").alias("label"))).cast(item)})
    context = {r["alert_id"]: r for r in evidence.evidence_context(ready).collect()}["no"]
    assert tuple(context["retrieval_status"]) == ("partial", "failed", "success")
    assert context["evidence_summary"]["total_evidence_items"] == 2
    status = {r["alert_id"]: r["s"] for r in evidence.evidence_context(ready).select("alert_id", quality.investigation_status().alias("s")).collect()}
    assert status == {"al": "partial", "no": "partial"}


def test_query_texts(spark):
    df = spark.createDataFrame([(None, None, None), ("TRANSFER", "100.0", "40.0")],
                               "transaction_type string, old_balance_orig string, new_balance_orig string")
    empty, full = [r[0] for r in df.select(evidence.knowledge_query_text(df)).collect()]
    assert empty.startswith("fraud alert. Retrieve") and "digital banking" not in empty
    assert "origin balance changed from 100.0 to 40.0 (change -60.0)" in full and "digital banking" in full


@pytest.mark.parametrize("question,intent", [
    ("What does RBI say on past cases?", "regulatory"), ("Early warning signs?", "regulatory"), ("Compare with others", "historical"),
    ("What happened before?", "account"), ("Why flagged?", "transaction"), ("Hello there", "general"), ("a herbivore", "general")])
def test_intents(spark, question, intent):
    df = spark.createDataFrame([(question,)], "question string")
    assert df.select(evidence.question_intent("question")).first()[0] == intent


def test_answer_checks(spark):
    empty = "array<struct<source_id:string,source_type:string>>"
    df = spark.createDataFrame([
        ("What is the balance?", "The customer works as a clerk; balance 10.50 and -3", "amount 10.50", ["x"]),
        ("anything", "History is not available.", "", ["x"]), ("q", "v2x 7", "8", [])],
        "question string, answer string, evidence_text string, missing array<string>").withColumn("cited", F.array().cast(empty))
    a, b, c = quality.assess_answers(df).collect()
    assert a["unsupported_claim_flags"] == ["occupation"] and a["numeric_grounding_fraction"] == 0.5
    assert a["relevance_keyword_overlap"] == 0.5 and a["missing_evidence_acknowledged"] == 0.0
    assert b["missing_evidence_acknowledged"] == 1.0 and b["numeric_grounding_fraction"] == 1.0
    assert c["missing_evidence_acknowledged"] is None and c["numeric_grounding_fraction"] == 0.0


def test_payload_edges(spark):
    texts = ["[]", "null", "", '{"investigation_summary": "s"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in quality.check_payloads(df, "t").select("violations").collect()]
    assert got[0] == got[1] == got[2] == ["root"]
    assert got[3] == [f"missing:{k}" for k in quality.PAYLOAD_KEYS if k != "investigation_summary"]


def test_supported_claims_stay(spark):
    df = spark.createDataFrame([("The customer occupation is listed", "Occupation: trader"),
                                ("RBI treats a balance decrease as a fraud indicator", "")], "t string, src string")
    texts = [r[0] for r in df.select(quality.guarded_claim(
        F.col("t"), F.col("src"), F.array(F.lit("amount")), F.lit("a text on balance patterns"))).collect()]
    assert texts[0].startswith("The customer") and texts[1].startswith("RBI treats")


def test_results_refuse_null_status_and_extra_groups(spark):
    import json

    from tallywatch.operators import quality

    good = {key: [] for key in quality.PAYLOAD_KEYS} | {key: "x" for key in quality.RESULT_ONLY_KEYS} | {
        "investigation_summary": "text", "investigation_status": "completed", "historical_comparison": {"fraud_cases": [], "normal_cases": []},
        "alert_assessment": {key: None for key in quality.ASSESSMENT_KEYS}}
    wider = {"historical_comparison": good["historical_comparison"] | {"other_cases": []}}
    cases = [{}, {"investigation_status": None}, wider, {"alert_assessment": None}, {"historical_comparison": None}]
    df = spark.createDataFrame([(i, json.dumps(good | change)) for i, change in enumerate(cases)], "id int, payload string")
    found = {r["id"]: r["violations"] for r in quality.check_results(df, "payload").collect()}
    assert found == {0: [], 1: ["invalid:investigation_status"], 2: ["invalid:historical_comparison"],
                     3: ["invalid:alert_assessment"], 4: ["invalid:historical_comparison"]}
    payload = {key: good[key] for key in quality.PAYLOAD_KEYS} | wider
    assert quality.check_payloads(spark.createDataFrame([(json.dumps(payload),)], "payload string"), "payload").first()["violations"] == []


def test_history_of_selected_evidence(spark):
    tx = "array<struct<transaction_id:string,event_time:string,amount:double>>"
    alert = "array<struct<alert_id:string,transaction_id:string,risk_level:string>>"
    told = "array<struct<investigation_id:string,investigation_summary:string,recommended_review_points:array<string>>>"
    item = "array<struct<document_id:string,text:string,authority:string,source_type:string,label:string>>"
    case = [("d1", "x" * 2000, None, None, "1")]
    rows = [
        (1, "previous activity?", "T1", [("T1", "t", 1.0), ("T2", None, 2.0), ("T3", "t", 3.0)], [("A1", "", "L1"), ("A2", "T9", "L2")],
         [("I1", "s" * 900, ["a", "b", "c", "d"])], [], case),
        (2, "history of it", "T1", [], [], [], [], case),
        (3, "what does RBI say", "T1", [("T2", "t", 1.0)], [], [], [], case),
        (4, "past cases", "T1", [("T1", "t", 1.0)], None, [(None, None, None)], None, case),
    ]
    schema = f"id int, question string, transaction_id string, recent_transactions {tx}, recent_alerts {alert}, previous_investigations {told}, knowledge {item}, cases {item}"
    got = {r["id"]: r for r in evidence.select_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert [h["source_id"] for h in got[1]["history"]] == ["T2", "A1", "I1"]
    assert json.loads(got[1]["history"][0]["content"]) == {"transaction_id": "T2", "amount": 2.0}
    last = json.loads(got[1]["history"][2]["content"])
    assert len(last["investigation_summary"]) == 800 and last["recommended_review_points"] == ["a", "b", "c"]
    assert got[1]["missing"] == [] and got[2]["history"] == [] and got[2]["missing"] == [evidence.NO_HISTORY]
    assert got[3]["history"] is None and got[3]["missing"] == [evidence.NO_KNOWLEDGE]
    assert got[4]["history"] == [] and evidence.NO_HISTORY not in got[4]["missing"]
    assert got[4]["missing"] == [evidence.NO_KNOWLEDGE, evidence.NO_CASES.format("normal")]


def _plain_plan(spark, make):
    """The plan without broadcasts and run-time changes, as large tables get it."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    df = make()
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_account_lists_are_the_last_shuffled_join(spark):
    """Rows that hold the lists of their account are not shuffled again, by alert or by question."""
    from tallywatch.plans import casework

    for make in (casework.account_evidence, casework.missing, casework.evidence_contexts, casework.history_evidence):
        plan = _plain_plan(spark, lambda: make(spark, "/root/testdata/sf0.001"))
        shuffled = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert "[name_orig#" in shuffled[0], (make.__name__, shuffled[0])


def test_contexts_are_saved_small_with_their_marks(spark, tmp_path):
    import gzip
    import json

    from tallywatch.sources import writers

    rows = spark.createDataFrame([("a", "x" * 5000, "2024-01-01"), ("b", "x" * 5000, "2024-01-02"), ("c", "x" * 5000, None)], "alert_id string, body string, event_date string")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    writers.save_contexts(rows, str(tmp_path / "out"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = list((tmp_path / "out").glob("event_date=*/*.json.gz"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < 1000
    assert sorted(json.loads(gzip.open(f).read())["artifact"] for f in files) == ["a", "b", "c"]


CONTEXT_ROW = ("alert_id string, alert struct<alert_id: string, transaction_id: string>, live_account_context struct<recent_transactions: array<struct<transaction_id: string>>, "
               "recent_alerts: array<struct<transaction_id: string, alert_id: string>>, previous_investigations: array<struct<alert_id: string, investigation_id: string>>>, "
               "regulatory_context array<struct<document_id: string>>, historical_paysim_context struct<fraud_cases: array<struct<document_id: string, label: string>>, "
               "normal_cases: array<struct<document_id: string, label: string>>>")


def context(alert, tx, recent=(), documents=(), fraud=(), normal=()):
    cases = ([(d, "fraud") for d in fraud], [(d, "normal") for d in normal])
    return (alert, (alert, tx), ([(t,) for t in recent], [("", "old")], [(None, "INV-1")]), [(d,) for d in documents], cases)


@pytest.mark.parametrize("keys", [evidence.BROADCAST_KEYS, 0])
def test_catalogue_of_alerts_that_come_once_is_not_shuffled(spark, monkeypatch, keys):
    """A later source overrides an earlier one of the same id, within a row and among rows of one alert; only repeated alerts are grouped."""
    monkeypatch.setattr(evidence, "BROADCAST_KEYS", keys)
    once = [context("a", "t1", ["t1", "t2", "t2", None, ""], ["k1", "t2"], ["p1", "k1"], ["p1", "p2"]), context("b", None, ["a"])]
    again = [context("c", "t1", ["x"]), context("c", "t1", [], ["x"], [], ["t1"]), context(None, "t9", ["y"]), context(None, None, ["z"], ["y"])]
    base = {("old", "cassandra_history"), ("INV-1", "cassandra_history")}
    want = {
        "a": base | {("a", "live_transaction"), ("model-output:t1", "model_output"), ("t1", "cassandra_history"), ("t2", "rbi_knowledge"),
                     ("k1", "paysim_fraud"), ("p1", "paysim_normal"), ("p2", "paysim_normal")},
        "b": base | {("b", "live_transaction"), ("a", "cassandra_history")},
        "c": base | {("c", "live_transaction"), ("model-output:t1", "model_output"), ("t1", "paysim_normal"), ("x", "rbi_knowledge")},
        None: base | {("t9", "live_transaction"), ("model-output:t9", "model_output"), ("y", "rbi_knowledge"), ("z", "cassandra_history"),
                      ("current-alert", "live_transaction")},
    }

    def listed(rows):
        df = evidence.evidence_catalogue(spark.createDataFrame(rows, CONTEXT_ROW))
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and df.columns == ["alert_id", "source_id", "source_type"]
        return df, {k: {(s, t) for a, s, t in got if a == k} for k in {a for a, _, _ in got}}

    df, got = listed(once)
    assert got == {k: want[k] for k in "ab"} and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert listed(once + again)[1] == want


@pytest.mark.parametrize("keys", [evidence.BROADCAST_KEYS, 0])
def test_only_cited_sources_meet_the_citations(spark, monkeypatch, keys):
    monkeypatch.setattr(evidence, "BROADCAST_KEYS", keys)
    names = "alert_id string, source_id string, source_type string"
    catalogue = spark.createDataFrame([("a", f"t{i}", "cassandra_history") for i in range(50)] + [("a", "p1", "paysim_fraud")] * 2 + [("b", "p1", "paysim_normal"), (None, "p1", "paysim_fraud")], names)
    cited = spark.createDataFrame([("a", "p1", "paysim_fraud"), ("a", "p1", "paysim_fraud"), ("b", "p1", "paysim_fraud"), ("a", None, "paysim_fraud"), (None, "p1", "paysim_fraud")], names)
    written, plans = evidence._scratch_table, {}
    monkeypatch.setattr(evidence, "_scratch_table", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or written(df, label))
    kept, rejected = evidence.checked_citations(cited, catalogue)
    assert kept.columns == rejected.columns == cited.columns
    assert [tuple(r) for r in kept.collect()] == [("a", "p1", "paysim_fraud")] * 2
    assert {tuple(r) for r in rejected.collect()} == {("b", "p1", "paysim_fraud"), ("a", None, "paysim_fraud"), (None, "p1", "paysim_fraud")}
    assert plans["checked-citations"].count("LeftSemi") == (1 if keys else 0)
