"""Trade-paper operators on small cases with results written by hand."""

from __future__ import annotations

import json
import uuid
import re

import pytest
from pyspark.sql import functions as F

from ladingspark.catalogs import invoice
from ladingspark.functions.tables import elements
from ladingspark.operators import agent, classify, clean, contracts, extract, pages, papers, retrieve, validate
from ladingspark.plans import document, judgement
from ladingspark.sources import readers, store

REPAIRS = [
    ("hs_code", "8479.50.00", "8479.50.00"), ("amount", "USD 500,000.00", "USD 500,000.00"), ("quantity", "500 PCS", "500 PCS"), ("shipment_date", "2024-09-15", "2024-09-15"),
    ("exporter_name", "COSCO Pioneer", "COSCO Pioneer"), ("vessel_name", "COSCO Pioneer", "COSCO Pioneer"), ("hs_code", "847O.5O.OO", "8470.50.00"), ("amount", "USD 5OO,OOO.OO", "USD 500,000.00"),
    ("quantity", "5OO PCS", "500 PCS"), ("shipment_date", "2O24-O9-15", "2024-09-15"), ("gross_weight", "12,OOO", "12,OOO"), ("quantity", "IO PCS", "10 PCS"), ("hs_code", "847l.50.0l", "8471.50.01"),
    ("exporter_name", "C0SC0 Pioneer", "COSCO Pioneer"), ("lc_no", "LC-2O24-OO1", "LC-2O24-OO1"), ("voyage_no", "CS24O815", "CS24O815"), ("hs_code", "XYZ", "XYZ"), ("amount", "gibberish", "gibberish"),
]
LABELS = [
    ("B/L N0: COSC240815-1000", "B/L No: COSC240815-1000"), ("B/LN0:COSC240815", "B/L No:COSC240815"), ("REF N0:SK-VN-2024-890.", "REF No:SK-VN-2024-890."), ("LC N0 ABC123", "LC No ABC123"),
    ("Invoice N0. INV-001", "Invoice No. INV-001"), ("Contract N0: C-2024", "Contract No: C-2024"), ("P/L N0", "P/L No"), ("Voyage N0 V123", "Voyage No V123"), ("B/L No: COSC...", "B/L No: COSC..."),
    ("No way", "No way"), ("COSCO Pioneer", "COSCO Pioneer"), ("B/L NO: ABC", "B/L No: ABC"),
]


def one(spark, text, **more):
    names = ["text", *more]
    return spark.createDataFrame([(text, *more.values())], ", ".join(f"{n} string" for n in names))


def test_repairs(spark):
    rows = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(REPAIRS)], "i int, field string, value string")
    got = {r["i"]: r["value"] for r in clean.fix_fields(rows).collect()}
    want = {i: w for i, (_, _, w) in enumerate(REPAIRS)}
    want[10] = "12,000"
    assert got == want
    assert clean.changes(rows).count() == sum(want[i] != v for i, (_, v, _) in enumerate(REPAIRS))


def test_labels(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LABELS)], "i int, text string")
    assert {r[0]: r[1] for r in rows.select("i", clean.label_numbers("text")).collect()} == {i: b for i, (_, b) in enumerate(LABELS)}


@pytest.mark.parametrize(
    ("text", "want"),
    [("USD 45000.0", [("USD", 450.0)]), ("usd 1,234.56 KRW 5", [("USD", 1234.56), ("KRW", 5.0)]), ("EUR 1.234.56", []), ("none", []), (None, []), ("USD 12.500", [("USD", 12.5)])],
)
def test_amounts(spark, text, want):
    got = one(spark, text).select(extract.amounts("text").alias("a")).first()["a"]
    assert [(a["currency"], a["value"]) for a in got] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-04-22 and 2026년 4월 22일", ["2026-04-22"]), ("20260422", ["2026-04-22"]), ("2024-02-31", ["2024-02-31"]), ("2024-13-01", []), ("1899-01-01", []), ("2026년 5월 1일 2025.1.2", ["2025-01-02", "2026-05-01"]), ("", [])],
)
def test_dates(spark, text, want):
    assert [d["iso"] for d in one(spark, text).select(extract.dates("text").alias("d")).first()["d"]] == want


def test_terms_in_list_order(spark):
    assert one(spark, "CIF Hamburg, FOB Busan; fob x CIF Hamburg EXW").select(extract.incoterms("text")).first()[0] == ["EXW", "FOB Busan", "CIF Hamburg"]


def test_classifier_ties_and_unknown(spark):
    rows = spark.createDataFrame([(0, ""), (1, None), (2, "BILL\nOF\nLADING"), (3, "COMMERCIAL INVOICE PROFORMA"), (4, "Shipper")], "i int, text string")
    got = {r["i"]: r for r in classify.classify(rows).collect()}
    assert got[0]["doc_type"] == got[1]["doc_type"] == "Unknown" and got[0]["confidence"] == 0 and got[0]["needs_recheck"]
    assert got[2]["doc_type"] == "BillOfLading" and got[2]["scores"][0]["score"] == 55.5
    assert got[4]["doc_type"] == "BillOfLading"  # of equal scores the first in the catalogue
    assert got[3]["scores"][0]["doc_type"] != "" and "[neg] PROFORMA" in [m for s in got[3]["scores"] if s["doc_type"] == "CommercialInvoice" for m in s["matched"]]


def test_invoice_values_that_are_labels(spark):
    text = "COMMERCIAL INVOICE\nInvoice No: INV-26-000123\nSeller: Netcom Trading\nBuyer:\nTel: 02-123-4567\nTotal Amount: USD 1,037.00\nNet Weight: 8 KGS"
    fields = papers.parse_invoice_like(one(spark, text), "CommercialInvoice").first()["key_fields"]
    assert fields["invoice_no"] == "INV-26-000123" and fields["total_amount"] == "1037.00" and fields["net_weight"] == "8"
    assert "Netcom" not in fields.get("seller", "") and "Tel" not in fields.get("buyer", "")


def test_swift_last_value_wins(spark):
    text = ":20: A1\n:59: FIRST\n:59: SECOND\nLINE 2\n:99Z: odd\n:32B: USD 5,000.00"
    row = papers.parse_credit(one(spark, text)).first()
    assert row["format"] == "swift_mt700" and row["key_fields"]["beneficiary"] == "SECOND\nLINE 2" and row["key_fields"]["field_99Z"] == "odd"
    assert row["key_fields"]["currency"] == "USD" and row["key_fields"]["amount"] == "5,000.00"
    assert row["warnings"] == ["MISSING_FIELDS:APPLICANT"]


def test_a_long_message_does_not_overflow(spark):
    text = ":20: A1\n:45A: goods\n" + "\n".join(f"line {i}" for i in range(20_000)) + "\n:59: SELLER"
    assert papers.parse_credit(one(spark, text)).first()["key_fields"]["beneficiary"] == "SELLER"


def test_contract_without_headers_and_near_headers(spark):
    row = contracts.parse_contract(one(spark, "nothing here")).first()
    assert row["n_clauses"] == 1 and row["clauses"][0]["article_no"] == 0 and row["warnings"] == ["NO_SIGNATURE_BLOCK"]
    assert "NO_CLAUSES_DETECTED" in contracts.parse_contract(one(spark, "nothing here"), extended=True).first()["warnings"]
    text = "제2조 (둘)\nsecond body\n제1조 (하나)\nfirst body\n서명"
    clauses = contracts.parse_contract(one(spark, text)).first()["clauses"]
    assert [c["article_no"] for c in clauses] == [1, 2] and clauses[0]["full_body"] == ""  # ends where number 2 starts, which is before
    flat = contracts.flat_clauses(one(spark, text)).first()["clauses"]
    assert [c["clause_id"] for c in flat] == ["제2조", "제1조"]


def test_seller_and_buyer_swap(spark):
    text = "THE BUYER ABCDEFGH CO. and far away from it all, quite a long way down the page, stands THE SELLER IJKLMNOP CO. here"
    fields = one(spark, text).select(F.expr(contracts.unswapped("map('seller', 'ABCDEFGH', 'buyer', 'IJKLMNOP')", "text")).alias("m")).first()["m"]
    assert fields == {"seller": "IJKLMNOP", "buyer": "ABCDEFGH"}


def test_checks(spark):
    row = spark.range(1)
    status = lambda c: row.select(c.alias("c")).first()["c"]["status"]
    assert status(validate.check_insurance(F.lit("110.5%"))) == "FAIL"
    assert status(validate.check_insurance(F.lit("110%"))) == "PASS"
    assert status(validate.check_insurance(F.lit(None).cast("string"))) == "UNKNOWN"
    assert status(validate.check_amounts(F.lit("1,000"), F.lit("999.5"))) == "PASS"
    assert status(validate.check_amounts(F.lit("1,000"), F.lit("abc"))) == "ERROR"
    assert status(validate.check_dates(F.lit("2024-10-01"), F.lit("2024-9-30"))) == "PASS"  # as texts
    assert status(validate.check_dates(F.lit("2024-10-01"), F.lit("2024-09-30"))) == "FAIL"
    papers_ = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, "x"), (5, "1")], "doc_id int, total_amount string")
    items = spark.createDataFrame([(1, 1, "2", "5", "10"), (2, 1, "2", "5", "11"), (3, 1, "2", "5", "11"), (4, 1, "1", "1", "1")], "doc_id int, pos int, quantity string, unit_price string, amount string")
    got = {r["doc_id"]: r["arithmetic"]["status"] for r in validate.check_arithmetic(papers_, items).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "WARNING", 4: "ERROR", 5: "UNKNOWN"}


def test_payload_keys_in_the_texts_order(spark):
    rows = spark.createDataFrame([(1, '{"z": {"k": null, "deep": {"k": 1}}, "a": [{"k": "two"}], "k2": 3}'), (2, "no json"), (3, None)], "i int, json string")
    got = {r["i"]: r["found"] for r in validate.found_keys(rows, ["k", "k2", "none"]).collect()}
    assert got == {1: {"k": "two", "k2": "3"}, 2: {}, 3: {}}
    report = validate.check_payload(spark.createDataFrame([(1, '{"coverage": "90%"}')], "doc_id int, json string"), "doc_id").first()
    assert report["insurance"]["status"] == "FAIL" and "❌" in report["report"] and report["arithmetic"]["status"] == "UNKNOWN"


def test_search_falls_back_and_cuts(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 10], "J1", "C1") for i in range(8)] + [(9, None, "J1", "C1"), (10, [0.0, 0.0], "J1", "C1")], "article_id long, embedding array<double>, jurisdiction string, category string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "J1", None), (2, [1.0, 0.0], "J9", "C1"), (3, [1.0, 0.0], None, "C9")], "query_id long, embedding array<double>, jurisdiction string, category string")
    near = retrieve.nearest(queries, vectors, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["article_id"]) for r in near) == [(q, k + 1, k) for q in (1, 2) for k in range(3)]
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 7)], "source_id long, target_id long")
    assert {r["article_id"]: r["degree"] for r in retrieve.degrees(edges).collect()} == {1: 3, 2: 2, 3: 1, 7: 1}


def test_page_rules(spark):
    rows = spark.createDataFrame([(1, "a" * 200, "b" * 30, None), (1, "short", "long enough text here", None), (1, "x", "y" * 50, "boom"), (1, "제1조 제2조 제3조" + "a" * 200, "제1조" + "b" * 100, None), (1, "n" * 200, "m" * 300, None)], "doc_id int, raw_text string, vlm_text string, vlm_error string")
    got = [r["decision_reason"].split("(")[0].split(":")[0] for r in pages.choose_text(rows).collect()]
    assert got == ["default", "orig_too_short", "vlm_error", "vlm_lost_articles", "longer_clean"]
    many = spark.createDataFrame([(1, i, "t", 1, 0.5 if i > 4 else 0.9) for i in range(1, 9)], "doc_id int, page_number int, raw_text string, n_blocks int, avg_confidence double")
    assert sorted(r["page_number"] for r in pages.pages_to_recheck(many, most=4).collect()) == [5, 6, 7, 8]
    answers = lambda asked: asked.select("doc_id", "page_number", F.lit("better " * 10).alias("vlm_text"), F.lit(None).cast("string").alias("vlm_error"))
    assert pages.reread(many, answers, most=4).filter("chosen = 'vlm'").count() == 4
    assert pages.page_stats(spark.createDataFrame([(1, None)], "doc_id int, blocks array<struct<text:string,confidence:double,bbox_aabb:array<int>>>")).first()["raw_text"] == ""


def test_agent_parts(spark):
    rows = spark.createDataFrame([("It passes: Pass",), ("FAIL 수정 지시: one 수정 지시: two ",), (None,)], "reply string")
    assert [r[0] for r in rows.select(agent.feedback("reply")).collect()] == ["PASS", "two", ""]
    assert one(spark, "<query> a\nb </query>").select(agent.tag("query", "text")).first()[0] == "a\nb"
    assert one(spark, "x").select(agent.rendered("{a}-{b}!", a=F.col("text"), b=F.lit(None))).first()[0] == "x-!"


def test_store(spark, tmp_path):
    texts = spark.createDataFrame([("a", "docs", "x"), ("a", "reports", "y"), ("b", "docs", None)], "name string, category string, text string")
    sealed = store.encrypted(texts, "k" * 16)
    assert {(r["name"], r["category"]): r["text"] for r in store.decrypted(sealed, "k" * 16).collect()} == {("a", "docs"): "x", ("a", "reports"): "y", ("b", "docs"): None}
    assert store.decrypted(sealed, "q" * 16).filter("text is not null").count() == 0
    assert [r["name"] for r in store.wiped(sealed, texts.filter("name = 'a'")).collect()] == ["b"]
    (tmp_path / "in").mkdir()
    for name in ("a.PDF", "b.png", "c.txt"):
        (tmp_path / "in" / name).write_bytes("가".encode("cp949"))
    found = readers.files(spark, str(tmp_path / "in"))
    assert sorted(r["kind"] for r in found.collect()) == ["image", "pdf"]
    assert {r["text"] for r in readers.payloads(found).collect()} == {"가"}
    assert readers.preferences(spark, str(tmp_path / "none.md"), "default") == "default"


def test_papers_of_every_kind_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "COMMERCIAL INVOICE\nInvoice No: INV-26-000123"), (2, None), (3, ""), (4, "BILL OF LADING\nB/L N0: COS240815"), (5, "plain text")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in document.summaries(document.read_papers(rows)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1]["doc_type"] == "CommercialInvoice" and got[4]["doc_type"] == "BillOfLading" and got[2]["doc_type"] == "Unknown"


def test_nearest_by_pieces_and_blocks(spark, monkeypatch):
    """Copies tie to the smaller id whatever piece they are in; queries of other lengths, blank and null ones find nothing."""
    vectors = [(i, [float(i % 5), 1.0, float(i % 3)], f"J{i % 2}", "C1") for i in range(90)] + [(200, [1.0], "J0", "C1")]
    asked = [(q, [1.0, 1.0, float(q % 2)], "J0, J7" if q % 3 else None, "C1" if q % 2 else None) for q in range(12)] + [(50, [1.0, 2.0], None, None), (51, None, None, None), (52, [0.0, 0.0, 0.0], None, None)]
    given = spark.createDataFrame(vectors, "article_id long, embedding array<double>, jurisdiction string, category string")
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, jurisdiction string, category string")
    want = []
    for q, v, place, _ in asked[:12]:
        cosine = lambda x, v=v: sum(a * b for a, b in zip(x, v, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in v)) ** 0.5
        near = sorted((round(1 - cosine(x), 12), i) for i, x, j, _ in vectors[:90] if place is None or j == "J0")[:4]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    for piece, block in ((16_384, 2048), (7, 3)):
        monkeypatch.setattr(retrieve, "PIECE_ROWS", piece)
        monkeypatch.setattr(retrieve, "BLOCK_QUERIES", block)
        assert sorted((r["query_id"], r["rank"], r["article_id"]) for r in retrieve.nearest(queries, given, 4).collect()) == want


def test_drafts_are_kept_where_the_model_changes_its_mind(spark):
    """Each answer of the model differs from the last; no row is lost or doubled, and a reply is asked for once a draft."""
    write = lambda s: s.withColumn("judgment", F.uuid())
    review = lambda s: s.withColumn("reply", F.when(F.rand() < 0.5, F.concat(F.lit("PASS "), "judgment")).otherwise(F.concat(F.lit("수정 지시: "), "judgment")))
    out = agent.drafted(spark.range(200).withColumnRenamed("id", "n"), write, review)
    first, again = (sorted((r["n"], r["judgment"], r["critic_feedback"], r["resolve_count"]) for r in out.collect()) for _ in range(2))
    assert first == again and [r[0] for r in first] == list(range(200))
    assert {r[3] for r in first} == {1, 2} and all(r[2] in ("PASS", r[1]) for r in first) and all(r[2] == "PASS" for r in first if r[3] == 1)


def test_from_papers_to_verdict(spark):
    law = {
        "vectors": spark.createDataFrame([(1, [1.0, 0.0], "KR", "C"), (2, [0.0, 1.0], "KR", "C")], "article_id long, embedding array<double>, jurisdiction string, category string"),
        "articles": spark.createDataFrame([(1, 7, "1", "first"), (2, 7, "2", "second")], "article_id long, law_id long, article_no string, content string"),
        "laws": spark.createDataFrame([(7, "Trade Act", "KR")], "law_id long, law_name string, jurisdiction string"),
        "metadata": spark.createDataFrame([(1, "C", True, "why", "s"), (2, "C", False, "why", "s")], "article_id long, category string, is_mandatory boolean, analysis_reason string, source_type string"),
        "edges": spark.createDataFrame([(1, 2)], "source_id long, target_id long"),
    }
    papers_ = spark.createDataFrame([(1, ' {"document_type": "SalesContract", "lc_amount": 10, "total_amount": 11} ', "be strict"), (2, "{}", None)], "query_id long, payload string, special string")
    prepare = lambda s: s.withColumn("prep", F.lit("<query>liability?</query><jurisdiction>KR</jurisdiction>"))
    embed = lambda s: s.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.1)))
    got = {r["query_id"]: r for r in judgement.analyze_documents(papers_, prepare, embed, law, preferences="prefs").collect()}
    assert got[1]["judgment"] == "위험" and got[2]["judgment"] == "주의"
    assert (got[1]["instruction"], got[2]["instruction"]) == ("A", "B")
    assert got[1]["context"].startswith("Source: Trade Act (Art. 1)\nContent: first") and "second" in got[1]["context"]
    assert "### [이번 분석 특별 지시]\nbe strict\n\nprefs" in got[1]["request"] and got[2]["request"].endswith("prefs")
    assert "[1단계: 서류 사전 분석]" in got[1]["verdict"] and got[1]["verdict"].count("위험") == 1
    assert judgement.analyze_documents(papers_.limit(0), prepare, embed, law).count() == 0


def test_models_are_asked_once(spark):
    """Models that never repeat themselves, and what they were given: one question a row, all the way to the verdict."""
    law = {
        "vectors": spark.createDataFrame([(1, [1.0, 0.0], "KR", "C")], "article_id long, embedding array<double>, jurisdiction string, category string"),
        "articles": spark.createDataFrame([(1, 7, "1", "first")], "article_id long, law_id long, article_no string, content string"),
        "laws": spark.createDataFrame([(7, "Trade Act", "KR")], "law_id long, law_name string, jurisdiction string"),
        "metadata": spark.createDataFrame([(1, "C", True, "why", "s")], "article_id long, category string, is_mandatory boolean, analysis_reason string, source_type string"),
        "edges": spark.createDataFrame([], "source_id long, target_id long"),
    }
    asked = {name: spark.sparkContext.accumulator(0) for name in ("prep", "embed", "write", "review")}

    def counting(name, column, make):
        def count(texts):
            asked[name].add(len(texts))
            return texts.map(make)

        return lambda s: s.withColumn(column[1], F.pandas_udf(count, "string").asNondeterministic()(column[0]))

    prepare = counting("prep", ("prep_request", "prep"), lambda t: f"<query>risk {uuid.uuid4()}</query>{t}")
    write = counting("write", ("request", "judgment"), lambda t: f"{uuid.uuid4()}")
    review = counting("review", ("review_request", "reply"), lambda t: f"PASS {t}")
    seen = counting("embed", ("refined", "_seen"), lambda t: t)
    embed = lambda s: seen(s).withColumn("embedding", F.when(F.startswith("_seen", F.lit("query: risk")) & F.endswith("_seen", F.lit("liability exclusion")), F.array(F.lit(1.0), F.lit(0.0))))
    papers_ = spark.createDataFrame([(1, "\n\u3000{}\t", None), (2, None, None), (3, '{"document_type": "SalesContract",', None), (4, " ", None)], "query_id long, payload string, special string")
    got = {r["query_id"]: r for r in judgement.analyze_documents(papers_, prepare, embed, law, write=write, review=review).collect()}
    assert {name: a.value for name, a in asked.items()} == {"prep": 4, "embed": 4, "write": 4, "review": 4}
    assert all(got[k]["query"] in got[k]["prep"] and got[k]["query"] in got[k]["request"] and got[k]["sources"] == "Source: Trade Act (Art. 1)\n" for k in got)
    assert got[1]["prep_request"].endswith("\n\n{}") and got[1]["facts"].startswith("### ")
    assert [got[k]["facts"] for k in (2, 3, 4)] == ["검증 데이터 없음", "수치 검증 수행 불가", "검증 데이터 없음"] and got[3]["instruction"] == "B"
    assert {r["arithmetic"]["status"] for r in got.values()} == {"UNKNOWN"} and {r["resolve_count"] for r in got.values()} == {1}


def test_payload_escapes_names(spark):
    rows = spark.createDataFrame([(1, 'a"b\\c', "Invoice", {"k": 'v"'}, "t")], "deal_id long, doc_id string, doc_type string, fixed_fields map<string,string>, text string")
    got = json.loads(document.payload(rows).first()["payload"])
    assert got == [{"filename": 'a"b\\c', "data": {"document_type": "Invoice", "key_fields": {"k": 'v"'}, "text": "t"}}]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("COMMERCIAL INVOICE\nUnit Price", "CommercialInvoice"), ("PROFORMA INVOICE", "ProformaInvoice"), ("PACKING LIST\nGross Weight", "PackingList"), ("BILL OF LADING\nShipper Consignee", "BillOfLading"), ("IRREVOCABLE DOCUMENTARY CREDIT", "LetterOfCredit"), ("PURCHASE ORDER\nVendor", "PurchaseOrder"), ("매매계약서 제1조", "SalesContract")],
)
def test_kinds_by_hand(spark, text, kind):
    assert classify.classify(one(spark, text)).first()["doc_type"] == kind


def test_forms_and_rejected_values(spark):
    """Layouts that the rendered papers don't have: labels beside values in one line, a block of parties, labels where values should be."""
    texts = ("2. SHIPPER ALPHA TRADING CO., LTD", "3. CONSIGNEE BETA IMPORT GMBH", "VESSEL / VOYAGE NO.: COSCO PIONEER / 123E", "POL BUSAN PORT\tPOD HAMBURG PORT")
    fields = [papers.parse_lading(one(spark, t)).first()["key_fields"] for t in texts]
    assert fields[0]["shipper"] == "ALPHA TRADING CO., LTD" and fields[1]["consignee"] == "BETA IMPORT GMBH"
    assert (fields[2]["vessel"], fields[2]["voyage"]) == ("COSCO PIONEER", "123E")
    assert (fields[3]["port_of_loading"], fields[3]["port_of_discharge"]) == ("BUSAN PORT", "HAMBURG PORT")
    invoice = papers.parse_invoice_like(one(spark, "INVOICE NO / DATE INV-2026-001 2026-01-05\nParties\nALPHA TRADING\nTel: 02-123-4567\nBETA IMPORT\nEUR 500\n"), "CommercialInvoice").first()["key_fields"]
    assert (invoice["invoice_no"], invoice["date"], invoice["seller"], invoice["buyer"], invoice["currency"]) == ("INV-2026-001", "2026-01-05", "ALPHA TRADING", "BETA IMPORT", "EUR")
    assert "shipper" not in papers.parse_lading(one(spark, "Shipper: Consignee\n")).first()["key_fields"]
    assert "applicant" not in papers.parse_credit(one(spark, "Applicant: Beneficiary\n")).first()["key_fields"]


def test_rows_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "i int, xs array<string>")
    assert sorted(map(tuple, elements(rows, ["i"], "xs").collect()), key=str) == [(1, 0, "a"), (1, 1, None)]
    text = "Invoice No: INV-26-000001\nTotal Amount: USD 10.00"
    read = papers.long_fields(papers.parse_invoice_like(one(spark, text), "CommercialInvoice"), ["text"])
    assert {(r["field"], r["value"], r["currency"]) for r in read.collect()} >= {("total_amount", "10.00", "USD")}


def test_item_lines_equal_those_of_another_engine(spark):
    text = "Bolts M8 and nuts 3 1,000.50 3,001.50\r\n\n  \nSteel pipe 20 mm\n4 2.5 10  \n\nWide cloth 1 2 3 4.5 9 40.5\nQuantity of all 1 2 3\nLast one 7 1.0 7.0"
    want = [(m.group(1).strip(), m.group(0), *(float(m.group(k).replace(",", "")) for k in (2, 3, 4))) for m in re.finditer(invoice.ITEM_LINE, text) if not re.search(invoice.ITEM_HEADER, m.group(1), re.I)]
    got = one(spark, text).select(papers.items("text").alias("items")).first()["items"]
    assert want and [(r["description"], r["raw"], r["quantity"], r["unit_price"], r["amount"]) for r in got] == want
