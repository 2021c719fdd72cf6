"""Queries of the parsers: papers are written out from the orders, read again, and held against the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import elements, kept
from ..operators import classify, contracts, extract, papers
from ..plans import document, render

#: The deals' facts, from the tables alone.
DEALS = """with d as (
  select o_orderkey as doc_id, o_orderkey % 3 as variant, 'KOREA TRADING ' || (o_orderkey % 97) || ' CO., LTD' as seller,
    upper(n_name) || ' IMPORT ' || o_custkey as buyer, 'INV-26-' || lpad((o_orderkey % 1000000)::varchar, 6, '0') as invoice_no,
    'ORD-26-' || lpad((o_orderkey % 1000000)::varchar, 6, '0') as order_no, 'COS' || lpad(o_orderkey::varchar, 9, '0') as bl_number,
    'MAEU' || lpad((o_orderkey % 10000000)::varchar, 7, '0') as container, 'M10LC' || lpad(o_orderkey::varchar, 9, '0') as lc_number,
    strftime(o_orderdate, '%Y-%m-%d') as date, o_totalprice::decimal(18,2) as total, upper(n_name) as port, (o_orderkey % 9000 + 100)::varchar as weight
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""


def written(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = render.texts(render.deals(spark, sf_dir))
    return kept(rows.select("doc_id", F.col(kind).alias("text")))


def field(name: str, part: str = "value"):
    return F.col("fields").getItem(name)[part]


def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_invoice_like(written(spark, sf_dir, "CommercialInvoice"), "CommercialInvoice")
    return read.select(
        "doc_id", field("invoice_no").alias("invoice_no"), field("date").alias("date"), field("seller").alias("seller"), field("buyer").alias("buyer"),
        F.concat_ws(" ", field("incoterms", "term"), field("incoterms", "place")).alias("terms"), field("total_amount").cast("decimal(18,2)").alias("total"),
        field("total_amount", "currency").alias("currency"), field("country_of_origin").alias("origin"), field("gross_weight").alias("weight"), field("gross_weight", "unit").alias("unit"),
    )


def proforma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_invoice_like(written(spark, sf_dir, "ProformaInvoice"), "ProformaInvoice")
    return read.select("doc_id", field("invoice_no").alias("invoice_no"), field("seller").alias("seller"), field("buyer").alias("buyer"), field("valid_until").alias("valid_until"), F.col("key_fields")["quotation_no"].alias("quotation_no"))


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_invoice_like(written(spark, sf_dir, "PurchaseOrder"), "PurchaseOrder")
    return read.select("doc_id", field("order_no").alias("order_no"), field("date").alias("date"), field("buyer").alias("buyer"), field("seller").alias("seller"), field("payment_terms").alias("terms"), field("total_amount").cast("decimal(18,2)").alias("total"))


def packing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_invoice_like(written(spark, sf_dir, "PackingList"), "PackingList")
    return read.select("doc_id", field("packing_no").alias("packing_no"), field("gross_weight").alias("weight"), field("measurement").alias("measurement"), field("measurement", "unit").alias("unit"), field("n_packages").alias("packages"), field("n_packages", "unit").alias("packs"), F.array_join("warnings", ";").alias("warnings"))


def _said(label: str, column: str):
    return F.concat(F.lit(label), F.col(column))


def order_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an order that the rendered papers don't have; what is above a label that begins a line is no value here."""
    d = render.deals(spark, sf_dir)
    code = F.concat(F.lit("H.S. Code: "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(".30"))
    text = render.lines(
        "PURCHASE ORDER", "", _said("Ship To:\nWAREHOUSE ", "port"), render.plain("Delivery Date", "date"), code, "Currency: USD", "Port of Loading: BUSAN", _said("Port of Discharge: PORT ", "port"),
        F.concat(F.lit("Net Weight: "), F.col("weight"), F.lit(" LBS")), _said("Marks & Numbers: LOT ", "order_no"),
    )
    read = papers.parse_invoice_like(d.select("doc_id", text.alias("text")), "PurchaseOrder")
    names = ("ship_to", "delivery_date", "hs_code", "currency", "port_of_loading", "port_of_discharge", "net_weight", "marks_numbers")
    return read.select("doc_id", *[field(n).alias(n) for n in names], field("net_weight", "unit").alias("unit"))


def bl_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a bill of lading that the rendered papers don't have; lines above a label are labels too, so that their values are rejected."""
    d = render.deals(spark, sf_dir)
    number = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    text = render.lines(
        "BILL OF LADING", "", F.concat(F.lit("Booking No: BK00"), number), _said("Notify Party:\n", "buyer"), "", _said("Vessel: MV ", "port"), F.concat(F.lit("Voyage No: "), number, F.lit("W")), "Place of Receipt: BUSAN CY",
        _said("Place of Delivery: PORT ", "port"), _said("Airport of Destination: ", "port"), "Measurement: 12.5 CBM", "Freight Terms: Prepaid", render.plain("Date of Issue", "date"), "Place of Issue: SEOUL",
    )
    read = papers.parse_lading(d.select("doc_id", text.alias("text")))
    names = ("booking_no", "notify_party", "vessel", "voyage", "place_of_receipt", "place_of_delivery", "airport_of_destination", "measurement", "freight_terms", "issue_place")
    return read.select("doc_id", *[F.col("key_fields")[n].alias(n) for n in names], field("measurement", "unit").alias("unit"))


def lc_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a credit in words that the rendered papers don't have."""
    d = render.deals(spark, sf_dir)
    text = render.lines(
        "IRREVOCABLE DOCUMENTARY CREDIT", "", render.plain("Applicant", "buyer"), _said("Issuing Bank: FIRST BANK ", "port"), _said("Advising Bank: BANK OF ", "lc_number"), "Port of Loading: BUSAN", _said("Port of Discharge: PORT ", "port"),
        render.plain("Date of Expiry", "date"), "Place of Expiry: SEOUL", render.plain("Latest Shipment", "date"), "Transhipment: NOT ALLOWED", "Incoterms: CIF Hamburg", "Partial Shipments: ALLOWED",
    )
    read = papers.parse_credit(d.select("doc_id", text.alias("text")))
    names = ("issuing_bank", "advising_bank", "port_of_loading", "port_of_discharge", "expiry_date", "expiry_place", "latest_shipment_date", "transhipment", "incoterm", "partial_shipments")
    return read.select("doc_id", "format", *[F.col("key_fields")[n].alias(n) for n in names])


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = render.item_texts(render.invoice_lines(spark, sf_dir)).withColumn("items", papers.items("text"))
    rows = papers.long_items(read, ["doc_id"])
    return rows.select("doc_id", "description", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("quantity", "unit_price", "amount")])


def invoice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and warnings where a third of the invoices lack their parties."""
    rows = render.texts(render.deals(spark, sf_dir))
    text = F.when(F.col("variant") == 0, F.regexp_replace("CommercialInvoice", r"(Seller|Buyer): [^\n]*\n", "")).otherwise(F.col("CommercialInvoice"))
    read = papers.parse_invoice_like(rows.select("doc_id", text.alias("text")), "CommercialInvoice")
    return read.select("doc_id", F.round("confidence", 6).alias("confidence"), F.array_join("warnings", ";").alias("warnings"))


def bl_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_lading(written(spark, sf_dir, "BillOfLading"))
    names = ("bl_number", "shipper", "consignee", "port_of_loading", "port_of_discharge", "gross_weight", "issue_date")
    return read.select("doc_id", *[F.col("key_fields")[n].alias(n) for n in names], F.array_join("containers", ",").alias("containers"), "transport_mode", F.round("confidence", 6).alias("confidence"))


def awb_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    number = F.concat(F.lit("180-"), F.lpad((F.col("doc_id") % 100000000).cast("string"), 8, "0"))
    flight = F.concat(F.lit("KE"), (F.col("doc_id") % 900 + 100).cast("string"))
    text = render.lines("AIR WAYBILL", F.concat(F.lit("AWB No: "), number), F.concat(F.lit("Flight No: "), flight), render.plain("Shipper", "seller"), "Airport of Departure: INCHEON")
    read = papers.parse_lading(d.select("doc_id", text.alias("text")))
    names = ("awb_number", "flight_no", "shipper", "airport_of_departure")
    return read.select("doc_id", *[F.col("key_fields")[n].alias(n) for n in names], "transport_mode", F.array_join("warnings", ";").alias("warnings"))


def lc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = papers.parse_credit(written(spark, sf_dir, "LetterOfCredit"))
    k = lambda *names: F.coalesce(*[F.try_element_at("key_fields", F.lit(n)) for n in names])
    return read.select("doc_id", "format", k("lc_number", "documentary_credit_number").alias("lc_number"), k("date_of_issue").alias("date"), k("applicant").alias("applicant"), k("beneficiary").alias("beneficiary"), k("currency").alias("currency"), F.regexp_replace(k("amount"), ",", "").cast("decimal(18,2)").alias("amount"), F.array_join("warnings", ";").alias("warnings"))


def contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = contracts.parse_contract(written(spark, sf_dir, "SalesContract"))
    return contracts.long_clauses(read, ["doc_id"]).select("doc_id", F.col("article_no").cast("bigint").alias("article_no"), "title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.md5("full_body").alias("body_md5"), F.coalesce(F.array_join(F.flatten(F.transform("paragraphs", lambda p: F.transform(p["items"], lambda i: i["text"]))), "|"), F.lit("")).alias("items"))


def contract_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preamble, signature, parties by position and warnings of the extended parser."""
    read = contracts.parse_contract(written(spark, sf_dir, "SalesContract"), extended=True)
    return read.select("doc_id", F.length("preamble").cast("bigint").alias("preamble_chars"), F.col("signature.found").alias("signed"), F.col("key_fields")["seller"].alias("seller"), F.col("key_fields")["buyer"].alias("buyer"), F.array_join("warnings", ";").alias("warnings"))


def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English contracts by labels. Names are read in pairs of characters, each from a letter on."""
    d = render.deals(spark, sf_dir)
    code = F.translate(F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), "0123456789", "ABCDEFGHIJ")
    text = render.lines(
        "SALES CONTRACT", F.concat(F.lit("Contract No: C"), F.col("order_no")), render.plain("Contract Date", "date"), F.concat(F.lit("SELLER: KOREATRADE"), code), F.concat(F.lit("BUYER: IMPORTHAUS"), code),
        F.concat(F.lit("TOTAL AMOUNT "), F.col("total_text")), "Currency: USD", "This contract is governed by and construed in accordance with the laws of Korea.", "Disputes go to arbitration in Seoul.",
    )
    read = contracts.parse_contract(d.select("doc_id", text.alias("text")), extended=True)
    names = ("contract_no", "date", "seller", "buyer", "currency", "total_amount", "governing_law", "arbitration_seat")
    return read.select("doc_id", *[F.col("key_fields")[n].alias(n) for n in names])


def clause_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    english = F.concat(F.lit("AGREEMENT\nArticle 1. Goods\nThe seller sells "), F.col("invoice_no"), F.lit(" whole.\nSection 2. Delivery\nDelivery is due on "), F.col("date"), F.lit(".\nArticle 3. X\nshort\n"))
    text = F.when(F.col("variant") == 0, F.col("SalesContract")).when(F.col("variant") == 1, english).otherwise(F.concat(F.lit("Too short.\n\nThe first paragraph of deal "), F.col("invoice_no"), F.lit(".\n\n\nAnother paragraph with buyer "), F.col("buyer"), F.lit(".")))
    rows = render.texts(d).select("doc_id", text.alias("text"))
    found = contracts.long_clauses(contracts.flat_clauses(rows), ["doc_id"])
    return found.select("doc_id", "clause_id", "title", "lang", "article_no", F.length("text").cast("bigint").alias("chars"))


def structural_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks on a page, a little out of line, back to cells."""
    items = render.invoice_lines(spark, sf_dir)
    block = lambda text, x, y, w: F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), F.array(x, y, x + w, y + F.lit(10)).alias("bbox_aabb"))
    top = F.col("pos") * 20 + 100
    shift = (F.col("doc_id") % 5).cast("int")
    cells = F.array(block(F.col("description"), F.lit(10) + shift, top, F.lit(120)), block(F.col("quantity").cast("string"), F.lit(210), top + 2, F.lit(30)), block(F.col("unit_price").cast("string"), F.lit(310) + shift, top + 1, F.lit(30)), block(F.col("amount").cast("string"), F.lit(410), top + 3, F.lit(30)))
    head = F.array(*[block(F.lit(t), F.lit(x), F.lit(100), F.lit(60)) for t, x in (("Description", 10), ("Quantity", 200), ("Unit Price", 300), ("Amount", 400))])
    pages = items.groupBy("doc_id").agg(F.concat(head, F.flatten(F.collect_list(cells))).alias("blocks"))
    rows = elements(pages, ["doc_id"], F.expr(contracts.table_items("blocks")), "i")
    return rows.select("doc_id", F.col("i.description").alias("description"), F.col("i.quantity").cast("decimal(18,2)").alias("quantity"), F.col("i.unit_price").cast("decimal(18,2)").alias("unit_price"), F.col("i.amount").cast("decimal(18,2)").alias("amount"))


def common_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates, terms and parties of a line; every third amount has no separators and is cut after three digits."""
    d = render.deals(spark, sf_dir)
    amount = F.when(F.col("variant") == 2, F.concat(F.lit("eur "), (F.col("total").cast("bigint") % 90000 + 1000).cast("string"))).otherwise(F.concat(F.lit("USD "), F.col("total_text")))
    text = F.concat(F.lit("갑 구매자 pays "), amount, F.lit(" on "), F.col("date"), F.lit(" and "), F.col("date"), F.lit(" CIF "), F.col("port"), F.lit(" FOB BUSAN @수출자1 @수출자1"))
    rows = d.select("doc_id", text.alias("text")).withColumn("c", extract.common_fields("text"))
    return rows.select("doc_id", F.col("c.amounts")[0]["currency"].alias("currency"), F.col("c.amounts")[0]["value"].cast("decimal(18,2)").alias("amount"), F.array_join(F.transform("c.dates", lambda x: x["iso"]), ",").alias("dates"), F.array_join("c.incoterms", ",").alias("terms"), F.col("c.parties.party_a").alias("party_a"), F.col("c.parties.party_b").alias("party_b"), F.array_join("c.parties.roles", ",").alias("roles"), F.array_join("c.parties.placeholders", ",").alias("placeholders"))


def classify_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(render.papers(spark, sf_dir)).select("doc_id", "doc_type")


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all kinds over the documents, each with some words of trade put before it."""
    docs = render.spread(render.table(spark, sf_dir, "documents"))
    said = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("doc_id") % len(PREFIXES) + 1).cast("int"))
    rows = docs.select("doc_id", F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    found = classify.classify(rows)
    return found.select("doc_id", "doc_type", F.round("confidence", 6).alias("confidence"), "needs_recheck", F.size("matched").cast("bigint").alias("n_matched"))


PREFIXES = ("plain words", "PACKING LIST PACKING LIST Gross Weight", "Commercial Invoice usd PROFORMA", "purchase order Vendor Ship To", "AIR WAYBILL Shipper Consignee Notify Party", "Arbitration Jurisdiction 갑 을", "quotation validity total amount unit price")


def title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = classify.keyword_counts(render.table(spark, sf_dir, "documents").select("doc_id", "text"), ["the", "en", "ound"])
    return docs.select("doc_id", F.explode("hits").alias("word", "h")).select("doc_id", "word", F.col("h.n").cast("bigint").alias("n"), F.col("h.top").cast("bigint").alias("top"))


def document_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: papers of all kinds are cleaned, classified, parsed and repaired in one plan."""
    read = document.read_papers(render.papers(spark, sf_dir))
    number = F.coalesce(*[F.try_element_at("fixed_fields", F.lit(n)) for n in ("invoice_no", "order_no", "packing_no", "bl_number", "lc_number", "documentary_credit_number")])
    return read.select("doc_id", "doc_type", number.alias("number"), F.coalesce(F.size("warnings") > 0, F.lit(False)).alias("has_warnings"))


def _spaced(deals: DataFrame) -> DataFrame:
    """Deals whose names have blanks for underscores, which names in forms don't hold."""
    return deals.withColumns({c: F.translate(c, "_", " ") for c in ("buyer", "port")})


def invoice_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that only the layouts of forms find, and parties that stand without labels in their block; the line of a telephone is no name."""
    d = _spaced(render.deals(spark, sf_dir))
    form = render.lines(
        _said("PL NO / DATE PL-", "order_no"), _said("INVOICE NO / DATE REF ", "date"), F.concat(F.lit("CONSIGNEE / BILL TO "), F.col("buyer"), F.lit(" VESSEL")), "TERMS OF SALE FOB BUSAN (KR)",
        F.concat(F.lit("TOTAL 40 CTNS 90.5 KGS "), F.col("weight"), F.lit(" KGS 12.5 CBM")),
    )
    block = render.lines("PACKING LIST", "Parties", F.col("seller"), "Tel: 02-111-2222", F.col("buyer"), "Weight in all")
    text = F.when(F.col("variant") == 0, block).otherwise(form)
    read = papers.parse_invoice_like(d.select("doc_id", text.alias("text")), "PackingList")
    return read.select("doc_id", *[field(n).alias(n) for n in ("pl_no", "seller", "buyer", "gross_weight", "net_weight")], field("incoterms", "term").alias("term"), field("incoterms", "place").alias("place"), field("seller", "raw").alias("seller_raw"))


def bl_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of forms: labels without colons, short names of ports, vessel and voyage in one."""
    d = _spaced(render.deals(spark, sf_dir))
    voyage = F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("W"))
    text = render.lines(
        _said("BILL OF LADING B/L NO ", "bl_number"), F.concat(F.lit("Shipper "), F.col("seller"), F.lit(" Consignee "), F.col("buyer"), F.lit(" Vessel")),
        F.concat(F.lit("VESSEL / VOYAGE NO. EVER "), F.col("port"), F.lit(" / "), voyage), _said("POL BUSAN POD PORT ", "port"),
    )
    read = papers.parse_lading(d.select("doc_id", text.alias("text")))
    return read.select("doc_id", *[F.col("key_fields")[n].alias(n) for n in ("bl_number", "shipper", "consignee", "vessel", "voyage", "port_of_loading", "port_of_discharge")])


def clause_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in both languages: the same number stands in each, and the text's order decides."""
    d = render.deals(spark, sf_dir)
    text = render.lines("제1조 (목적)", F.concat(F.lit("본 계약은 "), F.col("invoice_no"), F.lit(" 구매를 목적으로 한다.")), "Article 1. Purpose", F.concat(F.lit("The purpose is to buy "), F.col("invoice_no"), F.lit(" whole.")), "제2조 (인도)", F.concat(F.lit("선적일은 "), F.col("date"), F.lit(" 로 한다. 인도 지연 시 지급한다.")), "Article 2. Delivery", F.concat(F.lit("Delivery is due on "), F.col("date"), F.lit(".")), "제1조 (다시)", "같은 번호는 다시 쓰지 않는다.")
    found = contracts.long_clauses(contracts.flat_clauses(d.select("doc_id", text.alias("text"))), ["doc_id"])
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "clause_id", "title", "lang", F.col("start").cast("bigint").alias("start"), F.length("text").cast("bigint").alias("chars"))


#: Texts with the kind and confidence that follow by hand from the classifier's rules: a title word counts 10 and a tenth of its kind's priority,
#: a word 2, both with twice as much again for each time in the first 300 characters, a pattern 15 and a word against the kind -40.
BY_HAND = (
    ("nothing of trade", "Unknown", 0.0), ("a Vendor", "PurchaseOrder", 0.56), ("x" * 300 + " Vendor", "PurchaseOrder", 0.52), ("a Vendor, the Vendor", "PurchaseOrder", 0.6),
    ("Quotation in USD", "CommercialInvoice", 0.06), ("PROFORMA in USD", "ProformaInvoice", 0.56), ("Please supply", "PurchaseOrder", 0.65), ("x" * 300 + " Letter  of\nCredit", "LetterOfCredit", 0.69),
    ("a Pallet and Voyage, Vendor, Vendor", "PurchaseOrder", 0.3), ("packing list", "PackingList", 1.0),
)


def classify_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose kind and confidence are stated beside them, one a deal."""
    d = render.spread(render.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")))
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in BY_HAND]), (F.col("doc_id") % len(BY_HAND) + 1).cast("int"))
    return classify.classify(d.select("doc_id", text.alias("text"))).select("doc_id", "doc_type", F.round("confidence", 6).alias("confidence"), "needs_recheck")


def _score_sql() -> str:
    """The classifier's rules over documents, in SQL, from the same word lists."""
    from ..catalogs import kinds as K

    q = lambda s: "'" + s.replace("'", "''") + "'"
    words = [(name, p, kind.priority, "t", i, w) for p, (name, kind) in enumerate(K.KINDS.items()) for i, w in enumerate(kind.titles)]
    words += [(name, p, kind.priority, "w", i, w) for p, (name, kind) in enumerate(K.KINDS.items()) for i, w in enumerate(kind.words)]
    values = ", ".join(f"({q(n)}, {p}, {prio}, {q(k)}, {i}, {q(w.upper())})" for n, p, prio, k, i, w in words)
    rules = [(name, p, i, r, K.PATTERN_SCORE, True) for p, (name, kind) in enumerate(K.KINDS.items()) for i, r in enumerate(kind.patterns)]
    against = [(name, p, i, w, K.AGAINST_SCORE, False) for p, (name, kind) in enumerate(K.KINDS.items()) for i, w in enumerate(kind.against)]
    tests = " union all ".join(f"select doc_id, {q(n)} as doc_type, {p} as place, {score} as s from u where " + (f"regexp_matches(text, {q('(?i)' + r)})" if regex else f"contains(up, {q(r.upper())})") for n, p, _, r, score, regex in rules + against)
    prefix = "case doc_id % " + str(len(PREFIXES)) + " " + " ".join(f"when {i} then {q(t)}" for i, t in enumerate(PREFIXES)) + " end"
    count = lambda t, w: f"((length({t}) - length(replace({t}, {w}, ''))) // length({w}))"
    return f"""
with u as (select doc_id, {prefix} || ' ' || coalesce(text, '') as text, upper({prefix} || ' ' || coalesce(text, '')) as up from documents),
s as (select *, regexp_replace(up, '\\s+', ' ', 'g') as sp from u),
words(doc_type, place, prio, kind, pos, word) as (values {values}),
h0 as (select doc_id, doc_type, place, prio, kind, pos,
    case when kind = 't' and contains(word, ' ') and not contains(up, word) then {count("sp", "word")} else {count("up", "word")} end as n,
    case when kind = 't' and contains(word, ' ') and not contains(up, word) then {count("substring(sp, 1, 300)", "word")} else {count("substring(up, 1, 300)", "word")} end as top
  from s, words where contains(up, word) or (kind = 't' and contains(sp, word))),
h as (select *, row_number() over (partition by doc_id, doc_type, kind order by pos) as r from h0 where n > 0),
parts as (
  select doc_id, doc_type, place, case kind when 't' then (10 + prio / 10.0) * (1 + 2 * top) else 2 + 4 * top end::double as s from h where kind = 't' or r <= 15
  union all {tests}),
scores as (select doc_id, doc_type, place, sum(s) as score, count(*) as n from parts group by all having sum(s) > 0),
ranked as (select *, row_number() over (partition by doc_id order by score desc, place) as r, lead(score, 1, 0) over (partition by doc_id order by score desc, place) as second from scores)
select d.doc_id, coalesce(doc_type, 'Unknown') as doc_type, round((case when score is null then 0 else least(1.0, score / 50 * 0.5 + (score - second) / score * 0.5) end)::double, 6) as confidence,
  case when score is null then 0 else least(1.0, score / 50 * 0.5 + (score - second) / score * 0.5) end < 0.5 as needs_recheck, coalesce(n, 0)::bigint as n_matched
from documents d left join (select * from ranked where r = 1) x using (doc_id)"""


_KIND = "case doc_id % 7 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(render.KINDS)) + " end"
_ITEMS = """with i as (select l_orderkey as doc_id, l_linenumber as pos, 'Part number ' || l_partkey || 'A' as description, l_quantity::decimal(18,2) as quantity,
  ((round(l_extendedprice * 100)::bigint // l_quantity::bigint) / 100.0)::decimal(18,2) as unit_price, case when l_partkey % 7 = 0 then 1 else 0 end as wrong from lineitem)
"""

QUERIES = {
    "invoice_fields": (invoice_fields, DEALS + "select doc_id, invoice_no, date, seller, buyer, 'FOB BUSAN' as terms, total, 'USD' as currency, 'BUSAN' as origin, weight, 'KGS' as unit from d"),
    "proforma_fields": (proforma_fields, DEALS + "select doc_id, invoice_no, seller, buyer, date as valid_until, invoice_no as quotation_no from d"),
    "po_fields": (order_fields, DEALS + "select doc_id, order_no, date, buyer, seller, 'T/T 30 days' as terms, total from d"),
    "packing_fields": (packing_fields, DEALS + "select doc_id, order_no as packing_no, weight, '12.5' as measurement, 'CBM' as unit, '40' as packages, 'CTNS' as packs, 'NO_ITEMS_DETECTED' as warnings from d"),
    "po_rest": (order_rest, DEALS + "select doc_id, 'WAREHOUSE ' || port as ship_to, date as delivery_date, lpad((doc_id % 10000)::varchar, 4, '0') || '.30' as hs_code, 'USD' as currency, 'BUSAN' as port_of_loading, 'PORT ' || port as port_of_discharge, weight as net_weight, 'LOT ' || order_no as marks_numbers, 'LBS' as unit from d"),
    "bl_rest": (bl_rest, DEALS + "select doc_id, 'BK00' || lpad((doc_id % 1000)::varchar, 3, '0') as booking_no, buyer as notify_party, 'MV ' || port as vessel, lpad((doc_id % 1000)::varchar, 3, '0') || 'W' as voyage, 'BUSAN CY' as place_of_receipt, 'PORT ' || port as place_of_delivery, port as airport_of_destination, '12.5' as measurement, 'Prepaid' as freight_terms, 'SEOUL' as issue_place, 'CBM' as unit from d"),
    "lc_rest": (lc_rest, DEALS + "select doc_id, 'narrative' as format, 'FIRST BANK ' || port as issuing_bank, 'BANK OF ' || lc_number as advising_bank, 'BUSAN' as port_of_loading, 'PORT ' || port as port_of_discharge, date as expiry_date, 'SEOUL' as expiry_place, date as latest_shipment_date, 'NOT ALLOWED' as transhipment, 'CIF' as incoterm, 'ALLOWED' as partial_shipments from d"),
    "invoice_items": (invoice_items, _ITEMS + "select doc_id, description, quantity, unit_price, (quantity * unit_price + wrong)::decimal(18,2) as amount from i"),
    "invoice_quality": (invoice_quality, DEALS + "select doc_id, 0.7::double as confidence, case when variant = 0 then 'MISSING_FIELDS:BUYER;' else '' end || 'NO_ITEMS_DETECTED' as warnings from d"),
    "bl_fields": (bl_fields, DEALS + "select doc_id, bl_number, seller as shipper, buyer as consignee, 'BUSAN' as port_of_loading, 'PORT ' || port as port_of_discharge, weight as gross_weight, date as issue_date, container as containers, 'sea' as transport_mode, 0.75::double as confidence from d"),
    "awb_fields": (awb_fields, DEALS + "select doc_id, '180-' || lpad((doc_id % 100000000)::varchar, 8, '0') as awb_number, 'KE' || (doc_id % 900 + 100) as flight_no, seller as shipper, 'INCHEON' as airport_of_departure, 'air' as transport_mode, 'MISSING_FIELDS:CONSIGNEE' as warnings from d"),
    "lc_fields": (lc_fields, DEALS + "select doc_id, case when variant = 0 then 'swift_mt700' else 'narrative' end as format, lc_number, date, case when variant = 0 then buyer || chr(10) || 'SECOND LINE' else buyer end as applicant, seller as beneficiary, 'USD' as currency, total as amount, '' as warnings from d"),
    "contract_clauses": (contract_clauses, DEALS + """, c as (
  select doc_id, 1 as article_no, '목적' as title, 1 as n_paragraphs, '본 계약은 ' || invoice_no || ' 구매를 목적으로 한다.' as body, '' as items from d union all
  select doc_id, 2, '인도', 2, '① 선적일은 ' || date || ' 로 한다.' || chr(10) || '1. 첫째' || chr(10) || '2. ' || container || chr(10) || '② 인도 지연 시 지급한다.', '첫째|' || container from d union all
  select doc_id, 3, '지급', 2, '대금은 USD ' || trim(format('{:,.2f}', total::double)) || ' 이다.' || chr(10) || '계약일자 서명', '' from d)
select doc_id, article_no::bigint as article_no, title, n_paragraphs::bigint as n_paragraphs, md5(body) as body_md5, items from c"""),
    "contract_frame": (contract_frame, DEALS + "select doc_id, length('매매계약서' || chr(10) || chr(10) || 'between ' || seller || ' and ' || buyer || ' hereinafter')::bigint as preamble_chars, true as signed, seller, buyer, 'NO_ITEMS_STRUCTURAL_DETECTED' as warnings from d"),
    "contract_fields": (contract_fields, DEALS + "select doc_id, 'C' || order_no as contract_no, date, 'KOREATRADE' || translate(lpad((doc_id % 10000)::varchar, 4, '0'), '0123456789', 'ABCDEFGHIJ') as seller, 'IMPORTHAUS' || translate(lpad((doc_id % 10000)::varchar, 4, '0'), '0123456789', 'ABCDEFGHIJ') as buyer, 'USD' as currency, format('{:,.2f}', total::double) as total_amount, 'Korea' as governing_law, 'Seoul' as arbitration_seat from d"),
    "clause_flat": (clause_flat, DEALS + """, c as (
  select doc_id, '제1조' as clause_id, '목적' as title, 'ko' as lang, '1' as article_no, '본 계약은 ' || invoice_no || ' 구매를 목적으로 한다.' as t from d where variant = 0 union all
  select doc_id, '제2조', '인도', 'ko', '2', '① 선적일은 ' || date || ' 로 한다.' || chr(10) || '1. 첫째' || chr(10) || '2. ' || container || chr(10) || '② 인도 지연 시 지급한다.' from d where variant = 0 union all
  select doc_id, '제3조', '지급', 'ko', '3', '대금은 USD ' || format('{:,.2f}', total::double) || ' 이다.' || chr(10) || '계약일자 서명' from d where variant = 0 union all
  select doc_id, 'article_1', 'Goods', 'en', '1', 'The seller sells ' || invoice_no || ' whole.' from d where variant = 1 union all
  select doc_id, 'article_2', 'Delivery', 'en', '2', 'Delivery is due on ' || date || '.' from d where variant = 1 union all
  select doc_id, 'para_1', '', 'paragraph', '1', 'The first paragraph of deal ' || invoice_no || '.' from d where variant = 2 union all
  select doc_id, 'para_2', '', 'paragraph', '2', 'Another paragraph with buyer ' || buyer || '.' from d where variant = 2)
select doc_id, clause_id, title, lang, article_no, length(t)::bigint as chars from c"""),
    "structural_items": (structural_items, _ITEMS + "select doc_id, description, quantity, unit_price, (quantity * unit_price + wrong)::decimal(18,2) as amount from i"),
    "common_fields": (common_fields, DEALS + "select doc_id, case when variant = 2 then 'EUR' else 'USD' end as currency, case when variant = 2 then substring((floor(total)::bigint % 90000 + 1000)::varchar, 1, 3)::decimal(18,2) else total end as amount, date as dates, 'FOB BUSAN,CIF ' || regexp_extract(port, '^[A-Za-z]*') as terms, true as party_a, false as party_b, '구매자,수출자' as roles, '@수출자1' as placeholders from d"),
    "classify_papers": (classify_papers, DEALS + f"select doc_id, {_KIND} as doc_type from d"),
    "classify_documents": (classify_documents, _score_sql()),
    "title_counts": (title_counts, "select doc_id, w as word, ((length(upper(replace(text, 'ß', 'SS'))) - length(replace(upper(replace(text, 'ß', 'SS')), upper(w), ''))) // length(w))::bigint as n, ((length(substring(upper(replace(text, 'ß', 'SS')), 1, 300)) - length(replace(substring(upper(replace(text, 'ß', 'SS')), 1, 300), upper(w), ''))) // length(w))::bigint as top from documents, (values ('the'), ('en'), ('ound')) as k(w)"),
    "invoice_forms": (invoice_forms, DEALS + "select doc_id, case when variant > 0 then 'PL-' || order_no end as pl_no, case when variant = 0 then seller end as seller, translate(buyer, '_', ' ') as buyer, case when variant > 0 then weight end as gross_weight, case when variant > 0 then '90.5' end as net_weight, case when variant > 0 then 'FOB' end as term, case when variant > 0 then 'BUSAN' end as place, case when variant = 0 then '[fallback]' end as seller_raw from d"),
    "bl_forms": (bl_forms, DEALS + "select doc_id, bl_number, seller as shipper, translate(buyer, '_', ' ') as consignee, 'EVER ' || translate(port, '_', ' ') as vessel, lpad((doc_id % 1000)::varchar, 3, '0') || 'W' as voyage, 'BUSAN' as port_of_loading, 'PORT ' || translate(port, '_', ' ') as port_of_discharge from d"),
    "clause_mixed": (clause_mixed, DEALS + """, c as (
  select doc_id, 0 as pos, '제1조' as clause_id, '목적' as title, 'ko' as lang, '제1조 (목적)' as head, '본 계약은 ' || invoice_no || ' 구매를 목적으로 한다.' as body from d union all
  select doc_id, 1, 'article_1', 'Purpose', 'en', 'Article 1. Purpose', 'The purpose is to buy ' || invoice_no || ' whole.' from d union all
  select doc_id, 2, '제2조', '인도', 'ko', '제2조 (인도)', '선적일은 ' || date || ' 로 한다. 인도 지연 시 지급한다.' from d union all
  select doc_id, 3, 'article_2', 'Delivery', 'en', 'Article 2. Delivery', 'Delivery is due on ' || date || '.' || chr(10) || '제1조 (다시)' || chr(10) || '같은 번호는 다시 쓰지 않는다.' from d)
select doc_id, pos::bigint as pos, clause_id, title, lang, (coalesce(sum(length(head) + length(body) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + length(head))::bigint as start, length(body)::bigint as chars from c"""),
    "classify_by_hand": (classify_by_hand, "with t(i, doc_type, confidence) as (values " + ", ".join(f"({i}, '{k}', {c}::double)" for i, (_, k, c) in enumerate(BY_HAND)) + f") select o_orderkey as doc_id, doc_type, confidence, confidence < 0.5 as needs_recheck from orders join t on i = o_orderkey % {len(BY_HAND)}"),
    "document_flow": (document_flow, DEALS + f"select doc_id, {_KIND} as doc_type, case doc_id % 7 when 0 then invoice_no when 1 then invoice_no when 2 then order_no when 3 then order_no when 4 then bl_number when 5 then lc_number end as number, doc_id % 7 < 4 as has_warnings from d"),
}
