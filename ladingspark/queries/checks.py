"""Queries of the checks, the search, the pages and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import folder, kept
from ..operators import clean, lsh, pages, retrieve, validate
from ..functions import stages
from ..plans import judgement, record, render
from ..sources import ledger, readers, store
from ..streaming import folder as stream
from .texts import _PLAIN, _WS


def check_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals agree for orders that 5 divides; one line in seven is off by one."""
    items = render.invoice_lines(spark, sf_dir)
    sums = items.groupBy("doc_id").agg(F.sum("amount").alias("s"))
    papers = sums.select("doc_id", F.when(F.col("doc_id") % 5 < 3, F.format_number("s", 2)).when(F.col("doc_id") % 5 == 3, F.format_number(F.col("s") + 1, 2)).alias("total_amount"))
    return validate.check_arithmetic(papers, items).select("doc_id", F.col("arithmetic.status").alias("status"))


def deal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates, cover and policy of the deals as long rows."""
    d = render.deals(spark, sf_dir)
    credit = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.lit("much")).otherwise(F.format_number(F.lit(150000), 2))
    latest = F.when(F.col("doc_id") % 3 == 0, F.lit("1998-01-01")).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("1996-06-30"))
    cover = F.when(F.col("doc_id") % 5 == 0, F.lit("110%")).when(F.col("doc_id") % 5 == 1, F.lit("110.5%")).when(F.col("doc_id") % 5 == 2, F.lit("100 %")).otherwise(F.lit("99% of value"))
    checked = d.select("doc_id", validate.check_amounts(credit, F.col("total_text")).alias("amounts"), validate.check_dates(F.col("date"), latest).alias("dates"), validate.check_insurance(cover).alias("insurance"))
    return validate.long_checks(checked, "doc_id", ["amounts", "dates", "insurance"]).select("doc_id", "check", "status", "message")


def check_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    k = F.col("doc_id")
    rules = validate.check_policy(k % 2 == 0, F.when(k % 3 == 0, "FOB BUSAN").when(k % 3 == 1, "CIF HAMBURG"), F.when(k % 5 == 0, "100%").otherwise("110%"), F.lit("USD"), F.when(k % 7 == 0, "EUR").otherwise("USD"), F.col("seller"), F.when(k % 11 == 0, F.lower("seller")).otherwise(F.col("seller")))
    return d.select("doc_id", F.explode(rules).alias("r")).select("doc_id", "r.rule", "r.status")


def check_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON of any shape: keys are found wherever they stand, the first in the text's order."""
    d = render.deals(spark, sf_dir)
    body = F.concat(
        F.lit('[{"a": {"dates": {"latest_shipment_date": "1997-01-01", "bl_date": "'), F.col("date"), F.lit('"}}, "lc": {"lc_amount": "200,000"}}, {"z": {"total_amount": "'), F.col("total_text"),
        F.lit('", "items": [{"quantity": 2, "unit_price": "1,000.50", "amount": 2001}]}, "insurance": {"coverage": "120%"}, "exporter": {"name": "'), F.col("seller"), F.lit('"}}]'),
    )
    out = validate.check_payload(d.select("doc_id", body.alias("json")), "doc_id")
    return out.select("doc_id", *[F.col(f"{c}.status").alias(c) for c in ("arithmetic", "insurance", "amounts", "dates")], "report")


def across_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    fact = lambda kind, field, value: F.struct(F.lit(kind).alias("doc_type"), F.lit(field).alias("field"), value.alias("value"))
    facts = d.select(F.col("doc_id").alias("deal_id"), F.explode(F.array(fact("LetterOfCredit", "amount", F.lit("150,000.00")), fact("LetterOfCredit", "currency", F.lit("USD")), fact("CommercialInvoice", "total_amount", F.col("total_text")))).alias("f")).select("deal_id", "f.*")
    deals = validate.across_papers(facts)
    return deals.select("deal_id", validate.check_amounts(F.col("lc_amount"), F.col("invoice_amount"))["status"].alias("status"), "lc_currency")


def law(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A body of law out of the parts, and queries out of every hundredth vector."""
    e = render.table(spark, sf_dir, "embeddings").withColumn("jurisdiction", F.concat(F.lit("J"), (F.col("label") % 4).cast("string"))).withColumn("category", F.concat(F.lit("C"), (F.col("label") % 3).cast("string")))
    vectors = e.select(F.col("vec_id").alias("article_id"), "embedding", "jurisdiction", "category")
    articles = vectors.select("article_id", (F.col("article_id") % 20).alias("law_id"), F.concat((F.col("article_id") % 50 + 1).cast("string")).alias("article_no"), F.concat(F.lit("content of "), F.col("article_id").cast("string")).alias("content"))
    laws = spark.range(0, 19).select(F.col("id").alias("law_id"), F.concat(F.lit("Law "), F.col("id").cast("string")).alias("law_name"), F.lit("X").alias("jurisdiction"))
    metadata = vectors.select("article_id", "category", (F.col("article_id") % 3 == 0).alias("is_mandatory"), F.lit("why").alias("analysis_reason"), F.lit("statute").alias("source_type"))
    edges = vectors.filter("article_id % 2 = 0").select(F.col("article_id").alias("source_id"), F.pmod(F.col("article_id") * 7, F.lit(500)).alias("target_id"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 300 == 0, "J1, J2").when(F.col("vec_id") % 300 == 100, "nowhere").alias("jurisdiction"), F.when(F.col("vec_id") % 200 == 0, "C1").alias("category"))
    return {"queries": queries, "vectors": vectors, "articles": articles, "laws": laws, "metadata": metadata, "edges": edges}


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = law(spark, sf_dir)
    return retrieve.nearest(t["queries"], t["vectors"], 10).select("query_id", "article_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


def knn_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn, through buckets of random planes: what they find, exactly ranked. SQL has no such index; tests measure its recall."""
    t = law(spark, sf_dir)
    out = lsh.nearest(t["queries"], t["vectors"], 10)
    return out.select("query_id", "article_id", "rank", F.round("distance", 6).alias("distance"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.degrees(law(spark, sf_dir)["edges"])


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = law(spark, sf_dir)
    seeds = t["articles"].select(F.col("article_id").alias("query_id"), "article_id", F.lit(1).alias("place"))
    return retrieve.neighbours(seeds, t["edges"]).select("query_id", "article_id")


def _search(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    t = law(spark, sf_dir)
    found = retrieve.hybrid_search(**t, order=order)
    return found.select("query_id", F.col("place").cast("bigint").alias("place"), "article_id", "law_name", F.round("retrieval_score", 2).alias("score"), "reason")


def hybrid_search_vector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "vector")


def hybrid_search_score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "score")


def mandatory_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of rules read from CSV with a byte-order mark and a list of articles, met with findings."""
    path = f"{folder(spark)}/rules-{uuid.uuid4().hex}"
    lines = ["Jurisdiction,Law,Article/Section,Provision Summary,Case,Application Example", 'J1,Law 1,"1, 2",Summary one,Case,Example', "J2,Law 2,3,Summary two,Case,Example"]
    spark.createDataFrame([("﻿" + "\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    rules = readers.rule_map(spark, path)
    e = render.table(spark, sf_dir, "embeddings")
    findings = e.select("vec_id", F.concat(F.lit("J"), (F.col("vec_id") % 3).cast("string")).alias("jurisdiction"), F.concat(F.lit("Law "), (F.col("vec_id") % 3).cast("string")).alias("law"), (F.col("vec_id") % 4).cast("string").alias("article_no"))
    return retrieve.mandatory_rules(findings, rules).select("vec_id", "article_no", "summary")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages of 20 lines, with made-up blocks and confidences; a null text is one empty page."""
    docs = render.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.groupBy("doc_id", F.floor(F.col("pos") / 20).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return rows.select("doc_id", (F.col("_p") + 1).alias("page_number"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("raw_text"), F.size("_l").cast("bigint").alias("n_blocks"), ((F.col("doc_id") % 50) / 100 + 0.5).alias("avg_confidence"))


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = render.invoice_lines(spark, sf_dir)
    block = F.struct(F.col("description").alias("text"), ((F.col("pos") % 5) / 10 + 0.5).alias("confidence"), F.array(F.lit(10), F.col("pos") * -10, F.lit(50), F.lit(0)).alias("bbox_aabb"))
    given = items.groupBy("doc_id").agg(F.collect_list(block).alias("blocks"))
    out = pages.page_stats(given)
    return out.select("doc_id", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.col("n_low_confidence").cast("bigint").alias("n_low"), F.round("avg_confidence", 6).alias("confidence"), F.md5("raw_text").alias("text_md5"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.document_stats(pages_of(spark, sf_dir))
    return out.select("doc_id", "n_pages", "total_blocks", "total_chars", F.round("avg_confidence", 6).alias("confidence"), F.length("full_text").cast("bigint").alias("full_chars"))


def text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.text_layer(pages_of(spark, sf_dir), least=500)
    files = found.select("*", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".pdf")).alias("path"))
    return pages.routed(files).select("doc_id", "n_pages", "is_text", "is_image", "engine")


def page_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages_to_recheck(pages_of(spark, sf_dir), most=2).select("doc_id", "page_number", F.array_join("reasons", ";").alias("reasons"))


def merge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages_of(spark, sf_dir)
    other = F.when(F.col("doc_id") % 5 == 0, F.lit("short")).when(F.col("doc_id") % 5 == 1, F.concat("raw_text", "raw_text", F.lit("제1조 제2조 제3조 more"))).when(F.col("doc_id") % 5 == 2, F.concat("raw_text", F.lit(" output only ... unreadable text"))).when(F.col("doc_id") % 5 == 3, F.col("raw_text")).otherwise(F.repeat("raw_text", 3))
    rows = p.withColumn("vlm_text", other).withColumn("vlm_error", F.when(F.col("doc_id") % 7 == 0, F.lit("Timeout: after a very long time of waiting for it")))
    return pages.choose_text(rows).select("doc_id", "page_number", "chosen", F.regexp_extract("decision_reason", r"^[a-z_]+", 0).alias("reason"))


def hybrid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a text layer with a merged reading that is missing, blank, short or good."""
    p = pages_of(spark, sf_dir)
    merged = F.when(F.col("doc_id") % 5 == 1, F.lit(" \n\t ")).when(F.col("doc_id") % 5 == 2, F.substring("raw_text", 1, 10)).when(F.col("doc_id") % 5 > 2, F.concat(F.lit("merged "), F.col("raw_text")))
    out = pages.hybrid_pages(p.withColumn("merged_text", merged), is_image=F.col("doc_id") % 7 < 5)
    return out.select("doc_id", "page_number", "mode", F.md5("final_text").alias("text_md5"))


def judge_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From questions and payloads to verdicts, by the checks alone: search, facts, requests, drafts and their review. Some payloads are missing, empty or broken."""
    t = law(spark, sf_dir)
    k = F.col("query_id")
    items = F.when(k % 300 == 100, F.lit("")).otherwise(F.lit('"items":[{"quantity":2,"unit_price":50,"amount":100}],'))
    payload = F.concat(F.lit('{"document_type":"'), F.when(k % 200 == 0, "SalesContract").otherwise("LetterOfCredit"), F.lit('",'), items, F.lit('"lc_amount":"'), F.when(k % 300 == 200, "99").otherwise("100"), F.lit('","total_amount":"100","insurance":"110%","dates":{"bl_date":"2026-01-01","latest_shipment_date":"2026-01-02"}}'))
    payload = F.when(k % 700 == 100, F.lit(None)).when(k % 700 == 200, "").when(k % 700 == 300, F.concat(payload, F.lit(","))).otherwise(payload)
    asked = t["queries"].withColumn("query", F.concat(F.lit("question "), k.cast("string"))).withColumn("payload", payload).withColumn("special", F.when(k % 400 == 0, "be brief"))
    out = judgement.run(asked, {name: df for name, df in t.items() if name != "queries"}, preferences="none")
    return out.select("query_id", "instruction", "judgment", "critic_feedback", F.col("resolve_count").cast("bigint").alias("drafts"), "facts", "request", "sources", "verdict")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored readings, a page a line after a title page; one document in ten has a fault."""
    d = render.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, title = F.col("doc_id"), F.concat(F.lit("COMMERCIAL INVOICE\nInvoice No: INV-26-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    page = lambda t, i: F.struct((i + 1).cast("int").alias("page_number"), t.alias("raw_text"), (i % 3).cast("bigint").alias("n_blocks"), ((i % 5) / 10 + 0.5).alias("avg_confidence"))
    pages_ = F.transform(F.concat(F.array(title), F.split("text", "\n", -1)), page)
    pages_ = F.when(k % 50 == 4, F.slice(pages_, 1, 0)).when(k % 50 == 5, F.transform(pages_, lambda p: p.withField("page_number", F.nullif(p["page_number"], F.lit(1))))).when(k % 50 == 6, F.concat(pages_, F.slice(pages_, 1, 1))).otherwise(F.reverse(pages_))
    body = F.to_json(F.struct(F.lit("odl").alias("engine"), pages_.alias("pages")), {"ignoreNullFields": "false"})
    content = F.when(k % 50 == 1, F.lit(None)).when(k % 50 == 2, F.substring(body, 1, 60).cast("binary")).when(k % 50 == 3, F.concat(F.lit(b"\xff\xff"), body.cast("binary"))).otherwise(body.cast("binary"))
    return d.select("doc_id", content.alias("content"))


def document_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document from stored readings, of which some are missing, cut short, in no known code, without pages or misnumbered, and some done before."""
    files = _readings(spark, sf_dir)
    out = record.records(files, done=files.filter("doc_id % 50 = 7"))
    of = lambda path, kind="string": F.get_json_object("record", f"$.{path}").cast(kind)
    fields = {"document_type": "document_type", "invoice_no": "parse.key_fields.invoice_no", "engine": "ocr_quality.engine"}
    counts = ("n_pages", "total_blocks", "total_chars")
    return out.select("doc_id", "status", "error", *[of(p).alias(n) for n, p in fields.items()], *[of(f"ocr_quality.{c}", "bigint").alias(c) for c in counts], F.round(of("ocr_quality.avg_confidence", "double"), 6).alias("avg_confidence"), F.md5(of("full_text_raw")).alias("text_md5"))


def record_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failures of each stage of the same job, observed as they are stored."""
    seen, files = stages.Stages(), _readings(spark, sf_dir)
    record.records(files, done=files.filter("doc_id % 50 = 7"), stages=seen)
    return seen.table(spark).select("stage", "rows", "failures", (F.col("seconds") > 0).alias("timed"))


def ledger_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by batch: all documents, then all again with some of them changed, the second batch done twice over."""
    docs = render.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), F.col("text"))).otherwise(F.col("text")))
    work = lambda rows: rows.select("doc_id", "sha256", F.length("text").cast("bigint").alias("n_chars"))
    for batch, inputs in ((0, docs), (1, changed.unionByName(changed)), (1, changed), (2, changed)):
        ledger.run(inputs.withColumn("sha256", F.sha2("text", 256)), at, batch, work)
    done = ledger.batches(spark, at, "doc_id bigint, sha256 string").groupBy("doc_id").agg(F.count("*").alias("results"))
    return ledger.current(spark, at, "doc_id bigint, sha256 string, n_chars bigint").join(done, "doc_id").select("doc_id", "sha256", "n_chars", "batch", "results")


def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    part = lambda no, title, text: F.struct(F.lit(no).cast("int").alias("article"), F.lit(True).alias("is_article_title"), F.lit("TEXT").alias("type"), F.array(F.struct(F.concat(F.lit(title), text).alias("text"))).alias("contents"))
    document = F.struct(F.lit("t").alias("title"), F.array(part(1, "Purpose of the deal ", F.col("invoice_no")), part(2, "Delivery ", F.col("port")), part(3, "Payment ", F.col("date"))).alias("sub_documents"))
    truth = pages.ground_truth(d.select("doc_id", document.alias("document")))
    said = F.concat(F.lit("제1조 and Deliv ery "), F.when(F.col("doc_id") % 2 == 0, F.col("port")).otherwise(F.lit("elsewhere")))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 > 0, said).otherwise("").alias("response"))
    out = pages.recall(rows, truth)
    return out.select("doc_id", F.col("article_hits").cast("bigint").alias("article_hits"), F.round("article_recall", 4).alias("article_recall"), F.col("keyword_hits").cast("bigint").alias("keyword_hits"), F.array_join("missed_articles", ",").alias("missed"))


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.table(spark, sf_dir, "documents")
    scores = docs.select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.lit(0.5).alias("seconds"), (F.col("doc_id") % 101).cast("double").alias("article_recall"), (F.col("doc_id") % 7).cast("double").alias("keyword_recall"))
    return pages.benchmark(scores).select("model", "n_docs", *[F.round(c, 6).alias(c) for c in ("total_seconds", "avg_seconds", "avg_article_recall", "avg_keyword_recall")])


def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return store.input_records(docs).select("name", "sha256", F.col("n_bytes").cast("bigint").alias("n_bytes"), readers.upload_type("path").alias("media_type"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not done yet, and how far each input is."""
    docs = render.table(spark, sf_dir, "documents").select("doc_id")
    todo = store.not_done(docs, docs.filter("doc_id % 3 = 0"))
    return store.stage_summary(todo, {"pages": docs.filter("doc_id % 2 = 0"), "result": docs.filter("doc_id % 5 = 0")})


def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts of two kinds, some of them wiped, read again with the key."""
    docs = render.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(F.lit("docs"), F.lit("reports"))).alias("category"))
    sealed = store.encrypted(docs, "0123456789abcdef")
    left = store.wiped(sealed, docs.filter("cast(name as bigint) % 4 = 0"))
    left = store.wiped(left, docs.filter("cast(name as bigint) % 4 = 1"), "reports")
    return store.decrypted(left, "0123456789abcdef").select("name", "category", F.md5("text").alias("text_md5"))


def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    level = F.when(F.col("doc_id") % 5 == 0, "위험").when(F.col("doc_id") % 5 == 1, "주의").when(F.col("doc_id") % 5 == 2, "적합").when(F.col("doc_id") % 5 == 3, "other")
    return store.risk_counts(d.select("variant", level.alias("risk_level")), ["variant"]).select(F.col("variant").cast("bigint").alias("variant"), "high", "middle", "low")


def stream_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream through the same operators as a batch, written exactly once."""
    source = kept(render.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    out = f"{source.inputFiles()[0].rsplit('/', 1)[0]}-out"
    query = stream.process(stream.papers(spark, source.inputFiles()[0].rsplit("/", 1)[0]), lambda s: s.select("doc_id", clean.label_numbers(F.concat(F.lit("B/L N0: "), F.col("doc_id").cast("string"))).alias("label"), F.md5(clean.unescape_lines("text")).alias("text_md5")), out, f"{out}-checkpoint")
    query.awaitTermination()
    return spark.read.schema("doc_id bigint, label string, text_md5 string").parquet(out)


_DEAL = "with d as (select o_orderkey as doc_id, o_totalprice::decimal(18,2) as total, strftime(o_orderdate, '%Y-%m-%d') as date, o_orderkey % 3 as variant from orders join customer on o_custkey = c_custkey)\n"
_LINES = "with i as (select l_orderkey as doc_id, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as pos, l_quantity::decimal(18,2) as quantity, ((round(l_extendedprice * 100)::bigint // l_quantity::bigint) / 100.0)::decimal(18,2) as unit_price, case when l_partkey % 7 = 0 then 1 else 0 end as wrong from lineitem)\n"
_LAW = """with e as (select vec_id, embedding::double[] as v, 'J' || (label % 4) as jurisdiction, 'C' || (label % 3) as category from embeddings),
q as (select vec_id as query_id, v as qv, case when vec_id % 300 = 0 then 'J1, J2' when vec_id % 300 = 100 then 'nowhere' end as qj, case when vec_id % 200 = 0 then 'C1' end as qc from e where vec_id % 100 = 0),
c as (select query_id, vec_id as article_id, 1 - list_cosine_similarity(qv, v) as distance, qj is null or list_contains(list_transform(string_split(qj, ','), lambda x: trim(x)), jurisdiction) as strict, category from q, e where qc is null or qc = category),
k as (select *, bool_or(strict) over (partition by query_id) as any_strict from c),
n as (select query_id, article_id, distance, row_number() over (partition by query_id order by distance, article_id) as rank from k where strict or not any_strict),
edges as (select vec_id as source_id, (vec_id * 7) % 500 as target_id from e where vec_id % 2 = 0),
ends as (select source_id as article_id, target_id as other from edges union all select target_id, source_id from edges where source_id <> target_id),
degree as (select article_id, count(*) as degree from ends group by 1)
"""


def _found_sql(order: str) -> str:
    """The search as far as r: all results of each query with their places."""
    return _LAW + f""", hits as (select query_id, n.article_id, rank, 'Law ' || (n.article_id % 20) as law_name, n.article_id % 3 = 0 as mandatory, round((1 - distance) * 100, 2) as base, coalesce(degree, 0) as degree
  from n left join degree using (article_id) where rank <= 20 and n.article_id % 20 < 19 and exists (select 1 from e where vec_id = n.article_id)),
s as (select *, least(base + case when mandatory then 15 else 0 end + least(5 * degree, 15), 100) as score, 'why' as reason from hits),
p as (select *, row_number() over (partition by query_id order by {order}) as place from s),
near as (select p.query_id, other as article_id, min(place) as seed_place, arg_min(p.article_id, place) as seed from p join ends using (article_id) where place <= 3 group by 1, 2),
added as (select query_id, article_id, seed_place, seed from near where article_id % 20 < 19 and article_id in (select vec_id from e) and not exists (select 1 from p where p.query_id = near.query_id and p.article_id = near.article_id)),
u as (select query_id, article_id, law_name, score, reason, 0 as behind, place as a from p union all select query_id, article_id, 'Law ' || (article_id % 20), 75, 'Graph Neighbor of ' || seed, 1, seed_place from added),
r as (select *, row_number() over (partition by query_id order by behind, a, article_id) as place from u)"""


def _search_sql(order: str) -> str:
    return _found_sql(order) + " select query_id, place, article_id, law_name, round(score, 2)::double as score, reason from r where place <= 10"


_PAGES = "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from documents), p as (select doc_id, pos // 20 + 1 as page_number, string_agg(line, chr(10) order by pos) as raw_text, count(*) as n_blocks, (doc_id % 50) / 100 + 0.5 as conf from l group by doc_id, pos // 20)\n"



def _odd(column: str) -> str:
    return f"case when length({column}) = 0 then 1.0 else length(regexp_replace({column}, '{_PLAIN}', '', 'g'))::double / length({column}) end"


def _articles(column: str) -> str:
    return f"len(list_distinct(regexp_extract_all({column}, '제\\s*(\\d+)\\s*조', 1)))"


_MEASURED = _PAGES + f", m as (select *, length(raw_text) as n, {_odd('raw_text')} as odd, {_articles('raw_text')} as articles from p)"

#: The report on a payload, line by line.
_REPORT = """'### 📋 [기본 거래 정보 요약]' || chr(10) || '| 항목 | 내용 |' || chr(10) || '| :--- | :--- |' || chr(10)
  || '| **수출자** | KOREA TRADING ' || (doc_id % 97) || ' CO., LTD |' || chr(10) || '| **수입자** | 미확인 |' || chr(10) || '| **선적항 / 하역항** | 미확인 / 미확인 |' || chr(10) || '| **거래 조건 (Incoterms)** | 미확인 |' || chr(10)
  || '| **거래 금액** | ' || trim(format('{:,.2f}', total::double)) || ' USD |' || chr(10) || '| **선적 기한 / 실제 선적** | 1997-01-01 / ' || date || ' |' || chr(10) || chr(10) || chr(10)
  || '### 🚨 [시스템 팩트 체크 결과]' || chr(10)
  || case when abs(2001 - total) > 0.01 then '❌ [결함 적발] 총액 불일치: 상세 합계(2001.0) != 명시된 총액(' || total::double || '). OCR 인식 오류(콤마 유실 등)가 의심됩니다.' else '✅ [정상 확인] 문서 내 수치 산술 정합성 확인 완료 (상세 합계와 총액 일치)' end || chr(10)
  || '✅ [정상 확인] 보험 부보율 적정: 120%' || chr(10)
  || case when total > 200000 then '❌ [결함 적발] Invoice 금액(' || total::double || ')이 LC 금액(200000.0)을 초과합니다.' else '✅ [정상 확인] LC/Invoice 금액 정합성 확인 (' || total::double || ' <= 200000.0)' end || chr(10)
  || case when date > '1997-01-01' then '❌ [결함 적발] 지연 선적 발생: 선적 마감일(1997-01-01)보다 선적일(' || date || ')이 늦습니다.' else '✅ [정상 확인] 선적일 적정 (' || date || ' <= 1997-01-01)' end || chr(10)
  || case when abs(2001 - total) > 0.01 or total > 200000 or date > '1997-01-01' then '' else '✅ 수치 및 날짜상 명백한 하자는 발견되지 않았습니다.' || chr(10) end || chr(10)
  || '### 📊 [Input Data Summary]' || chr(10) || '- Incoterms: None' || chr(10) || '- L/C Amount: 200,000' || chr(10) || '- Invoice Total: ' || trim(format('{:,.2f}', total::double)) || chr(10) || '- Insurance: 120%' || chr(10)"""

#: Readings with their faults, and what is measured of the good ones.
_RECORDS = """with d as (select doc_id, coalesce(text, '') as text, case when doc_id % 50 = 7 then 'skipped' when doc_id % 50 between 1 and 6 then 'error' else 'ok' end as status,
  case doc_id % 50 when 1 then 'no content' when 2 then 'not a reading in JSON' when 3 then 'not decoded: UnicodeDecodeError' when 4 then 'no pages' when 5 then 'a page without a number' when 6 then 'a page number given twice' end as error from documents),
p as (select doc_id, unnest(list_prepend('COMMERCIAL INVOICE' || chr(10) || 'Invoice No: INV-26-' || lpad(doc_id::varchar, 6, '0'), string_split(text, chr(10)))) as page, generate_subscripts(list_prepend('', string_split(text, chr(10))), 1) - 1 as i from d),
m as (select doc_id, count(*) as n_pages, sum(i % 3)::bigint as total_blocks, sum(length(page))::bigint as total_chars, round(coalesce(sum((i % 3) * ((i % 5) / 10 + 0.5)) / nullif(sum(i % 3), 0), 0), 6) as avg_confidence, md5(string_agg(page, chr(10) || chr(10) order by i)) as text_md5 from p group by doc_id)
"""

#: Facts, requests and verdicts of questions whose papers are known, missing or broken.
_JUDGED = """,
ctx as (select query_id, string_agg('Source: ' || law_name || ' (Art. ' || (article_id % 50 + 1) || ')' || chr(10) || 'Content: content of ' || article_id || chr(10) || chr(10), '' order by place) as context,
  string_agg('Source: ' || law_name || ' (Art. ' || (article_id % 50 + 1) || ')' || chr(10), '' order by place) as sources from r where place <= 3 group by 1),
kinds as (select query_id, query_id % 700 in (100, 200) as missing, query_id % 700 = 300 as broken, query_id % 300 = 100 as bare, query_id % 300 = 200 as over from q),
j as (select *, case when missing or broken then '주의' when over then '위험' when bare then '주의' else '적합' end as judgment, case when not missing and not broken and query_id % 200 = 0 then 'A' else 'B' end as instruction,
  case when missing then '검증 데이터 없음' when broken then '수치 검증 수행 불가' else
  '### 📋 [기본 거래 정보 요약]' || chr(10) || '| 항목 | 내용 |' || chr(10) || '| :--- | :--- |' || chr(10) || '| **수출자** | 미확인 |' || chr(10) || '| **수입자** | 미확인 |' || chr(10) || '| **선적항 / 하역항** | 미확인 / 미확인 |' || chr(10)
  || '| **거래 조건 (Incoterms)** | 미확인 |' || chr(10) || '| **거래 금액** | 100 USD |' || chr(10) || '| **선적 기한 / 실제 선적** | 2026-01-02 / 2026-01-01 |' || chr(10) || chr(10) || chr(10) || '### 🚨 [시스템 팩트 체크 결과]' || chr(10)
  || case when bare then '⚠️ [UNKNOWN] 품목 상세 정보가 없어 산술 검증을 수행할 수 없습니다.' else '✅ [정상 확인] 문서 내 수치 산술 정합성 확인 완료 (상세 합계와 총액 일치)' end || chr(10) || '✅ [정상 확인] 보험 부보율 적정: 110%' || chr(10)
  || case when over then '❌ [결함 적발] Invoice 금액(100.0)이 LC 금액(99.0)을 초과합니다.' else '✅ [정상 확인] LC/Invoice 금액 정합성 확인 (100.0 <= 100.0)' end || chr(10) || '✅ [정상 확인] 선적일 적정 (2026-01-01 <= 2026-01-02)' || chr(10)
  || case when over then '' else '✅ 수치 및 날짜상 명백한 하자는 발견되지 않았습니다.' || chr(10) end || chr(10)
  || '### 📊 [Input Data Summary]' || chr(10) || '- Incoterms: None' || chr(10) || '- L/C Amount: ' || case when over then '99' else '100' end || chr(10) || '- Invoice Total: 100' || chr(10) || '- Insurance: 110%' || chr(10) end as facts from kinds)
select query_id, instruction, judgment, 'PASS' as critic_feedback, 1::bigint as drafts, facts, coalesce(sources, '') as sources,
  instruction || chr(10) || chr(10) || 'Question: question ' || query_id || chr(10) || chr(10) || 'Facts:' || chr(10) || facts || chr(10) || chr(10) || 'Articles:' || chr(10) || coalesce(context, '') || chr(10) || chr(10)
  || 'Preferences:' || chr(10) || case when query_id % 400 = 0 then '### [이번 분석 특별 지시]' || chr(10) || 'be brief' || chr(10) || chr(10) else '' end || 'none' as request,
  repeat('═', 60) || chr(10) || '⚖️  최종 법적 판단' || chr(10) || repeat('═', 60) || chr(10) || chr(10) || '⚖️  [최종 판정]' || chr(10) || judgment || chr(10) || repeat('═', 60) as verdict from j left join ctx using (query_id)"""

QUERIES = {
    "check_arithmetic": (check_arithmetic, _LINES + "select doc_id, case when doc_id % 5 = 3 then 'FAIL' when bool_or(wrong = 1) then 'WARNING' else 'PASS' end as status from i group by doc_id"),
    "deal_checks": (deal_checks, _DEAL + """, c as (
  select doc_id, 'amounts' as "check", case when doc_id % 4 = 0 then 'UNKNOWN' when doc_id % 4 = 1 then 'ERROR' when total > 150000 then 'FAIL' else 'PASS' end as status,
    case when doc_id % 4 = 0 then '금액 정보(LC/Invoice)가 누락되었습니다.' when doc_id % 4 = 1 then '금액 데이터 형식이 올바르지 않습니다.'
      when total > 150000 then 'Invoice 금액(' || total::double || ')이 LC 금액(150000.0)을 초과합니다.' else 'LC/Invoice 금액 정합성 확인 (' || total::double || ' <= 150000.0)' end as message from d union all
  select doc_id, 'dates', case when doc_id % 3 = 1 then 'UNKNOWN' when date > latest then 'FAIL' else 'PASS' end,
    case when doc_id % 3 = 1 then '선적 관련 날짜가 누락되었습니다.' when date > latest then '지연 선적 발생: 선적 마감일(' || latest || ')보다 선적일(' || date || ')이 늦습니다.' else '선적일 적정 (' || date || ' <= ' || latest || ')' end
    from (select *, case when doc_id % 3 = 0 then '1998-01-01' else '1996-06-30' end as latest from d) union all
  select doc_id, 'insurance', case doc_id % 5 when 0 then 'PASS' when 2 then 'UNKNOWN' else 'FAIL' end,
    case doc_id % 5 when 0 then '보험 부보율 적정: 110%' when 1 then '보험 부보율 부족: 5% (최소 110% 필요)' when 2 then '보험 부보율 정보를 찾을 수 없습니다.' else '보험 부보율 부족: 99% (최소 110% 필요)' end from d)
select * from c"""),
    "check_policy": (check_policy, _DEAL + """select doc_id, 'no_fob_by_air' as rule, case when doc_id % 3 = 2 then 'UNKNOWN' when doc_id % 2 = 0 and doc_id % 3 = 0 then 'FAIL' else 'PASS' end as status from d union all
  select doc_id, 'one_currency', case when doc_id % 7 = 0 then 'FAIL' else 'PASS' end from d union all
  select doc_id, 'cover', case when doc_id % 3 = 2 then 'UNKNOWN' when doc_id % 3 = 1 and doc_id % 5 = 0 then 'FAIL' else 'PASS' end from d union all
  select doc_id, 'one_name', case when doc_id % 11 = 0 then 'FAIL' else 'PASS' end from d"""),
    "check_payload": (check_payload, _DEAL + "select doc_id, case when abs(2001 - total) > 0.01 then 'FAIL' else 'PASS' end as arithmetic, 'PASS' as insurance, case when total > 200000 then 'FAIL' else 'PASS' end as amounts, case when date > '1997-01-01' then 'FAIL' else 'PASS' end as dates, " + _REPORT + " as report from d"),
    "across_papers": (across_papers, _DEAL + "select doc_id as deal_id, case when total > 150000 then 'FAIL' else 'PASS' end as status, 'USD' as lc_currency from d"),
    "knn": (knn, _LAW + "select query_id, article_id, rank, round(distance, 6) as distance from n where rank <= 10"),
    "knn_buckets": (knn_buckets, None),
    "graph_degree": (graph_degree, _LAW + "select article_id, degree from degree"),
    "graph_expand": (graph_expand, _LAW + "select distinct article_id as query_id, other as article_id from ends where article_id in (select vec_id from e)"),
    "hybrid_search_vector_order": (hybrid_search_vector_order, _search_sql("rank")),
    "hybrid_search_score_order": (hybrid_search_score_order, _search_sql("score desc, rank")),
    "mandatory_rules": (mandatory_rules, "select vec_id, (vec_id % 4)::varchar as article_no, case vec_id % 3 when 1 then 'Summary one' else 'Summary two' end as summary from embeddings where (vec_id % 3 = 1 and vec_id % 4 in (1, 2)) or (vec_id % 3 = 2 and vec_id % 4 = 3)"),
    "page_stats": (page_stats, _LINES + "select doc_id, count(*) as n_blocks, sum(case when pos % 5 < 2 then 1 else 0 end)::bigint as n_low, round(avg((pos % 5) / 10 + 0.5), 6) as confidence, md5(string_agg('Part number ' || l_partkey || 'A', chr(10) order by pos desc)) as text_md5 from i group by doc_id"),
    "doc_stats": (doc_stats, _PAGES + "select doc_id, count(*) as n_pages, sum(n_blocks)::bigint as total_blocks, sum(length(raw_text))::bigint as total_chars, round(sum(conf * n_blocks) / sum(n_blocks), 6) as confidence, (sum(length(raw_text)) + 2 * (count(*) - 1))::bigint as full_chars from p group by doc_id"),
    "text_layer": (text_layer, _PAGES + ", t as (select doc_id, count(*) as n_pages, avg(case when page_number <= 3 then length(trim(raw_text, ' ' || chr(9) || chr(10) || chr(13))) end) >= 500 as is_text from p group by doc_id) select doc_id, n_pages, is_text, doc_id % 3 = 1 as is_image, case when is_text or doc_id % 3 = 1 then 'odl' else 'paddle' end as engine from t"),
    "page_recheck": (page_recheck, _MEASURED + """,
r as (select *, case when n_blocks > 0 and conf < 0.75 then 'low_conf(' || printf('%.2f', conf) || ')' end as low, case when n < 300 and n_blocks > 0 then 'short_text(' || n || ')' end as short,
  case when sum(articles) over (partition by doc_id) - articles >= 3 and articles = 0 and n > 200 then 'no_articles_suspect' end as bare, case when odd > 0.2 and n > 100 then 'high_gibberish' end as gibberish from m),
w as (select *, count(*) over (partition by doc_id) as many, case when low is not null then 0 when short is not null then 1 when bare is not null then 2 else 3 end as urgency from r where coalesce(low, short, bare, gibberish) is not null),
o as (select *, row_number() over (partition by doc_id order by case when many > 2 then urgency else 0 end, page_number) as place from w)
select doc_id, page_number, concat_ws(';', low, short, bare, gibberish) as reasons from o where place <= 2"""),
    "merge_decision": (merge_decision, _PAGES + f""", v as (select doc_id, page_number, raw_text as o, doc_id % 7 = 0 as failed,
    case doc_id % 5 when 0 then 'short' when 1 then raw_text || raw_text || '제1조 제2조 제3조 more' when 2 then raw_text || ' output only ... unreadable text' when 3 then raw_text else repeat(raw_text, 3) end as v from p),
m as (select *, length(o) as o_n, length(v) as v_n, {_odd('o')} as o_odd, {_odd('v')} as v_odd, {_articles('o')} as o_art, {_articles('v')} as v_art,
  (select count(*) from (values ('do not correct'), ('preserve line breaks'), ('unreadable'), ('output only'), ('read the image'), ('rules (strict)'), ('output format'), ('[system_prompt]')) as k(k) where contains(lower(v), k)) >= 2 as leak from v),
d as (select doc_id, page_number, case when failed then 'vlm_error' when v_n < 20 then 'vlm_too_short' when leak then 'vlm_prompt_leakage' when v_odd > 0.25 and v_odd > o_odd + 0.1 then 'vlm_gibberish' when o_n < 150 and v_n > o_n * 2 then 'orig_too_short'
  when v_art > o_art and v_art >= 3 then 'more_articles' when o_art >= 3 and v_art < o_art * 0.6 then 'vlm_lost_articles' when v_n > o_n * 1.2 and v_odd < 0.15 then 'longer_clean' else 'default' end as reason from m)
select doc_id, page_number, case when reason in ('orig_too_short', 'more_articles', 'longer_clean') then 'vlm' else 'original' end as chosen, reason from d"""),
    "hybrid_pages": (hybrid_pages, _MEASURED + f""", h as (select *, case doc_id % 5 when 0 then null when 1 then ' ' || chr(10) || chr(9) || ' ' when 2 then substring(raw_text, 1, 10) else 'merged ' || raw_text end as merged from m),
d as (select *, case when not (doc_id % 7 < 5 or n < 50 or odd > 0.1) then 'odl' when length(regexp_replace(coalesce(merged, ''), '{_WS}', '', 'g')) = 0 then 'merge_failed_fallback' when length(merged) < 0.3 * n then 'merge_rejected_too_short' else 'triangular_merge' end as mode from h)
select doc_id, page_number, mode, md5(case when mode = 'triangular_merge' then merged else raw_text end) as text_md5 from d"""),
    "judge_deals": (judge_deals, _found_sql("rank") + _JUDGED),
    "document_record": (document_record, _RECORDS + """select d.doc_id, status, error, case when status = 'ok' then 'CommercialInvoice' end as document_type, case when status = 'ok' then 'INV-26-' || lpad(d.doc_id::varchar, 6, '0') end as invoice_no, case when status = 'ok' then 'odl' end as engine,
  n_pages, total_blocks, total_chars, avg_confidence, text_md5 from d left join m on m.doc_id = d.doc_id and status = 'ok'"""),
    "record_stages": (record_stages, _RECORDS + """select 'read' as stage, count(*) as rows, count(*) filter (status = 'error') as failures, true as timed from d union all
  select 'parse', count(*), 0, true from d where status = 'ok' union all select 'record', count(*), count(*) filter (status = 'error'), true from d"""),
    "ledger_rerun": (ledger_rerun, "select doc_id, sha256(t) as sha256, length(t)::bigint as n_chars, case when doc_id % 3 = 0 then 1 else 0 end::bigint as batch, case when doc_id % 3 = 0 then 2 else 1 end::bigint as results from (select doc_id, case when doc_id % 3 = 0 then 'new ' else '' end || coalesce(text, '') as t from documents)"),
    "eval_recall": (eval_recall, "with d as (select o_orderkey as doc_id from orders join customer on o_custkey = c_custkey) select doc_id, case when doc_id % 3 = 0 then 0 when doc_id % 2 = 0 then 2 else 1 end::bigint as article_hits, round(case when doc_id % 3 = 0 then 0 when doc_id % 2 = 0 then 2 else 1 end * 100.0 / 3, 4)::double as article_recall, case when doc_id % 3 > 0 and doc_id % 2 = 0 then 1 else 0 end::bigint as keyword_hits, case when doc_id % 3 = 0 then '1,2,3' when doc_id % 2 = 0 then '3' else '2,3' end as missed from d"),
    "bench_summary": (bench_summary, "select 'm' || (doc_id % 3) as model, count(*) as n_docs, round(count(*) * 0.5, 6)::double as total_seconds, 0.5::double as avg_seconds, round(avg(doc_id % 101), 6) as avg_article_recall, round(avg(doc_id % 7), 6) as avg_keyword_recall from documents group by 1"),
    "input_hash": (input_hash, "select doc_id || '.txt' as name, sha256(coalesce(text, '')) as sha256, strlen(coalesce(text, ''))::bigint as n_bytes, 'text/plain' as media_type from documents"),
    "incremental_skip": (incremental, "select doc_id, doc_id % 2 = 0 as has_pages, doc_id % 5 = 0 as has_result from documents where doc_id % 3 <> 0"),
    "encrypt_roundtrip": (encrypt_roundtrip, "select doc_id::varchar as name, c as category, md5(coalesce(text, '')) as text_md5 from documents, (values ('docs'), ('reports')) as k(c) where doc_id % 4 <> 0 and not (doc_id % 4 = 1 and c = 'reports')"),
    "risk_counts": (risk_counts, _DEAL + "select variant, count(*) filter (doc_id % 5 = 0) as high, count(*) filter (doc_id % 5 = 1) as middle, count(*) filter (doc_id % 5 in (2, 4)) as low from d group by variant"),
    "stream_papers": (stream_papers, "select doc_id, 'B/L No: ' || doc_id as label, md5(replace(coalesce(text, ''), '\\n', chr(10))) as text_md5 from documents"),
}
