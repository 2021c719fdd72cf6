"""Queries of cleaning, repair and text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import elements
from ..operators import agent, clean, contracts, extract
from ..plans import render

BELL = "\x07"


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit(" \n\x0b"), F.coalesce("text", F.lit("")), F.lit(f"{BELL}\n\n\n\n\nend\x1f \t"))
    return docs.select("doc_id", F.md5(clean.sanitize(noisy)).alias("clean_md5"))


def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, after which a line comes doc_id % 8 times in a row between two others."""
    docs = render.table(spark, sf_dir, "documents")
    line = F.concat(F.lit("line "), F.col("doc_id").cast("string"), F.lit("\n"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\ntop\n"), F.repeat(line, (F.col("doc_id") % 8).cast("int")), F.lit("tail\ntail\ntail"))
    return docs.select("doc_id", F.md5(clean.collapse_repeats(text)).alias("text_md5"))


def swift_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(clean.unescape_lines(F.concat(F.lit(":50: A\\nB "), F.coalesce("text", F.lit(""))))).alias("text_md5"))


def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir).select("doc_id", "invoice_no")
    labels = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("glue")) for a, b in LABELS]))
    rows = d.select("doc_id", "invoice_no", labels.alias("l"))
    return rows.select("doc_id", F.col("l.label").alias("label"), clean.label_numbers(F.concat("l.label", "l.glue", "invoice_no")).alias("text"))


LABELS = (("B/L N0", ": "), ("B/LN0", ":"), ("REF NO", ":"), ("LC no", " "), ("Invoice N0", ". "), ("P/O No", ", "), ("Customer Now", " "), ("No way", " "))


def fields_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the deals with letters for digits; names of which two zeros were letters."""
    d = render.deals(spark, sf_dir)
    noisy = lambda c: F.translate(c, "0158", "OISB")
    # A numeric field is spoilt as a whole, an amount after its code.
    pairs = F.array(
        F.struct(F.lit("gross_weight").alias("field"), F.concat(noisy(F.col("weight")), F.lit(" KGS")).alias("value")),
        *[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in (
            ("total_amount", F.concat(F.lit("USD "), noisy(F.col("total_text")))), ("shipment_date", noisy(F.col("date"))), ("hs_code", noisy(F.lit("8471.50.01"))),
            ("exporter_name", F.concat(F.lit("C0SC0 "), F.col("weight"))), ("lc_no", noisy(F.col("lc_number"))), ("memo", noisy(F.col("weight"))),
        )],
    )
    rows = d.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.field", "p.value")
    return clean.fix_fields(rows).select("doc_id", "field", "value", "field_class", "changed")


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir).select("doc_id", F.lit("quantity").alias("field"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("IO"), F.col("weight"), F.lit(" PCS"))).otherwise(F.col("weight")).alias("value"))
    return clean.changes(d).select("doc_id", "field", "before", "after")


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.spread(render.table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit(" 제1조 제 2 조 제1조 ★★")).otherwise("")).alias("text"))
    return docs.select("doc_id", F.round(extract.plain_share("text"), 6).alias("odd_share"), extract.article_count("text").cast("bigint").alias("articles"), contracts.language("text").alias("language"))


def prompt_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = render.table(spark, sf_dir, "conversations")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.lit(" Output Only what is UNREADABLE")).when(F.col("turn") % 3 == 1, F.lit(" output only")).otherwise(""))
    return turns.select("conv_id", "turn", text.alias("text")).select("conv_id", "turn", extract.leaked("text").alias("leaked"))


def numbers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    text = F.concat(F.lit("weighs "), F.col("weight"), F.lit(" of -"), F.col("total_text"), F.lit(" or -5"))
    return elements(d.select("doc_id", text.alias("t")), ["doc_id"], extract.numbers("t"), "n").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("n").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"))


def prep_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = render.table(spark, sf_dir, "conversations")
    reply = F.concat(F.lit("noise <query> "), F.coalesce("text", F.lit("")), F.lit("\n</query> <jurisdiction>UK</jurisdiction> <query>second</query>"))
    rows = turns.select("conv_id", "turn", reply.alias("reply"))
    return rows.select("conv_id", "turn", F.md5(agent.tag("query", "reply")).alias("query_md5"), agent.tag("jurisdiction", "reply").alias("jurisdiction"), agent.tag("none", "reply").alias("absent"))


def critic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold a turn's whole text: passed, with instructions after the last mark, or free."""
    turns = render.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n결과: Pass"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("- 결과: FAIL\n수정 지시: a\n수정 지시: \t"), "text", F.lit(" \n"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", reply.alias("reply")).select("conv_id", "turn", F.md5(agent.feedback("reply")).alias("feedback_md5"), F.length(agent.feedback("reply")).cast("bigint").alias("n_chars"))


def instruction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.deals(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, render.KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    one = F.concat(F.lit('{"document_type":"'), kind, F.lit('"}'))
    payload = F.when(F.col("variant") == 0, one).when(F.col("variant") == 1, F.concat(F.lit("[{\"data\":"), one, F.lit("}]"))).otherwise(F.lit("a question"))
    return d.select("doc_id", payload.alias("p")).select("doc_id", agent.instruction("p").alias("instruction"), agent.is_payload("p").alias("is_payload"))


def draft_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drafts at most; deals whose number divides by 3 pass at once, by 2 at the second."""
    d = render.deals(spark, sf_dir).select("doc_id")
    write = lambda s: s.withColumn("judgment", F.concat(F.lit("draft "), (F.col("resolve_count") + 1).cast("string")))
    review = lambda s: s.withColumn("reply", F.when((F.col("doc_id") % 3 == 0) | ((F.col("doc_id") % 2 == 0) & (F.col("resolve_count") == 1)), "PASS").otherwise("수정 지시: more"))
    return agent.drafted(d, write, review).select("doc_id", "judgment", "critic_feedback", F.col("resolve_count").cast("bigint").alias("resolve_count"))


_DEAL = "select o_orderkey as doc_id, o_totalprice::decimal(18,2) as total, strftime(o_orderdate, '%Y-%m-%d') as date, (o_orderkey % 9000 + 100)::varchar as weight, 'M10LC' || lpad(o_orderkey::varchar, 9, '0') as lc_number, 'INV-26-' || lpad((o_orderkey % 1000000)::varchar, 6, '0') as invoice_no from orders join customer on o_custkey = c_custkey"
_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PLAIN = "[A-Za-z0-9가-힣" + _WS[1:-1] + r".,:;()/\-+*#@%''\"!?\[\]{}<>\\&=$^`~|_·①-⑳]"

QUERIES = {
    "sanitize_text": (sanitize_text, f"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(' ' || chr(10) || chr(11) || coalesce(text, '') || chr(7) || repeat(chr(10), 5) || 'end' || chr(31) || ' ' || chr(9),
        '[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')) as clean_md5 from documents"""),
    "collapse_repeats": (collapse_repeats, """with t as (select doc_id, coalesce(text, '') || chr(10) || 'top' || chr(10) || repeat('line ' || doc_id || chr(10), doc_id % 8) || 'tail' || chr(10) || 'tail' || chr(10) || 'tail' as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos, len(string_split(text, chr(10))) as last from t),
g as (select *, pos - row_number() over (partition by doc_id, line, pos = last order by pos) as run from l),
k as (select *, count(*) over (partition by doc_id, line, pos = last, run) as n, row_number() over (partition by doc_id, line, pos = last, run order by pos) as i from g)
select doc_id, md5(string_agg(line, chr(10) order by pos)) as text_md5 from k where n < 5 or i = 1 group by doc_id"""),
    "swift_unescape": (swift_unescape, "select doc_id, md5(replace(':50: A\\nB ' || coalesce(text, ''), '\\n', chr(10))) as text_md5 from documents"),
    "label_normalise": (label_normalise, f"with d as ({_DEAL}) select doc_id, label, want || glue || invoice_no as text from d, (values ('B/L N0', 'B/L No', ': '), ('B/LN0', 'B/L No', ':'), ('REF NO', 'REF No', ':'), ('LC no', 'LC No', ' '), ('Invoice N0', 'Invoice No', '. '), ('P/O No', 'P/O No', ', '), ('Customer Now', 'Customer Now', ' '), ('No way', 'No way', ' ')) as l(label, want, glue)"),
    "fields_repaired": (fields_repaired, f"""with d as ({_DEAL}), f as (
        select doc_id, 'gross_weight' as field, translate(weight, '0158', 'OISB') || ' KGS' as b, weight || ' KGS' as value, 'quantity' as field_class from d union all
        select doc_id, 'total_amount', 'USD ' || translate(format('{{:,.2f}}', total::double), '0158', 'OISB'), 'USD ' || format('{{:,.2f}}', total::double), 'amount' from d union all
        select doc_id, 'shipment_date', translate(date, '0158', 'OISB'), date, 'date' from d union all
        select doc_id, 'hs_code', 'x', '8471.50.01', 'numeric' from d union all
        select doc_id, 'exporter_name', 'x', 'COSCO ' || weight, 'alpha' from d union all
        select doc_id, 'lc_no', v, v, 'mixed' from (select doc_id, translate(lc_number, '0158', 'OISB') as v from d) union all
        select doc_id, 'memo', v, v, 'unknown' from (select doc_id, translate(weight, '0158', 'OISB') as v from d))
        -- a weight whose letters are one unit word can't be told from a unit
        select doc_id, field, value, field_class, b <> value as changed from f"""),
    "field_changes": (field_changes, f"with d as ({_DEAL}) select doc_id, 'quantity' as field, 'IO' || weight || ' PCS' as before, '10' || weight || ' PCS' as after from d where doc_id % 2 = 0"),
    "text_measures": (text_measures, f"""with t as (select doc_id, coalesce(text, '') || case when doc_id % 3 = 0 then ' 제1조 제 2 조 제1조 ★★' else '' end as text from documents)
        select doc_id, case when length(text) = 0 then 1.0 else round(length(regexp_replace(text, '{_PLAIN}', '', 'g'))::double / length(text), 6) end as odd_share,
          len(list_distinct(regexp_extract_all(text, '제\\s*(\\d+)\\s*조', 1)))::bigint as articles,
          case when length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) = 0 then 'en' when length(regexp_replace(text, '[^가-힣]', '', 'g'))::double / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) > 0.5 then 'ko'
            when length(regexp_replace(text, '[^가-힣]', '', 'g'))::double / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < 0.05 then 'en' else 'mixed' end as language from t"""),
    "prompt_leaks": (prompt_leaks, "with t as (select conv_id, turn, lower(coalesce(text, '') || case turn % 3 when 0 then ' Output Only what is UNREADABLE' when 1 then ' output only' else '' end) as t from conversations) select conv_id, turn, (select count(*) from (values ('do not correct'), ('preserve line breaks'), ('unreadable'), ('output only'), ('read the image'), ('rules (strict)'), ('output format'), ('[system_prompt]')) as m(m) where contains(t, m)) >= 2 as leaked from t"),
    "numbers_found": (numbers_found, f"with d as ({_DEAL}) select doc_id, 3::bigint as n, (weight::decimal(18,2) - total + 5)::decimal(18,2) as total from d"),
    "prep_tags": (prep_tags, f"select conv_id, turn, md5(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g')) as query_md5, 'UK' as jurisdiction, '' as absent from conversations"),
    "critic_parse": (critic_parse, f"""with t as (select conv_id, turn, coalesce(text, '') as text from conversations),
f as (select conv_id, turn, case when turn % 3 = 0 or contains(upper(text), 'PASS') then 'PASS' when turn % 3 = 1 then regexp_replace(regexp_replace(text, '^{_WS}+', ''), '{_WS}+$', '') else text end as feedback from t)
select conv_id, turn, md5(feedback) as feedback_md5, length(feedback)::bigint as n_chars from f"""),
    "instruction_choice": (instruction_choice, "select o_orderkey as doc_id, case when o_orderkey % 7 = 6 and o_orderkey % 3 < 2 then 'A' else 'B' end as instruction, o_orderkey % 3 < 2 as is_payload from orders join customer on o_custkey = c_custkey"),
    "draft_loop": (draft_loop, "select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then 'draft 1' else 'draft 2' end as judgment, case when o_orderkey % 3 = 0 or o_orderkey % 2 = 0 then 'PASS' else 'more' end as critic_feedback, case when o_orderkey % 3 = 0 then 1 else 2 end::bigint as resolve_count from orders join customer on o_custkey = c_custkey"),
}
