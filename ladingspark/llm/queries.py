"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, divergence, lm, media, mixing, quality, runs, sharding, simhash, token_counts, urls
from .common import read, text_of

#: The rules of the url query (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bytes of text a shard may hold. Stores are often cut at 64 MB and more; 1 MiB also cuts small tables.
SHARD_BYTES = 1 << 20


def tokenizer_json(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path("byte_bpe_50k.json")).read_text()


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op2_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"), keep_media=False)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "host", "path", "p_low", "p_toxic", "low_host_rate", "low_path_rate", "toxic_host_rate", "toxic_path_rate", (~F.col("rejected")).alias("keep"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_json(), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, F.octet_length(text_of()), SHARD_BYTES)
    return placed.select("row.doc_id", F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"), "shard", "page", "shard_bytes", "oversize")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.lengths(read(spark, sf_dir, "documents"), Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_text(), public_tokenizers.PATTERN)
    return token_counts.histogram(lengths)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read(spark, sf_dir, "documents"), rewrite=runs.planted)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(read(spark, sf_dir, "documents"))
    milli = [F.floor(1000 * F.col(f"{c}_distance")).alias(f"{c}_milli") for c in ("character", "common")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *milli)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_lm_scoring, op2_media_png, op3_quality_classifier, op4_url_filter, op5_mixing, op6_bpe, op7_simhash, op8_ann, op9_sharding, op10_token_counts, op11_periodic_runs, op12_collocations, op13_quality_rules)
    }


#: The rules as SQL values, in the same order.
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

OP4_SQL = f"""
with u as (select page_id, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from u),
h as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substring(rest, length(raw_host) + 1), '^[^?#]*') as path from p),
r(rule_host, rule_path, verdict) as (values {_RULES}),
fits as (select page_id, rule_host || rule_path as rule, verdict, row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join fits on h.page_id = fits.page_id and place = 1
"""

OP5_SQL = r"""
with d as (select doc_id, source, md5(coalesce(text, '')) as digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select source, source_size, place % 3 + 1 as weight, 3 * source_size as cap, sum(source_size) over () as total from s),
-- a source is capped if its cap is below its share once all sources with a smaller cap for their weight are capped
o as (select *, total - coalesce(sum(cap) over before, 0) as left_words, sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as left_weight from w
  window before as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, cap <= weight * left_words / left_weight::double as capped from o),
f as (select sum(case when capped then 0 else weight end) as free_weight, min(total) - sum(case when capped then cap else 0 end) as free_words from c),
t as (select source, source_size, case when capped then cap::double else (weight * free_words)::double / free_weight end as target from c, f),
x as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
  ('0x' || substring(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || digest), 1, 12))::bigint / 281474976710656.0 as uniform from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target, (size * (floor(rate) + case when uniform < rate - floor(rate) then 1 else 0 end))::bigint as taken from x
"""


def op9_sql() -> str:
    """All prefixes of all depths, and which of them are closed below one that is not."""
    null = "'93b885adfe0da089cdf634904fd59f71'"  # the digest that stands for a null
    digest = f"md5(coalesce(md5(doc_id::varchar), {null}) || ':' || coalesce(md5(text), {null}))"
    return f"""
with d as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, {digest} as digest from documents),
h as (select *, ('0x' || substring(digest, 1, 15))::bigint as hash from d),
p as (select depth, hash >> (60 - depth) as prefix, sum(n_bytes) as bytes, min(hash) = max(hash) as equal from h, range(0, 61) as r(depth) group by 1, 2),
c as (select *, bytes <= {SHARD_BYTES} or equal as closed from p),
s as (select c.* from c left join c as up on up.depth = c.depth - 1 and up.prefix = c.prefix >> 1 where c.closed and (c.depth = 0 or not up.closed)),
x as (select h.*, depth, bytes, bytes > {SHARD_BYTES} as paged, case when depth = 0 then '*' else lpad(bin(prefix), depth::int, '0') end as shard, greatest(1, {SHARD_BYTES} // greatest(n_bytes, 1)) as fit,
  row_number() over (partition by digest) - 1 as copy, count(*) over (partition by digest) as copies from h join s on prefix = hash >> (60 - depth))
select doc_id, n_bytes, shard, case when paged then copy // fit else 0 end::bigint as page, case when paged then n_bytes * least(fit, copies - copy // fit * fit) else bytes end::bigint as shard_bytes, paged and n_bytes > {SHARD_BYTES} as oversize from x
"""


OP12_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
p as (select lang, unnest(string_split_regex(low, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, row_number() over () as pid, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, pid, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (select lang, x, lead(x) over o as y, lead(x, 2) over o as z from t window o as (partition by pid order by i)),
f1 as (select lang, x, count(*) as f from g group by lang, x),
f2 as (select lang, x, y, count(*) as f from g where y is not null group by lang, x, y having count(*) >= 10),
f3 as (select lang, x, y, z, count(*) as f from g where z is not null group by lang, x, y, z having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
cut as (
  select lang, x || ' ' || y as phrase, f2.f as a, 1 as k, l.f as l, r.f as r from f2 join f1 as l using (lang, x) join f1 as r on r.lang = f2.lang and r.x = f2.y
  union all
  select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, l.f, r.f from f3 join f1 as l on l.lang = f3.lang and l.x = f3.x join f2 as r on r.lang = f3.lang and r.x = f3.y and r.y = f3.z
  union all
  select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, l.f, r.f from f3 join f2 as l on l.lang = f3.lang and l.x = f3.x and l.y = f3.y join f1 as r on r.lang = f3.lang and r.x = f3.z),
scored as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cut),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored),
inside as (select lang, phrase, max(f) as longer from (select lang, x || ' ' || y as phrase, f from f3 union all select lang, y || ' ' || z, f from f3) group by all),
kept as (select lang, phrase, a, l, r, score from best left join inside using (lang, phrase) where place = 1 and (longer is null or 100 * longer < 50 * a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""

#: Classes of characters, as patterns, in the operator's order; the last is what remains.
_CLASSES = (r"\p{Lu}\p{Lt}", r"\p{Ll}", r"\p{Lo}\p{Lm}", r"\p{N}", r"\p{P}", r"\p{S}", r"\p{Z}\x09-\x0D")

OP13_SQL = rf"""
with d as (select row_number() over () as doc, doc_id, coalesce(lang, 'und') as lang, coalesce(text, '') as text from documents),
b as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
  [{", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g'))" for c in _CLASSES)}] as seen from d),
h as (select *, list_append(seen, length(text) - list_sum(seen)::bigint) as classes from b),
each_ as (select doc, unnest(w) as word, generate_subscripts(w, 1) as i from h),
win as (select doc, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as five from each_ window o as (partition by doc order by i)),
twice as (select doc, i from (select doc, i, count(*) over (partition by doc, five) as times from win where five is not null) where times > 1),
again as (select doc, count(*) as n from (select distinct doc, i + unnest(range(0, 5)) as at from twice) group by doc),
base as (select h.doc, doc_id, lang, classes, length(text) as n_chars, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(again.n, 0)::bigint as n_repeat_words
  from h left join again on again.doc = h.doc),
counts as (select lang, doc, word, count(*) as n from (select lang, doc, unnest(w) as word from h) group by all),
total as (select lang, sum(n_words)::bigint as ref_words from base group by lang),
top as (select lang, word, n from (select lang, word, sum(n)::bigint as n, row_number() over (partition by lang order by sum(n) desc, word) as place from counts group by lang, word) where place <= 64),
asked as (select base.*, ref_words from base join total using (lang) where n_words >= 50 and ref_words >= 10000),
refs as (select lang, k, sum(classes[k]) as n from base, range(1, 9) as r(k) group by lang, k),
bins as (
  select asked.doc, 'c' as kind, classes[k] / n_chars as p, n / (sum(n) over (partition by asked.doc)) as q from asked join refs using (lang)
  union all
  select asked.doc, 'w', coalesce(counts.n, 0) / n_words, top.n / ref_words from asked join top using (lang) left join counts on counts.doc = asked.doc and counts.word = top.word
  union all
  select asked.doc, 'w', 1 - coalesce(sum(counts.n), 0) / any_value(n_words), 1 - sum(top.n) / any_value(ref_words) from asked join top using (lang) left join counts on counts.doc = asked.doc and counts.word = top.word group by asked.doc),
js as (select doc, kind, count(*) as size, greatest(0.0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2) as square from bins group by doc, kind),
verdict as (select asked.doc, floor(1000 * sqrt(c.square))::bigint as character_milli, floor(1000 * sqrt(x.square))::bigint as common_milli,
  c.square > {divergence.CHARACTERS} ** 2 + 7 / (8 * n_chars * ln(2)) or x.square > {divergence.COMMON} ** 2 + (x.size - 1) / (8 * n_words * ln(2)) as bad
  from asked join js as c on c.doc = asked.doc and c.kind = 'c' join js as x on x.doc = asked.doc and x.kind = 'w')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(bad, false) as kept, character_milli, common_milli
from base left join verdict on verdict.doc = base.doc
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins. The others can't be said in SQL: tests/llm holds them against brute force or the libraries."""
    return {"op4_url_filter": OP4_SQL, "op5_mixing": OP5_SQL, "op9_sharding": op9_sql(), "op12_collocations": OP12_SQL, "op13_quality_rules": OP13_SQL}
