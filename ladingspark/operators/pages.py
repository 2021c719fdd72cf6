"""Decisions on pages that were read by machine, and how good the reading is.

Pages are rows of doc_id, page_number, raw_text, n_blocks, avg_confidence, or carry their blocks.
Reading itself (by a layout extractor, a recognition engine, a vision model) is done by functions
that the caller plugs in; see `reread`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalogs import policy as P
from . import extract


def page_stats(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """pages with blocks in reading order, raw_text, avg_confidence, low_confidence_ratio, n_blocks, n_low_confidence.

    Reading order: from the top, then from the left, then as given. Without blocks: empty text and zeros.
    """
    order = "(a, b) -> case when a.b.bbox_aabb[1] <> b.b.bbox_aabb[1] then a.b.bbox_aabb[1] - b.b.bbox_aabb[1] when a.b.bbox_aabb[0] <> b.b.bbox_aabb[0] then a.b.bbox_aabb[0] - b.b.bbox_aabb[0] else a.i - b.i end"
    given = f"coalesce({blocks}, slice({blocks}, 1, 0))"
    out = pages.withColumn(blocks, F.expr(f"transform(array_sort(transform({given}, (b, i) -> named_struct('b', b, 'i', i)), {order}), x -> x.b)"))
    total = "aggregate({0}, 0.0D, (s, b) -> s + b.confidence)".format(blocks)
    low = f"size(filter({blocks}, b -> b.confidence < {P.LOW_BLOCK}))"
    n = f"size({blocks})"
    return out.withColumns({
        "raw_text": F.expr(f"coalesce(array_join(transform({blocks}, b -> b.text), '\\n'), '')"), "n_blocks": F.expr(f"greatest({n}, 0)"),
        "avg_confidence": F.expr(f"if({n} > 0, {total} / {n}, 0.0D)"), "n_low_confidence": F.expr(f"if({n} > 0, {low}, 0)"),
        "low_confidence_ratio": F.expr(f"if({n} > 0, double({low}) / {n}, 0.0D)"),
    })


def joined_text(separator: str = "\n\n", text: str = "raw_text") -> Column:
    """Aggregate: the texts of a document's pages in order. A document's pages come together; they are one row's text anyway."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda p: p["t"]), separator)


def document_stats(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, total_blocks, total_chars, avg_confidence (by blocks), full_text."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum("n_blocks").alias("total_blocks"), F.sum(F.length("raw_text")).alias("total_chars"),
        F.coalesce(F.try_divide(F.sum(F.col("avg_confidence") * F.col("n_blocks")), F.sum("n_blocks")), F.lit(0.0)).alias("avg_confidence"),
        joined_text().alias("full_text"),
    )


def text_layer(pages: DataFrame, least: int = P.TEXT_PAGE_CHARS, sample: int = P.TEXT_SAMPLE_PAGES) -> DataFrame:
    """doc_id, n_pages, avg_chars_per_page, is_text: whether the first pages hold so many characters on average."""
    first = F.when(F.col("page_number") <= sample, F.length(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)^\s+|\s+$", "")))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.coalesce(F.avg(first), F.lit(0.0)).alias("avg_chars_per_page"))
    return out.withColumn("is_text", F.col("avg_chars_per_page") >= least)


def suffix(path: str) -> Column:
    return F.lower(F.regexp_extract(F.col(path), r"(\.[^./\\]+)$", 1))


def routed(files: DataFrame, path: str = "path", is_text: str = "is_text", has_out_dir: Column | None = None, force: Column | None = None) -> DataFrame:
    """files with is_image and engine: odl for text layers and pictures if there is a place for its output, else paddle. force: 'odl', 'paddle' or null."""
    image = suffix(path).isin(*P.IMAGES)
    forced = force if force is not None else F.lit(None).cast("string")
    text = F.when(forced == "odl", True).when(forced == "paddle", False).otherwise(F.coalesce(F.col(is_text), F.lit(False)) & (suffix(path) == ".pdf"))
    place = has_out_dir if has_out_dir is not None else F.lit(True)
    return files.withColumn("is_image", image).withColumn("engine", F.when((text | image) & place, "odl").otherwise("paddle"))


def recheck_reasons(pages: DataFrame, sure: float = P.SURE_PAGE, least: int = P.PAGE_CHARS) -> DataFrame:
    """pages with reasons (array): why a page should be read again; empty if it need not."""
    out = pages.withColumn("_articles", extract.article_count("raw_text")).withColumn("_odd", extract.plain_share("raw_text")).withColumn("_n", F.length(F.coalesce("raw_text", F.lit(""))))
    others = F.sum("_articles").over(Window.partitionBy("doc_id")) - F.col("_articles")
    low = (F.col("n_blocks") > 0) & (F.col("avg_confidence") < sure)
    reasons = F.array(
        F.when(low, F.format_string("low_conf(%.2f)", "avg_confidence")),
        F.when((F.col("_n") < least) & (F.col("n_blocks") > 0), F.format_string("short_text(%d)", "_n")),
        F.when(F.col("n_blocks") == 0, "no_blocks"),
        F.when((others >= 3) & (F.col("_articles") == 0) & (F.col("_n") > 200), "no_articles_suspect"),
        F.when((F.col("_odd") > 0.2) & (F.col("_n") > 100), "high_gibberish"),
    )
    return out.withColumn("reasons", F.array_compact(reasons)).drop("_articles", "_odd", "_n")


def pages_to_recheck(pages: DataFrame, most: int = P.MOST_RECHECKS, **limits) -> DataFrame:
    """The pages with reasons, `most` a document: low confidence first, then short, then without articles, then the rest."""
    out = recheck_reasons(pages, **limits).filter(F.size("reasons") > 0)
    starts = lambda word: F.exists("reasons", lambda r: F.startswith(r, F.lit(word)))
    urgency = F.when(starts("low_conf"), 0).when(starts("short_text"), 1).when(starts("no_articles"), 2).otherwise(3)
    own = Window.partitionBy("doc_id")
    # Pages stay in their own order where all of a document's fit.
    place = F.row_number().over(own.orderBy(F.when(F.col("_many") > most, urgency).otherwise(0), "page_number"))
    return out.withColumn("_many", F.count("*").over(own)).withColumn("_place", place).filter(F.col("_place") <= most).drop("_many", "_place")


def choose_text(pages: DataFrame, original: str = "raw_text", other: str = "vlm_text", error: str = "vlm_error") -> DataFrame:
    """pages with chosen ('original' or 'vlm'), decision_reason and final_text. The first rule that fits decides."""
    o, v = (F.coalesce(F.col(c), F.lit("")) for c in (original, other))
    out = pages.withColumns({"_og": extract.plain_share(original), "_vg": extract.plain_share(other), "_oa": extract.article_count(original), "_va": extract.article_count(other), "_leak": extract.leaked(other), "_on": F.length(o), "_vn": F.length(v)})
    og, vg, oa, va, on, vn = (F.col(c) for c in ("_og", "_vg", "_oa", "_va", "_on", "_vn"))
    keep = lambda reason: F.struct(F.lit("original").alias("chosen"), reason.alias("why"))
    take = lambda reason: F.struct(F.lit("vlm").alias("chosen"), reason.alias("why"))
    rules = (
        F.when(F.coalesce(F.col(error), F.lit("")) != "", keep(F.concat(F.lit("vlm_error:"), F.substring(F.col(error), 1, 40))))
        .when(vn < 20, keep(F.lit("vlm_too_short")))
        .when(F.col("_leak"), keep(F.lit("vlm_prompt_leakage")))
        .when((vg > 0.25) & (vg > og + 0.1), keep(F.format_string("vlm_gibberish(%.2f)", vg)))
        .when((on < 150) & (vn > on * 2), take(F.lit("orig_too_short")))
        .when((va > oa) & (va >= 3), take(F.format_string("more_articles(%d->%d)", oa, va)))
        .when((oa >= 3) & (va < oa * 0.6), keep(F.format_string("vlm_lost_articles(%d->%d)", oa, va)))
        .when((vn > on * 1.2) & (vg < 0.15), take(F.format_string("longer_clean(%d->%d)", on, vn)))
        .otherwise(keep(F.lit("default")))
    )
    out = out.withColumn("_d", rules).withColumn("chosen", F.col("_d.chosen")).withColumn("decision_reason", F.col("_d.why"))
    return out.withColumn("final_text", F.when(F.col("chosen") == "vlm", v).otherwise(o)).drop("_d", "_og", "_vg", "_oa", "_va", "_leak", "_on", "_vn")


def reread(pages: DataFrame, reader: Callable[[DataFrame], DataFrame], engine: Column | None = None, **limits) -> DataFrame:
    """pages with raw_text as the rules choose it, and chosen and decision_reason where a page was read again.

    reader: takes the pages to read again and returns doc_id, page_number, vlm_text, vlm_error (for
    instance by mapInPandas with a model that is loaded once a task). engine: rows where it is hybrid
    or odl are left alone.
    """
    due = pages if engine is None else pages.filter(~F.coalesce(engine.isin("hybrid", "odl"), F.lit(False)))
    asked = pages_to_recheck(due, **limits)
    answers = reader(asked).select("doc_id", "page_number", "vlm_text", "vlm_error")
    judged = choose_text(asked.join(answers, ["doc_id", "page_number"])).select("doc_id", "page_number", "chosen", "decision_reason", "final_text")
    out = pages.join(judged, ["doc_id", "page_number"], "left")
    return out.withColumn("raw_text", F.coalesce("final_text", "raw_text")).drop("final_text")


def hybrid_pages(pages: DataFrame, merged: str = "merged_text", is_image: Column | None = None, least: int = P.TEXT_PAGE_CHARS, always_test: bool = True) -> DataFrame:
    """pages with mode and final_text from the text layer and a merged reading.

    A page is doubtful if it is a picture, short, or odd in its characters; its merged text is taken
    unless that is blank or shorter than .3 of the layer's. always_test=False: nothing is merged in a
    document in which no page is short.
    """
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    image = is_image if is_image is not None else F.lit(False)
    short = image | (F.length(text) < least)
    doubtful = short | (extract.plain_share("raw_text") > 0.1)
    if not always_test:
        doubtful = doubtful & F.max(short).over(Window.partitionBy("doc_id"))
    blank = F.length(F.regexp_replace(F.coalesce(F.col(merged), F.lit("")), r"(?U)\s+", "")) == 0
    mode = F.when(~doubtful, "odl").when(blank, "merge_failed_fallback").when(F.length(merged) < 0.3 * F.length(text), "merge_rejected_too_short").otherwise("triangular_merge")
    return pages.withColumn("mode", mode).withColumn("final_text", F.when(F.col("mode") == "triangular_merge", F.col(merged)).otherwise(text))


def ground_truth(documents: DataFrame) -> DataFrame:
    """doc_id, articles (array), article_titles (map), sample_texts (first 20 of the first 50 parts' longer texts)."""
    subs = "document.sub_documents"
    words = "array_join(transform(coalesce(s.contents, array()), c -> coalesce(c.text, '')), ' ')"
    titles = f"transform(filter({subs}, s -> s.is_article_title and s.article is not null), s -> named_struct('key', s.article, 'value', trim({words})))"
    last = "aggregate({0}, cast(map() as map<int,string>), (m, e) -> map_concat(map_filter(m, (k, v) -> k <> e.key), map(e.key, e.value)))".format(titles)
    texts = f"slice(filter(flatten(transform(filter(slice({subs}, 1, 50), s -> s.type = 'TEXT'), s -> transform(s.contents, c -> trim(c.text)))), t -> length(t) > 10), 1, 20)"
    return documents.select("doc_id", F.expr(f"array_sort(array_distinct(array_compact(transform({subs}, s -> s.article))))").alias("articles"), F.expr(last).alias("article_titles"), F.expr(texts).alias("sample_texts"))


def recall(responses: DataFrame, truth: DataFrame) -> DataFrame:
    """responses (doc_id, response) with article_recall, article_hits, missed_articles, keyword_recall, keyword_hits, response_length.

    An article is found if its number is written as such, or the first 15 characters of its title
    without blanks are there; a text if its first 30 are. An empty response finds nothing.
    """
    out = responses.join(truth, "doc_id").withColumn("_r", F.coalesce("response", F.lit("")))
    bare = lambda c: f"regexp_replace({c}, '(?U)\\\\s+', '')"
    out = out.withColumn("_b", F.expr(bare("_r")))
    found = f"contains(_r, concat('제', e.key, '조')) or contains(_b, substring({bare('e.value')}, 1, 15))"
    out = out.withColumn("_hit", F.expr(f"filter(map_entries(article_titles), e -> length(_r) > 0 and ({found}))"))
    out = out.withColumn("_miss", F.expr(f"transform(filter(map_entries(article_titles), e -> not (length(_r) > 0 and ({found}))), e -> e.key)"))
    out = out.withColumn("missed_articles", F.expr("if(length(_r) = 0, articles, array_sort(_miss))"))
    probe = f"substring({bare('t')}, 1, 30)"
    out = out.withColumn("keyword_hits", F.expr(f"size(filter(sample_texts, t -> length(_r) > 0 and {probe} <> '' and contains(_b, {probe})))"))
    share = lambda part, whole: F.when(whole > 0, part / whole * 100).otherwise(0.0)
    out = out.withColumn("article_hits", F.size("_hit")).withColumn("response_length", F.length("_r"))
    out = out.withColumn("article_recall", share(F.col("article_hits"), F.size("articles"))).withColumn("keyword_recall", share(F.col("keyword_hits"), F.size("sample_texts")))
    return out.drop("_r", "_b", "_hit", "_miss", "articles", "article_titles", "sample_texts")


def benchmark(scores: DataFrame) -> DataFrame:
    """A row a model: documents, total and mean seconds, mean recalls."""
    return scores.groupBy("model").agg(F.count("*").alias("n_docs"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("avg_seconds"), F.avg("article_recall").alias("avg_article_recall"), F.avg("keyword_recall").alias("avg_keyword_recall"))
