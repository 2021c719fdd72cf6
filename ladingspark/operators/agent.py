"""From facts and articles to a verdict: tags, prompts, drafts, review.

The model is a function from a DataFrame to a DataFrame that the caller plugs in; without one a
verdict follows from the checks. Every step is DataFrame to DataFrame; the loop over drafts is
bounded by MOST_DRAFTS.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogs import policy as P
from ..functions.tables import kept
from ..functions.templates import filled as rendered

Writer = Callable[[DataFrame], DataFrame]


def tag(name: str, text: str) -> Column:
    """What stands between <name> and </name> first, stripped; '' if nothing does."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), f"(?s)<{name}>(.*?)</{name}>", 1), r"(?U)^\s+|\s+$", "")


def feedback(reply: str) -> Column:
    """PASS if the reply says so anywhere, else what follows the last mark of instructions, else the reply."""
    text = F.coalesce(F.col(reply), F.lit(""))
    after = F.regexp_replace(F.substring_index(text, P.FEEDBACK_MARK, -1), r"(?U)^\s+|\s+$", "")
    return F.when(F.contains(F.upper(text), F.lit("PASS")), "PASS").when(F.contains(text, F.lit(P.FEEDBACK_MARK)), after).otherwise(text)


def document_type(payload: str) -> Column:
    """document_type of an object, or of a list's first element, there or under `data`."""
    text = F.col(payload)
    return F.coalesce(F.get_json_object(text, "$.document_type"), F.get_json_object(text, "$[0].document_type"), F.get_json_object(text, "$[0].data.document_type"))


def instruction(payload: str, readable: str | None = None) -> Column:
    """A for a contract by itself, else B; what is no JSON (readable: a column that says so) is B whatever its first letters say."""
    reviewed = F.contains(F.lower(F.coalesce(document_type(payload), F.lit(""))), F.lit(P.REVIEWED))
    return F.when(reviewed if readable is None else reviewed & F.coalesce(F.col(readable), F.lit(False)), "A").otherwise("B")


def is_payload(text: str, lists: bool = True) -> Column:
    """Whether a text is to be read as papers and not as a question: an object, and a list too unless lists is false."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    of = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    return of("{", "}") | of("[", "]") if lists else of("{", "}")


def context(hits: DataFrame, with_content: bool = True) -> DataFrame:
    """query_id, context: the best three articles of each query as text, contents cut."""
    head = F.concat(F.lit("Source: "), F.col("law_name"), F.lit(" (Art. "), F.col("article_no").cast("string"), F.lit(")\n"))
    body = F.concat(head, F.lit("Content: "), F.substring("content", 1, P.CONTENT_CHARS), F.lit("\n\n")) if with_content else head
    best = hits.filter(F.col("place") <= P.GRADED).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", body.alias("t")))).alias("_c"))
    return best.select("query_id", F.array_join(F.transform("_c", lambda c: c["t"]), "").alias("context"))


#: The requests to the models; wording is the caller's, this is the order of their parts: before the search, for a draft, for its review.
PREPARATION = "Name the legal issue as <query> and the place as <jurisdiction>.\n\n{payload}"
REQUEST = "{instruction}\n\nQuestion: {query}\n\nFacts:\n{facts}\n\nArticles:\n{context}\n\nPreferences:\n{preferences}"
REVIEW = "Question: {query}\n\nDraft:\n{judgment}\n\nArticles:\n{sources}"


def with_preferences(preferences: str, special: Column) -> Column:
    return F.when(F.coalesce(special, F.lit("")) != "", F.concat(F.lit(f"{P.SPECIAL_TITLE}\n"), special, F.lit("\n\n"), F.lit(preferences))).otherwise(F.lit(preferences))


def verdict_text(judgment: str, prep: str | None = None) -> Column:
    """The verdict as it is shown: rules and headings, the preparation only if there is one."""
    head = F.lit(f"{P.VERDICT_RULE}\n{P.VERDICT_TITLE}\n{P.VERDICT_RULE}\n")
    before = F.lit("") if prep is None else F.when(F.coalesce(F.col(prep), F.lit("")) != "", F.concat(F.lit(f"\n{P.PREP_TITLE}\n"), F.col(prep), F.lit("\n"))).otherwise("")
    said = F.when(F.col(judgment).isNotNull(), F.concat(F.lit(f"\n{P.JUDGMENT_TITLE}\n"), F.col(judgment), F.lit("\n"))).otherwise("")
    return F.concat(head, before, said, F.lit(P.VERDICT_RULE))


def verdict(checks: list[str]) -> Column:
    """Without a model: any FAIL is the highest risk, anything but PASS the middle one, else none."""
    status = F.array(*[F.col(f"{c}.status") for c in checks])
    return F.when(F.array_contains(status, P.FAIL), P.RISKS[0]).when(F.exists(status, lambda s: s != P.PASS), P.RISKS[1]).otherwise(P.RISKS[2])


def drafted(states: DataFrame, write: Writer, review: Writer, most: int = P.MOST_DRAFTS, request: str | None = None) -> DataFrame:
    """states with judgment, critic_feedback and resolve_count after at most `most` drafts.

    write adds `judgment`, review adds `reply`; a state is done once the reply says PASS. request: a template of the
    review's request, which review then sees as `review_request`. Each round takes the states that are
    still open and stores what it gives, so that the model is asked once for each draft and
    a reply can't change afterwards; states that are done are not written again.
    """
    start = states.withColumn("judgment", F.lit("")).withColumn("critic_feedback", F.lit(None).cast("string")).withColumn("resolve_count", F.lit(0))
    columns, open_, closed = start.columns, start, []
    for place in range(most):
        written = write(open_.drop("judgment"))
        if request is not None:
            # The draft is stored before two columns are made of it.
            written = kept(written)
            written = written.withColumn("review_request", rendered(request, **{c: F.col(c) for c in written.columns}))
        answered = review(written).withColumn("critic_feedback", feedback("reply")).withColumn("resolve_count", F.col("resolve_count") + 1)
        round_ = kept(answered.select(*columns))
        done = F.col("critic_feedback") == "PASS"
        closed.append(round_.filter(done) if place + 1 < most else round_)
        open_ = round_.filter(~done)
    return reduce(DataFrame.unionByName, closed, start.limit(0) if not closed else closed.pop(0))
