"""From questions and papers to a verdict: search, checks, drafts and their review, as one job over all states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogs import policy as P
from ..functions.tables import kept
from ..operators import agent, clean, retrieve, validate

CHECKS = ("arithmetic", "insurance", "amounts", "dates")


def by_rules(states: DataFrame) -> DataFrame:
    """A judgment from the checks alone, for where no model is plugged in."""
    return states.withColumn("judgment", agent.verdict(list(CHECKS)))


def accepted(states: DataFrame) -> DataFrame:
    """A review that passes every draft, for where no model is plugged in."""
    return states.withColumn("reply", F.lit("PASS"))


def run(questions: DataFrame, law: dict[str, DataFrame], write: agent.Writer = by_rules, review: agent.Writer = accepted, preferences: str = "", embed: agent.Writer | None = None) -> DataFrame:
    """questions with instruction, context, sources, facts, the checks, readable, request, judgment, critic_feedback, resolve_count and verdict.

    questions: query_id, query, embedding, jurisdiction, category, payload, special. payload is the papers' JSON; without one
    (null, empty) facts say that there is no data, and if it is no JSON that nothing could be checked: then all checks are UNKNOWN.
    special: an instruction for this question alone or null. embed: gives `embedding` of `refined`, the query as the
    search is asked it, where questions have none; it is asked once a row. law: the tables of `retrieve.hybrid_search` but queries. A question
    without an article has an empty context. write and review see all of these columns, review also `review_request`.
    """
    if embed is not None:
        questions = embed(questions.withColumn("refined", retrieve.rewritten(F.coalesce("query", F.lit(""))))).drop("refined")
    # Stored before it is used twice: a model that answers differently each time must not give one row two questions.
    questions = kept(questions)
    found = kept(retrieve.hybrid_search(questions.select("query_id", "embedding", "jurisdiction", "category"), **law))
    checked = validate.check_payload(questions.drop("embedding"), "query_id", "payload")
    facts = F.when(F.coalesce("payload", F.lit("")) == "", P.NO_FACTS).when(~F.col("readable"), P.NOT_CHECKED).otherwise(F.col("report"))
    states = checked.withColumn("facts", facts).drop("report")
    sources = agent.context(found, with_content=False).withColumnRenamed("context", "sources")
    states = states.join(agent.context(found), "query_id", "left").join(sources, "query_id", "left")
    states = states.withColumns({c: F.coalesce(c, F.lit("")) for c in ("context", "sources")})
    states = states.withColumn("instruction", agent.instruction("payload", "readable"))
    request = agent.rendered(agent.REQUEST, instruction=F.col("instruction"), query=F.col("query"), facts=F.col("facts"), context=F.col("context"), preferences=agent.with_preferences(preferences, F.col("special")))
    judged = agent.drafted(states.withColumn("request", request), write, review, request=agent.REVIEW)
    return judged.withColumn("verdict", agent.verdict_text("judgment"))


def analyze_documents(papers: DataFrame, prepare: agent.Writer, embed: agent.Writer, law: dict[str, DataFrame], **options) -> DataFrame:
    """As `run` for papers (query_id, payload, special): prepare is given `prep_request` and adds `prep`, whose tags name the query and jurisdiction; embed as in `run`. Each is asked once a row."""
    asked = papers.withColumn("payload", clean.stripped(F.col("payload")))
    asked = kept(prepare(asked.withColumn("prep_request", agent.rendered(agent.PREPARATION, payload=F.col("payload")))))
    asked = asked.withColumn("query", agent.tag("query", "prep")).withColumn("jurisdiction", F.nullif(agent.tag("jurisdiction", "prep"), F.lit(""))).withColumn("category", F.lit(None).cast("string"))
    return run(asked, law, embed=embed, **options).withColumn("verdict", agent.verdict_text("judgment", "prep"))
