"""Scores of answers against labelled cases, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which detected intents count for an expected one, and phrases that make an answer no answer.
INTENTS = {
    "factual": ("factual", "general_query", "admission_query"), "general_query": ("factual", "general_query", "listing", "comparison"), "procedural": ("procedural", "how_to_apply"),
    "listing": ("listing",), "comparison": ("comparison",), "person_lookup": ("person_lookup",),
}
NO_ANSWER = ("i don't have", "i couldn't find", "no relevant information", "api error", "llm not running", "rag error", "technical issue")


def intent_score(expected: Column, detected: Column) -> Column:
    out = F.when(expected == "general_query", 1.0)
    for name, alike in INTENTS.items():
        out = out.when((expected == name) & detected.isin(*alike), 1.0)
    return out.when(expected == detected, 1.0).otherwise(0.0)


def share_contained(terms: Column, answer: Column) -> Column:
    """Share of the terms that the answer contains, case ignored, rounded half to even; 1 without terms."""
    hay = F.lower(F.coalesce(answer, F.lit("")))
    found = F.size(F.filter(terms, lambda t: F.contains(hay, F.lower(t))))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.bround(found / F.size(terms), 2))


def citation_score(answer: Column, sources: Column | None = None) -> Column:
    text = F.coalesce(answer, F.lit(""))
    cited = text.contains("[1]") | text.contains("[2]") | text.contains("Sources:") | text.contains("http")
    return (cited if sources is None else cited | (F.coalesce(F.size(sources), F.lit(0)) > 0)).cast("double")


def faithfulness_score(answer: Column) -> Column:
    hay, hit = F.lower(F.coalesce(answer, F.lit(""))), F.lit(False)
    for phrase in NO_ANSWER:
        hit = hit | hay.contains(phrase)
    return (~hit).cast("double")


def hallucination_score(forbidden: Column, answer: Column) -> Column:
    hay = F.lower(F.coalesce(answer, F.lit("")))
    return F.coalesce((~F.exists(forbidden, lambda t: F.contains(hay, F.lower(t)))).cast("double"), F.lit(1.0))


def quality_score(answer: Column) -> Column:
    text = F.coalesce(answer, F.lit(""))
    return F.round(F.lit(0.5) + F.when(F.length(text) > 100, 0.2).otherwise(0.0) + F.when(text.rlike(r"[-*]\s+\w"), 0.15).otherwise(0.0) + F.when(text.rlike(r"[0-9]+[.)\s]"), 0.15).otherwise(0.0), 2)


def score(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per result with its seven scores and whether it passes. results: result_id, id, detected_intent, answer."""
    joined = results.join(F.broadcast(cases.select("id", "expected_intent", "expected_keywords", "expected_items", "should_not_contain")), "id")
    a = F.col("answer")
    scored = joined.select(
        "result_id", "id", intent_score(F.col("expected_intent"), F.col("detected_intent")).alias("intent"), share_contained(F.col("expected_keywords"), a).alias("keyword_recall"),
        share_contained(F.col("expected_items"), a).alias("item_completeness"), (F.size("expected_items") > 0).alias("has_items"), citation_score(a).alias("citation"),
        faithfulness_score(a).alias("faithfulness"), hallucination_score(F.col("should_not_contain"), a).alias("hallucination_free"), quality_score(a).alias("quality"), "latency_seconds",
    )
    return scored.withColumn("passed", (F.col("intent") == 1) & (F.col("keyword_recall") >= 0.5) & (F.col("faithfulness") == 1))


def summary(scored: DataFrame) -> DataFrame:
    """One row: number of results and the mean scores in per cent; items only where a case has some; latency from 0."""
    pct = lambda c, name: F.bround(F.avg(c) * 100, 1).alias(name)
    return scored.agg(
        F.count("*").alias("results"), pct(F.col("intent"), "intent_accuracy"), pct(F.col("keyword_recall"), "keyword_recall"), pct(F.when(F.col("has_items"), F.col("item_completeness")), "item_completeness"),
        pct(F.col("citation"), "citation_rate"), pct(F.col("faithfulness"), "faithfulness_rate"), pct(F.col("hallucination_free"), "hallucination_free_rate"), pct(F.col("quality"), "answer_quality"),
        F.bround(F.avg(F.greatest(F.col("latency_seconds"), F.lit(0.0))), 2).alias("latency"), F.sum(F.col("passed").cast("long")).alias("passed"),
    )
