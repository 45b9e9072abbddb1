"""Per-route profiles from pages: sections, categorised links, rows of program tables, and the links to programs.

What a page says is taken as text; no rule of admission is applied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.pages import host, normalize_url
from graphloom.functions.text import excerpt, sections, squeeze

#: Sections of an admission page and their headings.
HEADINGS = (
    ("criteria", ("Admission Criteria",)), ("eligibility", ("Eligibility",)), ("how_to_apply", ("How to Apply",)), ("important_dates", ("Important Dates",)),
    ("exam_pattern_or_syllabus", ("Syllabus and Examination Pattern", "Syllabus", "Examination Pattern")), ("scholarship", ("Scholarship",)), ("refund_policy", ("Refund Policy",)), ("fees", ("Fee Structure", "Fees")), ("faq_summary", ("FAQs", "FAQ")),
)
#: What label or address of a link shows its category.
CATEGORIES = {"apply": r"apply|application|register", "exam": r"exam|entrance|syllabus|mock", "prospectus": r"prospectus|brochure|handbook"}


def categorize(links: Column, pattern: str, hosts: Sequence[str] = ()) -> Column:
    """The distinct links (label, url) whose label or address fits, official hosts first, then by label and address."""
    fits = F.filter(links, lambda x: F.lower(F.concat_ws(" ", x.label, x.url)).rlike(pattern))
    ordered = F.transform(fits, lambda x: F.struct((~host(x.url).isin(*hosts) if hosts else F.lit(True)).alias("other"), F.lower(x.label).alias("key"), x.url.alias("url"), x.label.alias("label")))
    return F.array_distinct(F.transform(F.array_sort(ordered), lambda x: F.struct(x.label.alias("label"), x.url.alias("url"))))


def first_link(links: Column, hosts: Sequence[str] = ()) -> Column:
    """The first link to an official host, else the first of all; empty without links."""
    official = F.filter(links, lambda x: host(x.url).isin(*hosts)) if hosts else F.filter(links, lambda x: F.lit(False))
    return F.coalesce(F.try_element_at(official, F.lit(1))["url"], F.try_element_at(links, F.lit(1))["url"], F.lit(""))


def enrich(pages: DataFrame, portal: DataFrame) -> DataFrame:
    """pages with the portal page's text (portal: url, text) of the same plain address, null if there is none."""
    other = portal.groupBy(normalize_url(F.col("url")).alias("__plain")).agg(F.max("text").alias("portal_text"))
    return pages.withColumn("__plain", normalize_url(F.col("url"))).join(other, "__plain", "left").drop("__plain")


def profiles(pages: DataFrame, hosts: Sequence[str] = ()) -> DataFrame:
    """url, name, sections (field -> body), apply_links, exam_links, prospectus_links, scraped_at of pages.

    pages: url, title, text, links, scraped_at.
    """
    found = sections(squeeze(F.regexp_replace("text", r"(?i)\bEdit Content\b", " ")), HEADINGS)
    linked = [categorize(F.col("links"), p, hosts).alias(f"{c}_links") for c, p in CATEGORIES.items()]
    return pages.select("url", F.col("title").alias("name"), F.map_from_entries(F.transform(found, lambda s: F.struct(s.field, excerpt(s.body, 1200)))).alias("sections"), *linked, "scraped_at")


def lineage(links: DataFrame) -> DataFrame:
    """id, ancestor, distance of every node (links: child, parent), by the trees' paths."""
    from graphloom.operators.hierarchy import nested_sets

    path = nested_sets(links).filter("path IS NOT NULL")
    each = path.select("id", "depth", F.posexplode("path").alias("level", "ancestor"))
    return each.filter("ancestor <> id").select("id", "ancestor", (F.col("depth") - F.col("level")).alias("distance"))


def governing(programs: DataFrame, edges: DataFrame, above: DataFrame) -> DataFrame:
    """program_id, admission_id, how: by a governs edge, else by a covers edge of the nearest ancestor (above: id, ancestor, distance)."""
    direct = edges.filter("relation_type = 'admission_governs'").select(F.col("target_id").alias("program_id"), F.col("source_id").alias("admission_id"))
    governed = programs.select("program_id").distinct().join(direct, "program_id").distinct().withColumn("how", F.lit("governs"))
    left = programs.select("program_id").distinct().join(governed, "program_id", "left_anti")
    covers = edges.filter("relation_type = 'admission_covers'").select(F.col("target_id").alias("ancestor"), F.col("source_id").alias("admission_id"))
    by_scope = left.join(above.withColumnRenamed("id", "program_id"), "program_id").join(covers, "ancestor")
    nearest = by_scope.groupBy("program_id").agg(F.min(F.struct("distance", "admission_id")).alias("b"))
    return governed.select("program_id", "admission_id", "how").unionByName(nearest.select("program_id", "b.admission_id", F.lit("covers").alias("how")))


def context_block(facts: DataFrame, key: str, most: int = 320) -> DataFrame:
    """KEY, block: the facts (KEY, ix, label, text) of each key as numbered lines; empty texts are left out."""
    line = F.concat("label", F.lit(": "), excerpt(F.col("text"), most))
    lines = facts.filter("text IS NOT NULL AND text <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ix", line.alias("line")))).alias("x"))
    return lines.select(key, F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x.line)), "\n").alias("block"))
