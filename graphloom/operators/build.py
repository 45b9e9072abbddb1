"""A graph built from pages: dispatch by address, people and units read from texts, link edges, and rewriting passes in order."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import pages as page
from graphloom.functions.text import squeeze
from graphloom.operators import graph, matching
from graphloom.operators.skew import spread_join
from graphloom.session import materialize

#: Kinds of pages that stand for an entity of the same type.
ENTITY_KINDS = ("department", "college", "program", "centre", "facility", "admission", "directorate", "campus")
#: Which relation leads from a page to a page that it links to, by their types.
LINKS = {
    ("college", "department"): "has_department", ("department", "program"): "offers_program", ("department", "centre"): "has_centre", ("college", "centre"): "has_centre", ("college", "program"): "offers_program",
    ("directorate", "centre"): "has_centre", ("campus", "facility"): "has_facility", ("campus", "college"): "has_college",
}
NAME = r"((?:Dr|Prof|Mr|Ms|Mrs)\.?(?:\s*Dr\.?)?\s+[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,3})"
#: A unit's name after "of": capitalised words joined by small ones, up to the next unit.
UNIT = r"[A-Z][A-Za-z&]*(?: (?!Department|School)(?:(?:and|&|of) (?!Department|School))?[A-Z][A-Za-z&]*)*"
#: How texts name who leads a unit; either order of name and role.
ROLE_WORDS = {"hod": r"(?:head\s+of\s+(?:the\s+)?department|hod|professor\s*(?:and|&)\s*head)", "dean": r"dean", "chairperson": r"chair\s*person", "director": r"director"}
FEE = r"(?i)(?:annual\s+fees?|fees?)\s*[:|-]?\s*((?:rs\.?|inr|₹)\s*[\d,.]+(?:\s*lakhs?)?(?:\s*(?:per annum|p\.a\.|per year))?)"
ELIGIBILITY = r"(?i)eligibility\s*[:|-]\s*([^\n|]{5,200})"


@dataclass
class Rules:
    """What a build is told besides the pages; everything may be empty."""

    blocked_slugs: Sequence[str] = ()
    merges: Sequence[tuple[str, str]] = ()
    dropped: Sequence[str] = ()
    parents: Sequence[tuple[str, str, str]] = ()
    inferred: dict[str, Sequence[tuple[str, str]]] = field(default_factory=dict)
    urls: Sequence[tuple[str, str]] = ()
    late_sources: Sequence[str] = ("directorate",)


def entity_id(kind: Column, name: Column) -> Column:
    """type--slug of a name or slug."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.concat(kind, F.lit("--"), F.regexp_replace(plain, " +", "-"))


def dispatch(pages: DataFrame, blocked: Sequence[str] = (), kinds: Sequence[str] = ENTITY_KINDS) -> DataFrame:
    """id, name, entity_type, campus, url, attributes, seq of the pages (url, title, seq) that stand for an entity.

    The kind comes from the address; of several pages of one id the first by seq counts. Noise pages, blocked slugs and
    pages below an entity's page give none.
    """
    kind, slug = page.kind(F.col("url")), page.slug(F.lower("url"))
    depth = F.size(page.path_parts(F.col("url")))
    own = kind.isin(*kinds) & (depth == 2) & (slug != "") & ~page.is_noise(F.col("url")) & ~slug.isin(*(blocked or [""]))
    name = F.coalesce(F.nullif(squeeze(F.regexp_replace("title", r"\s+[|–-]\s+.*$", "")), F.lit("")), page.readable(slug))
    rows = pages.filter(own).select(entity_id(kind, slug).alias("id"), name.alias("name"), kind.alias("entity_type"), F.lit(None).cast("string").alias("campus"), "url", F.create_map().cast("map<string,string>").alias("attributes"), "seq")
    return rows.groupBy("id").agg(F.min(F.struct("seq", "name", "entity_type", "campus", "url")).alias("r"), F.first("attributes").alias("attributes")).select("id", "r.name", "r.entity_type", "r.campus", "r.url", "attributes", "r.seq")


def leaders(text: Column, most: int = 3000) -> Column:
    """role -> person of the leaders that the first `most` characters name; roles without a person are left out."""
    head = F.substring(text, 1, most)
    entries = []
    for role, words in ROLE_WORDS.items():
        after = F.regexp_extract(head, rf"(?i:{words})\s*(?:is|:|-|,)?\s*{NAME}", 1)
        before = F.regexp_extract(head, rf"{NAME}\s*[,(-]?\s*(?:is\s+(?:the\s+)?)?(?i:{words})\b", 1)
        person = F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))
        entries.append(F.struct(F.lit(role).alias("key"), F.trim(person).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def facts(text: Column) -> Column:
    """fee and eligibility that a text or table names, as a map without absent entries."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(squeeze(F.regexp_extract(text, p, 1)), F.lit("")).alias("value")) for k, p in (("annual_fees", FEE), ("eligibility", ELIGIBILITY))])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def school_blocks(text: str) -> list[tuple[str, str, str]]:
    """(school, department, person) of a text that lists departments and heads below names of schools."""
    out = []
    parts = re.split(r"(?=\bSchool of [A-Z])", text or "")
    for part in parts:
        if not (m := re.match(rf"School of {UNIT}", part)):
            continue
        school = m[0].strip()
        for d in re.finditer(rf"Department of ({UNIT})(?:\s*[-–:,(]\s*(?:HoD|Head)?[:\s]*{NAME})?", part[m.end() :]):
            out.append((school, f"Department of {d[1].strip()}", (d[2] or "").strip()))
    return out


def schools(pages: DataFrame) -> DataFrame:
    """url, school, department, person of all pages (url, text) that list such."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *r) for u, t in zip(b["url"], b["text"]) for r in school_blocks(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["url", "school", "department", "person"])

    return pages.filter("text IS NOT NULL").select("url", "text").mapInPandas(read, "url string, school string, department string, person string")


def link_relations(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between the entities of pages that link to one another (pages: url, links, seq), by the types of both."""
    linked = graph.link_edges(pages.select("url", "links"), entities.select("id", "url"))
    plain = page.normalize_url
    source = entities.filter("url IS NOT NULL").groupBy(plain(F.col("url")).alias("plain")).agg(F.min("id").alias("source_id"), F.min("seq").alias("seq"))
    both = linked.withColumn("plain", plain(F.col("from_url"))).join(source, "plain").select("source_id", F.col("to_id").alias("target_id"), "seq").filter("source_id <> target_id")
    kind = lambda c: F.split(c, "--")[0]
    relation = F.lit(None).cast("string")
    for (a, b), name in LINKS.items():
        relation = F.when((kind(F.col("source_id")) == a) & (kind(F.col("target_id")) == b), name).otherwise(relation)
    return both.withColumn("relation_type", relation).filter("relation_type IS NOT NULL").select("source_id", "target_id", "relation_type", "seq").distinct()


def build_graph(pages: DataFrame, seeds: tuple[DataFrame, DataFrame] | None = None, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of pages (url, title, text, links, seq), in the order of passes that decides who wins.

    Seeds, dispatch, people, link edges, schools, merges and drops, parent overrides, inference for orphans, centres
    attached, addresses, single parent, validation, dedupe.
    """
    rules, spark = rules or Rules(), pages.sparkSession
    said = pages.select("url", F.map_concat(leaders(F.col("text")), facts(F.col("text"))).alias("attributes"))
    # Each pass reads what earlier ones made several times, so that is computed once.
    found = materialize(dispatch(pages, rules.blocked_slugs))
    told = found.drop("attributes").join(said.groupBy("url").agg(F.first("attributes").alias("attributes")), "url", "left")
    order = ["id", "name", "entity_type", "campus", "url", "attributes", "seq"]
    parts = [p.select(*order) for p in (*([seeds[0]] if seeds else []), found, told)]
    listed = materialize(schools(pages))
    school_rows = listed.select(entity_id(F.lit("school"), F.regexp_replace("school", "^School of ", "")).alias("id"), F.col("school").alias("name"), F.lit("school").alias("entity_type"))
    unit_rows = listed.select(entity_id(F.lit("department"), F.regexp_replace("department", "^Department of ", "")).alias("id"), F.col("department").alias("name"), F.lit("department").alias("entity_type"))
    bare = school_rows.unionByName(unit_rows).distinct().select("id", "name", "entity_type", F.lit(None).cast("string").alias("campus"), F.lit(None).cast("string").alias("url"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(2**40).alias("seq"))
    entities = materialize(graph.upsert(*parts, bare.select(*order)))
    edges = link_relations(pages, found)
    belongs = listed.select(entity_id(F.lit("school"), F.regexp_replace("school", "^School of ", "")).alias("source_id"), entity_id(F.lit("department"), F.regexp_replace("department", "^Department of ", "")).alias("target_id"), F.lit("has_department").alias("relation_type"), F.lit(2**40).alias("seq")).distinct()
    edges = edges.unionByName(belongs)
    if seeds:
        edges = seeds[1].select(*edges.columns).unionByName(edges)
    edges = materialize(edges)
    if rules.merges:
        entities, edges = graph.merge_entities(entities, edges, spark.createDataFrame(list(rules.merges), "old_id string, new_id string"))
    if rules.dropped:
        entities, edges = graph.drop_entities(entities, edges, spark.createDataFrame([(x,) for x in rules.dropped], "id string"))
    for relation in dict.fromkeys(r for _, _, r in rules.parents):
        mine = [(s, t) for s, t, r in rules.parents if r == relation]
        edges = graph.override_parents(edges, spark.createDataFrame(mine, "source_id string, target_id string"), entities, relation)
    for relation, patterns in rules.inferred.items():
        kind = {"offers_program": "program", "has_centre": "centre", "has_department": "department"}[relation]
        edges = edges.unionByName(graph.infer_parents(graph.orphans(entities, edges, kind, (relation, "also_listed_under")), patterns, relation))
    edges = materialize(edges)
    late = F.split("source_id", "--")[0].isin(*rules.late_sources)
    edges = edges.filter("relation_type <> 'has_centre'").unionByName(graph.attach(edges, never_first=late).select(*edges.columns))
    if rules.urls:
        entities = graph.backfill_urls(entities, spark.createDataFrame(list(rules.urls), "id string, url string"))
    edges = materialize(graph.drop_dangling(graph.single_parent(edges), entities))
    bad = graph.invalid_edges(edges, entities)
    return entities, graph.dedupe_edges(edges.join(bad, ["source_id", "target_id", "relation_type"], "left_anti"))


def best_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The row of each program (rows: program_id, campus, confidence, seq, ...) for the campus asked (wanted: program_id, campus).

    The campus' own row counts first, then the highest confidence, then the first by seq.
    """
    asked = wanted.select("program_id", F.col("campus").alias("asked")).distinct()
    w = Window.partitionBy("program_id", "asked").orderBy((F.col("campus") != F.col("asked")), F.desc("confidence"), "seq")
    return rows.join(asked, "program_id").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def add_programs(entities: DataFrame, official: DataFrame, least: float = 0.5) -> DataFrame:
    """entities with the official list (row_id, title, url, duration, fees, intake): matched programs are updated, others added.

    All rows are matched against the programs that were there before; rows of one title are one new program, so a later row
    finds what an earlier one would have added.
    """
    programs = entities.filter("entity_type = 'program' AND name IS NOT NULL").select(F.col("id").alias("name_id"), F.col("name").alias("text"))
    hit = matching.best_names(official.filter("title IS NOT NULL").select("row_id", F.col("title").alias("text")), programs, least)
    told = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("duration", "duration"), ("annual_fees", "fees"), ("intake", "intake"))]), lambda e: e["value"].isNotNull()))
    rows = official.filter("title IS NOT NULL").join(hit, "row_id", "left").select(
        F.coalesce("name_id", entity_id(F.lit("program"), F.col("title"))).alias("id"), F.col("title").alias("name"), F.lit("program").alias("entity_type"), F.lit(None).cast("string").alias("campus"), "url", told.alias("attributes"), F.col("row_id").cast("long").alias("seq")
    )
    return graph.upsert(entities.select("id", "name", "entity_type", "campus", "url", "attributes", F.col("seq").cast("long").alias("seq")), rows)


def apply_reconciliation(entities: DataFrame, edges: DataFrame, matched: DataFrame, official: DataFrame, home: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after a reconciliation: matched programs get the official name and address, stale ones of the home
    campus go, stale ones elsewhere lose their offers, missing ones are added.

    matched: lid, rid. official: lid, name, url.
    """
    new = spread_join(matched.select("lid", F.col("rid").alias("id")), official.select("lid", F.col("name").alias("new_name"), F.col("url").alias("new_url")), ["lid"], "id")
    programs = entities.filter("entity_type = 'program'")
    stale = programs.join(matched.select(F.col("rid").alias("id")), "id", "left_anti")
    gone = stale.filter(F.col("campus") == home).select("id")
    kept, rest = graph.drop_entities(entities, edges, gone)
    away = stale.filter(F.coalesce(F.col("campus") != home, F.lit(True))).select(F.col("id").alias("target_id"))
    rest = rest.filter("relation_type <> 'offers_program'").unionByName(rest.filter("relation_type = 'offers_program'").join(away, "target_id", "left_anti").select(*rest.columns))
    renamed = kept.join(new.drop("lid"), "id", "left").withColumns({"name": F.coalesce("new_name", "name"), "url": F.coalesce("new_url", "url")}).drop("new_name", "new_url")
    missing = official.filter("name IS NOT NULL").join(matched.select("lid"), "lid", "left_anti")
    added = missing.select(entity_id(F.lit("program"), F.col("name")).alias("id"), "name", F.lit("program").alias("entity_type"), F.lit(home).alias("campus"), "url", F.create_map().cast("map<string,string>").alias("attributes"), F.lit(2**41).alias("seq"))
    return graph.upsert(renamed.select(*added.columns), added), rest
