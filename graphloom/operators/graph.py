"""Entity-relationship graphs as two DataFrames: building, rewriting, navigation and inspection.

entities: id, name, entity_type, campus, url, attributes, seq. edges: source_id, target_id, relation_type, seq.
Where a loop over rows would let the first or last one win, seq decides here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import present, relation_name
from graphloom.operators.skew import spread_join

#: Which entity types and relation types a graph may have, and pairs that must not collaborate.
ENTITY_TYPES = ("university", "campus", "college", "school", "sub_college", "department", "centre", "directorate", "program", "facility", "admission", "publication", "misc")
RELATION_TYPES = (
    "has_campus", "has_college", "has_sub_college", "has_department", "has_centre", "has_directorate", "has_facility", "has_admission", "has_admission_child", "offers_program",
    "admission_covers", "admission_governs", "collaborates_with", "also_listed_under", "belongs_to",
)
NO_COLLABORATION = ("directorate", "college", "department")
#: Relations in the order in which a listing looks for children, and those that make no parent.
LISTING_ORDER = ("has_department", "has_sub_college", "has_centre")
NO_PARENT = ("offers_program", "has_admission", "admission_covers", "admission_governs", "collaborates_with", "also_listed_under", "belongs_to")


def entities_of(table: DataFrame, seq: str = "rec_id") -> DataFrame:
    """One row per id, the last by seq (an upsert); null and empty ids are dropped. Rows of one id meet in an aggregation."""
    fields = ["id", "name", "entity_type", "campus", "url", "attributes"]
    last = table.filter(present(F.col("id"))).groupBy(F.col("id").alias("key")).agg(F.max_by(F.struct(*fields, F.col(seq).alias("seq")), F.col(seq)).alias("e"))
    return last.select("e.*")


def edges_of(table: DataFrame, seq: str = "rel_id") -> DataFrame:
    """The edges with both ends, relation types in plain form, each once with its first seq."""
    both = table.filter(present(F.col("source_id")) & present(F.col("target_id")))
    return both.groupBy("source_id", "target_id", relation_name(F.col("relation_type")).alias("relation_type")).agg(F.min(seq).alias("seq"))


def upsert(*parts: DataFrame) -> DataFrame:
    """Rows of several parts as one entity per id: first name, last non-empty url, later attributes over earlier ones.

    A part's place in the arguments comes before its rows' seq.
    """
    every = None
    for n, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(n))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    order = F.struct("__part", "seq")
    pairs = every.select("id", order.alias("o"), F.explode_outer(F.map_entries("attributes")).alias("kv"))
    best = pairs.filter("kv IS NOT NULL").groupBy("id", F.col("kv.key").alias("k")).agg(F.max_by("kv.value", "o").alias("v"))
    attributes = best.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    url = F.when(present(F.col("url")), F.col("url"))
    one = every.groupBy("id").agg(F.min_by("name", order).alias("name"), F.min_by("entity_type", order).alias("entity_type"), F.min_by("campus", order).alias("campus"), F.max_by("url", F.when(url.isNotNull(), order)).alias("url"), F.min("seq").alias("seq"))
    return one.join(attributes, "id", "left")


def invalid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that must not be: unknown relation types, and collaborations with an excluded type, with the reason."""
    kinds = entities.select("id", "entity_type")
    s, t = kinds.toDF("source_id", "source_type"), kinds.toDF("target_id", "target_type")
    typed = spread_join(spread_join(edges, s, ["source_id"], "seq", "left"), t, ["target_id"], "seq", "left")
    excluded = (F.col("relation_type") == "collaborates_with") & (F.coalesce(F.col("source_type").isin(*NO_COLLABORATION), F.lit(False)) | F.coalesce(F.col("target_type").isin(*NO_COLLABORATION), F.lit(False)))
    reason = F.when(~F.col("relation_type").isin(*RELATION_TYPES), "relation_type").when(excluded, "collaboration")
    return typed.withColumn("reason", reason).filter("reason IS NOT NULL").select("source_id", "target_id", "relation_type", "reason")


def children(edges: DataFrame, entities: DataFrame, relations: Sequence[str] = ()) -> DataFrame:
    """parent_id, relation_type, id, name, entity_type, seq of each edge's target; all relations if none is named."""
    kept = edges.filter(F.col("relation_type").isin(*relations)) if relations else edges
    found = spread_join(kept, entities.select(F.col("id").alias("target_id"), "name", "entity_type"), ["target_id"], "seq")
    return found.select(F.col("source_id").alias("parent_id"), "relation_type", F.col("target_id").alias("id"), "name", "entity_type", "seq")


def parents(edges: DataFrame) -> DataFrame:
    """id, parent_id: the source of the last edge that makes a parent."""
    return edges.filter(~F.col("relation_type").isin(*NO_PARENT)).groupBy(F.col("target_id").alias("id")).agg(F.max_by("source_id", "seq").alias("parent_id"))


def listing(edges: DataFrame, entities: DataFrame, order: Sequence[str] = LISTING_ORDER) -> DataFrame:
    """The children of each parent by the first relation of order that it has any of, else by any relation."""
    rank = F.lit(len(order))
    for i, r in reversed(list(enumerate(order))):
        rank = F.when(F.col("relation_type") == r, F.lit(i)).otherwise(rank)
    kids = children(edges, entities).withColumn("rank", rank)
    best = kids.groupBy("parent_id").agg(F.min("rank").alias("rank"))
    return spread_join(kids, best, ["parent_id", "rank"], "seq").select("parent_id", "id", "name", "relation_type").distinct()


def shared_children(edges: DataFrame, relations: Sequence[str] = ("has_centre", "offers_program", "also_listed_under")) -> DataFrame:
    """id, parents, first, last of each target that several sources have; the pairs of its sources are not spelled out."""
    linked = edges.filter(F.col("relation_type").isin(*relations)).select("source_id", "target_id").distinct()
    return linked.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("parents"), F.min("source_id").alias("first"), F.max("source_id").alias("last")).filter("parents > 1")


def by_name(entities: DataFrame) -> DataFrame:
    """name (lower case), id: the last entity of each name."""
    return entities.filter("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.max_by("id", "seq").alias("id"))


def search(entities: DataFrame, words: Sequence[str], entity_type: str | None = None) -> DataFrame:
    """Entities whose name or attribute values contain all words, case ignored."""
    hay = F.lower(F.concat_ws(" ", "name", F.map_values("attributes")))
    hit = F.lit(True)
    for w in words:
        hit = hit & hay.contains(w.lower())
    found = entities.filter(hit)
    return found if entity_type is None else found.filter(F.col("entity_type") == entity_type)


def roles(entities: DataFrame, keys: Sequence[str] = ("hod", "dean", "chairperson", "head")) -> DataFrame:
    """id, name, role, person of the role attributes that entities have."""
    pairs = F.filter(F.map_entries("attributes"), lambda e: e.key.isin(*keys) & e.value.isNotNull())
    return entities.select("id", "name", F.explode(pairs).alias("e")).select("id", "name", F.col("e.key").alias("role"), F.col("e.value").alias("person"))


def single_parent(edges: DataFrame, classes: Sequence[Sequence[str]] = (("has_department", "has_sub_college"), ("offers_program",))) -> DataFrame:
    """edges with only the first edge of each target and class of relations; other edges stay."""
    group = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        group = F.when(F.col("relation_type").isin(*c), F.lit(i)).otherwise(group)
    marked = edges.withColumn("__class", group)
    row = F.struct("seq", *[c for c in edges.columns if c != "seq"])
    first = marked.filter("__class IS NOT NULL").groupBy("target_id", "__class").agg(F.min(row).alias("r"))
    return marked.filter("__class IS NULL").select(*edges.columns).unionByName(first.select("r.*").select(*edges.columns))


def dedupe_edges(edges: DataFrame, confidence: str | None = None) -> DataFrame:
    """One edge per (source, target, relation) with the first seq; with a confidence column, the largest confidence."""
    aggs = [F.min("seq").alias("seq")] + ([F.max(confidence).alias(confidence)] if confidence else [])
    return edges.groupBy("source_id", "target_id", "relation_type").agg(*aggs)


def override_parents(edges: DataFrame, overrides: DataFrame, entities: DataFrame, relation: str) -> DataFrame:
    """edges where the targets of overrides (target_id, source_id) have just the given source by this relation.

    Overrides with an unknown end leave their target without such an edge. The new edges come last by seq.
    """
    kept = edges.filter(F.col("relation_type") != relation).unionByName(edges.filter(F.col("relation_type") == relation).join(overrides.select("target_id").distinct(), "target_id", "left_anti").select(*edges.columns))
    known = entities.select("id")
    new = overrides.join(known.toDF("source_id"), "source_id", "left_semi").join(known.toDF("target_id"), "target_id", "left_semi")
    return kept.unionByName(new.select("source_id", "target_id", F.lit(relation).alias("relation_type"), F.lit(2**62).alias("seq")))


def merge_entities(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after each old id of merges (old_id, new_id) became its new one.

    Attributes are united, the old entity's values win; its address is kept as alternate_url; edges that became loops or
    repeats are dropped.
    """
    to = merges.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("new_id"))
    moved = entities.join(to, "id", "left")
    old = moved.filter("new_id IS NOT NULL").select(F.col("new_id").alias("id"), "name", "entity_type", "campus", F.lit(None).cast("string").alias("url"), F.map_concat(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.when(present(F.col("url")), F.create_map(F.lit("alternate_url"), F.col("url"))).otherwise(F.create_map().cast("map<string,string>"))).alias("attributes"), "seq")
    stays = moved.filter("new_id IS NULL").drop("new_id")
    renamed = edges
    for end in ("source_id", "target_id"):
        renamed = spread_join(renamed, to.select(F.col("id").alias(end), "new_id"), [end], "seq", "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
    return upsert(stays, old), dedupe_edges(renamed.filter("source_id <> target_id"))


def drop_entities(entities: DataFrame, edges: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) without the ids of dropped (id) and without the edges at them."""
    ids = dropped.select("id").distinct()
    kept = edges
    for end in ("source_id", "target_id"):
        kept = spread_join(kept, ids.select(F.col("id").alias(end)), [end], "seq", "left_anti")
    return entities.join(ids, "id", "left_anti"), kept


def drop_dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges whose ends are both known."""
    for end in ("source_id", "target_id"):
        edges = spread_join(edges, entities.select(F.col("id").alias(end)), [end], "seq", "left_semi")
    return edges


def orphans(entities: DataFrame, edges: DataFrame, entity_type: str, relations: Sequence[str]) -> DataFrame:
    """Entities of a type that no edge of the relations leads to."""
    linked = edges.filter(F.col("relation_type").isin(*relations)).select(F.col("target_id").alias("id")).distinct()
    return entities.filter(F.col("entity_type") == entity_type).join(linked, "id", "left_anti")


def infer_parents(lonely: DataFrame, rules: Sequence[tuple[str, str]], relation: str) -> DataFrame:
    """Edges from the parent of the first rule (pattern, parent id) that an orphan's name matches; others stay alone."""
    parent = F.lit(None).cast("string")
    for pattern, source in reversed(rules):
        parent = F.when(F.lower("name").rlike(pattern), F.lit(source)).otherwise(parent)
    found = lonely.withColumn("source_id", parent).filter("source_id IS NOT NULL")
    return found.select("source_id", F.col("id").alias("target_id"), F.lit(relation).alias("relation_type"), F.col("seq").cast("long").alias("seq"))


def attach(edges: DataFrame, primary: str = "has_centre", secondary: str = "also_listed_under", never_first: Column | None = None) -> DataFrame:
    """Each target's first candidate edge of the primary relation stays primary, its others become secondary ones.

    never_first: sources that only become primary where a target has no other source.
    """
    mine = edges.filter(F.col("relation_type") == primary)
    late = F.coalesce(never_first.cast("int"), F.lit(0)) if never_first is not None else F.lit(0)
    first = mine.groupBy("target_id").agg(F.min(F.struct(late.alias("late"), "seq", "source_id")).alias("f")).select("target_id", F.col("f.source_id").alias("owner"))
    marked = spread_join(mine, first, ["target_id"], "seq")
    return marked.select("source_id", "target_id", F.when(F.col("source_id") == F.col("owner"), primary).otherwise(secondary).alias("relation_type"), "seq").distinct()


def backfill_urls(entities: DataFrame, urls: DataFrame) -> DataFrame:
    """entities with the url that urls (id, url) gives, where it gives one."""
    given = urls.groupBy("id").agg(F.max("url").alias("given"))
    return entities.join(given, "id", "left").withColumn("url", F.coalesce("given", "url")).drop("given")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """what, kind, n: totals and counts by type of entities and relations."""
    e = entities.rollup(F.col("entity_type").alias("kind")).count().select(F.lit("entity").alias("what"), F.coalesce("kind", F.lit("(all)")).alias("kind"), F.col("count").alias("n"))
    r = edges.rollup(F.col("relation_type").alias("kind")).count().select(F.lit("relation").alias("what"), F.coalesce("kind", F.lit("(all)")).alias("kind"), F.col("count").alias("n"))
    return e.unionByName(r)


def duplicate_names(entities: DataFrame) -> DataFrame:
    """name, n, first_id of names (lower case) that several entities have."""
    return entities.filter("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def several_parents(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """id, n of targets with several sources by the relations."""
    return edges.filter(F.col("relation_type").isin(*relations)).groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("n")).filter("n > 1")


def suspicious_ids(entities: DataFrame) -> DataFrame:
    """Entities whose id does not begin with their type, or has characters beyond a slug's."""
    odd = ~F.col("id").startswith(F.concat("entity_type", F.lit("--"))) | ~F.col("id").rlike("^[a-z_]+--[a-z0-9-]+$")
    return entities.filter(F.coalesce(odd, F.lit(True))).select("id", "entity_type")


def link_edges(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """from_url, to_id: pages linked by documents (url, links) to the entities (id, url) whose plain address they have."""
    links = documents.select(F.col("url").alias("from_url"), F.explode("links").alias("to_url")).distinct()
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", ""))
    known = pages.filter("url IS NOT NULL").groupBy(plain(F.col("url")).alias("plain")).agg(F.min("id").alias("to_id"))
    return links.withColumn("plain", plain(F.col("to_url"))).join(known, "plain").select("from_url", "to_id").distinct()


def neighbours_by_type(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """parent_id, entity_type, n, names: children grouped by type, with the first three names of each group."""
    kids = children(edges, entities)
    w = Window.partitionBy("parent_id", "entity_type").orderBy("name", "id")
    ranked = kids.select("parent_id", "entity_type", "id", "name").distinct().withColumn("k", F.row_number().over(w))
    return ranked.groupBy("parent_id", "entity_type").agg(F.count("*").alias("n"), F.concat_ws(" | ", F.max(F.when(F.col("k") == 1, F.col("name"))), F.max(F.when(F.col("k") == 2, F.col("name"))), F.max(F.when(F.col("k") == 3, F.col("name")))).alias("names"))
