"""Queries over the entity-relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import pages as page_rules
from graphloom.operators import build, graph, hierarchy
from graphloom.plans.pipeline_queries import _LINKS
from graphloom.sources.tables import table


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return graph.entities_of(table(spark, folder, "entity")), graph.edges_of(table(spark, folder, "relationship"))


def kg_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[0].select("id", "name", "entity_type", "campus", "url", "seq")


def kg_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[1]


def kg_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph.stats(*_graph(spark, folder))


def kg_stats_cube(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entity")
    return e.cube("entity_type", "feed").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    return graph.duplicate_names(_graph(spark, folder)[0])


def multi_parent(spark: SparkSession, folder: str) -> DataFrame:
    return graph.several_parents(_graph(spark, folder)[1], ("admission_governs", "also_listed_under", "admission_covers"))


def suspicious_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Of all ids that edges name, each with the type that its entity has or, without one, none."""
    e, r = _graph(spark, folder)
    named = r.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.suspicious_ids(named.join(e.select("id", "entity_type"), "id", "left"))


def edge_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Of the edges as they were written, whose types are not always known ones."""
    e, _ = _graph(spark, folder)
    written = table(spark, folder, "relationship").filter("source_id <> '' AND target_id <> ''").select("source_id", "target_id", "relation_type", F.col("rel_id").alias("seq"))
    return graph.invalid_edges(written, e).distinct()


def kg_children(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    return graph.children(r, e, ("has_department", "has_centre")).select("parent_id", "relation_type", "id", "name")


def kg_parent(spark: SparkSession, folder: str) -> DataFrame:
    return graph.parents(_graph(spark, folder)[1])


def kg_listing(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    return graph.listing(r, e)


def kg_roles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.roles(_graph(spark, folder)[0])


def kg_search(spark: SparkSession, folder: str) -> DataFrame:
    return graph.search(_graph(spark, folder)[0], ("60", "years", "tech"), "program").select("id", "name")


def kg_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return graph.by_name(_graph(spark, folder)[0])


def shared_children(spark: SparkSession, folder: str) -> DataFrame:
    return graph.shared_children(_graph(spark, folder)[1])


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    return graph.orphans(e, r, "program", ("admission_governs", "admission_covers")).select("id", "name")


#: Kinds of relations of which a node keeps one edge.
_PARENT_CLASSES = (("has_department", "has_sub_college", "has_centre"), ("offers_program",), ("admission_governs",))


def single_parent(spark: SparkSession, folder: str) -> DataFrame:
    return graph.single_parent(_graph(spark, folder)[1], _PARENT_CLASSES)


def dedup_edges(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "relationship").filter("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id", "relation_type", F.col("rel_id").alias("seq"), (F.col("rel_id") % 7).alias("confidence"))
    return graph.dedupe_edges(raw, "confidence")


def override_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The centres of departments move to the first university by id."""
    e, r = _graph(spark, folder)
    top = e.filter("entity_type = 'university'").agg(F.min("id").alias("source_id"))
    moved = r.filter("relation_type = 'has_centre' AND source_id LIKE 'department--%'").select("target_id").distinct().crossJoin(F.broadcast(top))  # one row
    return graph.override_parents(r, moved, e, "has_centre")


def merge_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Directorates of one name become the first of them."""
    e, r = _graph(spark, folder)
    names = e.filter("entity_type = 'directorate'").groupBy("name").agg(F.min("id").alias("new_id"))
    merges = e.filter("entity_type = 'directorate'").join(names, "name").filter("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    return graph.merge_entities(e, r, merges)[1]


def merge_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """The entities after the merge of merge_entities: name, how many attributes, and the address of the last one merged in."""
    e, r = _graph(spark, folder)
    names = e.filter("entity_type = 'directorate'").groupBy("name").agg(F.min("id").alias("new_id"))
    merges = e.filter("entity_type = 'directorate'").join(names, "name").filter("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    merged = graph.merge_entities(e, r, merges)[0]
    return merged.select("id", "name", "url", F.coalesce(F.size("attributes"), F.lit(0)).alias("attributes"), F.col("attributes")["alternate_url"].alias("alternate_url"))


def drop_entities(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    kept, edges = graph.drop_entities(e, r, e.filter("entity_type = 'facility'"))
    return edges.select("source_id", "target_id", "relation_type").unionByName(kept.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.col("entity_type").alias("relation_type")))


def drop_dangling(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    return graph.drop_dangling(r, e)


def infer_parents(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    rules = (("chemi", "topic--chemistry"), ("engineer|tech", "topic--engineering"), ("design|art", "topic--arts"))
    return graph.infer_parents(graph.orphans(e, r, "program", ("admission_governs",)), rules, "has_topic")


def attach_centres(spark: SparkSession, folder: str) -> DataFrame:
    r = _graph(spark, folder)[1].filter("relation_type IN ('has_centre', 'also_listed_under')").withColumn("relation_type", F.lit("has_centre"))
    return graph.attach(r, never_first=F.col("source_id").startswith("directorate--"))


def backfill_urls(spark: SparkSession, folder: str) -> DataFrame:
    e, _ = _graph(spark, folder)
    good = table(spark, folder, "entity").filter("url LIKE 'http%/'").select("id", "url")
    return graph.backfill_urls(e, good).select("id", "url")


def upsert_entities(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the table as one entity per id: first name, last usable-looking address, later attributes win."""
    rows = table(spark, folder, "entity").filter("id IS NOT NULL AND id <> ''").withColumn("seq", F.col("rec_id"))
    return graph.upsert(rows.select("id", "name", "entity_type", "campus", "url", "attributes", "seq")).select("id", "name", "url", "seq")


def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every address that a row of the entity table gives, as a link of that row, to the entities of that plain address."""
    given = table(spark, folder, "entity").select(F.concat(F.lit("row:"), "rec_id").alias("url"), F.array("url").alias("links"))
    return graph.link_edges(given, _graph(spark, folder)[0].select("id", "url"))


def neighbours_by_type(spark: SparkSession, folder: str) -> DataFrame:
    e, r = _graph(spark, folder)
    return graph.neighbours_by_type(r.filter("relation_type LIKE 'has_%'"), e.withColumn("name", F.coalesce("name", F.lit("")))).select("parent_id", "entity_type", "n")


def kg_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Every program with each of its ancestors, from the paths of the trees."""
    tree = hierarchy.nested_sets(hierarchy.hierarchy_links(table(spark, folder, "relationship")))
    each = tree.filter(F.col("id").startswith("program--")).select("id", F.posexplode("path").alias("level", "ancestor"))
    return each.filter("ancestor <> id").select("id", "ancestor", "level")


def page_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by the addresses of the entity table's pages."""
    pages = table(spark, folder, "entity").filter("url IS NOT NULL").select("url", F.col("name").alias("title"), F.col("rec_id").alias("seq"))
    return build.dispatch(pages).select("id", "entity_type", "url", "seq")


def kg_build(spark: SparkSession, folder: str) -> DataFrame:
    """A graph built anew from the entities' pages, with the addresses of the hierarchy's children as links."""
    e, r = _graph(spark, folder)
    kids = graph.children(r.filter("relation_type LIKE 'has_%' OR relation_type = 'offers_program'"), e).select("parent_id", "id").join(e.select("id", "url"), "id")
    links = kids.groupBy(F.col("parent_id").alias("id")).agg(F.collect_set("url").alias("links"))
    own = e.filter("url LIKE 'http%'").join(links, "id", "left").select("url", F.col("name").alias("title"), F.lit("").alias("text"), "links", "seq")
    texts = table(spark, folder, "documents").select("url", "title", F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("links"), (F.col("doc_id") + 2**40).alias("seq"))
    pages = own.unionByName(texts.filter("url IS NOT NULL"))
    return build.build_graph(pages)[1].select("source_id", "relation_type", "target_id")


def add_programs(spark: SparkSession, folder: str) -> DataFrame:
    """The official list brought into the graph: matched programs updated, others added."""
    listing = table(spark, folder, "program_listing").select(F.col("listing_id").alias("row_id"), "title", "url", "duration", F.col("annual_fees").alias("fees"), "intake")
    return build.add_programs(_graph(spark, folder)[0], listing).filter("entity_type = 'program'").select("id", "name", F.to_json("attributes").alias("attributes"))


QUERIES = {
    f.__name__: f
    for f in (
        kg_entities, kg_edges, kg_stats, kg_stats_cube, duplicate_names, multi_parent, suspicious_ids, edge_validation, kg_children, kg_parent, kg_listing, kg_roles, kg_search, kg_by_name, shared_children,
        orphans, single_parent, dedup_edges, override_parents, merge_entities, merge_attributes, drop_entities, drop_dangling, infer_parents, attach_centres, backfill_urls, upsert_entities, link_edges, neighbours_by_type, kg_lineage, page_dispatch, kg_build, add_programs,
    )
}

_G = """WITH e AS (SELECT * EXCLUDE (n) FROM (SELECT id, name, entity_type, campus, url, attributes, rec_id AS seq, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS n FROM entity WHERE id <> '') WHERE n = 1),
r AS (SELECT source_id, target_id, regexp_replace(lower(regexp_replace(relation_type, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g') AS relation_type, min(rel_id) AS seq FROM relationship WHERE source_id <> '' AND target_id <> '' GROUP BY ALL)"""
_NP = ", ".join(f"'{x}'" for x in graph.NO_PARENT)
_DIR = "dirs AS (SELECT name, min(id) AS new_id FROM e WHERE entity_type = 'directorate' GROUP BY name), merges AS (SELECT id AS old_id, new_id FROM e JOIN dirs USING (name) WHERE entity_type = 'directorate' AND id <> new_id)"
_RULES = "CASE WHEN regexp_matches(lower(name), 'chemi') THEN 'topic--chemistry' WHEN regexp_matches(lower(name), 'engineer|tech') THEN 'topic--engineering' WHEN regexp_matches(lower(name), 'design|art') THEN 'topic--arts' END"

_PARTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^\\w+://[^/]*', ''), '/'), lambda p: p <> '')"
_KIND = "CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{k}'" for p, k in page_rules.KINDS) + " ELSE 'general' END"

ORACLES = {
    "page_dispatch": f"""WITH d AS (SELECT *, {_KIND} AS k, {_PARTS} AS parts FROM entity WHERE url IS NOT NULL),
      x AS (SELECT k || '--' || regexp_replace(trim(regexp_replace(lower(parts[-1]), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') AS id, k AS entity_type, url, rec_id AS seq FROM d
        WHERE k IN ({", ".join(f"'{t}'" for t in build.ENTITY_KINDS)}) AND len(parts) = 2 AND NOT regexp_matches(url, '{"|".join(page_rules.NOISE)}', 'i'))
      SELECT id, entity_type, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM x) WHERE n = 1""",
    "kg_entities": f"{_G} SELECT id, name, entity_type, campus, url, seq FROM e",
    "kg_edges": f"{_G} SELECT * FROM r",
    "kg_stats": f"{_G} SELECT 'entity' AS what, coalesce(entity_type, '(all)') AS kind, count(*) AS n FROM e GROUP BY ROLLUP (entity_type) UNION ALL SELECT 'relation', coalesce(relation_type, '(all)'), count(*) FROM r GROUP BY ROLLUP (relation_type)",
    "kg_stats_cube": "SELECT entity_type, feed, count(*) AS n, count(DISTINCT id) AS ids FROM entity GROUP BY CUBE (entity_type, feed)",
    "duplicate_names": f"{_G} SELECT lower(name) AS name, count(*) AS n, min(id) AS first_id FROM e WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "multi_parent": f"{_G} SELECT target_id AS id, count(DISTINCT source_id) AS n FROM r WHERE relation_type IN ('admission_governs', 'also_listed_under', 'admission_covers') GROUP BY 1 HAVING count(DISTINCT source_id) > 1",
    "suspicious_ids": f"{_G} SELECT id, entity_type FROM (SELECT source_id AS id FROM r UNION SELECT target_id FROM r) LEFT JOIN e USING (id) WHERE coalesce(NOT starts_with(id, entity_type || '--') OR NOT regexp_matches(id, '^[a-z_]+--[a-z0-9-]+$'), true)",
    "edge_validation": f"""{_G} SELECT DISTINCT source_id, target_id, relation_type, CASE WHEN relation_type NOT IN ({", ".join(f"'{x}'" for x in graph.RELATION_TYPES)}) THEN 'relation_type' ELSE 'collaboration' END AS reason
      FROM relationship LEFT JOIN e s ON s.id = source_id LEFT JOIN e t ON t.id = target_id WHERE source_id <> '' AND target_id <> ''
      AND (relation_type NOT IN ({", ".join(f"'{x}'" for x in graph.RELATION_TYPES)}) OR relation_type = 'collaborates_with' AND (coalesce(s.entity_type IN ('directorate', 'college', 'department'), false) OR coalesce(t.entity_type IN ('directorate', 'college', 'department'), false)))""",
    "kg_children": f"{_G} SELECT source_id AS parent_id, relation_type, target_id AS id, name FROM r JOIN e ON e.id = target_id WHERE relation_type IN ('has_department', 'has_centre')",
    "kg_parent": f"{_G} SELECT target_id AS id, arg_max(source_id, seq) AS parent_id FROM r WHERE relation_type NOT IN ({_NP}) GROUP BY 1",
    "kg_listing": f"""{_G}, k AS (SELECT source_id AS parent_id, target_id AS id, name, relation_type, CASE relation_type WHEN 'has_department' THEN 0 WHEN 'has_sub_college' THEN 1 WHEN 'has_centre' THEN 2 ELSE 3 END AS p FROM r JOIN e ON e.id = target_id)
      SELECT DISTINCT parent_id, id, name, relation_type FROM k WHERE p = (SELECT min(p) FROM k x WHERE x.parent_id = k.parent_id)""",
    "kg_roles": f"{_G} SELECT id, name, x.key AS role, x.value AS person FROM (SELECT id, name, unnest(map_entries(attributes)) AS x FROM e) WHERE x.key IN ('hod', 'dean', 'chairperson', 'head') AND x.value IS NOT NULL",
    "kg_search": f"{_G}, h AS (SELECT *, lower(concat_ws(' ', name, array_to_string(map_values(attributes), ' '))) AS hay FROM e) SELECT id, name FROM h WHERE contains(hay, '60') AND contains(hay, 'years') AND contains(hay, 'tech') AND entity_type = 'program'",
    "kg_by_name": f"{_G} SELECT lower(name) AS name, arg_max(id, seq) AS id FROM e WHERE name IS NOT NULL GROUP BY 1",
    "shared_children": f"{_G} SELECT target_id AS id, count(DISTINCT source_id) AS parents, min(source_id) AS first, max(source_id) AS last FROM r WHERE relation_type IN ('has_centre', 'offers_program', 'also_listed_under') GROUP BY 1 HAVING count(DISTINCT source_id) > 1",
    "orphans": f"{_G} SELECT id, name FROM e WHERE entity_type = 'program' AND id NOT IN (SELECT target_id FROM r WHERE relation_type IN ('admission_governs', 'admission_covers'))",
    "single_parent": f"""{_G}, c AS (SELECT *, CASE WHEN relation_type IN ('has_department', 'has_sub_college', 'has_centre') THEN 0 WHEN relation_type = 'offers_program' THEN 1 WHEN relation_type = 'admission_governs' THEN 2 END AS c FROM r)
      SELECT source_id, target_id, relation_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY target_id, c ORDER BY seq) AS n FROM c) WHERE c IS NULL OR n = 1""",
    "dedup_edges": "SELECT source_id, target_id, relation_type, min(rel_id) AS seq, max(rel_id % 7) AS confidence FROM relationship WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL",
    "override_parents": f"""{_G}, moved AS (SELECT DISTINCT target_id FROM r WHERE relation_type = 'has_centre' AND source_id LIKE 'department--%')
      SELECT * FROM r WHERE relation_type <> 'has_centre' OR target_id NOT IN (FROM moved)
      UNION ALL SELECT (SELECT min(id) FROM e WHERE entity_type = 'university'), target_id, 'has_centre', 4611686018427387904 FROM moved WHERE target_id IN (SELECT id FROM e)""",
    "merge_entities": f"""{_G}, {_DIR}, moved AS (SELECT coalesce(a.new_id, source_id) AS source_id, coalesce(b.new_id, target_id) AS target_id, relation_type, seq FROM r LEFT JOIN merges a ON a.old_id = source_id LEFT JOIN merges b ON b.old_id = target_id)
      SELECT source_id, target_id, relation_type, min(seq) AS seq FROM moved WHERE source_id <> target_id GROUP BY ALL""",
    "drop_entities": f"{_G}, f AS (SELECT id FROM e WHERE entity_type = 'facility') SELECT source_id, target_id, relation_type FROM r WHERE source_id NOT IN (FROM f) AND target_id NOT IN (FROM f) UNION ALL SELECT id, NULL, entity_type FROM e WHERE id NOT IN (FROM f)",
    "merge_attributes": f"""{_G}, {_DIR}, x AS (SELECT coalesce(new_id, id) AS id, id AS own, new_id IS NOT NULL AS gone, seq, name, url, attributes FROM e LEFT JOIN merges ON old_id = id),
      k AS (SELECT id, count(DISTINCT key) AS n FROM (SELECT id, unnest(map_keys(attributes)) AS key FROM x) GROUP BY id)
      SELECT x.id, arg_min(x.name, gone) FILTER (NOT gone) AS name, max(url) FILTER (NOT gone AND url <> '') AS url, coalesce(any_value(k.n), 0) + (count(*) FILTER (gone AND url <> '') > 0)::INT AS attributes, arg_max(url, seq) FILTER (gone AND url <> '') AS alternate_url
      FROM x LEFT JOIN k USING (id) GROUP BY x.id""",
    "drop_dangling": f"{_G} SELECT * FROM r WHERE source_id IN (SELECT id FROM e) AND target_id IN (SELECT id FROM e)",
    "infer_parents": f"""{_G} SELECT * FROM (SELECT {_RULES} AS source_id, id AS target_id, 'has_topic' AS relation_type, seq FROM e WHERE entity_type = 'program' AND id NOT IN (SELECT target_id FROM r WHERE relation_type = 'admission_governs')) WHERE source_id IS NOT NULL""",
    "attach_centres": f"""{_G}, c AS (SELECT source_id, target_id, seq, CASE WHEN starts_with(source_id, 'directorate--') THEN 1 ELSE 0 END AS late FROM r WHERE relation_type IN ('has_centre', 'also_listed_under')),
      f AS (SELECT target_id, source_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY late, seq, source_id) AS n FROM c) WHERE n = 1)
      SELECT DISTINCT source_id, target_id, CASE WHEN source_id = owner THEN 'has_centre' ELSE 'also_listed_under' END AS relation_type, seq FROM c JOIN f USING (target_id)""",
    "backfill_urls": f"{_G}, g AS (SELECT id, max(url) AS given FROM entity WHERE url LIKE 'http%/' GROUP BY id) SELECT id, coalesce(given, url) AS url FROM e LEFT JOIN g USING (id)",
    "upsert_entities": "SELECT id, arg_min_null(name, rec_id) AS name, arg_max(url, rec_id) FILTER (url <> '') AS url, min(rec_id) AS seq FROM entity WHERE id <> '' GROUP BY id",
    "link_edges": f"""{_G}, k AS (SELECT lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS plain, min(id) AS to_id FROM e WHERE url IS NOT NULL GROUP BY 1)
      SELECT DISTINCT 'row:' || rec_id AS from_url, to_id FROM entity JOIN k ON plain = lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''))""",
    "kg_lineage": f"WITH RECURSIVE {_LINKS}, a AS (SELECT id, string_split(path, ' > ') AS p FROM tree WHERE starts_with(id, 'program--')) SELECT id, ancestor, level - 1 AS level FROM (SELECT id, unnest(p) AS ancestor, generate_subscripts(p, 1)::INT AS level FROM a) WHERE ancestor <> id",
    "neighbours_by_type": f"{_G} SELECT source_id AS parent_id, entity_type, count(DISTINCT target_id) AS n FROM r JOIN e ON e.id = target_id WHERE relation_type LIKE 'has_%' GROUP BY ALL",
}
