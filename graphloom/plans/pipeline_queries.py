"""Queries of the general data problems: hierarchies (p1) and dangling references (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, references
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.found(table(spark, folder, "relationship"))


def p1_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.nested_sets(hierarchy.hierarchy_links(table(spark, folder, "relationship")))
    return tree.select(
        F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("path"), "descendants",
        (F.col("rgt") - F.col("lft") == F.col("descendants")).alias("range_fits"),
    )


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every node below each university, by nested-set ranges."""
    tree = hierarchy.nested_sets(hierarchy.hierarchy_links(table(spark, folder, "relationship")))
    top = tree.filter(F.col("id").startswith("university--")).select("id")
    return hierarchy.descendants(tree, top).select("ancestor", F.col("id").alias("node_id"), F.col("distance").cast("int").alias("distance"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.found(table(spark, folder, "relationship"), table(spark, folder, "entity"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.report(table(spark, folder, "relationship"), table(spark, folder, "entity"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_descendants, p2_found, p2_report)}

_LINKS = """links AS (
  SELECT DISTINCT CASE WHEN up THEN s ELSE t END AS child, CASE WHEN up THEN t ELSE s END AS parent
  FROM (SELECT nullif(source_id, '') AS s, nullif(target_id, '') AS t, k = 'belongs_to' AS up
        FROM (SELECT source_id, target_id, regexp_replace(lower(regexp_replace(relation_type, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g') AS k FROM relationship)
        WHERE k IN ('belongs_to', 'has_campus', 'has_college', 'has_sub_college', 'has_department', 'has_centre', 'has_directorate', 'has_facility', 'has_admission', 'offers_program'))),
nodes AS (SELECT id, min(parent) AS parent FROM (SELECT child AS id, parent FROM links UNION ALL SELECT parent, NULL FROM links) WHERE id IS NOT NULL GROUP BY id),
tree AS (
  SELECT id, id AS root, 0 AS depth, id AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || ' > ' || n.id FROM nodes n JOIN tree t ON n.parent = t.id),
stray AS (SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
up AS (SELECT id AS start, parent AS above FROM stray UNION SELECT u.start, s.parent FROM up u JOIN stray s ON s.id = u.above),
ring AS (SELECT above AS id FROM up WHERE start = above),
stray_root AS (SELECT start AS id, min(above) AS root FROM up WHERE above IN (SELECT id FROM ring) GROUP BY start)"""

_REFS = """refs AS (SELECT rel_id, 'source_id' AS ref_field, source_id AS k, seen_at FROM relationship UNION ALL SELECT rel_id, 'target_id', target_id, seen_at FROM relationship),
known AS (SELECT id, min(scraped_at) AS first_at, max(removed_at) AS removed_at FROM entity WHERE id IS NOT NULL GROUP BY id),
judged AS (SELECT rel_id, ref_field, seen_at, CASE WHEN id IS NULL THEN 'missing' WHEN first_at > seen_at THEN 'late' WHEN removed_at <= seen_at THEN 'removed' END AS kind
  FROM refs LEFT JOIN known ON k = id WHERE k <> '')"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT id AS node_id, root AS root_id, depth FROM tree UNION ALL SELECT id, root, -1 FROM stray_root",
    "p1_tree": f"""WITH RECURSIVE {_LINKS},
      down AS (SELECT id AS top, id FROM tree UNION ALL SELECT d.top, n.id FROM down d JOIN nodes n ON n.parent = d.id),
      sizes AS (SELECT top AS id, count(*) - 1 AS descendants FROM down GROUP BY top)
      SELECT id AS node_id, root AS root_id, depth, path, descendants, true AS range_fits FROM tree JOIN sizes USING (id)
      UNION ALL SELECT id, root, -1, NULL, NULL, NULL FROM stray_root""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
      down AS (SELECT id AS ancestor, id, 0 AS distance FROM tree WHERE starts_with(id, 'university--') UNION ALL SELECT d.ancestor, n.id, d.distance + 1 FROM down d JOIN nodes n ON n.parent = d.id)
      SELECT ancestor, id AS node_id, distance FROM down WHERE distance > 0""",
    "p2_found": f"WITH {_REFS} SELECT rel_id, ref_field, kind FROM judged WHERE kind IS NOT NULL",
    "p2_report": f"""WITH {_REFS} SELECT ref_field, strftime(seen_at, '%Y-%m') AS month, count(*) AS refs, count(*) FILTER (kind = 'missing') AS missing,
      count(*) FILTER (kind = 'late') AS late, count(*) FILTER (kind = 'removed') AS removed FROM judged GROUP BY ALL""",
}
