"""Reading and writing pages, graphs, profiles, programs, indexes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page with less text than this is not kept.
LEAST_TEXT = 200
ENTITY = "id string, name string, entity_type string, campus string, url string, attributes map<string,string>"
RELATIONSHIP = "source_id string, target_id string, relation_type string, metadata map<string,string>"
CASE = "id string, question string, expected_intent string, expected_keywords array<string>, expected_items array<string>, should_not_contain array<string>"


def read_page_folders(spark: SparkSession, root: str) -> DataFrame:
    """url, title, scraped_at, meta, internal_links, content of folders that hold content.txt and metadata.json.

    Folders that lack one of them, or whose metadata is broken, are left out.
    """
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1)
    content = spark.read.text(f"{root}/*/content.txt", wholetext=True).select(folder.alias("folder"), F.col("value").alias("content"))
    schema = "url string, title string, scraped_at string, meta map<string,string>, internal_links array<string>, _corrupt_record string"
    meta = spark.read.schema(schema).json(f"{root}/*/metadata.json", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").withColumn("folder", folder)
    return meta.filter("_corrupt_record IS NULL AND url IS NOT NULL").drop("_corrupt_record").join(content, "folder")


def read_sitemaps(spark: SparkSession, paths: str) -> DataFrame:
    """Distinct addresses (column url) named by sitemap files."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))).alias("url")).distinct()


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """The official list: Title, URL, Duration, Annual Fees, Intake; a byte order mark before the header is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of graph files; entities are a map by id or a list, missing metadata is empty."""
    text = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", r"(?s)^[^{]*?=\s*(?=\{)|;\s*$", ""))
    as_map = F.from_json(F.get_json_object("value", "$.entities"), f"map<string,struct<{ENTITY.replace(' string', ':string').replace(' map', ':map')}>>")
    as_list = F.from_json(F.get_json_object("value", "$.entities"), f"array<struct<{ENTITY.replace(' string', ':string').replace(' map', ':map')}>>")
    entities = text.select(F.posexplode(F.when(F.get_json_object("value", "$.entities").startswith("["), as_list).otherwise(F.map_values(as_map))).alias("seq", "e")).select("e.*", "seq")
    rels = F.from_json(F.get_json_object("value", "$.relationships"), f"array<struct<{RELATIONSHIP.replace(' string', ':string').replace(' map', ':map')}>>")
    edges = text.select(F.posexplode(rels).alias("seq", "r")).select("r.*", "seq").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return entities, edges


def write_graph(entities: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as two Parquet tables; the same graph is the same after reading."""
    entities.write.mode("overwrite").parquet(f"{folder}/entities")
    edges.write.mode("overwrite").parquet(f"{folder}/relationships")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path, multiLine=True)


def keep_pages(pages: DataFrame, text: Column, least: int = LEAST_TEXT) -> DataFrame:
    """Pages with enough text."""
    return pages.filter(F.length(F.coalesce(text, F.lit(""))) >= least)


def not_yet(pages: DataFrame, indexed: DataFrame, plain: Column) -> DataFrame:
    """Pages whose plain address no indexed page (column url, plain already) has."""
    return pages.withColumn("__plain", plain).join(indexed.select(F.col("url").alias("__plain")).distinct(), "__plain", "left_anti").drop("__plain")


def write_index(chunks: DataFrame, terms: DataFrame, stats: DataFrame, folder: str, force: bool = False) -> None:
    """A sparse index: chunks by level, terms with their statistics, corpus totals. force replaces what is there."""
    mode = "overwrite" if force else "append"
    chunks.write.mode(mode).partitionBy("chunk_level").parquet(f"{folder}/chunks")
    terms.write.mode("overwrite").parquet(f"{folder}/term_stats")
    stats.write.mode("overwrite").parquet(f"{folder}/corpus_stats")


#: Fields that a chunk of an index must have.
CHUNK_FIELDS = ("chunk_id", "chunk_level", "parent_id", "chunk_type", "document")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, term statistics, corpus totals) of a written index; an error names the fields that its chunks lack."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    if lacking := [f for f in CHUNK_FIELDS if f not in chunks.columns]:
        raise ValueError(f"the index at {folder} is of another version: its chunks lack {', '.join(lacking)}")
    return chunks, spark.read.parquet(f"{folder}/term_stats"), spark.read.parquet(f"{folder}/corpus_stats")


def upsert_index(chunks: DataFrame, folder: str) -> None:
    """Bring chunks into an index by id: known ids are replaced, new ones added, so a second run changes nothing.

    The new state is written beside the old one, which is then replaced as a whole; an interrupted run leaves the old one. Of rows
    with one id in chunks one is kept. The statistics are to be written anew from read_index's chunks.
    """
    spark = chunks.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = place("chunks").getFileSystem(conf)
    after = chunks.dropDuplicates(["chunk_id"])
    if files.exists(place("chunks")):
        before = spark.read.parquet(f"{folder}/chunks")
        after = before.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(after, allowMissingColumns=True)
    after.write.mode("overwrite").partitionBy("chunk_level").parquet(f"{folder}/chunks_next")
    files.delete(place("chunks"), True)
    files.rename(place("chunks_next"), place("chunks"))


def write_profiles(profiles: DataFrame, folder: str) -> None:
    """Profiles as JSON lines, as read_profiles reads them."""
    profiles.write.mode("overwrite").json(folder)


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles (url, name, sections, links by category, scraped_at) that write_profiles wrote; unknown fields are ignored."""
    links = ", ".join(f"{c}_links array<struct<label:string,url:string>>" for c in ("apply", "exam", "prospectus"))
    return spark.read.schema(f"url string, name string, sections map<string,string>, {links}, scraped_at timestamp").json(folder)


def write_evaluation(scored: DataFrame, summary: DataFrame, folder: str) -> None:
    """An evaluation as two JSON tables: one row per result, and the summary."""
    scored.write.mode("overwrite").json(f"{folder}/results")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def report(matched: DataFrame, stale: DataFrame, missing: DataFrame, rows: int = 1000) -> str:
    """A reconciliation as markdown: matches by falling score, stale and missing names, at most `rows` of each shown with the total."""
    out = []
    for title, df, order in (("Matched", matched, [F.desc("score"), "name"]), ("Stale", stale, ["name"]), ("Missing", missing, ["name"])):
        out += [f"## {title}: {df.count()}", ""] + [f"- {r['name']}" + (f" ({r['score']:.3f}, {r['method']})" if "score" in r else "") for r in (x.asDict() for x in df.orderBy(*order).limit(rows).collect())] + [""]
    return "\n".join(out)
