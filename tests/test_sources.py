import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions import html, pages, text
from graphloom.operators import admissions, chunking, retrieval
from graphloom.sources import readers

PAGE = """<html><head><title> A  page </title><meta name="description" content="About it"><meta property="og:title" content="T"></head><body><nav>menu</nav>
<main><h1>Robots</h1><p>Read <a href="/more?x=1#f">more</a> or <a href="https://o.example/apply">Apply now</a> &amp; go.</p><script>var x;</script>
<table><tr><td>Founded</td><td>1999</td></tr></table><table><tr><th>Campus</th><th>Degree</th><th>Annual Fees</th></tr><tr><td>Main</td><td>B.Tech</td><td>100</td></tr><tr><td>odd</td></tr></table></main></body></html>"""


def test_page_reading(spark):
    df = spark.createDataFrame([("https://h.example/department/robots/", PAGE), ("https://h.example/x", None), ("https://h.example/y", "<p>broken <b")], "url string, html string")
    got = {r.url: r for r in html.parse_pages(df).collect()}
    p = got["https://h.example/department/robots/"]
    assert p.text.startswith("Robots Read more or Apply now & go.") and "menu" not in p.text and "var x" not in p.text
    assert p.meta == {"description": "About it", "og:title": "T"} and p.infobox == {"Founded": "1999"}
    assert [(x.label, x.url) for x in p.links] == [("more", "https://h.example/more?x=1#f"), ("Apply now", "https://o.example/apply")]
    rows = chunking.table_rows(html.parse_pages(df)).collect()
    assert [r.cells for r in rows] == [{"campus": "Main", "degree": "B.Tech", "annual fees": "100"}]
    r = df.select(html.title_by_regex(F.col("html")).alias("t"), html.links_by_regex(F.col("html"), F.col("url")).alias("l"), html.text_by_regex(F.col("html")).alias("x")).collect()[0]
    assert r.t == "A page" and r.l == ["https://h.example/more?x=1", "https://o.example/apply"] and "menu" not in r.x
    t = html.parse_pages(df).select("url", html.table_text(F.col("tables")).alias("t"), html.infobox_text(F.col("infobox")).alias("i")).collect()[0]
    assert t.t.startswith("Founded | 1999\n\nCampus | Degree") and t.i == "Founded: 1999"


def test_url_functions(spark):
    url = F.col("u")
    df = spark.createDataFrame([("HTTPS://H.example/Department/Civil-Works/?a=1#x",), ("https://h.example/tag/x",), (None,), ("",)], "u string")
    r = df.select(pages.normalize_url(url).alias("n"), pages.slug(url).alias("s"), pages.kind(url).alias("k"), pages.is_noise(url).alias("z"), pages.parent_name(url).alias("p"), pages.tier(url).alias("t")).collect()
    assert tuple(r[0]) == ("https://h.example/department/civil-works", "Civil-Works", "department", False, "Civil Works", "tier2_academic") and r[1].z and not r[2].z


def test_expansion_is_one_pass(spark):
    df = spark.createDataFrame([("HOD of cse, it IT",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(text.expand(F.col("q"), {"hod": "head of cse", "cse": "computer science", "it": "information technology"}, skip=("it",))).collect()]
    assert got == ["HOD (head of cse) of cse (computer science), it IT", "", None]


def test_sections_and_profile(spark):
    body = "Intro. Eligibility pass with 60. How to Apply fill the form. Important Dates 3 May."
    df = spark.createDataFrame([("https://h.example/a", "A", body, [("Apply", "https://o.example/apply"), ("x", "https://z.example/")], "2024")], "url string, title string, text string, links array<struct<label:string,url:string>>, scraped_at string")
    p = admissions.profiles(df, hosts=("o.example",)).collect()[0]
    assert p.sections == {"eligibility": "pass with 60.", "how_to_apply": "fill the form.", "important_dates": "3 May."} and p.apply_links[0].url == "https://o.example/apply"


def test_readers(spark, tmp_path):
    for name, ok in (("a", True), ("b", False)):
        d = tmp_path / "pages" / name
        d.mkdir(parents=True)
        (d / "content.txt").write_text("text of " + name)
        (d / "metadata.json").write_text(json.dumps({"url": f"https://h.example/{name}", "title": name, "meta": {"k": "v"}, "internal_links": []}) if ok else "{broken")
    assert [(r.url, r.content) for r in readers.read_page_folders(spark, str(tmp_path / "pages")).collect()] == [("https://h.example/a", "text of a")]
    (tmp_path / "p.csv").write_bytes("﻿Title,URL,Duration,Annual Fees,Intake\n\"B.Tech, Robots\",https://h.example/p,4,100,60\n".encode())
    row = readers.read_programs(spark, str(tmp_path / "p.csv")).collect()[0]
    assert row["Title"] == "B.Tech, Robots" and row["Annual Fees"] == "100"
    (tmp_path / "kg.json").write_text(json.dumps({"entities": {"x": {"id": "x", "name": "X", "entity_type": "misc", "attributes": {"a": "1"}}}, "relationships": [{"source_id": "x", "target_id": "y", "relation_type": "has_centre"}]}))
    e, r = readers.read_graph(spark, str(tmp_path / "kg.json"))
    assert e.collect()[0].attributes == {"a": "1"} and r.collect()[0].metadata == {}
    readers.write_graph(e, r, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/entities")).collect() == e.collect()
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://h.example/a</loc></url><url><loc> https://h.example/a </loc></url></urlset>")
    assert [x.url for x in readers.read_sitemaps(spark, str(tmp_path / "map.xml")).collect()] == ["https://h.example/a"]


def test_index_and_report(spark, tmp_path):
    from graphloom.operators import retrieval

    docs = spark.createDataFrame([("https://h.example/a", "A", "first text of some length " * 20, "", "")], "url string, title string, content string, table_text string, infobox_text string")
    chunks = chunking.build_chunks(docs)
    by_text = chunks.selectExpr("chunk_id doc_id", "document text")
    posts, stats = retrieval.postings(by_text), retrieval.corpus_stats(by_text)
    readers.write_index(chunks, retrieval.term_stats(posts, stats), stats, str(tmp_path / "ix"), force=True)
    assert spark.read.parquet(str(tmp_path / "ix/chunks")).count() == chunks.count() and not chunking.packs_versions(chunks)
    m = spark.createDataFrame([("B.A", 0.9, "x")], "name string, score double, method string")
    assert "## Matched: 1" in readers.report(m, m.select("name"), m.select("name"))


def test_index_life_cycle(spark, tmp_path):
    docs = spark.createDataFrame([("https://h.example/a", "A", "First text of the page.", "", ""), ("https://h.example/b", "B", "Other text.", "", "")], "url string, title string, content string, table_text string, infobox_text string")
    folder, chunks = str(tmp_path / "ix"), chunking.build_chunks(docs, lossless=True)
    readers.upsert_index(chunks, folder)
    readers.upsert_index(chunks, folder)
    assert spark.read.parquet(f"{folder}/chunks").count() == chunks.count()
    changed = chunking.build_chunks(docs.filter("title = 'A'").withColumn("content", F.lit("New text of the page.")), lossless=True)
    readers.upsert_index(changed, folder)
    by_text = spark.read.parquet(f"{folder}/chunks").filter("chunk_level = 'child'").selectExpr("chunk_id doc_id", "document text")
    assert sorted(r.text.split("\n")[-1] for r in by_text.collect()) == ["New text of the page.", "Other text."]
    posts, stats = retrieval.postings(by_text), retrieval.corpus_stats(by_text)
    retrieval.term_stats(posts, stats).write.parquet(f"{folder}/term_stats")
    stats.write.parquet(f"{folder}/corpus_stats")
    read, terms, totals = readers.read_index(spark, folder)
    asked = spark.createDataFrame([("q", "new page")], "query_id string, question string")
    found = retrieval.search_sparse(asked, by_text, 3, index=(posts, totals))
    assert found.collect() == retrieval.search_sparse(asked, by_text, 3).collect() and terms.count() and read.count() == chunks.count()
    read.drop("parent_id").write.mode("overwrite").parquet(str(tmp_path / "old/chunks"))
    with pytest.raises(ValueError, match="parent_id"):
        readers.read_index(spark, str(tmp_path / "old"))


def test_profiles_and_evaluations_round_trip(spark, tmp_path):
    rows = [("u", "n", {"fees": "Rs. 5"}, [("Apply", "https://h.example/apply")], [], [], datetime(2024, 1, 2, 3))]
    links = "array<struct<label:string,url:string>>"
    profiles = spark.createDataFrame(rows, f"url string, name string, sections map<string,string>, apply_links {links}, exam_links {links}, prospectus_links {links}, scraped_at timestamp")
    readers.write_profiles(profiles, str(tmp_path / "p"))
    assert readers.read_profiles(spark, str(tmp_path / "p")).collect() == profiles.collect()
    readers.write_evaluation(spark.range(3), spark.range(1), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/results")).count() == 3 and spark.read.json(str(tmp_path / "e/summary")).count() == 1
