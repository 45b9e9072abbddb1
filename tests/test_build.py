from pyspark.sql import functions as F

from graphloom.operators import build, matching

H = "https://h.example"
PAGES = [
    (f"{H}/college/engineering/", "Faculty of Engineering | Home", "Dean: Dr. A. Vale welcomes you.", [f"{H}/department/robotics", f"{H}/centre/kilns/"], 1), (f"{H}/department/robotics", "Robotics", "Prof. Dr. Reed, Head of the Department. Annual fees: Rs. 50,000 per annum", [f"{H}/program/b-tech-robotics/"], 2),
    (f"{H}/program/b-tech-robotics/", None, "Eligibility: minimum 60% marks", [], 3), (f"{H}/program/m-sc-chemistry/", "M.Sc Chemistry", "", None, 4), (f"{H}/directorate/research/", "Research", None, [f"{H}/centre/kilns/"], 0), (f"{H}/centre/kilns/", "Kilns", "", [], 5),
    (f"{H}/tag/x/", "x", "", [], 6), (f"{H}/department/robotics/staff/", "Staff", "", [], 7), (f"{H}/about/units/", "Units", "School of Law Department of Tax - Head: Dr. B. Orr School of Arts and Design Department of Music Department of Fine Arts", [], 8), (None, None, None, None, 9),
]


def test_graph_from_pages(spark):
    pages = spark.createDataFrame(PAGES, "url string, title string, text string, links array<string>, seq long")
    rules = build.Rules(inferred={"offers_program": [("chem", "college--engineering")]}, merges=[("department--fine-arts", "department--music")], urls=[("school--law", f"{H}/law")], parents=[("college--engineering", "department--tax", "has_department")])
    entities, edges = build.build_graph(pages, rules=rules)
    e = {r.id: r for r in entities.collect()}
    assert set(e) == {"college--engineering", "department--robotics", "program--b-tech-robotics", "program--m-sc-chemistry", "directorate--research", "centre--kilns", "school--law", "school--arts-and-design", "department--tax", "department--music"}
    assert e["college--engineering"].name == "Faculty of Engineering" and e["college--engineering"].attributes == {"dean": "Dr. A. Vale"} and e["school--law"].url == f"{H}/law"
    assert e["department--robotics"].attributes == {"hod": "Prof. Dr. Reed", "annual_fees": "Rs. 50,000 per annum"} and e["program--b-tech-robotics"].name == "B Tech Robotics"
    got = {(r.source_id, r.relation_type, r.target_id) for r in edges.collect()}
    assert got == {
        ("college--engineering", "has_department", "department--robotics"), ("department--robotics", "offers_program", "program--b-tech-robotics"), ("college--engineering", "offers_program", "program--m-sc-chemistry"), ("college--engineering", "has_centre", "centre--kilns"),
        ("directorate--research", "also_listed_under", "centre--kilns"), ("college--engineering", "has_department", "department--tax"), ("school--arts-and-design", "has_department", "department--music"),
    }


def test_official_list_and_reconciliation(spark):
    e = spark.createDataFrame([("p1", "B.Tech Robotics", "program", "M", "", {"k": "1"}, 1), ("p2", "M.A History", "program", "M", "", {}, 2), ("p3", "M.A Music", "program", "X", "", {}, 3), ("d", "Robotics", "department", "M", "", {}, 4)], "id string, name string, entity_type string, campus string, url string, attributes map<string,string>, seq long")
    official = spark.createDataFrame([(1, "B.Tech Robotics 2026", "u", "4", "100", None), (2, "Ph.D Tides", None, None, None, "5"), (3, "Ph.D Tides", None, "3", None, None), (4, None, None, None, None, None)], "row_id long, title string, url string, duration string, fees string, intake string")
    got = {r.id: r.attributes for r in build.add_programs(e, official).collect()}
    assert got["p1"] == {"k": "1", "duration": "4", "annual_fees": "100"} and got["program--ph-d-tides"] == {"duration": "3", "intake": "5"}
    r = spark.createDataFrame([("d", "p1", "offers_program", 1), ("d", "p2", "offers_program", 2), ("d", "p3", "offers_program", 3)], "source_id string, target_id string, relation_type string, seq long")
    o = official.filter("row_id < 3").select(F.col("row_id").alias("lid"), F.col("title").alias("name"), "url")
    matched = matching.fuzzy_tier(o, e.filter("entity_type = 'program'").select(F.col("id").alias("rid"), "name", "url"), spark.createDataFrame([], "lid long, rid string"))
    ents, edges = build.apply_reconciliation(e, r, matched, o, "M")
    assert {x.id: x.name for x in ents.collect()} == {"p1": "B.Tech Robotics 2026", "p3": "M.A Music", "d": "Robotics", "program--ph-d-tides": "Ph.D Tides"}
    assert {(x.source_id, x.target_id) for x in edges.collect()} == {("d", "p1")}
    rows = spark.createDataFrame([("p", "A", 0.5, 1), ("p", "B", 0.9, 2), ("q", "A", 0.4, 3), ("q", "C", 0.8, 4)], "program_id string, campus string, confidence double, seq long")
    want = spark.createDataFrame([("p", "A"), ("q", "B")], "program_id string, campus string")
    assert {(x.program_id, x.campus) for x in build.best_rows(rows, want).collect()} == {("p", "A"), ("q", "C")}
