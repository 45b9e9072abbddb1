"""Registered queries over rows of every script, by hand."""

import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.operators import chunking, routing
from graphloom.plans.catalogue import QUERIES
from tests.hostile import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")

ASKED = [(1, "मुझे बताओ how to apply for B.Tech"), (2, "Compare the “Robotics” and Design departments"), (3, "ค่าธรรมเนียม hostel fees"), (4, "plain list of programs"), (5, None)]
NAMES = [("department--r", "department", "Robotics"), ("department--x", "department", "Кафедра"), ("college--x", "college", "кафедра"), ("program--d", "program", "M.Des Café Lighting"), ("program--n", "program", None)]
EDGES = [(1, "a", "p", "offers_program"), (2, "b", "p", "offers_program"), (3, "c", "q", "offers_program"), (4, "a", "x", "has_centre")]
TEXTS = [(1, "İİ 🙂 café. In Addition the fée is due. Under clause 4 — “none”.", "tr"), (2, "plain. In addition it rains.", "en"), (3, None, "en"), (4, "यह सूची है।", "hi")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("whole")

    def write(name: str, rows: list[dict]) -> None:
        schema = pq.read_schema(DATA / f"{name}.parquet")
        pq.write_table(pa.Table.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema=schema), to / f"{name}.parquet")

    write("chat_request", [{"request_id": i, "query": q} for i, q in ASKED])
    write("entity", [{"rec_id": k, "id": i, "entity_type": t, "name": n} for k, (i, t, n) in enumerate(NAMES)])
    write("relationship", [{"rel_id": k, "source_id": a, "target_id": b, "relation_type": r} for k, a, b, r in EDGES])
    write("program_listing", [{"listing_id": 1, "title": "M.Des – Café Lighting"}, {"listing_id": 2, "title": None}])
    write("documents", [{"doc_id": i, "text": t, "lang": lang, "url": f"https://h.example/{i}"} for i, t, lang in TEXTS])
    return str(to)


def test_questions_of_every_script(spark, folder):
    kinds = {r.request_id: r.query_type for r in QUERIES["intent_classify"](spark, folder).collect()}
    want = {i: next((n for p, n in routing.QUERY_TYPES if re.search(p, q.lower())), "factual") for i, q in ASKED if q}
    assert kinds == want
    domains = {r.request_id: (r.task, r.domain) for r in QUERIES["route_domain_scores"](spark, folder).collect()}
    assert domains == {1: ("procedure", "admissions"), 2: ("compare", "departments"), 3: ("general", "fees"), 4: ("list", "programs")}
    assert {(r.text_id, r.name) for r in QUERIES["longest_name_in_text"](spark, folder).collect()} == {(2, "robotics")}


def test_names_of_every_script(spark, folder):
    assert [tuple(r) for r in QUERIES["duplicate_names"](spark, folder).collect()] == [("кафедра", 2, "college--x")]
    assert {tuple(r) for r in QUERIES["kg_by_name"](spark, folder).collect()} == {("robotics", "department--r"), ("кафедра", "college--x"), ("m.des café lighting", "program--d")}
    assert [r.share for r in QUERIES["name_token_overlap"](spark, folder).collect()] == [1.0]


def test_first_edge_whatever_its_number(spark, folder):
    assert {(r.source_id, r.target_id) for r in QUERIES["single_parent"](spark, folder).collect()} == {("a", "p"), ("c", "q"), ("a", "x")}


def test_chunks_hold_the_whole_text(spark, folder):
    sizes = {}
    for r in QUERIES["chunk_semantic"](spark, folder).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
    assert sizes == {i: len(t) for i, t, _ in TEXTS if t}
    assert {(r.url[-1], r.chunk_type) for r in QUERIES["chunk_ids_all"](spark, folder).collect() if r.chunk_type == "text"} == {(x, "text") for x in "124"}
    page = spark.createDataFrame([("u", "t", "x" * 1500, "", "")], "url string, title string, content string, table_text string, infobox_text string")
    pieces = [r.document.split("\n")[-1] for r in chunking.build_chunks(page, lossless=True).filter("chunk_level = 'child'").orderBy("chunk_ix").collect()]
    assert "".join(pieces) == "x" * 1500


def test_documents_of_every_script(spark, folder):
    got = {(r.doc_id, r.field): (r.size, r.digest) for r in QUERIES["page_sections"](spark, folder).collect()}
    said = lambda s: (len(s), hashlib.md5(s.encode()).hexdigest())
    assert got == {(1, "first"): said("the fée is due."), (1, "clause"): said("4 — “none”."), (2, "first"): said("it rains.")}
    assert {r.doc_id for r in QUERIES["sentence_compress"](spark, folder).collect()} == {1, 2, 4}
