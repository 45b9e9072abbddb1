import pytest

from graphloom.llm.queries import QUERIES
from tests.hostile import DATA, folder

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def bad(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("bad") / "t")


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("empty") / "t", empty=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_survives_dirty_tables(spark, bad, name):
    df = QUERIES[name](spark, bad)
    rows = df.collect()
    if name.endswith("_found") and name != "p10_found":  # doc_id is unique there
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_survives_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
