import pytest

from graphloom.plans.catalogue import QUERIES
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
    QUERIES[name](spark, bad).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_survives_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).count()
    assert rows == 0 or name in ("corpus_stats", "eval_summary", "cache_stats", "kg_stats", "kg_stats_cube")
