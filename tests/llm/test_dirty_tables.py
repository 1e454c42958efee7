import pytest

from evtide.llm.queries import QUERIES
from tests.dirty import copy, rows


@pytest.fixture(scope="module")
def empty(base, tmp_path_factory):
    return copy(base, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.fixture(scope="module")
def dirty(base, tmp_path_factory):
    return copy(base, tmp_path_factory.mktemp("dirty"), empty=False)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert name == "p9_report" or QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_found") or n == "p2_survivors"])
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, base, dirty, name):
    assert rows(QUERIES[name](spark, dirty)) == rows(QUERIES[name](spark, base))
