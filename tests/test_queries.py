import pytest

from searchloom.plans import catalogue
from tests.comparing import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    assert_same(catalogue.queries()[name](spark, folder), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    assert catalogue.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert 0 <= row["ndcg_10"] <= 1 and 0 <= row["recall_100"] <= 1


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"searchloom\.llm|from searchloom import .*llm", path.read_text()), path
