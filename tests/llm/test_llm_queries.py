"""Every query of the subpackage over the smallest shared tables; SQL where there is some."""

import pytest

from broadsheet.llm import queries
from tests.oracle import connect, duck_rows, spark_rows

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, name):
    names, rows = spark_rows(QUERIES[name](spark, data))
    assert len(set(names)) == len(names)
    if name.endswith("_found"):
        assert rows and len(rows) == len(set(rows))
    if name in SQL:
        assert (names, rows) == duck_rows(connect(data), SQL[name])


def test_nothing_outside_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"broadsheet\.llm|from \.llm", path.read_text()), path
