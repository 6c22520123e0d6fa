"""The operators that must be native run no Python on the executors."""

import contextlib
import io

import pytest

from basketry.llm import queries


@pytest.mark.parametrize("name", ["op8_decontaminate", "op9_pii"])
def test_no_python_in_the_plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in out.getvalue()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    from compare import compare

    compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])
