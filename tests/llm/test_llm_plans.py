"""What plans of text operators must not contain."""

import re

import pytest

from panelforge.llm import mixing, pii

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("operator", [mixing.mix, mixing.repeat_copies, pii.find_pii, pii.mask_pii])
def test_native_operators_have_no_python_workers_and_no_cross_joins(spark, operator):
    plan = operator(spark.read.parquet(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
