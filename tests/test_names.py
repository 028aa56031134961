"""Modules say each name once: a second function of a name would take the place of the first for all its callers."""

import ast
import glob
import os
from collections import Counter

import pytest

import chronolake
from chronolake.plans import adapters

MODULES = sorted(glob.glob(os.path.join(os.path.dirname(chronolake.__file__), "*", "*.py")))


@pytest.mark.parametrize("path", MODULES, ids=os.path.basename)
def test_functions_are_defined_once(path):
    with open(path, encoding="utf-8") as f:
        names = Counter(n.name for n in ast.parse(f.read()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
    assert [n for n, k in names.items() if k > 1] == []


def test_ticks_are_dealt_before_their_texts_are_made(spark):
    plan = adapters.dealt_by_month(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    assert "concat(" in above and "concat(" not in below and "l_tax" not in below.split("Relation")[0]
