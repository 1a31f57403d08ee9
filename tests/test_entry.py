from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__
from breathlake.functions.compare import nudged

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and all(o.values()) and len(q) > 90


def test_core_imports_without_llm():
    code = "import sys; sys.modules['breathlake.llm'] = None; import __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith(('p3', 'p8'))))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.strip() == "[]", out.stderr


def test_nudge():
    assert nudged("select round(max(a, 1), 6) b, round(f(g(x), y) / 2, 4) c") == "select round((max(a, 1)) + 1e-10, 6) b, round((f(g(x), y) / 2) + 1e-10, 4) c"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
