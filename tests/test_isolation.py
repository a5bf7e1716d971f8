"""The core stands alone: without the text package, or something it needs, its queries are all there."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["tapecheck.llm", "xxhash", "pyarrow", "corpus_pipeline"])
def test_core_queries_without(absent):
    code = (
        "import sys; sys.modules[sys.argv[1]] = None; import __spark_entry__ as e; "
        "from tapecheck.plans.queries import REGISTERED as r; assert set(r) <= set(e.queries()), 1; e.oracle_sql()"
    )
    done = subprocess.run([sys.executable, "-c", code, absent], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
