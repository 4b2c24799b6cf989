"""The registered queries and the independence of the core."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_match():
    from mediagauge.plans import registry

    q, s = registry.queries(), registry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_core_does_not_import_llm():
    for path in (ROOT / "mediagauge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "mediagauge").parts:
            assert "mediagauge.llm" not in path.read_text(encoding="utf-8"), path
    code = "import sys; sys.modules['mediagauge.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not [k for k in e.queries() if k.startswith('p1_')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_runs(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["article_id", "published_us"] and df.count() > 0
