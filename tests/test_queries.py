"""Every query with SQL of its own, against DuckDB on the smallest tables."""

import pytest

from pagelode.plans import registry
from tests.conftest import SF

#: Many steps; they run in the driver's comparison.
SLOW = {"pagerank_20it", "pagerank_top", "pagerank_summary", "rank_authority", "rank_relevance", "rank_page2", "search_full", "top_pages"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_against_sql(spark, duck, agree, name):
    agree(registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLES[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """The rest imports and answers with both llm folders gone, whether the pipeline's file is there or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pagelode", tmp_path / "pagelode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from pagelode.llm.bpe import encode_documents\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
