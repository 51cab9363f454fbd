"""The driver's entry and every registered query of the engine against DuckDB."""

import subprocess
import sys
from pathlib import Path

import pytest
from rows import HAS_TABLES, SMALL, duck, same_as_sql

from bhashya import queries as engine

ROOT = Path(__file__).parent.parent
needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck()


@needs_tables
@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_equal_to_sql(spark, connection, name):
    assert same_as_sql(spark, connection, engine.QUERIES[name], engine.ORACLES[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_the_others_run(spark, name):
    assert engine.QUERIES[name](spark, SMALL).count() > 0


@needs_tables
def test_documents_normalise_as_plain_python_does(spark):
    import hashlib

    from bhashya.functions.normalize import normalize_text

    texts = {r["id"]: r["text"] for r in engine.texts(spark, SMALL).collect()}
    for r in engine.QUERIES["normalize_documents"](spark, SMALL).collect():
        assert r["norm_sha256"] == hashlib.sha256(normalize_text(texts[r["id"]]).encode()).hexdigest()


@needs_tables
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["label", "n", "passed"] and set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.QUERIES) <= set(entry.queries())


def test_the_entry_imports_without_the_training_data_operators(tmp_path):
    """As after the deletion of their subpackage and the pipeline."""
    for p in ("__spark_entry__.py", "bhashya"):
        (tmp_path / p).symlink_to(ROOT / p)
    code = "import sys; sys.modules['bhashya.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    # the folder of the linked file comes first in sys.path, so corpus_pipeline is hidden as well
    done = subprocess.run([sys.executable, "-c", "import sys; sys.modules['corpus_pipeline'] = None; " + code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(engine.QUERIES), done.stderr
