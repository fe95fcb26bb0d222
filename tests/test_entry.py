"""The entry module works in a process that has no Spark session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def bare(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)


def test_imports_without_a_session():
    done = bare("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print(len(q), len(s))")
    assert done.returncode == 0, done.stderr
    n_queries, n_sql = map(int, done.stdout.split())
    assert n_queries >= n_sql >= 90


def test_works_without_the_training_data_subpackage():
    block = "import sys; sys.modules['vqspark.llm'] = None; sys.modules['corpus_pipeline'] = None; "
    done = bare(block + "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; assert len(e.oracle_sql()) >= 90")
    assert done.returncode == 0, done.stderr


def test_sql_is_there_for_most_queries():
    done = bare("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); core = [n for n in q if not (n.startswith('op') and n[2].isdigit()) and n != 'pipeline']; print(sum(n in s for n in core), len(core))")
    with_sql, core = map(int, done.stdout.split())
    assert with_sql >= 0.75 * core
