import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_every_sql_has_a_query():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_training_data_query_is_timed():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e
    import bench

    trained = lambda n: n == "pipeline" or n.startswith("op") and n[2].isdigit()
    there = set(e.queries())
    assert {n for n in there if trained(n)} | {"contamination_word_span"} <= set(bench.HEADLINE)
    assert {n for n in bench.HEADLINE if not trained(n)} <= there and (not e.llm or not e.corpus_pipeline or set(bench.HEADLINE) <= there)
