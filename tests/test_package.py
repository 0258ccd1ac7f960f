"""The package works outside its folder, and cleans up after itself."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from worklens.session import build_session, remove_run_folder, run_folder, ship_package, written
from worklens.functions.words import sequence_ratio
spark = build_session("away", "local[2]", **{"spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[2]})
ship_package(spark)
df = written(spark.createDataFrame([("abc", "abd")], "a string, b string"), "pairs")
assert round(df.select(sequence_ratio("a", "b").alias("r")).first().r, 3) == 0.667
folder = run_folder(spark)
assert os.path.isdir(folder)
remove_run_folder(spark)
assert not os.path.exists(folder)
"""


def test_pandas_paths_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert run.returncode == 0, run.stderr[-2000:]


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage, its tests and the pipeline still has all other queries."""
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, copy, ignore=lambda folder, names: {n for n in names if n in ("llm", ".git", "__pycache__")})
        if not keep_pipeline:
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
        count, numbered, pipeline = done.stdout.split()
        assert int(count) > 150 and (numbered, pipeline) == ("False", "False")
