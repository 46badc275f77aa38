"""The entry without the optional folders, and a session without settings."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd, **env):
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env={**os.environ, **env}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_without_the_optional_folders(tmp_path, leftover):
    shutil.copytree(os.path.join(ROOT, "lexiscope"), tmp_path / "lexiscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if leftover:  # a folder without modules, and the pipeline without its operators
        (tmp_path / "lexiscope" / "llm" / "__pycache__").mkdir(parents=True)
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path) if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else None
    out = run("import __spark_entry__ as e\nq = e.queries()\n"
              "assert 'retrieval_metrics_wide' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')], sorted(q)\n"
              "from lexiscope.session import local_session\n"
              "print(q['prep_counts'](local_session(2), '/root/testdata/sf0.001').count())", tmp_path)
    assert int(out.split()[-1]) > 0


def test_checkpoint_folder_of_a_local_session_without_settings(tmp_path):
    code = ("from lexiscope.session import checkpoint_dir, local_session\ns = local_session(2)\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\na = checkpoint_dir(s)\n"
            "assert checkpoint_dir(s) == a\nprint(s.range(5).checkpoint().count())")
    out = run(code, ROOT, SPARK_CONF_DIR=str(tmp_path))
    assert out.split()[-1] == "5"


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(os.path.join(ROOT, "lexiscope"), tmp_path / "lexiscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "lexiscope" / "llm").mkdir()
    (tmp_path / "lexiscope" / "llm" / "queries.py").write_text("import not_a_module_at_all\n")
    out = run("try:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    print(e.name)", tmp_path)
    assert out.split()[-1] == "not_a_module_at_all"
