"""The rest of the repository does without the subpackage."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_without_the_subpackage(tmp_path):
    import shutil

    for name in ("quiver", "__spark_entry__.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 45 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = [k.split("_")[0] for k in entry.queries() if k.startswith("op") and k.split("_")[0][2:].isdigit()]
    assert sorted(names, key=lambda x: int(x[2:])) == [f"op{n}" for n in range(1, 14)] and "pipeline" in entry.queries()


def test_nothing_else_imports_the_subpackage():
    for base, _, files in os.walk(os.path.join(REPO, "quiver")):
        if os.path.basename(base) not in ("llm", "__pycache__") and os.sep + "llm" not in base:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(base, f)) as source:
                        assert "quiver.llm" not in source.read(), f
