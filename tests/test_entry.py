"""The entry without the optional parts: the training-data operators, the pipeline, or both."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def _copy(to) -> str:
    shutil.copytree(f"{ROOT}/meterlake", f"{to}/meterlake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", to)
    return str(to)


def _run(at: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", NAMES], cwd=at, env=os.environ | {"PYTHONPATH": at}, capture_output=True, text=True)


@pytest.mark.parametrize("gone", [["meterlake/llm"], ["corpus_pipeline.py"], ["meterlake/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_optional_parts(tmp_path, gone):
    at = _copy(tmp_path)
    for name in gone:
        shutil.rmtree(f"{at}/{name}", ignore_errors=True)
        if os.path.isfile(f"{at}/{name}"):
            os.remove(f"{at}/{name}")
    names, sql = json.loads(_run(at).stdout)
    assert "breakdown_model" in names and set(sql) <= set(names)
    assert "pipeline" not in names and (gone == ["corpus_pipeline.py"] or not any(n.startswith("op") for n in names))


def test_other_failing_imports_are_errors(tmp_path):
    at = _copy(tmp_path)
    os.makedirs(f"{at}/meterlake/llm", exist_ok=True)
    for name, text in (("__init__.py", ""), ("queries.py", "import no_such_module_of_ours\n")):
        with open(f"{at}/meterlake/llm/{name}", "w") as out:
            out.write(text)
    found = _run(at)
    assert found.returncode and "no_such_module_of_ours" in found.stderr
