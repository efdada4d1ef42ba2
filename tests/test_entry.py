"""The driver's contract holds where the corpus part was removed."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(root):
    return json.loads(subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, check=True).stdout)


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_queries_without_the_corpus_part(tmp_path, with_pipeline):
    names, sql = listed(ROOT)
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    if not with_pipeline:
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    own = lambda names: [n for n in names if n != "pipeline" and not n.startswith("op")]
    assert listed(tmp_path / "r") == [own(names), own(sql)]
