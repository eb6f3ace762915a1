"""The entry point without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len([n for n in e.queries() if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']), len(e.queries()))"


def _copy(tmp_path, without):
    shutil.copytree(
        os.path.join(ROOT, "mailsift"), tmp_path / "mailsift", ignore=shutil.ignore_patterns("__pycache__", *without)
    )
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    return tmp_path


def _counted(folder):
    env = os.environ | {"PYTHONPATH": "", "PYTHONWARNINGS": "ignore"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


@pytest.mark.parametrize("without", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_core_queries_without_the_optional_part(tmp_path, without):
    from mailsift.plans import catalog

    assert _counted(_copy(tmp_path, without)) == [0, len(catalog.QUERIES)]


def test_core_queries_without_an_optional_package(tmp_path):
    from mailsift.plans import catalog

    folder = _copy(tmp_path, ())
    (folder / "public_tokenizers.py").write_text("raise ImportError('not installed')")
    assert _counted(folder) == [0, len(catalog.QUERIES)]
