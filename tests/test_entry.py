"""The driver's entry where the training-data operators, or what they need, are not installed."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys, warnings
warnings.simplefilter("ignore")
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = entry.queries()
print("throttle" in names, "pipeline" in names, set(entry.oracle_sql()) <= set(names))
"""


@pytest.mark.parametrize("blocked", [["public_tokenizers"], ["framewright.llm"], ["framewright.llm", "corpus_pipeline"]])
def test_other_queries_stay(blocked):
    run = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert run.stdout.split() == ["True", "False", "True"], run.stderr


def test_a_broken_library_is_reported():
    run = subprocess.run([sys.executable, "-c", CODE.format(blocked=["framewright.session"])], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert "ModuleNotFoundError" in run.stderr
