"""Without the corpus operators, or what they need, the other queries are all there."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
for name in {missing!r}:
    sys.modules[name] = None  # as if it were not installed
import __spark_entry__ as e
from helmsight import queries as reference
assert set(e.queries()) == set(reference.queries()) and set(e.oracle_sql()) == set(reference.oracle_sql())
"""


def test_entry_without_corpus_operators():
    for missing in (["helmsight.llm"], ["helmsight.llm", "corpus_pipeline"], ["regex"]):
        subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, check=True)
