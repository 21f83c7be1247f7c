"""The driver's contract holds with and without the training-data folder."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('pagelattice.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
if {block}:
    sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and len(q) > 90, len(q)
print('llm' if any(x.startswith('op1_') for x in q) else 'plain')
"""


def test_without_llm():
    out = subprocess.run([sys.executable, "-c", CODE.format(block=True)], cwd=REPO, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "plain"


def test_as_it_is():
    out = subprocess.run([sys.executable, "-c", CODE.format(block=False)], cwd=REPO, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == ("llm" if (REPO / "pagelattice/llm").is_dir() else "plain")
