"""The entry module without what the training-data part needs."""

import subprocess
import sys

from conftest import ROOT

HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == {hidden!r}:
            raise ModuleNotFoundError(f'No module named {{name!r}}', name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter('always')
    import __spark_entry__ as E
print(len(E.queries()), any(k.startswith('op') or k == 'pipeline' for k in E.queries()), sum('left out' in str(w.message) for w in seen))
"""


def listed(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, root=ROOT)], capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_core_queries_stay_when_a_module_is_missing():
    n, llm, warned = listed("xxhash")
    assert int(n) > 70 and llm == "False" and warned == "1"


def test_core_queries_stay_without_the_pipeline():
    n, llm, warned = listed("corpus_pipeline")
    assert int(n) > 70 and llm == "False" and warned == "0"
