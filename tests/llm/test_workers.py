import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import importlib.util, sys
sys.path.insert(0, sys.argv[1])
from scanloom.session import local_session
import __spark_entry__ as contract
spark = local_session("2")
there = lambda _: [importlib.util.find_spec("scanloom") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
for name in sys.argv[2:]:
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() >= 200, name
"""


def test_workers_need_not_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op2_language_id", "op8_packing", "op11_spelling_variants", "op12_merkle_manifest", "op13_sentence_pieces", "pipeline"]
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
