"""Executors need no copy of the package: Python code and broadcast values reach them by value."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import functions as F
sys.path.insert(0, {root!r})
from wavegrid.session import local_session
from wavegrid.llm import language_id, lm_score, ngram_join, packing, quality_rules
spark = local_session("bare", cores=2, partitions=2, memory="2g")

def absent(batches):
    try:
        import wavegrid
        found = True
    except ImportError:
        found = False
    for b in batches:
        yield b.assign(found=found)

assert not spark.range(1).mapInPandas(absent, "id long, found boolean").first().found, "the workers see the package"
rows = [(i, " ".join(f"w{{j % 7}}{{i}}" for j in range(60)), ["en", "de"][i % 2], "s", 9) for i in range(8)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
assert lm_score.score(docs, F.lit(True)).count() == 8
assert quality_rules.judge(docs).count() == 8
assert language_id.classify(docs, language_id.train(docs)).count() == 8
assert ngram_join.join_components(docs).count() == 8
assert packing.pack(docs).count() == 8
print("ALL RAN")
"""


def test_operators_run_where_the_package_is_absent(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RAN" in run.stdout, run.stderr[-3000:]
