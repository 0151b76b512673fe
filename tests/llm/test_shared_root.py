"""Where scratch tables lie, in applications of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[2]
RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from vellum.llm import rans, simhash
from vellum.llm.common import Scratch
from vellum.session import shared_root
from vellum.llm.tokens import tokenizer_path
root = shared_root(spark)
assert root.startswith("file:///") and root == shared_root(spark) == shared_root(spark.newSession()), root
assert len(sys.argv) < 2 or root == f"file://{sys.argv[1]}", root
docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
folder = Scratch(spark, "rans").path("archive")
rans.write_archive(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
assert rans.read_archive(spark, folder).count() == 3
print("whole")
"""


@pytest.mark.parametrize("named", [False, True])
def test_folder(tmp_path, named):
    """Without spark.checkpoint.dir, and with one that has no scheme."""
    conf = tmp_path / "conf"
    conf.mkdir()
    (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {tmp_path}/shared\n" if named else "")
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", RUN, *([f"{tmp_path}/shared"] if named else [])], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.endswith("whole\n"), done.stderr[-2000:]
