"""Scratch data on a stock installation, whose defaults name no shared folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUN = """
from seqloom.session import local_session, scratch_path, stored
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = (stored(spark.range(n), "rows") for n in (3, 5))
assert (a.count(), b.count()) == (3, 5)
assert scratch_path(spark, "x").rsplit("/", 1)[0] == scratch_path(spark, "y").rsplit("/", 1)[0]
"""


def test_stored_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
