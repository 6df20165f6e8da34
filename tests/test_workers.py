"""The package reaches the Python workers of a session that runs somewhere else."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from auditmill.session import build_session
from auditmill.operators import knn
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2")
df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0]), (4, None), (5, [None, 1.0])], "id long, vector array<double>")
rows = knn.knn_join(df, df, 1, exclude_self=True).collect()
print("FOUND", sorted((r.query_id, r.neighbor_id) for r in rows))
"""


def test_neighbour_join_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [(1, 2), (2, 1), (3, 2)]" in done.stdout, done.stderr[-2000:]
