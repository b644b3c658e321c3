"""The package reaches workers that don't have it installed."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from loglens.session import get_session
from loglens.operators import templates
spark = get_session("foreign", "local[1]", {{"spark.sql.shuffle.partitions": "1", "spark.ui.showConsoleProgress": "false"}})
lines = spark.createDataFrame([(0, "open 1"), (1, "open 2")], "line_id bigint, content string")
print("rows", templates.mine_templates(lines).count())
"""


def test_foreign_working_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
