"""Python workers find the package wherever the session was started from."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {root!r})
from antipode.session import local_session
from antipode.plans import QUERIES
spark = local_session(2, "elsewhere")
for name in ("nearest_of_all", "random_project", "spectrum"):
    assert QUERIES[name](spark, {sf!r}).count() > 0
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")
def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=SF_DIR)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
