"""The contract's functions can be listed before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 50
