"""The package reaches Python workers that do not have it installed."""

import subprocess
import sys
import zipfile
from pathlib import Path

from basketry.session import ship

ROOT = Path(__file__).resolve().parent.parent


def test_archive_is_importable(spark, tmp_path):
    archive = ship(spark)
    names = set(zipfile.ZipFile(archive).namelist())
    assert {"basketry/__init__.py", "basketry/plans/features.py"} <= names
    assert not any(name.endswith(".pyc") for name in names)
    code = "import basketry.plans.reports as r; print(r.__file__)"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": archive, "PATH": ""}, capture_output=True, text=True
    )
    assert done.returncode == 0 and "basketry.zip" in done.stdout, done.stderr
