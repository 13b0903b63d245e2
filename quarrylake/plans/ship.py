"""Give executors the package where they cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package as a zip to all executors, once per application.

    Not needed where Python workers inherit a path that holds it: those of a
    local session whose PYTHONPATH or working folder is the package's root.
    """
    context = spark.sparkContext
    if getattr(context, "_quarrylake_shipped", False):
        return
    context._quarrylake_shipped = True
    inherited = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local[") or context.master == "local":
        inherited.add(os.path.realpath(os.getcwd()))
    if context.master.startswith("local") and str(ROOT) in inherited:
        return
    path = Path(tempfile.mkdtemp(prefix="quarrylake-package-")) / "quarrylake.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted((ROOT / "quarrylake").rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
