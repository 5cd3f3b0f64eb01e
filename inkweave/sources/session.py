"""Sessions, and the library's own code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from inkweave.sources.shared import own_dir

_shipped: set[str] = set()


def session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC, Arrow, and a checkpoint folder of its own where none is named; on a cluster name one that all executors reach."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("inkweave")
    base = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "spark.checkpoint.dir" not in conf:
        base["spark.checkpoint.dir"] = own_dir()
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():  # not when imported from an archive, which has been sent already
        tmp = tempfile.mkdtemp(prefix="inkweave-code-")  # on the driver, which serves the archive
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        stage = Path(tmp) / "stage"
        shutil.copytree(root / "inkweave", stage / "inkweave", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tmp, "inkweave"), "zip", stage))
    _shipped.add(app)
