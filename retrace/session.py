"""What a session needs before the first query: the code on its executors, and settings the plans rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Fixes the time zone and hands the package to the Python workers of this application, once.

    The archive is served by the driver, as ``addPyFile`` does on any cluster; no executor looks for a
    local path. Workers that already find the package on their PYTHONPATH just find it twice.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        if str(package.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            folder = tempfile.mkdtemp(prefix="retrace-code-")
            spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/retrace", "zip", root_dir=package.parent, base_dir=package.name))
        _SHIPPED.add(app)
    return spark
