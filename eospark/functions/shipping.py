"""Send this package to the executors, which need it for the Python parts of a job."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Zip the package once a session and let Spark hand it out."""
    sc = spark.sparkContext
    if getattr(sc, "_eospark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="eospark-")) / "eospark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._eospark_shipped = True
