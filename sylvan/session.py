"""Making the package importable on the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="spark-sylvan-")) / "sylvan.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
