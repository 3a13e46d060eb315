"""Sessions, and shipping this package to executors that don't have it on their path."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one that is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("inkframe")
    for key, value in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application and content."""
    files = sorted(_HERE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    name = f"inkframe-{digest}.zip"
    if any(name in str(path) for path in spark.sparkContext._python_includes):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        for f in files:
            out.write(f, f"inkframe/{f.relative_to(_HERE)}")
    path = Path(tempfile.mkdtemp(prefix="inkframe-zip-")) / name
    path.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(path))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan dealt evenly, where it has fewer partitions than the session has cores.

    Scans are cut by bytes, but a row group goes to one task whole, so a small file's rows are one task's,
    however much work they take. A larger scan is left as it is: nothing is shuffled once a table fills
    the cores. Select the columns needed first.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
