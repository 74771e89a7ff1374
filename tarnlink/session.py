"""Makes the package known to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once an application, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tarnlink-")) / "tarnlink.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, file.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir; a temporary one where that is unset, on one machine only) and
    read back, so that later steps plan over a table and lost executors cost nothing."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tarnlink-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tarnlink/linkage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
