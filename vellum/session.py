"""What an application needs once: the package on the executors, and a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds the package's source as a file of the application, once for each SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    root = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum_source.zip"
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(name.resolve()))
    context._vellum_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, as an address with its file system, so that Spark and Arrow mean the same one.

    Where that is unset and everything runs on one machine, a temporary folder, the same one for the whole application.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = context._vellum_folder = getattr(context, "_vellum_folder", None) or f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^(\w[\w+.-]*):/(?!/)", r"\1:///", whole).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written to the shared folder: for what is read more than once. Lineage ends here."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
