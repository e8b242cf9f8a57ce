"""Session helpers: table loading, checkpoint folder, Arrow batch bounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH_BYTES = 16 << 20
ARROW_BATCH_ROWS = 5000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one of the parquet tables below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, through Spark's own file server,
    so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    root = Path(__file__).parent
    if getattr(sc, "_tallyforge_shipped", False) or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tallyforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"tallyforge/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._tallyforge_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, bound what one Arrow batch holds, and make sure there is a
    checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session (tests) that names none gets a temporary one.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or None
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(where)
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write to a table in the shared checkpoint folder and read it back.

    Later joins then plan with the table's true size, and lost executors cost nothing.
    """
    spark = prepare(df.sparkSession)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/table-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # readers may come as long as the session lives
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
