"""Session settings that the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: The temporary folder of a session on one machine that has no shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Without that setting a session on one machine gets a temporary folder, the same for all
    calls; on a cluster, whose machines would not see it, the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("folder")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL["folder"] = tempfile.mkdtemp(prefix="spark-")
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder (see :func:`shared_folder`) and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to a folder and read again.

    Unlike a checkpoint it forgets the sizes that were estimated for ``df``: a loop that joins
    what it stored would multiply them each time, until planning takes longer than running.
    """
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of whatever store holds it, in order; none where it is missing."""
    path, files = _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    place, files = _path(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file, moved to its name when it is whole, so that nobody reads half of it."""
    place, files = _path(spark, path)
    if files.exists(place):
        if not replace:
            raise FileExistsError(path)
        files.delete(place, False)
    new = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(new, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not files.rename(new, place):
        raise OSError(f"{path} could not be put in place")
