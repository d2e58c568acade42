"""The folder that driver and executors share, and tables and files kept in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str, str]] = []
_owner = [""]
#: Hadoop's scheme to pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss", "wasb": "abfs"}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a URI; without a scheme it is a folder of Hadoop's default file system. Where the
    setting is unset, a local session gets a temporary one; a cluster is an error."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        _made.append((spark.sparkContext, root, ""))
    return root.rstrip("/") if "://" in root else qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI, by Hadoop's default file system if it has no scheme."""
    where, fs = _hadoop(spark.sparkContext, path)
    uri = fs.makeQualified(where).toString().rstrip("/")
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder name; it is removed when the driver ends, or its owner frees it."""
    path = f"{shared_root(spark)}/quarryline/{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext, path, _owner[0]))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Folders named within belong to an owner, who can free them."""
    before, _owner[0] = _owner[0], owner
    try:
        yield
    finally:
        _owner[0] = before


def free(spark: SparkSession, owner: str) -> None:
    """Removes an owner's folders. What was read from them must have been written."""
    for x in [x for x in _made if x[2] == owner and x[0] is spark.sparkContext]:
        _made.remove(x)
        remove(spark, x[1])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    where, fs = _hadoop(spark.sparkContext, path)
    fs.delete(where, True)


def _hadoop(sc, path: str):
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def _clean() -> None:
    for sc, path, _ in _made:
        try:
            where, fs = _hadoop(sc, path)
            fs.delete(where, True)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)


def store_uri(uri: str) -> str:
    """A URI of Hadoop's as pyarrow writes it: s3a://b/k is s3://b/k, file:/x is file:///x."""
    scheme, found, rest = uri.partition(":")
    if not found:
        return uri
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(uri: str):
    """(file system, path) for a URI of the shared folder; any store pyarrow knows, by Hadoop's name for it too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_uri(uri))
