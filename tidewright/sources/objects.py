"""Raw files as objects: four buckets below a root, on whatever file system Spark uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import list_files

#: Buckets of the store. (fixed values)
BUCKETS = ("raw", "enriched", "reports", "audit")


class ObjectStore:
    """``root/bucket/key``; a bucket that isn't one of the four is an error."""

    def __init__(self, spark: SparkSession, root: str, buckets: tuple[str, ...] = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, bucket: str, key: str = ""):
        if bucket not in self.buckets:
            raise ValueError(f"no bucket {bucket!r}")
        if ".." in key.split("/"):
            raise ValueError(f"bad key {key!r}")
        return self._path(f"{self.root}/{bucket}/{key}".rstrip("/"))

    def ensure(self) -> None:
        for b in self.buckets:
            self._fs.mkdirs(self._at(b))

    def put(self, bucket: str, key: str, content: bytes) -> str:
        p = self._at(bucket, key)
        s = self._fs.create(p, True)
        try:
            s.write(bytearray(content))
        finally:
            s.close()
        return p.toString()

    def get(self, bucket: str, key: str) -> bytes:
        s = self._fs.open(self._at(bucket, key))
        try:
            return bytes(self._io.toByteArray(s))
        finally:
            s.close()

    def delete(self, bucket: str, key: str) -> bool:
        return self._fs.delete(self._at(bucket, key), False)

    def buckets_there(self) -> list[str]:
        """Buckets that exist, of those that may."""
        return [b for b in self.buckets if self._fs.exists(self._at(b))]

    def drop(self, bucket: str) -> bool:
        """Remove a bucket that holds nothing; one with objects is an error."""
        p = self._at(bucket)
        if self._fs.exists(p) and len(self._fs.listStatus(p)):
            raise ValueError(f"bucket {bucket!r} isn't empty")
        return self._fs.delete(p, False)

    def list(self, bucket: str, pattern: str = "*") -> DataFrame:
        """(path, length, modificationTime) of a bucket's objects."""
        return list_files(self.spark, self._at(bucket).toString(), pattern)


def raw_key(workspace_id: str, job_id: str, file: str) -> str:
    """Key of an upload's raw copy."""
    return f"{workspace_id}/{job_id}/{file}"
