"""Small files through Hadoop's file systems, from the driver: the same for local, HDFS and object store paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._spark, self._jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark._jsc.hadoopConfiguration()), p

    def absolute(self, path: str) -> str:
        """The path with its scheme, without a slash at the end."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toString().rstrip("/")

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isFile())

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
