"""Small files on whatever storage Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    """Paths may have a scheme; without one they lie on the cluster's default file system."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()

    def _at(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        raw = jvm.org.apache.hadoop.fs.Path(path)
        fs = raw.getFileSystem(conf)
        return fs, fs.makeQualified(raw)

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def read_text(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Replace a file at once: it is written beside the old one and renamed over it."""
        fs, at = self._at(path)
        fs.mkdirs(at.getParent())
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(beside, at, how)
