"""Small metadata files on whatever file system the store lives on (Hadoop API)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Listing, reading and create-if-absent for manifests and run records."""

    def __init__(self, spark: SparkSession) -> None:
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._strings = spark.sparkContext._jvm.java.lang.String

    def _at(self, path: str):
        target = self._hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def children(self, path: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of each visible entry, by name."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return []
        found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]
        return sorted(item for item in found if not item[0].startswith("."))

    def size(self, path: str) -> int:
        fs, target = self._at(path)
        return int(fs.getContentSummary(target).getLength())

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return str(self._hadoop.io.IOUtils.readFullyToByteArray(stream).decode("utf-8"))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write ``text`` unless ``path`` exists; False when another writer was first.

        The content is complete before the name appears: it is written aside and
        renamed. HDFS refuses to rename onto an existing name; on a store whose rename
        replaces, one writer per table is required.
        """
        fs, target = self._at(path)
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            return False
        aside = self._hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not fs.exists(target) and fs.rename(aside, target):
            return True
        fs.delete(aside, False)
        return False

    def put(self, path: str, text: str) -> None:
        """Write or replace a file."""
        fs, target = self._at(path)
        fs.mkdirs(target.getParent())
        stream = fs.create(target, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def remove(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.delete(target, True)
