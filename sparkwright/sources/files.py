"""Small control files in any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Hadoop's file system API, for pointers and listings (never for table data)."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength())

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """A file that is not there yet: written beside and renamed, so that readers see
        none or all of it. Fails if another writer was first."""
        aside = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(path) or not self._fs.rename(aside, self._path(path)):
            self._fs.delete(aside, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
