"""Small files and folders on whatever file system a path names, through the file system layer of the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """Paths are texts with or without a scheme; parts of a path are joined by ``/``."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, old: str, new: str, over: bool = False) -> bool:
        """Rename in one step; False where ``new`` is there already, unless it is to be replaced."""
        if not over:
            return not self.exists(new) and self.fs.rename(self._path(old), self._path(new))
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.conf).rename(self._path(old), self._path(new), options)
        return True
