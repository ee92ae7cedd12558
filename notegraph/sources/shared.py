"""Small files in a folder that the whole cluster reaches, on any file system that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """Files are put whole: written beside their place and renamed into it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self._path(name)
        if not self._files.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(at))

    def read(self, name: str) -> str | None:
        at = self._path(name)
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str, replace: bool = True) -> bool:
        """Whether it was put: without ``replace`` a file that is there stays, whoever put it. The rename decides,
        which is atomic where the file system's is."""
        fs = self._jvm.org.apache.hadoop.fs
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self._files.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(how.NONE.getClass(), 1)
        options[0] = how.OVERWRITE if replace else how.NONE
        at = self._path(name)
        try:
            fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(part, at, options)
        except Exception:
            self._files.delete(part, False)
            if replace or not self._files.exists(at):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)
