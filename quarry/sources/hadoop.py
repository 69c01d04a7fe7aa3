"""Files on any path that Spark reads, by Hadoop's file systems: lists, small texts, and texts that come to be at once or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if self._fs.getScheme() == "file":
            self._fs = self._fs.getRawFileSystem()  # no checksum files beside what others may edit

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What a folder in it holds, sorted; nothing where there is none."""
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> bool:
        """Writes a text beside its place and renames it there. False, and nothing changed, if there is one already (unless it may
        be replaced): of two writers one wins."""
        other, at = self._at(f"{name}.{uuid.uuid4().hex}.tmp"), self._at(name)
        self._fs.mkdirs(at.getParent())
        stream = self._fs.create(other, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            self._moved(other, at, replace)
            return True
        except Exception as e:
            self._fs.delete(other, False)
            if "FileAlreadyExists" in str(e) or (not replace and self._fs.exists(at)):
                return False
            raise

    def lines(self, name: str) -> Iterator[str]:
        """The lines of a text file, one by one."""
        io = self._jvm.java.io
        reader = io.BufferedReader(io.InputStreamReader(self._fs.open(self._at(name)), "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                yield line
        finally:
            reader.close()

    def joined(self, name: str, pieces: list, source: Folder) -> None:
        """One file of texts and of files of another folder (name, bytes to skip), copied in order as streams."""
        other, at = self._at(f".{name}.{uuid.uuid4().hex}.tmp"), self._at(name)
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(other, True)
        try:
            for piece in pieces:
                if isinstance(piece, str):
                    out.write(bytearray(piece.encode("utf-8")))
                    continue
                stream = source._fs.open(source._at(piece[0]))
                try:
                    stream.seek(piece[1])
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
        self._moved(other, at, replace=True)

    def _moved(self, other, at, replace: bool) -> None:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE if replace else options.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(other, at, kinds)

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._at(name), True)

    def size(self, name: str = "") -> tuple[int, int]:
        """Files and bytes below."""
        at = self._at(name)
        if not self._fs.exists(at):
            return 0, 0
        about = self._fs.getContentSummary(at)
        return about.getFileCount(), about.getLength()
