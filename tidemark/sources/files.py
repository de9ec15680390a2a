"""Files of any store that Spark's Hadoop layer reaches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        #: The root's path on this machine, if it is on a plain file system of it.
        self._here = self._path("").toUri().getPath() if self._fs.getUri().getScheme() == "file" else None

    def full(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.full(name))

    def local(self, name: str) -> str | None:
        """The path on this machine, if the store is a plain file system of it."""
        return self._here and (f"{self._here}/{name}" if name else self._here)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """In order, without the checksum files of Hadoop's local file system; each write asks, so local folders are listed here."""
        if (path := self.local(folder)) is not None:
            try:
                return sorted(n for n in os.listdir(path) if not (n.startswith(".") and n.endswith(".crc")))
            except FileNotFoundError:
                return []
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()

    def append_stream(self, name: str):
        """A new file's output stream; sync() it after each record."""
        return self._fs.create(self._path(name), True)

    def create(self, name: str, data: bytes) -> bool:
        """A whole new file, or False if the name is taken: of several writers one makes it.

        On this machine by a hard link, elsewhere by a rename, which HDFS and the like refuse if the name is taken.
        """
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.draft-{last}-{uuid.uuid4().hex}"
        if (path := self.local(draft)) is None:
            self.write(draft, data)
            done = not self.exists(name) and self._fs.rename(self._path(draft), self._path(name))
            if not done:
                self.delete(draft)
            return done
        with open(path, "xb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(path, self.local(name))
        except FileExistsError:
            return False
        finally:
            os.unlink(path)
        return True

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{self.full(name)} can't be moved to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()
