"""Small named files of an artifact, in one folder of any Hadoop file system or in memory: whole texts by plain names, nothing outside."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import SparkSession


class Files(Protocol):
    def read(self, name: str) -> str | None: ...

    def write(self, name: str, text: str) -> None: ...

    def remove(self, name: str) -> None: ...

    def names(self) -> list[str]: ...


def plain(name: str) -> str:
    """The name, if it is one: no folders, no way up, no hidden files."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]{0,199}", name) or ".." in name:
        raise ValueError("a file has a plain name")
    return name


class MemoryFiles:
    """For tests and one-off runs."""

    def __init__(self):
        self._kept: dict[str, str] = {}

    def read(self, name: str) -> str | None:
        return self._kept.get(plain(name))

    def write(self, name: str, text: str) -> None:
        self._kept[plain(name)] = text

    def remove(self, name: str) -> None:
        self._kept.pop(plain(name), None)

    def names(self) -> list[str]:
        return sorted(self._kept)


class FolderFiles:
    """Files below a folder; a file is written under another name first, so that it is there whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._io, self._path, self.folder = jvm.org.apache.commons.io.IOUtils, jvm.org.apache.hadoop.fs.Path, folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{plain(name)}")

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        at, tmp = self._at(name), self._path(f"{self.folder}/_{plain(name)}.new")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8", "surrogatepass")))
        out.close()
        self._fs.delete(at, False)
        self._fs.rename(tmp, at)

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), False)

    def names(self) -> list[str]:
        at = self._path(self.folder)
        found = [f.getPath().getName() for f in self._fs.listStatus(at) if f.isFile()] if self._fs.exists(at) else []
        return sorted(n for n in found if not n.startswith(("_", ".")))
