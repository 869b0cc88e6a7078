"""Small metadata files: on a local disk, or wherever Hadoop's file systems reach.

A name is created once, and only whole files are seen: by a hard link on a local disk, by renaming a
draft where the file system's rename never replaces, and by a conditional put on object stores. Other
file systems have nothing to build compare-and-swap on and are refused when a name is to be created.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import OrderedDict
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: File systems that rename at once and not over a file, unless told to.
RENAMING = ("hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")
#: Object stores with conditional puts: by an option of the file's builder, or whenever it is not to be overwritten.
CONDITIONAL, EXCLUSIVE = ("s3a",), ("gs",)


class Files:
    """Text files under a base path. ``create`` succeeds once for a name: what compare-and-swap is built on."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self.local = Path(self.base.removeprefix("file://")) if "://" not in self.base or self.base.startswith("file://") else None
        self.scheme = "file" if self.local is not None else self.base.split("://")[0].lower()
        self._spark = spark

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _hadoop(self, name: str):
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def read(self, name: str) -> str | None:
        if self.local is not None:
            try:
                return (self.local / name).read_text()
            except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                return None
        fs, path, jvm = self._hadoop(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace; on a local disk at once."""
        if self.local is not None:
            target = self.local / name
            target.parent.mkdir(parents=True, exist_ok=True)
            draft = target.with_name(f".{target.name}.{os.getpid()}")
            draft.write_text(text)
            os.replace(draft, target)
            return
        if self.scheme in RENAMING:
            self._rename(name, text, replace=True)
            return
        fs, path, _ = self._hadoop(name)
        self._put(fs.create(path, True), text)

    @staticmethod
    def _put(stream, text: str) -> None:
        stream.write(bytearray(text.encode()))
        stream.close()

    def _rename(self, name: str, text: str, *, replace: bool) -> None:
        """Write a draft beside the file and rename it; without ``replace`` this fails where the file exists."""
        fs, path, jvm = self._hadoop(name)
        draft = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
        options = jvm.org.apache.hadoop.fs.Options.Rename
        how = self._spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE if replace else options.NONE
        self._put(fs.create(draft, False), text)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, path, how)
        finally:
            fs.delete(draft, False)

    def create(self, name: str, text: str) -> bool:
        """Write unless it exists; whether this call wrote it."""
        if self.local is not None:
            target = self.local / name
            target.parent.mkdir(parents=True, exist_ok=True)
            draft = target.with_name(f".{target.name}.{os.getpid()}.new")
            draft.write_text(text)
            try:
                os.link(draft, target)  # fails if the name is taken, and shows only whole files
                return True
            except FileExistsError:
                return False
            finally:
                draft.unlink()
        fs, path, _ = self._hadoop(name)
        if self.scheme not in (*RENAMING, *CONDITIONAL, *EXCLUSIVE):
            raise NotImplementedError(f"{self.scheme} has no exclusive creation that refs can be built on")
        if fs.exists(path):
            return False
        try:
            if self.scheme in RENAMING:
                self._rename(name, text, replace=False)
            elif self.scheme in CONDITIONAL:
                self._put(fs.createFile(path).must("fs.option.create.conditional.overwrite", True).recursive().build(), text)
            else:
                self._put(fs.create(path, False), text)
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        return True

    def list(self, name: str) -> list[str]:
        """Names inside a folder, sorted; empty if there is none."""
        if self.local is not None:
            top = self.local / name
            return sorted(p.name for p in top.iterdir() if not p.name.startswith(".")) if top.is_dir() else []
        fs, path, _ = self._hadoop(name)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if not n.startswith("."))

    def exists(self, name: str) -> bool:
        if self.local is not None:
            return (self.local / name).exists()
        fs, path, _ = self._hadoop(name)
        return fs.exists(path)

    def delete(self, name: str) -> bool:
        """Delete a file or folder; whether there was one."""
        if not self.exists(name):
            return False
        if self.local is not None:
            target = self.local / name
            shutil.rmtree(target) if target.is_dir() else target.unlink()
            return True
        fs, path, _ = self._hadoop(name)
        return fs.delete(path, True)


class CachedFiles(Files):
    """Remembers the last ``most`` commits it read: these never change, while refs and HEAD are always read anew."""

    def __init__(self, spark: SparkSession, base: str, most: int = 10_000):
        super().__init__(spark, base)
        self._most, self._held = most, OrderedDict()

    def read(self, name: str) -> str | None:
        if not name.startswith("commits/"):
            return super().read(name)
        text = self._held.pop(name, None) or super().read(name)
        if text is not None:
            self._held[name] = text
            if len(self._held) > self._most:
                self._held.popitem(last=False)
        return text

    def delete(self, name: str) -> bool:
        for held in [k for k in self._held if k == name or k.startswith(name.rstrip("/") + "/")]:
            del self._held[held]
        return super().delete(name)
