"""Numbered commits in a shared folder: the newest one names the table of what is valid.

A writer stages its files under names nobody else uses, writes a new manifest beside the
old ones and publishes it as commit n+1. Publishing never overwrites: of two writers that
read commit n, one gets n+1 and the other has to look again. Readers follow commits, so
staged or half-written files are never seen, and nothing is found by listing folders.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Small files of a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.settings = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root
        top = self._path("")
        self.system = top.getFileSystem(self.settings)
        self.local = self.system.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _local_path(self, name: str) -> str:
        return self._path(name).toUri().getPath()

    def read(self, name: str) -> str | None:
        if not self.system.exists(self._path(name)):
            return None
        stream = self.system.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces what is there."""
        if self.local:
            path = self._local_path(name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as out:
                out.write(text)
            return
        out = self.system.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, name: str, text: str) -> bool:
        """Makes the file with its whole content, or finds that it exists: then False.

        The content is written beside it and put in place in one step that refuses to
        overwrite: a hard link on a local disk, elsewhere the rename of the file system,
        which is atomic on HDFS and on stores with a hierarchical namespace.
        """
        staged = f"{os.path.dirname(name)}/.staged-{uuid.uuid4().hex}"
        self.write(staged, text)
        if self.local:
            try:
                os.link(self._local_path(staged), self._local_path(name))
            except FileExistsError:
                return False
            finally:
                os.unlink(self._local_path(staged))
            return True
        return self._rename(staged, name)

    def _rename(self, staged: str, name: str) -> bool:
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename, 1)
        options[0] = rename.getMethod("valueOf", self._classes("java.lang.String")).invoke(None, self._objects("NONE"))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.settings)
        try:
            context.rename(self._path(staged), self._path(name), options)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self.system.delete(self._path(staged), False)
            return False
        return True

    def _classes(self, name: str):
        found = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.Class"), 1)
        found[0] = self.jvm.java.lang.Class.forName(name)
        return found

    def _objects(self, value: str):
        found = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.Object"), 1)
        found[0] = value
        return found


class Commits:
    """The commits of a folder; each holds one text."""

    def __init__(self, files: Files):
        self.files = files

    @staticmethod
    def _name(number: int) -> str:
        return f"commits/{number:020d}"

    def newest(self) -> tuple[int, str | None]:
        """Number and text of the newest commit; (0, None) before the first. The hint tells
        where to look; commits after it are found one by one."""
        told = self.files.read("commits/hint") or ""
        number = int(told) if told.isdigit() else 0
        text = self.files.read(self._name(number)) if number else None
        if number and text is None:
            number = 0
        while (later := self.files.read(self._name(number + 1))) is not None:
            number, text = number + 1, later
        return number, text

    def add(self, number: int, text: str) -> bool:
        """Commit `number`, unless somebody else was first."""
        if not self.files.publish(self._name(number), text):
            return False
        self.files.write("commits/hint", str(number))
        return True
