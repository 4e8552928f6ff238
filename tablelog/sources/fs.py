"""Hadoop file system access from the driver: any store that Spark reaches."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tablelog.errors import LogError

#: Stores without renames, whose objects appear whole.
_OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "obs"}


class Fs:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def of(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def qualified(self, p: str) -> str:
        """Absolute URI of a path, without a trailing slash."""
        try:
            path = self.path(p)
            return path.getFileSystem(self.conf).makeQualified(path).toString().rstrip("/")
        except Py4JJavaError as e:
            raise LogError("ObjectStoreError", f"Error interacting with object store: {_cause(e)}") from None

    def exists(self, p: str) -> bool:
        return self.of(p).exists(self.path(p))

    def names(self, folder: str) -> list[tuple[str, int, int]]:
        """(name, size, milliseconds of last change) of the files in a folder, sorted."""
        try:
            found = self.of(folder).listStatus(self.path(folder))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception.getClass()):
                return []
            raise LogError("ObjectStoreError", f"Error interacting with object store: {_cause(e)}") from None
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found if s.isFile())

    def read(self, p: str) -> bytes:
        stream = self.of(p).open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, p: str, data: bytes, overwrite: bool = False) -> bool:
        """Create a file; False if it exists and may not be overwritten."""
        fs, path = self.of(p), self.path(p)
        fs.mkdirs(path.getParent())
        try:
            stream = fs.create(path, overwrite)
        except Py4JJavaError as e:
            if not overwrite and ("AlreadyExists" in str(e.java_exception) or fs.exists(path)):
                return False
            raise
        try:
            stream.write(data)
        finally:
            stream.close()
        return True

    def put_if_absent(self, p: str, data: bytes) -> bool:
        """Publish a whole file under a name that no one has; False if it is taken.

        Written beside under another name first, so a crash leaves no half file of
        that name and readers never see one.  On local disks a hard link publishes
        it, elsewhere a rename, which fails on a taken name.  Object stores have neither;
        there an object appears when its stream is closed, and creation is exclusive where the store offers that.
        """
        fs, target = self.of(p), self.path(p)
        scheme = fs.getUri().getScheme()
        if scheme in _OBJECT_STORES:
            return self.write(p, data, overwrite=False)
        if fs.exists(target):
            return False
        beside = f"{p.rpartition('/')[0]}/.{p.rpartition('/')[2]}.{uuid.uuid4().hex}.tmp"
        try:
            self.write(beside, data)
            if scheme == "file":
                try:
                    os.link(plain(fs.makeQualified(self.path(beside)).toString()), plain(fs.makeQualified(target).toString()))
                except FileExistsError:
                    return False
                return True
            try:
                return bool(fs.rename(self.path(beside), target))
            except Py4JJavaError:
                if fs.exists(target):
                    return False
                raise
        finally:
            self.delete(beside)

    def rename(self, a: str, b: str) -> None:
        self.of(b).mkdirs(self.path(b).getParent())
        if not self.of(a).rename(self.path(a), self.path(b)):
            raise LogError("IOErrorError", f"cannot move {a} to {b}")

    def delete(self, p: str, recursive: bool = False) -> None:
        self.of(p).delete(self.path(p), recursive)

    def delete_if_empty(self, folder: str) -> None:
        """Another writer may be using it."""
        try:
            if not self.of(folder).listStatus(self.path(folder)):
                self.of(folder).delete(self.path(folder), False)
        except Py4JJavaError:
            pass

    def status(self, p: str) -> tuple[int, int]:
        s = self.of(p).getFileStatus(self.path(p))
        return s.getLen(), s.getModificationTime()

    def copy_dir(self, a: str, b: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.of(a), self.path(a), self.of(b), self.path(b), False, True, self.conf)


def _cause(e: Py4JJavaError) -> str:
    return str(e.java_exception.getMessage())


def join(root: str, path: str) -> str:
    """Place of a log path: percent-decoded once, below the root unless it is absolute."""
    path = unquote(path)
    if "://" in path or path.startswith(("/", "file:")):
        return path
    return f"{root}/{path}"


def plain(path: str) -> str:
    """A local path without its scheme; other URIs as they are."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return "/" + path.removeprefix(prefix).lstrip("/")
    return path


def glob_escaped(path: str) -> str:
    """A path that Spark's readers take literally."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in path)
