"""Versions of derived data: each is a folder that is written aside and published by a pointer, so that readers see one version
or the next, and a failure on the way leaves the old one.  Works on any file system that Spark writes to."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's default for spark.checkpoint.dir: reported by the session even where nobody set it.
_UNSET = {None, "", "/tmp/checkpoints"}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir; on one machine, where that is unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base in _UNSET:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/larkspur-work"
    return f"{base.rstrip('/')}/larkspur-{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in a scratch folder: its lineage ends there, and lost executors cost one stage."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """The few file operations that a commit needs, by Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        """A path below the folder; without names the folder itself."""
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def names(self, *below: str) -> list[str]:
        p = self._path(*below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, *names: str) -> bool:
        return self._fs.exists(self._path(*names))

    def delete(self, *names: str) -> None:
        self._fs.delete(self._path(*names), True)

    def write(self, text: str, *names: str) -> None:
        """A new file; an error if it exists."""
        out = self._fs.create(self._path(*names), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, *names: str) -> str:
        at = self._fs.open(self._path(*names))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()


class Snapshots:
    """<root>/versions/<name> are versions, <root>/published/<number> the pointers: the highest whole one counts.

    A pointer is made by creating its file, which fails if it exists, so that of two writers one publishes.  A pointer that was
    cut off on the way doesn't end in its line feed and is passed over."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._at = Folder(spark, self.root)

    def _pointers(self) -> list[str]:
        return [n for n in self._at.names("published") if n.isdigit()]

    def current(self) -> str | None:
        """The folder of the published version."""
        for n in reversed(self._pointers()):
            name = self._at.read("published", n)
            if name.endswith("\n") and self._at.exists("versions", name.strip()):
                return f"{self.root}/versions/{name.strip()}"
        return None

    def build(self, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> str:
        """Let *write* fill a new folder, *check* verify it, and publish it.  If either fails the folder is removed, and what was
        published before stays."""
        name = f"v{uuid.uuid4().hex}"
        path = f"{self.root}/versions/{name}"
        before = self._pointers()
        try:
            write(path)
            if check:
                check(path)
            self._at.write(f"{name}\n", "published", f"{(int(before[-1]) if before else 0) + 1:012d}")
        except Exception:
            self._at.delete("versions", name)
            raise
        return path

    def rollback(self) -> str | None:
        """Publish the version before again, if it is still there: its pointer becomes the newest."""
        now = self.current()
        for n in reversed(self._pointers()):
            name = self._at.read("published", n)
            if name.endswith("\n") and f"{self.root}/versions/{name.strip()}" != now and self._at.exists("versions", name.strip()):
                self._at.write(name, "published", f"{int(self._pointers()[-1]) + 1:012d}")
                return self.current()
        return None

    def prune(self) -> list[str]:
        """Remove all versions but the published one, and older pointers; the names of what went."""
        now = self.current()
        if now is None:
            return []
        gone = [n for n in self._at.names("versions") if not now.endswith(f"/{n}")]
        for n in gone:
            self._at.delete("versions", n)
        for n in self._pointers()[:-1]:
            self._at.delete("published", n)
        return gone
