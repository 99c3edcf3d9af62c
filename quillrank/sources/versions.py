"""Several tables published as one version: staged, then swapped by one small file.

A version's tables are written to a folder of its own. Only when all are written and
counted is its manifest put in place, by a rename within one folder, which the shared
file system does wholly or not at all. So a run that dies half way leaves the version
before it in force, and its folder is rubbish that the next publish sweeps up. A reader
looks at the manifest once and stays with that version's folders, whatever is published
meanwhile; ``keep`` versions are left for such readers. Writers publish one after the
other: of two at a time, the one whose number is taken raises and may try again.

Tables may be empty; a version without tables raises ValueError.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

KEEP = 2
_MANIFEST = re.compile(r"manifest-(\d+)\.json")


@dataclass(frozen=True)
class Version:
    """A published version: where its tables are, how many rows each has, and what was said of it."""

    number: int
    folder: str
    rows: dict[str, int]
    note: dict

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.rows:
            raise KeyError(name)
        return spark.read.parquet(f"{self.folder}/{name}")


class _Files:
    """The few operations on the shared file system that a publish needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def place(self, name: str, text: str) -> bool:
        """Write aside, then rename; False if the name is taken."""
        aside = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(aside), self._path(name)):
            self.remove(aside)
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _numbers(files: _Files) -> list[int]:
    return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, files.names()) if m)


def current(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The version in force, or one that is still kept by its number; None if there is none."""
    files = _Files(spark, root)
    numbers = _numbers(files)
    if not numbers or (number is not None and number not in numbers):
        return None
    said = json.loads(files.read(f"manifest-{number or numbers[-1]}.json"))
    return Version(said["version"], f"{files.root}/{said['folder']}", said["rows"], said["note"])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], note: dict | None = None, keep: int = KEEP) -> Version:
    """Write ``tables`` as the next version and put it in force. They may read the version before."""
    if not tables:
        raise ValueError("a version needs a table")
    files = _Files(spark, root)
    before = _numbers(files)
    number = before[-1] + 1 if before else 1
    folder, rows = f"v{number}-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.parquet(f"{files.root}/{folder}/{name}")
        rows[name] = spark.read.parquet(f"{files.root}/{folder}/{name}").count()
    said = {"version": number, "folder": folder, "rows": rows, "note": note or {}}
    if not files.place(f"manifest-{number}.json", json.dumps(said, sort_keys=True)):
        files.remove(folder)
        raise RuntimeError(f"version {number} was published meanwhile")
    _sweep(files, keep)
    return Version(number, f"{files.root}/{folder}", rows, said["note"])


def _sweep(files: _Files, keep: int) -> None:
    """Remove versions beyond the last ``keep``, and what dead runs left behind."""
    numbers = _numbers(files)
    kept = numbers[-keep:]
    folders = {json.loads(files.read(f"manifest-{n}.json"))["folder"] for n in kept}
    for n in numbers[:-keep]:
        files.remove(f"manifest-{n}.json")
    for name in files.names():
        m = re.fullmatch(r"v(\d+)-[0-9a-f]{32}", name)
        # A folder of a later number belongs to a publish that is under way.
        if m and name not in folders and int(m[1]) <= kept[-1]:
            files.remove(name)
