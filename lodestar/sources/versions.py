"""Versions of a folder of tables: one small file names what belongs to a version, and making that file is the commit.

Tables are written under names of their own first; until a version names them they are of no account, so a run may end anywhere and be repeated. A version's file is created exclusively: of two runs that began at one version one commits and the other is told.
A file that was torn by a crash isn't a version, and its number isn't used again.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .tables import delete


class Conflict(RuntimeError):
    """Another run committed first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/versions"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []

    def _content(self, number: int) -> dict | None:
        rows = self.spark.read.text(f"{self.folder}/{number:08d}", wholetext=True).collect()
        try:
            return json.loads(rows[0][0]) if rows else None
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """The number and content of the newest version; -1 and nothing before the first."""
        for number in reversed(self._numbers()):
            content = self._content(number)
            if content is not None:
                return number, content
        return -1, {}

    def commit(self, base: int, content: dict) -> int:
        """The next version, if ``base`` still is the newest."""
        now, _ = self.latest()
        if now != base:
            raise Conflict(f"version {now} was committed after {base}")
        number = max(self._numbers(), default=-1) + 1
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number:08d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {number} is being committed by another run") from e
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        return number

    def clean(self, folder: str, named: set[str]) -> list[str]:
        """Deletes the tables under ``folder`` that aren't ``named``; no other run may be writing."""
        fs, _ = self._fs()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        gone = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName() not in named] if fs.exists(at) else []
        for name in gone:
            delete(self.spark, f"{self.root}/{folder}/{name}")
        return gone
