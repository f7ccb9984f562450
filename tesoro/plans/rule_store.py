"""Versions of the two rule tables, switched as one (T5): what a publish changes is seen
whole or not at all, and of two publishes made from one version one wins.

A version is a folder ``version=N`` with both tables. It is written aside and then renamed
to the number after the one it was made from. A rename onto a version that is there fails,
which makes it the compare-and-swap. The store must rename folders atomically (HDFS, a
mounted file system); plain object stores don't.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tesoro import schemas
from tesoro.operators import tax

TABLES = {"rule_sets": schemas.TAX_RULESET, "rules": schemas.TAX_RULE}


class VersionConflict(RuntimeError):
    """Another version was stored since the one that this change was made from."""


class RuleStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, version: int) -> str:
        return f"{self.base}/version={version:08d}"

    def version(self) -> int:
        """The latest version; 0 before the first."""
        where, fs = self._hadoop(self.base)
        if not fs.exists(where):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)

    def load(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """``(rule_sets, rules)`` of a version, by default the latest; empty before the first."""
        version = self.version() if version is None else version
        if not version:
            return tax.empty_rule_tables(self.spark)
        return tuple(self.spark.read.schema(schema).parquet(f"{self._folder(version)}/{name}")
                     for name, schema in TABLES.items())

    def swap(self, seen: int, rule_sets: DataFrame, rules: DataFrame) -> int:
        """Store both tables as the version after ``seen`` and return its number, or raise
        VersionConflict if there is one already; nothing of a loser stays."""
        aside = f"{self.base}/_aside-{uuid.uuid4().hex}"
        try:
            for name, table in (("rule_sets", rule_sets), ("rules", rules)):
                table.select(*TABLES[name].fieldNames()).write.parquet(f"{aside}/{name}")
            if self.version() != seen or not self._rename(aside, self._folder(seen + 1)):
                raise VersionConflict(f"made from version {seen}, the latest is {self.version()}")
        finally:
            where, fs = self._hadoop(aside)
            fs.delete(where, True)
        return seen + 1

    def _rename(self, source: str, target: str) -> bool:
        """False if ``target`` is there."""
        parts = urlparse(source)
        if parts.scheme in ("", "file"):
            try:
                os.rename(*(unquote(urlparse(p).path) for p in (source, target)))
            except OSError:
                if os.path.isdir(unquote(urlparse(target).path)):
                    return False
                raise
            return True
        jvm = self.spark._jvm
        where, _ = self._hadoop(source)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(where, jvm.org.apache.hadoop.fs.Path(target), options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def change(self, by: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> int:
        """``by(rule_sets, rules)`` of the latest version, stored as the next one."""
        seen = self.version()
        return self.swap(seen, *by(*self.load(seen)))

    def add_draft(self, spec: dict, created_at: _dt.datetime, set_id: str | None = None) -> str:
        """A draft of ``spec``; its id."""
        found = []

        def by(rule_sets, rules):
            rule_sets, rules, ids = tax.create_drafts(
                self.spark, rule_sets, rules, [(spec, created_at, set_id) if set_id else (spec, created_at)])
            found.extend(ids)
            return rule_sets, rules
        self.change(by)
        return found[0]

    def publish(self, set_id: str, published_by: str = "api_user", published_at: _dt.datetime | None = None,
                seen: int | None = None) -> int:
        """T5 T6 on the version ``seen``, by default the latest."""
        seen = self.version() if seen is None else seen
        rule_sets, rules = self.load(seen)
        return self.swap(seen, tax.publish(rule_sets, set_id, published_by, published_at), rules)
