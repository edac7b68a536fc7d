"""Several tables that change together: a run's manifest, written last and read first, names their versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import listed, put_text, read_text, remove_folder


@dataclass(frozen=True)
class Manifest:
    """What the tables are after a run: for each the folders whose rows it holds."""

    number: int
    day: str
    tables: dict[str, list[str]]

    def text(self) -> str:
        return json.dumps({"number": self.number, "day": self.day, "tables": self.tables})


@dataclass(frozen=True)
class RunStore:
    """Tables below a folder, as the newest manifest says; what no manifest names does not exist.

    Manifests are small files ``runs/<number>.json``, numbered upwards. One run writes at a time.
    """

    spark: SparkSession
    folder: str

    def manifests(self) -> list[Manifest]:
        names = [n for n in listed(self.spark, f"{self.folder}/runs") if n.endswith(".json") and n[0] not in "._"]
        return sorted((Manifest(**json.loads(read_text(self.spark, f"{self.folder}/runs/{n}"))) for n in names), key=lambda m: m.number)

    def current(self, before: str | None = None) -> Manifest | None:
        """The newest run; with ``before`` the newest of an earlier day."""
        known = [m for m in self.manifests() if before is None or m.day < before]
        return max(known, key=lambda m: (m.day, m.number), default=None)

    def read(self, name: str, schema: str, manifest: Manifest | None = None) -> DataFrame:
        """A table as of a run, by default the newest; without rows where no run wrote it."""
        manifest = manifest or self.current()
        parts = manifest.tables.get(name, []) if manifest else []
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts))

    def begin(self, day: str) -> Run:
        """A run of ``day`` on top of what the newest run of an earlier day left. A day that is run
        again takes the place of what it was before."""
        return Run(self, day, self.current(day))

    def sweep(self, keep: int = 2) -> list[str]:
        """Remove all but the last runs of the newest ``keep`` days: other manifests, then folders that no
        manifest names any more, such as those of runs that broke off. Returns the folders that went."""
        known = self.manifests()
        newest = sorted(known, key=lambda m: (m.day, m.number))
        last = {m.day: m for m in newest}  # of a day that was run again the last run
        kept = list(last.values())[-keep:]
        for m in known:
            if m not in kept:
                remove_folder(self.spark, f"{self.folder}/runs/{m.number:08d}.json")
        named = {p for m in kept for parts in m.tables.values() for p in parts}
        gone = []
        for table in listed(self.spark, f"{self.folder}/tables"):
            for part in listed(self.spark, f"{self.folder}/tables/{table}"):
                if f"tables/{table}/{part}" not in named:
                    remove_folder(self.spark, f"{self.folder}/tables/{table}/{part}")
                    gone.append(f"{table}/{part}")
        return gone


@dataclass
class Run:
    """One run's writes. Nothing of it can be read before :meth:`commit`, everything after it."""

    store: RunStore
    day: str
    base: Manifest | None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    written: dict[str, list[str]] = field(default_factory=dict)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table as the run found it."""
        return self.store.read(name, schema, self.base) if self.base else self.store.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"tables/{name}/{self.day}-{self.name}"
        rows.write.parquet(f"{self.store.folder}/{part}")
        return part

    def put(self, name: str, rows: DataFrame) -> None:
        """``rows`` in place of the table."""
        self.written[name] = [self._write(name, rows)]

    def append(self, name: str, rows: DataFrame) -> None:
        """``rows`` on top of the table's."""
        self.written[name] = [*(self.base.tables.get(name, []) if self.base else []), self._write(name, rows)]

    def commit(self) -> Manifest:
        number = max((m.number for m in self.store.manifests()), default=0) + 1
        manifest = Manifest(number, self.day, {**(self.base.tables if self.base else {}), **self.written})
        put_text(self.store.spark, f"{self.store.folder}/runs/{number:08d}.json", manifest.text())
        return manifest
