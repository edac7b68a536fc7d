"""The two-reading confirmation on a stream of readings."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.sinks import append_changes

STATE = "last_hash string, base string, held string"
READING = "seq: long, hash: string, print: string"
OUTPUT = "slug string, seq long, outcome string, old_print string, new_print string"
_COLUMNS = ["slug", "seq", "outcome", "old_print", "new_print"]

#: The state store that holds typed state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(column: pd.Series) -> list:
    """Values with None for null."""
    return column.astype(object).where(column.notna(), None).tolist()


def _in_order(reading: tuple) -> tuple:
    """By seq, null last, then by hash and print, null first."""
    seq, hashed, found = reading
    return seq is None, seq or 0, hashed is not None, hashed or "", found is not None, found or ""


def step(state: tuple, hashed: str, found: str, strict: bool) -> tuple[tuple, str, str | None]:
    """(new state, outcome, old print) of one reading.

    ``strict`` skips an unchanged page even while a change is held; by default a held
    change is not gated, so the next reading can confirm it.
    """
    last, base, held = state
    if hashed == last and (strict or held is None):
        return state, "same", None
    if base is None:
        return (hashed, found, None), "new", None
    if found == base:
        return (hashed, base, None), "noise", None
    if held != found:
        return (hashed, base, found), "hold", None
    return (hashed, found, None), "change", base


class Confirmation(StatefulProcessor):
    """The rule of :func:`step` as keyed state of a stream.

    The rows of a key come unordered and may be more than a worker holds. What does not fit is sorted a
    part at a time and kept in the state store, in chunks, until the batch's last row has come; then the parts are
    merged, a chunk of each in memory, and the rule sees the readings in order.
    """

    def __init__(self, strict: bool, held_rows: int, chunk_rows: int):
        self.strict, self.held_rows, self.chunk_rows = strict, held_rows, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE)
        self.parts = handle.getMapState("parts", "part int, chunk int", f"readings array<struct<{READING}>>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, sizes = [], []
        for frame in rows:
            held.extend(zip(*(_plain(frame[c]) for c in ("seq", "hash", "print")), strict=True))
            while len(held) >= self.held_rows:
                sizes.append(self._keep(len(sizes), held[: self.held_rows]))
                held = held[self.held_rows :]
        held.sort(key=_in_order)
        lines = [self._kept(part, chunks) for part, chunks in enumerate(sizes)]
        yield from self._run(key[0], heapq.merge(*lines, held, key=_in_order))
        if sizes:
            self.parts.clear()

    def _keep(self, part: int, readings: list[tuple]) -> int:
        readings.sort(key=_in_order)
        starts = range(0, len(readings), self.chunk_rows)
        for chunk, low in enumerate(starts):
            self.parts.updateValue((part, chunk), ([tuple(r) for r in readings[low : low + self.chunk_rows]],))
        return len(starts)

    def _kept(self, part: int, chunks: int) -> Iterator[tuple]:
        for chunk in range(chunks):
            yield from (tuple(r) for r in self.parts.getValue((part, chunk))[0])

    def _run(self, slug: str, readings: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        now = tuple(self.known.get()) if self.known.exists() else (None, None, None)
        out = []
        for seq, hashed, found in readings:
            now, outcome, old = step(now, hashed, found, self.strict)
            out.append((slug, seq, outcome, old, found if outcome == "change" else None))
            if len(out) >= self.chunk_rows:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        self.known.update(now)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)


def confirm_stream(readings: DataFrame, strict: bool = False, held_rows: int = 100_000, chunk_rows: int = 1_000) -> DataFrame:
    """Outcome of each reading of ``(slug, seq, hash, print)``; a change names both prints.

    State per slug is its last hash, confirmed print and held print, in the state store. Readings of a slug are
    taken in order of ``seq`` within a batch, ties by hash and print; batches must come in order. A worker holds ``held_rows``
    readings of a slug, and of those beyond a chunk for each time as many; the rest waits in the state store, so a slug may have any
    number of readings in a batch. The session's state store must be RocksDB, which this sets where it is not.
    """
    conf = readings.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = readings.select("slug", "seq", "hash", "print").groupBy("slug")
    return keyed.transformWithStateInPandas(Confirmation(strict, held_rows, chunk_rows), OUTPUT, "append", "none")


def reading_stream(spark: SparkSession, path: str, schema: str, most_files: int = 1_000) -> DataFrame:
    """Readings that arrive as Parquet files, at most ``most_files`` of them in a batch, so that a
    backlog is worked off in steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def route_stream(changes: DataFrame, path: str, checkpoint: str):
    """Write a stream of changes to the published log and the review queue, each batch once."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: append_changes(batch, path, number)).start()
