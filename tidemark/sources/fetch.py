"""Fetching pages politely: a data source whose partitions are queues of hosts, each page asked for once."""

from __future__ import annotations

import heapq
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import host_of
from tidemark.session import shared_folder

#: Seconds between requests to a host, most seconds that a host may ask to wait, retries.
CRAWL_DELAY, MOST_WAIT, RETRIES = 3.0, 120.0, 2

#: Takes a url; gives (status, html or None, Retry-After header or None). Status 0 is a transport error.
Fetcher = Callable[[str], tuple[int, str | None, str | None]]

SCHEMA = "url string, status int, html string, error string"
_ARROW = pa.schema([("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string())])
_FORBIDDEN = "forbidden by robots.txt"


def wait_seconds(header: str | None, attempt: int, now: float) -> float:
    """Seconds that a Retry-After header asks for, as a number or a date, within bounds."""
    if header is None:
        return min(MOST_WAIT, 2.0 ** (attempt + 3))
    try:
        asked = float(header)
    except ValueError:
        try:
            asked = parsedate_to_datetime(header).timestamp() - now
        except ValueError:
            asked = 2.0 ** (attempt + 3)
    return min(MOST_WAIT, max(0.0, asked))


def web_fetcher(agent: str = "tidemark", timeout: float = 20.0) -> Fetcher:
    """A fetcher over the network. Answers are read as UTF-8, or as their header says."""

    def get(url: str) -> tuple[int, str | None, str | None]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except HTTPError as refused:
            return refused.code, None, refused.headers.get("Retry-After")

    return get


def ask(url: str, fetcher: Fetcher) -> tuple[int, str | None, str | None, str | None]:
    """(status, html, Retry-After, error) of one request."""
    try:
        status, html, header = fetcher(url)
    except OSError as caught:
        return 0, None, None, str(caught)
    return status, html if status == 200 else None, header, None if status in (0, 200) else f"status {status}"


def pause_after(status: int, header: str | None, attempt: int, retries: int) -> float | None:
    """Seconds until a page is asked for again, or null where its answer is final."""
    if attempt >= retries or status not in (0, 429, 503):
        return None
    return 2.0**attempt if status == 0 else wait_seconds(header, attempt, time.time())


def fetch_one(url: str, fetcher: Fetcher, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str | None, str | None]:
    """(status, html, error) after retries of transport errors and of hosts that are busy."""
    attempt = 0
    while True:
        status, html, header, error = ask(url, fetcher)
        pause = pause_after(status, header, attempt, RETRIES)
        if pause is None:
            return status, html, error
        sleep(pause)
        attempt += 1


def take_turns(
    pages: dict[str, list[str]], fetcher: Fetcher, delay: float, workers: int, retries: int, clock: Callable[[], float] = time.monotonic
) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(url, status, html, error) of the pages of several hosts, as answers come.

    Each host has a time from which it may be asked again, and the earliest host is asked next,
    so one that is spaced, busy or slow holds up no other. A host has one request open at a time, all
    together ``workers``. A page that is to be retried stays at the head of its host's line.
    """
    lines = {host: deque((url, 0) for url in urls) for host, urls in pages.items() if urls}
    ready = [(clock(), host) for host in lines]
    heapq.heapify(ready)
    with ThreadPoolExecutor(workers) as pool:
        asked = {}
        while ready or asked:
            while ready and len(asked) < workers and ready[0][0] <= clock():
                host = heapq.heappop(ready)[1]
                asked[pool.submit(ask, lines[host][0][0], fetcher)] = host
            until = ready[0][0] - clock() if ready and len(asked) < workers else None
            if not asked:
                time.sleep(max(0.0, until))
                continue
            for answer in wait(asked, until, FIRST_COMPLETED).done:
                host = asked.pop(answer)
                url, attempt = lines[host].popleft()
                status, html, header, error = answer.result()
                pause = pause_after(status, header, attempt, retries)
                if pause is not None:
                    lines[host].appendleft((url, attempt + 1))
                if lines[host]:
                    heapq.heappush(ready, (clock() + max(delay, pause or 0.0), host))
                if pause is None:
                    yield url, status, html, error


@dataclass
class HostQueue(InputPartition):
    """A file of urls, all of a host in one file."""

    name: str


@dataclass
class PageReader(DataSourceReader):
    """Reads queues of a store: what is fetched already from there, the rest from the hosts.

    A page is written to the queue's journal before the next of its host is asked for, so a task
    that starts again, or another action, asks only for what no task has brought home. A finished queue
    is one file, and its journal goes. Two tasks at one queue at the same time would both ask, so
    speculative execution must be off, as it is unless set. A page that was on its way when its task
    died is asked for again.
    """

    store: str
    fetcher: Fetcher
    delay: float
    workers: int
    retries: int

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.store)

    @staticmethod
    def _listed(files: pafs.FileSystem, folder: str) -> list[str]:
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def partitions(self) -> list[HostQueue]:
        files, root = self._files()
        return [HostQueue(p.rsplit("/", 1)[1]) for p in self._listed(files, f"{root}/queues")]

    def read(self, partition: HostQueue | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, root = self._files()
        done = f"{root}/fetched/{partition.name}"
        if files.get_file_info(done).type == pafs.FileType.NotFound:
            self._fetch(files, f"{root}/queues/{partition.name}", f"{root}/journal/{partition.name}", done)
        with files.open_input_file(done) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=64)

    def _fetch(self, files: pafs.FileSystem, queue: str, journal: str, done: str) -> None:
        files.create_dir(journal, recursive=True)
        known = set()
        for path in self._listed(files, journal):
            known.update(pq.read_table(path, columns=["url"], filesystem=files)["url"].to_pylist())
        lines: dict[str, list[str]] = {}
        for row in pq.read_table(queue, filesystem=files).to_pylist():
            if row["url"] in known:
                continue
            if row["allowed"]:
                lines.setdefault(row["host"], []).append(row["url"])
            else:
                self._write(files, f"{journal}/{uuid.uuid4().hex}.parquet", [(row["url"], None, None, _FORBIDDEN)])
        for page in take_turns(lines, self.fetcher, self.delay, self.workers, self.retries):
            self._write(files, f"{journal}/{uuid.uuid4().hex}.parquet", [page])
        # One file of the queue, moved into place when it is whole.
        files.create_dir(done.rsplit("/", 1)[0], recursive=True)
        new = done.replace("/fetched/", f"/fetched/.{uuid.uuid4().hex}-")
        with files.open_output_stream(new) as out, pq.ParquetWriter(out, _ARROW) as writer:
            for path in self._listed(files, journal):
                writer.write_table(pq.read_table(path, filesystem=files, schema=_ARROW))
        files.move(new, done)
        files.delete_dir(journal)

    def _write(self, files: pafs.FileSystem, path: str, rows: list[tuple]) -> None:
        folder, name = path.rsplit("/", 1)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        with files.open_output_stream(f"{folder}/.{name}") as out:
            pq.write_table(pa.table(columns, schema=_ARROW), out)
        files.move(f"{folder}/.{name}", path)


def page_source(reader: PageReader) -> type[DataSource]:
    """The data source ``tidemark_pages`` over one store."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return reader

    return Pages


def deal_queues(urls: DataFrame, folder: str, queues: int) -> None:
    """Write ``urls(url, allowed)`` once each, as files that hold all urls of their hosts.

    Null urls go; a url is forbidden where any of its rows is.
    """
    once = urls.where("url IS NOT NULL").groupBy("url").agg(F.min(F.coalesce("allowed", F.lit(True))).alias("allowed"))
    hosted = once.select("url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "allowed")
    hosted.repartition(queues, "host").sortWithinPartitions("host", "url").write.mode("overwrite").parquet(folder)


def fetch_pages(
    urls: DataFrame, fetcher: Fetcher, delay: float = CRAWL_DELAY, store: str | None = None, queues: int | None = None, workers: int = 8, retries: int = RETRIES
) -> DataFrame:
    """(url, status, html, error) of each url of ``urls(url, allowed)``, asked for once whatever reads it.

    Urls that robots rules forbid are not asked for and have no status; null urls give no row. Urls are
    dealt by host into ``queues`` files in ``store``, a folder that all executors share (one of its own where none is
    given); requests to a host are ``delay`` seconds apart, and hosts of a queue take turns. The first action
    fetches, later ones read what the store holds, and so does a run that is given the store of an earlier one, which
    goes on where that one broke off. Urls reach tasks by files: the driver lists the queues alone.
    """
    spark = urls.sparkSession
    store = store or f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    files, root = pafs.FileSystem.from_uri(store)
    if files.get_file_info(f"{root}/queues/_SUCCESS").type == pafs.FileType.NotFound:
        deal_queues(urls, f"{store}/queues", queues or int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.dataSource.register(page_source(PageReader(store, fetcher, delay, workers, retries)))
    return spark.read.format("tidemark_pages").load()
