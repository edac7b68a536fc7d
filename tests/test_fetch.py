"""Polite fetching with a made-up fetcher."""

import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources.fetch import fetch_one, fetch_pages, take_turns, wait_seconds
from tidemark.sources.registry import find_moved_pages


@pytest.mark.parametrize(
    "header, want", [("7", 7), ("999", 120), (None, 16), ("soon", 16), ("Thu, 01 Jan 1970 00:01:40 GMT", 90), ("Thu, 01 Jan 1970 00:00:01 GMT", 0)]
)
def test_retry_after(header, want):
    assert wait_seconds(header, 1, 10.0) == want


def test_retries_and_gives_up():
    slept, answers = [], iter([(503, None, "2"), (0, None, None), (200, "ok", None)])
    assert fetch_one("u", lambda u: next(answers), slept.append) == (200, "ok", None) and slept == [2.0, 2.0]
    assert fetch_one("u", lambda u: (404, None, None), slept.append) == (404, None, "status 404") and len(slept) == 2

    def broken(url):
        raise OSError("no route")

    assert fetch_one("u", broken, slept.append) == (0, None, "no route")


def test_pages_of_a_host_are_spaced(spark):
    urls = [(f"https://a.test/{i}", i != 1) for i in range(3)] + [("https://b.test/", None)]
    began = time.time()
    got = {r["url"]: r for r in fetch_pages(spark.createDataFrame(urls, "url string, allowed boolean"), lambda u: (200, u[-1], None), delay=0.4).collect()}
    assert time.time() - began >= 0.4 and len(got) == 4
    assert got["https://a.test/1"]["status"] is None and "robots" in got["https://a.test/1"]["error"]
    assert got["https://a.test/2"]["html"] == "2" and got["https://b.test/"]["status"] == 200
    assert fetch_pages(spark.createDataFrame([], "url string, allowed boolean"), lambda u: (200, "", None)).count() == 0


def requests(log):
    return sorted(log.read_text().split()) if log.exists() else []


def test_two_actions_ask_once(spark, tmp_path):
    log = tmp_path / "asked"

    def counted(url):
        with log.open("a") as f:
            f.write(url + "\n")
        return 200, url[-1], None

    urls = [(f"https://h{i % 7}.test/{i}",) for i in range(30)] + [("https://h1.test/1",), (None,)]
    frame = spark.createDataFrame(urls, "url string").selectExpr("url", "NOT coalesce(url LIKE '%/9', false) AS allowed")
    pages = fetch_pages(frame, counted, delay=0.0, queues=3)
    assert pages.count() == 30 and pages.where("status = 200").count() == 29 and len(pages.collect()) == 30
    asked = requests(log)
    assert len(asked) == len(set(asked)) == 29 and "https://h2.test/9" not in asked


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    """A fetcher that ends its worker: what was brought home before is not asked for again."""
    log, killed = tmp_path / "asked", tmp_path / "killed"

    def deadly(url):
        if url.endswith("/5") and not killed.exists():
            killed.touch()
            os._exit(1)
        with log.open("a") as f:
            f.write(url + "\n")
        return 200, "page", None

    urls = spark.createDataFrame([(f"https://a.test/{i}", True) for i in range(10)], "url string, allowed boolean")
    store = str(tmp_path / "store")
    with pytest.raises(Exception, match="crashed|exited|EOF|closed"):
        fetch_pages(urls, deadly, delay=0.0, store=store, workers=1).count()
    first = requests(log)
    assert first == [f"https://a.test/{i}" for i in range(5)]
    pages = fetch_pages(urls, deadly, delay=0.0, store=store, workers=1)
    assert sorted(r.url for r in pages.collect()) == [f"https://a.test/{i}" for i in range(10)]
    assert requests(log) == [f"https://a.test/{i}" for i in range(10)]
    assert not any((tmp_path / "store" / "journal").iterdir())


KILLED_TASK = """
import os, sys
from pathlib import Path
from pyspark.sql import SparkSession
from tidemark.sources.fetch import fetch_pages
from tidemark.sources.registry import find_moved_pages
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
log, killed = Path(sys.argv[1]), Path(sys.argv[2])
def deadly(url):
    if url.endswith("/3") and not killed.exists():
        killed.touch()
        os._exit(1)
    with log.open("a") as f:
        f.write(url + chr(10))
    return 200, "page", None
urls = spark.createDataFrame([(f"https://h{i % 2}.test/{i}", True) for i in range(8)], "url string, allowed boolean")
pages = fetch_pages(urls, deadly, delay=0.0, queues=2, workers=1)
print(pages.count(), pages.count())
"""


def test_a_killed_task_asks_for_the_rest_alone(tmp_path):
    """The task is started again inside the same job."""
    said = subprocess.run([sys.executable, "-c", KILLED_TASK, tmp_path / "asked", tmp_path / "killed"], capture_output=True, text=True, check=True).stdout
    assert said.split() == ["8", "8"] and (tmp_path / "killed").exists()
    assert requests(tmp_path / "asked") == [f"https://h{i % 2}.test/{i}" for i in sorted(range(8), key=lambda i: (i % 2, i))]


def test_a_busy_host_holds_up_no_other():
    answers = {"slow/1": iter([(503, None, "0.6"), (200, "late", None)])}
    order = [u for u, *_ in take_turns({"slow": ["slow/1", "slow/2"], "quick": [f"quick/{i}" for i in range(4)]}, lambda u: next(answers[u]) if u in answers else (200, "x", None), 0.05, 1, 2)]
    assert order == ["quick/0", "quick/1", "quick/2", "quick/3", "slow/1", "slow/2"]


def test_one_request_of_a_host_at_a_time():
    open_now, most, lock = {"a": 0, "b": 0}, [], threading.Lock()

    def slow(url):
        with lock:
            open_now[url[0]] += 1
            most.append((open_now[url[0]], sum(open_now.values())))
        time.sleep(0.05)
        with lock:
            open_now[url[0]] -= 1
        return 200, "", None

    assert len(list(take_turns({"a": ["a1", "a2", "a3"], "b": ["b1", "b2", "b3"]}, slow, 0.0, 4, 0))) == 6
    assert max(m for m, _ in most) == 1 and max(m for _, m in most) == 2


def test_the_search_for_moved_pages_stops_at_the_first_hit(spark, tmp_path):
    """Rounds ask in order, skip what another page has asked, read home pages last, and ask no more after a hit."""
    log, page = tmp_path / "asked", "x" * 501
    home = '<a href="/about">x</a><a href="//c.test/Pricing-now">x</a><a href="https://other.test/pricing">x</a><a href="https://c.testing/pricing">x</a><a href="/plans-2">x</a>'
    there = {
        "https://a.test/old/": page, "https://b.test/plans": page, "https://c.test": home, "https://c.test/Pricing-now": "short",
        "https://c.test/plans-2": page, "https://d.test": page + '<a href="/pricing/plans/">x</a>',
    }

    def counted(url):
        with log.open("a") as f:
            f.write(url + "\n")
        return (200, there[url], None) if url in there else (404, None, None)

    lost = ["https://a.test/old", "https://b.test/pricing/", "https://b.test/gone", "https://c.test/x", "https://d.test/y", "https://e.test/z", None, "https://c.test/x"]
    frame = spark.createDataFrame([(u,) for u in lost], "url string")
    forbid = lambda urls: urls.withColumn("allowed", F.col("host") != "e.test")
    found = {r.url: r.found for r in find_moved_pages(frame, counted, forbid, delay=0.0).collect()}
    assert found == {
        "https://a.test/old": "https://a.test/old/", "https://b.test/pricing/": "https://b.test/plans", "https://b.test/gone": "https://b.test/plans",
        "https://c.test/x": "https://c.test/plans-2", "https://d.test/y": None, "https://e.test/z": None,
    }
    asked, paths = requests(log), ["/pricing", "/pricing/", "/plans", "/plans/", "/en/pricing", "/pricing/plans"]
    of = lambda host: [u for u in asked if u.startswith(f"https://{host}")]
    assert of("a.test") == ["https://a.test/old/"] and of("e.test") == [] and of("other.test") == []
    assert of("b.test") == sorted(["https://b.test/pricing", "https://b.test/gone/", "https://b.test/pricing/", "https://b.test/plans"])
    assert of("c.test") == sorted(["https://c.test" + p for p in ["", "/x/", *paths, "/Pricing-now", "/plans-2"]])
    assert of("d.test") == sorted(["https://d.test" + p for p in ["", "/y/", *paths, "/pricing/plans/"]])
