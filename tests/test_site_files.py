"""The site writer: files equal the manifest, a failed write leaves what was there."""

import hashlib
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.site_files import site_files, site_root, write_site

PAGES = "path string, content string"


def on_disk(folder):
    root = Path(site_root(folder))
    if not root.exists():
        return {}
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_files_equal_the_manifest(spark, tmp_path):
    folder = str(tmp_path / "site")
    assert site_root(folder) is None and site_files(spark, folder).count() == 0
    rows = [(f"v/{i}.html", f"page {i} é") for i in range(50)] + [("index.html", None), ("a b/c.txt", "x\n"), (".nojekyll", "")]
    manifest = write_site(spark.createDataFrame(rows, PAGES).repartition(7), folder)
    want = {p: (c or "").encode() for p, c in rows}
    assert on_disk(folder) == want and manifest["files"] == 53 and manifest["bytes"] == sum(map(len, want.values()))
    listed = {r.path: (r.bytes, r.sha256) for r in site_files(spark, folder).collect()}
    assert listed == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in want.items()}
    # The next site takes the place of this one, and nothing of it stays.
    write_site(spark.createDataFrame([("index.html", "new")], PAGES), folder)
    assert on_disk(folder) == {"index.html": b"new"} and len(os.listdir(folder)) == 2


@pytest.mark.parametrize("bad", ["../x", "/etc/x", "a//b", "v/./x", None, "v/3.html"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "site")
    good = spark.createDataFrame([(f"v/{i}.html", "x") for i in range(20)], PAGES)
    broken = good.unionByName(spark.createDataFrame([(bad, "y")], PAGES))
    with pytest.raises(Exception, match="not a path"):
        write_site(broken, folder)
    assert site_root(folder) is None and os.listdir(folder) == []
    before = write_site(good, folder)
    with pytest.raises(Exception, match="not a path"):
        write_site(broken, folder)
    assert json.loads(Path(folder, "manifest.json").read_text()) == before
    assert set(os.listdir(folder)) == {"manifest.json", before["run"]} and len(on_disk(folder)) == 20


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "site")

    @F.udf("string")
    def deadly(path):
        if path == "v/7.html":
            os._exit(1)
        return path

    pages = spark.createDataFrame([(f"v/{i}.html", "x") for i in range(20)], PAGES)
    with pytest.raises(Exception):
        write_site(pages.withColumn("content", deadly("path")), folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    assert write_site(spark.createDataFrame([], PAGES), folder)["files"] == 0 and on_disk(folder) == {}
