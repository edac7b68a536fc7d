"""Tables that change together: a run that breaks off anywhere has not happened."""

import os
from pathlib import Path

import pytest

from test_ingest import html, pages
from tidemark import __main__ as cli
from tidemark.sources import runs
from tidemark.sources.runs import RunStore

T = "k string, v int"


def put(spark, store, day, **tables):
    run = store.begin(day)
    for name, rows in tables.items():
        (run.append if name == "log" else run.put)(name, spark.createDataFrame(rows, T))
    return run.commit()


def rows(store, name, manifest=None):
    return sorted(tuple(r) for r in store.read(name, T, manifest).collect())


def test_tables_change_together(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.current() is None and rows(store, "a") == []
    first = put(spark, store, "2024-01-01", a=[("x", 1)], log=[("l", 1)])
    put(spark, store, "2024-01-02", a=[("x", 2)], b=[("y", 1)], log=[("l", 2)])
    assert (rows(store, "a"), rows(store, "b"), rows(store, "log")) == ([("x", 2)], [("y", 1)], [("l", 1), ("l", 2)])
    assert rows(store, "a", first) == [("x", 1)]
    # A day that is run again stands on the day before, not on itself.
    put(spark, store, "2024-01-02", a=[("x", 3)], log=[("l", 3)])
    assert (rows(store, "a"), rows(store, "b"), rows(store, "log")) == ([("x", 3)], [], [("l", 1), ("l", 3)])
    assert store.current("2024-01-02") == first


def test_a_run_that_breaks_off_has_not_happened(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    put(spark, store, "2024-01-01", a=[("x", 1)], log=[("l", 1)])
    before = store.manifests()
    run = store.begin("2024-01-02")
    run.put("a", spark.createDataFrame([("x", 9)], T))
    run.append("log", spark.createDataFrame([("l", 9)], T))
    assert store.manifests() == before and rows(store, "a") == [("x", 1)] and rows(store, "log") == [("l", 1)]
    assert len(store.sweep()) == 2
    assert rows(store, "a") == [("x", 1)] and rows(store, "log") == [("l", 1)]
    for day in (3, 4, 5):
        put(spark, store, f"2024-01-0{day}", a=[("x", day)], log=[("l", day)])
    store.sweep(keep=2)
    assert [m.day for m in store.manifests()] == ["2024-01-04", "2024-01-05"]
    assert rows(store, "a") == [("x", 5)] and rows(store, "log") == [("l", n) for n in (1, 3, 4, 5)]
    assert len(os.listdir(tmp_path / "store" / "tables" / "a")) == 2


class Killed(Exception):
    pass


def test_a_command_killed_between_any_two_writes(spark, tmp_path, monkeypatch):
    """Six tables and the manifest: wherever a run ends, the next day goes on from the last whole one."""
    folder, source = str(tmp_path / "store"), str(tmp_path / "pages")
    day = lambda n, price: pages(spark, ("a", 200, html(price))).write.mode("overwrite").parquet(source) or cli.main(["run", folder, "--pages", source, "--day", f"2024-02-0{n}"])
    assert day(1, 49) == 0 and day(2, 59) == 0
    store = RunStore(spark, folder)
    read = lambda: {n: sorted(map(str, store.read(n, s).collect())) for n, s in cli.TABLES.items()}
    before, real, written = read(), runs.Run._write, []

    def dying(self, name, frame):
        if len(written) == after:
            raise Killed
        written.append(name)
        return real(self, name, frame)

    def no_manifest(*_):
        raise Killed

    with monkeypatch.context() as patched:
        patched.setattr(runs.Run, "_write", dying)
        patched.setattr(runs, "put_text", no_manifest)
        for after in range(7):
            written.clear()
            with pytest.raises(Killed):
                day(3, 59)
            assert len(written) == min(after, 6) and read() == before
    # The second reading of 59 has not been stored, so the next one confirms it.
    assert day(4, 59) == 0
    after_all = read()
    assert len(after_all["changes"]) == 1 and "price_increase" in after_all["changes"][0] and after_all["pending"] == []


def test_commands_over_a_registry(spark, tmp_path, monkeypatch, capsys):
    """Fetch, run, digest, advise and publish, with a page that moved and one that robots rules forbid."""
    folder, source, site, registry = (str(tmp_path / n) for n in ("store", "pages", "site", "vendors.yaml"))
    Path(registry).write_text(
        "# ours\nvendors:\n  - name: Alpha\n    category: crm\n    pricing_url: https://a.test/pricing  # home\n"
        "  - name: Beta Mail\n    category: crm\n    pricing_url: https://b.test/old\n"
        "  - name: Gamma\n    category: mail\n    crawl_tier: weekly\n    pricing_url: https://g.test/pricing\n"
        "  - name: Delta\n    pricing_url: https://d.test/private\n"
    )
    def web_of(price):
        there = {
            "https://a.test/pricing": html(price), "https://b.test/plans": html(5) + "x" * 300, "https://g.test/pricing": html(7),
            "https://d.test/robots.txt": "User-agent: *\nDisallow: /private", "https://d.test/private": html(1),
        }
        return lambda url: (200, there[url], None) if url in there else (404, None, None)

    for n, cost in ((6, 49), (7, 59), (8, 59)):
        monkeypatch.setattr(cli.fetching, "web_fetcher", lambda web=web_of(cost): web)
        at = ["--registry", registry, "--day", f"2024-02-0{n}", "--pages", source]
        assert cli.main(["fetch", folder, *at, "--delay", "0", *(["--fix-urls"] if n == 6 else [])]) == 0
        said = capsys.readouterr().out
        # The 6th is a Tuesday: the weekly vendor is not due.
        assert said.startswith("3 pages, 1 moved, registry updated" if n == 6 else "3 pages, 0 moved")
        assert cli.main(["run", folder, *at]) == 0
        capsys.readouterr()
    assert "pricing_url: https://b.test/plans" in Path(registry).read_text() and "# home" in Path(registry).read_text()
    assert cli.main(["digest", folder, "--day", "2024-02-09", "--registry", registry]) == 0
    assert "- crm: 1 changes at 1 vendors" in capsys.readouterr().out
    assert cli.main(["advise", folder, "--day", "2024-02-08"]) == 0
    assert "2 days recorded, 5 days to 7" in capsys.readouterr().out
    state = {r.slug: r for r in RunStore(spark, folder).read("state", cli.TABLES["state"]).collect()}
    assert state["alpha"].hash_changes == 2 and state["delta"].status == "robots_disallowed" and str(state["beta-mail"].last_checked) == "2024-02-08"
    assert RunStore(spark, folder).read("spend", cli.TABLES["spend"]).first()["usd"] > 0
    assert cli.main(["publish", folder, "--registry", registry, "--site", site, "--day", "2024-02-08"]) == 0
    capsys.readouterr()
    out = str(tmp_path / "dumps")
    assert cli.main(["diagnose", folder, "--pages", source, "--out", out, "alpha"]) == 0 and cli.main(["diagnose", folder, "--pages", source, "--out", out, "alpha"]) == 0
    assert "<h1>Pricing</h1>" in Path(out, "alpha-raw.html").read_text() and "<h1>" not in Path(out, "alpha-cleaned.txt").read_text()
    check_site(site)


def check_site(site):
    from html.parser import HTMLParser
    from xml.dom.minidom import parseString

    from tidemark.sources.site_files import site_root

    root = Path(site_root(site))
    files = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}
    assert set(files) == {
        "index.html", "changes.html", "week.html", "status.html", "vendor/alpha.html", "vendor/beta-mail.html", "category/crm.html", "compare/alpha-vs-beta-mail.html",
        "feed.xml", "sitemap.xml", "sitemap-1.xml", "robots.txt", ".nojekyll",
    }

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.found.append(dict(attrs)["href"])

    for path, content in files.items():
        if path.endswith(".html"):
            links = Links()
            links.found = []
            links.feed(content)
            for href in links.found:
                assert os.path.normpath(os.path.join(os.path.dirname(path), href)) in files, (path, href)
    assert "went up from $49 to $59" in files["vendor/alpha.html"] and "<td>$59</td>" in files["vendor/alpha.html"] and "application/ld+json" in files["vendor/alpha.html"]
    assert "median entry $12" in files["category/crm.html"] and "Alpha vs Beta Mail" in files["compare/alpha-vs-beta-mail.html"]
    assert "noindex" not in files["index.html"] and "2 vendors" in files["index.html"] and "CRM: 1 changes" in files["week.html"]
    places = [n.firstChild.data for n in parseString(files["sitemap-1.xml"]).getElementsByTagName("loc")]
    assert sorted(places) == sorted(f"https://example.com/{p}" for p in files if p.endswith(".html"))
    parseString(files["feed.xml"]), parseString(files["sitemap.xml"])
