"""Every operator as a query over the driver's tables, beside the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import benchmarks, diff, gate, history, records, reports
from tidemark.operators.pairs import block_pairs
from tidemark.operators.ranks import places
from tidemark.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The moment that stands for now in every query.
NOW, TODAY = "2024-01-25 04:30:00", "2001-06-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Text


@query(rf"""WITH {V.TEXTS} SELECT id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '\?v=[\w.-]+', '', 'g'), '\b[0-9a-f]{{32,64}}\b', '<HASH>', 'g'), '\bnonce-[\w+/=-]+', '<NONCE>', 'gi'),
    '\b\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(:\d{{2}})?\b', '<TS>', 'g'),
    '\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b', '<UUID>', 'gi'),
    '\b\d[\d,]{{3,}}\+?\s+(customers|teams|companies|users|businesses|developers)\b', '<COUNT> \1', 'gi') AS masked
  FROM texts_v""")
def mask_volatile(spark, sf_dir):
    return V.texts(spark, sf_dir).select("id", T.mask_volatile(F.col("text")).alias("masked"))


@query("""WITH parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)
  SELECT doc_id, sha256(array_to_string(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1]), chr(10))) AS text_sha256 FROM parts""")
def normalize_lines(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.normalize_lines(F.col("text")), 256).alias("text_sha256"))


@query("""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  marked AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM lines)
  SELECT doc_id, pos::INTEGER AS pos, line FROM marked WHERE before IS NULL OR line <> before""")
def dedup_adjacent_lines(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("before", before).where("before IS NULL OR line <> before").drop("before")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def _strip_tags_sql() -> str:
    # RE2 has no back-references: one replacement for each tag.
    sql = "html"
    for tag in T.DROPPED_TAGS:
        sql = f"regexp_replace({sql}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    sql = f"regexp_replace(regexp_replace({sql}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
    return f"SELECT page_id, sha256(trim(regexp_replace({sql}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS text_sha256 FROM pages"


@query()
def strip_tags(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query(rf"""WITH {V.TEXTS} SELECT id FROM texts_v WHERE length(text) >= 200
  AND regexp_matches(lower(text), '[$£€]\s?\d|\bper (month|user|seat|year)\b|\bfree\b|\bcontact sales\b')
  AND (contains(lower(text), 'plan') OR contains(lower(text), 'pricing') OR contains(lower(text), 'tier')
       OR contains(lower(text), 'billed') OR contains(lower(text), 'subscription'))""")
def pricing_page_filter(spark, sf_dir):
    return V.texts(spark, sf_dir).where(T.looks_like_pricing_page(F.col("text"))).select("id")


@query("""SELECT page_id, href, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href FROM pages) GROUP BY ALL""")
def href_extract(spark, sf_dir):
    links = V.table(spark, sf_dir, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(rf"""WITH {V.TEXTS}, found AS (
  SELECT id, unnest(regexp_extract_all(text, '[$£€]\s?\d{{1,4}}([.,]\d{{2}})?')) AS snippet,
         generate_subscripts(regexp_extract_all(text, '[$£€]\s?\d{{1,4}}([.,]\d{{2}})?'), 1) - 1 AS pos FROM texts_v),
  first AS (SELECT id, substr(snippet, 1, 12) AS k, arg_min(snippet, pos) AS snippet, min(pos) AS pos FROM found GROUP BY id, k)
  SELECT id, snippet, (row_number() OVER (PARTITION BY id ORDER BY pos))::INTEGER AS place FROM first QUALIFY place <= 6""")
def price_hunt(spark, sf_dir):
    found = V.texts(spark, sf_dir).select("id", F.posexplode(T.markup_prices(F.col("text"))).alias("pos", "snippet"))
    first = found.groupBy("id", F.substring("snippet", 1, 12).alias("k")).agg(F.min_by("snippet", "pos").alias("snippet"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return first.withColumn("place", place).where("place <= 6").select("id", "snippet", "place")


@query("""SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, count(*) AS pages,
  sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1""")
def host_rollup(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.groupBy(T.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query()
def clean_pages(spark, sf_dir):
    from tidemark.operators.html import clean_pages as clean

    pages = V.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return clean(pages).select("page_id", "text", T.content_hash(F.col("text")).alias("hash"))


@query()
def diagnose_pages(spark, sf_dir):
    from tidemark.operators.html import clean_pages as clean

    pages = clean(V.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    raw, clean_prices = T.markup_prices(F.col("html")), T.markup_prices(F.col("text"))
    has_json = F.exists(F.slice(raw, 1, 4), lambda s: s.rlike('[{}":]'))
    verdict = reports.diagnose(
        T.looks_like_pricing_page(F.col("text")), F.lit(200), F.size(raw), F.size(clean_prices), F.length("html"), has_json
    )
    return pages.select("page_id", verdict.alias("verdict"))


# Scalars


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slugify(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


_PLAN_NAME = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' Plan' WHEN 1 THEN ' Tier Plan' WHEN 2 THEN ' Plan Tier' WHEN 3 THEN ' Edition ' ELSE '+' END"


@query(f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({_PLAN_NAME})),
  ' plan$', ''), ' tier$', ''), ' package$', ''), ' edition$', ''), '[^a-z0-9]', '', 'g') AS key FROM part""")
def plan_key(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", T.plan_key(F.expr(_PLAN_NAME)).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'CRM' ELSE array_to_string(list_transform(string_split(
    CASE WHEN p_partkey % 3 = 0 THEN 'seo-api-' ELSE '' END || lower(p_type) || '-' || replace(p_name, ' ', '-'), '-'),
  lambda w: CASE w WHEN 'seo' THEN 'SEO' WHEN 'api' THEN 'API' ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS title FROM part""")
def title_case(spark, sf_dir):
    prefix = F.when(F.col("p_partkey") % 3 == 0, "seo-api-").otherwise("")
    slug = F.concat(prefix, F.lower("p_type"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
    slug = F.when(F.col("p_partkey") % 7 == 0, "crm-tools").otherwise(slug)
    return V.table(spark, sf_dir, "part").select("p_partkey", T.title_case(slug).alias("title"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'))
  AS escaped_sha256 FROM pages""")
def html_escape(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_escape(F.col("html")), 256).alias("escaped_sha256"))


@query("""WITH amounts AS (
  SELECT c_custkey, ['USD', 'GBP', 'EUR', 'CAD', 'AUD', 'INR', 'SEK', ''][(c_custkey % 8 + 1)::INTEGER] AS code,
    regexp_replace(regexp_replace(format('{:,.2f}', c_acctbal), '0+$', ''), '\\.$', '') AS digits FROM customer)
  SELECT c_custkey, CASE code WHEN 'USD' THEN '$' || digits WHEN 'GBP' THEN '£' || digits WHEN 'EUR' THEN '€' || digits
    WHEN 'CAD' THEN 'CA$' || digits WHEN 'AUD' THEN 'A$' || digits WHEN 'INR' THEN '₹' || digits WHEN '' THEN digits ELSE digits || ' ' || code END AS amount
  FROM amounts""")
def money_format(spark, sf_dir):
    codes = F.array(*map(F.lit, ("USD", "GBP", "EUR", "CAD", "AUD", "INR", "SEK", "")))
    code = F.get(codes, (F.col("c_custkey") % 8).cast("int"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", T.money(code, F.col("c_acctbal")).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN substr('not a date ' || o_orderkey, 1, 10)
  WHEN o_orderkey % 11 = 0 THEN '—' ELSE strftime(o_orderdate, '%d %b %Y') END AS day FROM orders""")
def pretty_date(spark, sf_dir):
    iso = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("not a date "), F.col("o_orderkey").cast("string"))).when(
        F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.pretty_date(iso).alias("day"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, array_to_string(list_sort([lower(a.s_name), lower(b.s_name)]), '-vs-') AS pair
  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey > b.s_suppkey""")
def pair_slug(spark, sf_dir):
    known = V.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lower("s_name").alias("name"))
    pairs = block_pairs(known, "s_nationkey", "s_suppkey").where("s_suppkey_a > s_suppkey_b")
    return pairs.select(F.col("s_suppkey_a").alias("a"), F.col("s_suppkey_b").alias("b"), T.pair_slug(F.col("name_a"), F.col("name_b")).alias("pair"))


@query(f"""WITH {V.CHANGES} SELECT event_id, CASE WHEN old_value IS NULL OR new_value IS NULL THEN 'none' WHEN new_value > old_value THEN 'up'
  WHEN new_value < old_value THEN 'down' ELSE 'flat' END AS direction FROM changes_v""")
def diff_direction(spark, sf_dir):
    return V.changes(spark, sf_dir).select("event_id", T.diff_direction(F.col("old_value"), F.col("new_value")).alias("direction"))


_NUMBER_TEXT = "CASE WHEN o_orderkey % 4 = 0 THEN 'from ' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderkey || '.125' END"


@query(f"SELECT o_orderkey, round(try_cast({_NUMBER_TEXT} AS DOUBLE), 2) AS number FROM orders")
def to_num(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.to_number(F.expr(_NUMBER_TEXT)).alias("number"))


@query("""SELECT doc_id, round(least(length(text), 24000) / 4.0::DOUBLE / 1e6 * 1.0::DOUBLE + 900 / 1e6 * 5.0::DOUBLE, 9) AS usd FROM documents""")
def extract_cost(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.round(T.extraction_cost(F.col("text")), 9).alias("usd"))


# Records

_RAW_NAME = "'  ' || name || ' Plan '"


def _nested(spark, sf_dir):
    """Raw nested records: a supplier's plans of each year, as an extractor would deliver them."""
    rows = V.plans(spark, sf_dir)
    plan = F.struct(
        F.expr(_RAW_NAME).alias("name"),
        F.col("monthly_price").cast("string").alias("monthly_price"),
        F.col("annual_price_per_month").cast("string").alias("annual_price_per_month"),
        "is_free",
        "is_custom_pricing",
        "is_per_seat",
        "is_addon",
        F.lit("many").alias("min_seats"),
        F.lit("14").alias("trial_days"),
        F.array(F.struct(F.lit(" Quantity").alias("metric"), F.col("limits")["quantity"].cast("string").alias("value"), F.lit("").alias("unit"))).alias("limits"),
        F.transform("features", lambda f: F.concat(F.lit(" "), f)).alias("features"),
    )
    # A supplier's plans of a year make one record, the unit of the data model.
    grouped = rows.groupBy("vendor", "year").agg(F.collect_list(plan).alias("plans"))
    raw = F.struct(F.lit(" usd").alias("currency"), F.lit(None).cast("boolean").alias("pricing_is_public"), F.lit(" ").alias("extraction_notes"), F.col("plans")).cast(records.RAW_RECORD)
    return grouped.select("vendor", "year", records.normalize_record(raw).alias("record"))


_NORMAL = f"""{V.PLANS}, normal_v AS (
  SELECT vendor, year, name || ' Plan' AS name, key, is_free, is_custom_pricing, round(monthly_price, 2) AS monthly_price, round(annual_price_per_month, 2) AS annual_price_per_month,
    is_per_seat, is_addon, round(quantity, 2) AS quantity, list_transform(features, lambda f: lower(f)) AS features
  FROM plans_v)"""


@query(f"""WITH {_NORMAL} SELECT vendor, year, (row_number() OVER (PARTITION BY vendor, year ORDER BY monthly_price, key))::INTEGER AS place, name, key,
  monthly_price, annual_price_per_month, is_free, is_custom_pricing AS custom, is_per_seat, is_addon, 14 AS trial_days, quantity, array_to_string(features, ',') AS features,
  'USD' AS currency, false AS public FROM normal_v""")
def normalize_plans(spark, sf_dir):
    rows = _nested(spark, sf_dir).select("vendor", "year", "record", F.posexplode("record.plans").alias("pos", "p"))
    return rows.select(
        "vendor", "year", (F.col("pos") + 1).alias("place"), "p.name", "p.key", "p.monthly_price", "p.annual_price_per_month",
        "p.is_free", F.col("p.is_custom_pricing").alias("custom"), "p.is_per_seat", "p.is_addon",
        "p.trial_days", F.get("p.limits", F.lit(0))["value"].alias("quantity"), F.array_join("p.features", ",").alias("features"),
        F.col("record.currency").alias("currency"), F.col("record.pricing_is_public").alias("public"),
    )


@query(f"""WITH {_NORMAL} SELECT vendor, year, sha256('USD|false||' || string_agg(
    key || '|' || coalesce(round(monthly_price * 100)::BIGINT::VARCHAR, 'None') || '|' || coalesce(round(annual_price_per_month * 100)::BIGINT::VARCHAR, 'None')
    || '|' || is_free || '|' || is_custom_pricing || '|' || is_addon || '|quantity=' || round(quantity * 100)::BIGINT || '|' || array_to_string(features, ','), '||' ORDER BY key)) AS fingerprint
  FROM normal_v GROUP BY vendor, year""")
def record_fingerprint(spark, sf_dir):
    return _nested(spark, sf_dir).select("vendor", "year", records.record_fingerprint(F.col("record")).alias("fingerprint"))


@query(f"""WITH {V.PLANS} SELECT vendor, year, key, coalesce(nullif(monthly_price, 0), nullif(annual_price_per_month, 0)) AS price,
  CASE WHEN monthly_price <> 0 THEN 'monthly' WHEN annual_price_per_month <> 0 THEN 'annual' ELSE 'none' END AS basis
  FROM (SELECT vendor, year, key, CASE WHEN quantity > 40 THEN monthly_price END AS monthly_price, annual_price_per_month FROM plans_v)""")
def plan_price_basis(spark, sf_dir):
    rows = V.plans(spark, sf_dir).withColumn("monthly_price", F.when(F.col("limits")["quantity"] > 40, F.col("monthly_price")))
    price, basis = records.plan_price(F.col("monthly_price"), F.col("annual_price_per_month"))
    return rows.select("vendor", "year", "key", price.alias("price"), basis.alias("basis"))


@query(f"""WITH {V.PLANS} SELECT vendor, year, min(price) AS entry_price, max(price) AS top_price,
  CASE WHEN bool_and(basis = 'annual') THEN 'annual' ELSE 'monthly' END AS basis FROM (
    SELECT vendor, year, coalesce(monthly_price, annual_price_per_month) AS price, CASE WHEN monthly_price IS NULL THEN 'annual' ELSE 'monthly' END AS basis
    FROM (SELECT vendor, year, is_addon, is_custom_pricing, CASE WHEN quantity > 40 THEN monthly_price END AS monthly_price, annual_price_per_month FROM plans_v)
    WHERE NOT is_addon AND NOT is_custom_pricing)
  WHERE price IS NOT NULL GROUP BY vendor, year""")
def headline_prices(spark, sf_dir):
    rows = V.plans(spark, sf_dir).withColumn("monthly_price", F.when(F.col("limits")["quantity"] > 40, F.col("monthly_price")))
    return records.headline_prices(rows, ["vendor", "year"])


@query(f"""WITH {V.PLANS} SELECT vendor, year, coalesce(bool_or(is_free) FILTER (NOT is_addon), false) AS free_real,
  coalesce(bool_or(is_per_seat) FILTER (NOT is_addon), false) AS seat_real, coalesce(bool_or(is_custom_pricing) FILTER (NOT is_addon), false) AS custom_real,
  bool_or(is_free) AS free_any, bool_or(is_per_seat) AS seat_any, bool_or(is_custom_pricing) AS custom_any, count(*) FILTER (NOT is_addon) AS real_plans FROM plans_v GROUP BY vendor, year""")
def vendor_flags(spark, sf_dir):
    return records.vendor_flags(V.plans(spark, sf_dir), ["vendor", "year"])


@query(f"WITH {V.PLANS} SELECT DISTINCT vendor, year, unnest(features) AS feature FROM plans_v WHERE NOT is_addon")
def all_features(spark, sf_dir):
    return records.all_features(V.plans(spark, sf_dir), ["vendor", "year"])


@query(f"""WITH {V.PLANS} SELECT vendor, year, min(monthly_price) AS low_price, max(monthly_price) AS high_price, count(*) AS offer_count
  FROM plans_v WHERE NOT is_addon AND monthly_price IS NOT NULL GROUP BY vendor, year""")
def aggregate_offer(spark, sf_dir):
    return records.aggregate_offer(V.plans(spark, sf_dir), ["vendor", "year"])


# Differences between each yearly reading and the one of the year before


def _years(spark, sf_dir):
    return V.year_pairs(V.plans(spark, sf_dir), V.readings(spark, sf_dir))


_SPLIT = ("vendor.vendor", "vendor.year")

_YEARS = f"""{V.PLANS}, {V.READINGS}, pair_years AS (SELECT b.vendor, b.year FROM readings_v a JOIN readings_v b ON a.vendor = b.vendor AND b.year = a.year + 1),
o AS (SELECT p.* EXCLUDE (year), p.year + 1 AS year FROM plans_v p SEMI JOIN pair_years y ON y.vendor = p.vendor AND y.year = p.year + 1),
n AS (SELECT p.* FROM plans_v p SEMI JOIN pair_years y ON y.vendor = p.vendor AND y.year = p.year),
both_v AS (
  SELECT n.vendor, n.year, n.key, n.name, o.name AS old_name, o.is_custom_pricing AS old_custom, n.is_custom_pricing AS new_custom, o.monthly_price AS old_monthly, n.monthly_price AS new_monthly, o.annual_price_per_month AS old_annual,
    n.annual_price_per_month AS new_annual, o.is_per_seat AS old_seat, n.is_per_seat AS new_seat, o.quantity AS old_quantity, n.quantity AS new_quantity,
    o.features AS old_features, n.features AS new_features FROM o JOIN n ON o.vendor = n.vendor AND o.year = n.year AND o.key = n.key)"""


@query(f"WITH {_YEARS} SELECT vendor, year, key, name, monthly_price FROM n ANTI JOIN o USING (vendor, year, key)")
def plans_added(spark, sf_dir):
    old, new = _years(spark, sf_dir)
    return diff.plans_added(old, new).select(*_SPLIT, "key", "name", "monthly_price")


@query(f"WITH {_YEARS} SELECT vendor, year, key, name, monthly_price FROM o ANTI JOIN n USING (vendor, year, key)")
def plans_removed(spark, sf_dir):
    old, new = _years(spark, sf_dir)
    return diff.plans_removed(old, new).select(*_SPLIT, "key", "name", "monthly_price")


@query(f"""WITH {_YEARS} SELECT coalesce(o.vendor, n.vendor) AS vendor, coalesce(o.year, n.year) AS year, coalesce(o.key, n.key) AS key, o.monthly_price AS old_price, n.monthly_price AS new_price,
  CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'persisted' END AS fate FROM o FULL JOIN n ON o.vendor = n.vendor AND o.year = n.year AND o.key = n.key""")
def plan_diff_outer(spark, sf_dir):
    joined = diff.join_versions(*map(diff.last_by_key, _years(spark, sf_dir)))
    fate = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("persisted")
    return joined.select(*_SPLIT, "key", F.col("old.monthly_price").alias("old_price"), F.col("new.monthly_price").alias("new_price"), fate.alias("fate"))


def _persisted(spark, sf_dir):
    joined = diff.join_versions(*map(diff.last_by_key, _years(spark, sf_dir)))
    return joined.where("old IS NOT NULL AND new IS NOT NULL")


_MOVE = "abs((new_monthly - old_monthly) / nullif(old_monthly, 0) * 100)"


@query(f"WITH {_YEARS} SELECT vendor, year, key, old_monthly AS old_price, new_monthly AS new_price FROM both_v WHERE old_monthly <> new_monthly AND {_MOVE} < 1.0")
def rounding_noise(spark, sf_dir):
    a, b = F.col("old.monthly_price"), F.col("new.monthly_price")
    return _persisted(spark, sf_dir).where((a != b) & diff.is_noise(a, b)).select(*_SPLIT, "key", a.alias("old_price"), b.alias("new_price"))


@query(f"""WITH {_YEARS} SELECT vendor, year, key, old_monthly AS old_price, new_monthly AS new_price FROM both_v
  WHERE old_monthly > 0 AND (least(old_monthly, new_monthly) <= 0 OR greatest(old_monthly, new_monthly) / least(old_monthly, new_monthly) > 4.0)""")
def implausible_moves(spark, sf_dir):
    a, b = F.col("old.monthly_price"), F.col("new.monthly_price")
    return _persisted(spark, sf_dir).where(diff.is_implausible(a, b)).select(*_SPLIT, "key", a.alias("old_price"), b.alias("new_price"))


@query(f"WITH {_YEARS} SELECT vendor, year, key, 'quantity' AS metric, old_quantity AS old_limit, new_quantity AS new_limit FROM both_v WHERE old_quantity <> new_quantity")
def limit_changes(spark, sf_dir):
    events = diff.plan_events(_persisted(spark, sf_dir), F.lit(False)).where("event.change_type = 'limit_changed'")
    return events.select(*_SPLIT, "key", F.col("event.field").alias("metric"), F.col("event.old_num").alias("old_limit"), F.col("event.new_num").alias("new_limit"))


@query(f"""WITH {_YEARS}
  SELECT vendor, year, key, 'feature_added' AS change_type, f AS feature FROM both_v, unnest(list_filter(new_features, lambda x: NOT list_contains(old_features, x))) t(f)
  UNION ALL
  SELECT vendor, year, key, 'feature_moved_out', f FROM both_v, unnest(list_filter(old_features, lambda x: NOT list_contains(new_features, x))) t(f)""")
def feature_changes(spark, sf_dir):
    events = diff.plan_events(_persisted(spark, sf_dir), F.lit(False)).where("event.field = 'features'")
    return events.select(*_SPLIT, "key", "event.change_type", F.coalesce("event.new_text", "event.old_text").alias("feature"))


@query(f"""WITH {_YEARS} SELECT DISTINCT vendor, year, key, unnest(features) AS feature FROM o WHERE NOT is_addon
  EXCEPT SELECT DISTINCT vendor, year, key, unnest(features) FROM n WHERE NOT is_addon""")
def feature_only_left(spark, sf_dir):
    old, new = _years(spark, sf_dir)
    lost = records.all_features(old, ["vendor", "key"]).subtract(records.all_features(new, ["vendor", "key"]))
    return lost.select(*_SPLIT, "key", "feature")


@query(f"""WITH {_YEARS} SELECT vendor, year, key, round(CASE WHEN old_monthly <> 0 THEN (new_monthly - old_monthly) / old_monthly * 100 END, 6) AS pct FROM both_v""")
def pct_change(spark, sf_dir):
    pct = T.percent_change(F.col("old.monthly_price"), F.col("new.monthly_price"))
    return _persisted(spark, sf_dir).select(*_SPLIT, "key", F.round(pct, 6).alias("pct"))


@query(f"""WITH {_YEARS} SELECT vendor, year, key, coalesce(format('{{:+.1f}}%', round((new_monthly - old_monthly) / nullif(old_monthly, 0) * 100, 1)), 'n/a') AS pct FROM both_v""")
def pct_text(spark, sf_dir):
    return _persisted(spark, sf_dir).select(*_SPLIT, "key", T.percent_text(F.col("old.monthly_price"), F.col("new.monthly_price")).alias("pct"))


def _all_events(spark, sf_dir):
    # A task gets about as many lines on any input. Each plan and reading is the new side of its year and the old one of the next.
    tasks = V.line_tasks(spark, sf_dir)
    events = diff.diff_sides(V.year_sides(V.plans(spark, sf_dir, tasks)), V.year_sides(V.readings(spark, sf_dir)), tasks)
    return events.select(*_SPLIT, *(c for c in events.columns if c != "vendor"))


_EVENTS = f"""{_YEARS}, pair_v AS (
  SELECT b.vendor, b.year, a.currency AS old_currency, b.currency AS new_currency, a.pricing_is_public AS was, b.pricing_is_public AS now,
    round(greatest(0, 0.95::DOUBLE - ((CASE WHEN b.extraction_notes <> '' THEN 0.15::DOUBLE ELSE 0 END)
      + (CASE coalesce(c.k, 0) WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE 0 END) + 0.0::DOUBLE)), 2) AS base
  FROM readings_v a JOIN readings_v b ON a.vendor = b.vendor AND b.year = a.year + 1
  LEFT JOIN (SELECT vendor, year, count(*) AS k FROM n GROUP BY ALL) c ON c.vendor = b.vendor AND c.year = b.year),
priced AS (
  SELECT vendor, year, key, name, 'monthly_price' AS field, old_monthly AS a, new_monthly AS b FROM both_v
  UNION ALL SELECT vendor, year, key, name, 'annual_price_per_month', old_annual, new_annual FROM both_v),
rules AS (
  SELECT vendor, year, NULL AS key, 'pricing_hidden' AS change_type, NULL AS plan, NULL AS field, NULL::DOUBLE AS old_num, NULL::DOUBLE AS new_num,
    'true' AS old_text, 'false' AS new_text, 1.0::DOUBLE AS share FROM pair_v WHERE was AND NOT now
  UNION ALL SELECT vendor, year, NULL, 'pricing_published', NULL, NULL, NULL, NULL, 'false', 'true', 1.0 FROM pair_v WHERE now AND NOT was
  UNION ALL SELECT vendor, year, NULL, 'currency_changed', NULL, 'currency', NULL, NULL, old_currency, new_currency, 0.4 FROM pair_v WHERE old_currency <> new_currency
  UNION ALL SELECT vendor, year, key, 'plan_added', name, NULL, NULL, monthly_price, NULL, NULL, 1.0 FROM n ANTI JOIN o USING (vendor, year, key)
  UNION ALL SELECT vendor, year, key, 'plan_removed', name, NULL, monthly_price, NULL, NULL, NULL, 1.0 FROM o ANTI JOIN n USING (vendor, year, key)
  UNION ALL SELECT vendor, year, key, 'plan_renamed', name, 'name', NULL, NULL, old_name, name, 1.0 FROM both_v WHERE old_name <> name
  UNION ALL SELECT vendor, year, key, 'custom_pricing_changed', name, 'is_custom_pricing', NULL, NULL, old_custom::VARCHAR, new_custom::VARCHAR, 1.0 FROM both_v WHERE old_custom <> new_custom
  UNION ALL SELECT vendor, year, key, 'billing_model_changed', name, 'is_per_seat', NULL, NULL, old_seat::VARCHAR, new_seat::VARCHAR, 0.8 FROM both_v WHERE old_seat <> new_seat
  UNION ALL SELECT vendor, year, key, 'price_availability_changed', name, field, a, b, NULL, NULL, 0.7 FROM priced JOIN pair_v USING (vendor, year)
    WHERE old_currency = new_currency AND (a IS NULL) <> (b IS NULL)
  UNION ALL SELECT vendor, year, key, CASE WHEN b > a THEN 'price_increase' ELSE 'price_decrease' END, name, field, a, b, NULL, NULL,
      CASE WHEN a > 0 AND (least(a, b) <= 0 OR greatest(a, b) / least(a, b) > 4.0) THEN 0.3 ELSE 1.0 END FROM priced JOIN pair_v USING (vendor, year)
    WHERE old_currency = new_currency AND a <> b AND NOT (a <> 0 AND abs((b - a) / nullif(a, 0) * 100) < 1.0)
  UNION ALL SELECT vendor, year, key, 'limit_changed', name, 'quantity', old_quantity, new_quantity, NULL, NULL, 0.9 FROM both_v WHERE old_quantity <> new_quantity
  UNION ALL SELECT vendor, year, key, 'feature_added', name, 'features', NULL, NULL, NULL, f, 0.6 FROM both_v, unnest(list_filter(new_features, lambda x: NOT list_contains(old_features, x))) t(f)
  UNION ALL SELECT vendor, year, key, 'feature_moved_out', name, 'features', NULL, NULL, f, NULL, 0.6 FROM both_v, unnest(list_filter(old_features, lambda x: NOT list_contains(new_features, x))) t(f)),
events_v AS (
  SELECT vendor, year, key, change_type, plan, field, old_num, new_num, old_text, new_text, round(base * share, 4) AS confidence, round(base * share, 4) >= 0.80 AS publishable
  FROM rules JOIN pair_v USING (vendor, year))"""


@query(f"WITH {_EVENTS} SELECT * FROM events_v")
def diff_all_events(spark, sf_dir):
    return _all_events(spark, sf_dir)


@query(f"WITH {_EVENTS} SELECT publishable, change_type, count(*) AS events FROM events_v GROUP BY ALL")
def route_changes(spark, sf_dir):
    return _all_events(spark, sf_dir).groupBy("publishable", "change_type").agg(F.count("*").alias("events"))


# Gate, confirmation, budget, outcomes


def _hashes(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), "ts", "event_id", F.sha2("event_type", 256).alias("hash"))


_HASHES = "hash_v AS (SELECT user_id AS slug, ts, event_id, sha256(event_type) AS hash FROM events)"


@query(f"""WITH {_HASHES}, b AS (SELECT *, lag(hash) OVER (PARTITION BY slug ORDER BY ts, event_id) AS before FROM hash_v)
  SELECT slug, event_id, hash FROM b WHERE hash IS DISTINCT FROM before""")
def hash_gate(spark, sf_dir):
    return gate.hash_gate(_hashes(spark, sf_dir), "slug", ["ts", "event_id"]).select("slug", "event_id", "hash")


@query(f"""WITH {_HASHES}, b AS (SELECT *, lag(hash) OVER (PARTITION BY slug ORDER BY ts, event_id) AS before FROM hash_v)
  SELECT slug, count(*) FILTER (before IS NOT NULL AND before <> hash) AS hash_changes FROM b GROUP BY slug""")
def hash_change_count(spark, sf_dir):
    return gate.hash_change_count(_hashes(spark, sf_dir), "slug", ["ts", "event_id"])


@query("""WITH RECURSIVE r AS (
  SELECT user_id AS vendor, floor(value / 200)::BIGINT AS print, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  walk AS (
    SELECT vendor, i, seq, print AS base, NULL::BIGINT AS held, NULL::BIGINT AS old_print, NULL::BIGINT AS new_print FROM r WHERE i = 1
    UNION ALL
    SELECT r.vendor, r.i, r.seq, CASE WHEN r.print <> w.base AND w.held = r.print THEN r.print ELSE w.base END,
      CASE WHEN r.print = w.base OR w.held = r.print THEN NULL ELSE r.print END,
      CASE WHEN r.print <> w.base AND w.held = r.print THEN w.base END, CASE WHEN r.print <> w.base AND w.held = r.print THEN r.print END
    FROM walk w JOIN r ON r.vendor = w.vendor AND r.i = w.i + 1)
  SELECT vendor, seq, old_print, new_print FROM walk WHERE new_print IS NOT NULL""")
def confirm_changes(spark, sf_dir):
    readings = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("vendor"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 200).cast("bigint").alias("print"))
    return gate.confirm_changes(readings, "vendor", "seq", "print")


@query("""WITH c AS (SELECT o_custkey AS run, o_orderkey AS pos, round(o_totalprice * 100)::BIGINT AS cost FROM orders),
  s AS (SELECT *, sum(cost) OVER (PARTITION BY run ORDER BY pos) AS spent FROM c)
  SELECT run, pos, cost, spent::BIGINT AS spent FROM s WHERE spent <= 100000000""")
def budget_cutoff(spark, sf_dir):
    costs = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("pos"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cost")
    )
    return gate.budget_cutoff(costs, "run", "pos", "cost", 100_000_000)


@query(f"WITH {V.VENDORS} SELECT vendor, name, slug, tier FROM vendors_v WHERE tier <> 'weekly'")
def due_vendors(spark, sf_dir):
    return gate.due_vendors(V.vendors(spark, sf_dir), F.lit("2024-01-23").cast("date")).select("vendor", "name", "slug", "tier")


@query(f"WITH {V.VENDORS} SELECT vendor, name, slug, tier FROM vendors_v")
def due_vendors_monday(spark, sf_dir):
    return gate.due_vendors(V.vendors(spark, sf_dir), F.lit("2024-01-22").cast("date")).select("vendor", "name", "slug", "tier")


@query(f"""WITH {V.CHECKS}, g AS (SELECT slug, outcome, count(*) FILTER (outcome <> 'error') OVER (
    PARTITION BY slug ORDER BY checked_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS later_ok FROM checks_v)
  SELECT slug, count(*) FILTER (outcome = 'error' AND later_ok = 0) AS consecutive_failures FROM g GROUP BY slug""")
def consecutive_failures(spark, sf_dir):
    return gate.consecutive_failures(V.checks(spark, sf_dir), "slug", ["checked_at", "id"], F.col("outcome") == "error")


_STATS = f"""{V.CHECKS}, stats AS (SELECT strftime(checked_at, '%Y-%m') AS month, count(*) AS checked, count(*) FILTER (outcome = 'ok') AS ok,
  count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (outcome = 'robots') AS robots FROM checks_v GROUP BY 1)"""


@query(f"WITH {_STATS} SELECT * FROM stats")
def run_stats(spark, sf_dir):
    months = V.checks(spark, sf_dir).withColumn("month", F.date_format("checked_at", "yyyy-MM"))
    return gate.run_stats(months, "month", "outcome", ["ok", "error", "robots"])


@query(f"WITH {_STATS} SELECT month, (error + robots) / checked AS failure_ratio FROM stats WHERE (error + robots) / checked > 0.5")
def failure_alarm(spark, sf_dir):
    stats = run_stats(spark, sf_dir)
    return gate.failure_alarm(stats, F.col("error") + F.col("robots"), F.col("checked")).select("month", "failure_ratio")


# Benchmarks and comparisons


@query(f"""WITH {V.HEADS}, priced AS (SELECT * FROM heads_v WHERE entry_price IS NOT NULL),
  counts AS (SELECT category, currency, count(*) AS c FROM priced GROUP BY ALL),
  seen AS (SELECT category, count(DISTINCT currency) AS currencies FROM heads_v GROUP BY category),
  best AS (SELECT category, arg_min(currency, (-c, currency)) AS currency, max(c) AS c, sum(c) AS priced FROM counts GROUP BY category),
  main AS (SELECT p.* FROM priced p JOIN best b ON p.category = b.category AND p.currency = b.currency),
  med AS (SELECT category, list_sort(list(entry_price))[count(*) // 2 + 1] AS median_entry, list_sort(list(top_price))[count(*) // 2 + 1] AS median_top FROM main GROUP BY category)
  SELECT f.category, count(*) AS vendors, count(*) FILTER (has_free) / count(*) * 100 AS pct_free, count(*) FILTER (per_seat) / count(*) * 100 AS pct_per_seat,
    coalesce(any_value(b.currency), 'USD') AS currency, any_value(s.currencies) AS currencies, coalesce(any_value(b.c), 0)::BIGINT AS priced_in_currency,
    any_value(median_entry) AS median_entry, any_value(median_top) AS median_top,
    coalesce(any_value(b.priced) - any_value(b.c), 0)::BIGINT AS excluded
  FROM heads_v f JOIN seen s ON s.category = f.category LEFT JOIN best b ON b.category = f.category LEFT JOIN med m ON m.category = f.category GROUP BY f.category""")
def category_benchmark(spark, sf_dir):
    return benchmarks.category_benchmark(V.heads(spark, sf_dir))


@query("SELECT source, list_sort(list(n_chars))[count(n_chars) // 2 + 1] AS upper_median FROM documents GROUP BY source")
def upper_median(spark, sf_dir):
    return benchmarks.upper_median(V.table(spark, sf_dir, "documents").select("source", "n_chars"), ["source"], "n_chars")


_PAIRS = f"""{V.HEADS}, {V.CHANGES}, lively AS (SELECT *, tier = 'daily' OR vendor IN (SELECT vendor FROM changes_v) AS l FROM heads_v WHERE entry_price IS NOT NULL),
  pairs_v AS (SELECT a.category, a.vendor AS vendor_a, b.vendor AS vendor_b, a.name AS name_a, b.name AS name_b, a.slug || '-vs-' || b.slug AS pair,
    a.entry_price AS entry_price_a, b.entry_price AS entry_price_b, a.currency AS currency_a, b.currency AS currency_b, a.per_seat AS per_seat_a, b.per_seat AS per_seat_b, a.has_free AS has_free_a, b.has_free AS has_free_b,
    a.plans AS plans_a, b.plans AS plans_b, a.trial_days AS days_a, b.trial_days AS days_b, a.features AS features_a, b.features AS features_b,
    a.changes AS changes_a, b.changes AS changes_b FROM lively a JOIN lively b ON a.category = b.category AND a.name < b.name WHERE a.l OR b.l)"""


def _pairs(spark, sf_dir, known=lambda heads: heads):
    """Pairs of the heads, with what ``known`` adds to each vendor before they meet."""
    return benchmarks.comparison_pairs(known(V.heads(spark, sf_dir)), V.changes(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT category, vendor_a, vendor_b, pair FROM pairs_v")
def comparison_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("category", "vendor_a", "vendor_b", "pair")


@query(f"""WITH {_PAIRS} SELECT pair, CASE WHEN currency_a <> currency_b THEN 'different currencies' WHEN entry_price_a = entry_price_b THEN 'same entry price'
  WHEN entry_price_a < entry_price_b THEN name_a || ' is cheaper by ' || round(entry_price_b / entry_price_a, 1)::VARCHAR || 'x'
  ELSE name_b || ' is cheaper by ' || round(entry_price_a / entry_price_b, 1)::VARCHAR || 'x' END AS verdict FROM pairs_v""")
def compare_verdict(spark, sf_dir):
    c = F.col
    said = benchmarks.verdict(c("name_a"), c("name_b"), c("entry_price_a"), c("entry_price_b"), c("currency_a"), c("currency_b"))
    return _pairs(spark, sf_dir).select("pair", said.alias("verdict"))


@query(f"""WITH {_PAIRS}, g AS (SELECT pair, (greatest(entry_price_a, entry_price_b) - least(entry_price_a, entry_price_b)) / nullif(least(entry_price_a, entry_price_b), 0) * 100 AS gap FROM pairs_v)
  SELECT pair, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < 10 THEN 'close' WHEN gap < 100 THEN 'apart' ELSE 'multiple' END AS bucket FROM g""")
def compare_gap_bucket(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", benchmarks.gap_bucket(F.col("entry_price_a"), F.col("entry_price_b")).alias("bucket"))


@query(f"""WITH {_PAIRS} SELECT pair, array_to_string(list_filter([CASE WHEN has_free_a AND NOT has_free_b THEN 'only first has a free plan' END,
  CASE WHEN has_free_b AND NOT has_free_a THEN 'only second has a free plan' END, CASE WHEN per_seat_a <> per_seat_b THEN 'billing differs' END,
  CASE WHEN plans_a > plans_b THEN 'first has more plans' END, CASE WHEN plans_a < plans_b THEN 'second has more plans' END,
  CASE WHEN has_free_a AND has_free_b THEN 'both have a free plan' END,
  CASE WHEN days_a > days_b THEN 'first has the longer trial, ' || days_a || ' days against ' || days_b END,
  CASE WHEN days_a < days_b THEN 'second has the longer trial, ' || days_b || ' days against ' || days_a END,
  'only first names ' || nullif(array_to_string(list_sort(list_filter(features_a, lambda x: NOT list_contains(features_b, x)))[1:6], ', '), ''),
  'only second names ' || nullif(array_to_string(list_sort(list_filter(features_b, lambda x: NOT list_contains(features_a, x)))[1:6], ', '), ''),
  CASE WHEN changes_a > 0 AND changes_b = 0 THEN 'only first has changed, times ' || changes_a END,
  CASE WHEN changes_b > 0 AND changes_a = 0 THEN 'only second has changed, times ' || changes_b END,
  CASE WHEN changes_a > 0 AND changes_b > 0 THEN 'both have changed, times ' || changes_a || ' and ' || changes_b END], lambda x: x IS NOT NULL), '; ') AS facts FROM pairs_v""")
def compare_facts(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", benchmarks.facts_text().alias("facts"))


@query(f"""WITH {V.VENDORS} SELECT category, name, sibling, (row_number() OVER (PARTITION BY category, name ORDER BY sibling))::INTEGER AS place FROM (
  SELECT a.category, a.name, b.name AS sibling FROM vendors_v a JOIN vendors_v b ON a.category = b.category AND a.name <> b.name) QUALIFY place <= 8""")
def vendor_siblings(spark, sf_dir):
    return benchmarks.siblings(V.vendors(spark, sf_dir))


@query(f"WITH {V.VENDORS}, {V.READINGS} SELECT vendor, year, currency FROM readings_v ANTI JOIN vendors_v USING (vendor)")
def orphan_records(spark, sf_dir):
    found = V.readings(spark, sf_dir)
    return benchmarks.orphan_records(found, V.vendors(spark, sf_dir), "vendor").select("vendor", "year", "currency")


# History and feeds

_SERIES = f"""{V.CHANGES}, known AS (SELECT * FROM changes_v WHERE old_value IS NOT NULL AND new_value IS NOT NULL),
  series_v AS (SELECT vendor, plan, list_prepend(arg_min(old_value, (detected_at, event_id)), list(new_value ORDER BY detected_at, event_id)) AS series FROM known GROUP BY vendor, plan)"""


@query(f"WITH {_SERIES} SELECT vendor, plan, generate_subscripts(series, 1)::INTEGER - 1 AS pos, unnest(series) AS price FROM series_v")
def price_series(spark, sf_dir):
    return history.series_rows(V.changes(spark, sf_dir))


@query(f"""WITH {_SERIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY len(series) DESC, series[-1], plan) AS r FROM series_v)
  SELECT vendor, plan, len(series)::INTEGER AS points, round(CASE WHEN series[1] = 0 THEN 0 ELSE (series[-1] - series[1]) / series[1] * 100 END, 6) AS delta_pct FROM ranked WHERE r = 1""")
def spark_target_plan(spark, sf_dir):
    best = history.longest_history(V.changes(spark, sf_dir))
    return best.select("vendor", "plan", "points", F.round(history.series_delta(F.array("first", "last")), 6).alias("delta_pct"))


@query(f"""WITH {_SERIES}, boxed AS (SELECT vendor, plan, series, list_min(series) AS lo, CASE WHEN list_max(series) = list_min(series) THEN 1.0::DOUBLE ELSE list_max(series) - list_min(series) END AS span FROM series_v WHERE len(series) > 1),
  pts AS (SELECT vendor, plan, len(series) AS n, lo, span, unnest(series) AS v, generate_subscripts(series, 1) - 1 AS i FROM boxed)
  SELECT vendor, plan, i::INTEGER AS pos, round(i::DOUBLE / (n - 1) * 260.0::DOUBLE, 1) AS x, round(56.0::DOUBLE - (v - lo) / span * 56.0::DOUBLE, 1) AS y FROM pts""")
def sparkline_points(spark, sf_dir):
    return history.sparkline_rows(history.series_rows(V.changes(spark, sf_dir)))


_TOP = "row_number() OVER (ORDER BY detected_at DESC, event_id DESC)"


@query(f"WITH {V.CHANGES} SELECT event_id, vendor, plan, old_value, new_value, ({_TOP})::INTEGER AS rank FROM changes_v QUALIFY rank <= 12")
def top_changes(spark, sf_dir):
    return history.newest_first(V.changes(spark, sf_dir), 12).select("event_id", "vendor", "plan", "old_value", "new_value", "rank")


_LOG_LINE = """CASE WHEN event_id % 10 = 3 THEN '{"broken": ' WHEN event_id % 10 = 4 THEN '[1, 2]' WHEN event_id % 10 = 5 THEN '' WHEN event_id % 10 = 6 THEN 'not json' ELSE props END"""


@query(f"""WITH l AS (SELECT event_id, {_LOG_LINE} AS line FROM events)
  SELECT event_id, json_extract(line, '$.k')::BIGINT AS k FROM l WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END""")
def change_log_scan(spark, sf_dir):
    from tidemark.sources.logs import parse_log

    lines = V.table(spark, sf_dir, "events").select("event_id", F.expr(_LOG_LINE).alias("line"))
    return parse_log(lines, "line").select("event_id", F.try_variant_get("entry", "$.k", "bigint").alias("k"))


@query(f"""WITH {V.CHANGES} SELECT ({_TOP})::INTEGER AS rank, vendor || ' ' || plan || ' changed' AS title, 'vendor/' || vendor || '.html' AS link,
  strftime(detected_at, '%Y-%m-%d') || '-' || vendor || '-' || event_id AS guid FROM changes_v QUALIFY rank <= 50""")
def feed_items(spark, sf_dir):
    return history.feed_items(V.changes(spark, sf_dir))


@query(f"WITH {V.CHANGES} SELECT vendor, count(*) AS changes, max(detected_at) AS latest FROM changes_v GROUP BY vendor")
def changes_per_vendor(spark, sf_dir):
    counted = history.changes_per_vendor(V.changes(spark, sf_dir))
    return counted.withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query(f"""WITH {V.CHANGES}, {V.VENDORS}, latest AS (SELECT vendor, max(detected_at::DATE) AS day FROM changes_v GROUP BY vendor),
  known AS (SELECT v.vendor, v.category, l.day FROM vendors_v v LEFT JOIN latest l ON v.vendor = l.vendor)
  SELECT CASE WHEN grouping(vendor) = 0 THEN 'vendor/' || vendor WHEN grouping(category) = 0 THEN 'category/' || category ELSE 'index' END AS page,
    coalesce(max(day), DATE '2023-12-31')::VARCHAR AS lastmod FROM known GROUP BY GROUPING SETS ((vendor), (category), ())""")
def page_lastmod(spark, sf_dir):
    pages = history.page_lastmod(V.changes(spark, sf_dir), V.vendors(spark, sf_dir), F.lit("2023-12-31").cast("date"))
    return pages.withColumn("lastmod", F.col("lastmod").cast("string"))


# Reports

_RECENT = f"{V.CHANGES}, recent_v AS (SELECT * FROM changes_v WHERE detected_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"


def _recent(spark, sf_dir):
    return reports.recent(V.changes(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"WITH {_RECENT} SELECT event_id, vendor, plan, old_value, new_value FROM recent_v")
def digest_recent(spark, sf_dir):
    return _recent(spark, sf_dir).select("event_id", "vendor", "plan", "old_value", "new_value")


@query(f"""WITH {_RECENT}, {V.VENDORS} SELECT coalesce(category, 'uncategorised') AS category, count(*) AS changes, count(DISTINCT r.vendor) AS vendors, max(detected_at) AS latest
  FROM recent_v r LEFT JOIN vendors_v v ON v.vendor = r.vendor GROUP BY 1""")
def digest_by_category(spark, sf_dir):
    digest = reports.digest_by_category(_recent(spark, sf_dir), V.vendors(spark, sf_dir))
    return digest.withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query(f"""WITH {_RECENT}, {V.VENDORS} SELECT r.event_id, r.vendor, r.plan, coalesce(v.category, 'uncategorised') AS category FROM recent_v r LEFT JOIN vendors_v v ON v.vendor = r.vendor""")
def digest_rows(spark, sf_dir):
    return reports.digest_rows(_recent(spark, sf_dir), V.vendors(spark, sf_dir)).select("event_id", "vendor", "plan", "category")


@query(f"WITH {_RECENT} SELECT count(*) AS changes, count(DISTINCT vendor) AS vendors FROM recent_v")
def digest_header(spark, sf_dir):
    return reports.digest_header(_recent(spark, sf_dir))


@query(f"""WITH {V.VENDORS}, {V.PLANS}, {V.CURRENT}, {V.CHANGES} SELECT (SELECT count(*) FROM vendors_v) AS vendors,
  (SELECT count(*) FROM current_v SEMI JOIN vendors_v USING (vendor) WHERE NOT is_addon) AS plans, (SELECT count(*) FROM changes_v) AS changes, '{TODAY}' AS since""")
def grand_totals(spark, sf_dir):
    known = V.vendors(spark, sf_dir)
    own = V.newest(V.plans(spark, sf_dir)).join(known.select("vendor"), "vendor", "left_semi")
    return reports.grand_totals(known, own, V.changes(spark, sf_dir), F.lit(TODAY))


@query(f"""WITH {_EVENTS} SELECT vendor, year, key, change_type, field, confidence, (row_number() OVER (
  ORDER BY confidence, vendor, year, coalesce(key, ''), change_type, coalesce(field, ''), coalesce(old_text, ''), coalesce(new_text, '')))::BIGINT AS rank
  FROM events_v WHERE NOT publishable""")
def review_queue(spark, sf_dir):
    events = _all_events(spark, sf_dir)
    for c in ("key", "field", "old_text", "new_text"):
        events = events.withColumn(f"_{c}", F.coalesce(c, F.lit("")))
    ranked = reports.review_queue(events, ["vendor", "year", "_key", "change_type", "_field", "_old_text", "_new_text"])
    return ranked.select("vendor", "year", "key", "change_type", "field", "confidence", F.col("rank").cast("long").alias("rank"))


@query("""SELECT c_mktsegment, count(*) FILTER (hit) AS shown, count(*) AS total FROM (
  SELECT c_mktsegment, contains(lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment), '99') AS hit FROM customer) GROUP BY 1 HAVING count(*) FILTER (hit) > 0""")
def find_rows(spark, sf_dir):
    return reports.find_rows(V.table(spark, sf_dir, "customer"), " 99 ", ["c_custkey", "c_name", "c_mktsegment"], "c_mktsegment")


_CELL = "CASE WHEN c_custkey % 6 = 0 THEN 'contact us' ELSE '$' || c_custkey || '.5 / month' END"


@query(f"""WITH cells AS (SELECT c_custkey, c_mktsegment, {_CELL} AS cell FROM customer)
  SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY try_cast(nullif(regexp_replace(cell, '[^0-9.-]', '', 'g'), '') AS DOUBLE) DESC NULLS LAST, c_custkey))::INTEGER AS place FROM cells""")
def sort_blanks_last(spark, sf_dir):
    cells = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.expr(_CELL).alias("cell"))
    cells = cells.withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("")))
    placed = places(cells, [reports.numeric_order(F.col("cell"), descending=True), "c_custkey"], ["c_mktsegment"])
    return placed.select("c_custkey", F.col("place").cast("int").alias("place"))


@query(f"""WITH {V.SNAPSHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY day DESC) AS r FROM snap_v),
  o AS (SELECT slug, day, row_number() OVER (PARTITION BY slug, date_trunc('month', day) ORDER BY day) AS k FROM r WHERE r > 60) SELECT slug, day::VARCHAR AS day FROM o WHERE k > 1""")
def prune_snapshots(spark, sf_dir):
    return reports.prunable_snapshots(V.snapshots(spark, sf_dir)).select("slug", F.col("day").cast("string").alias("day"))


@query(f"WITH {V.SNAPSHOTS} SELECT coalesce(min(day), DATE '{TODAY}')::VARCHAR AS since FROM snap_v")
def recording_since(spark, sf_dir):
    return reports.recording_since(V.snapshots(spark, sf_dir), F.lit(TODAY).cast("date")).select(F.col("since").cast("string").alias("since"))


@query("SELECT strftime(ts, '%Y-%m') AS month, round(sum(round(value * 100)::BIGINT) / 100.0::DOUBLE, 6) AS usd FROM events GROUP BY 1")
def spend_by_month(spark, sf_dir):
    # Cents add up exactly in any order.
    cents = V.table(spark, sf_dir, "events").select("ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return reports.spend_by_month(cents, "ts", "cents").select("month", F.round(F.col("usd") / 100.0, 6).alias("usd"))


@query(f"""WITH {V.STATE}, {V.CHANGES}, {V.SNAPSHOTS} SELECT count(*) AS vendors, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failing,
  count(*) FILTER (last_checked < DATE '{TODAY}' - 14) AS stale, max(last_checked)::VARCHAR AS last_run, (SELECT count(*) FROM changes_v) AS changes,
  (SELECT count(*) FROM snap_v) AS snapshots,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS records, (SELECT count(DISTINCT user_id) FROM events) AS pending, (SELECT count(*) FROM changes_v WHERE old_value IS NULL) AS review,
  CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) FILTER (status <> 'ok' OR last_checked < DATE '{TODAY}' - 14) > 0 THEN 'problems' ELSE 'ok' END AS health FROM state_v""")
def status_rollup(spark, sf_dir):
    changes = V.changes(spark, sf_dir)
    stored = (V.readings(spark, sf_dir).select("vendor").distinct(), changes.select("vendor").distinct(), changes.where("old_value IS NULL"))
    row = reports.status_rollup(V.state(spark, sf_dir), changes, V.snapshots(spark, sf_dir), F.lit(TODAY).cast("date"), *stored)
    return row.withColumn("last_run", F.col("last_run").cast("string"))


@query(f"""WITH {V.STATE} SELECT slug, status, CASE status WHEN 'error' THEN 'could not be read' ELSE 'blocked by robots.txt' END AS reason FROM state_v WHERE status <> 'ok'""")
def failing_vendors(spark, sf_dir):
    return reports.failing_vendors(V.state(spark, sf_dir)).select("slug", "status", "reason")


@query(f"WITH {V.STATE} SELECT slug, last_checked::VARCHAR AS last_checked FROM state_v WHERE last_checked < DATE '{TODAY}' - 14")
def stale_vendors(spark, sf_dir):
    return reports.stale_vendors(V.state(spark, sf_dir), F.lit(TODAY).cast("date")).select("slug", F.col("last_checked").cast("string").alias("last_checked"))


_SINCE = "CASE WHEN o_orderkey % 5 = 0 THEN 'someday' ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_DAYS = f"greatest(0, coalesce(date_diff('day', try_cast({_SINCE} AS DATE), DATE '{TODAY}'), 0))"


def _since():
    return F.when(F.col("o_orderkey") % 5 == 0, "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"SELECT o_orderkey, ({_DAYS})::INTEGER AS days FROM orders")
def days_recording(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", reports.days_recording(_since(), F.lit(TODAY).cast("date")).alias("days"))


@query(f"""WITH d AS (SELECT o_orderkey, ({_DAYS})::INTEGER AS days FROM orders)
  SELECT o_orderkey, (CASE WHEN days < 7 THEN 7 - days WHEN days < 30 THEN 30 - days WHEN days < 90 THEN 90 - days WHEN days < 365 THEN 365 - days END)::INTEGER AS days_left FROM d""")
def next_milestone(spark, sf_dir):
    days = reports.days_recording(_since(), F.lit(TODAY).cast("date"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", reports.next_milestone(days).alias("days_left"))


@query(f"""WITH d AS (SELECT o_orderkey, ({_DAYS})::INTEGER AS days FROM orders), t AS (
    SELECT *, CASE WHEN days < 7 THEN 7 WHEN days < 30 THEN 30 WHEN days < 90 THEN 90 WHEN days < 365 THEN 365 END AS target FROM d)
  SELECT o_orderkey, coalesce((target - days) || ' days to ' || target, 'past every milestone') AS milestone FROM t""")
def milestone_text(spark, sf_dir):
    days = reports.days_recording(_since(), F.lit(TODAY).cast("date"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", reports.milestone_text(days).alias("milestone"))


@query("""WITH d AS (SELECT event_id, ts, CASE WHEN date_trunc('day', ts) + INTERVAL 6 HOUR <= ts THEN date_trunc('day', ts) + INTERVAL 30 HOUR
    ELSE date_trunc('day', ts) + INTERVAL 6 HOUR END AS due FROM events),
  s AS (SELECT event_id, floor(epoch(due) - epoch(ts))::BIGINT AS s FROM d)
  SELECT event_id, CASE WHEN s // 3600 < 1 THEN 'in ' || (s // 60) || ' minutes' WHEN s // 3600 >= 2 THEN 'in ' || (s // 3600) || ' hours' ELSE 'in about an hour' END AS wait FROM s""")
def next_check(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", reports.next_check(F.col("ts").cast("timestamp")).alias("wait"))


@query("""WITH d AS (SELECT event_id, event_id % 7 <> 0 AS up, event_id % 5 = 0 AS crawl, event_id % 3 AS problems, event_id % 100 AS days, (event_id // 7) % 3 AS changes FROM events)
  SELECT event_id, CASE WHEN NOT up THEN 'site down' WHEN crawl THEN 'wake the crawl' WHEN problems > 0 THEN 'clear problems' WHEN days < 7 THEN 'wait'
    WHEN changes = 0 AND days >= 21 THEN 'widen' WHEN changes = 0 THEN 'keep waiting' WHEN changes >= 1 AND days < 30 THEN 'tell one person'
    WHEN days >= 30 THEN 'check who came' ELSE 'nothing' END AS advice FROM d""")
def advise(spark, sf_dir):
    i = F.col("event_id")
    said = reports.advise(i % 7 != 0, i % 5 == 0, i % 3, i % 100, F.expr("(event_id div 7) % 3"))
    return V.table(spark, sf_dir, "events").select("event_id", said.alias("advice"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""")
def events_daily_window(spark, sf_dir):
    from tidemark.streaming.windows import daily_counts

    events = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_counts(events).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", "cents")


ORACLES["strip_tags"] = _strip_tags_sql()
