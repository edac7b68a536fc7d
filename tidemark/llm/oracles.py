"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

#: Words: runs of anything but space and U+0009 to U+000D.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len({_WORDS.format(text='text')}), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         2.0::DOUBLE * source_size AS cap
  FROM sizes
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN level * w < cap THEN level END) OVER () * w, cap))::DOUBLE AS target
  FROM leveled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM targets
), hashes AS (
  SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h
), running AS (
  SELECT source, h, words,
         sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - words AS before
  FROM hashes
), boundary AS (
  SELECT b.source, max(struct_pack(h := h, before := before, words := words)) AS m
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WHERE r.words > 0 AND r.before <= b.target - b.repeats * b.source_size
  GROUP BY b.source
)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.repeats + CASE WHEN s.h < m.h
          OR (s.h = m.h AND (b.target - b.repeats * b.source_size - m.before) * 2 >= m.words) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN boundary ON boundary.source IS NOT DISTINCT FROM s.source
"""

_COMPONENTS = """
reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
)"""

OP2 = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_COMPONENTS}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id
LEFT JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) r ON r.id = vec_id
"""



def _op3() -> str:
    levels = []
    for d in range(6):
        seg = f"segs[{d + 1}]"
        levels.append(f"""c{d} AS (
  SELECT host, template, {seg} AS seg, sum(n) AS of_seg FROM p{d} WHERE len(segs) > {d} GROUP BY ALL
), f{d} AS (
  SELECT *, count(*) OVER (PARTITION BY host, template) AS kinds, sum(of_seg) OVER (PARTITION BY host, template) AS of_all FROM c{d}
), p{d + 1} AS (
  SELECT p.host, p.path, p.segs, p.n, p.b, p.l,
         CASE WHEN len(segs) > {d} THEN p.template || '/' || CASE WHEN f.kinds > 12 AND f.of_seg < 0.05::DOUBLE * f.of_all THEN '?' ELSE {seg} END
              ELSE p.template END AS template
  FROM p{d} p LEFT JOIN f{d} f ON f.host = p.host AND f.template = p.template AND f.seg = {seg}
)""")
    # The purity of each level comes from that above: a template has seven steps at most.
    down = []
    for d in range(1, 8):
        down.append(f"""q{d} AS (
  SELECT q.host, q.template, CASE WHEN j.node IS NULL THEN q.purity ELSE
    (j.b + 4.0::DOUBLE * q.purity + 4.0::DOUBLE / (j.ol + 4.0::DOUBLE) * j.ob) / (j.l + 4.0::DOUBLE + 4.0::DOUBLE / (j.ol + 4.0::DOUBLE) * j.ol) END AS purity
  FROM q{d - 1} q LEFT JOIN steps s ON s.host = q.host AND s.template = q.template AND s.depth = {d} LEFT JOIN judged j ON j.host = s.host AND j.node = s.node
)""")
    return f"""
WITH parts AS (
  SELECT page_id, {_LOWER.format(text="coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
), known AS (
  SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM ruled
), p0 AS (
  SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, count(*) AS n,
         count(*) FILTER (ruled = 'block') AS b, count(ruled) AS l, '' AS template
  FROM known GROUP BY host, path
), {", ".join(levels)}, paths AS (
  SELECT host, path, b, l, CASE WHEN len(segs) > 6 THEN template || '/??' ELSE template END AS template FROM p6
), leaves AS (
  SELECT host, template, sum(b) AS b, sum(l) AS l FROM paths GROUP BY ALL
), hosts AS (
  SELECT host, array_to_string(string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-2:], '.') AS domain, sum(b) AS b, sum(l) AS l FROM leaves GROUP BY ALL
), domains AS (
  SELECT domain, (sum(b) + 4.0::DOUBLE * (SELECT coalesce(sum(b) / nullif(sum(l), 0), 0) FROM hosts)) / (sum(l) + 4.0::DOUBLE) AS purity FROM hosts GROUP BY domain
), steps AS (
  SELECT host, template, b, l, d AS depth, array_to_string(string_split(template, '/')[1:d + 1], '/') AS node, array_to_string(string_split(template, '/')[1:d], '/') AS parent
  FROM (SELECT *, unnest(range(1, len(string_split(template, '/')))) AS d FROM leaves)
), nodes AS (
  SELECT host, parent, node, sum(b) AS b, sum(l) AS l FROM steps GROUP BY ALL
), pooled AS (
  SELECT *, sum(b) OVER w / nullif(sum(l) OVER w, 0) AS pool FROM nodes WINDOW w AS (PARTITION BY host, parent)
), named AS (
  SELECT *, CASE WHEN abs(b / nullif(l, 0) - pool) <= 1.96::DOUBLE * sqrt(pool * (1 - pool) / nullif(l, 0)) THEN '#' ELSE node END AS branch FROM pooled
), judged AS (
  SELECT host, node, sum(b) OVER w AS b, sum(l) OVER w AS l, sum(b) OVER e - b AS ob, sum(l) OVER e - l AS ol
  FROM named WINDOW w AS (PARTITION BY host, parent, branch), e AS (PARTITION BY node)
), q0 AS (
  SELECT v.host, v.template, (h.b + 4.0::DOUBLE * d.purity) / (h.l + 4.0::DOUBLE) AS purity FROM leaves v JOIN hosts h ON h.host = v.host JOIN domains d ON d.domain = h.domain
), {", ".join(down)}
SELECT page_id, k.host, k.path, k.rule, coalesce(k.ruled, CASE WHEN q7.purity >= 0.75 THEN 'block' ELSE 'allow' END) AS verdict
FROM known k JOIN paths p ON p.host = k.host AND p.path = k.path JOIN q7 ON q7.host = p.host AND q7.template = p.template
"""


OP3 = _op3()

OP5 = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP7 = f"""
WITH words AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM words
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS content FROM places
), earliest AS (
  SELECT content, min(struct_pack(d := doc_id, p := pos)) AS e FROM windows GROUP BY content HAVING count(*) > 1
), starts AS (
  SELECT doc_id, pos FROM windows JOIN earliest USING (content) WHERE doc_id <> e.d OR pos >= e.p + 50
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 50)))) AS g FROM starts GROUP BY doc_id
), edges AS (
  SELECT doc_id, g, list_sort(list_filter(g, lambda x: NOT list_contains(g, x - 1))) AS a, list_sort(list_filter(g, lambda x: NOT list_contains(g, x + 1))) AS b FROM gone
)
SELECT w.doc_id, coalesce(len(g), 0)::BIGINT AS n_removed,
       coalesce(array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || ':' || (b[i] + 1)), ','), '') AS removed,
       sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i - 1)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN edges e ON e.doc_id = w.doc_id
"""

OP9 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
{_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) r ON r.id = doc_id
"""

OP10 = """
WITH bits AS (
  SELECT page_id, coalesce(html, '') AS html,
         array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c:
           ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
           [strpos('0123456789abcdef', c)]), '') AS b
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           16 * substr(b, i * 5 + 1, 1)::INTEGER + 8 * substr(b, i * 5 + 2, 1)::INTEGER + 4 * substr(b, i * 5 + 3, 1)::INTEGER
           + 2 * substr(b, i * 5 + 4, 1)::INTEGER + substr(b, i * 5 + 5, 1)::INTEGER)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER (PARTITION BY html) THEN max(page_id) OVER (PARTITION BY html) END AS refers_to
FROM bits
"""

OP11 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), marks AS (
  SELECT doc_id, part,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS m
  FROM texts
), known AS (
  SELECT doc_id, coalesce(max((quality = 1)::INTEGER), 0) AS good, coalesce(max((toxic = 1)::INTEGER), 0) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM marks LEFT JOIN known ON known.doc_id = marks.doc_id GROUP BY part, m
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), told AS (
  SELECT part, o, step, s.f, n, good, bad, strpos(m, s.f) > 0 AS fails, m = s.f AS alone,
         length(translate(m, before, '')) < length(m) AS earlier
  FROM cells, steps s
), summed AS (
  SELECT part, o, step, f,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM told GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""

#: ``formatted_chars`` counts the marks too: 24 a turn, and a backslash for each escape.
OP12 = r"""
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(role) + length(text) + 24
    + len(regexp_extract_all(role || chr(10) || text, '<\\*(\||s>|/s>|SYS>|/SYS>|bos>|eos>|start_of_turn>|end_of_turn>)|\[\\*/?INST\]')) AS chars
  FROM chats
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn ASC NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""



def _op13(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain rounds: every part against every entry of its codebook."""
    dot = "list_inner_product({0}, {1})".format
    steps = [
        f"""cut AS (
  SELECT vec_id, label, p, list_transform(embedding[1 + p * len(embedding) // {parts} : (p + 1) * len(embedding) // {parts}], lambda x: floor(x::DOUBLE * 1024)) AS x
  FROM embeddings, (SELECT unnest(range({parts})) AS p)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {entries}
)"""
    ]
    for turn in range(rounds + 1):
        d = f"{dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')}"
        steps.append(f"""near{turn} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, cut.p, any_value(x) AS x, min(struct_pack(d := {d}, e := e)) AS m
  FROM cut JOIN book{turn} b ON b.p = cut.p GROUP BY vec_id, cut.p
)""")
        if turn < rounds:
            steps.append(f"""mean{turn} AS (
  SELECT p, e, list(v ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(v) / count(*)) AS v
    FROM (SELECT p, m.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{turn}) GROUP BY p, e, i
  ) GROUP BY p, e
), book{turn + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn} n ON n.p = b.p AND n.e = b.e
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id
), said AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS s
  FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM book{rounds})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, said
"""


OP13 = _op13()

ORACLES = {
    "op1_mixing": OP1,
    "op2_embedding_near_dedup": OP2,
    "op3_url_filter": OP3,
    "op5_nearest_neighbours": OP5,
    "op7_line_dedup": OP7,
    "op9_ngram_jaccard_join": OP9,
    "op10_warc": OP10,
    "op11_filter_audit": OP11,
    "op12_chat_format": OP12,
    "op13_vector_codes": OP13,
}
