"""What the queries must return, in DuckDB's SQL."""

from __future__ import annotations

from strandmill.llm.linkgraph import DAMPING, MAX_DISTRUST, Rule, rounds_to

#: The rules that the url filter query is to apply.
PAGE_RULES: list[Rule] = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]

# ------------------------------------------------------------------------ preference pairs

_RENDERED = "'<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)"


def _joined(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: {_RENDERED}), '')"


def _mask(turns: str) -> str:
    """Spans from running lengths: turn i begins after the rendered turns before it."""
    before = (
        f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length({_RENDERED}))), 0)"
    )
    head = f"length('<|' || coalesce({turns}[i].role, '') || '|>' || chr(10))"
    whole = f"length({_RENDERED.replace('t.', f'{turns}[i].')})"
    spans = (
        f"list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), "
        f"lambda i: CAST({before} + {head} AS BIGINT) || '-' || CAST({before} + {whole} AS BIGINT))"
    )
    return f"coalesce(array_to_string({spans}, ','), '')"


def preference_sql() -> str:
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ), ends AS (
      SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS last
      FROM turns WHERE role = 'assistant' GROUP BY conv_id
    ), ending AS (
      SELECT e.conv_id, e.last.turn AS last_turn, p.last.text AS other, p.conv_id IS NOT NULL AS answered
      FROM ends e LEFT JOIN ends p ON p.conv_id = xor(e.conv_id, 1)
    ), placed AS (
      SELECT t.*, e.last_turn, e.other, e.answered, coalesce(turn = last_turn AND role = 'assistant', false) AS ends_it
      FROM turns t LEFT JOIN ending e USING (conv_id)
    ), sides AS (
      SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM turns
      UNION ALL
      SELECT conv_id, 'rejected', turn, role, CASE WHEN ends_it THEN other ELSE text END
      FROM placed WHERE (last_turn IS NULL OR turn <= last_turn) AND (NOT ends_it OR answered)
    ), listed AS (
      SELECT pair_id,
             list_sort(coalesce(list(DISTINCT struct_pack(turn := turn, role := role, text := text))
               FILTER (side = 'chosen'), [])) AS a,
             list_sort(coalesce(list(DISTINCT struct_pack(turn := turn, role := role, text := text))
               FILTER (side = 'rejected'), [])) AS b
      FROM sides GROUP BY pair_id
    ), measured AS (
      SELECT *, CAST(coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i:
               i <= len(a) AND i <= len(b) AND a[i].role IS NOT DISTINCT FROM b[i].role
               AND a[i].text IS NOT DISTINCT FROM b[i].text), false), 0) AS INTEGER) AS other_at FROM listed
    ), cut AS (
      SELECT pair_id, CASE WHEN other_at = 0 THEN CAST(greatest(len(a), len(b)) AS INTEGER)
             ELSE other_at - 1 END AS n_prompt_turns, a, b FROM measured
    ), parts AS (
      SELECT pair_id, n_prompt_turns, a[1:n_prompt_turns] AS p, a[n_prompt_turns + 1:] AS c,
             b[n_prompt_turns + 1:] AS r FROM cut
    )
    SELECT pair_id, n_prompt_turns, {_joined('p')} AS prompt, {_joined('c')} AS chosen,
           {_joined('r')} AS rejected, {_mask('c')} AS chosen_mask, {_mask('r')} AS rejected_mask
    FROM parts
    """


# ------------------------------------------------------------------------ url filters


def url_filter_sql(rules: list[Rule], rounds: int = rounds_to()) -> str:
    listed = ", ".join(
        f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')"
        for verdict, rule in rules
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"translate(coalesce(regexp_extract({{}}, '://([^/?#]*)', 1), ''), '{upper}', '{lower}')"
    steps = ["r0 AS MATERIALIZED (SELECT kind, host, score FROM base)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
          SELECT kind, host, score FROM base UNION ALL
          SELECT s.kind, s.dst, {DAMPING} * r.score * s.share FROM r{i - 1} r JOIN shares s
          ON r.kind = s.kind AND r.host = s.src) GROUP BY ALL)""")
    return f"""
    WITH rules(verdict, rule, domain, prefix) AS (VALUES {listed}),
    parts AS (
      SELECT row_number() OVER () AS n, page_id, html, {host.format('url')} AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
    ), fits AS (
      SELECT n, max(struct_pack(size := length(rule), blocks := rule_verdict = 'block', rule := rule)) AS best
      FROM parts JOIN (SELECT *, verdict AS rule_verdict FROM rules) r
      ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY n
    ), judged AS (
      SELECT p.*, best.rule AS rule,
             CASE WHEN best IS NULL THEN NULL WHEN best.blocks THEN 'block' ELSE 'allow' END AS ruled
      FROM parts p LEFT JOIN fits USING (n)
    ), found AS (
      SELECT host AS src, unnest(regexp_extract_all(html,
        '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM parts
    ), links AS MATERIALIZED (
      SELECT src, dst, count(*) AS n FROM (
        SELECT src, {host.format("':' || regexp_replace(link, '(?i)^https?:', '')")} AS dst FROM found)
      WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
    ), shares AS MATERIALIZED (
      SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links
    ), base AS MATERIALIZED (
      SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
             (1 - {DAMPING}::DOUBLE) * count(*) AS score
      FROM judged WHERE host <> '' AND ruled IS NOT NULL GROUP BY ALL
    ), {', '.join(steps)},
    scores AS (
      SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust,
             coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
      FROM r{rounds} GROUP BY host
    )
    SELECT page_id, j.host, path, rule, coalesce(ruled, CASE
      WHEN round(distrust / (trust + distrust), 9) > {MAX_DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN scores s ON j.host = s.host
    """


# ------------------------------------------------------------------------ revisits

_CANONICAL = """
  CASE WHEN host <> '' THEN host || regexp_replace(regexp_extract(target_uri, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')
    || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(list_sort(params), '&') END END
"""

WARC_SQL = f"""
WITH pages_at AS (
  SELECT page_id, url, html, 1700000000 + (page_id * 7919) % 1000003 AS ts,
         '"' || substr(md5(html), 1, 16) || '"' AS tag,
         CASE WHEN page_id % 5 = 0 THEN -100 ELSE 3600 + page_id % 1000 END AS later FROM pages
), records AS (
  SELECT 2 * page_id AS id, true AS serves, url AS target_uri, ts, tag,
         CAST(length(html) AS VARCHAR) AS size, sha256(html) AS digest, NULL AS age FROM pages_at
  UNION ALL
  SELECT 2 * page_id + 1, false, CASE WHEN page_id % 3 = 0 THEN url || '#part' ELSE url END, ts + later,
         CASE WHEN page_id % 7 = 0 THEN '"stale"' WHEN page_id % 4 = 1 THEN 'W/' || tag ELSE tag END,
         NULL, NULL, CAST(page_id % 60 AS VARCHAR) FROM pages_at
), cut AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(target_uri,
           '^[^:/?#]+://([^/?#]*)', 1)), '^[^@]*@', ''), '(:(80|443)?)$', ''), '^www\\.', '') AS host,
         list_filter(string_split(regexp_extract(target_uri, '^[^:/?#]+://[^/?#]*[^?#]*\\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^utm_[^=]*(=|$)')) AS params
  FROM records
), keyed AS (SELECT *, {_CANONICAL} AS key FROM cut),
found AS (
  SELECT *, last_value(CASE WHEN serves THEN struct_pack(id := id, tag := tag, size := size, digest := digest) END
           IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, serves, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM keyed WHERE key IS NOT NULL AND ts IS NOT NULL
  UNION ALL SELECT *, NULL FROM keyed WHERE key IS NULL OR ts IS NULL
), judged AS (
  SELECT *, CASE WHEN f IS NULL THEN 'missing'
                 WHEN coalesce(regexp_replace(tag, '^[Ww]/', '') = regexp_replace(f.tag, '^[Ww]/', ''), false)
                 THEN 'resolved' ELSE 'changed' END AS outcome
  FROM found WHERE NOT serves
)
SELECT id AS record_id, key AS canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN f.id END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || age || chr(10) || 'content-length: ' || f.size
         || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(ts AS VARCHAR) || chr(10)
         || 'etag: ' || tag || chr(10) || 'server: first' END AS headers,
       CASE WHEN outcome = 'resolved' THEN f.digest END AS payload_digest
FROM judged
"""

# ------------------------------------------------------------------------ shingles

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"


_GRAMS = """CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"""

LEAKS_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, {_GRAMS} AS g
  FROM (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
  WHERE len(w) > 0
), items AS (
  SELECT item_id, g, len(g) AS size FROM (SELECT DISTINCT item_id, {_GRAMS} AS g
  FROM (SELECT item_id, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
  WHERE len(w) > 0)
), item_grams AS (
  SELECT item_id, g, size, gram, count(*) AS theirs
  FROM (SELECT item_id, g, size, unnest(g) AS gram FROM items) GROUP BY ALL
), hits AS MATERIALIZED (
  SELECT row_no, doc_id, n, pos, gram FROM (
    SELECT row_no, doc_id, len(g) AS n, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS pos FROM docs)
  WHERE gram IN (SELECT gram FROM item_grams)
), windows AS (
  SELECT DISTINCT row_no, doc_id, n, size, least(pos, greatest(n - size, 0)) AS start
  FROM hits JOIN (SELECT DISTINCT gram, size FROM item_grams) USING (gram)
), counted AS (
  SELECT w.row_no, w.doc_id, w.n, w.size, w.start, i.item_id, i.g, i.theirs, h.gram, count(*) AS ours
  FROM windows w JOIN hits h ON h.row_no = w.row_no AND h.pos >= w.start AND h.pos < w.start + w.size
  JOIN item_grams i ON i.size = w.size AND i.gram = h.gram GROUP BY ALL
), shared AS (
  SELECT row_no, doc_id, size, start, item_id, least(n, size) + size AS total, sum(least(ours, theirs)) AS shared
  FROM counted GROUP BY row_no, doc_id, n, size, start, item_id, g
), near AS (
  SELECT *, shared / (total - shared) AS similarity FROM shared WHERE 100 * shared >= 80 * (total - shared)
)
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, count(DISTINCT (size, start)) AS n_windows,
       CAST(min(start) FILTER (similarity = top) AS INTEGER) AS start
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS top FROM near)
GROUP BY doc_id, item_id
"""

LINKS_SQL = f"""
WITH RECURSIVE sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct({_GRAMS}) END AS s
  FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_words('text')} END AS w FROM documents)
), grams AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, hash(gram) AS gram FROM (SELECT doc_id, s, unnest(s) AS gram FROM sets)
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS shared
    FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL)
  WHERE 100 * shared >= 80 * (n + m - shared)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1) k USING (doc_id)
"""

# --------------------------------------------------------------------- fill in the middle

FIM_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1,
         CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3,
         CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM docs
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m,
         array_to_string(units[high + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# --------------------------------------------------------------------------- collocations

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents
), placed AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS gram, CAST(count(*) AS BIGINT) AS f
  FROM placed, (VALUES (1), (2), (3)) sizes(k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), split AS (
  SELECT lang, k, gram, f, string_split(gram, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT s.lang, s.k, s.gram, s.f AS a, cut, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * s.f * s.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM split) s
  JOIN grams x ON x.lang = s.lang AND x.k = cut AND x.gram = array_to_string(w[1:cut], ' ')
  JOIN grams y ON y.lang = s.lang AND y.k = s.k - cut AND y.gram = array_to_string(w[cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1
), covering AS (
  SELECT lang, gram, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS gram, f FROM split WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM split WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN covering c ON b.k = 2 AND b.lang = c.lang AND b.gram = c.gram
  WHERE c.f IS NULL OR 100 * c.f < 50 * b.a
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank,
       gram AS phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
