"""SQL that DuckDB runs over the same tables, where SQL can express a query."""

from __future__ import annotations

from textloom.llm import oracle_markup, oracle_truncation

#: Shared head: current rows and articles.
ARTICLES = r"""current_rows AS (
  SELECT * FROM page WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision.id DESC NULLS LAST, loaded_at NULLS LAST) = 1
), article AS (
  SELECT * FROM current_rows WHERE ns = 0 AND redirect IS NULL AND length(title) > 0 AND length(text) > 0
)"""

#: Words of article texts, with counts.
COUNTS = rf"""{ARTICLES}, word AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM article
), tf AS (
  SELECT id, term, count(*) AS tf FROM word GROUP BY ALL
), counts AS (
  SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS records FROM tf GROUP BY term
), marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > 2 * (SELECT count(*) FROM article) THEN 'common' END AS mark FROM counts
)"""

#: The title key of an expression.
KEY = r"translate(lower(regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), ' .:,;-', '')"

#: Where runs of 12 words of an item, or whole shorter items, stand in documents.
LEAKS = r"""d AS (
  SELECT doc_id, regexp_extract_all(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents
), e AS (
  SELECT item_id, regexp_extract_all(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM eval_item
), phrase AS (
  SELECT DISTINCT item_id, least(12, len(w)) AS n, unnest([array_to_string(w[i : i + least(12, len(w)) - 1], ' ') FOR i IN range(1, greatest(len(w) - 12, 0) + 2)]) AS p FROM e WHERE len(w) > 0
), size AS (SELECT DISTINCT n FROM phrase), run AS (
  SELECT doc_id, n, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS p, unnest(range(len(w) - n + 1)) AS a FROM d, size WHERE len(w) >= n
), hit AS (SELECT DISTINCT item_id, doc_id, a, a + n AS b FROM phrase JOIN run USING (n, p))"""



def pairs(width: int, similar: str) -> str:
    """CTEs up to pair(a, b, similarity): texts that are alike, copies standing in as their least id."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""{ARTICLES}, words AS (
  SELECT id, min(id) OVER (PARTITION BY lower(title || ' ' || text)) AS rep, regexp_extract_all(lower(title || ' ' || text), '[\p{{L}}\p{{N}}]+') AS w FROM article
), shingle AS (
  SELECT DISTINCT id, unnest([{run} FOR i IN range(1, len(w) - {width - 2})]) AS s FROM words WHERE id = rep AND len(w) >= {width}
), size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id
), common AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.id < b.id GROUP BY ALL
), pair AS (
  SELECT common.a, common.b, common.n / (x.n + y.n - common.n) AS similarity FROM common JOIN size x ON x.id = common.a JOIN size y ON y.id = common.b
  WHERE common.n * 10 >= {similar} * (x.n + y.n - common.n)
)"""


#: Places where long texts may be cut, and how good a place each is.
CUTS = r"""long AS (SELECT id, text, length(text) AS n FROM article WHERE length(text) > 4000
), parts AS (
  SELECT id, unnest(regexp_extract_all(text, '\S+|\s+')) AS part, unnest(range(len(regexp_extract_all(text, '\S+|\s+')))) AS k FROM long
), placed AS (
  SELECT *, (sum(length(part)) OVER (PARTITION BY id ORDER BY k))::BIGINT AS after, lag(part) OVER (PARTITION BY id ORDER BY k) AS before FROM parts
), gap AS (SELECT id, part, before, after - length(part) AS p, after AS q FROM placed WHERE regexp_matches(part, '^\s')
), cut AS (
  SELECT id, q AS pos, 1 AS level FROM gap
  UNION ALL SELECT id, p + 1, 2 FROM gap WHERE before[-1] IN (',', ':')
  UNION ALL SELECT id, p + 1, 3 FROM gap WHERE before[-1] = ';'
  UNION ALL SELECT id, q, 4 FROM gap WHERE regexp_matches(before, '[.!?…]["''»“)\]]*$')
  UNION ALL SELECT id, p + i, 5 FROM (SELECT id, p, part, unnest(range(1, length(part) + 1)) AS i FROM gap) WHERE part[i] = chr(10)
  UNION ALL SELECT id, p + length(regexp_extract(part, '^.*\n[^\S\n]*\n+')), 6 FROM gap WHERE regexp_matches(part, '\n[^\S\n]*\n')
), best AS (SELECT id, pos, max(level) AS level FROM cut GROUP BY ALL
), piece(id, piece, start, new_from, stop, text, n) AS (
  SELECT id, 0, 0::BIGINT, 0::BIGINT, coalesce((SELECT max(level::BIGINT * 1000000000 + pos) % 1000000000 FROM best WHERE best.id = long.id AND pos BETWEEN 2000 AND 4000), 4000), text, n FROM long
  UNION ALL
  SELECT id, piece + 1, s, stop, CASE WHEN n - s <= 4000 THEN n ELSE coalesce((SELECT max(level::BIGINT * 1000000000 + pos) % 1000000000 FROM best WHERE best.id = x.id AND pos BETWEEN greatest(s + 2000, stop + 1) AND s + 4000), s + 4000) END, text, n
  FROM (SELECT *, coalesce((SELECT min(q) FROM gap WHERE gap.id = piece.id AND q >= greatest(start + 1, stop - 200) AND q < stop), greatest(start + 1, stop - 200)) AS s FROM piece WHERE stop < n) x
)"""

SQL = {
    "p3_found": f"""WITH {COUNTS}, scored AS (
  SELECT id, term, tf * ln((SELECT count(*) FROM article)::DOUBLE / records) AS score FROM tf JOIN counts USING (term) WHERE records >= 2
), best AS (SELECT id, max(score) AS top FROM scored GROUP BY id)
SELECT id, term FROM scored JOIN best USING (id) WHERE score >= top - 1e-12 * abs(top)""",
    "p3_log_odds": f"""WITH {COUNTS}, total AS (SELECT sum(tf)::DOUBLE AS c FROM tf), len AS (SELECT id, sum(tf)::DOUBLE AS n FROM tf GROUP BY id
), part AS (
  SELECT id, term, tf, occurrences, records, n, c, tf + 1000 * occurrences / c AS a, occurrences - tf + 1000 * occurrences / c AS b
  FROM tf JOIN counts USING (term) JOIN len USING (id), total WHERE records >= 2
), scored AS (
  SELECT *, (ln(a / (n + 1000 - a)) - ln(b / (c - n + 1000 - b))) / sqrt(1 / a + 1 / b) AS z FROM part
), best AS (SELECT id, max(z) AS top FROM scored GROUP BY id)
SELECT id, term, tf, occurrences, records, round(z, 6) AS z FROM scored JOIN best USING (id) WHERE z >= top - 1e-12 * abs(top)""",
    "p4_found": rf"""WITH {ARTICLES}, words AS (
  SELECT id, regexp_extract_all(lower(title || ' ' || text), '[\p{{L}}\p{{N}}]+') AS w FROM article
), shingle AS (
  SELECT DISTINCT id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM words WHERE len(w) >= 3
), size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id
), common AS (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.id < b.id GROUP BY ALL
)
SELECT id_a, id_b FROM common JOIN size a ON a.id = id_a JOIN size b ON b.id = id_b WHERE common.n * 10 >= 6 * (a.n + b.n - common.n)""",
    "p4_pairs": f"WITH {pairs(3, '6')} SELECT a, b, similarity FROM pair",
    "p4_groups": f"""WITH RECURSIVE {pairs(5, '8')}, both_ways AS (SELECT a AS x, b AS y FROM pair UNION SELECT b, a FROM pair
), reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y
), grp AS (SELECT x, min(y) AS g FROM reach GROUP BY x), link AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT id, coalesce(g, rep) AS group_id, coalesce(n, 0) AS n_links FROM words LEFT JOIN grp ON grp.x = rep LEFT JOIN link ON link.x = rep""",
    "p6_pieces": f"""WITH RECURSIVE {ARTICLES}, {CUTS}
SELECT id, piece, start, new_from, stop AS end, text[start + 1 : stop] AS content FROM piece""",
    "p6_tiling": f"WITH {ARTICLES} SELECT id, md5(text) AS digest, true AS within, true AS overlaps FROM article WHERE length(text) > 4000",
    "p9_limits": """WITH t AS (SELECT source, max(target_share) AS share FROM mix_target WHERE source IS NOT NULL GROUP BY source
), n AS (SELECT source, count(*) AS documents FROM documents WHERE length(text) > 0 GROUP BY source)
SELECT source, coalesce(documents, 0)::BIGINT AS documents, true AS within, true AS reached FROM t LEFT JOIN n USING (source)""",
    "p5_found": rf"""WITH RECURSIVE {ARTICLES}, node AS (
  SELECT id, {KEY.format('title')} AS k, {KEY.format('redirect._title')} AS r FROM current_rows WHERE length(title) > 0
), keys AS (SELECT k, min(id) AS v FROM node GROUP BY k
), edge AS (
  SELECT DISTINCT a.v AS x, b.v AS y FROM node JOIN keys a ON a.k = node.k JOIN keys b ON b.k = node.r WHERE a.v <> b.v
), both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge
), reach(x, y) AS (
  SELECT v, v FROM keys UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y
), grp AS (SELECT x, min(y) AS group_id FROM reach GROUP BY x
), member AS (SELECT node.id, group_id FROM node JOIN keys USING (k) JOIN grp ON grp.x = keys.v)
SELECT id, group_id FROM member WHERE group_id IN (SELECT group_id FROM member GROUP BY 1 HAVING count(*) > 1)""",
    "p6_found": f"WITH {ARTICLES} SELECT id FROM article WHERE length(text) > 4000",
    "p7_terms": f"WITH {COUNTS} SELECT term, occurrences, records, mark FROM marked",
    "p7_found": f"WITH {COUNTS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p8_found": f"WITH {LEAKS} SELECT DISTINCT item_id, doc_id FROM hit",
    "p8_spans": rf"""WITH {LEAKS}, fresh AS (
  SELECT *, coalesce(a > max(b) OVER (PARTITION BY item_id, doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM hit
), island AS (SELECT *, sum(new) OVER (PARTITION BY item_id, doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM fresh
), span AS (SELECT item_id, doc_id, min(a)::INTEGER AS first_word, max(b)::INTEGER AS end_word FROM island GROUP BY item_id, doc_id, k
), raw AS (
  SELECT doc_id, len(w) AS n, [length(x) FOR x IN regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')] AS w, [length(x) FOR x IN string_split_regex(text, '[\p{{L}}\p{{N}}]+')] AS gap
  FROM documents JOIN d USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM span)
)
SELECT item_id, doc_id, first_word, end_word,
  CASE WHEN len(raw.w) = n THEN (list_sum(gap[1:first_word + 1]) + coalesce(list_sum(raw.w[1:first_word]), 0))::INTEGER ELSE -1 END AS start,
  CASE WHEN len(raw.w) = n THEN (list_sum(gap[1:end_word]) + list_sum(raw.w[1:end_word]))::INTEGER ELSE -1 END AS end
FROM span JOIN raw USING (doc_id)""",
    **oracle_truncation.SQL,
    **oracle_markup.queries(ARTICLES),
}
