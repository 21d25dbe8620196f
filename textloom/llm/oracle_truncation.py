"""SQL for the truncation queries, written apart from the operator."""

from __future__ import annotations

BLANKS = "(chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))"
STOPS = "('.', '?', '!', chr(10))"
TOKEN = r"'[\p{L}\p{N}]+|[.?!]+(?:\s|\z)|\n'"


def form(x: str) -> str:
    """Class of a token."""
    return f"""CASE WHEN {x} IS NULL OR {x}[1] IN {STOPS} THEN '.' WHEN {x}[1] BETWEEN '0' AND '9' THEN '0'
    WHEN length({x}) > 5 AND {x}[1] <> lower({x}[1]) THEN 'N' WHEN length({x}) <= 6 THEN {x} ELSE '~' || right({x}, 3) END"""


PAIRS = r"[['[[', ']]'], ['{{', '}}'], ['{|', '|}'], ['<!--', '-->'], ['\begin{', '\end{']]"
ELEMENTS = "['ref', 'pre', 'source', 'syntaxhighlight', 'math', 'nowiki', 'gallery', 'table', 'code']"
LOOSE = r"'[\p{L}\p{N}]$'"


def rate(k: int, own: str) -> str:
    return f"CASE WHEN t{k}.n - {own} >= 3 THEN (t{k}.ends - {own}) / (t{k}.n - {own}) END"


#: Why texts count as cut off.
CUT = rf"""doc AS (
  SELECT doc_id, source, rtrim(text, {BLANKS}) AS t, text LIKE '% ' AS blank, length(text) AS chars, strlen(text) AS bytes FROM documents
), tok AS (
  SELECT *, regexp_extract_all(t, {TOKEN}) AS k, string_split(t, chr(10))[-1] AS line, string_split(t, chr(10) || chr(10))[-1] AS para,
    rtrim(CASE WHEN regexp_matches(t, '(…|\.\.\.)\]$') THEN rtrim(t, '[…].' || {BLANKS}) WHEN regexp_matches(t, '(…|\.\.\.)$') THEN rtrim(t, '….' || {BLANKS}) ELSE t END, ',;:–-' || chr(65533) || {BLANKS}) AS core
  FROM doc WHERE length(t) > 0
), placed AS (
  SELECT k, unnest(range(1, len(k))) AS i FROM tok
), each AS (
  SELECT CASE WHEN i < 3 OR {form('k[i - 1]')} = '.' THEN '.' ELSE {form('k[i - 2]')} END AS a, CASE WHEN i < 2 THEN '.' ELSE {form('k[i - 1]')} END AS b, {form('k[i]')} AS c,
    k[i] AS word, k[i + 1][1] IN {STOPS} AS e FROM placed WHERE k[i][1] NOT IN {STOPS}
), words AS (SELECT word, count(*) AS n FROM each GROUP BY word
), begins AS (
  SELECT last, sum(CASE WHEN last = word THEN 0 ELSE n END) > 50 * sum(CASE WHEN last = word THEN n ELSE 0 END) AS part
  FROM (SELECT word, n, unnest([word[1:m] FOR m IN range(1, length(word) + 1)]) AS last FROM words) GROUP BY last
), per_source AS (SELECT source, count(DISTINCT t) AS n FROM tok GROUP BY source
), sized AS (SELECT DISTINCT source, kind, size, t FROM (SELECT source, t, 'c' AS kind, chars AS size FROM tok UNION ALL SELECT source, t, 'b', bytes FROM tok)
), limits AS (
  SELECT s.source, kind, size FROM sized s JOIN per_source p ON p.source IS NOT DISTINCT FROM s.source GROUP BY s.source, kind, size, p.n HAVING count(*) >= 5 AND count(*) * 50 >= p.n
), tail AS (
  SELECT *, CASE WHEN regexp_matches(core, {LOOSE}) THEN regexp_extract_all(string_split(core, chr(10))[-1], {TOKEN}) END AS z, regexp_matches(line, {LOOSE}) AS loose,
    regexp_matches(line, '^[ \t]*([*#+-]|[0-9]+\.)[ \t]') AS entry FROM tok
), last AS (
  SELECT *, z[-1] AS last, {form('z[-1]')} AS c, CASE WHEN z IS NULL OR len(z) < 2 THEN '.' ELSE {form('z[-2]')} END AS b,
    CASE WHEN z IS NULL OR len(z) < 3 OR {form('z[-2]')} = '.' THEN '.' ELSE {form('z[-3]')} END AS a FROM tail
), inside AS (SELECT a, b, c, count(*) AS n, sum(e::INT) AS ends FROM each GROUP BY ALL
), t3 AS (
  SELECT a, b, c, sum(n) AS n, sum(ends) AS ends
  FROM (SELECT * FROM inside UNION ALL SELECT a, b, c, count(DISTINCT t), count(DISTINCT t) FROM last WHERE loose GROUP BY ALL) GROUP BY ALL
), t2 AS (SELECT b, c, sum(n) AS n, sum(ends) AS ends FROM t3 GROUP BY ALL
), t1 AS (SELECT c, sum(n) AS n, sum(ends) AS ends FROM t3 GROUP BY ALL
), t0 AS (SELECT a, b, sum(n) AS n, sum(ends) AS ends FROM inside GROUP BY ALL
), rated AS (
  SELECT l.*, coalesce(part, false) AND l.c <> '0' AS part, {rate(0, '0')} AS p0, coalesce({rate(3, 'loose::INT')}, {rate(2, 'loose::INT')}, {rate(1, 'loose::INT')}) AS p,
    EXISTS (SELECT 1 FROM limits x WHERE x.source IS NOT DISTINCT FROM l.source AND (kind = 'c' AND size = chars OR kind = 'b' AND bytes BETWEEN size - 3 AND size)) AS at_limit
  FROM last l LEFT JOIN t3 ON t3.a = l.a AND t3.b = l.b AND t3.c = l.c LEFT JOIN t2 ON t2.b = l.b AND t2.c = l.c LEFT JOIN t1 ON t1.c = l.c LEFT JOIN t0 ON t0.a = l.a AND t0.b = l.b
    LEFT JOIN begins ON begins.last = l.last
), judged AS (
  SELECT doc_id, source, CASE
    WHEN last IS NOT NULL AND NOT entry AND coalesce(CASE WHEN NOT part THEN p END, p0, 1) < CASE WHEN at_limit THEN 0.9 ELSE 0.1 END THEN 'trigram'
    WHEN part THEN 'word'
    WHEN regexp_matches(t, '(…|\.\.\.|\[…\]|\[\.\.\.\]|\x{{FFFD}})$') THEN 'stand-in'
    WHEN regexp_matches(t, '<[\p{{L}}/!][^<>]*$|&#?[\p{{L}}\p{{N}}]*$') OR regexp_matches(para, '\[[^\[\]]*$|\([^()]*$|»[^»«]*$|„[^„“”]*$') OR regexp_matches(line, '^=+[^=]+=?$|^\|([^}}]|$)')
      OR len(regexp_extract_all(line, '''{{2,}}')) % 2 = 1 OR len(regexp_extract_all(para, '"')) % 2 = 1
      OR list_bool_or([contains(t, x[1]) AND NOT contains(string_split(t, x[1])[-1], x[2]) FOR x IN {PAIRS}])
      OR list_bool_or([contains(t, '<' || x) AND regexp_matches(string_split(t, '<' || x)[-1], '^(>|[ \t]([^<>]*[^<>/])?>)') AND NOT contains(string_split(t, '<' || x)[-1], '</' || x) FOR x IN {ELEMENTS}]) THEN 'open'
    WHEN regexp_matches(line, '[,;:–-]$') OR blank AND loose AND NOT entry THEN 'sign' END AS reason
  FROM rated
)"""

SQL = {
    "p10_truncated": f"WITH {CUT} SELECT doc_id, source, reason FROM judged WHERE reason IS NOT NULL",
    "p10_found": f"WITH {CUT} SELECT DISTINCT doc_id FROM judged WHERE reason IS NOT NULL",
    "p10_rates": f"""WITH {CUT}, n AS (SELECT source, count(*) AS documents FROM documents GROUP BY source), f AS (SELECT source, count(reason) AS truncated FROM judged GROUP BY source)
SELECT n.source, documents, coalesce(truncated, 0) AS truncated, round(coalesce(truncated, 0) / documents, 6) AS rate FROM n LEFT JOIN f ON n.source IS NOT DISTINCT FROM f.source""",
}
