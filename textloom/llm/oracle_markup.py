"""SQL for the elements of articles, written apart from the operator: patterns over texts, spans and lines, for the forms the test articles have."""

from __future__ import annotations


def sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CODES = (
    (r"<(?:source|syntaxhighlight|pre)\b[^<>]*>.*?</(?:source|syntaxhighlight|pre)\s*>", r"(?is)^<(?:source|syntaxhighlight|pre)\b[^<>]*>(.*)</[^<>]*>$"),
    (r"(?m:^)[ \t]{0,3}```[^\n`]*\n(?:.*?\n)??[ \t]{0,3}```[ \t]*(?m:$)", r"(?s)^[ \t]*`{3,}[^\n]*\n(.*?)[ \t]*`{3,}[ \t]*$"),
    (r"(?m:^)[ \t]{0,3}~~~[^\n]*\n(?:.*?\n)??[ \t]{0,3}~~~[ \t]*(?m:$)", r"(?s)^[ \t]*~{3,}[^\n]*\n(.*?)[ \t]*~{3,}[ \t]*$"),
    (r"\\begin\{verbatim\}.*?\\end\{verbatim\}", r"(?s)^\\begin\{verbatim\}(.*)\\end\{verbatim\}$"),
)
FORMULAS = (
    (r"<math\b[^<>]*>.*?</math\s*>", r"(?is)^<math[^<>]*>(.*)</math\s*>$"),
    (r"\\begin\{equation\}.*?\\end\{equation\}", r"(?s)^\\begin\{equation\}(.*)\\end\{equation\}$"),
    (r"\$\$.*?\$\$", r"(?s)^\$\$(.*)\$\$$"),
    (r"\\\[.*?\\\]", r"(?s)^\\\[(.*)\\\]$"),
    (r"\\\(.*?\\\)", r"(?s)^\\\((.*)\\\)$"),
    (r"\$[^\s$](?:[^$\n]*[^\s\\$])?\$", r"^\$([^$]*)\$$"),
)
#: What is taken whole; a dollar sign after a word is none.
WHOLE = "(?is)" + "|".join(
    [r"<!--.*?-->", *(p for p, _ in CODES), r"`[^`\n]+`", r"[\p{L}\p{N}_\\]\$", *(p for p, _ in FORMULAS)]
    + [r"<(?:gallery|ref|table)\b(?:[^<>]*[^<>/])?>.*?</(?:gallery|ref|table)\s*>", r"(?m:^)\{\|.*?(?m:^)\|\}", r"\{\{[^{}]*\}\}"]
)
#: Signs in formulas and literals that must not be read as markup, and what hides them meanwhile.
SIGNS = "*_`[]{}<>&\\~'=#-+:;|$!\n"
HIDDEN = "".join(chr(0xE000 + i) for i in range(len(SIGNS)))
SPAN = r"(?is)<h[1-6]\b[^<>]*>.*?</h[1-6]\s*>|\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{(?:[^{}]|\{[^{}]*\})*\}|<li\b[^<>]*>[^\x01]*|\\item\b[^\x01]*"
STOP = r"(?i)(</?li\b|</[ou]l\b|\\item\b|\\end\{|\n[ \t]*\n)"
INLINE = (
    (r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", r"\1"), (r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", r"\1"), (r'!?\[([^\[\]]*)\]\([^()\s]*(?:[ \t]+"[^"]*")?\)', r"\1"),
    (r"(?i)\[[a-z][a-z+.-]*://\S+[ \t]+([^\[\]]*)\]", r"\1"), (r"(?i)\[([a-z][a-z+.-]*://[^\s\[\]]+)\]", r"\1"), (r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"),
    (r"\\(?:emph|text[a-z]{2,}|underline|mbox)\{([^{}]*)\}", r"\1"), (r"\\(?:emph|text[a-z]{2,}|underline|mbox)\{([^{}]*)\}", r"\1"), (r"(?i)<br\s*/?>", " "), ("</?[A-Za-z][^<>]*>", ""),
    ("'{2,5}", ""), (r"\*\*([^\s*](?:[^*]*[^\s*])?)\*\*", r"\1"), (r"__([^\s_](?:[^_]*[^\s_])?)__", r"\1"), (r"(^|[^\p{L}\p{N}_*])\*([^\s*](?:[^*]*[^\s*])?)\*([^\p{L}\p{N}_*]|$)", r"\1\2\3"),
    (r"(^|[^\p{L}\p{N}_])_([^\s_](?:[^_]*[^\s_])?)_([^\p{L}\p{N}_]|$)", r"\1\2\3"), (r"~~([^\s~](?:.*?[^\s~])?)~~", r"\1"), (r"\\([&%_#$*{}])", r"\1"),
)
WIKI = r"^={1,6}[ \t]*([^=\s](?:.*?[^=])?)[ \t]*={1,6}[ \t]*$"
DASHES = r"^(={2,}|-{2,})[ \t]*$"
EMPHASIS = r"^(\*\*[^\s*][^*]*\*\*|\*[^\s*][^*]*\*([^\p{L}\p{N}_*]|$))"
ITEMS = (r"^[:;]*(?:\*[*#:]*[ \t]*|#[ \t]+|[*#:]+[*#][ \t]+)(\S.*)$", r"^[ \t]*[-+*][ \t]+(\S.*)$", r"^[ \t]*\d{1,9}[.)][ \t]+(\S.*)$")


def first_of(x: str, patterns) -> str:
    """What the first pattern that matches captures."""
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {sql(p)}) THEN regexp_extract({x}, {sql(p)}, 1)" for p in patterns) + " END"


def one_line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{a0}}]+', ' ', 'g'))"


def inline(x: str) -> str:
    for pattern, to in INLINE:
        x = f"regexp_replace({x}, {sql(pattern)}, '{to}', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return one_line(f"translate({x}, {sql(HIDDEN)}, {sql(SIGNS)})")


def elements(articles: str) -> str:
    """CTEs up to every(id, kind, content)."""
    code, formula = first_of("w", [c for _, c in CODES]), first_of("w", [c for _, c in FORMULAS])
    return rf"""WITH {articles}, taken AS (
  SELECT id, regexp_extract_all(text, {sql(WHOLE)}) AS ws, string_split_regex(text, {sql(WHOLE)}) AS gaps FROM article
), whole AS (
  SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM taken
), told AS (
  SELECT id, k, w, {code} AS code, CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}_\\]\$$') THEN NULL ELSE {formula} END AS formula, CASE WHEN regexp_matches(w, '^`[^`]+`$') THEN w[2:-2] END AS literal FROM whole
), shown AS (
  SELECT id, list(CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}_\\]\$$') THEN w WHEN code IS NOT NULL THEN chr(10) || chr(2) || chr(10) ELSE translate(coalesce(formula, literal, ''), {sql(SIGNS)}, {sql(HIDDEN)}) END ORDER BY k) AS ms
  FROM told GROUP BY id
), body AS (
  SELECT id, regexp_replace(CASE WHEN ms IS NULL THEN gaps[1] ELSE array_to_string([z[1] || coalesce(z[2], '') FOR z IN list_zip(gaps, ms)], '') END, {sql(STOP)}, chr(1) || '\1', 'g') AS b FROM taken LEFT JOIN shown USING (id)
), cut AS (SELECT id, regexp_extract_all(b, {sql(SPAN)}) AS spans, array_to_string(string_split_regex(b, {sql(SPAN)}), chr(10)) AS rest FROM body
), line AS (
  SELECT id, unnest(string_split(replace(rest, chr(1), ''), chr(10))) AS r, unnest(range(len(string_split(replace(rest, chr(1), ''), chr(10))))) AS k FROM cut
), near AS (SELECT id, r, lead(r) OVER (PARTITION BY id ORDER BY k) AS nx, regexp_matches(r, {sql(DASHES)}) AS dashes, {first_of('r', ITEMS)} AS item, regexp_matches(r, {sql(EMPHASIS)}) AS strong FROM line
), of_lines AS (
  SELECT id, CASE WHEN regexp_matches(r, {sql(WIKI)}) OR regexp_matches(r, '^#{{2,6}}[^#]') THEN 'heading' WHEN item IS NOT NULL AND NOT strong THEN CASE WHEN NOT dashes THEN 'item' END
      WHEN regexp_matches(nx, {sql(DASHES)}) AND regexp_matches(r, '^[^-=|!{{<\x02]') AND trim(r) <> '' THEN 'heading' END AS kind,
    CASE WHEN regexp_matches(r, {sql(WIKI)}) THEN regexp_extract(r, {sql(WIKI)}, 1) WHEN regexp_matches(r, '^#{{2,6}}[^#]') THEN regexp_extract(r, '^#{{2,6}}[ \t]*(.*?)[ \t]*#*[ \t]*$', 1)
      WHEN item IS NOT NULL AND NOT strong THEN item ELSE r END AS content FROM near
), of_spans AS (
  SELECT id, CASE WHEN regexp_matches(s, '(?i)^(<li|\\item)') THEN 'item' ELSE 'heading' END AS kind,
    CASE WHEN regexp_matches(s, '(?i)^<li') THEN regexp_extract(s, '(?s)^<[^<>]*>(.*)$', 1) WHEN regexp_matches(s, '^\\item') THEN regexp_extract(s, '(?s)^\\item(?:\[[^\[\]\n]*\])?(.*)$', 1)
      WHEN regexp_matches(s, '(?i)^<h') THEN regexp_extract(s, '(?s)^<[^<>]*>(.*)</[^<>]*>$', 1) ELSE regexp_extract(s, '(?s)^\\[a-z]+\*?\{{(.*)\}}$', 1) END AS content
  FROM (SELECT id, replace(unnest(spans), chr(1), '') AS s FROM cut)
), every AS (
  SELECT id, kind, {inline('content')} AS content FROM (SELECT * FROM of_lines WHERE kind IS NOT NULL UNION ALL SELECT * FROM of_spans)
  UNION ALL SELECT id, 'code', {one_line('code')} FROM told WHERE code IS NOT NULL
  UNION ALL SELECT id, 'formula', {one_line('formula')} FROM told WHERE formula IS NOT NULL
)"""


LEFTOVER = r"</?[A-Za-z][^<>]*>|\\(?:begin|end)\{[^{}]*\}"


def clean(articles: str) -> str:
    """Running text and elements in order; formulas stand before the line they are in, and in running text also within dollar signs."""
    code, formula = first_of("w", [c for _, c in CODES]), first_of("w", [c for _, c in FORMULAS])

    def shown(x: str, mark: str) -> str:
        return inline(rf"regexp_replace({x}, '\x02([^\x03]*)\x03', '{mark}\1{mark}', 'g')")

    return rf"""WITH {articles}, taken AS (
  SELECT id, regexp_extract_all(text, {sql(WHOLE)}) AS ws, string_split_regex(text, {sql(WHOLE)}) AS gaps FROM article
), whole AS (
  SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM taken
), told AS (
  SELECT id, k, w, {code} AS code, CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}_\\]\$$') THEN NULL ELSE {formula} END AS formula, CASE WHEN regexp_matches(w, '^`[^`]+`$') THEN w[2:-2] END AS literal FROM whole
), shown AS (
  SELECT id, list(CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}_\\]\$$') THEN w WHEN code IS NOT NULL THEN chr(10) || chr(5) || k || chr(10)
      WHEN formula IS NOT NULL THEN chr(2) || translate(formula, {sql(SIGNS)}, {sql(HIDDEN)}) || chr(3) ELSE coalesce(translate(literal, {sql(SIGNS)}, {sql(HIDDEN)}), chr(6)) END ORDER BY k) AS ms
  FROM told GROUP BY id
), body AS (
  SELECT id, regexp_replace(CASE WHEN ms IS NULL THEN gaps[1] ELSE array_to_string([z[1] || coalesce(z[2], '') FOR z IN list_zip(gaps, ms)], '') END, {sql(STOP)}, chr(1) || '\1', 'g') AS b FROM taken LEFT JOIN shown USING (id)
), cut AS (SELECT id, regexp_extract_all(b, {sql(SPAN)}) AS spans, string_split_regex(b, {sql(SPAN)}) AS gaps FROM body
), laid AS (
  SELECT id, spans, array_to_string([z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE chr(10) || chr(4) || z[3] || chr(10) END FOR z IN list_zip(gaps, spans, range(1, len(gaps) + 1))], '') AS b FROM cut
), line AS (
  SELECT id, unnest(string_split(replace(b, chr(1), ''), chr(10))) AS r, unnest(range(len(string_split(replace(b, chr(1), ''), chr(10))))) AS k FROM laid
), near AS (
  SELECT line.id, line.k, r, lead(r) OVER (PARTITION BY line.id ORDER BY line.k) AS nx, regexp_matches(r, {sql(DASHES)}) AS dashes, {first_of('r', ITEMS)} AS item, regexp_matches(r, {sql(EMPHASIS)}) AS strong,
    CASE WHEN r[1] = chr(4) THEN replace(spans[r[2:]::INT], chr(1), '') END AS s, CASE WHEN r[1] = chr(5) THEN r[2:]::INT END AS n
  FROM line JOIN laid USING (id)
), kinds AS (
  SELECT id, k, n, CASE WHEN n IS NOT NULL THEN 'code' WHEN s IS NOT NULL THEN CASE WHEN regexp_matches(s, '(?i)^(<li|\\item)') THEN 'item' ELSE 'heading' END
      WHEN regexp_matches(r, {sql(WIKI)}) OR regexp_matches(r, '^#{{2,6}}[^#]') THEN 'heading' WHEN item IS NOT NULL AND NOT strong THEN CASE WHEN NOT dashes THEN 'item' END
      WHEN regexp_matches(nx, {sql(DASHES)}) AND regexp_matches(r, '^[^-=|!{{<\x02]') AND trim(r) <> '' THEN 'heading' WHEN regexp_matches(r, '(?i)^\[\[(Kategorie|Category|Datei|File|Bild|Image):') OR dashes THEN NULL ELSE 'text' END AS kind,
    CASE WHEN s IS NOT NULL THEN CASE WHEN regexp_matches(s, '(?i)^<li') THEN regexp_extract(s, '(?s)^<[^<>]*>(.*)$', 1) WHEN regexp_matches(s, '^\\item') THEN regexp_extract(s, '(?s)^\\item(?:\[[^\[\]\n]*\])?(.*)$', 1)
        WHEN regexp_matches(s, '(?i)^<h') THEN regexp_extract(s, '(?s)^<[^<>]*>(.*)</[^<>]*>$', 1) ELSE regexp_extract(s, '(?s)^\\[a-z]+\*?\{{(.*)\}}$', 1) END
      WHEN regexp_matches(r, {sql(WIKI)}) THEN regexp_extract(r, {sql(WIKI)}, 1) WHEN regexp_matches(r, '^#{{2,6}}[^#]') THEN regexp_extract(r, '^#{{2,6}}[ \t]*(.*?)[ \t]*#*[ \t]*$', 1)
      WHEN item IS NOT NULL AND NOT strong THEN item ELSE r END AS content FROM near
), said AS (
  SELECT id, k, kind, n, regexp_extract_all(content, '\x02([^\x03]*)\x03', 1) AS fs, CASE WHEN kind = 'text' AND regexp_matches(content, '^[:\x02]') AND regexp_matches(regexp_replace(content, '\x02[^\x03]*\x03', '', 'g'), '^[: \t]*$') THEN ''
    WHEN kind = 'text' THEN {shown(f"regexp_replace(content, {sql(LEFTOVER)}, '', 'g')", '$')} ELSE {shown('content', '')} END AS c FROM kinds WHERE kind IS NOT NULL
), leaf AS (
  SELECT id, k, 0 AS o, unnest(fs) AS f, unnest(range(len(fs))) AS i, NULL AS t FROM said
  UNION ALL SELECT id, k, 1, NULL, 0, CASE kind WHEN 'heading' THEN chr(10) || '## ' || c || chr(10) WHEN 'item' THEN '- ' || c ELSE c END FROM said WHERE kind <> 'code' AND trim(replace(c, chr(6), '')) <> ''
  UNION ALL SELECT said.id, said.k, 1, NULL, 0, '```' || chr(10) || trim(code, chr(10)) || chr(10) || '```' FROM said JOIN told ON told.id = said.id AND told.k = n WHERE trim(code) <> ''
), rendered AS (SELECT id, k, o, i, CASE WHEN o = 0 THEN '$$' || {one_line(f"translate(f, {sql(HIDDEN)}, {sql(SIGNS)})")} || '$$' ELSE t END AS t FROM leaf
), joined AS (SELECT id, string_agg(t, chr(10) ORDER BY k, o, i) AS t FROM rendered GROUP BY id)
SELECT article.id, coalesce(trim(replace(t, chr(6), ''), ' ' || chr(9) || chr(10) || chr(13)), '') AS clean_text FROM article LEFT JOIN joined USING (id)"""


def queries(articles: str) -> dict[str, str]:
    every = elements(articles)
    return {
        "p2_clean": clean(articles),
        "p2_found": f"{every} SELECT DISTINCT id, kind, content FROM every WHERE content <> ''",
        "p2_structure": f"{every} SELECT id, kind, count(*) AS n FROM every WHERE content <> '' GROUP BY ALL",
    }
