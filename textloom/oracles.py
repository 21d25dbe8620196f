"""SQL that DuckDB runs over the same tables, written apart from the operators."""

from __future__ import annotations


def key(c: str) -> str:
    return rf"translate(lower(regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), ' .:,;-', '')"


#: Current rows and articles.
ARTICLES = r"""current_rows AS (
  SELECT * FROM page WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision.id DESC NULLS LAST, loaded_at NULLS LAST) = 1
), article AS (
  SELECT * FROM current_rows WHERE ns = 0 AND redirect IS NULL AND length(title) > 0 AND length(text) > 0
)"""

#: Words as UAX#29 breaks them, quotes doubled for SQL.
WORD = r"(?:\p{L}[\p{L}\p{M}]*(?:[.:''’·]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:[.,;''’]\p{N}+)*|_)+"

STOP = "stop AS (SELECT DISTINCT w FROM (SELECT lower(trim(unnest(string_split(line, ',')))) AS w FROM stop_word) WHERE w <> '')"


def kept(source: str, key_column: str) -> str:
    """Words left once stop words are gone, with their place among these."""
    return rf"""raw AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS o FROM (SELECT {key_column} AS doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM {source})
), kept AS (
  SELECT doc_id, word, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INTEGER AS pos FROM raw WHERE word NOT IN (SELECT w FROM stop)
)"""


#: (word, normal, term) of distinct words, by light stemming; ``source`` has the words.
STEMS = r"""spelled AS (
  SELECT word, translate(replace(regexp_replace(regexp_replace(word, '([ao])e', '\1', 'g'), '(^|[^aeioquyäöü])ue', '\1u', 'g'), 'ß', 'ss'), 'äöü', 'aou') AS normal FROM (SELECT DISTINCT word FROM kept)
), once AS (
  SELECT word, normal, CASE
    WHEN length(normal) > 5 AND regexp_matches(normal, 'ern$') THEN normal[:-4]
    WHEN length(normal) > 4 AND regexp_matches(normal, 'e[mnrs]$') THEN normal[:-3]
    WHEN length(normal) > 3 AND regexp_matches(normal, 'e$') THEN normal[:-2]
    WHEN length(normal) > 3 AND regexp_matches(normal, '[bdfghklmnt]s$') THEN normal[:-2] ELSE normal END AS s FROM spelled
), stem AS (
  SELECT word, normal, CASE
    WHEN length(s) > 5 AND regexp_matches(s, 'est$') THEN s[:-4]
    WHEN length(s) > 4 AND regexp_matches(s, 'e[rn]$') THEN s[:-3]
    WHEN length(s) > 4 AND regexp_matches(s, '[bdfghklmnt]st$') THEN s[:-3] ELSE s END AS term FROM once
)"""

#: Letter groups that count as one letter in the second stemmer.
GROUPS = (("sch", "$"), ("ch", "§"), ("ei", "%"), ("ie", "&"), ("ig", "#"), ("st", "!"))


def once_stripped(v: str) -> str:
    return f"""CASE WHEN length({v}) <= 3 THEN {v} WHEN length({v}) + hidden > 5 AND {v} LIKE '%nd' THEN {v}[:-3]
    WHEN length({v}) + hidden > 4 AND ({v} LIKE '%em' OR {v} LIKE '%er') THEN {v}[:-3] WHEN {v}[-1] IN ('e', 's', 'n', 't') THEN {v}[:-2] ELSE {v} END"""


def strip_all(name: str, source: str) -> str:
    """CTE (word, hidden, v): endings of (word, hidden, v) stripped until none is left."""
    return f"""{name}_step(word, hidden, v, i) AS (
  SELECT word, hidden, v, 0 FROM {source} UNION ALL SELECT word, hidden, {once_stripped('v')}, i + 1 FROM {name}_step WHERE {once_stripped('v')} <> v
), {name} AS (SELECT word, any_value(hidden) AS hidden, arg_max(v, i) AS v FROM {name}_step GROUP BY word)"""


def second_stems(source: str, name: str, tag: str = "") -> str:
    """CTEs up to ``name`` (word, normal, term): those of ``source`` stemmed again."""
    v = "translate(replace(term, 'ß', 'ss'), 'äöü', 'aou')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        v = f"replace({v}, '{c}{c}', '{c}*')"
    for group, sign in GROUPS:
        v = f"replace({v}, '{group}', '{sign}')"
    hidden = " + ".join(f"{len(group) - 1} * (length(v) - length(replace(v, '{sign}', '')))" for group, sign in GROUPS)
    back = "regexp_replace(regexp_replace(v, 'z$', 'x'), '(\\p{L})\\*', '\\1\\1', 'g')"
    for group, sign in GROUPS:
        back = f"replace({back}, '{sign}', '{group}')"
    return f"""grouped{tag} AS (SELECT term AS word, {hidden} AS hidden, v FROM (SELECT DISTINCT term, {v} AS v FROM {source} WHERE regexp_matches(term, '^\\p{{L}}+$'))
), {strip_all('bare' + tag, 'grouped' + tag)}, less{tag} AS (SELECT word, hidden, v[:-2] AS v FROM bare{tag} WHERE length(v) > 5 AND v LIKE '%erin*'
), {strip_all('barer' + tag, 'less' + tag)}, ungrouped{tag} AS (
  SELECT word, {back} AS v FROM (SELECT word, v FROM barer{tag} UNION ALL SELECT word, v FROM bare{tag} WHERE word NOT IN (SELECT word FROM less{tag}))
), {name} AS (
  SELECT s.word, normal, coalesce(CASE WHEN length(v) > 4 THEN regexp_replace(v, '^(.*?)gege', '\\1ge') ELSE v END, term) AS term FROM {source} s LEFT JOIN ungrouped{tag} u ON u.word = s.term)"""


TERMS = f"""{ARTICLES}, {STOP}, {kept('article', 'id')}, {STEMS}, tok AS (
  SELECT doc_id, pos, term FROM kept JOIN stem USING (word)
), posting AS (
  SELECT term, doc_id, count(*)::INTEGER AS tf FROM tok GROUP BY ALL
), voc AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posting GROUP BY term
)"""

#: The same with both stemmers.
FULL_STEMS = STEMS.replace("stem AS (", "light AS (") + ", " + second_stems("light", "stem")
FULL_TERMS = TERMS.replace(STEMS, FULL_STEMS)


def scores(name: str, terms: dict[str, int], where: str = "") -> str:
    """BM25 of one query as a CTE."""
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""{name} AS (
  SELECT doc_id, round(sum(ln(((SELECT count(*) FROM article) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE * tf / (1.2::DOUBLE + tf) * 101 * qf / (100 + qf)), 9) AS score
  FROM (VALUES {values}) q(term, qf) JOIN voc USING (term) JOIN posting USING (term) {where} GROUP BY doc_id)"""


RANKED = {"bruck": 2, "siedlung": 1}
PHRASE_2 = "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'bau' AND b.term = 'nutzung'"
PHRASE_3 = """SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
  WHERE a.term = 'list' AND b.term = 'fluss' AND c.term = 'ostmark'"""
TOP_10 = "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10"


def having(t: str) -> str:
    return f"SELECT doc_id FROM posting WHERE term = '{t}'"


#: The patterns of wiki links and of links to the German wiki.
LINKS = rf"""{ARTICLES}, link AS (
  SELECT id AS source_doc_id, {key('title')} AS source_norm,
    unnest(list_concat(regexp_extract_all(text, '\[\[([^:#|\]]+)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]', 1), regexp_extract_all(text, '\[http://de\.wikipedia\.org/wiki/([^ :#\]]+)[^\]]*\]', 1))) AS target FROM article
), links AS (
  SELECT DISTINCT {key('target')} AS target_norm, source_norm, source_doc_id FROM link WHERE {key('target')} <> ''
)"""

#: Link occurrences as problem 1 counts them.
WIKI_LINKS = rf"""{ARTICLES}, kept AS (
  SELECT * FROM (SELECT id AS source_doc_id, {key('t')} AS target_norm FROM (SELECT id, unnest(regexp_extract_all(text, '\[\[([^:#|\]]+)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]', 1)) AS t FROM article)) WHERE target_norm <> ''
)"""


def cleaned(c: str) -> str:
    """The ordered rewrites of wiki text. A dot of RE2 leaves out line feeds only, which is all the test texts have."""
    rules = (
        ("'''", ""), ("''", ""), ("==+", ""), (r"\[\[Datei:[^\]]*\]\]", ""), (r"\[\[[^|\]]+\|", ""), (r"\[\[", ""), (r"\]\]", ""), (r"\[\w+://[^\s]+\s", ""), (r"\[", ""), (r"\]", ""),
        (r"\{\{[^}]*\}\}", ""), (r"\{\{", ""), (r"\}\}", ""), (r"\{[^}]*\}", ""), (r"\|(.*)\n", ""), ("<gallery>[^<]*</gallery>", ""), ("<ref>[^<]*</ref>", ""), ("#WEITERLEITUNG", ""),
        ("<[^>]*>", ""), ("\n(.*):\\\\mathrm(.*)\n", "\n"), ("  ", ""), ("\n ", "\n"), ("\n\n\n", "\n\n"), ("&nbsp;", " "),
    )
    c = f"replace({c}, chr(9), ' ')"
    for pattern, to in rules:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


CLEAN = f"{ARTICLES}, clean AS (SELECT id AS doc_id, {cleaned('text')} AS t FROM article)"


def last_blank(text: str, at: str) -> str:
    return f"(CASE WHEN contains({text}[1:{at} + 1], ' ') THEN length({text}[1:{at} + 1]) - instr(reverse({text}[1:{at} + 1]), ' ') ELSE -1 END)"


HEAD = f"""head AS (
  SELECT doc_id, t, least(length(t), 240) AS e FROM clean
), cut AS (SELECT *, {last_blank('t', '(e - 1)')} AS b FROM head
), headed AS (SELECT doc_id, replace(t[1:CASE WHEN b > 200 THEN b ELSE e END], chr(10), ' ') || '...' AS snippet FROM cut WHERE length(t) > 0)"""

CLEAN_ONLY = CLEAN.removeprefix(f"{ARTICLES}, ")


def stems_of(source: str, tag: str, full: bool = False) -> str:
    """STEMS over the words of another CTE, under names of its own."""
    text = STEMS.replace("FROM kept", f"FROM {source}")
    for name in ("spelled", "once", "stem"):
        text = text.replace(f"{name} AS (", f"{name}_{tag} AS (").replace(f"FROM {name}", f"FROM {name}_{tag}")
    return text.replace(f"stem_{tag} AS (", f"light_{tag} AS (") + ", " + second_stems(f"light_{tag}", f"stem_{tag}", f"_{tag}") if full else text


def hit_snippets(results: str, terms: str, tag: str, full: bool = False) -> str:
    """CTEs up to shown_<tag>(doc_id, snippet): snippets of the documents of ``results`` for the terms of the CTE ``terms``."""
    return rf"""win_{tag} AS (SELECT doc_id, t[1:10000] AS t FROM clean WHERE doc_id IN (SELECT doc_id FROM {results}) AND length(t) > 0
), split_{tag} AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM win_{tag}
), piece_{tag} AS (SELECT doc_id, t, unnest(list_concat(w[1:499], CASE WHEN len(w) > 499 THEN [array_to_string(w[500:], ' ')] ELSE [] END)) AS p, unnest(range(least(len(w), 500))) AS o FROM split_{tag}
), said_{tag} AS (SELECT doc_id, t, p, o, unnest(w) AS word, unnest(range(len(w))) AS k FROM (SELECT *, regexp_extract_all(lower(p), '{WORD}') AS w FROM piece_{tag})
), first_{tag} AS (SELECT doc_id, any_value(t) AS t, any_value(p) AS p, o, arg_min(word, k) AS word FROM said_{tag} WHERE word NOT IN (SELECT w FROM stop) GROUP BY doc_id, o
), {stems_of(f'first_{tag}', tag, full)}, hit_{tag} AS (
  SELECT doc_id, any_value(t) AS t, arg_min(p, o) AS p FROM first_{tag} JOIN stem_{tag} USING (word) WHERE term IN (SELECT term FROM {terms}) GROUP BY doc_id
), placed_{tag} AS (SELECT doc_id, t, instr(t, p) - 1 AS p FROM hit_{tag}
), near_{tag} AS (SELECT *, {last_blank('t', '(p - 100)')} + 1 AS near FROM placed_{tag}
), start_{tag} AS (SELECT *, CASE WHEN p <= 100 THEN 0 WHEN p - near > 140 THEN p - 100 ELSE near END AS a, least(p + 120, length(t)) AS e FROM near_{tag}
), stop_{tag} AS (SELECT *, {last_blank('t', '(e - 1)')} AS b FROM start_{tag}
), made_{tag} AS (SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || replace(t[a + 1:CASE WHEN b - a > 200 THEN b ELSE e END], chr(10), ' ') || '...' AS snippet FROM stop_{tag}
), shown_{tag} AS (SELECT * FROM made_{tag} UNION ALL SELECT doc_id, snippet FROM headed WHERE doc_id IN (SELECT doc_id FROM win_{tag}) AND doc_id NOT IN (SELECT doc_id FROM made_{tag}))"""


def scored(name: str, asked: str, where: str = "") -> str:
    """BM25 as a CTE, of the terms in the CTE ``asked`` (term, qf)."""
    return f"""{name} AS (
  SELECT doc_id, round(sum(ln(((SELECT count(*) FROM article) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE * tf / (1.2::DOUBLE + tf) * 101 * qf / (100 + qf)), 9) AS score
  FROM {asked} JOIN voc USING (term) JOIN posting USING (term) {where} GROUP BY doc_id)"""


def in_a_row(*terms: str) -> str:
    """Documents with terms that follow each other, by joins."""
    joins = "".join(f" JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"SELECT DISTINCT t0.doc_id FROM tok t0{joins} WHERE t0.term = '{terms[0]}'"


KEYWORDS = ("bau", "nutzung", "list", "fluss", "ostmark")
KEYWORD_SQL = f"""WITH {TERMS}, {CLEAN_ONLY}, {HEAD}, asked AS (SELECT unnest({list(KEYWORDS)}) AS term, 1 AS qf
), {scored('every', 'asked')}, whole AS ({in_a_row(*KEYWORDS)}), allowed AS ({PHRASE_3}), tiers AS (
  SELECT doc_id, score, doc_id NOT IN (SELECT doc_id FROM whole) AS tier FROM every WHERE doc_id IN (SELECT doc_id FROM whole UNION SELECT doc_id FROM allowed)
), best AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, doc_id)::INTEGER AS rank FROM tiers QUALIFY rank <= 20), {hit_snippets('best', 'asked', 'k')}
SELECT rank, best.doc_id, round(score, 6) AS score, title, snippet FROM best JOIN article ON id = best.doc_id LEFT JOIN shown_k ON shown_k.doc_id = best.doc_id"""

PRF_SQL = rf"""WITH {TERMS}, {CLEAN_ONLY}, {HEAD}, asked AS (SELECT * FROM (VALUES ('bruck', 2), ('siedlung', 1)) v(term, qf)
), {scored('s', 'asked')}, three AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 3), {hit_snippets('three', 'asked', 'f')}, answer AS (
  SELECT unnest(regexp_extract_all(lower(regexp_replace(title || chr(10) || snippet, '\.\.\.', '', 'g')), '{WORD}')) AS word FROM shown_f JOIN article ON id = doc_id
), fresh AS (SELECT DISTINCT word FROM answer WHERE word NOT IN (SELECT w FROM stop)), {stems_of('fresh', 'g')}, extra AS (
  SELECT term FROM answer JOIN stem_g USING (word) WHERE term NOT IN (SELECT term FROM asked) GROUP BY term ORDER BY count(*) DESC, term LIMIT 10
), more AS (SELECT term, qf FROM asked UNION ALL SELECT term, 1 FROM extra), {scored('again', 'more')}, whole AS ({in_a_row('bruck', 'siedlung', 'bruck')}), tiers AS (
  SELECT doc_id, min(tier) AS tier, max(score) AS score FROM (SELECT doc_id, score, 1 AS tier FROM again UNION ALL SELECT doc_id, score, 0 FROM s WHERE doc_id IN (SELECT doc_id FROM whole)) GROUP BY doc_id
), best AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, doc_id)::INTEGER AS rank FROM tiers QUALIFY rank <= 10)
SELECT rank, doc_id, round(score, 6) AS score, title FROM best JOIN article ON id = doc_id"""

ASKED = """asked AS (
  SELECT * FROM query_case WHERE query IS NOT NULL AND query_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at NULLS LAST, query, topk) = 1
)"""

#: (query_id, topk, word) of the logged queries that rank, without operators and quotes.
ASKED_WORDS = f"""asked_word AS (
  SELECT query_id, topk, unnest(regexp_extract_all(lower(translate(replace(replace(replace(query, ' AND ', ' '), ' OR ', ' '), ' BUT NOT ', ' '), '"*' || chr(39), '')), '{WORD}')) AS word
  FROM asked WHERE topk > 0 AND NOT contains(query, 'LINKTO ')
), """


def dcg(g: str, rank: str) -> str:
    gain = f"floor(10 * pow(0.5::DOUBLE, 0.1::DOUBLE * {g}))"
    return f"(1 + CASE WHEN {rank} = 1 THEN {gain} ELSE {gain} / ln({rank}::DOUBLE) END)"


GOLD = """SELECT query, row_number() OVER (PARTITION BY query ORDER BY gold_rank, translate(title, '"', ''))::INTEGER AS rank, translate(title, '"', '') AS title
FROM gold_ranking WHERE query IS NOT NULL AND title IS NOT NULL AND gold_rank IS NOT NULL"""

SQL = {
    "articles": f"WITH {ARTICLES} SELECT id AS doc_id, title, {key('title')} AS norm_title, length(text)::INTEGER AS chars FROM article",
    "title_norms": f"SELECT DISTINCT title, {key('title')} AS norm_title FROM page",
    "tokenize": f"""SELECT doc_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents)""",
    "stop_words": f"WITH {STOP} SELECT w AS word FROM stop",
    "stopword_filter": f"WITH {STOP}, {kept('documents', 'doc_id')} SELECT doc_id, pos, word FROM kept",
    "stem_light": f"WITH {ARTICLES}, {STOP}, {kept('article', 'id')}, {STEMS} SELECT word, normal, term FROM stem",
    "stem_full": f"WITH RECURSIVE {ARTICLES}, {STOP}, {kept('article', 'id')}, {FULL_STEMS} SELECT word, term FROM stem",
    "keyword_full": f"""WITH RECURSIVE {FULL_TERMS}, {CLEAN_ONLY}, {HEAD}, asked AS (SELECT term, count(*) AS qf FROM (SELECT unnest(['brücke', 'siedlung', 'brücke']) AS word) JOIN stem USING (word) GROUP BY term
), {scored('s', 'asked')}, place AS (SELECT unnest(['brücke', 'siedlung', 'brücke']) AS word, unnest([0, 1, 2]) AS o
), whole AS (
  SELECT doc_id FROM (SELECT doc_id, pos - o AS start FROM tok JOIN (SELECT term, o FROM place JOIN stem USING (word)) USING (term)) GROUP BY doc_id, start HAVING count(*) = 3
), best AS (SELECT doc_id, score, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM whole), score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10), {hit_snippets('best', 'asked', 'k', True)}
SELECT rank, best.doc_id, round(score, 6) AS score, title, snippet FROM best JOIN article ON id = best.doc_id LEFT JOIN shown_k ON shown_k.doc_id = best.doc_id""",
    "postings": f"WITH {TERMS} SELECT term, doc_id, count(*)::INTEGER AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY ALL",
    "posting_lists": f"""WITH {TERMS}, line AS (SELECT term, doc_id, doc_id::VARCHAR || ':' || string_agg(pos::VARCHAR, ',' ORDER BY pos) AS e FROM tok GROUP BY term, doc_id)
SELECT term, doc_id // 10000 AS part, string_agg(e, ';' ORDER BY doc_id) AS line FROM line GROUP BY ALL""",
    "posting_round_trip": f"WITH {TERMS} SELECT term, doc_id, tf FROM posting",
    "vocabulary_df": f"WITH {TERMS} SELECT term, df, cf FROM voc",
    "corpus_stats": f"WITH {ARTICLES} SELECT count(*) AS n_docs FROM article",
    "df_cutoff": f"WITH {TERMS} SELECT term, df FROM voc WHERE df <= 100",
    "term_query": f"WITH {TERMS} {having('bruck')}",
    "prefix_query": f"WITH {TERMS} SELECT DISTINCT doc_id FROM posting WHERE term IN (SELECT term FROM voc WHERE term LIKE 'bruck%' ORDER BY term LIMIT 10)",
    "phrase_query_2": f"WITH {TERMS} {PHRASE_2}",
    "phrase_query_3": f"WITH {TERMS} {PHRASE_3}",
    "boolean_and": f"WITH {TERMS} {having('burg')} INTERSECT {having('bruck')}",
    "boolean_or": f"WITH {TERMS} {having('burg')} UNION {having('kapell')}",
    "boolean_but_not": f"WITH {TERMS} {having('burg')} EXCEPT {having('bruck')}",
    "boolean_chain": f"WITH {TERMS} (({having('burg')} INTERSECT {having('bruck')}) UNION {having('kapell')}) EXCEPT {having('siedlung')}",
    "bm25_topk": f"WITH {TERMS}, {scores('s', RANKED)} {TOP_10}",
    "bm25_restricted": f"WITH {TERMS}, {scores('s', RANKED, f'WHERE doc_id IN ({PHRASE_2})')} {TOP_10}",
    "bm25_union": f"""WITH {TERMS}, {scores('s', RANKED)}, allowed AS ({PHRASE_2})
SELECT doc_id, round(score, 6) AS score FROM s UNION ALL SELECT doc_id, 0.0::DOUBLE FROM allowed WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
    "query_types": """SELECT DISTINCT query, CASE WHEN query IS NULL THEN 'none' WHEN query LIKE '%LINKTO %' THEN 'link'
  WHEN query LIKE '% AND %' OR query LIKE '% OR %' OR query LIKE '% BUT NOT %' THEN 'boolean' WHEN query LIKE '%*%' THEN 'prefix'
  WHEN regexp_matches(query, '(?s)(^|[^\\p{L}\\p{N}_])''.*?''([^\\p{L}\\p{N}_]|$)|".*?"') THEN 'phrase' ELSE 'keyword' END AS kind FROM query_case""",
    "bm25_batch": rf"""WITH {ASKED}, {TERMS.replace('kept AS (', ASKED_WORDS + 'kept AS (').replace('(SELECT DISTINCT word FROM kept)', '(SELECT DISTINCT word FROM kept UNION SELECT word FROM asked_word)')}, qt AS (
  SELECT query_id, topk, term, count(*) AS qf FROM asked_word JOIN stem USING (word) WHERE word NOT IN (SELECT w FROM stop) GROUP BY ALL
), s AS (
  SELECT query_id, topk, doc_id, round(sum(ln(((SELECT count(*) FROM article) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE * tf / (1.2::DOUBLE + tf) * 101 * qf / (100 + qf)), 9) AS score
  FROM qt JOIN voc USING (term) JOIN posting USING (term) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= topk""",
    "prf_terms": rf"""WITH {TERMS}, {scores('s', RANKED)}, best AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 3
), answer AS (SELECT unnest(regexp_extract_all(lower(regexp_replace(title || chr(10) || text, '\.\.\.', '', 'g')), '{WORD}')) AS word FROM article WHERE id IN (SELECT doc_id FROM best)
), fresh AS (SELECT DISTINCT word FROM answer WHERE word NOT IN (SELECT w FROM stop)), {STEMS.replace('spelled AS', 'spelled2 AS').replace('FROM spelled', 'FROM spelled2').replace('once AS', 'once2 AS').replace('FROM once', 'FROM once2').replace('stem AS', 'stem2 AS').replace('FROM kept', 'FROM fresh')}
SELECT term, count(*) AS n FROM answer JOIN stem2 USING (word) WHERE term NOT IN ('bruck', 'siedlung') GROUP BY term ORDER BY n DESC, term LIMIT 10""",
    "bm25_prf": PRF_SQL,
    "keyword_pipeline": KEYWORD_SQL,
    "strict_boolean": f"""WITH {TERMS}, hit AS (
  (({PHRASE_2}) INTERSECT SELECT doc_id FROM posting WHERE term IN (SELECT term FROM voc WHERE term LIKE 'bruck%' ORDER BY term LIMIT 10)) EXCEPT {having('kapell')}
) SELECT (row_number() OVER (ORDER BY doc_id))::INTEGER AS rank, doc_id, title FROM hit JOIN article ON id = doc_id""",
    "index_round_trip": f"""WITH {TERMS}, {scores('s', RANKED)}, whole AS (
  SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'bruck' AND b.term = 'siedlung' AND c.term = 'bruck'
), r AS (SELECT doc_id, score, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM whole), score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT rank, doc_id, round(score, 6) AS score, title FROM r JOIN article ON id = doc_id WHERE rank <= 10""",
    "snippet_head": f"WITH {CLEAN}, {HEAD} SELECT doc_id, snippet FROM headed",
    "snippet_hit": rf"""WITH {CLEAN}, {HEAD}, win AS (SELECT doc_id, t[1:10000] AS t FROM clean WHERE length(t) > 0
), split AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM win
), piece AS (SELECT doc_id, t, unnest(list_concat(w[1:499], CASE WHEN len(w) > 499 THEN [array_to_string(w[500:], ' ')] ELSE [] END)) AS p, unnest(range(least(len(w), 500))) AS o FROM split
), hit AS (SELECT doc_id, any_value(t) AS t, arg_min(p, o) AS p FROM piece WHERE regexp_extract(lower(p), '{WORD}') = 'nutzung' GROUP BY doc_id
), placed AS (SELECT doc_id, t, instr(t, p) - 1 AS p FROM hit
), near AS (SELECT *, {last_blank('t', '(p - 100)')} + 1 AS near FROM placed
), start AS (SELECT *, CASE WHEN p <= 100 THEN 0 WHEN p - near > 140 THEN p - 100 ELSE near END AS a, least(p + 120, length(t)) AS e FROM near
), stop_at AS (SELECT *, {last_blank('t', '(e - 1)')} AS b FROM start
), made AS (SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || replace(t[a + 1:CASE WHEN b - a > 200 THEN b ELSE e END], chr(10), ' ') || '...' AS snippet FROM stop_at)
SELECT doc_id, snippet FROM made UNION ALL SELECT doc_id, snippet FROM headed WHERE doc_id NOT IN (SELECT doc_id FROM made)""",
    "clean_markup": f"WITH {CLEAN} SELECT doc_id, t AS clean_text FROM clean",
    "link_extract": f"WITH {LINKS} SELECT target_norm, source_norm, source_doc_id FROM links",
    "link_lists": f"WITH {LINKS}, d AS (SELECT DISTINCT target_norm, source_norm, source_doc_id // 10000 AS part FROM links) SELECT target_norm, part, string_agg(source_norm, ',' ORDER BY source_norm) AS sources FROM d GROUP BY ALL",
    "link_round_trip": f"WITH {LINKS} SELECT DISTINCT target_norm, source_norm FROM links",
    "operator_strip": """SELECT DISTINCT query, translate(replace(replace(replace(replace(query, ' AND ', ' '), ' OR ', ' '), ' BUT NOT ', ' '), 'LINKTO ', ''), '"*' || chr(39), '') AS plain FROM query_case""",
    "answer_titles": f"WITH {CLEAN}, {HEAD} SELECT doc_id, title || chr(10) || snippet AS answer, string_split(title, chr(10))[1] AS title FROM headed JOIN article ON id = doc_id",
    "link_query": f"""WITH {LINKS}, bearer AS (SELECT {key('title')} AS n, max(id) AS doc_id FROM article GROUP BY 1)
SELECT doc_id, min(source_norm) AS source_norm FROM links JOIN bearer ON n = source_norm WHERE target_norm = 'großraumnorderwiek' GROUP BY doc_id""",
    "gold_extract": GOLD,
    "gold_kept": GOLD,
    "ndcg": f"""WITH {ASKED}, hit AS (
  SELECT query_id, result_rank AS rank, min(title) AS title FROM search_result WHERE query_id IS NOT NULL AND result_rank IS NOT NULL AND title IS NOT NULL GROUP BY ALL
), best AS (SELECT query_id, title, min(gold_rank) AS g FROM asked JOIN gold_ranking USING (query) WHERE title IS NOT NULL AND gold_rank IS NOT NULL GROUP BY ALL
), d AS (SELECT query_id, sum({dcg('g', 'rank')}) AS dcg FROM hit JOIN asked USING (query_id) JOIN best USING (query_id, title) WHERE rank BETWEEN 1 AND topk GROUP BY ALL
), i AS (SELECT query_id, sum({dcg('r', 'r')}) AS idcg FROM (SELECT query_id, unnest(range(1, topk + 1)) AS r FROM asked WHERE topk > 0) GROUP BY ALL)
SELECT query_id, CASE WHEN topk > 0 THEN round(coalesce(dcg, 0) / idcg, 9) ELSE 'nan'::DOUBLE END AS ndcg FROM asked LEFT JOIN d USING (query_id) LEFT JOIN i USING (query_id)""",
    "evaluation": f"""WITH {TERMS}, {scores('s', RANKED)}, whole AS ({in_a_row('bruck', 'siedlung', 'bruck')}), hit AS (
  SELECT title, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM whole), score DESC, doc_id) AS rank FROM s JOIN article ON id = doc_id QUALIFY rank <= 10
), gold AS (SELECT title, row_number() OVER (ORDER BY doc_id) AS g FROM posting JOIN article ON id = doc_id WHERE term = 'bruck' QUALIFY g <= 100
), best AS (SELECT title, min(g) AS g FROM gold GROUP BY title
), d AS (SELECT sum({dcg('g', 'rank')}) AS dcg FROM hit JOIN best USING (title)), i AS (SELECT sum({dcg('r', 'r')}) AS idcg FROM (SELECT unnest(range(1, 11)) AS r))
SELECT rank::INTEGER AS rank, hit.title, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM hit, d, i""",
    "unranked_limit": f"""WITH {TERMS}, hit AS (SELECT DISTINCT doc_id FROM posting WHERE term IN (SELECT term FROM voc WHERE term LIKE 'bruck%' ORDER BY term LIMIT 10))
SELECT (row_number() OVER (ORDER BY doc_id))::INTEGER AS rank, doc_id FROM hit QUALIFY rank <= 25""",
    "argument_guards": "SELECT * FROM (VALUES ('null query', 0::BIGINT), ('no results wanted', 0), ('fewer than none', 0), ('nothing asked', 0)) v(arguments, n)",
    "empty_restriction": f"""WITH {TERMS}, {scores('s', {'bruck': 1})} SELECT (row_number() OVER (ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "head_sample": f"WITH {ARTICLES} SELECT title AS value FROM article WHERE NOT contains(title, chr(10)) ORDER BY id LIMIT 101",
    "xml_pages": f"WITH {ARTICLES} SELECT id AS doc_id, title, length(text)::INTEGER AS chars FROM article",
    "p1_found": f"""WITH {WIKI_LINKS}, heavy AS (SELECT target_norm FROM kept GROUP BY 1 HAVING count(*) * 50 >= (SELECT count(*) FROM kept))
SELECT DISTINCT target_norm, source_doc_id FROM kept WHERE target_norm IN (SELECT target_norm FROM heavy)""",
    "p1_summary": f"""WITH {WIKI_LINKS}, n AS (SELECT target_norm, source_doc_id, count(*) AS n FROM kept GROUP BY ALL)
SELECT target_norm, sum(n)::BIGINT AS n_rows, count(*) AS n_values, (arg_min(source_doc_id, (-n, source_doc_id))) AS mode FROM n GROUP BY target_norm""",
    "p1_percentiles": f"""WITH {WIKI_LINKS}, n AS (
  SELECT target_norm, source_doc_id, row_number() OVER (PARTITION BY target_norm ORDER BY source_doc_id) AS r, count(*) OVER (PARTITION BY target_norm) AS n FROM kept)
SELECT target_norm, p::DOUBLE AS p, source_doc_id FROM n, (VALUES (0.25), (0.5), (0.75)) v(p) WHERE r = greatest(1, ceil(p * n))""",
}
