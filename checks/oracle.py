"""For each query, the SQL that must give the same rows when another engine runs it on the same tables."""

from __future__ import annotations

from checks import shared
from checks.stemming_sql import stem_tables
from litscreen.functions import fixed

K = fixed.TOP_SECTIONS_PER_ARTICLE
STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
WORDS = fixed.WORD_PATTERN
SEARCH = fixed.SEARCH_WORD_PATTERN


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- common tables ---------------------------------------------------------------------------------------------------

LINES = """lines AS (
    SELECT doc_id AS article_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)"""

SECTIONS = f"""{LINES}, sections AS (
    SELECT article_id, unnest(lines) AS text, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS section_no FROM lines)"""

TOKENS = f"""{SECTIONS}, tokens AS (
    SELECT article_id, section_no,
           list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda t: t NOT IN ({STOP})) AS tokens
    FROM sections)"""

_STATS = """sizes AS (
    SELECT article_id, CAST(count(*) AS INTEGER) AS n_sections, sum(len(tokens)) / count(*) AS avgdl
    FROM tokens GROUP BY article_id),
counted AS (
    SELECT article_id, section_no, term, dl, count(*) AS tf
    FROM (SELECT article_id, section_no, CAST(len(tokens) AS INTEGER) AS dl, unnest(tokens) AS term FROM tokens)
    GROUP BY article_id, section_no, term, dl),
stats AS (
    SELECT article_id, section_no, term, tf, dl, avgdl, n_sections, count(*) OVER (PARTITION BY article_id, term) AS df
    FROM counted JOIN sizes USING (article_id))"""
STATS = f"{TOKENS}, {_STATS}"

HITS = f"""asked AS (
    SELECT item_id AS question_id, regexp_extract_all(lower(text), '[\\p{{L}}]{{4,}}') AS long,
           regexp_extract_all(lower(text), '{SEARCH}') AS w
    FROM benchmark),
terms AS (
    SELECT DISTINCT question_id, group_no, term FROM (
        SELECT question_id, 0 AS group_no, unnest(long[1:2]) AS term FROM asked
        UNION ALL SELECT question_id, 1, unnest(list_concat(long[3:4], [array_to_string(w[1:2], ' ')])) FROM asked)
    WHERE term <> ''),
paragraphs AS (
    SELECT article_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{SEARCH}'), ' ') || ' ' AS norm
    FROM sections),
matches AS (
    SELECT DISTINCT question_id, group_no, term, article_id
    FROM terms JOIN paragraphs ON contains(norm, ' ' || term || ' ')),
needed AS (SELECT question_id, count(DISTINCT group_no) AS n_groups FROM terms GROUP BY question_id),
found AS (
    SELECT question_id, article_id, count(*) AS n_terms, count(DISTINCT group_no) AS n_matched
    FROM matches GROUP BY question_id, article_id),
hits AS (
    SELECT question_id, article_id, n_terms,
           CAST(row_number() OVER (PARTITION BY question_id ORDER BY n_terms DESC, article_id) AS INTEGER) AS rank
    FROM found JOIN needed USING (question_id) WHERE n_matched = n_groups
    QUALIFY rank <= {fixed.TOP_ARTICLES_PER_SEARCH})"""

WEIGHT = f"""ln(1 + (n_sections - df + 0.5) / (df + 0.5)) * tf
    / (tf + {fixed.BM25_K1} * (1 - {fixed.BM25_B} + {fixed.BM25_B} * dl / avgdl))"""

ASKED_TOKENS = f"""asked_tokens AS (
    SELECT item_id AS question_id,
           list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda t: t NOT IN ({STOP})) AS tokens
    FROM benchmark)"""

_SCORES = f"""{HITS}, question_terms AS (
    SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(tokens) AS term FROM asked_tokens)
    GROUP BY question_id, term),
scores AS (
    SELECT question_id, article_id, section_no, round(sum(qtf * {WEIGHT}), {fixed.SCORE_DIGITS}) AS score
    FROM hits JOIN question_terms USING (question_id) JOIN stats USING (article_id, term)
    GROUP BY question_id, article_id, section_no)"""
SCORES = f"{STATS}, {ASKED_TOKENS}, {_SCORES}"

_TOP = f"""every_section AS (
    SELECT question_id, article_id, s.section_no, s.text, n_sections, coalesce(score, 0.0) AS score
    FROM hits JOIN sections s USING (article_id) JOIN sizes USING (article_id)
    LEFT JOIN scores USING (question_id, article_id, section_no)),
top AS (
    SELECT question_id, article_id, section_no, text, CASE WHEN n_sections > {K} THEN score END AS score,
           CAST(row_number() OVER (
               PARTITION BY question_id, article_id
               ORDER BY CASE WHEN n_sections > {K} THEN score ELSE 0 END DESC, section_no) AS INTEGER) AS rank
    FROM every_section QUALIFY rank <= {K})"""
TOP = f"{SCORES}, {_TOP}"

# The same ranking over stems: the tokens of sections and questions are replaced, everything else stays.
STEMMED_TOP = f"""{TOKENS.replace("tokens AS (", "plain_tokens AS MATERIALIZED (", 1)},
{ASKED_TOKENS.replace("asked_tokens AS (", "plain_asked AS MATERIALIZED (", 1)},
vocabulary AS (
    SELECT DISTINCT token FROM (
        SELECT unnest(tokens) AS token FROM plain_tokens UNION ALL SELECT unnest(tokens) FROM plain_asked)),
{stem_tables().replace("stems AS (", "stems AS MATERIALIZED (", 1)},
token_stems AS MATERIALIZED (
    SELECT article_id, section_no, list(stem) AS stems
    FROM (SELECT article_id, section_no, unnest(tokens) AS token FROM plain_tokens) JOIN stems USING (token)
    GROUP BY article_id, section_no),
tokens AS MATERIALIZED (
    SELECT article_id, section_no, coalesce(stems, []) AS tokens
    FROM plain_tokens LEFT JOIN token_stems USING (article_id, section_no)),
asked_tokens AS (
    SELECT question_id, list(stem) AS tokens
    FROM (SELECT question_id, unnest(tokens) AS token FROM plain_asked) JOIN stems USING (token) GROUP BY question_id),
{_STATS}, {_SCORES}, {_TOP}"""

LABELLED = f"""{TOP}, labelled AS (
    SELECT question_id, article_id,
           '{{' || string_agg(to_json('section_' || rank)::VARCHAR || ':' || to_json(text)::VARCHAR, ',' ORDER BY rank)
               || '}}' AS sections
    FROM top GROUP BY question_id, article_id)"""

HEAD = text_literal(shared.OPENING + "\n\n" + shared.BLOCK + "\n\nQUESTION: ")
PROMPTS = f"""{LABELLED}, prompts AS (
    SELECT question_id, article_id, sections, {HEAD} || b.text || chr(10) || sections || chr(10) AS prompt
    FROM labelled JOIN benchmark b ON b.item_id = question_id)"""


def _markup_text() -> str:
    text = "regexp_replace(html, '[\\x01\\x02\\x03]', ' ', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "head"):
        text = f"regexp_replace({text}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    ends = (
        "article|aside|blockquote|body|div|dl|dt|dd|figure|footer|form|header|hr|html|li|main|ol|pre|section|table|td|th|tr"
        "|ul|h1|h2|h3|h4|h5|h6|p"
    )
    text = f"regexp_replace({text}, '(?i)<(h1|h2|h3|h4|h5|h6)(\\s[^>]*)?>', chr(1), 'g')"
    text = f"regexp_replace({text}, '(?i)<(p)(\\s[^>]*)?>', chr(3), 'g')"
    return f"regexp_replace({text}, '(?i)</?({ends})(\\s[^>]*)?/?>', chr(2), 'g')"


# The references that the pages hold; the ampersand comes last so that nothing is decoded twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "\xa9", "&middot;": "\xb7", "&amp;": "&"}


def _plain(text: str) -> str:
    text = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for entity, char in REFERENCES.items():
        text = f"replace({text}, {text_literal(entity)}, {text_literal(char)})"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


MARKUP = f"""cut AS (SELECT page_id, string_split({_markup_text()}, chr(1)) AS pieces FROM pages),
pieces AS (SELECT page_id, generate_subscripts(pieces, 1) AS piece_no, unnest(pieces) AS piece FROM cut),
starts AS (
    SELECT page_id, piece_no, CASE WHEN piece_no = 1 THEN ''
               ELSE {_plain("string_split(replace(piece, chr(3), chr(2)), chr(2))[1]")} END AS title,
           string_split(piece, chr(3))[2:] AS texts
    FROM pieces),
spread AS (SELECT page_id, piece_no, title, generate_subscripts(texts, 1) AS text_no, unnest(texts) AS raw FROM starts),
plain AS (SELECT *, {_plain("string_split(raw, chr(2))[1]")} AS text FROM spread),
paragraph AS (
    SELECT page_id, title, text,
           CAST(row_number() OVER (PARTITION BY page_id ORDER BY piece_no, text_no) - 1 AS INTEGER) AS section_no
    FROM plain WHERE text <> ''),
web AS (
    SELECT page_id AS article_id, 1 AS n_abstract, CAST(count(*) - 1 AS INTEGER) AS n_sections,
           max(text) FILTER (section_no = 0) AS abstract,
           coalesce(string_agg(text, chr(10) ORDER BY section_no) FILTER (section_no > 0), '') AS sections
    FROM paragraph GROUP BY page_id)"""

BRIEF = f"""{LINES}, brief AS (
    SELECT article_id, CAST(len(lines[1:1]) AS INTEGER) AS n_abstract, CAST(len(lines[2:]) AS INTEGER) AS n_sections,
           array_to_string(lines[1:1], chr(10)) AS abstract, array_to_string(lines[2:], chr(10)) AS sections
    FROM lines)"""

JOURNALS = """lines AS (
    SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x:
               trim(regexp_replace(x, '[\\s\\x0B\\x{a0}\\x01-\\x08\\x0E-\\x1F]+', ' ', 'g'))), lambda x: x <> '') AS l
    FROM documents),
journal AS (
    SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi,
           CAST(greatest(0, ceil((len(l) - 2) / 2)) AS INTEGER) AS n_sec,
           CAST(least(2, len(l)) AS INTEGER) AS n_abstract, CAST(greatest(0, len(l) - 2) AS INTEGER) AS n_sections,
           array_to_string(l[:2], chr(10)) AS abstract, array_to_string(l[3:], chr(10)) AS sections,
           array_to_string(list_transform(l[3:], lambda x, i: 'Part ' || CAST((i - 1) // 2 AS VARCHAR)), chr(10)) AS titles
    FROM lines)"""
RESOLVED = f"""{MARKUP}, {BRIEF}, joined AS (
    SELECT d.doc_id AS article_id, l.doc_id AS known, w.abstract AS w_abstract, w.sections AS w_sections,
           w.n_sections AS w_n, b.*
    FROM documents d JOIN brief b ON b.article_id = d.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN web w ON w.article_id = d.doc_id),
tagged AS (
    SELECT *, CASE WHEN w_n >= {fixed.MIN_FULL_TEXT_SECTIONS} THEN '{fixed.FORMAT_FULL_TEXT}'
                   WHEN n_abstract > 0 AND known IS NOT NULL AND w_n > 0 THEN '{fixed.FORMAT_ABSTRACT_AND_PDF}'
                   WHEN n_abstract > 0 THEN '{fixed.FORMAT_ABSTRACT}' END AS format
    FROM joined)"""

INPUTS = """inputs AS (
    SELECT 'nation' AS param, n_nationkey AS pos, n_name AS name, [r_name, r_name || ' region'] AS search_aliases,
           [r_name] AS question_aliases
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT DISTINCT 'brand', CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) - 1, p_brand, NULL, NULL FROM part)"""

GRID = f"""{INPUTS}, grid AS (
    SELECT n.pos * (SELECT count(*) FROM inputs WHERE param = 'brand') + b.pos AS question_id,
           n.name AS nation, b.name AS brand, n.search_aliases AS nation_search, n.question_aliases AS nation_question
    FROM (SELECT * FROM inputs WHERE param = 'nation') n, (SELECT * FROM inputs WHERE param = 'brand') b)"""

_before, _between, _after = "What does ", " make of ", ", and why?"

RECORDS = """stored_once AS (
    SELECT doc_id + 1 AS id, CAST(doc_id AS VARCHAR) AS pubmed_id, 'quality' AS topic, 'stored ' || quality AS note
    FROM labels),
stored AS (SELECT * FROM stored_once UNION ALL SELECT id + 10000000, pubmed_id, topic, note FROM stored_once),
incoming AS (
    SELECT CAST(doc_id AS VARCHAR) AS pubmed_id, 'quality' AS topic, lang AS first_note, source AS last_note
    FROM documents),
lowest AS (SELECT topic, pubmed_id, min(id) AS id FROM stored GROUP BY topic, pubmed_id),
matched AS (SELECT i.*, l.id FROM incoming i LEFT JOIN lowest l USING (topic, pubmed_id)),
numbered AS (
    SELECT *, (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY topic, pubmed_id) AS new_id
    FROM matched WHERE id IS NULL)"""

# Typed reading of the generated answers.
_KIND = "json_type(j, '$.{f}')"


def _given(f: str) -> str:
    return f"coalesce({_KIND.format(f=f)}, 'NULL') <> 'NULL'"


def _choice(f: str, aliases: list[str], value: str) -> str:
    listed = ", ".join(f"'{a}'" for a in aliases)
    return f"{value} IN ({listed})"


_elements = "list_transform(json_extract(j, '$.{f}[*]'), lambda e: {body})"
_bad_evidence = "len(list_filter(json_extract(j, '$.evidence[*]'), lambda e: json_type(e) NOT IN ('BIGINT', 'UBIGINT'))) > 0"
_bad_kinds = (
    "len(list_filter(json_extract(j, '$.kinds[*]'), lambda e: json_type(e) <> 'VARCHAR' "
    "OR json_extract_string(e, '$') NOT IN ('PR', 'LI'))) > 0"
)
PARSED = f"""answers AS (SELECT doc_id, {shared.ANSWER} AS response FROM labels),
bare AS (
    SELECT doc_id, response, CASE
        WHEN doc_id % 10 = 1 THEN regexp_extract(response, '(?s)```json(.*?)```', 1)
        WHEN doc_id % 20 = 9 THEN replace(regexp_extract(response, '(?s)\\{{.*\\}}', 0), chr(10), '\\n')
        ELSE response END AS t
    FROM answers),
read AS (SELECT doc_id, response, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM bare),
judged AS (
    SELECT *, CASE
        WHEN j IS NULL THEN 'invalid_json'
        WHEN json_type(j) <> 'OBJECT' THEN 'not_object'
        WHEN {_given('verdict')} AND {_KIND.format(f='verdict')} <> 'VARCHAR' THEN 'type:verdict'
        WHEN {_given('verdict')} AND NOT {_choice('verdict', ['UN', 'US', 'HA'], "json_extract_string(j, '$.verdict')")}
            THEN 'value:verdict'
        WHEN {_given('evidence')} AND {_KIND.format(f='evidence')} <> 'ARRAY' THEN 'type:evidence'
        WHEN {_given('evidence')} AND {_bad_evidence} THEN 'value:evidence'
        WHEN {_KIND.format(f='kinds')} IS NULL THEN 'missing:kinds'
        WHEN {_KIND.format(f='kinds')} <> 'ARRAY' THEN 'type:kinds'
        WHEN {_bad_kinds} THEN 'value:kinds'
        WHEN {_KIND.format(f='note')} IS NULL THEN 'missing:note'
        WHEN {_KIND.format(f='note')} <> 'VARCHAR' THEN 'type:note'
        WHEN {_given('weight')} AND {_KIND.format(f='weight')} NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'type:weight'
        WHEN {_given('flagged')} AND {_KIND.format(f='flagged')} <> 'BOOLEAN' THEN 'type:flagged'
        WHEN {_given('analysis')} AND {_KIND.format(f='analysis')} <> 'OBJECT' THEN 'type:analysis'
    END AS reject_reason FROM read),
parsed AS (
    SELECT doc_id, response, reject_reason,
           CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.verdict') END AS verdict,
           CASE WHEN reject_reason IS NULL AND {_given('evidence')}
                THEN array_to_string({_elements.format(f='evidence', body='e::VARCHAR')}, ',') END AS evidence,
           CASE WHEN reject_reason IS NULL
                THEN {_elements.format(f='kinds', body="json_extract_string(e, '$')")} END AS kind_list,
           CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.note') END AS note,
           CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.weight')::DOUBLE END AS weight,
           CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.flagged')::BOOLEAN END AS flagged,
           CASE WHEN reject_reason IS NULL THEN json_extract(j, '$.analysis')::VARCHAR END AS analysis
    FROM judged)"""
PARSED_COLUMNS = "doc_id, verdict, evidence, array_to_string(kind_list, ',') AS kinds, note, weight, flagged, analysis"


def _named(feature_index: int, value: str, what: str) -> str:
    cases = " ".join(
        f"WHEN '{a.alias}' THEN {text_literal(getattr(a, what))}" for a in shared.FEATURES[feature_index].allowed_values
    )
    return f"CASE {value} {cases} END"


def _named_list(what: str) -> str:
    return f"array_to_string(list_transform(kind_list, lambda e: {_named(2, 'e', what)}), ',')"


def _ranked_prompt_answers() -> str:
    return f"""SELECT question_id, article_id,
       '{{"size_class": "' || CASE WHEN length(prompt) > {shared.LONG_PROMPT} THEN 'L' ELSE 'S' END
           || '", "n_chars": ' || length(prompt) || '}}' AS response,
       length(prompt) / 1000 AS cost, CAST(NULL AS VARCHAR) AS error
FROM prompts"""


def _stream_prompt() -> str:
    from litscreen.operators.prompts import prompt_opening

    head = text_literal(prompt_opening(shared.item_review()) + "\n\nQUESTION: ")
    return f"{head} || b.text || chr(10) || sections || chr(10)"


ORACLE = {
    "read_articles": f"WITH {BRIEF} SELECT * FROM brief",
    "sections_from_markup": f"WITH {MARKUP} SELECT page_id, section_no, title, text FROM paragraph",
    "search_corpus": f"WITH {SECTIONS}, {HITS} SELECT * FROM hits",
    "search_index": f"WITH {SECTIONS}, {HITS} SELECT * FROM hits",
    "stream_search": f"WITH {SECTIONS}, {HITS} SELECT * FROM hits",
    "search_corpus_grid": f"""WITH {SECTIONS}, {GRID}, grid_terms AS (
            SELECT question_id, 0 AS group_no, unnest(list_concat([nation], nation_search)) AS term FROM grid
            UNION ALL SELECT question_id, 1, brand FROM grid UNION ALL SELECT question_id, 1, 'that' FROM grid
            UNION ALL SELECT question_id, 2, 'the' FROM grid UNION ALL SELECT question_id, 2, 'of' FROM grid
            UNION ALL SELECT question_id, 0, 'the' FROM grid WHERE question_id % 2 = 0
            UNION ALL SELECT question_id, 0, 'que' FROM grid WHERE question_id % 2 = 1),
        split AS (SELECT question_id, group_no, regexp_extract_all(lower(term), '{SEARCH}') AS w FROM grid_terms),
        terms AS (SELECT DISTINCT question_id, group_no, array_to_string(w, ' ') AS term FROM split),
        paragraphs AS (
            SELECT article_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{SEARCH}'), ' ') || ' ' AS norm FROM sections),
        at_all AS (
            SELECT DISTINCT term, article_id FROM (SELECT DISTINCT term FROM terms) JOIN paragraphs ON contains(norm, ' ' || term || ' ')),
        found AS (
            SELECT question_id, article_id, count(*) AS n_terms, count(DISTINCT group_no) AS n_groups
            FROM terms JOIN at_all USING (term) GROUP BY question_id, article_id)
        SELECT question_id, article_id, n_terms,
               CAST(row_number() OVER (PARTITION BY question_id ORDER BY n_terms DESC, article_id) AS INTEGER) AS rank
        FROM found WHERE n_groups = 3 QUALIFY rank <= {fixed.TOP_ARTICLES_PER_SEARCH}""",
    "input_grid_sparse": f"WITH {GRID} SELECT question_id, nation, brand FROM grid",
    "map_external_ids": """SELECT d.doc_id AS article_id, 'PMC' || l.doc_id AS external_id
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "explode_locations": """SELECT page_id, 0 AS pos, url FROM pages
        UNION ALL SELECT page_id, 1, url || '.pdf' FROM pages""",
    "first_valid_candidate": f"""SELECT regexp_extract(url, '//([^/]+)', 1) AS article_id, page_id AS pos, url,
            CAST(strlen(html) AS INTEGER) AS size
        FROM pages WHERE strlen(html) > {fixed.MIN_PDF_BYTES}
        QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) = 1""",
    "pending_fetch": """SELECT doc_id AS article_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "full_text_gate": f"WITH {BRIEF} SELECT * FROM brief WHERE n_sections >= {fixed.MIN_FULL_TEXT_SECTIONS}",
    "drop_empty_articles": f"WITH {MARKUP} SELECT * FROM web",
    "journal_articles": f"WITH {JOURNALS} SELECT article_id, doi, n_sec, n_abstract, n_sections, abstract, sections, titles FROM journal",
    "resolve_journals": f"""WITH {MARKUP}, {JOURNALS}, tagged AS (
        SELECT j.article_id, j.n_abstract, j.n_sections, w.n_sections AS w_n,
               CASE WHEN n_sec >= 2 THEN 'PMC' WHEN doi IS NOT NULL AND w.n_sections > 0 THEN 'PUBMED | PDF' ELSE 'PUBMED' END AS format
        FROM journal j LEFT JOIN web w USING (article_id) WHERE j.n_abstract > 0)
    SELECT article_id, format, n_abstract, CAST(CASE WHEN format = 'PUBMED | PDF' THEN w_n ELSE n_sections END AS INTEGER) AS n_sections FROM tagged""",
    "stream_resolved": f"""WITH {MARKUP}, {BRIEF}, landed AS (
        SELECT b.article_id, b.n_abstract, b.n_sections, w.n_sections AS w_n, b.article_id % 3 AS third,
               b.n_sections >= {fixed.MIN_FULL_TEXT_SECTIONS} AS is_full, l.doc_id IS NOT NULL AND w.n_sections > 0 AS is_pdf
        FROM brief b LEFT JOIN labels l ON l.doc_id = b.article_id LEFT JOIN web w ON w.article_id = b.article_id
        WHERE b.n_abstract > 0)
    SELECT article_id, CASE WHEN is_full AND third = 0 THEN 'PMC' WHEN is_pdf THEN 'PUBMED | PDF' ELSE 'PUBMED' END AS format,
           n_abstract, CASE WHEN NOT (is_full AND third = 0) AND is_pdf THEN w_n ELSE n_sections END AS n_sections
    FROM landed
    UNION ALL SELECT article_id, 'PMC', n_abstract, n_sections FROM landed WHERE is_full AND third = 1""",
    "resolve_articles": f"""WITH {RESOLVED}
        SELECT article_id, format,
               CASE WHEN format = '{fixed.FORMAT_FULL_TEXT}' THEN 1 ELSE n_abstract END AS n_abstract,
               CASE WHEN format = '{fixed.FORMAT_ABSTRACT}' THEN n_sections ELSE w_n END AS n_sections,
               CASE WHEN format = '{fixed.FORMAT_FULL_TEXT}' THEN w_abstract ELSE abstract END AS abstract,
               CASE WHEN format = '{fixed.FORMAT_ABSTRACT}' THEN sections ELSE w_sections END AS sections
        FROM tagged WHERE format IS NOT NULL""",
    "review_from_sources": f"""WITH {RESOLVED},
        paragraphs AS (
            SELECT article_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{SEARCH}'), ' ') || ' ' AS norm
            FROM (SELECT article_id, unnest(lines) AS text FROM lines)),
        words AS (SELECT unnest([{", ".join(f"'{w}'" for w in shared.REVIEW_WORDS)}]) AS item),
        found AS (
            SELECT DISTINCT item, article_id FROM words JOIN paragraphs ON contains(norm, ' ' || item || ' ')),
        best AS (
            SELECT item, article_id FROM found
            QUALIFY row_number() OVER (PARTITION BY item ORDER BY article_id) <= {fixed.TOP_ARTICLES_PER_SEARCH})
        SELECT item, article_id, format FROM best JOIN tagged USING (article_id) WHERE format IS NOT NULL""",
    "parse_aliases": f"""WITH {INPUTS} SELECT param, pos, name, array_to_string(search_aliases, '|') AS search_aliases,
        array_to_string(question_aliases, '|') AS question_aliases FROM inputs""",
    "input_grid": f"WITH {GRID} SELECT question_id, nation, brand FROM grid",
    "build_search_query": f"""WITH {GRID} SELECT question_id, '(' || nation || ' OR ' || array_to_string(nation_search, ' OR ')
        || ') AND (' || brand || ') {shared.EXTRA_KEYWORDS}' AS search_query FROM grid""",
    "search_terms": f"""WITH {GRID}, raw AS (
            SELECT question_id, 0 AS group_no, unnest(list_concat([nation], nation_search)) AS term FROM grid
            UNION ALL SELECT question_id, 1, brand FROM grid
            UNION ALL SELECT question_id, 2, unnest({shared.EXTRA_GROUPS[0]}) FROM grid),
        split AS (SELECT question_id, group_no, regexp_extract_all(lower(term), '{SEARCH}') AS w FROM raw)
        SELECT DISTINCT question_id, group_no, array_to_string(w, ' ') AS term, CAST(len(w) AS INTEGER) AS n_words
        FROM split""",
    "format_question": f"""WITH {GRID} SELECT question_id, '{_before}' || nation || ' (a.k.a ' ||
        array_to_string(nation_question, ', ') || ')' || '{_between}' || brand || '{_after}' AS question FROM grid""",
    "screening_pairs": f"""WITH {SECTIONS}, {HITS} SELECT question_id, article_id, rank, b.text AS question
        FROM hits JOIN benchmark b ON b.item_id = question_id JOIN lines USING (article_id)
        WHERE len(lines) > {fixed.MIN_FULL_TEXT_SECTIONS}""",
    "explode_sections": f"WITH {SECTIONS} SELECT article_id, section_no, text FROM sections",
    "tokenize": f"""WITH {SECTIONS} SELECT article_id, section_no,
        array_to_string(regexp_extract_all(lower(text), '{WORDS}'), ' ') AS tokens FROM sections""",
    "remove_stopwords": f"""WITH {TOKENS} SELECT article_id, section_no, CAST(len(tokens) AS INTEGER) AS dl,
        array_to_string(tokens, ' ') AS tokens FROM tokens""",
    "stem_tokens": f"""WITH vocabulary AS (
            SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents), {stem_tables()}
        SELECT token, stem FROM stems""",
    "section_term_stats": f"WITH {STATS} SELECT * FROM stats",
    "bm25_scores": f"WITH {SCORES} SELECT * FROM scores",
    "top_sections": f"WITH {TOP} SELECT question_id, article_id, section_no, score, rank FROM top",
    "top_sections_stemmed": f"WITH {STEMMED_TOP} SELECT question_id, article_id, section_no, score, rank FROM top",
    "label_sections": f"WITH {LABELLED} SELECT * FROM labelled",
    "render_examples": """SELECT u.conv_id, u.turn, 'QUESTION: ' || u.text || chr(10) || '{"section_1":' || to_json(u.text)::VARCHAR
            || '}' || chr(10) || '{"answer":' || to_json(a.text)::VARCHAR || '}' AS example
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "build_prompts": f"WITH {PROMPTS} SELECT question_id, article_id, prompt FROM prompts",
    "run_extractor": f"WITH {PROMPTS} {_ranked_prompt_answers()}",
    "few_shot_prompts": """SELECT item_id AS question_id, 'Read the sections and answer in JSON.' || chr(10) || chr(10)
            || 'QUESTION: one' || chr(10) || '{"section_1": "A list."}' || chr(10) || '{"size_class":"S","n_chars":7}' || chr(10) || chr(10)
            || 'QUESTION: two' || chr(10) || '{"section_1": "Text."}' || chr(10) || '{"size_class":"L","n_chars":2000}' || chr(10) || chr(10)
            || 'QUESTION: ' || text || chr(10) || '{}' || chr(10) AS prompt
        FROM benchmark""",
    "extraction_failures": f"""WITH {PROMPTS} SELECT question_id, article_id, 'ValueError: no answer' AS error
        FROM prompts WHERE length(prompt) % 7 = 0""",
    "parse_responses": f"WITH {PARSED} SELECT {PARSED_COLUMNS}, reject_reason FROM parsed",
    "split_rejects_good": f"WITH {PARSED} SELECT {PARSED_COLUMNS} FROM parsed WHERE reject_reason IS NULL",
    "split_rejects_bad": f"WITH {PARSED} SELECT doc_id, response, reject_reason FROM parsed WHERE reject_reason IS NOT NULL",
    "expand_allowed_values": f"""WITH {PARSED} SELECT doc_id, verdict, {_named(0, 'verdict', 'name')} AS verdict_name,
        {_named(0, 'verdict', 'description')} AS verdict_description, {_named_list('name')} AS kinds_name,
        {_named_list('description')} AS kinds_description FROM parsed""",
    "cost_summary": """SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed,
        CAST(coalesce(sum(CAST(value AS DECIMAL(28, 15))) FILTER (event_type <> 'error'), 0) AS DECIMAL(38, 6)) AS total_cost
        FROM events""",
    "cost_summary_small": """SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed,
        CAST(round(coalesce(sum(CAST(value AS DECIMAL(28, 15)) / 1000000) FILTER (event_type <> 'error'), 0), 6) AS DECIMAL(38, 6)) AS total_cost
        FROM events""",
    "run_summary": """SELECT count(*) AS pairs, count(*) FILTER (event_type = 'purchase') AS added,
        CAST(coalesce(sum(CAST(value AS DECIMAL(28, 15))) FILTER (event_type <> 'error'), 0) AS DECIMAL(38, 6)) AS total_cost
        FROM events""",
    "project_columns": """SELECT CAST(doc_id AS VARCHAR) AS pubmed_id, 'PUBMED' AS format, text AS sections, lang AS item,
            CASE WHEN quality = 1 THEN 'L' ELSE 'S' END AS size_class, CAST(quality + toxic AS BIGINT) AS n_chars
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "serialise_record": """SELECT doc_id, lang, '[' || coalesce(CAST(quality AS VARCHAR), 'null') || ',' || coalesce(CAST(toxic AS VARCHAR), 'null') || ']' AS marks,
            '{"section_1":' || to_json(text)::VARCHAR || '}' AS sections,
            '{"source":' || to_json(source)::VARCHAR || ',"n_chars":' || n_chars || '}' AS origin
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "find_existing": f"WITH {RECORDS} SELECT topic, pubmed_id, id FROM matched",
    "pending_extractions": f"WITH {RECORDS} SELECT topic, pubmed_id FROM matched WHERE id IS NULL",
    "pending_extractions_overwrite": f"WITH {RECORDS} SELECT topic, pubmed_id FROM matched",
    "assign_record_ids": f"WITH {RECORDS} SELECT new_id AS id, topic, pubmed_id FROM numbered",
    "upsert_results": f"""WITH {RECORDS} SELECT id, pubmed_id, topic, note FROM stored
        UNION ALL SELECT new_id, pubmed_id, topic, first_note FROM numbered""",
    "upsert_results_overwrite": f"""WITH {RECORDS} SELECT s.id, s.pubmed_id, s.topic, coalesce(m.last_note, s.note) AS note
        FROM stored s LEFT JOIN matched m ON m.id = s.id
        UNION ALL SELECT new_id, pubmed_id, topic, last_note FROM numbered""",
    "result_table": """WITH first AS (
            SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS id FROM labels),
        fresh AS (
            SELECT doc_id, (SELECT max(id) FROM first) + row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS id
            FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT id, CAST(doc_id AS VARCHAR) AS pubmed_id, 'PUBMED' AS format, '{}' AS sections, 'all' AS item,
               'L' AS size_class, n_chars
        FROM (SELECT * FROM first UNION ALL SELECT * FROM fresh) JOIN documents USING (doc_id)""",
    "reset_result_table": """SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS id,
               CAST(doc_id AS VARCHAR) AS pubmed_id, 'PUBMED' AS format, '{}' AS sections, 'all' AS item, 'L' AS size_class, n_chars
        FROM documents""",
    "pending_extractions_stored": """SELECT 'all' AS item, CAST(doc_id AS VARCHAR) AS pubmed_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "stream_articles": f"WITH {MARKUP} SELECT * FROM web",
    "stream_screen": f"""WITH {LABELLED}, prompts AS (
            SELECT question_id, article_id, sections, length({_stream_prompt()}) AS n_chars
            FROM labelled JOIN benchmark b ON b.item_id = question_id)
        SELECT CAST(article_id AS VARCHAR) AS pubmed_id, 'PUBMED' AS format, sections,
               CAST(question_id AS VARCHAR) AS item,
               CASE WHEN n_chars > {shared.LONG_PROMPT} THEN 'L' ELSE 'S' END AS size_class, n_chars
        FROM prompts""",
}
