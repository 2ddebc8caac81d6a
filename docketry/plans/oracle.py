"""DuckDB SQL for the registered queries, built from the same fixed tables."""

from __future__ import annotations

from docketry.plans import queries as Q
from docketry.plans.tables import CODES, INVENTOR_COUNT
from docketry.schema import (
    ABBREVIATIONS,
    COUNTRY_NAMES,
    FIELD_KEYWORDS,
    INDEXED_FIELDS,
    IPC_SECTIONS,
    SAMPLE_ABSTRACT,
    SAMPLE_CLAIMS,
    SAMPLE_CODES,
    SAMPLE_COMPANIES,
    SAMPLE_DESCRIPTION,
    SAMPLE_FIELDS,
    SAMPLE_INVENTORS,
    SAVED_QUERIES,
)

DIM = 384
NL = "chr(10)"
BLANKS = "(chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160))"
# Letters of the test texts that come apart under NFKD, by base letter.
ACCENTED = {
    "a": "ä", "c": "ç", "e": "éèê", "i": "í", "n": "ñ", "o": "óö", "u": "ü",
    "A": "Ä", "C": "Ç", "E": "ÉÈÊ", "I": "Í", "N": "Ñ", "O": "ÓÖ", "U": "Ü",
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def apart(x: str) -> str:
    for base, letters in ACCENTED.items():
        x = f"regexp_replace({x}, '[{letters}]', '{base}'||chr(769), 'g')"
    return x


def abbrev(x: str) -> str:
    for short, full in ABBREVIATIONS.items():
        x = f"replace({x}, {lit(short)}, {lit(full)})"
    return x


def spaces(x: str) -> str:
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s.,\\-()/:]', ' ', 'g')"
    return f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"


def clean(x: str) -> str:
    return spaces(abbrev(apart(tags(x))))


def each(f, x: str) -> str:
    return f"list_transform({x}, lambda e: {f('e')})"


def keep(x: str, condition: str) -> str:
    return f"list_filter({x}, lambda e: {condition})"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def claims_of(section: str) -> str:
    parts = f"regexp_split_to_array({clean(section)}, '\\s*\\p{{Nd}}+\\.\\s*')[2:]"
    kept = keep(each(lambda e: f"trim({e})", parts), "length(e) > 20")
    marks = "\\[\\p{Nd}+\\]|\\(\\p{Nd}+\\)"
    cleaned = each(lambda e: spaces(abbrev(f"regexp_replace({e}, '{marks}', '', 'g')")), kept)
    return keep(cleaned, "e <> ''")


def ipc(codes: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in IPC_SECTIONS.items())
    return f"CASE upper(substr({codes}[1], 1, 1)) {cases} ELSE 'Unknown' END"


def by_keywords(content: str) -> str:
    """Expects `content` to be a plain column."""
    def hits(k: str) -> str:
        return f"(length({content}) - length(replace({content}, {lit(k)}, ''))) // {len(k)}"

    scores = "[" + ", ".join("(" + " + ".join(map(hits, words)) + ")" for words in FIELD_KEYWORDS.values()) + "]"
    names = lits(FIELD_KEYWORDS)
    return f"CASE WHEN list_max({scores}) > 0 THEN {names}[list_position({scores}, list_max({scores}))] ELSE 'Unknown' END"


BASE = f"""base AS (
  SELECT d.doc_id, concat('D', d.doc_id) AS patent_id, split_part(d.text, {NL}, 1) AS title,
    d.text AS abstract, d.text AS description,
    {keep(each(strip, f"string_split(d.text, {NL})[2:]"), "e <> ''")} AS claims,
    ['Inventor ' || (d.doc_id % {INVENTOR_COUNT}), 'Inventor ' || ((d.doc_id + 1) % {INVENTOR_COUNT})] AS inventors,
    CASE WHEN d.doc_id % 3 = 0 THEN [d.source, 'src0'] ELSE [d.source] END AS assignees,
    CASE WHEN d.doc_id % 50 = 49 THEN '' ELSE cast(date '2020-01-01' + cast(d.doc_id % 1461 AS int) AS varchar) END AS filing_date,
    [{lits(CODES)}[d.doc_id % {len(CODES)} + 1]] AS classification_codes,
    upper(d.lang) AS country,
    CASE l.quality WHEN 1 THEN 'Granted' WHEN 0 THEN 'Published' ELSE 'Pending' END AS status,
    l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
rec AS (SELECT *, {ipc("classification_codes")} AS technology_field, md5(concat(patent_id, '_', title)) AS point_id FROM base)"""


def _enhanced(claims: str) -> str:
    content = "lower(concat(strip_title, ' ', strip_text, ' ', array_to_string(claims[:3], ' ')))"
    return f""",
trimmed AS (SELECT * REPLACE ({claims} AS claims), {strip("title")} AS strip_title, {strip("abstract")} AS strip_text FROM rec),
contents AS (SELECT *, {content} AS content FROM trimmed),
enhanced AS (
  SELECT doc_id, patent_id, {clean("strip_title")} AS title, {clean("strip_text")} AS abstract, {clean("strip_text")} AS description,
    {keep(each(clean, "claims"), "length(e) > 10")} AS claims, inventors, assignees, filing_date, classification_codes,
    CASE WHEN technology_field <> 'Unknown' THEN technology_field ELSE {by_keywords("content")} END AS technology_field,
    country, status, quality
  FROM contents)"""


ENHANCED = _enhanced("claims")
# A `|` inside a claim separates claims once it has been through a CSV cell.
CSV_CLAIMS = keep(each(strip, "string_split(array_to_string(claims, '|'), '|')"), "e <> ''")
CSV_ENHANCED = _enhanced(CSV_CLAIMS)


def flat(source: str, *more: str) -> str:
    lists = ("claims", "inventors", "assignees", "classification_codes")
    columns = [f"{joined(c)} AS {c}" if c in lists else c for c in (*Q._MAIN, *more)]
    return f"SELECT {', '.join(columns)} FROM {source}"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def text_of(source: str, label: str) -> str:
    return (
        "concat_ws(' ', 'Title: ' || title, 'Abstract: ' || abstract, "
        f"'{label}: ' || technology_field, 'Claims: ' || array_to_string(claims[:3], ' '), "
        "'Description: ' || substr(description, 1, 1000)"
    )


COMBINED = text_of("rec", "Technology Field") + (
    ", 'Inventors: ' || array_to_string(inventors[:3], ', '), 'Assignees: ' || array_to_string(assignees[:2], ', '))"
)


def hashed(name: str, source: str, key: str, text: str, dim: int = DIM) -> str:
    """(key, dim, n): how many words of a row fall into each dimension."""
    return f"""{name} AS (
  SELECT {key}, dim, count(*) AS n FROM (
    SELECT {key}, ('0x' || substr(md5(w), 1, 8))::ubigint % {dim} AS dim
    FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) WHERE w <> '')
  GROUP BY ALL)"""


SCORE = "round(sum(p.n * q.n) / (sqrt(any_value(p.nn)) * sqrt(any_value(q.nn))), 9)"


def scored(points: str, queries: str, pkey: str, qkey: str) -> str:
    """Cosine of every point and query that share a dimension."""
    return f"""
pn AS (SELECT *, sum(n * n) OVER (PARTITION BY {pkey}) AS nn FROM {points}),
qn AS (SELECT *, sum(n * n) OVER (PARTITION BY {qkey}) AS nn FROM {queries}),
scores AS (SELECT p.{pkey}, q.{qkey}, {SCORE} AS score FROM pn p JOIN qn q USING (dim) GROUP BY ALL)"""


def text_search(source_ctes: str, source: str, query: str, dim: int = DIM) -> str:
    """CTEs up to `scores(point_id, qid, score)` for one query text."""
    return ",\n".join([
        source_ctes,
        f"qt AS (SELECT 0 AS qid, {lit(query)} AS t)",
        hashed("pw", source, "point_id", COMBINED, dim),
        hashed("qw", "qt", "qid", "t", dim),
        # A point without a shared word scores 0 and is still found.
        scored("pw", "qw", "point_id", "qid").strip()
        + f",\nall_scores AS (SELECT r.*, coalesce(s.score, 0) AS score FROM {source} r LEFT JOIN scores s USING (point_id))",
    ])


def ranked(source: str, limit: int, where: str = "true", partition: str = "") -> str:
    return (
        f"(SELECT *, row_number() OVER ({partition} ORDER BY score DESC, point_id)::int AS rank FROM {source} WHERE {where} "
        f"QUALIFY rank <= {limit})"
    )


TEXTS = """texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"""

STORED = "stored AS (SELECT rec.*, e.embedding::double[] AS vector FROM rec JOIN embeddings e ON e.vec_id = rec.doc_id % (SELECT count(*) FROM embeddings))"

TURNS = """turns AS (
  SELECT CASE WHEN turn < 6 THEN 'C' || conv_id END AS patent_id, CASE WHEN role <> 'system' THEN text END AS title, role AS status
  FROM conversations)"""

FILTER_COLUMNS = (
    f"patent_id, technology_field, {joined('assignees')} AS assignees, {joined('inventors')} AS inventors, country, "
    f"filing_date, {joined('classification_codes')} AS classification_codes, status"
)


def filtered(where: str) -> str:
    return with_(BASE, f"SELECT {FILTER_COLUMNS} FROM rec WHERE {where}")


def holds(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {lit(p.lower())})" for p in parts) + ")"


def any_holds(column: str, *parts: str) -> str:
    return f"len({keep(column, holds('e', *parts))}) > 0"


def facet(key: str, order: str, where: str = "true") -> str:
    return with_(BASE, f"SELECT {key} AS key, count(*) AS count FROM rec WHERE {where} GROUP BY 1 ORDER BY {order} LIMIT 10")


BY_COUNT = "count DESC, key"
YEAR = "substr(filing_date, 1, 4)"


def one_facet(name: str, key: str, order: str, where: str = "true") -> str:
    return f"(SELECT '{name}' AS facet, {key} AS key, count(*) AS count FROM rec WHERE {where} GROUP BY 2 ORDER BY {order} LIMIT 10)"


def pick(values, i: str) -> str:
    return f"{lits(values)}[({i}) % {len(values)} + 1]"


def _sample() -> str:
    field = pick(SAMPLE_FIELDS, "i")

    def fill(t: str) -> str:
        return f"replace({lit(t)}, '{{field}}', lower({field}))"

    codes = "[" + ", ".join(lit("|".join(c)) for c in SAMPLE_CODES) + "]"
    number = "'US' || (10000000 + i)"
    return f"""SELECT {number} AS patent_id, 'Advanced ' || {field} || ' System and Method ' || (i + 1) AS title,
      {fill(SAMPLE_ABSTRACT)} AS abstract, {fill(SAMPLE_DESCRIPTION)} AS description,
      concat_ws('|', {", ".join(map(fill, SAMPLE_CLAIMS))}) AS claims,
      {pick(SAMPLE_INVENTORS, "i")} || '|' || {pick(SAMPLE_INVENTORS, "i + 1")} AS inventors,
      {pick(SAMPLE_COMPANIES, "i")} AS assignees,
      printf('%d-%02d-%02d', 2023 - i % 4, i % 12 + 1, i % 28 + 1) AS filing_date,
      {codes}[i % {len(SAMPLE_CODES)} + 1] AS classification_codes, {field} AS technology_field, 'US' AS country,
      CASE WHEN i % 5 = 0 THEN 'Granted' ELSE 'Published' END AS status, 'US' || (16000000 + i) AS application_number
    FROM (SELECT doc_id AS i FROM documents)"""


def _names(expression: str, titles: bool) -> str:
    parts = keep(each(strip, f"regexp_split_to_array({expression}, '[;,|]')"), "e <> ''")
    return _clean_names(parts, titles)


def _clean_names(parts: str, titles: bool) -> str:
    if titles:
        pattern = r"\b(Dr\.|Prof\.|Mr\.|Ms\.|Mrs\.|Jr\.|Sr\.|PhD|MD)\b"
        parts = each(lambda e: f"regexp_replace({e}, '{pattern}', '', 'g')", parts)
    return joined(keep(each(clean, parts), "e <> ''"))


def _dates() -> str:
    digits = "regexp_replace(given, '[^0-9\\-]', '', 'g')"
    return f"""WITH g AS (
      SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
    s AS (SELECT o_orderkey, [day, replace(day, '-', ''), substr(replace(day, '-', ''), 3, 6), 'on ' || replace(day, '-', '.'),
            substr(day, 1, 8)][o_orderkey % 5 + 1] AS given FROM g),
    c AS (SELECT o_orderkey, {digits} AS x FROM s)
    SELECT o_orderkey, CASE
      WHEN regexp_full_match(x, '[0-9]{{8}}') THEN substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2)
      WHEN regexp_full_match(x, '[0-9]{{6}}') THEN (CASE WHEN substr(x, 1, 2) < '50' THEN '20' ELSE '19' END) || substr(x, 1, 2)
        || '-' || substr(x, 3, 2) || '-' || substr(x, 5, 2)
      ELSE x END AS date FROM c"""


ARRIVALS = """arrivals AS (
  SELECT patent_id, title, 'Allowed' AS status, md5(concat(patent_id, '_', title)) AS point_id FROM (
    SELECT patent_id, CASE WHEN quality = 1 THEN title || ' (granted)' ELSE title END AS title FROM rec WHERE quality IS NOT NULL))"""
CURRENT = "patent_id, title, status, point_id"

XML_TITLE = clean("title")
# Titles may end inside an entity, which then lacks its semicolon.
HTML_TITLE = (
    "replace(replace(replace(regexp_extract(html, '(?is)<(h1|title)[^>]*>(.*?)</(h1|title)>', 2), "
    "'&amp;', '&'), '&amp', '&'), '&quot;', chr(34))"
)
XML_SECTION = f"array_to_string(list_transform(claims, lambda e, i: i || '. ' || e), {NL})"


def _batch_queries() -> str:
    return ",\n".join([
        BASE,
        hashed("pw", "rec", "point_id", COMBINED),
        hashed("qw", "(SELECT cast(item_id AS varchar) AS query_id, text FROM benchmark)", "query_id", "text"),
        scored("pw", "qw", "point_id", "query_id").strip(),
    ])


BATCH_HITS = (
    "SELECT query_id, point_id, rank, score FROM "
    + ranked("scores", 5, "score >= 0", "PARTITION BY query_id")
)


def _turn_queries() -> str:
    turns = "(SELECT concat_ws('-', conv_id, turn) AS query_id, text FROM conversations)"
    every = f"""every AS (SELECT q.query_id, r.point_id, coalesce(s.score, 0) AS score
      FROM {turns} q CROSS JOIN rec r LEFT JOIN scores s USING (query_id, point_id))"""
    return ",\n".join([
        BASE,
        hashed("pw", "rec", "point_id", COMBINED, Q.EMBEDDING_DIM),
        hashed("qw", turns, "query_id", "text", Q.EMBEDDING_DIM),
        scored("pw", "qw", "point_id", "query_id").strip(),
        every,
    ])


def _saved() -> str:
    rows = ", ".join(f"({lit(n)}, {lit(t)}, {lit(f)})" for n, t, f in SAVED_QUERIES)
    return ",\n".join([
        BASE + ENHANCED,
        "pts AS (SELECT *, md5(concat(patent_id, '_', title)) AS point_id FROM enhanced)",
        f"qt AS (SELECT * FROM (VALUES {rows}) t(query_id, t, field))",
        hashed("pw", "pts", "point_id", COMBINED),
        hashed("qw", "qt", "query_id", "t"),
        scored("pw", "qw", "point_id", "query_id").strip(),
        "every AS (SELECT p.point_id, q.query_id, coalesce(s.score, 0) AS score FROM pts p JOIN qt q ON p.technology_field = q.field "
        "LEFT JOIN scores s ON s.point_id = p.point_id AND s.query_id = q.query_id)",
    ])


def _indexed() -> str:
    return ",\n".join([
        BASE + CSV_ENHANCED,
        "pts AS (SELECT *, md5(concat(patent_id, '_', title)) AS point_id FROM enhanced)",
    ])


def nearest(where: str = "true") -> str:
    return f"""{BASE}, {STORED},
    one AS (SELECT vector AS qv FROM stored WHERE patent_id = '{Q.SIMILAR_TO}'),
    near AS (SELECT stored.*, round(list_cosine_similarity(vector, qv), 9) AS score FROM stored, one)"""


def all_oracles() -> dict[str, str]:
    csv_main = with_(BASE + CSV_ENHANCED, flat("enhanced"))
    main = with_(BASE + ENHANCED, flat("enhanced"))
    labelled = "quality IS NOT NULL"
    xml_filed = "filing_date, filing_date AS publication_date"
    sql = {
        "src_csv": csv_main,
        "src_json_lines": main,
        "src_json": main,
        "src_json_array": main,
        "enhance_records": main,
        "stream_load": csv_main,
        "src_xml": with_(BASE, f"SELECT patent_id, {XML_TITLE} AS title, {xml_filed}, country, technology_field FROM rec"),
        "stream_xml": with_(BASE, f"SELECT patent_id, {XML_TITLE} AS title, {xml_filed}, country, technology_field FROM rec"),
        "clear_collection": with_(BASE, "SELECT point_id, patent_id, title FROM rec WHERE quality = 1"),
        "vacuum_collection": with_(BASE, "SELECT point_id, patent_id, title, CASE WHEN quality = 1 THEN 'Allowed' ELSE status END AS status FROM rec"),
        "stream_json": main,
        "stream_rejects": with_(BASE, """SELECT * FROM (SELECT CASE WHEN quality = 0 THEN 'unknown:extra'
            WHEN toxic = 1 OR title = '' THEN 'required:title' END AS reject_reason, count(*) AS rows FROM rec GROUP BY 1)
          WHERE reject_reason IS NOT NULL"""),
        "xml_fields": with_(BASE, f"""SELECT patent_id, {XML_TITLE} AS title, {clean("abstract")} AS abstract, {clean("description")} AS description,
          {joined(claims_of(XML_SECTION))} AS claims, {joined(keep(each(clean, "inventors"), "e <> ''"))} AS inventors,
          {joined(keep(each(clean, "assignees"), "e <> ''"))} AS assignees, {xml_filed},
          {joined("classification_codes")} AS classification_codes, technology_field, country, 'Published' AS status FROM rec"""),
        "html_fields": f"""SELECT page_id, {clean(HTML_TITLE)} AS title,
          coalesce(nullif(upper(regexp_extract(html, '(?i)US[0-9]{{7,}}[A-Z]?[0-9]*')), ''), 'UNKNOWN') AS patent_id FROM pages""",
        "html_blocks": with_(BASE, f"""SELECT doc_id, (doc_id + 1000)::varchar AS patent_id, {clean("title")} AS title, {clean("abstract")} AS abstract,
          {clean("description")} AS description, {joined(claims_of("array_to_string(list_transform(claims, lambda e, i: i || '. ' || e), '')"))} AS claims,
          {joined(keep(each(clean, "inventors"), "e <> ''"))} AS inventors, {joined("assignees")} AS assignees FROM rec"""),
        "src_directory": with_(BASE + CSV_ENHANCED, f"""SELECT patent_id, title, abstract, technology_field, country, status FROM enhanced WHERE {labelled}
          UNION ALL SELECT patent_id, {XML_TITLE}, {clean("abstract")}, technology_field, country, 'Published' FROM rec WHERE quality IS NULL"""),
        "src_csv_strict": with_(BASE, f"""SELECT patent_id, {strip("title")} AS title, country, '' AS status FROM rec
          WHERE country <> 'ES' AND coalesce(toxic, 0) <> 1"""),
        "src_csv_split": with_(BASE, "SELECT patent_id, title, abstract, status FROM rec"),
        "src_directory_mixed": with_(BASE + CSV_ENHANCED, """SELECT patent_id, title,
          CASE status WHEN 'Granted' THEN 'c' WHEN 'Published' THEN 'b' ELSE 'Published' END AS status FROM enhanced"""),
        "stream_directory": with_(BASE + CSV_ENHANCED, """SELECT patent_id, title,
          CASE status WHEN 'Granted' THEN 'c' WHEN 'Published' THEN 'b' ELSE 'Published' END AS status FROM enhanced"""),
        "validate_csv": with_(BASE, """SELECT country AS kind, country <> 'ES' AS is_valid,
            CASE WHEN country = 'ES' THEN 'rows longer than the header' ELSE '' END AS errors,
            'missing recommended columns: abstract, inventors, assignees, filing_date'
              || CASE WHEN country = 'FR' AND bool_or(doc_id % 2 = 0) THEN '; missing patent ids' ELSE '' END
              || CASE WHEN country = 'DE' AND count(*) > 1 THEN '; duplicate patent ids' ELSE '' END AS warnings,
            count(*) AS records FROM rec GROUP BY country"""),
        "validate_json": with_(BASE, """SELECT country AS kind, country NOT IN ('DE', 'ES') AS is_valid,
            CASE country WHEN 'DE' THEN 'invalid JSON' WHEN 'ES' THEN 'missing fields: title' ELSE '' END AS errors,
            '' AS warnings, CASE WHEN country <> 'DE' THEN count(*) + 1 END AS records FROM rec GROUP BY country"""),
        "validate_xml": with_(BASE, """SELECT country AS kind, country <> 'DE' AS is_valid, CASE WHEN country = 'DE' THEN 'invalid XML' ELSE '' END AS errors,
            CASE WHEN country = 'FR' THEN 'no patent elements' ELSE '' END AS warnings,
            CASE WHEN country = 'FR' THEN 0 ELSE count(*) END AS records FROM rec GROUP BY country"""),
        "file_profile": """SELECT * FROM (VALUES ('csv', true, (SELECT count(*) FROM documents JOIN labels USING (doc_id))),
          ('txt', false, NULL), ('xml', true, NULL)) t(suffix, supported, records)""",
        "quality_report": f"""WITH {TURNS},
          a AS (SELECT count(*) AS n, count(*) FILTER (patent_id IS NULL) AS no_id, count(*) FILTER (coalesce(title, '') = '') AS no_title,
            count(patent_id) - count(DISTINCT patent_id) AS dup FROM turns)
          SELECT * FROM (
            SELECT 'warning' AS severity, 'missing recommended column' AS "check", c AS detail, n FROM a, unnest(['abstract', 'inventors', 'assignees', 'filing_date']) t(c)
            UNION ALL SELECT 'suggestion', 'add columns', 'abstract,inventors,assignees,filing_date', n FROM a
            UNION ALL SELECT 'warning', 'duplicate id', 'patent_id', dup FROM a
            UNION ALL SELECT 'warning', 'missing value', 'patent_id', no_id FROM a
            UNION ALL SELECT 'warning', 'missing value', 'title', no_title FROM a) WHERE n > 0""",
        "sample_records": _sample(),
        "roundtrip_csv": with_(BASE, f"SELECT * FROM ({flat(f'''(SELECT * REPLACE ({CSV_CLAIMS} AS claims, {strip('title')} AS title, {strip('abstract')} AS abstract, {strip('description')} AS description) FROM rec)''')})"),
        "roundtrip_json": with_(BASE, flat("rec")),
        "json_roundtrip": with_(BASE, flat("rec")),
        "export_limit": with_(BASE, f"SELECT point_id, patent_id, title FROM rec ORDER BY point_id LIMIT {Q.EXPORTED}"),
        "export_limit_by_range": with_(BASE, f"SELECT point_id, patent_id, title FROM rec ORDER BY point_id LIMIT {Q.EXPORTED}"),
        "upsert_latest": with_(f"{BASE}, {ARRIVALS}", f"SELECT {CURRENT} FROM rec WHERE point_id NOT IN (SELECT point_id FROM arrivals) UNION ALL SELECT {CURRENT} FROM arrivals"),
        "update_by_id": with_(f"{BASE}, {ARRIVALS}", f"SELECT {CURRENT} FROM rec WHERE patent_id NOT IN (SELECT patent_id FROM arrivals) UNION ALL SELECT {CURRENT} FROM arrivals"),
        "delete_by_id": with_(BASE, f"SELECT {CURRENT} FROM rec WHERE coalesce(toxic, 0) <> 1"),
        "collection_changes": with_(BASE, f"""SELECT {CURRENT} FROM (
            SELECT patent_id, title, CASE WHEN quality = 0 THEN 'Allowed' ELSE status END AS status, point_id, toxic FROM rec
            UNION ALL SELECT patent_id, title || ' (again)', status, md5(concat(patent_id, '_', title, ' (again)')), toxic FROM rec WHERE quality = 1)
          WHERE coalesce(toxic, 0) <> 1"""),
        "normalize_records": f"""SELECT patent_id, title, {strip("abstract")} AS abstract, '' AS description, '' AS claims, '' AS inventors,
            source || '|' || lang AS assignees, '' AS filing_date, classification_codes,
            CASE WHEN classification_codes <> '' THEN 'Physics' ELSE 'Unknown' END AS technology_field,
            CASE WHEN lang = 'en' THEN 'EP' ELSE 'US' END AS country, 'Published' AS status,
            patent_id AS patent_number
          FROM (SELECT 'D' || doc_id AS patent_id, {strip(f"split_part(text, {NL}, 1)")} AS title, text AS abstract, source, lang,
            CASE WHEN doc_id % 2 = 0 THEN 'g06N3/00|A61B5/00' ELSE '' END AS classification_codes FROM documents WHERE lang <> 'es')""",
        "load_counts": f"""WITH {TURNS} SELECT CASE WHEN coalesce(patent_id, '') = '' THEN 'required:patent_id'
            WHEN coalesce(title, '') = '' THEN 'required:title' ELSE 'accepted' END AS outcome, count(*) AS rows FROM turns GROUP BY 1""",
        "combined_text": with_(BASE, f"SELECT patent_id, {COMBINED} AS content FROM rec"),
        "searchable_text": with_(BASE, f"SELECT patent_id, {text_of('rec', 'Technology')}) AS content FROM rec"),
        "metadata_text": with_(BASE, """SELECT patent_id, concat('Inventors: ', array_to_string(inventors, ', '), ' Assignees: ', array_to_string(assignees, ', '),
          ' Classification: ', array_to_string(classification_codes, ', '), ' Country: ', country, ' Status: ', status) AS content FROM rec"""),
        "ipc_section": with_(BASE, "SELECT patent_id, classification_codes[1] AS main_code, substr(classification_codes[1], 1, 1) AS section FROM rec"),
        "point_id": with_(BASE, "SELECT patent_id, point_id FROM rec"),
        "filter_field_eq": filtered("technology_field = 'Physics'"),
        "filter_assignees_all": filtered("list_contains(assignees, 'src0') AND list_contains(assignees, 'src3')"),
        "filter_inventors_all": filtered("list_contains(inventors, 'Inventor 3') AND list_contains(inventors, 'Inventor 4')"),
        "filter_country": filtered("country = 'FR'"),
        "filter_status": filtered("status = 'Granted'"),
        "filter_date_range": filtered("filing_date <> '' AND filing_date BETWEEN '2020-06-01' AND '2021-12-31'"),
        "filter_codes_all": filtered("list_contains(classification_codes, 'G06N3/00')"),
        "match_field_any": filtered(holds("technology_field", "PHYS", "metall")),
        "match_assignee_any": filtered(any_holds("assignees", "SRC1", "src0")),
        "match_inventor_any": filtered(any_holds("inventors", "inventor 1")),
        "match_country_in": filtered("country IN ('FR', 'DE')"),
        "match_date_range": filtered("filing_date <> '' AND filing_date <= '2021-12-31'"),
        "match_code_any": filtered(f"len({keep('classification_codes', '''contains(e, '06N') OR contains(e, 'Z1/')''')}) > 0"),
        "match_status_in": filtered("status IN ('Granted', 'Pending')"),
        "match_all_filters": filtered(" AND ".join([
            holds("technology_field", "physics", "electricity", "human"), any_holds("assignees", "src1"),
            any_holds("inventors", "Inventor 1", "Inventor 2"), "country IN ('EN', 'FR')",
            "filing_date <> '' AND filing_date BETWEEN '2020-03-01' AND '2023-12-31'",
            f"len({keep('classification_codes', '''contains(e, '00')''')}) > 0", "status IN ('Granted', 'Pending')",
        ])),
        "filter_min_score": with_(text_search(BASE, "rec", Q.ENGLISH), "SELECT patent_id, score FROM all_scores WHERE score >= 0.4"),
        "lookup_by_id": with_(f"{BASE}, {STORED}", f"SELECT patent_id, point_id, title, {joined('assignees')} AS assignees FROM stored WHERE patent_id = '{Q.SIMILAR_TO}'"),
        "search_vectors": f"""WITH one AS (SELECT embedding::double[] AS qv, label AS ql FROM embeddings WHERE vec_id = 0),
          near AS (SELECT cast(vec_id AS varchar) AS point_id, label, round(list_cosine_similarity(embedding::double[], qv), 9) AS score FROM embeddings, one WHERE label = ql)
          SELECT point_id, label, rank, score FROM {ranked("near", 10, "score >= 0")}""",
        "embed_hash": with_(hashed("h", "documents", "doc_id", "text"), "SELECT doc_id, dim::int AS dim, n::int AS weight FROM h"),
        "embed_tfidf": with_(f"{BASE}, " + hashed("h", "rec", "patent_id", COMBINED), """,
          total AS (SELECT count(*) AS rows FROM documents),
          seen AS (SELECT dim, count(*) AS df FROM h GROUP BY dim),
          w AS (SELECT patent_id, dim, n * ln((rows + 1.0) / (df + 1.0)) AS x FROM h JOIN seen USING (dim), total),
          u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY patent_id)) AS v FROM w)
          SELECT patent_id, dim::int AS dim, round(v::float::double, 4) AS weight FROM u WHERE x > 0""".lstrip()),
        "cosine_pairs": """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) AS score
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "search_filtered": with_(text_search(BASE, "rec", Q.ENGLISH), f"""SELECT patent_id, technology_field, {lit(Q.ENGLISH)} AS search_query, rank, score
          FROM {ranked("all_scores", 10, f"score >= 0 AND technology_field = '{Q.SEARCH_FIELD}' AND country = 'EN' AND filing_date >= '2020-02-01'")}"""),
        "search_semantic": with_(text_search(BASE, "rec", Q.FRENCH), f"""SELECT patent_id, country, {lit(Q.FRENCH)} AS search_query, rank, score
          FROM {ranked("all_scores", 25, "score >= 0.2")}"""),
        "similar_records": with_(nearest(), f"""SELECT patent_id, '{Q.SIMILAR_TO}' AS reference_patent_id, rank, score
          FROM {ranked("near", 11, "score >= 0.2")} WHERE patent_id <> '{Q.SIMILAR_TO}' ORDER BY rank LIMIT 10"""),
        "search_ivf": with_(nearest(), f"SELECT patent_id, rank, score FROM {ranked('near', 10, 'score >= 0')}"),
        "search_batch": with_(_batch_queries(), BATCH_HITS),
        "search_batch_blocks": with_(_batch_queries(), BATCH_HITS),
        "search_conversations": with_(_turn_queries(), "SELECT query_id, point_id, rank, score FROM " + ranked("every", 3, "score >= 0", "PARTITION BY query_id")),
        "similar_all": with_(f"""{BASE}, {STORED},
          pairs AS (SELECT a.patent_id AS reference_patent_id, b.patent_id, b.point_id, round(list_cosine_similarity(a.vector, b.vector), 9) AS score
            FROM stored a CROSS JOIN stored b),
          best AS (SELECT * FROM {ranked("pairs", 6, "score >= 0.2", "PARTITION BY reference_patent_id")})""",
            """SELECT reference_patent_id, patent_id, rank, score FROM best WHERE patent_id <> reference_patent_id
            QUALIFY row_number() OVER (PARTITION BY reference_patent_id ORDER BY rank) <= 5"""),
        "search_saved": with_(_saved(), "SELECT query_id, point_id, rank, score FROM " + ranked("every", 10, "score >= 0", "PARTITION BY query_id")),
        "result_preview": with_(text_search(BASE, "rec", Q.ENGLISH), f"""SELECT rank, title, patent_id, printf('%.3f', score) AS score, technology_field,
          array_to_string(assignees, ', ') AS assignees, filing_date,
          CASE WHEN length(abstract) > 200 THEN substr(abstract, 1, 200) || '...' ELSE abstract END AS abstract
          FROM {ranked("all_scores", Q.PREVIEW_LIMIT, "score >= 0")}"""),
        "stats_fields": facet("technology_field", BY_COUNT),
        "stats_countries": facet("country", BY_COUNT),
        "stats_assignees": facet("assignees[1]", BY_COUNT),
        "stats_years": facet(YEAR, "key DESC", "length(filing_date) >= 4"),
        "stats_total": with_(BASE, "SELECT count(*) AS total FROM rec"),
        "stats_all": with_(BASE, "SELECT * FROM (" + " UNION ALL ".join([
            one_facet("technology_field", "technology_field", BY_COUNT), one_facet("country", "country", BY_COUNT),
            one_facet("assignee", "assignees[1]", BY_COUNT), one_facet("filing_year", YEAR, "key DESC", "length(filing_date) >= 4"),
        ]) + ")"),
        "stats_vector_size": with_(f"{BASE}, {STORED}", f"SELECT len(vector)::int AS vector_size, count(*) AS points, 'Cosine' AS distance_metric, {lit(','.join(INDEXED_FIELDS))} AS indexed_fields FROM stored GROUP BY 1"),
        "classify_ipc": with_(BASE, "SELECT patent_id, technology_field AS field FROM rec"),
        "country_names": with_(BASE, "SELECT patent_id, country, CASE country " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in COUNTRY_NAMES.items()) + " END AS country_name FROM rec"),
        "clean_text": f"WITH {TEXTS} SELECT id, {clean('text')} AS result FROM texts",
        "strip_tags": f"WITH {TEXTS} SELECT id, {tags('text')} AS result FROM texts",
        "expand_abbrev": f"WITH {TEXTS} SELECT id, {abbrev('text')} AS result FROM texts",
        "normalize_ws": f"WITH {TEXTS} SELECT id, {spaces('text')} AS result FROM texts",
        "extract_claims": f"""WITH s AS (SELECT doc_id, array_to_string(list_transform(string_split(text, {NL}), lambda e, i: i || '. ' || e || ' [2] (3)'), ' ') AS section FROM documents)
          SELECT doc_id, {joined(claims_of("section"))} AS claims FROM s""",
        "extract_inventors": f"SELECT doc_id, {_names("""('Dr.' || source || '; ' || lang || ' PhD | Mr. ' || source || ' Inc., ;Jr.x')""", True)} AS names FROM documents",
        "extract_inventors_json": f"SELECT doc_id, {_clean_names("""['Prof.' || source, lang || ' MD', lang || ' x', source]""", True)} AS names FROM documents",
        "extract_assignees": f"SELECT doc_id, {_names("""(source || ' Corp.,' || lang || ' Inc.| <b>' || source || '</b> & Sons; ;Dr. ' || lang)""", False)} AS names FROM documents",
        "extract_codes": "SELECT doc_id, upper('g06n' || doc_id || '/00|' || source) AS codes FROM documents",
        "format_date": _dates(),
        "classify_content": with_(BASE + ENHANCED, f"SELECT patent_id, {by_keywords('content')} AS field FROM (SELECT patent_id, lower(concat(title, ' ', abstract, ' ', array_to_string(claims[:3], ' '))) AS content FROM rec)"),
        "resolve_field": with_(BASE, f"""SELECT patent_id, CASE WHEN patent_id LIKE '%0' THEN 'Optics' WHEN technology_field <> 'Unknown' THEN technology_field ELSE {by_keywords("content")} END AS field
          FROM (SELECT patent_id, technology_field, lower(concat(title, ' ', abstract, ' ', array_to_string(claims[:3], ' '))) AS content FROM rec)"""),
        "stream_upsert": with_(_indexed(), "SELECT point_id, patent_id, title, technology_field FROM pts"),
        "batch_index": with_(text_search(_indexed(), "pts", Q.ENGLISH), f"SELECT point_id, patent_id, title, rank, score FROM {ranked('all_scores', 30, 'score >= 0')}"),
    }
    return sql
