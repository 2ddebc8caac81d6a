"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from docketry.llm.chat import Template
from docketry.llm.licenses import BASE, ENOUGH, TEMPLATES, WORD
from docketry.llm.filteraudit import FILTERS, LEAST_DISTINCT, LEAST_WORDS, MARKS, MOST_CAPITALS
from docketry.llm.linededup import LEAST_DOCUMENTS, LEAST_LENGTH, SPACE
from docketry.llm.queries import BREAKOUT, URL_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chat_sql() -> str:
    template = Template()

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for mark in template.control:
            out = f"replace({out}, {_text(mark)}, {_text(mark[0] + chr(92) + mark[1:])})"
        return out

    fixed = len(template.opening) + 1 + len(template.closing)
    more = ", ".join(f"({c}, {t}, {_text(r)}, {_text(x)})" for c, t, r, x in BREAKOUT)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {more}) AS v(conv_id, turn, role, text)
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({escaped("role")}) + length({escaped("text")}) + {fixed}) + {len(template.begin)} AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256,
  length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM joined"""


def license_sql() -> str:
    phrases = {**{k: (v, "") for k, v in BASE.items()}, **TEMPLATES}
    columns, places, shares = [], {}, {}
    for n, (label, (key, more)) in enumerate(phrases.items()):
        words, rest = key.split(), more.split()
        tests = " AND ".join(f"words[i + {k}] = {_text(w)}" for k, w in enumerate(words))
        columns.append(f"list_filter(spots, lambda i: coalesce({tests}, false)) AS p{n}")
        places[label] = f"p{n}"
        if rest:
            hits = " + ".join(f"CASE WHEN words[i + {len(words) + k}] = {_text(w)} THEN 1 ELSE 0 END" for k, w in enumerate(rest))
            shares[label] = f"coalesce(list_max(list_transform(p{n}, lambda i: ({hits}) / {float(len(rest))})), 0.0)"
        elif label in TEMPLATES:
            shares[label] = f"CASE WHEN len(p{n}) > 0 THEN 1.0 ELSE 0.0 END"
    base = " || ".join(places[k] for k in BASE)
    first = sorted({key.split()[0] for key, _ in phrases.values()})
    named = [f"CASE WHEN len({places[k]}) > 0 THEN {_text(k)} END" for k in BASE]
    added = [f"CASE WHEN {shares[k]} >= {ENOUGH} THEN {_text(k)} END" for k in TEMPLATES]
    joined = lambda x: f"array_to_string(list_sort(list_filter([{', '.join(x)}], lambda l: l IS NOT NULL)), ',')"
    return f"""
WITH lower AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), split AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM lower
), spotted AS (
  SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: list_contains([{', '.join(map(_text, first))}], words[i])) AS spots
  FROM split
), placed AS (SELECT doc_id, words, {', '.join(columns)} FROM spotted)
SELECT doc_id, len(words)::BIGINT AS n_words, len({base})::BIGINT AS n_base,
  (list_min({base}) - 1)::BIGINT AS first_word, (list_max({base}) - 1)::BIGINT AS last_word,
  {joined(named)} AS base_labels, {joined(named + added)} AS labels,
  greatest(CASE WHEN len({base}) > 0 THEN 1.0 ELSE 0.0 END, {', '.join(shares.values())})::DOUBLE AS score
FROM placed"""


def url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] == "allow"))
    fits = [
        (f"(host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)})", h + p, v) for h, p, v in rules
    ]
    rule = " ".join(f"WHEN {test} THEN {_text(name)}" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN {_text(v)}" for test, _, v in fits)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM split"""


def top_k_sql() -> str:
    return """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _crc32(text: str) -> str:
    """crc32 of ASCII text, with `crc_bytes` holding the value of each byte."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda a, b: xor(a >> 8, crc_bytes[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


def trie_sql() -> str:
    return f"""
WITH bytes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_bytes
), turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id - conv_id % 20 AS block, list({{'key': key, 'words': words}} ORDER BY turn NULLS FIRST, key) AS turns
  FROM turns GROUP BY conv_id
), hashed AS (SELECT own.*, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM own, bytes
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.block
), paths AS (
  SELECT conv_id, list_aggregate(list_prepend('', list_transform(turns, lambda t: t.key)), 'string_agg', '') AS path,
    list_transform(turns, lambda t: t.words) AS words, len(turns) AS size FROM rebuilt
), steps AS (
  SELECT conv_id, size, words, path, unnest(range(0, size + 1)) AS depth FROM paths
), nodes AS (
  SELECT substr(path, 1, 32 * depth) AS name, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    max(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM steps GROUP BY ALL
), kids AS (SELECT substr(name, 1, 32 * (depth - 1)) AS name, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (name, depth)
), up AS (SELECT name, depth, (n_convs - 1) * words AS saved, n_children = 0 AS leaf, unnest(range(0, depth + 1)) AS over FROM full_nodes
), below AS (SELECT substr(name, 1, 32 * over) AS name, over AS depth, sum(saved) AS saved, count_if(leaf) AS leaves FROM up GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below b USING (name, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.name = substr(n.name, 1, 32 * (n.depth - 1))"""


def audit_sql() -> str:
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    names = [f"l{i}" for i in range(len(FILTERS))]
    apart = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate(names) for b in names[i + 1:])
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words
  FROM documents
), flags AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '{MARKS}') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts
), marked AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(m.toxic), 0) AS toxic
  FROM flags LEFT JOIN marked m USING (doc_id) GROUP BY ALL
), l AS (SELECT * FROM (VALUES {letters}) AS v(x, bit)
), orders AS (
  SELECT concat({", ".join(f"{n}.x" for n in names)}) AS filter_order, [{", ".join(f"{n}.bit" for n in names)}] AS bits
  FROM {", ".join(f"l {n}" for n in names)} WHERE {apart}
), steps AS (
  SELECT filter_order, s AS step, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before, bits[s]::INT AS bit
  FROM orders, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS s)
)
SELECT part, filter_order, step::INTEGER AS step,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM masks, steps GROUP BY ALL"""


def line_sql() -> str:
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), cut AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM texts
), keyed AS (
  SELECT *, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_LENGTH}
  GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), told AS (
  SELECT k.*, f.key IS NOT NULL AND f.keeper IS DISTINCT FROM k.doc_id AS dropped FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY r"""


def llm_oracles() -> dict[str, str]:
    return {"op1_chat_formatting": chat_sql(), "op3_license_scan": license_sql(), "op9_url_filter": url_sql(), "op10_exact_top_k": top_k_sql(), "op11_filter_audit": audit_sql(), "op12_conversation_trie": trie_sql(), "op13_line_dedup": line_sql()}
