"""Index terms, phrases and their scores in SQL: stems by regular expressions, apart from the engine's own stemmer."""

from __future__ import annotations

from ..functions import porter
from ..functions import text as t

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _MANY, _ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _cut(n: int, col: str = "s") -> str:
    return f"left({col}, length({col}) - {n})"


def _table(pairs: list[tuple[str, str]], measure: str) -> str:
    """One step: the longest ending that fits, replaced where the rest is long enough."""
    cases = []
    for end, to in sorted(pairs, key=lambda p: -len(p[0])):
        also = f" AND regexp_matches({_cut(3)}, '[st]$')" if end == "ion" else ""
        cases.append(f"WHEN s LIKE '%{end}' THEN CASE WHEN regexp_matches({_cut(len(end))}, '{measure}'){also} THEN {_cut(len(end))} || '{to}' ELSE s END")
    return "CASE " + " ".join(cases) + " ELSE s END"


def stems(source: str) -> str:
    """CTEs from ``source`` (word, ...) to ``stemmed`` (word, term): one row a distinct word."""
    pairs = lambda x: [tuple(p.split(":")) for p in x.split()]
    steps = [
        "CASE WHEN s LIKE '%sses' OR s LIKE '%ies' THEN left(s, length(s) - 2) WHEN s LIKE '%ss' THEN s WHEN s LIKE '%s' THEN left(s, length(s) - 1) ELSE s END",
        # an ending of past or of course leaves a mark for the next step
        f"CASE WHEN s LIKE '%eed' THEN CASE WHEN regexp_matches({_cut(3)}, '{_SOME}') THEN {_cut(1)} ELSE s END WHEN s LIKE '%ed' THEN CASE WHEN regexp_matches({_cut(2)}, '{_VOWEL}') THEN {_cut(2)} || '|' ELSE s END WHEN s LIKE '%ing' AND regexp_matches({_cut(3)}, '{_VOWEL}') THEN {_cut(3)} || '|' ELSE s END",
        f"CASE WHEN s NOT LIKE '%|' THEN s WHEN regexp_matches(s, '(at|bl|iz)[|]$') THEN {_cut(1)} || 'e' WHEN regexp_matches(s, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|00|11|22|33|44|55|66|77|88|99|ßß)[|]$') THEN {_cut(2)} WHEN regexp_matches({_cut(1)}, '{_ONE}') AND regexp_matches({_cut(1)}, '{_CVC}') THEN {_cut(1)} || 'e' ELSE {_cut(1)} END",
        f"CASE WHEN s LIKE '%y' AND regexp_matches({_cut(1)}, '{_VOWEL}') THEN {_cut(1)} || 'i' ELSE s END",
        _table(pairs(porter.STEP2), _SOME),
        _table(pairs(porter.STEP3), _SOME),
        _table([(x, "") for x in porter.STEP4.split()], _MANY),
        f"CASE WHEN s LIKE '%e' AND (regexp_matches({_cut(1)}, '{_MANY}') OR regexp_matches({_cut(1)}, '{_ONE}') AND NOT regexp_matches({_cut(1)}, '{_CVC}')) THEN {_cut(1)} ELSE s END",
        f"CASE WHEN s LIKE '%ll' AND regexp_matches({_cut(1)}, '{_MANY}') THEN {_cut(1)} ELSE s END",
    ]
    out = [f"step0 AS (SELECT DISTINCT word, regexp_replace(strip_accents(word), '^y', 'Y') AS s FROM {source})"]
    for i, step in enumerate(steps):
        out.append(f"step{i + 1} AS (SELECT word, CASE WHEN strlen(strip_accents(word)) BETWEEN 3 AND {porter.LONGEST} THEN {step} ELSE s END AS s FROM step{i})")
    return ",\n".join([*out, f"stemmed AS (SELECT word, lower(s) AS term FROM step{len(steps)})"])


_WORDS = r"'[\p{L}\p{N}\p{M}]+'"
_STOP = ", ".join("'" + w + "'" for w in t.STOPWORDS)
_BM25 = "-(CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_chunks - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))"
#: asked (request_id, text) to requests (request_id, tokens) as SQL.
REQUESTS = rf"""asked0 AS (
  SELECT request_id, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_][A-Za-z0-9_.-]*'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS all_terms FROM asked),
requests AS (SELECT request_id, list_filter(list_transform(range(1, len(all_terms) + 1), lambda i: CASE WHEN list_position(all_terms, all_terms[i]) = i THEN all_terms[i] END), lambda x: x IS NOT NULL)[:24] AS tokens FROM asked0)"""
#: chunks and requests to scored: every chunk that holds a phrase of a request.
INDEX = rf"""cols AS (
  SELECT chunk_id, project_id, 0 AS col, 1.0 AS w, regexp_extract_all(lower(text), {_WORDS}) AS words FROM chunks UNION ALL
  SELECT chunk_id, project_id, 1, 1.5, regexp_extract_all(lower(coalesce(heading, '')), {_WORDS}) FROM chunks UNION ALL
  SELECT chunk_id, project_id, 2, 1.0, regexp_extract_all(lower(path), {_WORDS}) FROM chunks UNION ALL
  SELECT chunk_id, project_id, 3, 0.0, regexp_extract_all(lower(project_id), {_WORDS}) FROM chunks),
lengths AS (SELECT chunk_id, sum(len(words)) AS length FROM cols GROUP BY 1),
stats AS (SELECT count(*) AS n_chunks, avg(length) AS avg_length FROM lengths),
placed_words AS (SELECT chunk_id, project_id, col, w, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM cols),
tokens AS (SELECT request_id, len(tokens) AS n_terms, unnest(tokens) AS token FROM requests),
token_words AS (SELECT token, unnest(regexp_extract_all(token, {_WORDS})) AS word, generate_subscripts(regexp_extract_all(token, {_WORDS}), 1) AS pos FROM (SELECT DISTINCT token FROM tokens)),
all_words AS (SELECT word FROM placed_words UNION SELECT word FROM token_words)"""
INDEX += ",\n" + stems("all_words") + rf""",
laid AS (SELECT chunk_id, project_id, col, w, term, pos FROM placed_words JOIN stemmed USING (word)),
phrase AS (SELECT token, term, pos, max(pos) OVER (PARTITION BY token) AS n FROM token_words JOIN stemmed USING (word)),
begun AS (SELECT token, n, chunk_id, project_id, col, w, laid.pos AS start, phrase.pos AS k FROM laid JOIN phrase ON laid.term = phrase.term AND phrase.pos = 1),
occurs AS (
  SELECT token, chunk_id, project_id, w FROM begun WHERE n = 1 UNION ALL
  SELECT b.token, b.chunk_id, b.project_id, b.w FROM begun b JOIN phrase p ON p.token = b.token AND p.pos > 1 JOIN laid l ON l.chunk_id = b.chunk_id AND l.col = b.col AND l.term = p.term AND l.pos = b.start + p.pos - 1
  WHERE b.n > 1 GROUP BY b.token, b.chunk_id, b.project_id, b.w, b.col, b.start, b.n HAVING count(*) = b.n - 1),
freq AS (SELECT token, chunk_id, project_id, sum(w)::DOUBLE AS f, count(*) AS occurrences FROM occurs GROUP BY 1, 2, 3),
df AS (SELECT token, count(*) AS df FROM freq GROUP BY 1)"""
SCORED = f"""scored AS (
  SELECT request_id, n_terms, chunk_id, project_id, count(*) AS matched, sum({_BM25}) AS score
  FROM tokens JOIN freq USING (token) JOIN df USING (token) JOIN lengths USING (chunk_id), stats GROUP BY 1, 2, 3, 4)"""
#: prefix_scored: the same for the last pass, of the requests in ``unmet``; a prefix is a beginning of terms.
PREFIX = rf"""begins AS (
  SELECT token, term AS head, (length(token) >= 4 AND regexp_full_match(token, '[a-z0-9_]+')) AS plain, n FROM phrase WHERE pos = n AND token IN (SELECT token FROM tokens WHERE request_id IN (SELECT request_id FROM unmet))),
grown AS (SELECT token, n, chunk_id, project_id, col, w, pos FROM begins JOIN laid ON CASE WHEN plain THEN starts_with(term, head) ELSE term = head END),
ends AS (
  SELECT token, chunk_id, project_id, w FROM grown WHERE n = 1 UNION ALL
  SELECT g.token, g.chunk_id, g.project_id, g.w FROM grown g JOIN phrase p ON p.token = g.token AND p.pos < p.n JOIN laid l ON l.chunk_id = g.chunk_id AND l.col = g.col AND l.term = p.term AND l.pos = g.pos - g.n + p.pos
  WHERE g.n > 1 GROUP BY g.token, g.chunk_id, g.project_id, g.w, g.col, g.pos, g.n HAVING count(*) = g.n - 1),
prefix_freq AS (SELECT token, chunk_id, project_id, sum(w)::DOUBLE AS f FROM ends GROUP BY 1, 2, 3),
prefix_df AS (SELECT token, count(*) AS df FROM prefix_freq GROUP BY 1),
prefix_scored AS (
  SELECT request_id, n_terms, chunk_id, project_id, count(*) AS matched, sum({_BM25}) AS score
  FROM tokens JOIN prefix_freq USING (token) JOIN prefix_df USING (token) JOIN lengths USING (chunk_id), stats WHERE request_id IN (SELECT request_id FROM unmet) GROUP BY 1, 2, 3, 4)"""
_ORDER = "priority, rank, path, line_start, chunk_id"


def ladder(first: str, name: str, *, last: bool = False) -> str:
    """CTEs from ``first`` (scored rows) to ``name``: request_id, chunk_id, priority, path, line_start, match_pass, rank, position; scope and requests stand before."""
    both, near = "n_terms BETWEEN 2 AND 8", "n_terms BETWEEN 3 AND 6"
    place = f"(({both})::INT + ({near})::INT)"
    row = "request_id, n_terms, chunk_id, priority"
    some = f"""SELECT {row}, 0 AS pass, round(score, 9) AS rank, false AS filtered FROM {name}_in WHERE {both} AND matched = n_terms
  UNION ALL SELECT {row}, 1, round(CASE WHEN matched = n_terms THEN score * (n_terms - 1) ELSE score END, 9), false FROM {name}_in WHERE {near} AND matched >= n_terms - 1
  UNION ALL SELECT {row}, {place}, round(score, 9), n_terms >= 4 AND {place} > 0 FROM {name}_in"""
    only = f"SELECT {row}, {place} + 1 AS pass, round(score, 9) AS rank, n_terms >= 4 AS filtered FROM {name}_in"
    return f"""{name}_in AS (SELECT * FROM {first} JOIN scope USING (request_id, project_id)),
{name}_passes AS ({only if last else some}),
{name}_cap AS (SELECT p.*, c.path, c.line_start, c.heading FROM (SELECT * FROM {name}_passes QUALIFY row_number() OVER (PARTITION BY request_id, pass ORDER BY rank, chunk_id) <= 256) p JOIN chunks c USING (chunk_id) WHERE c.current),
{name}_cut AS (SELECT * FROM {name}_cap QUALIFY row_number() OVER (PARTITION BY request_id, pass ORDER BY {_ORDER}) <= CASE WHEN filtered THEN 32 ELSE 8 END),
{name}_cov AS (SELECT k.*, len(list_filter(r.tokens, lambda x: contains(replace(lower(concat_ws(' ', heading, path)), 'ß', 'ss'), x))) AS coverage FROM {name}_cut k JOIN requests r USING (request_id)),
{name}_kept AS (SELECT *, CASE WHEN filtered THEN -coverage ELSE 0 END AS less FROM {name}_cov QUALIFY NOT filtered OR max(coverage) OVER (PARTITION BY request_id, pass) < 2 OR coverage >= 2),
{name}_first AS (SELECT * FROM {name}_kept QUALIFY row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY pass) = 1),
{name} AS (SELECT request_id, chunk_id, priority, path, line_start, pass AS match_pass, rank, row_number() OVER (PARTITION BY request_id ORDER BY pass, priority, less, rank, path, line_start, chunk_id)::INT AS position FROM {name}_first QUALIFY position <= 8)"""
