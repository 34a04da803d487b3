"""SQL that states the results of the queries, for an independent engine over the same tables."""

from __future__ import annotations

from attestor.functions.hashing import CONCEPTS
from attestor.functions.text import EMBEDDING_STOP_WORDS, PROFILES, QUERY_STOP_WORDS, SECTION_NAMES, WHITE


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({low(x)}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def terms(x: str, stops=QUERY_STOP_WORDS) -> str:
    return f"list_sort(list_distinct(list_filter({tokens(x)}, lambda t: NOT list_contains({_list(stops)}, t))))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WHITE}]+'))"


def sentences(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[.!?\n]'), lambda s: s <> '')"


DOCS = """docs AS (
  SELECT 'd' || doc_id AS document_id, source AS source_id, source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents
)"""


def windows(target: int = 512, step: int = 448) -> str:
    return rf"""
pieces AS (SELECT *, regexp_extract_all(text, '[{WHITE}]*[^{WHITE}]+') AS w FROM docs),
starts AS (SELECT *, unnest(range(0, len(w), {step})) AS st FROM pieces),
raw AS (SELECT *, array_to_string(w[st + 1 : st + {target}], '') AS r, array_to_string(w[1 : st], '') AS pre FROM starts),
windows AS (
  SELECT document_id || '#' || (st // {step}) AS chunk_id, document_id, source_id, path, (st // {step})::INT AS ordinal, regexp_replace(r, '^[{WHITE}]+', '') AS text,
    least({target}, len(w) - st)::INT AS token_count, (strlen(pre) + strlen(r) - strlen(regexp_replace(r, '^[{WHITE}]+', '')))::INT AS byte_start,
    (strlen(pre) + strlen(r))::INT AS byte_end, CASE WHEN st + {target} >= len(w) THEN 'document_end' ELSE 'token_limit' END AS split_reason
  FROM raw
)"""


HEADING = rf"""(({trim('text')} = '') OR (len(list_filter(regexp_split_to_array({trim('text')}, '\n'), lambda l: {trim('l')} <> '')) <= 2
  AND {words(trim('text'))} <= 6 AND NOT regexp_matches({trim('text')}, '[.:;]')))"""

SQUEEZED = low(f"trim(regexp_replace(text, '[{WHITE}]+', ' ', 'g'))")

QUALITY = rf"""
rated AS (
  SELECT *, sha256(text) AS checksum, round(coalesce(length(regexp_replace(text, '[^\p{{L}}\p{{N}}{WHITE}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0), 6) AS text_density,
    {HEADING} AS heading, count(*) OVER (PARTITION BY document_id, {SQUEEZED}) > 1 AS is_duplicate
  FROM windows
),
chunks AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN heading THEN 'heading_only' END, CASE WHEN token_count <= 4 THEN 'too_short' END, CASE WHEN token_count >= 900 THEN 'too_long' END,
    CASE WHEN is_duplicate THEN 'duplicate' END, CASE WHEN text_density < 0.45 THEN 'low_text_density' END,
    CASE WHEN token_count >= 8 AND NOT heading AND text_density >= 0.55 THEN 'good_evidence_candidate' END], lambda f: f IS NOT NULL)) AS quality_flags,
    round(greatest(0.0, least(1.0, 0.5 + CASE WHEN token_count >= 8 AND NOT heading AND text_density >= 0.55 THEN 0.35 ELSE 0 END
      - CASE WHEN heading THEN 0.35 ELSE 0 END - CASE WHEN is_duplicate THEN 0.1 ELSE 0 END - CASE WHEN text_density < 0.45 THEN 0.15 ELSE 0 END)), 6) AS evidence_score_hint
  FROM rated
)"""

CHUNKS = DOCS + "," + windows() + "," + QUALITY

QUERIES = f"""
questions AS (SELECT item_id AS query_id, split_part(text, '.', 1) AS query FROM benchmark),
q AS (SELECT query_id, query, {terms('query')} AS terms, len({terms('query')})::INT AS n_terms, array_to_string({tokens('query')}, ' ') AS normalized FROM questions)"""

#: Signals of the lexical mode for every pair that shares a term.
SCORED = rf"""
idx AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest(list_concat({tokens('text')}, {tokens('path')})) AS term FROM chunks) GROUP BY ALL),
pairs AS (
  SELECT query_id, chunk_id, count(*) AS matched, sum(least(n, 4)) AS frequency FROM idx JOIN (SELECT query_id, unnest(terms) AS term FROM q) USING (term) GROUP BY ALL
),
norm AS (SELECT *, array_to_string({tokens('text')}, ' ') AS norm_text, {tokens('path')} AS path_tokens FROM chunks),
signals AS (
  SELECT *, 0.0 AS semantic, 0.0 AS section,
    round(matched / greatest(n_terms, 1)::DOUBLE * 2.4 + frequency / (greatest(n_terms, 1) * 4.0::DOUBLE) * 0.6, 6) AS lexical,
    round(CASE WHEN normalized <> '' AND contains(norm_text, normalized) THEN 1.2
      ELSE len(list_filter(range(1, n_terms), lambda i: contains(norm_text, terms[i] || ' ' || terms[i + 1]))) * 0.3::DOUBLE END, 6) AS phrase,
    round(len(list_filter(terms, lambda t: list_contains(path_tokens, t))) / greatest(n_terms, 1)::DOUBLE * 0.5, 6) AS path_score,
    round(CASE WHEN token_count > 0 THEN 0.02 ELSE 0 END, 6) AS metadata
  FROM pairs JOIN q USING (query_id) JOIN norm USING (chunk_id)
),
scored AS (SELECT *, round(lexical + phrase + section + path_score + metadata, 6) AS score FROM signals)"""

HITS = """
flagged AS (
  SELECT *, list_filter([CASE WHEN is_duplicate THEN 'duplicate' END, CASE WHEN list_contains(quality_flags, 'heading_only') THEN 'heading_only' END,
    CASE WHEN list_contains(quality_flags, 'too_short') THEN 'too_short' END, CASE WHEN matched > 0 THEN 'exact_term_match' END,
    CASE WHEN evidence_score_hint < 0.35 THEN 'weak_evidence' END], lambda f: f IS NOT NULL) AS flags0 FROM scored WHERE score > 0
),
strong AS (
  SELECT *, CASE WHEN list_contains(flags0, 'heading_only') OR score < 0.35 THEN 'weak'
    WHEN list_contains(flags0, 'weak_evidence') OR list_contains(flags0, 'too_short') OR score < 0.7 THEN 'medium' ELSE 'strong' END AS strength,
    count(*) OVER (PARTITION BY query_id, checksum) AS duplicate_count,
    row_number() OVER (PARTITION BY query_id, checksum ORDER BY score DESC, path, ordinal, chunk_id) AS nth FROM flagged
),
hits AS (
  SELECT * FROM (
    SELECT *, CASE WHEN duplicate_count > 1 AND NOT list_contains(flags0, 'duplicate') THEN list_append(flags0, 'duplicate') ELSE flags0 END AS hit_flags,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal, chunk_id)::INT AS rank
    FROM strong WHERE nth = 1
  ) WHERE rank <= 5
)"""

RETRIEVED = CHUNKS + "," + QUERIES + "," + SCORED + "," + HITS

MET = f"len(list_filter(terms, lambda t: list_contains({tokens('s')}, t)))"

ASSESSED = rf"""
ss AS (
  SELECT *, list_transform({sentences('text')}, lambda s, i: struct_pack(matched := {MET}, back := -i,
    digits := len(list_filter(terms, lambda t: regexp_matches(t, '[0-9]') AND NOT list_contains({tokens('s')}, t))) = 0, text := s)) AS ss FROM hits
),
body AS (
  SELECT *, coalesce(list_max(list_transform(ss, lambda s: s.matched)), 0) AS matched_body,
    CASE WHEN n_terms <= 1 THEN n_terms ELSE least(n_terms, greatest(2, ceil(n_terms * 0.5)))::INT END AS required FROM ss
),
fit AS (SELECT *, list_filter(ss, lambda s: s.matched >= required AND s.matched / nullif(n_terms, 0) >= 0.5 AND s.digits) AS fits FROM body),
lead AS (SELECT *, CASE WHEN n_terms > 0 AND len(fits) > 0 THEN list_filter(fits, lambda s: s.matched = list_max(list_transform(fits, lambda f: f.matched)))[1].text END AS sentence FROM fit),
assessed AS (
  SELECT *, round(CASE WHEN n_terms > 0 THEN matched_body / n_terms::DOUBLE ELSE 0 END, 6) AS coverage,
    CASE WHEN list_contains(hit_flags, 'heading_only') THEN 'heading_only_evidence' WHEN strength = 'weak' OR list_contains(hit_flags, 'weak_evidence') THEN 'weak_evidence'
      WHEN sentence IS NOT NULL THEN 'direct_body_support' WHEN matched_body > 0 THEN 'insufficient_body_overlap' WHEN semantic > 0 THEN 'semantic_only_match'
      WHEN path_score > 0 THEN 'path_only_match' WHEN metadata > 0 THEN 'metadata_only_match' ELSE 'insufficient_body_overlap' END AS support_reason
  FROM lead
)"""

SUPPORTED = """
judged AS (SELECT *, CASE WHEN support_reason = 'direct_body_support' THEN 'supported' ELSE 'unsupported' END AS support_status FROM assessed)"""

JUDGED = RETRIEVED + "," + ASSESSED + "," + SUPPORTED
