"""Queries for text functions, chunk structure, lookups, summaries, reports, streams and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import hashing, text, times
from attestor.operators import overview, reports
from attestor.operators.diagnosis import compare_reruns
from attestor.plans import oracle as o
from attestor.plans.queries import diagnosed, joined, lexical_hits, query
from attestor.plans.tables import chunks, documents, questions, table


@query("op_a1_a3_normalized_tokens", "WITH " + o.DOCS + f" SELECT document_id, len({o.tokens('text')})::INT AS n, sha256(array_to_string({o.tokens('text')}, ' ')) AS digest FROM docs")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", F.size(text.normalized_tokens(F.col("text"))).alias("n"), F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))


@query("op_a2_query_terms", f"SELECT item_id, array_to_string({o.terms('text')}, ' ') AS terms FROM benchmark")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("op_a4_sentences", "WITH " + o.DOCS + f" SELECT document_id, len({o.sentences('text')})::INT AS n, sha256(array_to_string({o.sentences('text')}, '|')) AS digest FROM docs")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.split_sentences(F.col("text"))
    return documents(spark, sf_dir).select("document_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


@query("op_a6_a7_snippets", """SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS truncated,
  CASE WHEN length(text) > 280 THEN left(text, 277) || '...' ELSE text END AS bounded FROM conversations""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.truncate_chars(F.col("text"), 120).alias("truncated"), text.bounded_snippet(F.col("text")).alias("bounded"))


@query("op_a8_a9_density", "WITH " + o.DOCS + rf""" SELECT document_id, round(coalesce(length(regexp_replace(text, '[^\p{{L}}\p{{N}}{o.WHITE}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0), 6) AS density,
  sha256({o.SQUEEZED}) AS digest FROM docs""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", F.round(text.text_density(F.col("text")), 6).alias("density"), F.sha2(text.normalize_for_duplicate(F.col("text")), 256).alias("digest"))


LINES = o.DOCS + rf""",
l0 AS (SELECT document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM docs),
l1 AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l0 WHERE line < n - 1 OR raw <> ''),
lines AS (SELECT document_id, line::INT AS line, {o.trim('raw')} AS body, (off + strlen(raw) - strlen(regexp_replace(raw, '^[{o.WHITE}]+', '')))::BIGINT AS byte_start,
  (off + strlen(raw) - strlen(regexp_replace(raw, '^[{o.WHITE}]+', '')) + strlen({o.trim('raw')}))::BIGINT AS byte_end FROM l1)"""

_KEY = o.low(f"trim(regexp_replace(regexp_replace(body, ':+$', ''), '[{o.WHITE}]+', ' ', 'g'))")
_BARE = r"regexp_replace(w, '^[()\[\]{}/&_-]+|[()\[\]{}/&_-]+$', '', 'g')"
HEADINGS = LINES + rf""",
known(title, key) AS (VALUES {", ".join(f"('{t}', '{k}')" for t, ks in o.SECTION_NAMES.items() for k in ks)}),
marked AS (
  SELECT lines.*, regexp_matches(body, '^\s*([-*•●◦] |[0-9]+[.)]\s)') AS bullet,
    CASE WHEN body = '' THEN NULL ELSE coalesce(known.title, CASE WHEN strlen(body) <= 80 AND NOT regexp_matches(body, '^\s*([-*•●◦] |[0-9]+[.)]\s)') AND NOT regexp_matches(body, '[.,;:!?]$')
      AND len(list_filter(regexp_split_to_array(body, '[{o.WHITE}]+'), lambda w: w <> '')) BETWEEN 1 AND 8
      AND ((length(regexp_replace(body, '\P{{L}}', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(body, '\P{{L}}', '', 'g'), '\P{{Lu}}'))
        OR len(list_filter(regexp_split_to_array(body, '[{o.WHITE}]+'), lambda w: w <> '' AND NOT ({_BARE} = '' OR {o.low(_BARE)} IN ('and', 'or', 'of', 'for', 'to', 'in', 'with') OR regexp_matches({_BARE}, '^[\p{{Lu}}\p{{N}}]')))) = 0)
      THEN body END) END AS heading
  FROM lines LEFT JOIN known ON known.key = {_KEY}
)"""


@query("op_c2_line_spans", "WITH " + LINES + " SELECT document_id, line, byte_start, byte_end, sha256(body) AS digest FROM lines")
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators import chunking

    return chunking.line_spans(documents(spark, sf_dir)).select("document_id", "line", "byte_start", "byte_end", F.sha2("body", 256).alias("digest"))


@query("op_a11_a12_headings", "WITH " + HEADINGS + " SELECT document_id, line, heading, bullet FROM marked WHERE heading IS NOT NULL OR bullet")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators import chunking

    rows = chunking.line_spans(documents(spark, sf_dir)).withColumns({"heading": F.when(F.col("body") != "", text.section_heading(F.col("body"))), "bullet": text.is_bullet(F.col("body"))})
    return rows.where(F.col("heading").isNotNull() | F.col("bullet")).select("document_id", "line", "heading", "bullet")


BLOCKS = HEADINGS + f""",
k AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN heading IS NOT NULL THEN 'heading' WHEN bullet THEN 'bullets' ELSE 'paragraph' END AS kind FROM marked),
s AS (SELECT *, last_value(heading IGNORE NULLS) OVER w AS section_title, kind = 'heading' OR coalesce(kind <> lag(kind) OVER w, true) AS opens FROM k WINDOW w AS (PARTITION BY document_id ORDER BY line)),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY document_id ORDER BY line) AS run FROM s),
b AS (SELECT document_id, run, any_value(section_title) AS section_title, any_value(kind) AS kind, min(line) AS first_line, max(line) AS last_line, min(byte_start) AS byte_start, max(byte_end) AS byte_end,
    sum({o.words('body')})::INT AS tokens
  FROM r WHERE kind <> 'blank' GROUP BY document_id, run),
blocks AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY run) - 1)::INT AS block FROM b)"""


@query("op_c3_section_blocks", "WITH " + BLOCKS + " SELECT document_id, block, section_title, kind, first_line, last_line, byte_start, byte_end FROM blocks")
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators import chunking

    return chunking.section_blocks(documents(spark, sf_dir)).select("document_id", "block", "section_title", "kind", "first_line", "last_line", "byte_start", "byte_end")


def structured_sql(target: int, overlap: int, docs: str = o.DOCS) -> str:
    """The fold over a document's blocks by recursion, one block a step; chunks are what closes, windows of long blocks, and what is open at the end."""
    return "WITH RECURSIVE " + BLOCKS.replace(o.DOCS, docs) + f""",
seen AS (SELECT document_id, block + 1 AS block, section_title AS title, tokens AS n, sum(tokens) OVER (PARTITION BY document_id ORDER BY block) - tokens AS pos FROM blocks),
fold AS (
  SELECT document_id, 0 AS block, false AS held, 0::HUGEINT AS begin_at, 0::HUGEINT AS upto, NULL::VARCHAR AS section, false AS closes, 0::HUGEINT AS old_begin, NULL::VARCHAR AS old_section, NULL::VARCHAR AS reason FROM docs
  UNION ALL
  SELECT document_id, block, n <= {target}, CASE WHEN room THEN begin_at WHEN carries THEN tail ELSE upto END, upto + n, CASE WHEN room OR carries THEN section ELSE title END,
    held AND NOT room, begin_at, section, CASE WHEN same THEN 'token_limit' ELSE 'section_boundary' END
  FROM (
    SELECT *, same AND upto - begin_at + n <= {target} AS room, same AND tail < upto AND upto - tail + n <= {target} AS carries
    FROM (
      SELECT f.document_id, s.block, f.held, f.begin_at, f.upto, f.section, s.title, s.n, f.held AND f.section IS NOT DISTINCT FROM s.title AS same, greatest(f.begin_at, f.upto - {overlap}) AS tail
      FROM fold f JOIN seen s ON s.document_id = f.document_id AND s.block = f.block + 1
    )
  )
),
spans AS (
  SELECT document_id, block, 0 AS kind, old_begin AS begin_at, upto - n AS end_at, old_section AS section_title, reason AS split_reason FROM fold JOIN seen USING (document_id, block) WHERE closes
  UNION ALL SELECT document_id, block, 1, pos + w, pos + least(w + {target}, n), title, 'fallback_whitespace' FROM (SELECT *, unnest(range(0, n, {max(1, target - overlap)})) AS w FROM seen WHERE n > {target})
  UNION ALL SELECT document_id, block, 2, begin_at, upto, section, 'document_end' FROM fold WHERE held QUALIFY block = max(block) OVER (PARTITION BY document_id)
    AND block = (SELECT max(m.block) FROM seen m WHERE m.document_id = fold.document_id)
),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY block, kind, begin_at) - 1)::INT AS ordinal FROM spans),
words AS (SELECT document_id, regexp_extract_all(text, '[{o.WHITE}]*[^{o.WHITE}]+') AS w FROM docs),
parts AS (
  SELECT c.document_id, c.ordinal, s.block, regexp_replace(array_to_string(w[(greatest(c.begin_at, s.pos) + 1)::BIGINT : least(c.end_at, s.pos + s.n)::BIGINT], ''), '^[{o.WHITE}]+', '') AS part
  FROM numbered c JOIN seen s ON s.document_id = c.document_id AND s.pos < c.end_at AND s.pos + s.n > c.begin_at JOIN words x ON x.document_id = c.document_id
),
texts AS (SELECT document_id, ordinal, string_agg(part, chr(10) || chr(10) ORDER BY block) AS text FROM parts GROUP BY ALL)
SELECT document_id || '#' || ordinal AS chunk_id, ordinal, section_title, (end_at - begin_at)::INT AS token_count,
  (strlen(array_to_string(w[1 : begin_at::BIGINT + 1], '')) - strlen(regexp_replace(w[begin_at::BIGINT + 1], '^[{o.WHITE}]+', '')))::INT AS byte_start, strlen(array_to_string(w[1 : end_at::BIGINT], ''))::INT AS byte_end,
  split_reason, sha256(text) AS checksum
FROM numbered JOIN texts USING (document_id, ordinal) JOIN words USING (document_id)"""


@query("op_c4_structured_chunks", structured_sql(128, 16))
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.chunking import Chunking, chunk

    return chunk(documents(spark, sf_dir), Chunking(128, 16, "smart_sections")).select("chunk_id", "ordinal", "section_title", "token_count", "byte_start", "byte_end", "split_reason", F.sha2("text", 256).alias("checksum"))


#: Documents in which every fourth line stands under a heading, so that sections begin and end.
SECTIONED = o.DOCS.replace("coalesce(text, '') AS text", """array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda l, i: CASE WHEN i % 4 <> 1 THEN l WHEN i % 8 = 1 THEN 'Technical Skills:' || chr(10) || l ELSE 'PART ' || (i // 16) || chr(10) || '- ' || l END), chr(10)) AS text""")


@query("op_c6_sectioned_chunks", structured_sql(60, 10, SECTIONED))
def sectioned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.chunking import Chunking, chunk

    def headed(line, i):
        part = F.concat(F.lit("PART "), F.floor((i + 1) / 16).cast("string"), F.lit("\n- "), line)
        return F.when(i % 4 != 0, line).when(i % 8 == 0, F.concat(F.lit("Technical Skills:\n"), line)).otherwise(part)

    docs = documents(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), headed), "\n"))
    return chunk(docs, Chunking(60, 10, "structured")).select("chunk_id", "ordinal", "section_title", "token_count", "byte_start", "byte_end", "split_reason", F.sha2("text", 256).alias("checksum"))


@query("op_a13_token_spans", "WITH " + o.DOCS + f""",
w AS (SELECT document_id, regexp_extract_all(text, '[{o.WHITE}]*[^{o.WHITE}]+') AS w FROM docs),
u AS (SELECT document_id, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM w),
e AS (SELECT *, sum(strlen(p)) OVER (PARTITION BY document_id ORDER BY i) AS byte_end, strlen(regexp_replace(p, '^[{o.WHITE}]+', '')) AS bytes FROM u),
d AS (SELECT document_id, string_agg((byte_end - bytes) || '-' || byte_end, ',' ORDER BY i) AS spans FROM e GROUP BY document_id)
SELECT document_id, len(w)::INT AS tokens, strlen(array_to_string(w, ''))::INT AS last_end, sha256(coalesce(spans, '')) AS spans_sha256 FROM w LEFT JOIN d USING (document_id)""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators import chunking

    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["byte_start"].cast("string"), s["byte_end"].cast("string"))), ",")
    rows = chunking.token_spans(documents(spark, sf_dir))
    return rows.select("document_id", F.size("spans").alias("tokens"), F.coalesce(F.get("spans", F.size("spans") - 1)["byte_end"], F.lit(0)).alias("last_end"), F.sha2(shown, 256).alias("spans_sha256"))


@query("op_a15_feature_hash", f"""WITH t AS (SELECT DISTINCT unnest({o.terms('text')}) AS t FROM benchmark)
SELECT t AS term, (('0x' || substr(sha256('token:' || t), 1, 16))::UBIGINT % 384)::INT AS idx, CASE WHEN ('0x' || substr(sha256('token:' || t), 17, 2))::INT & 1 = 1 THEN 1 ELSE -1 END AS sign FROM t""")
def feature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.explode(text.query_terms(F.col("text"))).alias("term")).distinct()
    name = F.concat(F.lit("token:"), F.col("term"))
    return rows.select("term", hashing.feature_index(name).alias("idx"), hashing.feature_sign(name).alias("sign"))


@query("op_a16_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(hashing.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


_H = "sha256('doc:' || doc_id)"


@query("op_a17_stable_uuid", f"""SELECT doc_id, concat_ws('-', substr({_H}, 1, 8), substr({_H}, 9, 4), '5' || substr({_H}, 14, 3),
  substr('89ab', (('0x' || substr({_H}, 17, 1))::INT & 3) + 1, 1) || substr({_H}, 18, 3), substr({_H}, 21, 12)) AS id FROM documents""")
def stable_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.stable_uuid(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("id"))


_PROFILE = "CASE " + " ".join(f"WHEN regexp_matches({o.low('text')}, '{'|'.join(m)}') OR regexp_matches({o.low('path')}, '{'|'.join(m)}') THEN '{n}'" for n, m in o.PROFILES) + " ELSE 'general' END"


@query("op_a19_a20_document_intelligence", "WITH " + o.DOCS + f""" SELECT document_id, sha256(text) AS checksum, strlen(text)::BIGINT AS byte_size, {_PROFILE} AS profile,
  CASE WHEN {o.words('text')} >= 80 AND NOT contains(text, chr(65533)) THEN 'high' WHEN {o.words('text')} >= 20 THEN 'medium' ELSE 'low' END AS extraction_quality,
  array_to_string(list_filter([CASE WHEN {o.words('text')} < 20 THEN 'low_text_volume' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_characters' END], lambda x: x IS NOT NULL), ',') AS warnings FROM docs""")
def document_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.intelligence import analyze

    return analyze(documents(spark, sf_dir)).select("document_id", "checksum", "byte_size", "profile", "extraction_quality", joined("warnings").alias("warnings"))


@query("op_g17_document_mix", "WITH " + o.DOCS + f""", p AS (SELECT {_PROFILE} AS profile FROM docs)
SELECT profile, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY profile""")
def document_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.document_mix(documents(spark, sf_dir).select(text.detect_profile(F.col("text"), F.col("path")).alias("profile")))


@query("op_g3_source_summary", "WITH " + o.CHUNKS + """, c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY ALL)
SELECT source_id, count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS chunks FROM docs LEFT JOIN c USING (document_id) GROUP BY source_id""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.source_summary(documents(spark, sf_dir), chunks(spark, sf_dir))


@query("op_g16_health", """WITH e AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS gap, count(*) FILTER (value > 80) AS warnings, count(*) FILTER (value < 1) AS weak FROM events GROUP BY user_id)
SELECT user_id, (100 - least(100, round(coalesce(gap::DOUBLE / nullif(total, 0), 0) * 30) + least(5 * warnings, 20) + least(5 * weak + 10 * gap, 25) + CASE WHEN total % 2 = 0 THEN 15 ELSE round((1 - weak::DOUBLE / total) * 15) END))::INT AS score FROM e""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("gap"), F.count_if(F.col("value") > 80).alias("warnings"), F.count_if(F.col("value") < 1).alias("weak")
    )
    return e.select("user_id", overview.health(F.col("total"), F.col("gap"), F.col("warnings"), F.col("weak"), F.col("gap"), F.col("total") % 2, F.col("weak") / F.col("total")).alias("score"))


@query("op_a24_email", "SELECT c_custkey, lower(trim(' ' || c_name || '@Example.COM ')) AS email, split_part(lower(trim(' ' || c_name || '@Example.COM ')), '@', 1) AS display_name FROM customer")
def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = text.normalize_email(F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.COM ")))
    return table(spark, sf_dir, "customer").select("c_custkey", e.alias("email"), text.display_name(e).alias("display_name"))


@query("op_a26_number_formats", "SELECT o_orderkey, printf('%.0f%%', o_totalprice + 0.001) AS percent, printf('%.3f', o_totalprice) AS three, printf('%+.2f', o_totalprice - 100000) AS signed FROM orders")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")  # prices have two digits; a thousandth more keeps them off ties, which round differently
    return rows.select("o_orderkey", F.format_string("%.0f%%", F.col("o_totalprice") + 0.001).alias("percent"), F.format_string("%.3f", "o_totalprice").alias("three"), F.format_string("%+.2f", F.col("o_totalprice") - 100000).alias("signed"))


@query("op_d1_d3_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS rfc3339, ts + INTERVAL 12 HOUR AS expires_at, make_timestamp(2026, 1, 1, hour(ts), minute(ts), 0.0) + to_days((event_id % 365)::INT) - to_hours(2) AS legacy FROM events")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    zero = F.lit(0).cast("long")
    parts = F.array(F.lit(2026).cast("long"), F.col("event_id") % 365 + 1, F.hour("ts").cast("long"), F.minute("ts").cast("long"), zero, zero, F.lit(2).cast("long"), zero, zero)
    return e.select("event_id", times.rfc3339(F.col("ts")).alias("rfc3339"), times.expires_at(F.col("ts"), 12).cast("timestamp_ntz").alias("expires_at"), times.legacy_time(parts).cast("timestamp_ntz").alias("legacy"))


@query("op_js1_json", "SELECT event_id, coalesce((props::JSON ->> '$.k')::INT, 0) AS k, coalesce((props::JSON ->> '$.missing'), 'none') AS missing FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@query("op_a25_context_keys", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE NULL END AS kept FROM events")
def context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_type").isin("click", "view"), F.lit("mode")).otherwise(F.lit("query_text"))
    kept = text.exportable_context(F.create_map(key, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(kept, F.lit("mode")).alias("kept"))


@query("op_w6_latest_by_key", "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("op_j13_baseline", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS baseline FROM events")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier run of the same key."""
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("baseline"))


@query("op_t4_recent_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the latest hundred, as the feature asks."""
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("op_p7_run_search", """SELECT event_id, 'attention' AS kind FROM events WHERE contains(lower(props), '9') AND (event_type = 'error' OR value < 5)
UNION ALL SELECT event_id, 'strong' FROM events WHERE contains(lower(props), '9') AND value >= 50""")
def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for runs, their properties for the questions; errors have a label."""
    from attestor.operators.traces import search

    none = F.array().cast("array<string>")
    strength = F.when(F.col("value") < 5, "weak").when(F.col("value") >= 50, "strong").otherwise("medium")
    runs = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("query"), F.when(F.col("event_type") == "error", F.array(F.lit("error"))).otherwise(none).alias("labels"), strength.alias("strength"))
    found = [search(runs, "9", kind).select("event_id", F.lit(kind).alias("kind")) for kind in ("attention", "strong")]
    return found[0].unionByName(found[1])


@query("op_p1_scope_filter", "WITH " + o.CHUNKS + " SELECT chunk_id, path, ordinal FROM chunks WHERE source_id IN ('src1', 'src2')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.retrieval import in_scope

    return chunks(spark, sf_dir).where(in_scope(["src1", "src2"], None)).select("chunk_id", "path", "ordinal")


@query("op_j3_document_chunks", "WITH " + o.CHUNKS + " SELECT document_id, count(chunk_id) AS chunks FROM docs LEFT JOIN chunks USING (document_id) GROUP BY document_id")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id")
    return d.join(chunks(spark, sf_dir).select("document_id", "chunk_id"), "document_id", "left").groupBy("document_id").agg(F.count("chunk_id").alias("chunks"))


@query("op_g26_hits_by_document", "WITH " + o.RETRIEVED + " SELECT query_id, document_id, count(*) AS hits, min(rank) AS first_rank, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks FROM hits GROUP BY ALL")
def hits_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"), F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")), ",").alias("ranks"))


@query("op_s5_html_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(p|div|li|h[1-6]|tr|title|ul|ol|table|section|article|header|footer|nav)>|<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[@]+|[@]+$', '', 'g') AS x FROM c)
SELECT page_id, length(x)::INT AS n_chars, sha256(x) AS digest FROM d""".replace("@", o.WHITE))
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(t).alias("n_chars"), F.sha2(t, 256).alias("digest"))


@query("op_s1_s9_ingest", r"""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' ELSE NULL END AS kind FROM pages)
SELECT page_id, kind, CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
  CASE page_id % 4 WHEN 2 THEN 'pdf_extraction_failed' WHEN 3 THEN 'unsupported_file_type' END AS failure FROM f""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.ingest import extract

    suffix = F.element_at(F.array(*map(F.lit, (".HTML", ".txt", ".pdf", ".exe"))), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), suffix).alias("file_name"), F.lit(None).cast("string").alias("content_type"), F.col("html").cast("binary").alias("content"))
    return extract(files).select("page_id", "kind", "mime_type", "failure")


@query("op_s2_admission", """WITH f AS (SELECT conv_id, turn, length(text) * 400000 AS length FROM conversations)
SELECT conv_id, turn, CASE WHEN row_number() OVER w > 10 THEN 'too_many_files' WHEN length > 20971520 THEN 'file_too_large' WHEN sum(length) OVER w > 52428800 THEN 'request_too_large' END AS failure
FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.ingest import admit

    files = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), (F.length("text").cast("long") * 400000).alias("length"))
    return admit(files).select(F.col("request_id").alias("conv_id"), F.col("position").alias("turn"), "failure")


@query("op_x2_run_metrics", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS mode, count(*) AS runs, round(avg((value > 50)::INT::DOUBLE)::DECIMAL(28, 9), 6)::DOUBLE AS failure_rate, round(avg(value)::DECIMAL(28, 9), 4)::DOUBLE AS latency, list_sort(list(value))[ceil(count(value) * 0.95)::INT] AS p95 FROM events GROUP BY ALL""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.streaming.streams import run_metrics as metrics

    e = table(spark, sf_dir, "events")
    return metrics(e.select("ts", F.col("event_type").alias("mode"), (F.col("value") > 50).alias("failed").cast("int"), F.col("value").alias("latency"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("op_x3_sessions", """WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, n""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.streaming.streams import sessions as by_gap

    rows = by_gap(table(spark, sf_dir, "events").select("ts", "user_id", "value"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("op_rep1_trace_report")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir)
    return reports.markdown(
        diagnosed(spark, sf_dir), reports.evidence(hits, "snippets_allowed"), "snippets_allowed", reports.report_context(hits, "lexical"), compare_reruns(hits, hits.where("rank = 1")), questions(spark, sf_dir)
    )


@query("op_rep4_privacy", "WITH " + o.RETRIEVED + " SELECT query_id, 'E' || rank AS label, chunk_id, CASE WHEN length(text) > 280 THEN left(text, 277) || '...' ELSE text END AS snippet FROM hits")
def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.evidence(lexical_hits(spark, sf_dir), "snippets_allowed").select("query_id", "label", "chunk_id", "snippet")


@query("op_g24_evidence_catalogue", "WITH " + o.RETRIEVED + """, f AS (SELECT chunk_id, min(row(query_id, rank)) AS first FROM hits GROUP BY chunk_id)
SELECT chunk_id, 'E' || row_number() OVER (ORDER BY first, chunk_id) AS label FROM f""")
def evidence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.evidence_catalogue(lexical_hits(spark, sf_dir).withColumn("mode", F.lit("lexical")))


@query("op_a23_markdown_escape", r"SELECT item_id, regexp_replace(regexp_replace(text || ' *a_b* [x](y)', '([\\`*_\[\]<>#|])', '\\\1', 'g'), '[\r\n]+', ' ', 'g') AS escaped FROM benchmark")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.escape_markdown(F.concat("text", F.lit(" *a_b* [x](y)"))).alias("escaped"))


@query("op_u1_u2_set_operations", "WITH " + o.RETRIEVED + """, a AS (SELECT query_id, list_sort(list(term)) AS t FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY query_id)
SELECT a.query_id, len(list_intersect(a.t, b.t))::INT AS common, array_to_string(list_sort(list_filter(a.t, lambda x: NOT list_contains(b.t, x))), ',') AS lost FROM a JOIN a b ON b.query_id = a.query_id + 1""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = retrieval_terms(spark, sf_dir)
    after = q.select((F.col("query_id") - 1).alias("query_id"), F.col("terms").alias("next"))
    return q.join(after, "query_id").select("query_id", F.size(F.array_intersect("terms", "next")).alias("common"), joined(F.array_sort(F.array_except("terms", "next"))).alias("lost"))


def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.retrieval import prepare_queries

    return prepare_queries(questions(spark, sf_dir)).where("n_terms > 0")




@query("op_s11_upsert", "SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    from attestor.sources.store import last_by

    rows = table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    return last_by(rows, "user_id", "order").select("user_id", "value")


@query("op_s20_warning_codec", "SELECT event_id, split_part(event_type || ':a:' || props, ':', 1) AS code, substr(event_type || ':a:' || props, strpos(event_type || ':a:' || props, ':') + 1) AS message FROM events")
def warning_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.sources.store import decode_warnings, encode_warnings

    w = F.array(F.struct(F.col("event_type").alias("code"), F.concat(F.lit("a:"), F.col("props")).alias("message")))
    back = F.get(decode_warnings(encode_warnings(w)), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", back["code"].alias("code"), back["message"].alias("message"))
