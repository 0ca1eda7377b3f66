"""Queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import (
    block_naming,
    bpe,
    feistel,
    filter_lattice,
    histogram_sort,
    hyperminhash,
    line_blocks,
    line_frequency,
    nbsvm,
    poisson_mix,
    skyband,
    tool_calls,
    warc,
)
from docspark.llm.common import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@query(
    r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)
), g AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM g WHERE w4 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, unnest(ls) AS raw, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, host, string_split(text, chr(10)) AS ls FROM d)
), ln AS (
  SELECT doc_id, host, pos, raw,
    translate(lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))), '123456789', '000000000') AS line
  FROM l
), lh AS (
  SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, len(string_split(line, ' ')) AS n
  FROM ln WHERE line <> ''
), ranked AS (
  SELECT doc_id, min(h) AS first, list_sort(list(DISTINCT h))[2] AS second FROM lh GROUP BY doc_id
), counted AS (
  SELECT host, h, count(DISTINCT coalesce(CASE WHEN h = first THEN second ELSE first END, h)) AS documents
  FROM lh JOIN ranked USING (doc_id) GROUP BY host, h
), frequent AS (
  SELECT host, h FROM counted JOIN (SELECT host, count(*) AS host_rows FROM d GROUP BY host) USING (host)
  WHERE documents >= {min_documents} AND documents >= {max_share}::DOUBLE * host_rows
), lost AS (
  SELECT doc_id, count(*) AS lines, sum(n) AS words FROM lh JOIN frequent USING (host, h) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lh GROUP BY doc_id
), base AS (
  SELECT d.doc_id,
    coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost.lines, 0)::BIGINT AS n_removed_lines,
    coalesce(lost.words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words - n_removed_words >= {min_kept_share}::DOUBLE * n_words AS kept,
  n_removed_lines, n_removed_words
FROM base
""".replace("{min_documents}", str(line_frequency.MIN_DOCUMENTS))
    .replace("{max_share}", str(line_frequency.MAX_SHARE))
    .replace("{min_kept_share}", str(line_frequency.MIN_KEPT_SHARE))
)
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(table(spark, sf_dir, "documents")).drop("clean_text", "row")


@query()
def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(table(spark, sf_dir, "documents"), shingle=2)


@query()
def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.page_texts(table(spark, sf_dir, "pages"))


@query()
def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return nbsvm.scored(documents, nbsvm.train(documents, table(spark, sf_dir, "labels")))


@query(
    f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS identity,
    strlen(coalesce(text, '')) + 1 AS size
  FROM documents
), s AS (
  SELECT source, sum(size) AS size, pow(sum(size), {poisson_mix.TEMPERATURE}::DOUBLE) AS weight FROM d GROUP BY source
), r AS (
  SELECT source, weight / sum(weight) OVER () * CAST(sum(size) OVER () AS DOUBLE) / size AS rate FROM s
), p AS (
  SELECT source, rate, greatest(CAST(ceil(rate / {poisson_mix.MAX_MEAN}) AS INT), 1) AS parts FROM r
), cdf AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS term, exp(-rate / parts) AS p FROM p
  UNION ALL
  SELECT cdf.source, k + 1, term * (rate / parts) / (k + 1), cdf.p + term * (rate / parts) / (k + 1)
  FROM cdf JOIN p ON cdf.source IS NOT DISTINCT FROM p.source WHERE k + 1 < {poisson_mix.TERMS}
), u AS (
  SELECT d.*, rate, part,
    ('0x' || substr(md5('0|draw|' || identity || '|' || part), 1, 13))::BIGINT / pow(2::DOUBLE, 52) AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS part)
), n AS (
  SELECT doc_id, u.source, lang, n_chars, text, identity, rate, count(p)::INT AS copies
  FROM u LEFT JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.p <= u.u
  GROUP BY ALL
), c AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM n)
SELECT doc_id, source, lang, n_chars, text, copies, copy,
  ('0x' || substr(md5('0|place|' || identity || '|' || copy), 1, 13))::BIGINT / pow(2::DOUBLE, 52) AS shuffle_key
FROM c
"""
)
def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.replicated(table(spark, sf_dir, "documents")).select("row.*", "copies", "copy", "shuffle_key")


@query()
def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# Calls of two tools made of the turns of users, and results made of the answers.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "store": {"query": ("string", True), "tags": ("array", True)},
}
_SECOND = "CASE WHEN conv_id % 2 = 0 THEN '\"limit\": ' || CASE WHEN turn % 8 = 4 THEN '\"all\"' ELSE CAST(length(text) % 50 AS {text}) END ELSE '\"tags\": [ \"t' || CAST(turn AS {text}) || '\", 1 ]' END"
_ARGUMENTS = (
    "CASE WHEN conv_id % 23 = 5 THEN '{{ \"query\": ' WHEN conv_id % 17 = 3 THEN '{{ ' || " + _SECOND + " || ', \"mode\": 1 }}' "
    "ELSE '{{ \"query\" : ' || {quoted} || ', ' || " + _SECOND + " || ' }}' END"
)
_ID = "'c' || CAST(conv_id AS {text}) || '-' || CAST({turn} AS {text})"


@query(
    f"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, {_ID.format(text="VARCHAR", turn="turn")} AS call_id,
    CASE WHEN conv_id % 2 = 0 THEN 'search' ELSE 'store' END AS name,
    {_ID.format(text="VARCHAR", turn="turn // 4 * 2")} AS after,
    conv_id % 23 = 5 AS broken, conv_id % 17 = 3 AS bare, turn % 8 = 4 AS odd,
    length(text) % 50 AS lim, text
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, {_ID.format(text="VARCHAR", turn="turn - 1")} AS call_id, text AS content
  FROM conversations WHERE role = 'assistant'
), placed AS (
  SELECT c.conv_id, c.call_id, c.turn, 0 AS level FROM calls c
  WHERE c.after = c.call_id OR NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, c.turn, level + 1 FROM calls c JOIN placed p
  ON p.conv_id = c.conv_id AND p.call_id = c.after AND c.after <> c.call_id
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position FROM placed
), checked AS (
  SELECT *, CASE WHEN broken THEN 'no JSON'
    WHEN bare AND name = 'search' AND odd THEN 'missing query; limit is no integer; unknown mode'
    WHEN bare THEN 'missing query; unknown mode'
    WHEN name = 'search' AND odd THEN 'limit is no integer' ELSE '' END AS errors,
    CASE WHEN broken THEN 'null' ELSE '{{' ||
      CASE WHEN name = 'search' THEN '"limit":' || CASE WHEN odd THEN '"all"' ELSE CAST(lim AS VARCHAR) END || ',' ELSE '' END ||
      CASE WHEN bare THEN '"mode":1' ELSE '"query":' || CAST(to_json(text) AS VARCHAR) END ||
      CASE WHEN name = 'store' THEN ',"tags":["t' || CAST(turn AS VARCHAR) || '",1]' ELSE '' END || '}}' END AS arguments
  FROM calls
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  o.level, o.position,
  (c.call_id IS NOT NULL)::BIGINT AS n_calls, (r.call_id IS NOT NULL)::BIGINT AS n_results, c.errors,
  '{{"arguments":' || coalesce(arguments, 'null')
    || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null')
    || ',"name":' || coalesce('"' || c.name || '"', 'null') || '}}' AS message
FROM checked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN ordered o ON o.conv_id = c.conv_id AND o.call_id = c.call_id
"""
)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    identifier = _ID.format(text="STRING", turn="turn")
    parent = _ID.format(text="STRING", turn="turn div 4 * 2")
    arguments = _ARGUMENTS.format(text="STRING", quoted="substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    calls = turns.filter("role = 'user'").selectExpr(
        "conv_id",
        "turn",
        f"{identifier} AS call_id",
        "CASE WHEN conv_id % 2 = 0 THEN 'search' ELSE 'store' END AS name",
        f"{arguments} AS arguments",
        f"CASE WHEN {parent} <> {identifier} THEN array({parent}) ELSE array() END AS after",
    )
    previous = _ID.format(text="STRING", turn="turn - 1")
    results = turns.filter("role = 'assistant'").selectExpr(
        "conv_id", "turn", f"{previous} AS call_id", "text AS content"
    )
    return tool_calls.linked(calls, results, TOOLS)


@query()
def op8_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.materialised(table(spark, sf_dir, "documents"), new_folder(spark), key=20)


@query()
def op9_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(documents, path, public_tokenizers.PATTERN).drop("text")


@query(
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
)
def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents")).drop("text_tag")


@query(
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages
), r AS (
  SELECT page_id, bytes, sha256(html) AS payload_digest,
    CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS holder FROM p
)
SELECT page_id, bytes AS payload_bytes, payload_digest,
  CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to, true AS intact
FROM r
"""
)
def op11_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), new_folder(spark)).select(
        F.col("record_key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_key").alias("refers_to"),
        "intact",
    )


@query(
    r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), grp AS (SELECT DISTINCT lang, source FROM d
), used AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, k.n AS lang_n
  FROM grp g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), p AS (
  SELECT *,
    1 + (1000000000 * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
    1 + (1000000000 * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s) AS q
  FROM cells WINDOW s AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
)
def op12_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyband.divergence(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step:step] AS filter, filter_order[1:step - 1] AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), m AS (
  SELECT *, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone, contains(fails, filter) AS failing
  FROM f, s
), steps AS (
  SELECT part, filter_order, step, filter,
    count(*) FILTER (NOT gone AND NOT failing) AS kept,
    count(*) FILTER (NOT gone AND failing) AS removed,
    count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (fails = filter) AS unique_fails,
    count(*) FILTER (NOT gone AND failing AND good) AS good_lost,
    count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM steps
"""
)
def op13_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lattice.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
