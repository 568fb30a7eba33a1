"""The training-data operators applied to the driver's tables, with SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm import (
    bpe,
    chat,
    divergence,
    embeddings,
    extraction,
    linededup,
    mixing,
    phrases,
    pii,
    quality,
    sharding,
    simhash,
    urlfilter,
)
from descry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHARDS = 16


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *columns)


@registered
def op1_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded_documents(_documents(spark, folder, "text"), SHARDS)


@registered
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, folder, "text"))
    return found.select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


@registered
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "text")
    kept = linededup.kept_lines(docs, linededup.started(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@registered
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat.fixed_conversation(spark))
    return chat.digest_of(chat.format_conversations(chat.events_of(turns)))


@registered
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "text")
    return pii.span_digest(pii.personal_data(docs, pii.trained_tagger(docs)))


def vocabulary() -> str:
    """Path of the vocabulary's ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@registered
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    pieces = bpe.read_ranks(vocabulary())
    return bpe.digested_documents(_documents(spark, folder, "text"), pieces)


@registered
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "text", "lang")
    rows = quality.judged(docs, quality.language_references(docs))
    return rows.select(
        F.col("__doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept",
    )


@registered
def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urlfilter.judged_urls(pages).select(
        F.col("__page_id").alias("page_id"), "host", "path", "rule", "verdict"
    )


@registered
def op9_curriculum_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = mixing.sized_documents(_documents(spark, folder, "text", "source"))
    # written, so that a row keeps its number
    sized = sized.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("row"))
    mix = mixing.training_mix(mixing.checkpointed(sized))
    return (
        mix.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))
        .drop("row")
    )


@registered
def op10_lattice_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, folder, "embeddings"))


@registered
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_documents(spark, folder, "text", "lang"))


@registered
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(_documents(spark, folder, "text", "lang", "source"))


@registered
def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extraction.extracted_pages(pages).select(
        F.col("__page_id").alias("page_id"), F.col("__url").alias("url"), "text", "n_chars"
    )


SQL["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                          lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) AS sizes(k))
  GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND n >= 10
), halves AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first_part,
         array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.n AS l, r.n AS r,
         (1000000 * c.a * c.a) // (l.n * r.n) AS score
  FROM halves c JOIN counts l ON l.phrase = c.first_part AND l.lang = c.lang
  JOIN counts r ON r.phrase = c.rest AND r.lang = c.lang
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, inner_phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')])
      AS inner_phrase FROM candidates WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.inner_phrase = s.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a
), totals AS (
  SELECT lang, sum(n) AS n FROM counts WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

# the tables' pages hold one article each, without unwanted elements inside
SQL["op13_html_extraction"] = r"""
WITH blocks AS (
  SELECT page_id, url, html,
         string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
                            '</?(p|h1)>') AS parts
  FROM pages
), plain AS (
  SELECT page_id, url, list_transform(parts, lambda b: trim(regexp_replace(
           regexp_replace(replace(replace(replace(replace(
             regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
             '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
           '[\s\p{Z}\x{1C}-\x{1F}\x{85}\x0B]+', ' ', 'g'))) AS parts
  FROM blocks
), texts AS (
  SELECT page_id, url,
         coalesce(array_to_string(list_filter(parts, lambda b: b <> ''), chr(10) || chr(10)), '')
           AS text
  FROM plain
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

SQL["op12_source_divergence"] = r"""
WITH terms AS (
  SELECT lang, source, doc, term, count(*)::HUGEINT AS n FROM (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           row_number() OVER () AS doc,
           unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM terms GROUP BY ALL HAVING count(*) >= 30
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), cells AS (
  SELECT lang, source, term, sum(t.n)::HUGEINT AS n
  FROM terms t SEMI JOIN kept k USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v,
         coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source
        FROM documents) g
  LEFT JOIN langs l USING (lang) LEFT JOIN cells c USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.first_doc AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op4_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(replace(replace(role, '%', '%25'), chr(10), '%0A'))
           + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op8_url_rules"] = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '(?s)\A([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)\A[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/')
           THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/')
           THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '/(login|signin|logout)(/|$)')
              OR regexp_matches(host || path, '^([^/]*\.)?ads?\.[^/]*/')
              OR contains(host || path, '/wp-admin/')
              OR contains(host || path, '/cgi-bin/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

SQL["op9_curriculum_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM sources
), levels AS (
  -- the level with exactly the sources of lesser cap for their weight at their caps
  SELECT sum(cap) OVER before AS capped, sum(weight) OVER onward AS open_weight,
         cap::DOUBLE / weight AS here, (SELECT sum(source_size) FROM weighed) AS total
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING),
         onward AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW
                    AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (total - coalesce(capped, 0))::DOUBLE AS rest, open_weight::DOUBLE AS open_weight
  FROM levels WHERE (total - coalesce(capped, 0)) / open_weight <= here
  ORDER BY here LIMIT 1
), targets AS (
  SELECT w.*, least(cap::DOUBLE, weight * rest / open_weight) AS target FROM weighed w, level
), streamed AS (
  SELECT s.*, t.source_size, t.target, t.rank, floor(t.target + 0.5)::BIGINT AS demand,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5(coalesce(s.doc_id::VARCHAR, '') || ':' || s.size), s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS whole FROM streamed
), taking AS (
  SELECT *, greatest(0, least(size, demand - whole * source_size - before)) AS extra FROM passed
), started AS (
  SELECT *, CASE WHEN (whole > 0 OR extra > 0) AND size > 0
                 THEN before::DOUBLE / demand END AS share
  FROM taking
)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken,
       CASE WHEN share IS NULL THEN NULL ELSE CASE rank % 3
         WHEN 0 THEN least(2 * share / (sqrt(greatest(2.25 - 2 * share, 0)) + 1.5), 1)
         WHEN 1 THEN share
         ELSE CASE WHEN share <= 0.375
                   THEN least(2 * share / (sqrt(0.25 + 2 * share) + 0.5), 0.5)
                   ELSE least(0.5 + 2 * (share - 0.375) / (sqrt(1 + 2 * (share - 0.375)) + 1), 1)
              END
       END END AS first_position
FROM started
"""

# the checksum of 8 bits at a time, with its table made by rule
SQL["op1_jump_sharding"] = r"""
WITH RECURSIVE entries(i, value, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1
  FROM entries WHERE step < 8
), lookup AS (
  SELECT list(value ORDER BY i) AS entry FROM entries WHERE step = 8
), jumps(doc_id, shards, key, shard, jump) AS (
  SELECT doc_id, shards, doc_id::UHUGEINT, -1::BIGINT, 0::BIGINT
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (16), (17)) AS n(shards)
  UNION ALL
  SELECT doc_id, shards, next, jump,
         floor((jump + 1)::DOUBLE * (2147483648.0 / ((next >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT
          AS next FROM jumps WHERE jump < shards)
), placed AS (
  SELECT doc_id, arg_max(shard, jump) FILTER (shards = 16) AS shard,
         arg_max(shard, jump) FILTER (shards = 17) AS grown_shard
  FROM jumps GROUP BY doc_id
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]),
                         4294967295), 4294967295) AS text_crc32
  FROM (SELECT doc_id, text, entry, CASE WHEN coalesce(text, '') = '' THEN []::BIGINT[] ELSE
          flatten(list_transform(list_transform(string_split(text, ''), lambda s: unicode(s)),
            lambda u: CASE
              WHEN u < 128 THEN [u::BIGINT]
              WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)]
              WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)]
              ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63),
                    128 + (u & 63)] END)) END AS bytes
        FROM documents, lookup)
)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY s.doc_id, text_crc32, size) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM sized s JOIN placed p ON s.doc_id = p.doc_id
"""
