"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (
    decontaminate,
    filter_audit,
    html_text,
    lexical_search,
    line_dedup,
    mixing,
    quality,
    repeats,
    simhash,
    substring_dedup,
    toxicity,
    url_filter,
    warc,
)
from orderlens.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", mixing.word_count(F.col("text")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_and_judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id").distinct()


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("url")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return found.select("row.doc_id", "n_lines", "n_removed", digest)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.measure_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_warc,
        op3_repeats,
        op4_mixing,
        op5_quality,
        op6_decontaminate,
        op7_html_text,
        op8_url_filter,
        op9_toxicity,
        op10_line_dedup,
        op11_filter_audit,
        op12_lexical_search,
        op13_substring_dedup,
    )
}

WORDS = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
""",
    "op4_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 2 / weight, source NULLS LAST) AS turn FROM w
), l AS (
  SELECT a.turn, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(b.source_size * 2) FILTER (b.turn < a.turn), 0))
    / sum(b.weight) FILTER (b.turn >= a.turn) AS level, any_value(a.weight) AS weight, any_value(a.source_size) * 2 AS cap
  FROM o a CROSS JOIN o b GROUP BY a.turn
), v AS (
  SELECT min_by(level, turn) AS level FROM l WHERE level * weight < cap
), t AS (
  SELECT source, source_size, coalesce(least(CAST(source_size * 2 AS DOUBLE), level * weight), CAST(source_size * 2 AS DOUBLE)) AS target,
    CAST('0x' || substr(md5('17:' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS shift
  FROM o LEFT JOIN v ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS place
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(rate * place + shift) - floor(rate * (place - 1) + shift), 2) AS BIGINT) * size AS taken
FROM r
""",
    "op5_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d
), g AS (
  SELECT doc_id, place, word, lead(word, 4) OVER o IS NOT NULL AS whole,
    concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), n AS (
  SELECT doc_id, place, word, whole AND count(*) OVER (PARTITION BY doc_id, five, whole) > 1 AS again FROM g
), c AS (
  SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS 4 PRECEDING) AS covered,
    word = lag(word) OVER (PARTITION BY doc_id ORDER BY place) AS doubled FROM n
), m AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words,
    count(*) FILTER (doubled) AS n_doubled FROM c GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), a AS (
  SELECT d.doc_id, CAST(coalesce(m.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_doubled, 0) AS n_doubled
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * n_doubled > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
""",
    "op10_line_dedup": r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), w AS (
  SELECT *, row_number() OVER o AS turn, count(*) OVER (PARTITION BY doc_id) AS n_worded,
    substr(md5(concat(lag(md5(line)) OVER o, md5(line))), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS mark
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), h AS (
  SELECT doc_id, place, mark AND NOT lag(mark) OVER (PARTITION BY doc_id ORDER BY place) AND turn <= n_worded - 2 AS stop FROM w
), n AS (
  SELECT l.doc_id, line, l.place, count(*) FILTER (stop) OVER (PARTITION BY l.doc_id ORDER BY l.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chunk
  FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.place = l.place
), c AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY place) AS body, count(*) AS n, min(place) AS place,
    count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) >= 2 AS fit
  FROM n GROUP BY doc_id, chunk
), r AS (
  SELECT *, fit AND row_number() OVER (PARTITION BY fit, body ORDER BY doc_id, place) > 1 AS gone FROM c
), k AS (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone) AS kept, coalesce(sum(n) FILTER (gone), 0) AS n_removed
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
}

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
# No seeds: equal words give the shifts at which two texts agree, and windows are counted from every equal word on.
ORACLE["op6_decontaminate"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, len(t) AS n, t FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)
), i AS (
  SELECT row_number() OVER () AS k, item_id, len(t) AS n, t FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)
), dw AS (
  SELECT k, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM d WHERE n >= 8
), iw AS (
  SELECT k, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM i WHERE n >= 8
), s AS (
  SELECT dw.k AS d, iw.k AS i, dw.pos - iw.pos AS shift, list(iw.pos) AS same
  FROM dw JOIN iw ON iw.word = dw.word GROUP BY ALL HAVING count(*) >= 7
), w AS (
  SELECT doc_id, item_id, same, least(20, d.n, i.n) AS width, greatest(1, 1 - shift) AS lowest, least(i.n, d.n - shift) AS last
  FROM s JOIN d ON d.k = s.d JOIN i ON i.k = s.i
), p AS (
  SELECT doc_id, item_id, same, width, lowest, least(unnest(same), last - width + 1) AS start, len(same) AS n_same FROM w
)
SELECT DISTINCT doc_id, item_id FROM p
WHERE n_same * 100 >= width * 80 AND start >= lowest
  AND len(list_filter(same, lambda x: x >= start AND x < start + width)) * 100 >= width * 80
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op12_lexical_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS terms FROM documents
), n AS (
  SELECT k, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), s AS (
  SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n
), i AS (
  SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT i, term, count(*) AS times FROM (SELECT i, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM i) GROUP BY i, term
), t AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term
), m AS (
  SELECT k, doc_id, 75 + (25 * n * big_n) // big_l AS m FROM n, s
), r AS (
  SELECT q.i, m.k, any_value(m.doc_id) AS doc_id, CAST(sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN w ON w.term = q.term JOIN t ON t.term = q.term JOIN m ON m.k = t.k GROUP BY q.i, m.k
), o AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i ON i.i = o.i WHERE rank <= 20
"""

ORACLE["op13_substring_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS words FROM documents
), w AS (
  SELECT k, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d
), g AS (
  SELECT k, doc_id, place, lead(word, 12) OVER o IS NOT NULL AS whole, string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS body
  FROM w WINDOW o AS (PARTITION BY k ORDER BY place)
), r AS (
  SELECT k, place, whole AND doc_id > min(doc_id) OVER (PARTITION BY whole, body) AS again FROM g
), c AS (
  SELECT k, place, bool_or(again) OVER (PARTITION BY k ORDER BY place ROWS 12 PRECEDING) AS gone FROM r
), m AS (
  SELECT w.k, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY w.place) FILTER (NOT gone) AS kept
  FROM w JOIN c ON c.k = w.k AND c.place = w.place GROUP BY w.k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m ON m.k = d.k
"""
