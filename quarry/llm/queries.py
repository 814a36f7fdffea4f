"""The training-data operators' queries, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id, line_dedup, matroska, mixing, near_dedup, packing, periodic_runs, phrase_dedup, quality_rules, quantile_summary, rule_ensemble, suffix_dedup, warc
from quarry.llm.common import WORD, documents, narrow_batches, small_batches, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrase_dedup.dedup_phrases(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ensemble = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = rule_ensemble.score(docs, ensemble)
    return scored.select("doc_id", (language_id.bucket(5) == 0).alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_suffixes(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", (language_id.bucket(4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def money_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x, weight: the rows of the streams `value` and `price`, equal rows as one.

    Of rows that share a click_id the one that arrived first counts (ties: least client, least value); of
    items that share an id the least brand and price. Rows lacking item, group or a finite amount are dropped; a null id is of batch 0.
    """

    def finite(c: str):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def batch(c: str):
        return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(8)).cast("int").alias("batch")

    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").filter(F.col("client_id").isNotNull() & finite("value"))
    first = clicks.groupBy("click_id").agg(F.min(F.struct("arrived_at", "client_id", "value")).alias("r"))
    value = first.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), batch("click_id"), F.col("r.value").alias("money"), F.lit(1).cast("long").alias("weight"))
    # Lines are counted by item and batch before they meet their item, so a frequent item is a few rows.
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").filter("item_id IS NOT NULL").groupBy("item_id", batch("vendor_id")).agg(F.count("*").alias("weight"))
    items = spark.read.parquet(f"{sf_dir}/items.parquet").filter(F.col("item_id").isNotNull() & F.col("brand").isNotNull() & finite("price"))
    items = items.groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("r"))
    price = lines.join(items, "item_id").select(F.lit("price").alias("stream"), F.col("r.brand").alias("grp"), "batch", F.col("r.price").alias("money"), "weight")
    x = (F.floor(100 * F.col("money") + 0.5).cast("long") + 1000 * F.col("batch")).alias("x")
    return value.unionByName(price).groupBy("stream", "grp", "batch", x).agg(F.sum("weight").alias("weight"))


def op12_quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow_batches(spark)
    keys, group = ["stream", "grp", "batch"], ["stream", "grp"]
    cells = written(money_streams(spark, sf_dir), "cells")
    batches = written(quantile_summary.summarise(cells, keys, "x", "weight"), "batches")
    whole = quantile_summary.merged_batches(batches, group).withColumn("batch", F.lit(-1))
    answers = written(quantile_summary.quantiles(batches.unionByName(whole), keys, 10, 20), "answers")
    # Batches without answers, of fewer than 20 rows, need no ranks; the whole has its cells from all batches.
    asked = cells.join(answers.select(*keys).distinct(), keys, "left_semi").select(*cells.columns)
    all_cells = asked.unionByName(cells.groupBy(*group, "x").agg(F.sum("weight").alias("weight")).withColumn("batch", F.lit(-1)))
    ranked = quantile_summary.exact_ranks(written(all_cells, "all-cells"), answers, keys, 10)
    checked = quantile_summary.with_rank_error(ranked, 50)
    return checked.select(*keys, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within", "bound")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in texts whose h = crc32(doc_id) is a multiple of 10, words from some word on repeat with a period drawn from h. A null doc_id leaves its text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w")
    words = words.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    words = words.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = F.sequence(F.lit(0), n - 1)
    looped = F.array_join(F.transform(place, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return words.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), looped).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(with_planted_runs(documents(spark, sf_dir)))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, pos, ws[pos] AS word,
         CASE WHEN pos + 19 <= len(ws) THEN array_to_string(ws[pos:pos + 19], ' ') END AS k
  FROM words
), judged AS (
  SELECT doc_id, pos, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS later FROM windows
), marked AS (
  SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged
), done AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS lost, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""

OP8_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(text)) AS hx FROM documents WHERE text <> ''
), chunks AS (
  SELECT doc_id, 256 * c AS base, substr(hx, 512 * c + 1, 512 + 398) AS part, least(256, len(hx) // 2 - 256 * c) AS own
  FROM (SELECT doc_id, hx, unnest(range(0, (len(hx) + 511) // 512)) AS c FROM texts)
), strings AS (
  SELECT doc_id, base + i AS pos, substr(part, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 400 <= len(part) THEN md5_number(substr(part, 2 * i + 1, 400)) END AS k
  FROM (SELECT *, unnest(range(0, own)) AS i FROM chunks)
), judged AS (
  SELECT doc_id, pos, byte, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM strings
), marked AS (
  SELECT doc_id, pos, byte, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) > 0 AS gone FROM judged
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM marked
), done AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS lost, count(*) FILTER (begins) AS spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(lost, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (h.k IS NOT NULL AND l.doc_id <> h.keeper) AS gone
  FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11_SQL = """
WITH held AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), judged AS (
  SELECT *, first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id) AS keeper, row_number() OVER (PARTITION BY digest ORDER BY page_id) AS place FROM held
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND place > 1 THEN keeper END AS refers_to
FROM judged
"""

OP13_SQL = r"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM crc WHERE k < 8
), steps AS (
  SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), heads AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
           lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents, steps
), plain AS (
  SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM heads
), shaped AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, g FROM plain
), words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM shaped)
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
  WHERE x.n >= 24
), lags AS (
  SELECT doc_id, q FROM pairs GROUP BY doc_id, q HAVING count(*) >= greatest(24 - q, 2 * q)
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT p.*, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs p SEMI JOIN lags USING (doc_id, q))
  GROUP BY doc_id, q, island
), stretches AS (
  SELECT * FROM islands WHERE length >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM islands o WHERE o.doc_id = s.doc_id AND o.q < s.q AND s.q % o.q = 0 AND o.start <= s.start AND o.start + o.length >= s.start + s.length)
), best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told,
         first(struct_pack(start, length, q) ORDER BY length::DOUBLE / q DESC, start, q) AS top
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM words w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.q AS period, 1000 * top.length // top.q AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_phrase_dedup": op1_phrase_dedup,
        "op2_mixing": op2_mixing,
        "op3_quality_rules": op3_quality_rules,
        "op4_line_dedup": op4_line_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_near_dedup": op6_near_dedup,
        "op7_rule_ensemble": op7_rule_ensemble,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_matroska": op9_matroska,
        "op10_language_id": op10_language_id,
        "op11_warc": op11_warc,
        "op12_quantile_summary": op12_quantile_summary,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_phrase_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op8_suffix_dedup": OP8_SQL, "op11_warc": OP11_SQL, "op13_periodic_runs": OP13_SQL}
