"""Registered queries of the subpackage, each on its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm import (conversations, decontaminate, html_text, lm_score, mixing, near_dup, quality, secret_scan,
                            substring_dedup, suffix_dedup, token_counts, tokenizer_pairs, toxicity)
from seriescast.llm.text import table


def _sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"))


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = substring_dedup.dedup(table(spark, sf, "documents"))
    return got.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = secret_scan.find(table(spark, sf, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != secret_scan.LEARNED)
    count = [number(k) for k in secret_scan.KINDS]
    return got.select("doc_id", *count, _sha(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    got = decontaminate.score(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.score(table(spark, sf, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf, "documents"), good)


def op8_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.classes(table(spark, sf, "documents"))


def op9_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    got = mixing.mix(table(spark, sf, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = suffix_dedup.dedup(table(spark, sf, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(table(spark, sf, "conversations"))


def op12_tokenizer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    got = tokenizer_pairs.aligned(table(spark, sf, "documents"))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("n_a") > 0, _sha(F.col("groups"))).otherwise("").alias("groups_sha256"))


def op13_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_secret_scan, op4_toxicity,
                                    op5_decontaminate, op6_quality_rules, op7_lm_score, op8_near_dup,
                                    op9_mix_sources, op10_suffix_dedup, op11_conversation_repair,
                                    op12_tokenizer_pairs, op13_html_text)}


_WORD = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP6 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, {_WORD} AS w FROM documents),
grams AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
twice AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM grams),
rep AS (
  SELECT row_id, count(DISTINCT j) AS n FROM (
    SELECT row_id, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY row_id),
lines AS (
  SELECT row_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
counted AS (
  SELECT b.doc_id, len(b.w)::BIGINT AS n_words,
         length(regexp_replace(b.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(b.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(l.l) AS n_lines, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b JOIN lines l USING (row_id) LEFT JOIN rep r USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 2 * n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM counted
"""

_OP9 = rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORD})::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / (1.0::DOUBLE - 0.9::DOUBLE * least(1.0::DOUBLE, symbols::DOUBLE / greatest(size, 1))) AS key FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM keyed GROUP BY source),
level AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound,
         sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS left_,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM src WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         CASE WHEN bound / w <= left_ / w_left THEN bound ELSE w * (
           SELECT arg_min(left_ / w_left, bound / w) FROM level WHERE bound / w > left_ / w_left) END AS target
  FROM level),
parts AS (
  SELECT k.doc_id, k.source, k.size, g.source_size, g.target, k.key,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS passes,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (passes * size + least(size, greatest(0, round(target - passes * source_size)::BIGINT - before)))::BIGINT AS taken
FROM parts
"""


_OP11 = r"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS k, i::BIGINT AS x FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
src AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
         row_number() OVER () AS row_id,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
             lambda ch: ascii(ch)::BIGINT)),
           lambda h, b: xor(h >> 8, tab[1 + (xor(h, b) & 255)])) AS h
  FROM conversations, crc),
hurt AS (
  SELECT c, turn, row_id, CASE WHEN d = 4 THEN 'user' ELSE r END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text,
         unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, xor(h, 4294967295) % 20 AS d FROM src)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, row_id, copy) AS pos FROM hurt),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
         left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) AS was
  FROM placed),
-- a state is what the repaired roles end in: 0 nothing, 1 s, 2 u, 3 a
fits(f, ini, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
fills AS (SELECT f, t, CASE ini WHEN 'u' THEN 'user' ELSE 'assistant' END AS role, ini FROM fits WHERE ini <> 's'),
starts AS (
  SELECT f, f AS at, '' AS ins, 0 AS c0, NULL::VARCHAR AS filler FROM range(4) s(f)
  UNION ALL SELECT f, t, 'I', 2, role || ':' FROM fills),
ways AS (
  SELECT s.f, x.ini, s.ins || 'K' AS letters, x.t, s.c0 AS cost, s.filler, NULL::VARCHAR AS as_role
  FROM starts s JOIN fits x ON x.f = s.at
  UNION ALL SELECT s.f, NULL::VARCHAR, s.ins || 'R', x.t, s.c0 + 2, s.filler, x.role FROM starts s JOIN fills x ON x.f = s.at
  UNION ALL SELECT f, NULL::VARCHAR, 'D', f, 3, NULL::VARCHAR, NULL::VARCHAR FROM range(4) s(f)),
dp AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0::BIGINT AS st, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS shown FROM src
  UNION ALL
  SELECT c, i, st, cost, audit, shown FROM (
    SELECT d.c, j.pos AS i, w.t::BIGINT AS st,
           (d.cost + w.cost + CASE WHEN w.letters <> 'D' AND j.cut THEN 1 ELSE 0 END)::BIGINT AS cost,
           d.audit || w.letters AS audit,
           CASE WHEN w.letters = 'D' THEN d.shown
                ELSE concat_ws(chr(10), d.shown, w.filler, coalesce(w.as_role, j.role) || ':' || j.text) END AS shown
    FROM dp d JOIN judged j ON j.c = d.c AND j.pos = d.i + 1
         JOIN ways w ON w.f = d.st AND (w.letters = 'D' OR NOT (j.blank OR j.again))
                    AND (w.ini IS NULL OR w.ini = j.ini))
  QUALIFY row_number() OVER (PARTITION BY c, st ORDER BY cost, audit) = 1),
done AS (
  SELECT d.c, d.cost + e.cost AS cost, d.audit || e.letters AS audit, concat_ws(chr(10), d.shown, e.filler) AS shown
  FROM dp d JOIN (VALUES (0, '', 0, NULL::VARCHAR), (1, 'II', 4, 'user:' || chr(10) || 'assistant:'),
                         (2, 'I', 2, 'assistant:'), (3, '', 0, NULL::VARCHAR)) e(st, letters, cost, filler) USING (st)
       JOIN (SELECT s.c, max(coalesce(p.pos, 0)) AS n FROM src s LEFT JOIN placed p USING (c) GROUP BY s.c) z
         ON z.c = d.c AND z.n = d.i
  QUALIFY row_number() OVER (PARTITION BY d.c ORDER BY d.cost + e.cost, d.audit || e.letters) = 1),
tallies AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (WHERE was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c)
SELECT nullif(d.c, ' ')::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(shown) AS repaired_sha256
FROM done d LEFT JOIN tallies USING (c)
"""

#: The tables' pages carry their text in one article element of plain blocks, so SQL can state the expected text.
_OP13 = r"""
WITH inner_ AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
cut AS (
  SELECT page_id, url, list_transform(
           string_split(regexp_replace(a, '</?(p|h1)>', chr(1), 'g'), chr(1)),
           lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(
             regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
             '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b
  FROM inner_),
joined AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM cut)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM joined
"""


def oracle() -> dict[str, str]:
    """SQL for the queries that SQL expresses on whole tables; the others are held against
    brute force in the tests."""
    return {"op6_quality_rules": _OP6, "op9_mix_sources": _OP9, "op11_conversation_repair": _OP11,
            "op13_html_text": _OP13}
