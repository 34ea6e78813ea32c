"""The registered queries of the training-data operators, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, embedding_whitening, html_extract, language_id, lattice_lm, line_templates, quality_rules, repeat_spans, simhash_cover, source_divergence, token_prefix
from .common import table


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    out = chat_format.format_conversations(rows.unionByName(probe))
    turns = chat_format.read_back(F.col("formatted"))
    loss = chat_format.under_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "formatted", "n_blocks", turns.alias("turns"), loss.alias("loss"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), seen AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS first
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(replace(text, '\', '\\'), '<', '\l'))
    + CASE WHEN first THEN 15 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) ELSE 6 END)::BIGINT AS formatted_chars,
  count(*) FILTER (first)::BIGINT AS n_blocks
FROM seen GROUP BY conv_id
"""


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (
  SELECT doc_id, text, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split
), tokens AS (
  SELECT doc_id, text, pos, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM each
), lines AS (
  SELECT doc_id, text, pos, t, array_to_string(t, ' ') AS m, len(t) AS n, array_to_string(t[1:3], ' ') AS lead FROM tokens WHERE len(t) > 0
), places AS (SELECT n, lead, m, unnest(range(4, n + 1)) AS p, unnest(t[4:]) AS token FROM lines WHERE n > 3),
counted AS (SELECT n, lead, p, token, count(*) AS c FROM places GROUP BY ALL),
sizes AS (SELECT DISTINCT n, lead, m, p, token, c FROM places JOIN counted USING (n, lead, p, token)),
least AS (SELECT n, lead, m, list_sort(list(c), 'DESC')[n - n * 20 // 100 - 3] AS c FROM sizes GROUP BY n, lead, m),
held AS (
  SELECT s.n, s.lead, s.m, count(*) AS k, string_agg(p || ':' || token, ' ' ORDER BY p) AS fields
  FROM sizes s JOIN least l ON s.n = l.n AND s.lead = l.lead AND s.m = l.m AND s.c >= l.c GROUP BY s.n, s.lead, s.m
), placed AS (
  SELECT l.doc_id, l.text, l.pos, CASE WHEN k + 3 < l.n THEN concat('fields ', l.n, ' ', l.lead, ' ', fields) ELSE 'line ' || l.m END AS template
  FROM lines l LEFT JOIN held h ON l.n = h.n AND l.lead = h.lead AND l.m = h.m
), often AS (SELECT template FROM placed GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= 10),
found AS (SELECT doc_id, count(*) AS n_recurring, list(pos) AS positions FROM placed WHERE template IN (SELECT template FROM often) GROUP BY doc_id),
full_ AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_recurring, 0)::BIGINT AS n_recurring, coalesce(n_recurring, 0)::BIGINT AS n_dropped,
  sha256(coalesce(CASE WHEN n_recurring > 0 THEN array_to_string(list_transform(list_filter(range(len(lines)), lambda k: NOT list_contains(positions, k)), lambda k: lines[k + 1]), chr(10)) ELSE s.text END, '')) AS kept_sha256
FROM split s LEFT JOIN found f ON s.doc_id = f.doc_id LEFT JOIN full_ g ON s.doc_id = g.doc_id
"""


def op4_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.token_budget(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    marked = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.predict(marked, model, keep="held_out").select("doc_id", "held_out", "lang_pred", "score")


def op8_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.report(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), each AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM each GROUP BY ALL HAVING count(DISTINCT k) >= 10),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * size.v))::HUGEINT AS p, (1 + 1000000000 * (kept.n + 2) // (size.total + 2 * size.v))::HUGEINT AS q
  FROM groups g JOIN kept ON g.lang = kept.lang JOIN size ON g.lang = size.lang
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM dense WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_chat_format, op3_line_templates, op4_simhash_cover, op5_quality_rules, op6_token_prefix, op7_language_id, op8_repeat_spans, op9_byte_bpe, op10_spaced_seeds, op11_source_divergence, op12_html_extract, op13_embedding_whitening)}
ORACLES = {"op2_chat_format": OP2_SQL, "op3_line_templates": OP3_SQL, "op11_source_divergence": OP11_SQL}
