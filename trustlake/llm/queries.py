"""The thirteen operators over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import (
    alignment, eliasfano, hilbert, hyperlang, lines, markov, mixing, ordinal, prefixjoin, repair, snapshots, suffixes, templates,
)
from trustlake.llm.common import table
from trustlake.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def hilbert_dims() -> dict:
    return {"lang": F.col("lang"), "source": F.col("source"), "length": F.log2(F.length("text") + F.lit(1.0))}


@query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"), hilbert_dims(), shards=16, law="bytes")


@query
def op2_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, max_epochs=2.0)


@query
def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.collapse_snapshots(table(spark, sf_dir, "conversations"))


@query
def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit_severity(ordinal.training_rows(docs, table(spark, sf_dir, "labels")))
    return ordinal.grade_documents(docs, model)


@query
def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return markov.scan_secrets(docs, markov.fit_markov(markov.labelled_strings(docs)))


@query
def op6_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    eliasfano.write_token_blocks(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return eliasfano.read_token_blocks(spark, folder)


@query
def op7_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.similar_documents(table(spark, sf_dir, "documents"), percent=80, words=5)


@query
def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents"), share=0.01, least=20, by_text=True)  # as its SQL counts


@query
def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held = F.coalesce(part == 2, F.lit(False))
    model = hyperlang.fit_prototypes(docs.where(~held).select("text", "lang"))
    return hyperlang.identify_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op12_repair_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query
def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), a, b)


ORACLES["op3_snapshot_collapse"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
w AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_turns,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
             string_agg(turn::VARCHAR || ':' || length(role)::VARCHAR || ':' || role || ':' || length(text)::VARCHAR || ':' || text, '|')
               OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM w WHERE k = n_turns GROUP BY prefix, n_turns),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM w WHERE k < n_turns))
SELECT t.conv_id, t.turn, kept.n_turns, kept.copies,
       '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS segment
FROM t JOIN kept USING (conv_id)"""

_WORDS = r"[w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> '']"

ORACLES["op7_grouped_prefix_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x20\x09-\x0D]+') if w <> ''] AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id FROM s
JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

ORACLES["op8_line_frequency"] = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
ls AS (SELECT doc_id, unnest([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')]) AS x FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM ls GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM rep) GROUP BY doc_id),
keyed AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key,
                 len([w for w in regexp_split_to_array(x, '[\x20\x09-\x0D]+') if w <> '']) AS words FROM ls),
lim AS (SELECT host, greatest(20.0, count(DISTINCT t) * 0.01) AS most FROM d GROUP BY host),
freq AS (SELECT host, key FROM keyed JOIN d USING (doc_id) JOIN lim USING (host) GROUP BY host, key, most HAVING count(DISTINCT t) > most),
gone AS (SELECT doc_id, sum(words) AS removed FROM keyed JOIN d USING (doc_id) JOIN freq USING (host, key) GROUP BY doc_id),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR removed_words > 0.8 * n_words)) AS kept FROM f"""
