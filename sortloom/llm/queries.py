"""The registered queries of the training-data operators: thin, with production
parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, debruijn, html, mixing, pieces, repetition, secrets, shingles, tokens, weaklabels
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"), digest=True).selectExpr("doc_id", "n_words", "n_removed", "kept kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.classify(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.media_columns(table(spark, sf_dir, "documents"))


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_suffix_repetition, op3_source_mixing, op4_debruijn_dedup, op5_token_counts, op6_quality_classifier, op7_piece_codec, op8_media_chunks, op9_page_differencing, op10_secret_scan)}


_WORDS = r"SELECT doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP1 = f"""WITH RECURSIVE w AS ({_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")}),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT d AS doc_id, CAST(coalesce(min(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d"""

_OP4 = f"""WITH w AS ({_WORDS.format(text="coalesce(text, '')")}),
p AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS win FROM (SELECT doc_id, words, unnest(range(len(words) - 12)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT p.doc_id, unnest(range(i + 1, i + 14)) AS k FROM p JOIN f USING (win) WHERE first < p.doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL expresses; the others have brute-force tests."""
    return {"op1_ngram_jaccard_join": _OP1, "op4_debruijn_dedup": _OP4}
