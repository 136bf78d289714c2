"""Queries of problems 6 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .abuse import Model, abuse_scores, rates_by_source, train_on
from .leakage import leaked_items, leaked_passages
from .mixing import audit_mixture, mix_blocks, mix_sources, mixture_shares, tokens_by_document
from .sources import clean_source
from .words import BETWEEN, UNSEEN


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p6_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each leak with its kind: an unchanged phrase, or words in order near each other."""
    return leaked_passages(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p6_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The leaks that are unchanged phrases."""
    return p6_matches(spark, sf).where("kind = 'phrase'").select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item with the number of documents it leaked into."""
    found = p6_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("docs"))
    return _t(spark, sf, "eval_items").select("item_id", "suite").join(found, "item_id", "left").fillna(0, ["docs"])


def p7_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return mix_blocks(tokens_by_document(_t(spark, sf, "documents"), ids=True), _t(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(tokens_by_document(_t(spark, sf, "documents")), _t(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    tokens, targets = tokens_by_document(_t(spark, sf, "documents")), _t(spark, sf, "mix_targets")
    return mixture_shares(tokens, targets, mix_sources(tokens, targets))


#: Models trained in this session, by folder; the queries of problem 8 share them.
MODELS: dict[tuple, Model] = {}


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must not be in the mixture, each with the number of times that it is."""
    targets = _t(spark, sf, "mix_targets")
    tokens = tokens_by_document(_t(spark, sf, "documents"), ids=True)
    return audit_mixture(tokens, targets, mix_sources(tokens, targets), mix_blocks(tokens, targets))


def _scores(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    documents = _t(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, sf)
    if key not in MODELS:
        MODELS[key] = train_on(documents, _t(spark, sf, "abuse_labels"))
    model = MODELS[key]
    return abuse_scores(documents.withColumn("source", clean_source("source")), model, ["source"]), model.threshold


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    scores, threshold = _scores(spark, sf)
    return scores.where(F.col("score") >= threshold).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)[0]


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the documents, those with a score from 0 to 1, and those without text, which score 0."""
    rows = _scores(spark, sf)[0].join(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("score").between(0, 1)).alias("scored"), F.count_if(F.coalesce(F.length("text"), F.lit(0)).eqNullSafe(0) & (F.col("score") == 0)).alias("empty"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rates_by_source(*_scores(spark, sf))


QUERIES = {f.__name__: f for f in (p6_found, p6_matches, p6_phrases, p6_items, p7_blocks, p7_mixture, p7_shares, p7_audit, p8_found, p8_scores, p8_coverage, p8_rates)}

#: Letters that are words by themselves (scripts without blanks), and those that make up words.
_LONE = r"\x{e00}-\x{fff}\x{1000}-\x{10bf}\x{1780}-\x{17ff}\x{3040}-\x{9fff}\x{f900}-\x{faff}\x{ff40}-\x{ffbf}\x{20000}-\x{10ffff}"
_RUN = r"a-z0-9\x{80}-\x{dff}\x{10c0}-\x{177f}\x{1800}-\x{303f}\x{a000}-\x{f8ff}\x{fb00}-\x{ff3f}\x{ffc0}-\x{1ffff}"
_WORDS = f"regexp_extract_all(regexp_replace(regexp_replace(lower(text), '{UNSEEN}', '', 'g'), '{BETWEEN}', ' ', 'g'), '[{_LONE}]|[{_RUN}]+')"
_SOURCE = r"regexp_replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))), '[\s\x{a0}_-]+', '_', 'g')"

ORACLES = {
    "p6_phrases": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''),
 i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text <> ''),
 texts AS (SELECT w, row_number() OVER () AS t FROM (SELECT DISTINCT w FROM i)),
 eights AS (SELECT t, p, w[p:p + 7] AS g FROM (SELECT t, w, unnest(range(1, len(w) - 6)) AS p FROM texts)),
 stock AS (SELECT g FROM eights GROUP BY g HAVING count(DISTINCT t) > greatest(7, 0.1 * (SELECT count(*) FROM texts))),
 covered AS (SELECT DISTINCT t, p + k AS p FROM eights SEMI JOIN stock USING (g), (SELECT unnest(range(8)) AS k)),
 own AS (SELECT t, list(x ORDER BY p) AS w FROM (SELECT t, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM texts) ANTI JOIN covered USING (t, p) GROUP BY t),
 asked AS (SELECT DISTINCT t, w[p:p + 23] AS g FROM (SELECT t, w, unnest(range(1, len(w) - 22)) AS p FROM own)),
 held AS (SELECT DISTINCT doc_id, w[p:p + 23] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 22)) AS p FROM d))
SELECT DISTINCT doc_id, item_id FROM held JOIN asked USING (g) JOIN texts USING (t) JOIN i USING (w)""",
    "p7_audit": "SELECT * FROM (VALUES ('document in too many passes', 0), ('token twice in a pass', 0), ('piece of a source that is no target', 0), ('source over its quota', 0), ('source under its quota', 0), ('slot without its block', 0), ('block of a wrong length', 0)) t(fault, times)",
    "p8_coverage": f"SELECT {_SOURCE} AS source, count(*) AS docs, count(*) AS scored, count(*) FILTER (coalesce(text, '') = '') AS empty FROM documents GROUP BY 1",
}
