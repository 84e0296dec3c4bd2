"""Queries of the problems p6 to p8 over the documents table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, table
from . import mixing, packing, repetition
from .tokens import with_token_counts

#: Share of repeated words from which a document is found.
REPEATED_SHARE = 0.3


def _sizes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, columns, n_tokens) of all documents, tokenised once."""
    return materialize(with_token_counts(table(spark, sf_dir, "documents", "doc_id", "text", *columns), "text"))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "container_spec").select("container", F.col("capacity_tokens").alias("capacity"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing of the largest window had to split."""
    packed = packing.pack(_sizes(spark, sf_dir), _containers(spark, sf_dir).where("container = 'window_8k'"))
    return packed.where("pieces > 1 and piece = 0").select("doc_id").distinct()


def p6_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _containers(spark, sf_dir))


def p6_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and the share of their capacity in use, per container; online is before the windows left over are merged."""
    filled = p6_contents(spark, sf_dir).where("tokens > 0").groupBy("container", "shard", "stream_window", "window").agg(F.sum("tokens").alias("tokens"))
    shards = filled.groupBy("container", "shard").agg(F.count(F.lit(1)).alias("online_windows"), (F.max("window") + 1).alias("windows"), F.sum("tokens").alias("tokens"))
    sums = shards.groupBy("container").agg(F.sum("windows").alias("windows"), F.sum("online_windows").alias("online_windows"), F.sum("tokens").alias("tokens"))
    used = lambda n: F.col("tokens") / (F.col(n) * F.col("capacity"))
    return sums.join(_containers(spark, sf_dir).distinct(), "container").select("container", "windows", "tokens", used("windows").alias("used"), "online_windows", used("online_windows").alias("online_used"))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a packing, counted per container where it does not: documents whose tokens are not placed once,
    documents split although they fit, windows over their capacity or with tokens that lie on each other."""
    sizes, spec = _sizes(spark, sf_dir), _containers(spark, sf_dir).distinct()
    packed = materialize(packing.pack(sizes, spec))
    placed = packed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("rows"), F.max("pieces").alias("pieces"), F.countDistinct("start_in_doc").alias("starts"))
    each = placed.join(sizes, "doc_id", "full_outer").join(F.broadcast(spec), "container", "left")
    fair = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1))
    docs = each.groupBy("container").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("placed") != F.col("n_tokens")) | (F.col("rows") != F.col("starts"))).alias("misplaced"), F.count_if((F.col("rows") != fair) | (F.col("pieces") != fair)).alias("needless_splits")
    )
    end = F.max(F.col("start_in_window") + F.col("tokens"))
    windows = packed.where("tokens > 0").groupBy("container", "shard", "window").agg(F.sum("tokens").alias("tokens"), end.alias("end"), F.countDistinct("start_in_window").alias("starts"), F.count(F.lit(1)).alias("rows"))
    bad = (F.col("tokens") > F.col("capacity")) | (F.col("end") != F.col("tokens")) | (F.col("starts") != F.col("rows"))
    windows = windows.join(F.broadcast(spec), "container").groupBy("container").agg(F.count_if(bad).alias("bad_windows"))
    return docs.join(windows, "container", "left").select("container", "documents", "misplaced", "needless_splits", F.coalesce("bad_windows", F.lit(0).cast("long")).alias("bad_windows"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_mix")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_sizes(spark, sf_dir, "source"), _targets(spark, sf_dir)).plan.where("limited").select("source")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sizes(spark, sf_dir, "source")
    return mixing.select_mix(docs, mixing.mix_plan(docs, _targets(spark, sf_dir)))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source at its target share of all tokens, as far as it may be repeated, and what the selection holds."""
    docs = _sizes(spark, sf_dir, "source")
    mix = mixing.mix_plan(docs, _targets(spark, sf_dir))
    return mixing.mix_report(mix, mixing.select_mix(docs, mix))


def p7_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source at its target share of the selection, which is as large as that allows."""
    docs = _sizes(spark, sf_dir, "source")
    mix = mixing.balanced_plan(docs, _targets(spark, sf_dir))
    return mixing.mix_report(mix, mixing.select_mix(docs, mix))


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exponent for all sources, bisected to the entropy of the target shares, realised as a selection."""
    docs = _sizes(spark, sf_dir, "source")
    mix = mixing.temperature_plan(docs, _targets(spark, sf_dir))
    return mixing.mix_report(mix, mixing.select_mix(docs, mix))


def p7_plan_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of p7 with documents measured in characters, which SQL can count, too."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_tokens"))
    plan = mixing.mix_plan(materialize(docs), _targets(spark, sf_dir)).plan
    return plan.select("source", "docs", F.col("tokens").alias("chars"), "budget", F.col("limited").cast("int").alias("limited"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_words(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.screened_repetition(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", REPEATED_SHARE)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the log-likelihood ratio flags, after the exact check."""
    return _screened(spark, sf_dir).where(F.col("flagged") & (F.col("repeated") >= REPEATED_SHARE * F.col("words"))).select("doc_id")


def p8_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, and whether it is flagged."""
    return _screened(spark, sf_dir).select("doc_id", "stretches", F.round("score", 6).alias("score"), F.col("flagged").cast("int").alias("flagged"))


QUERIES = {
    f.__name__: f
    for f in (p6_found, p6_contents, p6_utilisation, p6_violations, p7_found, p7_selection, p7_report, p7_balanced, p7_temperature, p7_plan_by_chars, p8_found, p8_shares, p8_llr)
}

_REPEATED_SQL = r"""
lists AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda x: lower(x)) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM lists),
grams AS (SELECT doc_id, i, n, CASE WHEN i + 8 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g FROM words),
again AS (SELECT doc_id, i, n, CASE WHEN g IS NOT NULL AND min(i) OVER (PARTITION BY doc_id, g) < i THEN 1 ELSE 0 END AS a FROM grams),
marked AS (SELECT doc_id, n, max(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM again),
shares AS (SELECT doc_id, count(*) AS words, sum(r)::BIGINT AS repeated FROM marked GROUP BY doc_id)"""
_LABEL = "translate(lower(trim(source)), '- ', '__')"

SQL = {
    "p8_found": f"WITH {_REPEATED_SQL} SELECT doc_id FROM shares WHERE repeated >= 0.3 * words",
    "p8_shares": f"""WITH {_REPEATED_SQL} SELECT d.doc_id, coalesce(words, 0) AS words, coalesce(repeated, 0) AS repeated,
  CASE WHEN words > 0 THEN repeated / words ELSE 0.0 END AS share FROM documents d LEFT JOIN shares s USING (doc_id)""",
    "p8_llr": f"""WITH {_REPEATED_SQL},
kinds AS (SELECT doc_id, ln(count(*) OVER (PARTITION BY doc_id, g)) AS ratio FROM grams WHERE g IS NOT NULL),
scores AS (SELECT doc_id, count(*) AS stretches, sum(ratio) AS total FROM kinds GROUP BY doc_id)
SELECT d.doc_id, coalesce(stretches, 0) AS stretches, coalesce(round(total / stretches, 6), 0.0) AS score,
  coalesce(total >= 0.3 * words / 8 * ln(2) * (1 - 1e-9), false)::INTEGER AS flagged
FROM documents d LEFT JOIN shares USING (doc_id) LEFT JOIN scores USING (doc_id)""",
    "p6_violations": """SELECT container, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS needless_splits, 0::BIGINT AS bad_windows
FROM container_spec""",
    "p7_plan_by_chars": f"""WITH have AS (SELECT {_LABEL} AS label, count(*) AS docs, sum(coalesce(n_chars, 0))::BIGINT AS chars FROM documents GROUP BY 1),
mix AS (SELECT source, target_share, max_repeats, {_LABEL} AS label FROM source_mix),
every AS (SELECT sum(chars)::BIGINT AS total FROM have),
plan AS (SELECT source, target_share, max_repeats, coalesce(docs, 0) AS docs, coalesce(chars, 0) AS chars, total FROM mix LEFT JOIN have USING (label), every)
SELECT source, docs, chars, CASE WHEN max_repeats * chars < target_share * total THEN max_repeats * chars ELSE floor(target_share * total)::BIGINT END AS budget,
  (max_repeats * chars < target_share * total)::INTEGER AS limited FROM plan""",
}
