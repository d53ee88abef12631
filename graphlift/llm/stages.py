"""The operators as filters and transformations of a documents table: (spark, docs, sf_dir) to a DataFrame.

All but `bpe_ids` return the columns of docs. Rows are told apart by their key and text, so null or
repeated keys do no harm; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, frames, langid, mixing, pathjoin, toxicity

#: The language of a text is taken for known from this score on: all 61,282 texts of four languages measured have 0.39 or more,
#: texts of other scripts and of random letters less.
LEAST_SCORE = 0.3


def _row() -> Column:
    """Names a row by its key and text, without nulls; the least one of a group has its least key."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("digest"))


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages learned: their n-grams' ranks are too far from every profile (a score under
    LEAST_SCORE), or they have no letter (null texts, too). Profiles are learned from the labelled rows of docs; if there are none, only
    texts without a letter go. Whole texts of any length count; equal texts share their fate. An empty table stays empty."""
    profiles = langid.learn(docs, F.coalesce(frames.fold("doc_id", 4), F.lit(0)) != 2)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = frames.fresh("_lang", docs), frames.fresh("_score", docs)
    found = langid.predict(docs, profiles, lang_name=lang, score_name=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold. Learned from the labelled rows of docs. Null and empty texts have score 0 and
    stay; texts count whole; equal texts share their fate; without labels of both kinds all rows stay. An empty table stays empty."""
    model = toxicity.learn(docs, frames.read(spark, sf_dir, "labels"), F.coalesce(frames.fold("doc_id", 4), F.lit(0)) != 2)
    score = frames.fresh("_score", docs)
    return toxicity.score(docs, model, score_name=score, located=False).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least key (a null key comes last, ties go by the text's hash). Texts
    without a word are copies of nothing and stay, unless key and text are equal. Texts count whole. An empty table stays empty."""
    row = frames.fresh("_row", docs)
    rows = docs.withColumn(row, _row())
    found = pathjoin.join(rows, key=row)
    first = found.where(F.col(row) == F.col("class_id")).select(row).distinct()
    return rows.join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words.

    taken / size is rounded by running sums over a source's documents in the order of their sizes, so a source's words stay within about one
    document of what the mix takes from it. Documents without a word go, and so may very short shares. Rows of one
    key and text count as one document. Texts count whole. An empty table stays empty.
    """
    row, times, copy = frames.fresh("_row", docs), frames.fresh("_times", docs), frames.fresh("_copy", docs)
    rows = docs.withColumn(row, _row())
    taken, _, _ = mixing.mix(rows, key=row)
    unit = 1 << 20
    shares = taken.where(F.col("size") > 0).groupBy(row).agg(F.min("source").alias("source"), F.first("size").alias("size"), F.sum("taken").alias("_taken"))
    # in units, so that sums are exact in any order
    shares = frames.written(shares.withColumn("_share", F.expr(f"cast(_taken as decimal(38,0)) * {unit} div size")))
    parts = max(1, -(-shares.count() // mixing.BUCKET_ROWS))
    order = F.floor(F.log2("size") * 4) * parts + F.pmod(F.xxhash64(row), F.lit(parts))
    sums = mixing.running(shares.withColumn("_bucket", order), "source", "_bucket", ["size", row], "_share", "_past", "_all")
    rounded = lambda x: F.floor((x + unit // 2) / unit)
    counts = sums.select(row, (rounded(F.col("_past") + F.col("_share")) - rounded(F.col("_past"))).cast("int").alias(times)).where(F.col(times) > 0)
    kept = rows.dropDuplicates([row]).join(counts, row)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def bpe_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them; a null text has no ids, repeated rows stay, texts count whole."""
    # smaller chunks than alone: workers of the stages before hold memory, and a stage may take more disk than the query
    return bpe.encode(docs, chunk_bytes=6 << 20)
