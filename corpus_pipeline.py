"""A corpus pipeline of four operators: language, near copies, repeated passages, packing.

Each stage gets (spark, docs, sf_dir) with the columns of documents and returns a
DataFrame; run() writes each stage's result as Parquet in the shared folder and
hands the table that it reads back to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _common, dedup, jaccard, langid, pack

#: A document stays if one language holds this share of it, and its languages know this share of its trigrams.
LEAST_SHARE, LEAST_KNOWN = 0.4, 0.5
#: Near copies share this percentage of their shingles of so many words, or more.
NEAR_PERCENT, NEAR_WORDS = 80, 5
#: A repeated passage holds so many words or more; each takes a byte, and another one parts it from the next.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1
#: SQL can't express the stages on bytes and tokens; tests hold them against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """docs with columns that no stage reads under names that no operator gives; selecting them restores docs.columns by place."""
    return docs.toDF(*(n if n in ("doc_id", "text", "lang") else f"__{i}" for i, n in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; those without a letter, in no language for the most part, or in one that was not learnt, go.

    A null or empty text has no letter and goes.  Rows are judged by their own text,
    so repeated rows stay or go together, and there are no ties; an empty table, or
    one without any language to learn, gives an empty result.
    """
    langs, logp = langid.train(docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))))
    own = _apart(docs)
    kept = langid.label(own, langs, logp).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("lang_known") >= LEAST_KNOWN))
    return kept.select(*own.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the one with the smallest id, a null before others, then the smallest hash of its text.

    Rows that are equal in both are told apart by a tag, so one of repeated rows
    stays.  Null and empty texts, and those without a word, link to nothing and stay,
    each row of them; an empty table gives an empty result.
    """
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = jaccard.join(docs, NEAR_PERCENT, NEAR_WORDS)
        first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("first"))
        return docs.join(first, docs["doc_id"].eqNullSafe(first["first"]), "left_semi")
    # ids that repeat name no row: rows get a tag of their own, written once so that it stays
    own = _apart(docs)
    tagged = _common.settle(own.withColumn("__tag", F.monotonically_increasing_id()))
    found = jaccard.join(tagged.select(F.col("__tag").alias("doc_id"), "text"), NEAR_PERCENT, NEAR_WORDS).select(F.col("id").alias("__tag"), "component_id")
    ranked = tagged.select("__tag", "doc_id", F.xxhash64("text").alias("hash")).join(found, "__tag")
    first = ranked.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", "__tag")).alias("least")).select(F.col("least.__tag").alias("__tag"))
    return tagged.join(first, "__tag", "left_semi").select(*own.columns).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes and more, that occur more than once are cut out of every document.

    No occurrence is kept, so equal rows lose all that is long enough, and there are
    no ties.  A null text stays null, and an empty one empty; every row stays, with
    n_chars of what is left; an empty table gives an empty result.
    """
    own = _apart(docs)
    out = dedup.strip_repeats(own, PASSAGE_BYTES, PASSAGE_WORDS).select(*own.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences.

    A null or empty text is the end id alone; repeated rows are packed each; equal
    pieces may stand for one another; an empty table gives an empty result.
    """
    return pack.pack(docs, _common.default_tokenizer())


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        since = _common.mark()
        docs = _common.settle(stage(spark, docs, sf_dir))
        _common.release(since, docs)
        if spent is not None:  # its successor has been written
            _common.drop(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
