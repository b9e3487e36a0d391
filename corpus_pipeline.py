"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``docs``. Empty tables pass
through; null texts count as empty, so the first stage drops them. Rows are told apart by doc_id and
text, so rows with the same id but different texts have fates of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import langid, ngram_join, packing, quality, suffix_dedup
from papyrine.llm._shared import small_batches, stored, table

#: Rejected rows up to this number are broadcast (16 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``rejected`` (doc_id, _text) does not name."""
    gone = stored(rejected.select("doc_id", "_text").distinct(), "rejected")
    few = gone.count() <= BROADCAST_ROWS
    right = gone.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"))
    own = docs.select("doc_id", text_hash().alias("_text"), F.struct(*docs.columns).alias("_row"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return own.join(F.broadcast(right) if few else right, on, "left_anti").select("_row.*")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def hashed(docs: DataFrame) -> DataFrame:
    """What operators read, and the hash that tells rows of one id apart."""
    return docs.select("doc_id", "text", "lang", text_hash().alias("_text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told (no text, null or empty, or no letter), and gives
    those without a language (null) the predicted one; a language that is given stays. Profiles are learnt
    from all documents with a language; without any every document is dropped unless it has one and a letter.
    Ties between languages go to the first by name. Repeated rows and null ids stay as they are."""
    small_batches(spark)
    found = langid.identify(docs.select("text", F.struct(*docs.columns).alias("_row")), langid.train(docs))
    kept = found.filter(F.col("lang_pred") != langid.UNKNOWN)
    lang = F.coalesce("_row.lang", "lang_pred").alias("lang")
    return kept.select(*(lang if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of too high a perplexity for their language (null is one of its own); a perplexity
    equal to the threshold stays, and without trusted documents all stay. A null text counts as empty, a
    null id is never trusted; rows of one id and text have one fate."""
    found = quality.classify(hashed(docs), table(spark, sf_dir, "labels"), carry=("_text",))
    return without(docs, found.filter(~F.col("keep")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest doc_id (null is the largest), then
    text hash, once; of rows that tie in both any one. Texts without words, null as empty, are copies only
    of equal ones."""
    found = ngram_join.join(hashed(docs), texts=True)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_text") == F.col("class_text"))
    kept = without(docs, found.filter(~first))
    # Rows of one id and text are copies too; texts are only dealt where there are such rows.
    marked = kept.select("doc_id", text_hash().alias("_text"), F.struct(*docs.columns).alias("_row"))
    repeated = marked.groupBy("doc_id", "_text").count().filter("count > 1").limit(1).count()
    return (marked.dropDuplicates(["doc_id", "_text"]) if repeated else marked).select("_row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that an earlier place (doc_id, null first, then hash of the text)
    has too; characters cut in two go. A null text becomes empty; a text of which nothing is left stays as
    an empty one. n_chars is counted anew."""
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("_row")
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", row), text_out=True)
    size = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    new = {"text": F.col("text"), "n_chars": size}
    return cut.select(*(new.get(c, F.col("_row")[c].alias(c)) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 1024 tokens; a null or empty text has
    the end id alone. Repeated rows are packed as different pieces."""
    return packing.op5_packing(docs)


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL expresses the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
