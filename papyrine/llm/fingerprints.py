"""Document fingerprints by I-Match with several randomised lexicons.

Method: terms whose document frequency lies in a band (neither everywhere nor nearly nowhere) make
up the lexicon; a document's distinct lexicon terms are sorted, and for each of several random
subsets of the lexicon the terms in it are hashed together. Two documents agree in a subset if their
terms differ nowhere in it, so small subsets tell how much two documents share and large ones whether
they are the same. Subsets come in four sizes to suit short and long documents.

Everything is built of DataFrame functions. The lexicon holds every term of the band. A band term is in
2e-5 of the documents at least, so there are at most 50,000 times as many as distinct terms in a mean
document. Up to ``LEXICON_ROWS`` of them are broadcast to the documents' terms; beyond, both are joined by
shuffling. Both ways give the same rows. No lexicon term is hot, since the band leaves out what more than a
twentieth of documents hold; other terms meet no row of the lexicon, and Spark splits their partitions.

Texts of any length are read whole: a text is one row, its terms one array of distinct hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm._shared import shuffle_parts, small_batches, stored

#: Band of the share of documents that hold a lexicon term, and the fewest documents.
BAND = (2e-5, 0.05)
FEWEST = 3
#: log2 of the slots of the lexicon, and the most terms that are broadcast (8 bytes each).
SLOT_BITS = 17
LEXICON_ROWS = 1 << 21
#: Documents of one range of ids, on average.
RANGE_ROWS = 100_000
#: Subsets: (lowest bit of the term's hash, parts of the lexicon, how many of them are subsets).
SUBSETS = ((0, 16, 16), (6, 64, 24), (14, 256, 24), (24, 1024, 24))
#: Subsets in which one of two documents must have terms for a size of subsets to compare them.
OCCUPIED = 6


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms (runs of letters and digits of the lower-cased text)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS)


def lexicon_terms(docs: DataFrame, documents: int) -> DataFrame:
    """(h) of every term whose number of documents lies in the band, over all documents."""
    low, high = max(FEWEST, BAND[0] * documents), max(FEWEST, BAND[1] * documents)
    # An outer explode: an inner one would have the texts split twice, to filter out empty arrays first.
    seen = docs.select(F.explode_outer(term_hashes(F.col("text"))).alias("h")).groupBy("h").count()
    return seen.filter(F.col("h").isNotNull() & F.col("count").between(low, high)).select("h")


def in_slots(terms: DataFrame) -> DataFrame:
    """One row with the array of the lexicon's slots, each the array of its terms."""
    own = terms.select(slot(F.col("h")).cast("int").alias("at"), "h")
    # One array place for each slot: pieces of 1024 slots first, so that no step handles single slots in one task.
    empty = terms.sparkSession.range(1 << SLOT_BITS).select(F.col("id").cast("int").alias("at"), F.lit(None).cast("long").alias("h"))
    full = own.unionByName(empty).groupBy("at").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    sheets = full.groupBy(F.shiftright("at", 10).alias("sheet")).agg(sorted_values("at", "hs").alias("slots"))
    return sheets.agg(F.flatten(sorted_values("sheet", "slots")).alias("lexicon"))


def lexicon(docs: DataFrame, documents: int) -> DataFrame:
    """One row with the lexicon laid out in slots."""
    return in_slots(lexicon_terms(docs, documents))


def sorted_values(key: str, value: str) -> Column:
    """The values of a group as an array, by rising key."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])


def subset_hashes(terms: Column) -> Column:
    """One hash for each lexicon subset over the sorted terms in it; 0 where it has none."""

    def of_size(low: int, modulus: int, count: int) -> Column:
        def place(h: Column) -> Column:
            return F.shiftrightunsigned(h, low).bitwiseAND(F.lit(modulus - 1).cast("long"))

        near = F.filter(terms, lambda h: place(h) < count)
        parts = F.sequence(F.lit(0), F.lit(count - 1))
        # The array of one element binds the filtered terms, so that they are filtered once.
        return F.flatten(F.transform(F.array(near), lambda own: F.transform(parts, lambda j: F.filter(own, lambda h: place(h) == j))))

    return F.transform(F.concat(*(of_size(*s) for s in SUBSETS)), lambda own: F.when(F.size(own) == 0, 0).otherwise(F.hash(own)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either document has terms, taken over the
    smallest subsets that enough of them have terms in; 1 for equal fingerprints. With few terms in a
    subset the share comes near the share of common terms among all."""

    def add(n: Column, p: Column) -> Column:
        equal = F.when((p["x"] == p["y"]) & (p["x"] != 0), 1).otherwise(0)
        either = F.when((p["x"] != 0) | (p["y"] != 0), 1).otherwise(0)
        return F.struct((n["equal"] + equal).alias("equal"), (n["either"] + either).alias("either"))

    shares, first = [], 0
    for _, _, count in SUBSETS:
        pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), first + 1, count)
        none = F.struct(F.lit(0).alias("equal"), F.lit(0).alias("either"))
        shares.append(F.aggregate(pairs, none, add))
        first += count
    measured = F.filter(F.array(*reversed(shares)), lambda n: n["either"] >= OCCUPIED)
    chosen = F.coalesce(F.get(measured, 0), shares[0])
    share = F.get(F.transform(F.array(chosen), lambda n: n["equal"] / F.greatest(n["either"], F.lit(1))), 0)
    return F.when(a == b, 1.0).otherwise(share)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def order_key() -> Column:
    """What documents are ordered by: doc_id (null first), then a hash of the text, so that rows without
    an id are dealt out like any others."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text"))


def bounds(docs: DataFrame, ranges: int) -> DataFrame:
    """One row with the sorted array of the largest key of each range of documents (empty without any)."""
    dealt = docs.select(order_key().alias("key")).repartitionByRange(ranges, "key")
    tops = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top"))
    return tops.agg(F.array_sort(F.collect_list("top")).alias("tops"))


def with_bucket(df: DataFrame, tops: DataFrame, count: int) -> DataFrame:
    """``df`` (with key) plus bucket, the number of bounds below the key, by binary search. Each step is a
    column of its own, because bounds in a column or a lambda would be copied into every row."""
    df = df.withColumn("bucket", F.lit(0))
    for i in range(count.bit_length() - 1, -1, -1):
        further = F.get(tops.scalar(), F.col("bucket") + (1 << i) - 1) < F.col("key")
        df = df.withColumn("bucket", F.when(further, F.col("bucket") + (1 << i)).otherwise(F.col("bucket")))
    return df.withColumn("bucket", F.least(F.col("bucket"), F.lit(count - 1)))


def edited_pairs(docs: DataFrame, documents: int) -> DataFrame:
    """bucket, ghost, pos, doc_id, text and edited of every document (doc_id, text).

    Documents are dealt by ranges of ids into buckets; the first of each bucket also goes, marked as a
    ghost, to the end of the bucket before, so one shuffle of the texts does.
    """
    spark = docs.sparkSession
    ranges = max(4 * shuffle_parts(spark), -(-documents // RANGE_ROWS))
    tops = stored(bounds(docs, ranges), "ranges")
    n = max(1, tops.select(F.size("tops").alias("n")).first()["n"])
    is_top = F.col("key") == F.get(tops.scalar(), F.col("bucket"))
    here = F.struct(F.lit(False).alias("ghost"), F.col("bucket").alias("bucket"))
    there = F.struct(F.lit(True).alias("ghost"), ((F.col("bucket") + 1) % n).alias("bucket"))
    places = F.when(is_top, F.array(here, there)).otherwise(F.array(here))
    dealt = with_bucket(docs.withColumn("key", order_key()), tops, n).withColumn("place", F.explode_outer(places))
    dealt = dealt.select("key", "doc_id", "text", "place.ghost", "place.bucket")
    # Of rows with the largest key of a bucket (repeated rows) one ghost is enough; the others are dropped below.
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("key").desc(), "text")
    after = F.coalesce(F.lead("text").over(order), F.lit(""))
    paired = dealt.select("bucket", "ghost", "doc_id", "text", after.alias("next"), F.row_number().over(order).alias("pos"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    return paired.select("bucket", "ghost", "pos", "doc_id", "text", edited.alias("edited"))


def fingerprints_of(pairs: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """bucket, pos, head (what is carried along) and the subset hashes fp and fp_edited of both texts.

    Distinct terms of both texts are laid out in rows, marked by a join with the lexicon (broadcast if
    it is small) and gathered again by document. A text is told by its terms in the lexicon, else by all
    its terms, else by itself. Documents are dealt by bucket already, so that with a small lexicon
    nothing is shuffled here.
    """
    head = F.struct("ghost", "doc_id", "n_chars", "edited_sha256", F.xxhash64("text").alias("whole"), F.xxhash64("edited").alias("whole_edited"))

    def marked(text: str, side: int) -> Column:
        return F.transform(term_hashes(F.col(text)), lambda h: F.struct(F.lit(side).alias("side"), h.alias("h")))

    # The first row of each document has the head; its key is spread, so that empty texts do not gather.
    first = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64("bucket", "pos").alias("h")))
    laid = pairs.select("bucket", "pos", head.alias("head"), F.concat(first, marked("text", 1), marked("edited", 2)).alias("sides"))
    rows = laid.select("bucket", "pos", "head", F.explode_outer("sides").alias("x"))
    rows = rows.select("pos", "bucket", F.when(F.col("x.side") == 0, F.col("head")).alias("head"), "x.side", "x.h")
    known = terms.withColumn("inside", F.lit(True))
    held = rows.join(F.broadcast(known) if few else known, "h", "left")
    every = {name: F.collect_list(F.when(F.col("side") == side, F.col("h"))) for side, name in ((1, "every"), (2, "every_edited"))}
    inside = {f"in_{name}": F.collect_list(F.when((F.col("side") == side) & F.col("inside"), F.col("h"))) for side, name in ((1, "every"), (2, "every_edited"))}
    out = held.groupBy("pos", "bucket").agg(F.first("head", ignorenulls=True).alias("head"), *(c.alias(n) for n, c in (every | inside).items()))
    for fp, name, whole in (("fp", "every", "whole"), ("fp_edited", "every_edited", "whole_edited")):
        own, all_ = F.col(f"in_{name}"), F.col(name)
        used = F.when(F.size(own) > 0, own).when(F.size(all_) > 0, all_).otherwise(F.array(F.col(f"head.{whole}")))
        out = out.withColumn(name, F.sort_array(used)).withColumn(fp, subset_hashes(F.col(name)))
    return out.select("bucket", "pos", "head.*", "fp", "fp_edited")


def fingerprint_pairs(docs: DataFrame, *, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the
    next document by falling doc_id (after the last comes the first). Null text counts as empty, a
    null doc_id as the smallest. Rows of one doc_id follow each other by falling hash of their texts. A
    text without lexicon terms is taken with all its terms, one without terms as a whole. Equal texts have
    equal fingerprints. One row per input row, repeated rows too; an empty table gives an empty one. Only
    doc_id and text are read, so names of other columns cannot clash.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    documents = docs.count()
    terms = stored(lexicon_terms(docs, documents), "lexicon")
    few = terms.count() <= lexicon_rows
    pairs = edited_pairs(docs, documents)
    digests = {"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}
    slim = fingerprints_of(pairs.withColumns(digests), terms, few)
    after = Window.partitionBy("bucket").orderBy("pos")
    done = slim.withColumn("fp_next", F.lead("fp").over(after)).filter(~F.col("ghost"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("fp_next")), F.lit(1.0)).alias("near_next"),
    )


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprint_pairs(docs)
