"""Removal of repeated passages with a sampled suffix array over UTF-8 bytes.

A byte goes if a passage of ``width`` bytes that covers it also starts earlier (smaller doc_id, or the
same document and an earlier start); matches do not cross documents.

Method. Suffixes are taken at sampled places only: of all ``GRAM``-byte strings in each passage of
``width`` bytes the one of smallest hash (rightmost on ties) marks the passage's suffix, so two equal
passages have their suffixes at the same place in them and no match is lost. Then

1. every marked suffix is range-partitioned by its leading ``GRAM`` bytes, and by its block of documents
   after them, at sampled splitters. Each bucket is sorted by multikey quicksort and neighbours are
   compared: suffixes whose leading bytes equal a neighbour's may repeat. Equal leads that splitters have
   parted lie at the ends of their buckets, so only the ends are compared across boundaries;
2. each block sends the suffixes that may repeat once more, once for each different surrounding, with the
   bytes that their passages cover. They are partitioned and sorted in the same way, and within each run
   of equal leads a passage repeats if an earlier suffix of the run has it too. Runs at the ends of a
   bucket also hand on the first place of each of their passages, and these are compared across buckets;
3. the repeats go back to their blocks, where copies inside the block are added and bytes removed.

A block sends one suffix for each surrounding however many copies it holds, and a lead that many blocks
have is spread over as many buckets as its rows need, so no list or bucket grows with a hot passage.
Blocks and buckets hold a bounded share of bytes and rows. What one run of texts sends to one bucket, or one
bucket to one block, travels as one row of packed numbers. Of a marked string and of a passage, 64-bit
hashes of the bytes are compared. Documents are read whole; a document's block must fit into a worker.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.llm._shared import Scratch, shuffle_parts, small_batches, trimmed
from papyrine.llm._text import PRIME, U64, byte_values, mix, powers, slices

WIDTH = 100
#: Bytes of a marked string; the smaller, the fewer suffixes and the more chance repeats.
GRAM = 40
#: Documents and bytes of a block, on average.
BLOCK_ROWS, BLOCK_BYTES = 1500, 4 << 20
BATCH_BYTES = 1 << 19
#: Suffixes of a bucket, and samples that its splitters are taken from, on average. A bucket of suffixes
#: with their passages holds a tenth as many.
BUCKET_ROWS, SAMPLES = 125_000, 64
#: Bytes of text that give one marked suffix, about.
SPACING = 23


class Marks:
    """The marked places of a run of texts given as bytes, and their surroundings."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram = width, gram
        self.begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.begins[1:])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(byte_values()[self.data] * up[:n], out=self.sums[1:])
        self.place = self.low = self.high = self.text = np.zeros(0, np.int64)
        self.grams = np.zeros(0, U64)
        if n < width:
            return
        hashes = mix((self.sums[gram:] - self.sums[: n - gram + 1]) * self.down[: n - gram + 1])
        # Largest key in a window: hash bits above, place below, so that of equal hashes the last wins.
        bits = U64(32)
        keys = (hashes >> bits << bits) | np.arange(n - gram + 1, dtype=U64)
        window = width - gram + 1
        chosen = sliding_max(keys, window).astype(np.uint32).astype(np.int64)  # of each window start
        del keys
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.begins))
        starts = np.flatnonzero(owner[: len(chosen)] == owner[width - 1 : width - 1 + len(chosen)])
        chosen = chosen[starts]
        if not len(starts):
            return
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(chosen)]]) - 1
        self.place, self.text = chosen[new], owner[starts[new]]
        self.low, self.high = starts[new], starts[last]  # first and last start of the passages marked here
        self.grams = hashes[self.place]

    def hash(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.down[at])

    def surroundings(self) -> np.ndarray:
        """Hash of the bytes that the passages of each place cover, and of how they lie around it."""
        span = self.high + self.width - self.low
        return mix(self.hash(self.low, span) + (span * 1000 + self.place - self.low).astype(U64) * U64(0x9E3779B97F4A7C15))


def sliding_max(keys: np.ndarray, window: int) -> np.ndarray:
    """Largest of each ``window`` keys in a row, from running maxima within blocks both ways."""
    n = len(keys)
    padded = np.concatenate([keys, np.zeros(-n % window, keys.dtype)]).reshape(-1, window)
    ahead = np.maximum.accumulate(padded, axis=1).ravel()
    behind = np.maximum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[: n - window + 1], ahead[window - 1 : n])


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings (rows of big-endian words), and how many leading words each
    shares with the one before. Sorts by the first word, then each run of ties by the next."""
    n, words = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    shared = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    for w in range(words):
        if w:
            tied = np.flatnonzero(np.concatenate([group[1:] == group[:-1], [False]]) | np.concatenate([[False], group[1:] == group[:-1]])) if n > 1 else np.zeros(0, np.int64)
            if not len(tied):
                break
            inner = np.lexsort((keys[order[tied], w], group[tied]))
            order[tied] = order[tied][inner]
        column = keys[order, w]
        same = np.concatenate([[False], (group[1:] == group[:-1]) & (column[1:] == column[:-1])]) if n else np.zeros(0, bool)
        shared += same
        group = np.cumsum(~same)
    return order, shared


def runs(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive offsets of each row."""
    if not len(rows):
        return rows, offsets, offsets
    order = np.lexsort((offsets, rows))
    rows, offsets = rows[order], offsets[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (offsets[1:] != offsets[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(rows)]]) - 1
    return rows[new], offsets[new], offsets[last]


def in_order(block: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A block's documents by doc_id (null first), then hash of the text; and their bytes."""
    texts = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in block["text"].to_pylist()]
    ids = block["doc_id"]
    order = np.lexsort((block["_hash"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()))
    return block.take(pa.array(order, pa.int64())), [texts[i] for i in order.tolist()]


class Seen:
    """Keys met so far."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, U64)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are met for the first time; they are remembered."""
        own, at = np.unique(keys, return_index=True)
        fresh = ~np.isin(own, self.keys, assume_unique=True)
        out = np.zeros(len(keys), bool)
        out[at[fresh]] = True
        self.keys = np.concatenate([self.keys, own[fresh]])
        return out


def binary_of(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as an array of binaries."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[place])])


def bytes_of(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """Rows of bytes of a column of equally long binaries."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, 4 * whole.offset)
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(len(whole), length)


def packed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Different keys, and for each column (fixed-size items, sorted by key) the bytes that belong to each key."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    bounds = np.append(new, len(keys))
    out = []
    for column in columns:
        data = np.ascontiguousarray(column)
        size = data.nbytes // max(1, len(data))
        out.append(pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(data.tobytes())]))
    return keys[new], out


def unpacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The items packed in all rows of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words of eight, filled up with zeros, in byte order."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(U64)


def hash_of(rows: np.ndarray) -> np.ndarray:
    """The hash that Marks gives strings of these bytes."""
    return mix((byte_values()[rows] * powers(rows.shape[1])[0]).sum(1, dtype=U64))


def spread(leads: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """What suffixes are dealt by: leading bytes, then a scrambling of the block, as byte strings."""
    after = mix((blocks.astype(np.int64).view(U64) + U64(1)) * PRIME).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([leads, after], axis=1)).view(f"S{leads.shape[1] + 8}").ravel()


def splitters(sample: pa.Table, gram: int, buckets: int) -> np.ndarray:
    """Up to ``buckets`` - 1 keys that part the sample's weights evenly."""
    if not len(sample):
        return np.zeros(0, f"S{gram + 8}")
    keys, weights = spread(bytes_of(sample["lead"], gram), sample["block"].to_numpy()), sample["weight"].to_numpy()
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, buckets) / buckets)
    return np.unique(keys[order][np.minimum(at, len(order) - 1)])


def bucket_of(cuts: np.ndarray, leads: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, spread(leads, blocks), "right").astype(np.int32)


def leads_at(marks: Marks, place: np.ndarray) -> np.ndarray:
    """The leading bytes of the suffixes at the given places."""
    return marks.data[place[:, None] + np.arange(marks.gram)[None, :]]


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binaries."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


#: Kinds of the rows that a bucket of leads gives: marked strings of a block that repeat (packed), a lead at
#: an end of the bucket that does not repeat in it, one that does, and a sample of those that repeat.
REPEATS, OPEN, WITNESS, SAMPLE = 0, 1, 2, 3
LEAD_SCHEMA = "block long, grams binary, kind int, lead binary"


def repeated_leads(bucket: pa.Table, gram: int) -> pa.Table:
    """Sorts a bucket's suffixes and compares neighbours: the hashes of leads that repeat, by block, one in
    64 of them as a sample, and the lead of the run at each end of the bucket."""
    leads = unpacked(bucket["leads"], np.uint8).reshape(-1, gram)
    marked = unpacked(bucket["blocks"], np.int64)
    block, twice = marked >> 1, marked & 1
    keys = words_of(leads)
    order, shared = multikey_sort(keys)
    run = np.cumsum(shared < keys.shape[1]) - 1
    many = (np.bincount(run) > 1) | (np.bincount(run, twice[order]) > 0)
    rows, ends = order[many[run]], order[np.unique([0, np.searchsorted(run, run[-1])])]
    grams, block_of = hash_of(leads[rows]), block[rows]
    some = rows[mix(grams ^ mix(block_of.view(U64))) % U64(64) == 0]
    by = np.lexsort((grams, block_of))
    blocks, (repeats,) = packed(block_of[by], grams[by])
    shown = np.concatenate([ends, some])
    kind = np.concatenate([np.where(many[run[[0, -1]]][-len(ends) :], WITNESS, OPEN), np.full(len(some), SAMPLE)])
    singles = binaries(np.ascontiguousarray(hash_of(leads[shown])).view(np.uint8).reshape(-1, 8))
    columns = [np.concatenate([blocks, block[shown]]), pa.concat_arrays([repeats, singles]), np.concatenate([np.full(len(blocks), REPEATS), kind]).astype(np.int32), pa.concat_arrays([pa.nulls(len(blocks), pa.binary()), binaries(leads[shown])])]
    return pa.table(columns, ["block", "grams", "kind", "lead"])


#: A suffix that a block sends: where it is, how many bytes of its context come before it, how many
#: passages it marks, and the length of the context, which begins with the first passage.
SUFFIX = np.dtype([("block", "i8"), ("doc", "i4"), ("known", "?"), ("doc_id", "i8"), ("hash", "i8"), ("start", "i8"), ("before", "i4"), ("windows", "i4"), ("size", "i4")])
SUFFIX_SCHEMA = "bucket int, suffixes binary, contexts binary"
#: A run of passages of a suffix that repeat; rows hold a block's runs, or (with ``passage``) the first
#: place of a passage in a bucket.
RUN = np.dtype([("doc", "i4"), ("start", "i8"), ("first", "i4"), ("last", "i4")])
FOUND_SCHEMA = "block long, runs binary, passage long, known boolean, doc_id long, hash long, at long"


def repeated_passages(bucket: pa.Table, width: int, gram: int) -> pa.Table:
    """Sorts a bucket's suffixes, and within each run of equal leads finds the passages that an earlier
    suffix (by doc_id, hash of the text, start) has too."""
    suffixes, data = unpacked(bucket["suffixes"], SUFFIX), unpacked(bucket["contexts"], np.uint8)
    before, windows, size = (suffixes[c].astype(np.int64) for c in ("before", "windows", "size"))
    begins = np.cumsum(size) - size
    keys = words_of(data[(begins + before)[:, None] + np.arange(gram)[None, :]])
    order, shared = multikey_sort(keys)
    run = np.cumsum(shared < keys.shape[1]) - 1
    edge = np.zeros(run[-1] + 1, bool)
    edge[[0, -1]] = True
    used = ((np.bincount(run) > 1) | edge)[run]
    rows, edge = order[used], edge[run[used]]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    n = windows[rows]
    row, edge = np.repeat(rows, n), np.repeat(edge, n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begins[row] + offset
    # A passage is known by its bytes and where the marked string lies in it.
    passage = mix((sums[start + width] - sums[start]) * down[start]) ^ mix((before[row] - offset).astype(U64) + U64(1))
    at = suffixes["start"][row] + offset
    # Only passages that are there more than once, or at an end of the bucket, need an order.
    keep = np.flatnonzero(edge | ~lone(passage))
    row, offset, passage, at, edge = row[keep], offset[keep], passage[keep], at[keep], edge[keep]
    order = np.lexsort((at, suffixes["hash"][row], suffixes["doc_id"][row], suffixes["known"][row], passage))
    again = np.zeros(len(order), bool)
    again[order[1:]] = passage[order[1:]] == passage[order[:-1]]
    found, first, last = runs(row[again], offset[again])
    handed = np.flatnonzero(edge & ~again)
    both = np.concatenate([found, row[handed]])
    out = np.zeros(len(both), RUN)
    out["doc"], out["start"] = suffixes["doc"][both], suffixes["start"][both]
    out["first"], out["last"] = np.concatenate([first, offset[handed]]), np.concatenate([last, offset[handed]])
    block = suffixes["block"][found]
    by = np.argsort(block, kind="stable")
    blocks, (packed_runs,) = packed(block[by], out[: len(found)][by])
    own, none = row[handed], len(blocks)
    singles = binaries(np.ascontiguousarray(out[len(found) :]).view(np.uint8).reshape(-1, RUN.itemsize))
    ends = {"passage": passage[handed].view(np.int64), "known": suffixes["known"][own], "doc_id": suffixes["doc_id"][own], "hash": suffixes["hash"][own], "at": at[handed]}
    columns = [np.concatenate([blocks, suffixes["block"][own]]), pa.concat_arrays([packed_runs, singles])]
    for name, values in ends.items():
        kind = pa.bool_() if name == "known" else pa.int64()
        columns.append(pa.concat_arrays([pa.nulls(none, kind), pa.array(np.ascontiguousarray(values), kind)]))
    return pa.table(columns, ["block", "runs", *ends])


def lone(keys: np.ndarray) -> np.ndarray:
    """Which keys surely occur once: no other key falls into their place of a table."""
    bits = max(10, int(len(keys) * 4).bit_length())
    place = (keys >> U64(64 - bits)).astype(np.int64)
    return (np.bincount(place, minlength=1 << bits) == 1)[place]


def leads_of(docs: DataFrame, cuts: np.ndarray, width: int, gram: int) -> DataFrame:
    """bucket, leads and blocks (packed; the lowest bit of a block tells whether it has the lead twice) of the
    marked suffixes of documents (_block, text), once for each block that a run of texts holds. Nothing but
    these rows is shuffled."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, texts = batch.column(0).to_numpy(), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for part in slices(map(len, texts), BATCH_BYTES):
                marks = Marks(texts[part], width, gram)
                if not len(marks.place):
                    continue
                block = blocks[part][marks.text]
                order = np.lexsort((block, marks.grams))
                key, own = marks.grams[order], block[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
                times = np.diff(np.concatenate([new, [len(order)]]))
                leads, own = leads_at(marks, marks.place[order[new]]), own[new] * 2 + (times > 1)
                bucket = bucket_of(cuts, leads, own >> 1)
                by = np.argsort(bucket, kind="stable")
                buckets, columns = packed(bucket[by], leads[by], own[by])
                yield pa.RecordBatch.from_arrays([pa.array(buckets), *columns], ["bucket", "leads", "blocks"])

    return docs.select("_block", "text").mapInArrow(trimmed(marked), "bucket int, leads binary, blocks binary")


def sampled_leads(docs: DataFrame, share: float, width: int, gram: int) -> pa.Table:
    """lead, block and weight of about SAMPLES suffixes of each document of a sample."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = Marks([(text or "").encode("utf-8", "surrogatepass")], width, gram)
                step = max(1, len(marks.place) // SAMPLES)
                place = marks.place[::step]
                yield pa.RecordBatch.from_arrays([binaries(leads_at(marks, place)), pa.array(np.full(len(place), block)), pa.array(np.full(len(place), float(step)))], ["lead", "block", "weight"])

    sample = docs.select("_block", "text") if share >= 1 else docs.select("_block", "text").sample(share, 5)
    return sample.mapInArrow(some, "lead binary, block long, weight double").toArrow()


def suffixes_of(docs: DataFrame, wanted: DataFrame, cuts: np.ndarray, width: int, gram: int) -> DataFrame:
    """The suffixes of each block at the marked strings wanted, once for each different surrounding, packed by
    bucket."""
    none = no_rows(SUFFIX_SCHEMA)

    def suffixes(group: pa.Table, own: pa.Table) -> pa.Table:
        tables = [none]
        if len(group) and len(own):
            group, texts = in_order(group)
            known, ids, hashes = (group["doc_id"].is_valid().to_numpy(), group["doc_id"].fill_null(0).to_numpy(), group["_hash"].to_numpy())
            block, repeated, seen = group["_block"][0].as_py(), np.unique(unpacked(own["grams"], U64)), Seen()
            for part in slices(map(len, texts), BATCH_BYTES):
                marks = Marks(texts[part], width, gram)
                use = np.flatnonzero(among(marks.grams, repeated))
                use = use[seen.first(marks.surroundings()[use])]
                bucket = bucket_of(cuts, leads_at(marks, marks.place[use]), np.full(len(use), block))
                by = np.argsort(bucket, kind="stable")
                use, bucket = use[by], bucket[by]
                doc, low = marks.text[use] + part.start, marks.low[use]
                rows = np.zeros(len(use), SUFFIX)
                rows["block"], rows["doc"], rows["known"], rows["doc_id"], rows["hash"] = block, doc, known[doc], ids[doc], hashes[doc]
                rows["start"], rows["before"] = low - marks.begins[marks.text[use]], marks.place[use] - low
                rows["windows"], rows["size"] = marks.high[use] - low + 1, marks.high[use] + width - low
                buckets, (heads,) = packed(bucket, rows)
                # The contexts of a bucket follow each other.
                upto = np.concatenate([[0], np.cumsum(rows["size"], dtype=np.int64)])
                each = binary_of(marks.data, low, rows["size"].astype(np.int64))
                bounds = upto[np.append(np.searchsorted(bucket, buckets), len(use))]
                contexts = pa.Array.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer(bounds.astype(np.int32)), each.buffers()[2]])
                tables.append(pa.table([pa.array(buckets), heads, contexts], none.schema.names))
        return pa.concat_tables(tables)

    small = docs.select("_block", "doc_id", "_hash", "text")
    return small.groupBy("_block").cogroup(wanted.groupBy("block")).applyInArrow(suffixes, SUFFIX_SCHEMA)


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, text_out: bool = False) -> DataFrame:
    """All columns of ``docs`` but text, plus n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 (lowercase hex of the remaining bytes); with ``text_out`` also text, the remaining
    bytes without characters cut in two.

    Null text counts as empty, a null doc_id as smaller than any. Rows of the same doc_id count by
    hash of the text and then as given (equal rows: all but one lose their repeats). Texts shorter than
    ``width`` bytes are left alone. One row out for each row in; an empty table gives an empty one. Columns
    named like the results, _block or _hash are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "_block", "_hash")
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(1, -(-count // block_rows), -(-size // BLOCK_BYTES))
    parts = max(1, min(blocks, 2 * shuffle_parts(spark)))
    # Rows are dealt by id and text, so that neither rows without an id nor copies gather in a block.
    numbered = docs.withColumn("_hash", F.xxhash64(text)).withColumn("_block", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(blocks)))
    dealt = numbered.repartition(parts, "_block")

    rows = size / SPACING
    buckets = max(2, math.ceil(rows / bucket_rows))
    share = SAMPLES * buckets / max(1.0, min(rows, SAMPLES * count))
    cuts = splitters(sampled_leads(numbered, share, width, gram), gram, buckets)
    deal = max(1, min(buckets, 2 * shuffle_parts(spark)))
    compared = leads_of(numbered, cuts, width, gram).repartition(deal, "bucket").groupBy("bucket")
    early = Scratch(spark)
    leads = early.stored(compared.applyInArrow(lambda bucket: repeated_leads(bucket, gram), LEAD_SCHEMA), "leads")
    ends = leads.filter(F.col("kind").isin(OPEN, WITNESS))
    parted = ends.groupBy("lead").agg(F.count("*").alias("n")).filter("n > 1")
    across = ends.filter(F.col("kind") == OPEN).join(parted, "lead").select("block", "grams")
    wanted = scratch.stored(leads.filter(F.col("kind") == REPEATS).select("block", "grams").unionByName(across), "grams")

    sends = (wanted.agg(F.sum(F.octet_length("grams")).alias("n")).first()["n"] or 0) // 8
    buckets = max(2, math.ceil(10 * sends / bucket_rows))
    sample = leads.filter(F.col("kind") == SAMPLE).sample(min(1.0, 64 * SAMPLES * buckets / max(1, sends)), 5)
    cuts = splitters(sample.select("lead", "block", F.lit(1.0).alias("weight")).toArrow(), gram, buckets)
    early.drop()
    deal = max(1, min(buckets, 2 * shuffle_parts(spark)))
    compared = suffixes_of(dealt, wanted, cuts, width, gram).repartition(deal, "bucket").groupBy("bucket")
    found = scratch.stored(compared.applyInArrow(lambda bucket: repeated_passages(bucket, width, gram), FOUND_SCHEMA), "passages")
    handed = found.filter("passage is not null").withColumn("place", F.struct("known", "doc_id", "hash", "at"))
    firsts = handed.groupBy("passage").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = handed.join(firsts, "passage").filter("place > earliest").select("block", "runs")
    repeats = found.filter("passage is null").select("block", "runs").unionByName(later)
    return cut_out(dealt, names, repeats, wanted, width, gram, text_out)


def cut_out(dealt: DataFrame, names: list[str], repeats: DataFrame, wanted: DataFrame, width: int, gram: int, text_out: bool) -> DataFrame:
    """The documents of each block without the passages that repeat those of other blocks (``repeats``)
    or earlier ones of their own, which are known by the surroundings of their marked strings."""
    result = [x for x in names if x != "text"]
    schema = dealt.select(*result).schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_sha256", "string")
    schema = schema.add("text", "string") if text_out else schema
    none = no_rows(schema)

    def cut(group: pa.Table, more: pa.Table) -> pa.Table:
        if not len(group):
            return none
        group, texts = in_order(group)
        repeated = np.unique(unpacked(more["grams"].drop_null(), U64))
        own = unpacked(more["runs"].drop_null(), RUN)
        own = own[np.argsort(own["doc"], kind="stable")]
        doc, start, first, last = (own[c].astype(np.int64) for c in ("doc", "start", "first", "last"))
        seen = Seen()
        sizes: list[tuple[int, int, int, str]] = []
        kept: list[str] = []
        for part in slices(map(len, texts), BATCH_BYTES):
            marks = Marks(texts[part], width, gram)
            use = np.flatnonzero(among(marks.grams, repeated))
            use = use[~seen.first(marks.surroundings()[use])]
            here = slice(*np.searchsorted(doc, [part.start, part.stop]))
            base = marks.begins[doc[here] - part.start] + start[here]
            low = np.concatenate([marks.low[use], base + first[here]])
            high = np.concatenate([marks.high[use], base + last[here]])
            change = np.bincount(low, minlength=len(marks.data) + 1) - np.bincount(high + width, minlength=len(marks.data) + 1)
            removed = np.cumsum(change)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(removed)])
            gone = upto[marks.begins[1:]] - upto[marks.begins[:-1]]
            for i, n in enumerate(gone.tolist()):
                text, spans = texts[part.start + i], 0
                size = len(text)
                if n:
                    mask = removed[marks.begins[i] : marks.begins[i + 1]]
                    text = marks.data[marks.begins[i] : marks.begins[i + 1]][~mask].tobytes()
                    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0])
                sizes.append((size, n, spans, hashlib.sha256(text).hexdigest()))
                if text_out:
                    kept.append(text.decode("utf-8", "ignore"))
        columns = [pa.array(c, t) for c, t in zip(zip(*sizes, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        out = group.select(result)
        for name, column in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, strict=True):
            out = out.append_column(name, column)
        return out.append_column("text", pa.array(kept, pa.string())) if text_out else out

    both = repeats.withColumn("grams", F.lit(None).cast("binary")).unionByName(wanted.select("block", "grams"), allowMissingColumns=True)
    return dealt.groupBy("_block").cogroup(both.groupBy("block")).applyInArrow(cut, schema)


def no_rows(schema: str | StructType) -> pa.Table:
    """An empty table of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"))
