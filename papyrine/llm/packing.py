"""Packing of tokenised documents into training sequences.

Method: first-fit decreasing over a tournament tree of bin capacities, run independently in
randomised groups of documents. A document longer than a sequence is cut into whole sequences and a
rest; only rests take part in the fitting. Whole sequences have groups of their own, so that neither many
documents nor long ones make a large group. Group numbers come from a hash of the piece and the number of
its partition, so a lost task is redone with the same result and repeated rows are dealt out like others.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm._shared import shuffle_parts, small_batches
from papyrine.llm._text import MIX_A, MIX_B, PRIME

#: Target number of rests in one randomised group.
GROUP_ROWS = 4096
#: Segments whose ids a task remembers (64 bytes each in a table half full, and their ids); beyond, it
#: forgets all and starts again.
MEMO = 1 << 20
#: Bytes of text encoded at a time, more only where a longer text cannot be cut.
BLOCK = 1 << 18
#: Segments of up to this many bytes are remembered: with their length they fill three words.
KEY_BYTES = 23
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class BytePairEncoder:
    """Ids of a byte-level vocabulary for a whole Arrow column at once.

    Ids equal those of the vocabulary's own tokenizer with special strings taken as ordinary text.
    Pre-tokens never go on from a character that is not white space to one that is, nor from a letter to
    anything but a letter, and what precedes such a place does not change how the rest is split. Texts are
    cut into segments at those of these places that bytes alone show; each different segment goes through
    the tokenizer once. Segments are looked up by their bytes and length, compared in full, in an open
    hash table of numpy arrays; longer ones go through the tokenizer each time.
    """

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._model = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self._widths[list(ranks.values())] = [len(piece) for piece in ranks]
        self._letter = np.zeros(256, bool)
        self._letter[65:91] = self._letter[97:123] = True
        masks = (b"\xff" * n + b"\0" * (24 - n) for n in range(KEY_BYTES + 1))
        self._masks = np.frombuffer(b"".join(masks), "<u8").reshape(-1, 3)
        self._plain = re.compile(r"[ \n]?\S+").fullmatch
        self._memo, self._bits = memo, (2 * memo - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        """An empty table: a key (the last is 0 where there is none), place and number of its ids."""
        self._keys = np.zeros((1 << self._bits, 3), np.uint64)
        self._at, self._count = np.zeros(1 << self._bits, np.int32), np.zeros(1 << self._bits, np.int32)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = self._known = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in a row, and where each text's begin (one entry more)."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins, parts, total = np.zeros(len(offsets), np.int64), [np.zeros(0, np.uint32)], 0
        a, size = 0, BLOCK
        while a < len(data):
            b = min(a + size, len(data))
            lo, hi = np.searchsorted(offsets, (a, b))
            starts = self._cuts(data[a:b], offsets[lo:hi] - a)
            if b < offsets[hi]:
                # The last segment may go on.
                if len(starts) == 1:
                    size *= 2
                    continue
                b, starts = a + int(starts[-1]), starts[:-1]
            if len(starts) > self._memo:
                b, starts = a + int(starts[self._memo]), starts[: self._memo]
            hi = np.searchsorted(offsets, b)
            ids, ends = self._segments(data[a:b], starts)
            begins[lo:hi] = total + np.append(0, ends)[np.searchsorted(starts, offsets[lo:hi] - a)]
            parts.append(ids)
            total += len(ids)
            a, size = b, BLOCK
        begins[np.searchsorted(offsets, len(data)) :] = total
        return np.concatenate(parts), begins

    def _cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where segments begin: at 0 and ``begins``, at a blank or line break after a character that is
        not white space, and at any other ASCII character but a letter after an ASCII letter."""
        last, this = data[:-1], data[1:]
        cut = np.zeros(len(data), bool)
        cut[1:] = self._letter[last] & ~self._letter[this] & (this < 128)
        blank = np.flatnonzero((this == 32) | (this == 10)) + 1
        good = data[blank - 1] > 32
        wide = np.flatnonzero(data[blank - 1] > 127)
        if len(wide):
            # White space of two and three bytes, and a few others.
            ends = blank[wide]
            one, two, three = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
            space = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            space |= (three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)
            space |= (three == 0xE2) & (two <= 0x81) & ((one <= 0x8A) | (one == 0x9F) | (one >= 0xA8))
            good[wide] = ~space
        cut[blank[good]] = True
        cut[0] = True
        cut[begins] = True
        return np.flatnonzero(cut)

    def _segments(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and where each segment's end."""
        if self._known + len(starts) > self._memo:
            self._forget()
        sizes = np.diff(starts, append=len(data))
        short = np.flatnonzero(sizes <= KEY_BYTES)
        own, width = starts[short], sizes[short]
        padded = np.zeros(len(data) + 24, np.uint8)
        padded[: len(data)] = data
        keys = np.ndarray(len(data), "V24", padded, strides=(1,))[own].view("<u8").reshape(-1, 3)
        keys &= self._masks[width]
        keys[:, 2] |= width.astype(np.uint64) << np.uint64(56)
        hashes = keys[:, 0] * PRIME + keys[:, 1] * MIX_A + keys[:, 2] * MIX_B
        hashes = (hashes ^ (hashes >> np.uint64(32))) * PRIME
        spots = (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        found = self._find(keys, spots)
        lost = np.flatnonzero(found < 0)
        while len(lost):
            # One of each hash; another segment of the same hash takes one more round.
            new = lost[np.unique(hashes[lost], return_index=True)[1]]
            self._learn(keys[new], spots[new], [data[x : x + n].tobytes().decode() for x, n in zip(own[new].tolist(), width[new].tolist(), strict=True)])
            found[lost] = self._find(keys[lost], spots[lost])
            lost = lost[found[lost] < 0]
        counts, at = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        counts[short], at[short] = self._count[found], self._at[found]
        long = {}
        for i in np.flatnonzero(sizes > KEY_BYTES).tolist():
            long[i] = self._model.encode_ordinary(data[starts[i] : starts[i] + sizes[i]].tobytes().decode())
            counts[i] = len(long[i])
        ends = np.cumsum(counts)
        ids = self._ids.take(np.repeat(at - ends + counts, counts) + np.arange(ends[-1]), mode="clip")
        for i, own_ids in long.items():
            ids[ends[i] - counts[i] : ends[i]] = own_ids
        return ids, ends

    def _find(self, keys: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or -1. Keys lie at their spot or at the next free one."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            there = self._keys[spots]
            other = there ^ keys
            hit = (other[:, 0] | other[:, 1] | other[:, 2]) == 0
            found[left[hit]] = spots[hit]
            on = np.flatnonzero(~hit & (there[:, 2] != 0))
            left, keys, spots = left[on], keys[on], (spots[on] + 1) & (len(self._keys) - 1)
        return found

    def _learn(self, keys: np.ndarray, spots: np.ndarray, texts: list[str]) -> None:
        """Puts different keys that the table has not into it, with the ids of their texts."""
        ids, ends = self._tokens(texts)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        counts, left = np.diff(ends, prepend=0), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self._keys[spots, 2] == 0)
            # Of those that want one free place the last gets it.
            self._at[spots[free]] = left[free]
            won = free[self._at[spots[free]] == left[free]]
            place, key = spots[won], left[won]
            self._keys[place], self._count[place] = keys[key], counts[key]
            self._at[place] = self._used + ends[key] - counts[key]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, spots = left[rest], (spots[rest] + 1) & (len(self._keys) - 1)
        self._used += len(ids)
        self._known += len(keys)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end. Texts whose only white space is one
        blank or line break before the rest go through the tokenizer together, a line break between them:
        it is a pre-token of its own there."""
        plain = np.array([self._plain(t) is not None for t in texts], bool)
        lines = [t for t, p in zip(texts, plain, strict=True) if p]
        ids = self._model.encode_to_numpy("\n".join(lines))
        breaks = np.cumsum([len(t.encode()) + 1 for t in lines])[:-1]
        at = np.searchsorted(np.cumsum(self._widths[ids]), breaks)
        ends = np.append(at, len(ids)) - np.arange(len(at) + 1)
        ids = np.delete(ids, at)
        if plain.all():
            return ids, ends
        each = iter(np.split(ids, ends[:-1]))
        found = [next(each) if p else np.array(self._model.encode_ordinary(t), np.uint32) for t, p in zip(texts, plain, strict=True)]
        return np.concatenate(found), np.cumsum([len(x) for x in found])


def token_pieces(docs: DataFrame, *, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids (then ``end_id``) cut into pieces of at most ``capacity``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, and ids (array<int>) if ``with_ids``.
    Null text counts as empty and so has the end id alone. Null doc_ids are kept. A text of any length is
    encoded as a whole, and its pieces take a row each. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = BytePairEncoder(public_tokenizers.path(f"{tokenizer}.tiktoken"), public_tokenizers.PATTERN)
        for batch in batches:
            ids, begins = coder.encode(batch.column(1))
            ids = np.insert(ids, begins[1:], end_id).astype("<u4", copy=False)
            begins += np.arange(len(begins))
            totals = np.diff(begins)
            pieces = -(-totals // capacity)
            row = np.repeat(np.arange(len(totals)), pieces)
            starts = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            # Pieces follow each other without a gap.
            edges = np.append(begins[row] + starts, len(ids))
            data = memoryview(ids).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in pairwise(edges.tolist())]
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (starts, np.diff(edges), sums, totals[row]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: items by falling size (ties: first given first), each
    into the first bin with room. A tournament tree over the bins holds the largest free room below
    each node, so the first bin with room is found in a number of steps logarithmic in the bins."""
    n = len(sizes)
    width = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - width, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces: DataFrame, *, rests: int | None = None, wholes: int | None = None, capacity: int = 1024, group_rows: int = GROUP_ROWS, seed: int = 0) -> DataFrame:
    """Places pieces (see token_pieces) into sequences: adds sequence_id and offset.

    Pieces as long as a sequence stand alone. The others are dealt to groups by a seeded hash, about
    ``group_rows`` in each, and every group is packed by itself. ``rests`` is the number of pieces shorter
    than a sequence (or of documents), ``wholes`` that of the others, each an upper bound perhaps; if one is
    unset, pieces are counted, which computes them once more. All other columns pass through, columns
    named like the results are replaced. An empty table gives an empty table. Equal rows are packed as
    different pieces. Sequence ids are distinct but not consecutive.
    """
    parts = shuffle_parts(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset", "_group")
    names = pieces.columns
    if rests is None or wholes is None:
        rests, wholes = pieces.agg(F.count_if(F.col("length") < capacity), F.count_if(F.col("length") >= capacity)).first()
    groups, more = max(1, -(-rests // group_rows)), max(1, -(-wholes // group_rows))
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    spot = F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed), F.spark_partition_id())
    key = F.when(F.col("length") < capacity, F.pmod(spot, F.lit(groups))).otherwise(groups + F.pmod(spot, F.lit(more)))

    def place(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].fill_null(-1)
        group = group.take(pa.array(np.lexsort((group["ids_crc32"].to_numpy(), group["start"].to_numpy(), ids.to_numpy()))))
        lengths = group["length"].to_numpy()
        short = lengths < capacity
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins[short], offsets[short] = first_fit_decreasing(lengths[short], capacity)
        bins[~short] = bins[short].max(initial=-1) + 1 + np.arange((~short).sum())
        number = group["_group"][0].as_py()
        return group.select(names).append_column("sequence_id", pa.array(number * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    return pieces.withColumn("_group", key).repartition(min(parts, groups + more), "_group").groupBy("_group").applyInArrow(place, out_schema)


def op5_packing(docs: DataFrame) -> DataFrame:
    """The contract's digest: one row per piece."""
    # A token has a byte at least, mostly about four.
    documents, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return pack(token_pieces(docs), rests=documents, wholes=size // 4096)
