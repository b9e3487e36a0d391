"""Similarity join of documents by the Jaccard likeness of their five-word shingles.

Method: MinHash values of all documents are cut into bands; documents that share a band are
candidates. Candidate pairs are compared value by value in steps, and a pair is dropped as soon as the
posterior probability that its likeness reaches the threshold (uniform prior, binomial matches) falls
below a tolerance; the rest are verified exactly on their shingles.

Copies (equal shingle sets) are one class from the start, reduced before any join. Candidates are
never listed pair by pair: a band's documents are tied to the smallest of them, connected parts of
these ties are found by star contractions, and a small part is compared within itself. A large part is
compared band by band, each pair in the first band that it shares, or as a whole where that takes fewer
comparisons (a dense group of near copies, whose bands hold most of it); either way in pairs of blocks.
A unit of work gives a row for each of its documents and a forest of its links, so rows grow with
documents, not pairs. At the defaults a pair of likeness 0.8 misses all bands with chance 5e-8 and is
dropped with chance below 1e-6.

Texts of any length are read whole; blocks are bounded by shingles as well as by documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm._shared import Scratch, small_batches, stored, trimmed
from papyrine.llm._text import PRIME, U64, mix, shingles, slices

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: Values compared at each step, and the least posterior probability of a pair that stays.
STEP, TOLERANCE = 32, 1e-7
#: Classes, and shingles, of one block of a large part and of a task's share of small parts.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Candidate classes up to this number are broadcast (40 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 300_000
BATCH_CHARS = 1 << 18


def minhashes(hashes: np.ndarray, begins: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values, sets x count, of non-empty sets laid in a row."""
    keys = mix(np.arange(1, count + 1, dtype=U64) * PRIME) | U64(1)
    out = np.zeros((len(begins), count), U64)
    for k in range(count):
        x = (hashes ^ keys[k]) * keys[-1 - k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> U64(32)), begins)
    return out


def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among the compared values with which a pair stays: P(likeness >= threshold given
    m matches of n) is the chance of at most m successes in n + 1 trials."""
    total = 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash), key (of the shingle set), n_shingles and bands of each document."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(map(len, texts), BATCH_CHARS):
                keys, sizes, bands = class_keys(texts[part])
                some = sizes > 0
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start).cast(pa.int64()), batch.column(2).slice(part.start, part.stop - part.start), pa.array(keys.view(np.int64)), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))], ["doc_id", "_text", "key", "n_shingles", "bands"])

    return docs.select("doc_id", "text", "_text").mapInArrow(trimmed(sketch), "doc_id long, _text long, key long, n_shingles long, bands array<long>")


def set_keys(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key of each non-empty set, from two sums over its scrambled members."""
    return mix(np.add.reduceat(mix(hashes ^ PRIME), begins) + mix(np.bitwise_xor.reduceat(mix(hashes + PRIME), begins)) * PRIME + sizes.astype(U64))


def class_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and number of shingles of each text, and bands of those that have any. Texts without words
    go by their characters: only equal ones are alike."""
    hashes, owner = shingles(texts, WORDS)
    sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    keys = np.zeros(len(texts), U64)
    some = np.flatnonzero(sizes)
    bands = np.zeros((0, BANDS), U64)
    if len(some):
        begins = np.concatenate([[0], np.cumsum(sizes[some])])[:-1]
        keys[some] = set_keys(hashes, begins, sizes[some])
        values = minhashes(hashes, begins).reshape(len(some), BANDS, ROWS)
        acc = np.arange(BANDS, dtype=U64)[None, :] * np.ones((len(some), 1), U64)
        for r in range(ROWS):
            acc = mix(acc * PRIME + values[:, :, r])
        bands = acc
    for i in np.flatnonzero(sizes == 0):
        codes = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        keys[i] = mix(np.bitwise_xor.reduce(mix(codes + np.arange(1, len(codes) + 1, dtype=U64) * PRIME)) + U64(len(codes)) + np.zeros(1, U64))[0] if len(codes) else U64(1)
    return keys, sizes.astype(np.int64), bands


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (u, v); component is the smallest node.

    Alternates large-star and small-star contractions until nothing changes. A node's neighbours are
    never gathered: a minimum by node is joined back to its edges.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.stored(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(keep=1)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found == state:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def compare(hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, earlier: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (numbers in ``hashes``) between the sets ``left`` and ``right``, or within ``left``
    where both are the same; some rows of ``left`` at a time. Pairs that agree anywhere in ``earlier``
    (rows for all sets) are left out: they are another unit's."""
    inside = left is right or np.array_equal(left, right)
    used = left if inside else np.concatenate([left, right])
    sizes = np.array([len(hashes[i]) for i in used])
    flat = np.concatenate([hashes[i] for i in used])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    signature = (minhashes(flat, begins[:-1]) & U64(0xFFFFFFFF)).astype(np.uint32)
    n_left = len(left)
    other = np.arange(n_left) if inside else np.arange(n_left, len(used))
    columns, number = np.unique(flat, return_inverse=True)
    common = np.bincount(number) > 1
    place = np.cumsum(common) - 1
    width = int(common.sum())
    owner = np.repeat(np.arange(len(used)), sizes)[common[number]]
    number = place[number[common[number]]]
    for at in range(0, n_left, 512):
        rows = np.arange(at, min(at + 512, n_left))
        able = np.minimum(sizes[rows][:, None], sizes[other][None, :]) * 5 >= np.maximum(sizes[rows][:, None], sizes[other][None, :]) * 4
        if inside:
            able &= other[None, :] > rows[:, None]
        matches = np.zeros(able.shape, np.uint8)
        for step in range(0, BANDS * ROWS, STEP):
            busy = np.count_nonzero(able)
            if not busy:
                break
            if busy * 4 < able.size:
                i, j = np.nonzero(able)
                for lo in range(0, len(i), 1 << 18):
                    s = slice(lo, lo + (1 << 18))
                    matches[i[s], j[s]] += (signature[rows[i[s]], step : step + STEP] == signature[other[j[s]], step : step + STEP]).sum(1).astype(np.uint8)
            else:
                for k in range(step, step + STEP):
                    matches += signature[rows, k][:, None] == signature[other, k][None, :]
            able &= matches >= least_matches(step + STEP)
        i, j = np.nonzero(able)
        if earlier is not None and earlier.shape[1]:
            own = np.concatenate([~(earlier[used[rows[i[s]]]] == earlier[used[other[j[s]]]]).any(1) for lo in range(0, len(i), 1 << 16) if (s := slice(lo, lo + (1 << 16)))] or [np.zeros(0, bool)])
            i, j = i[own], j[own]
        if not len(i):
            continue
        left_sizes, right_sizes = sizes[rows[i]], sizes[other[j]]
        if len(i) * float(sizes[rows[i]].mean()) * 2e-8 < len(rows) * len(other) * width / 1e10:
            shared = np.array([len(np.intersect1d(hashes[used[rows[a]]], hashes[used[other[b]]], True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        else:
            both = np.zeros((len(rows), len(other)), np.float32)
            for lo in range(0, width, 4096):
                own = (number >= lo) & (number < lo + 4096)
                grid = np.zeros((len(used), min(4096, width - lo)), np.float32)
                grid[owner[own], number[own] - lo] = 1
                both += grid[rows] @ grid[other].T
            shared = both[i, j].astype(np.int64)
        good = shared * 5 >= (left_sizes + right_sizes - shared) * 4
        yield used[rows[i[good]]], used[other[j[good]]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number of each node's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        live = low != high
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def join(docs: DataFrame, *, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document.

    Documents are linked if the Jaccard likeness of their shingle sets is 0.8 or more; class_id is the
    smallest doc_id that links lead to. n_links counts the other documents linked directly, copies
    (n_copies, itself counted) among them. Words are runs of letters and digits of the lower-cased
    text; a text of one to four words is one shingle; texts without words are linked if they are equal,
    null counting as empty. A null doc_id is the largest; a class of null ids only has a null class_id.
    Rows of equal id and text are copies. One row out for each row in, none for an empty table. Only doc_id
    and text are read, so names of other columns cannot clash. With ``texts`` there are also the
    hashes of the row's text (_text) and of the text of the class's first row by id, then hash (class_text).
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    rows = stored(sketches(docs), "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text"))
    classes = rows.groupBy("key").agg(rep.alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    banded = scratch.stored(rows.filter("n_shingles > 0").groupBy("key").agg(F.any_value("bands").alias("bands")), "bands")
    members = scratch.stored(parts_of(banded, classes), "members")
    total, weight = members.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    shares = max(1, -(-total // block), -(-weight // BLOCK_SHINGLES))
    shingled = contents(docs, members, total <= BROADCAST_ROWS)
    large = members.filter(blocks_of(F.col("size"), F.col("weight"), block) > 1).select("key", "component", "size", "n_shingles")
    some_large = large.limit(1).count()
    if some_large:
        shingled = scratch.stored(shingled, "shingles")
    units = small_units(shingled, shares, block)
    if some_large:
        units = units.unionByName(large_units(shingled, banded, large, scratch, block))
    found = scratch.stored(units.groupBy("unit").applyInArrow(linked, "key long, links long, root long, whole boolean"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = found.filter("whole").select("key", "root").distinct()
    cut = found.filter("not whole")
    if cut.limit(1).count():
        spread = connected_components(cut.select(F.col("key").alias("u"), F.col("root").alias("v")))
        roots = roots.unionByName(spread.select(F.col("node").alias("key"), F.col("component").alias("root")))
    named = classes.join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = named.groupBy("root").agg(F.min("rep").alias("first"))
    others = F.coalesce(F.col("links"), F.lit(0)) + F.col("copies") - 1
    named = named.join(ids, "root").select("key", F.col("first.doc_id").alias("class_id"), F.col("first._text").alias("class_text"), others.alias("n_links"), F.col("copies").alias("n_copies"))
    named = stored(named, "classes")
    scratch.drop()
    out = ["doc_id", "_text", "class_id", "class_text", "n_links", "n_copies"]
    return rows.select("doc_id", "_text", "key").join(named, "key").select(*(c for c in out if texts or not c.endswith("_text")))


def blocks_of(size: Column, weight: Column, block: int) -> Column:
    """Number of blocks for so many classes and shingles."""
    return F.greatest(F.ceil(size / block), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")


def parts_of(banded: DataFrame, classes: DataFrame) -> DataFrame:
    """key, component, size, weight (classes and shingles of the component), rep, rep_text, copies and
    n_shingles of every class that shares a band with another."""
    ties = banded.select("key", F.explode("bands").alias("band"))
    heads = ties.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head")
    edges = ties.join(heads, "band").filter("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    parts = connected_components(edges).select(F.col("node").alias("key"), "component").join(classes, "key")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    return parts.join(sizes, "component").select("key", "component", "size", "weight", F.col("rep.doc_id").alias("rep"), F.col("rep._text").alias("rep_text"), "copies", "n_shingles")


def contents(docs: DataFrame, members: DataFrame, few: bool) -> DataFrame:
    """key, component, size, weight, copies and content (shingle hashes) of the members, from the texts of
    their first rows. These are found by id and text, so that rows without ids neither gather in one task
    nor meet all others of their kind; of equal rows without ids one goes on."""
    held = docs.filter("doc_id is not null").unionByName(docs.filter("doc_id is null").dropDuplicates(["_text"]))
    same = held["doc_id"].eqNullSafe(members["rep"]) & (held["_text"] == members["rep_text"])
    text = held.join(F.broadcast(members) if few else members, same).select("key", "component", "size", "weight", "copies", "text")
    carried = text.columns[:-1]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            for part in slices(map(len, texts), BATCH_CHARS):
                hashes, owner = shingles(texts[part], WORDS)
                n = part.stop - part.start
                ends = np.cumsum(np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, int))
                own = batch.slice(part.start, n)
                keys = class_keys_only(hashes, ends)
                ours = np.flatnonzero(keys == own.column(0).to_numpy().view(U64))
                content = [hashes[(ends[i - 1] if i else 0) : ends[i]].tobytes() for i in ours]
                columns = [own.column(c).take(pa.array(ours)) for c in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], [*carried, "content"])

    return text.mapInArrow(trimmed(sets), "key long, component long, size long, weight long, copies long, content binary")


def small_units(shingled: DataFrame, shares: int, block: int) -> DataFrame:
    """Rows of parts that are one block, dealt to shares: unit, key, copies and content, group (what is
    compared: a part or a band), its blocks a and b, a row's own block, whole (whether the unit has all links of
    its group) and earlier (the row's earlier bands; pairs that agree there are another unit's)."""
    own = shingled.filter(blocks_of(F.col("size"), F.col("weight"), block) == 1)
    zero, none = F.lit(0), F.array().cast("array<long>")
    unit = F.pmod(F.xxhash64("component"), F.lit(shares))
    return own.select(unit.alias("unit"), "key", "copies", "content", F.col("component").alias("group"), zero.alias("a"), zero.alias("b"), zero.alias("own"), F.lit(True).alias("whole"), none.alias("earlier"))


def large_units(shingled: DataFrame, banded: DataFrame, large: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Rows of larger parts (key, component, size, n_shingles): by shared bands, or the whole part where
    that takes no more comparisons."""
    large = scratch.stored(large, "large")
    numbered = banded.join(large, "key").select("key", "component", "n_shingles", "bands", F.posexplode("bands").alias("number", "band"))
    groups = numbered.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).filter("n > 1")
    groups = scratch.stored(groups, "groups")
    # Comparisons band by band, each of which may repeat those of others, against all pairs of the part.
    cost = groups.groupBy("component").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("by_bands"))
    size = F.col("size").cast("double")
    modes = scratch.stored(large.select("component", "size").distinct().join(cost, "component").select("component", (F.col("by_bands") < size * size).alias("banded")), "modes")
    # A row for each large part: far fewer than rows, but their number is checked all the same.
    if modes.count() <= BROADCAST_ROWS:
        modes = F.broadcast(modes)
    none = F.array().cast("array<long>")
    whole = shingled.join(modes.filter("not banded"), "component").select("key", "copies", "content", F.col("component").alias("group"), blocks_of(F.col("size"), F.col("weight"), block).alias("blocks"), none.alias("earlier"))
    held = groups.join(modes.filter("banded"), "component").select("component", "band", blocks_of(F.col("n"), F.col("weight"), block).alias("blocks"))
    rows = numbered.select("key", "component", "band", F.slice("bands", F.lit(1), F.col("number")).alias("earlier")).join(held, ["component", "band"])
    content = shingled.join(modes.filter("banded"), "component").select("key", "copies", "content")
    by_band = rows.join(content, "key").select("key", "copies", "content", F.col("band").alias("group"), "blocks", "earlier")
    both = whole.unionByName(by_band).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    return both.select(F.xxhash64("group", a, b).alias("unit"), "key", "copies", "content", "group", a.alias("a"), b.alias("b"), "own", F.lit(False).alias("whole"), "earlier")


def linked(group: pa.Table) -> pa.Table:
    """A unit's rows compared: number of linked documents and root of each class in each of its groups."""
    key, copies, own = (group[c].to_numpy() for c in ("key", "copies", "own"))
    what, a, b = (group[c].to_numpy() for c in ("group", "a", "b"))
    hashes = [np.frombuffer(c.as_buffer(), U64) for c in group["content"].combine_chunks()]
    before = group["earlier"].combine_chunks()
    order = np.lexsort((key, b, a, what))
    new = np.flatnonzero(np.concatenate([[True], (what[order][1:] != what[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]))
    links = np.zeros(len(key), np.int64)
    label = np.arange(len(key))
    for lo, hi in zip(new, np.concatenate([new[1:], [len(order)]]), strict=True):
        some = order[lo:hi]
        some = some[np.unique(key[some], return_index=True)[1]]  # a row of each class
        first, second = a[some[0]], b[some[0]]
        left = some[own[some] == first]
        right = left if first == second else some[own[some] == second]
        if not len(left) or not len(right):
            continue
        width = len(before[int(some[0])])
        earlier = None
        if width:
            earlier = np.zeros((len(key), width), np.int64)
            earlier[some] = before.take(pa.array(some)).flatten().to_numpy().reshape(len(some), width)
        pairs = list(compare(hashes, left, right, earlier))
        if pairs:
            x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
            links += np.bincount(x, copies[y], len(key)).astype(np.int64) + np.bincount(y, copies[x], len(key)).astype(np.int64)
            local = np.full(len(key), -1)
            local[some] = np.arange(len(some))
            label[some] = some[forest(len(some), local[x], local[y])]
    return pa.table({"key": key, "links": links, "root": key[label], "whole": group["whole"]})


def class_keys_only(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the sets that end at ``ends``; 0 for empty ones."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    keys = np.zeros(len(ends), U64)
    some = np.flatnonzero(sizes)
    if len(some):
        keys[some] = set_keys(hashes, begins[some], sizes[some])
    return keys


def op4_ngram_join(docs: DataFrame) -> DataFrame:
    return join(docs)
