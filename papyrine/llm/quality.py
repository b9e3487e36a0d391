"""Quality classification by an interpolated modified Kneser-Ney model of byte n-grams.

Method: n-grams (n = 5) of the bytes of trusted texts (UTF-8, lower case, all digits as one, white space as
single blanks) are counted, so that every script is told apart exactly in one alphabet of 256. They are smoothed by modified Kneser-Ney with three discounts an order, and give each document a perplexity;
thresholds are quantiles of the perplexities of trusted documents, language by language, shifted by what
held-out ones score above those that a model has seen: a second model learns without them. Both models
lie in the same tables, told apart by a bit of their n-grams, so they are made and asked in one go.

The model is one table of weights, so that a text's log-probability is the sum of the weights of its
n-grams of all orders: an n-gram seen in training adds log p - log backoff - log p(shorter), and one
that is a context adds the log backoff weight of what follows it. Weights of the ``HEAD`` commonest
5-grams, summed over their suffixes, are broadcast: a table of fixed size. All other 5-grams of a
document are joined with the counts by shuffling, dealt by n-gram, and summed by document. Both ways
give the same numbers; the head only saves shuffling. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm._shared import Scratch, small_batches, stored, table, trimmed
from papyrine.llm._text import MIX_A, U64, slices

ORDER = 5
#: Bits of a symbol: a byte of the text; 0 stands before a text, the last (in no UTF-8 text) after it.
BITS = 8
ALPHABET = 1 << BITS
#: Marks the n-grams of the second model.
SECOND = 1 << 62
#: 5-grams whose weights are broadcast (16 bytes each): a fixed number.
HEAD = 1 << 19
#: Quantile of the trusted perplexities of a language, and what it is multiplied by; chosen on the
#: labelled rows of sf0.1 (README).
QUANTILE, SLACK = 0.97, 1.0
#: One of so many trusted texts is held out.
FOLDS = 4
#: Held-out documents that a language's shift is weighed against the shift of all languages with, and that
#: of all against none: the fewer a language has, the less its own count.
PRIOR = 50
#: Symbols of median perplexity that a text is judged with besides its own, so that a few symbols do not condemn it.
SHRINK = 40
#: Trusted ids up to this number are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 2_000_000
BATCH_CHARS = 1 << 18
#: Distinct n-grams that a worker holds before it passes its counts on.
HOLD = 1_000_000


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of each byte: itself, but for digits, which are one."""
    out = np.arange(256, dtype=U64)
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """5-gram of each place of the texts from the last boundary symbol to the end symbol, the text
    number of each, and whether it predicts (the first of each text is context only)."""
    pad, end = b"\0" * (ORDER - 1), bytes([ALPHABET - 1])
    clean = [pad + " ".join(t.lower().replace("\0", " ").split()).encode("utf-8", "surrogatepass") + end for t in texts]
    symbols = symbol_table()[np.frombuffer(b"".join(clean), np.uint8)]
    codes = symbols.copy()
    for k in range(1, ORDER):
        codes[k:] |= symbols[:-k] << U64(BITS * k)
    lengths = np.array([len(c) for c in clean], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = place >= ORDER - 2
    codes = codes & U64((1 << BITS * ORDER) - 1)
    first = place[use] == ORDER - 2
    codes = codes[use]
    codes[first] = 0
    return codes.astype(np.int64), owner[use], ~first


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c) of all 5-grams of the column ``text``; workers add up before the shuffle."""
    small_batches(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> None:
            nonlocal keys, counts, fresh, waiting
            if fresh:
                own, n = np.unique(np.concatenate(fresh), return_counts=True)
                both, inverse = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), len(both)).astype(np.int64)
                keys, fresh, waiting = both, [], 0

        for batch in batches:
            all_texts = [t or "" for t in batch.column(0).to_pylist()]
            for part in slices(map(len, all_texts), BATCH_CHARS):
                codes, _, predicts = grams(all_texts[part])
                fresh.append(codes[predicts])
                waiting += len(fresh[-1])
                if waiting > 4 * BATCH_CHARS:
                    merge()
                    if len(keys) > HOLD:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])
                        keys, counts = keys[:0], counts[:0]
        merge()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])

    return texts.select("text").mapInArrow(trimmed(counted), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def mark_of() -> Column:
    """The bit of g's model."""
    return F.col("g").bitwiseAND(F.lit(SECOND))


def tail_of(m: int) -> Column:
    """The last m symbols of g, in its model."""
    return F.col("g").bitwiseAND(F.lit((1 << BITS * m) - 1 | SECOND))


def context_of() -> Column:
    """All symbols of g but the last, in its model."""
    return F.shiftright(F.col("g").bitwiseAND(F.lit(SECOND - 1)), BITS).bitwiseOR(mark_of())


def discounts(counts: DataFrame) -> list[Column]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from the numbers of n-grams
    seen once to four times in each model."""
    seen = counts.groupBy(mark_of().alias("model")).agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    by_model = {bool(r["model"]): discounts_of(r["n1"], r["n2"], r["n3"], r["n4"]) for r in seen}
    first, second = (by_model.get(x, (0.5, 0.75, 0.75)) for x in (False, True))
    return [F.when(mark_of() != 0, F.lit(y)).otherwise(F.lit(x)) for x, y in zip(first, second, strict=True)]


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in raw)


def model_weights(grams5: DataFrame, scratch: Scratch) -> tuple[dict[int, DataFrame], dict[bool, float]]:
    """(g, w) for each order 1 to 5, from the counts of 5-grams, and what every symbol has besides in each
    model (second: True)."""
    stored = scratch.stored
    counts = {ORDER: grams5}
    for m in range(ORDER - 1, 0, -1):
        # An n-gram's count below the highest order is the number of different symbols before it.
        counts[m] = stored(counts[m + 1].groupBy(tail_of(m).alias("g")).agg(F.count("*").alias("c")), f"order{m}")
    weights: dict[int, DataFrame] = {}
    shorter: DataFrame | None = None
    backoffs: dict[int, DataFrame] = {}
    seen: dict[int, DataFrame] = {}
    for m in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[m])
        kinds = (("n1", F.col("c") == 1), ("n2", F.col("c") == 2), ("n3", F.col("c") >= 3))
        contexts = counts[m].groupBy(context_of().alias("context")).agg(F.sum("c").alias("total"), *(F.count_if(x).alias(n) for n, x in kinds))
        contexts = contexts.withColumn("g", F.col("context"))  # discounts go by the model of g
        left = (F.col("n1") * d1 + F.col("n2") * d2 + F.col("n3") * d3) / F.col("total")
        contexts = contexts.select("context", "total", left.alias("left"))
        backoffs[m] = contexts.select(F.col("context").alias("g"), F.log("left").alias("w"))
        own = counts[m].withColumn("context", context_of()).join(contexts, "context")
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = own.withColumn("direct", (F.col("c") - discount) / F.col("total"))
        if m == 1:
            own = own.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            own = own.withColumn("suffix", tail_of(m - 1)).join(shorter, "suffix")
        p = F.col("direct") + F.col("left") * F.col("lower")
        own = stored(own.select("g", p.alias("p"), (F.log(p) - F.log("left") - F.log("lower")).alias("w")), f"kn{m}")
        seen[m] = own.select("g", "w")
        shorter = own.select(F.col("g").alias("suffix"), F.col("p").alias("lower"))
    for m in range(1, ORDER + 1):
        both = seen[m] if m == ORDER else seen[m].unionByName(backoffs[m + 1])
        weights[m] = both if m == ORDER else both.groupBy("g").agg(F.sum("w").alias("w"))
    rest = {bool(r["g"]): r["w"] for r in backoffs[1].collect()}
    return weights, {x: rest.get(x, 0.0) - math.log(ALPHABET) for x in (False, True)}


def gram_scores(distinct: DataFrame, weights: dict[int, DataFrame]) -> DataFrame:
    """(g, score) of each distinct 5-gram: the weights of it and all its suffixes, added up order by
    order over the distinct n-grams of each."""
    levels = {ORDER: distinct}
    for m in range(ORDER - 1, 0, -1):
        levels[m] = levels[m + 1].select(tail_of(m).alias("g")).distinct()
    total: DataFrame | None = None
    for m in range(1, ORDER + 1):
        own = levels[m].join(weights[m], "g", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        if total is not None:
            own = own.withColumn("suffix", tail_of(m - 1)).join(total.select(F.col("g").alias("suffix"), "score"), "suffix").withColumn("w", F.col("w") + F.col("score"))
        total = own.select("g", F.col("w").alias("score"))
    return total


def commonest(grams5: DataFrame, most: int) -> DataFrame:
    """(g) of the n-grams of largest counts, ``most`` at most: those from some count on. The count is found
    in a small histogram, in which counts beyond 4095 are told apart by their first twelve bits."""
    low = F.greatest(F.floor(F.log2("c")).cast("int") - 11, F.lit(0))
    rounded = F.floor(F.col("c") / F.pow(F.lit(2.0), low)).cast("long") * F.pow(F.lit(2.0), low).cast("long")
    sizes = sorted(((r["at"], r["n"]) for r in grams5.groupBy(rounded.alias("at")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        if total + n > most:
            break
        least, total = at, total + n
    return grams5.filter(F.lit(False) if least is None else rounded >= least).select("g")


class HeadTable:
    """Scores of the head by hashing with two places a key; keys that find neither free are left to
    the join."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.scores = np.zeros(1 << self.bits, np.float64)
        rest = np.arange(len(keys))
        for turn in (0, 1):
            at = self.place(keys[rest], turn)
            free = self.keys[at] == -1
            rest_free, at_free = rest[free], at[free]
            first = np.unique(at_free, return_index=True)[1]
            self.keys[at_free[first]] = keys[rest_free[first]]
            self.scores[at_free[first]] = scores[rest_free[first]]
            taken = np.zeros(len(rest), bool)
            taken[np.flatnonzero(free)[first]] = True
            rest = rest[~taken]

    def place(self, keys: np.ndarray, turn: int) -> np.ndarray:
        h = (keys.astype(U64) + U64(turn)) * MIX_A
        return ((h ^ (h >> U64(29))) * MIX_A >> U64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 where not in the head) and whether each key is in the head."""
        at = self.place(keys, 0)
        hit = self.keys[at] == keys
        other = np.flatnonzero(~hit)
        at[other] = self.place(keys[other], 1)
        hit[other] = self.keys[at[other]] == keys[other]
        return np.where(hit, self.scores[at], 0.0), hit


def score(docs: DataFrame, grams5: DataFrame, *, head: int = HEAD, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs`` plus n_symbols, log_prob and perplexity (per symbol, the end of the text
    counted). Null text counts as empty. Columns already so named are replaced. Rows whose column _second is
    true are scored by the second model. What is computed on the way is kept in ``scratch``, and is needed
    until the result has been."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    weights, each = model_weights(grams5, scratch)
    weights = {m: scratch.stored(w, f"weights{m}") if m < ORDER else w for m, w in weights.items()}
    top = gram_scores(commonest(grams5, head), weights).toArrow()
    known = spark.sparkContext.broadcast((top["g"].to_numpy(), top["score"].to_numpy()))
    docs = docs.drop("n_symbols", "log_prob", "perplexity")
    docs = docs if "_second" in docs.columns else docs.withColumn("_second", F.lit(False))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    place, marked = names.index("text"), names.index("_second")
    keep = [i for i in range(len(names)) if i != place]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = HeadTable(*known.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            marks = batch.column(marked).to_numpy(zero_copy_only=False).astype(np.int64) << 62
            parts: list[tuple] = []
            for part in slices(map(len, texts), BATCH_CHARS):
                codes, owner, predicts = grams(texts[part])
                codes = codes | marks[part][owner]
                n = part.stop - part.start
                found, hit = lookup.look_up(codes)
                rest_owner, rest = owner[~hit], codes[~hit]
                order = np.lexsort((rest, rest_owner))
                rest_owner, rest = rest_owner[order], rest[order]
                new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1])])) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(rest)]]))
                parts.append((np.bincount(owner, predicts, n).astype(np.int64), np.bincount(owner, found, n), np.bincount(rest_owner[new], minlength=n), rest[new], times))
            n_symbols, found, sizes, rest, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch.column(i) for i in keep] + [pa.array(n_symbols), pa.array(found), pa.ListArray.from_arrays(offsets, pa.array(rest)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, [*(names[i] for i in keep), "n_symbols", "_head", "_rest", "_times"])

    rows = docs.mapInArrow(trimmed(scored), f"{fields}, n_symbols long, _head double, _rest array<long>, _times array<int>").withColumn("_row", F.monotonically_increasing_id())
    rows = scratch.stored(rows, "scored")
    known.destroy()
    rest = rows.select("_row", F.explode(F.arrays_zip(F.col("_rest").alias("g"), F.col("_times").alias("n"))).alias("x")).select("_row", "x.g", "x.n")
    scores = gram_scores(rest.select("g").distinct(), weights)
    sums = rest.join(scores, "g").groupBy("_row").agg(F.sum(F.col("n") * F.col("score")).alias("_tail"))
    besides = F.when(F.col("_second"), F.lit(each[True])).otherwise(F.lit(each[False]))
    log_prob = F.col("_head") + F.coalesce("_tail", F.lit(0.0)) + F.col("n_symbols") * besides
    out = rows.drop("_rest", "_times").join(sums, "_row", "left").withColumn("log_prob", log_prob)
    return out.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_symbols"))).drop("_row", "_head", "_tail")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and not toxic, and never otherwise."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, slack: float = SLACK, head: int = HEAD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, log_prob, perplexity, judged, threshold, keep,
    and the columns in ``carry``.

    The model learns from every document whose id ``labels`` trusts. ``judged`` is the perplexity with
    some symbols of median perplexity added; a document is kept if it is at most its language's
    threshold. A threshold is the quantile of the language's trusted texts, raised by what held-out ones
    (told by their hashes, so copies go together) score above it in a model of the others; the fewer of
    them a language has, the more the rise is that of all languages, and of a language without trusted
    texts the threshold is that of all. Null languages form one language. With no trusted document every
    document is kept (threshold null). Null text counts as empty. A null doc_id is never trusted. Repeated
    rows are scored each for itself. An empty table gives an empty one. Columns besides these and those in
    ``carry`` are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    trusted = scratch.stored(trusted_ids(labels), "trusted")
    few = trusted.count() <= BROADCAST_IDS
    ids = F.broadcast(trusted) if few else trusted
    docs = docs.select("doc_id", "lang", "text", *carry)
    known = docs.join(ids, "doc_id", "left_semi").select("lang", "text")
    held = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)) == 0
    learnt = scratch.stored(count_grams(known.filter(~held)), "learnt5")
    whole = learnt.unionByName(count_grams(known.filter(held))).groupBy("g").agg(F.sum("c").alias("c"))
    second = learnt.select(F.col("g").bitwiseOR(F.lit(SECOND)).alias("g"), "c")
    grams5 = scratch.stored(whole.unionByName(second), "grams5")
    asked = known.filter(held).select("lang", "text", F.lit(True).alias("_second"))
    asked = docs.withColumn("_second", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    scored = stored(score(asked, grams5, head=head, scratch=scratch), "perplexity")
    rows, unseen = scored.filter(~F.col("_second")), scored.filter("_second")
    seen = rows.join(ids, "doc_id", "left_semi")
    # Judged by perplexity drawn towards the median: a short text's own says little.
    half = seen.agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("m")).first()["m"]
    judged = (-F.col("log_prob") + SHRINK * F.log(F.lit(half).cast("double"))) / (F.col("n_symbols") + SHRINK)
    levels, overall = thresholds(seen.withColumn("judged", judged), unseen.withColumn("judged", judged), quantile)
    levels = stored(levels, "levels")
    threshold = F.exp(F.coalesce("level", F.lit(overall).cast("double"))) * slack
    few = levels.count() < 10_000
    out = rows.withColumn("judged", F.exp(judged)).withColumn("_lang", F.coalesce("lang", F.lit("")))
    out = out.join(F.broadcast(levels) if few else levels, "_lang", "left").withColumn("threshold", threshold)
    keep = F.coalesce(F.col("judged") <= F.col("threshold"), F.col("threshold").isNull())
    scratch.drop()
    return out.select("doc_id", "lang", "n_symbols", "log_prob", "perplexity", "judged", "threshold", keep.alias("keep"), *carry)


def thresholds(seen: DataFrame, unseen: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(_lang, level) of each language of the trusted texts, and the level of all (None without any), as
    logarithms: the quantile of ``judged`` in ``seen`` plus the shift of ``unseen``, never downwards."""
    lang, level = F.coalesce("lang", F.lit("")).alias("_lang"), F.percentile_approx("judged", quantile, 10_000)
    seen_all, unseen_all = seen.agg(level.alias("q")).first()["q"], unseen.agg(level.alias("q"), F.count("*").alias("n")).first()
    if seen_all is None:
        return seen.select(lang, F.col("judged").alias("level")).limit(0), None
    n = unseen_all["n"]
    shift = max(0.0, n * (unseen_all["q"] - seen_all) / (n + PRIOR)) if n else 0.0
    own = seen.groupBy(lang).agg(level.alias("q")).join(unseen.groupBy(lang).agg(level.alias("out"), F.count("*").alias("n")), "_lang", "left")
    moved = (F.coalesce(F.col("n") * (F.col("out") - F.col("q")), F.lit(0.0)) + PRIOR * shift) / (F.coalesce("n", F.lit(0)) + PRIOR)
    return own.select("_lang", (F.col("q") + F.greatest(moved, F.lit(0.0))).alias("level")), seen_all + shift


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)


def query(spark, sf_dir: str) -> DataFrame:
    return op6_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
