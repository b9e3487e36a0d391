"""SentencePiece encoding and decoding with several distinct sampled segmentations.

Method: Gumbel top-k without replacement by a perturbed A-star search over the segmentation lattice.
A lattice state is a place in a word; a step takes one piece. Exact backward sums give each step's
probability, so a text is a tree of independent-by-word decisions. A node's key is the largest
perturbed log-probability of any segmentation below it. Following the winner from the root gives the
first segmentation; at every step the pieces not taken form one sibling node, whose key is a Gumbel
draw of the siblings' mass truncated at its parent's key. Popping the largest key and following it
down gives the next segmentation, all distinct, in the order of their perturbed log-probabilities.
The (k+1)-th key is the threshold of the inclusion scores. Only the k largest sibling keys can still
be popped, so no more are kept: the search stays exact. Masses are kept as logarithms, summed over the
pieces not taken, so a sibling node is missing only where no piece is left.

Long texts: a text is cut into words where no piece crosses, and words are learnt once; a text without
blanks is one word, whose lattice grows with its length times the longest piece.

Draws are seeded by the row's key and text, so they do not depend on partitions or repeated tasks.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrine.llm._shared import small_batches
from papyrine.llm._text import PRIME, mix, slices
from papyrine.llm.token_counts import BLANK, UNKNOWN_PENALTY, parts, splits, vocabulary, word_ends

#: Segmentations of each text, and the factor on piece scores (the smaller, the more even).
SAMPLES, ALPHA = 3, 0.001
#: Lattice edges that a worker remembers; beyond, it forgets the newer half of its words.
MEMO_EDGES = 7_500_000
BATCH_CHARS = 200_000
#: Chance of an edge beyond which the others are added up by themselves.
MOST = 0.9
#: Edge numbers from here on stand for unknown characters: this plus the code point.
UNKNOWN_EDGE = 1 << 24

SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>"


class Lattices:
    """Lattices of words in one pool: states, and edges sorted by state with their chances' logarithms."""

    def __init__(self, model_path: str, alpha: float):
        import ahocorasick

        self.pieces, self.by_byte = vocabulary(model_path)
        self.alpha = alpha
        self.cuts, self.ends = splits(self.pieces), word_ends(self.pieces)
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        # Pieces are told by rank, the best first; one more rank stands for unknown characters. Pieces
        # of one character are looked up in an array, the others found by the automaton.
        ranked = sorted(self.pieces.items(), key=lambda x: (-x[1][1], x[1][0]))
        self.rank_bits = max(len(ranked).bit_length(), 1)
        self.piece_of = np.array([i for _, (i, _) in ranked] + [0])
        self.lengths = np.array([len(p) for p, _ in ranked] + [1])
        self.scores = alpha * np.array([score for _, (_, score) in ranked] + [self.unknown])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = np.full(0x110000, len(ranked), np.int64)
        for rank, (piece, _) in enumerate(ranked):
            if len(piece) == 1:
                self.single[ord(piece)] = rank
            else:
                self.automaton.add_word(piece, rank)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.text_of = {i: p.encode() for p, (i, _) in self.pieces.items()}
        self.text_of |= {i: bytes([b]) for b, i in enumerate(self.by_byte)}
        content = [self.text_of.get(i, b"") for i in range(1 + max(self.text_of))]
        self.pool = np.frombuffer(b"".join(content).replace(BLANK.encode(), b" "), np.uint8)
        self.pool_sizes = np.array([len(c.replace(BLANK.encode(), b" ")) for c in content])
        self.pool_begins = np.cumsum(self.pool_sizes) - self.pool_sizes
        self.forget()

    #: Arrays of edges: the state after it (-1 at a word's end), the logarithms of its chance and of that
    #: of all others at its state, the chance of it and those before it at its state, its piece, and the
    #: state that it leaves.
    EDGES = (("ends_at", np.int32), ("log_chance", np.float64), ("log_others", np.float64), ("upto", np.float64), ("piece", np.int32), ("state", np.int32))

    def forget_newer(self) -> None:
        """Drops the words learnt last, down to half of the edges: the words met first are common ones."""
        kept = 0
        for _, edges, states in self.learnt:
            if edges > MEMO_EDGES // 2:
                break
            kept, self.edges, self.states = kept + 1, edges, states
        if not kept:
            return self.forget()
        del self.learnt[kept:]
        for _ in range(len(self.known) - self.learnt[-1][0]):
            self.known.popitem()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.learnt: list[tuple[int, int, int]] = []  # words, edges and states after each learn()
        self.edges = self.states = 0
        for name, kind in self.EDGES:
            setattr(self, name, np.empty(1 << 16, kind))
        self.first_edge = np.zeros(1 << 16, np.int32)  # of each state

    def room(self, edges: int, states: int) -> None:
        """Makes room by doubling, so that the pool is seldom copied."""
        wanted = [(name, self.edges, edges) for name, _ in self.EDGES] + [("first_edge", self.states + 1, states + 1)]
        for name, used, more in wanted:
            old = getattr(self, name)
            if used + more > len(old):
                new = np.empty(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def learn(self, words: list[str]) -> None:
        """Adds words that the pool does not have: one pass of the automaton over all of them, then
        backward sums by the number of characters left."""
        sizes = np.array([len(w) for w in words])
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = "\0".join(words) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined)) if len(self.automaton) else (), np.int64).reshape(-1, 2)
        inner = np.ones(len(cps), bool)
        inner[base[1:] - 1] = False
        inner = np.flatnonzero(inner)
        # Edges as numbers of place and rank, sorted: good pieces first, for short look-ups.
        bits = self.rank_bits
        edges = np.concatenate([((hits[:, 0] + 1 - self.lengths[hits[:, 1]]) << bits) | hits[:, 1], (inner << bits) | self.single[cps[inner]]])
        edges.sort()
        start, rank = edges >> bits, edges & ((1 << bits) - 1)
        after, score, piece = start + self.lengths[rank], self.scores[rank], self.piece_of[rank]
        odd = np.flatnonzero(rank == len(self.scores) - 1)
        strange = cps[start[odd]]
        piece[odd] = np.where(strange < 128, np.array(self.by_byte)[np.minimum(strange, 127)], UNKNOWN_EDGE + strange.astype(np.int64))
        total = int(base[-1])
        firsts = np.searchsorted(start, np.arange(total + 1))
        beta = np.full(total, -np.inf)
        ends = base[1:] - 1
        beta[ends] = 0.0
        left = np.repeat(ends, sizes + 1) - np.arange(total)  # characters after each state
        remaining = left[start].astype(np.uint16 if sizes.max() < 1 << 16 else np.int64)
        by_left = np.argsort(remaining, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(remaining))])[1:]
        for step in range(len(bounds) - 1):
            own = by_left[bounds[step] : bounds[step + 1]]
            if len(own):
                value, place = score[own] + beta[after[own]], start[own]
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                top = np.maximum.reduceat(value, new)
                spread = np.repeat(top, np.diff(np.concatenate([new, [len(own)]])))
                beta[place[new]] = top + np.log(np.add.reduceat(np.exp(value - spread), new))
        log_chance = score + beta[after] - beta[start]
        degree = np.diff(firsts)
        upto = np.exp(log_chance)
        log_others = others(log_chance, upto, firsts, start)
        # Sums edge by edge of all states at once, so that they do not depend on the other words.
        for rank in range(1, int(degree.max(initial=0))):
            own = firsts[:-1][degree > rank] + rank
            upto[own] += upto[own - 1]
        last = firsts[1:][degree > 0] - 1
        whole = np.repeat(upto[last], degree[degree > 0])
        offset = self.states
        upto /= whole
        upto[last] = 2.0
        after = np.where(left[after] == 0, -1, offset + after)
        self.room(len(start), total)
        new = slice(self.edges, self.edges + len(start))
        for name, values in (("ends_at", after), ("log_chance", log_chance), ("log_others", log_others), ("upto", upto), ("piece", piece), ("state", offset + start)):
            getattr(self, name)[new] = values
        self.first_edge[offset : offset + total + 1] = self.edges + firsts
        self.edges, self.states = new.stop, offset + total
        self.known.update(zip(words, (offset + base[:-1]).tolist(), strict=True))
        self.learnt.append((len(self.known), self.edges, self.states))

    def words(self, text: str) -> list[str]:
        """A text's independent parts."""
        if not (self.cuts and text) or "  " in text or text[0] == " " or BLANK in text or "\0" in text:
            marked = BLANK + text.replace(" ", BLANK) if text else ""
            return parts(marked, self.ends) if self.cuts else [marked][: len(marked)]
        marked = (BLANK + text).replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")
        if self.ends:
            marked = self.ends.sub("\0\\g<0>", marked)
        return [x for x in marked.split("\0") if x]

    def begin(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The first states of the words of each text; unknown words are learnt."""
        words = list(itertools.chain.from_iterable(texts))
        states = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(states < 0).tolist()
        if missing:
            fresh = [words[i] for i in missing]
            self.learn(list(dict.fromkeys(fresh)))
            states[missing] = [self.known[w] for w in fresh]
        return np.split(states, np.cumsum([len(t) for t in texts])[:-1])

    def pick(self, states: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each uniform number picks at each state."""
        edge = self.first_edge[states]
        open_ = np.flatnonzero(self.upto[edge] < u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.upto[edge[open_]] < u[open_]]
        return edge

    def left_at(self, state: int, without: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The edges of a state but for some, and the logarithms of their chances."""
        low, high = int(self.first_edge[state]), int(self.first_edge[state + 1])
        there = np.ones(high - low, bool)
        for edge in without:
            there[edge - low] = False
        edges = np.flatnonzero(there)
        return edges + low, self.log_chance[low:high][edges]

    def follow(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each state to its word's end, seeded by each state's own key: the edges
        in path order, and where each state's path begins (one entry more than states)."""
        steps, now, who = [], states, np.arange(len(states))
        length = np.zeros(len(states), np.int64)
        while len(now):
            keys = keys + PRIME
            edge = self.pick(now, uniform(keys))
            steps.append((edge, who))
            length[who] += 1
            after = self.ends_at[edge]
            going = np.flatnonzero(after >= 0)
            now, who, keys = after[going], who[going], keys[going]
        begins = np.concatenate([[0], np.cumsum(length)])
        edges = np.zeros(begins[-1], np.int64)
        for step, (edge, who) in enumerate(steps):
            edges[begins[who] + step] = edge
        return edges, begins

    def ids(self, edges: np.ndarray) -> np.ndarray:
        pieces = self.piece[edges]
        if len(pieces) and pieces.max() >= UNKNOWN_EDGE:
            parts, last = [], 0
            for at in np.flatnonzero(pieces >= UNKNOWN_EDGE).tolist():
                parts += [pieces[last:at], np.array([self.by_byte[b] for b in chr(pieces[at] - UNKNOWN_EDGE).encode("utf-8", "surrogatepass")])]
                last = at + 1
            return np.concatenate([*parts, pieces[last:]])
        return pieces

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: pieces in a row, byte pieces as bytes, blanks restored, the first dropped."""
        ids = np.asarray(ids, np.int64)
        sizes = self.pool_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.pool_begins[ids] - ends + sizes, sizes) + np.arange(total)
        text = self.pool[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def others(log_chance: np.ndarray, chance: np.ndarray, firsts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each edge the logarithm of the chances of all other edges of its state, added up; -inf where
    there is none. ``start`` is the state of each edge, ``firsts`` the first edge of each state."""
    # One less its own chance is exact enough but for an edge that takes most of the chance: there the
    # others are added up themselves.
    out = np.log1p(-np.minimum(chance, MOST))
    heavy = np.flatnonzero(chance > MOST)
    begin, sizes = firsts[start[heavy]], firsts[start[heavy] + 1] - firsts[start[heavy]]
    out[heavy[sizes == 1]] = -np.inf
    heavy, begin, sizes = heavy[sizes > 1], begin[sizes > 1], sizes[sizes > 1]
    if not len(heavy):
        return out
    bounds = np.cumsum(sizes) - sizes
    edge = np.arange(sizes.sum()) + np.repeat(begin - bounds, sizes)
    rest = log_chance[edge]
    rest[edge == np.repeat(heavy, sizes)] = -np.inf
    top = np.maximum.reduceat(rest, bounds)
    out[heavy] = top + np.log(np.add.reduceat(np.exp(rest - np.repeat(top, sizes)), bounds))
    return out


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample(lattices: Lattices, texts: list[np.ndarray], k: int, seeds: np.ndarray) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text, given as the first states of its words: up to k distinct paths as (edges,
    log-probability, perturbed log-probability), largest perturbed first, and the key that would have
    come next (-inf if no path is left). The searches of all texts advance in step, one path a round."""
    heaps: list[list] = []
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    seeds = mix(seeds.astype(np.uint64))
    for root, states in zip(-np.log(-np.log(uniform(seeds + np.uint64(1)))), texts, strict=True):
        # key, order of arrival, edges before, their log-probability, word number, state, edges that are taken there
        heaps.append([(-float(root), 0, np.zeros(0, np.int32), 0.0, 0, int(states[0]), ())] if len(states) else [])
    for i, states in enumerate(texts):
        if not len(states):
            found[i].append((np.zeros(0, np.int64), 0.0, 0.0))
    for turn in range(k):
        active = [i for i, h in enumerate(heaps) if h]
        if not active:
            break
        popped = [heapq.heappop(heaps[i]) for i in active]
        seed = mix(seeds[active] + np.uint64(turn + 2))
        draws = uniform(seed)
        starts, heads = [], []
        for node, i, u in zip(popped, active, draws, strict=True):
            word, state, without = node[4:]
            if without:
                open_, logs = lattices.left_at(state, without)
                chances = np.cumsum(np.exp(logs - logs.max()))
                edge = int(open_[min(int(np.searchsorted(chances, u * chances[-1], "right")), len(open_) - 1)])
                after = int(lattices.ends_at[edge])
                heads.append(np.array([edge]))
                starts.append(texts[i][word + 1 :] if after < 0 else np.concatenate([[after], texts[i][word + 1 :]]))
            else:
                heads.append(np.zeros(0, np.int64))
                starts.append(texts[i][word:])
        sizes = np.array([len(x) for x in starts])
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        more, begins = lattices.follow(np.concatenate(starts).astype(np.int64), np.repeat(seed, sizes) + mix((place.astype(np.uint64) + np.uint64(1)) << np.uint64(20)))
        cuts = begins[np.concatenate([[0], np.cumsum(sizes)])]
        # Each search's step from its own node comes before the steps that were followed from there.
        lead = np.array([len(h) for h in heads])
        spots = np.repeat(cuts[:-1], lead)
        edges = np.insert(more, spots, np.concatenate(heads)) if lead.any() else more
        bounds = cuts + np.concatenate([[0], np.cumsum(lead)])
        lengths = np.diff(bounds)
        logs, left = lattices.log_chance[edges], lattices.log_others[edges]
        for j in np.flatnonzero(lead):
            gone = (*popped[j][6], int(edges[bounds[j]]))
            rest = lattices.left_at(popped[j][5], gone)[1]
            left[bounds[j]] = rest.max() + np.log(np.exp(rest - rest.max()).sum()) if len(rest) else -np.inf
        before_step, totals = np.zeros(len(edges)), np.zeros(len(popped))
        for j, node in enumerate(popped):
            ahead = node[3] + np.concatenate([[0.0], np.cumsum(logs[bounds[j] : bounds[j + 1]])])
            before_step[bounds[j] : bounds[j + 1]], totals[j] = ahead[:-1], ahead[-1]
        step = mix(np.arange(lengths.max(), dtype=np.uint64))[np.arange(len(edges)) - np.repeat(bounds[:-1], lengths)]
        noise = -np.log(uniform(np.repeat(seed, lengths) ^ step))
        # A Gumbel draw at the location, given that it is at most the node's key; -inf stays so.
        location = before_step + left
        keys = location - np.log(np.exp(location + np.repeat([node[0] for node in popped], lengths)) + noise)
        word_base = np.cumsum(sizes) - sizes
        for j, (node, i) in enumerate(zip(popped, active, strict=True)):
            key, _, before, _, word, _, without = node
            lo, hi = bounds[j], bounds[j + 1]
            path = np.concatenate([before, edges[lo:hi]])
            found[i].append((path, float(totals[j]), -key))
            room, own = k + 1 - len(found[i]), keys[lo:hi]
            if room == 1:  # no more is drawn: only the key that would have come next counts
                heapq.heappush(heaps[i], (-float(own.max()), 0))
                continue
            best = np.argpartition(-own, room - 1)[:room] if room < len(own) else np.arange(len(own))
            first_word = word + int(lead[j] and sizes[j] < len(texts[i]) - word)
            for at in best.tolist():
                if own[at] > -np.inf:
                    e = int(edges[lo + at])
                    extra = at - int(lead[j])
                    at_word = word if extra < 0 else first_word + int(np.searchsorted(begins, cuts[j] + extra, "right") - 1 - word_base[j])
                    heapq.heappush(heaps[i], (-float(own[at]), turn * 1_000_000 + at, path[: len(before) + at], float(before_step[lo + at]), at_word, int(lattices.state[e]), (*(without if at == 0 else ()), e)))
    return [(f, -h[0][0] if h else -np.inf) for f, h in zip(found, heaps, strict=True)]


@functools.lru_cache(maxsize=1)
def lattices_of(model_path: str, alpha: float) -> Lattices:
    """A worker's lattices, kept for its next task."""
    return Lattices(model_path, alpha)


def row_seed(doc_id: int | None, text: str, seed: int) -> int:
    return ((doc_id or 0) * 0x9E3779B97F4A7C15 + (zlib.crc32(text.encode("utf-8", "surrogatepass")) << 16) + seed) & (1 << 64) - 1


def encode_samples(docs: DataFrame, *, model_path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 11, digest: bool = False) -> DataFrame:
    """Up to k distinct segmentations of every whole text, likeliest perturbed first.

    Returns doc_id, sample (from 1), n_pieces, log_prob (exact), perturbed, inclusion (chance that the
    segmentation's key passes the threshold, 1 if no other segmentation is left) and ids; with
    ``digest`` ids_crc32 (unsigned, little-endian 32-bit ids) and round_trip (decoding gives the text)
    instead of ids. Null and empty texts have one empty segmentation of log-probability 0. A text
    with fewer than k segmentations gives as many as it has. Repeated rows give equal samples, a null
    doc_id draws like 0. Other columns are not looked at, so their names cannot clash. An empty table
    gives an empty one.
    """
    small_batches(docs.sparkSession)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path, alpha)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(map(len, texts), BATCH_CHARS):
                if lattices.edges > MEMO_EDGES:
                    lattices.forget_newer()
                states = lattices.begin([lattices.words(t) for t in texts[part]])
                columns: list[list] = [[] for _ in range(8)]
                seeds = np.array([row_seed(i, t, seed) for i, t in zip(ids[part], texts[part], strict=True)], np.uint64)
                for doc_id, text, (found, threshold) in zip(ids[part], texts[part], sample(lattices, states, k, seeds), strict=True):
                    for number, (edges, log_prob, key) in enumerate(found):
                        own = lattices.ids(edges)
                        chance = float(-np.expm1(-np.exp(min(log_prob - threshold, 700.0))))
                        row = [doc_id, number + 1, len(own), log_prob, key, chance]
                        row += [zlib.crc32(own.astype("<u4").tobytes()), lattices.decode(own) == text.replace(BLANK, " ")] if digest else [own.astype(np.int32), None]
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *([pa.int64(), pa.bool_()] if digest else [pa.list_(pa.int32())])]
                names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", *(["ids_crc32", "round_trip"] if digest else ["ids"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return docs.select("doc_id", "text").mapInArrow(sampled, SCHEMA.replace("ids array<int>", "ids_crc32 long, round_trip boolean") if digest else SCHEMA)


def decode_ids(df: DataFrame, *, model_path: str) -> DataFrame:
    """All columns plus ``decoded``: the text of the column ``ids`` (null: null)."""
    place = df.columns.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(model_path, ALPHA)
        for batch in batches:
            texts = [None if ids is None else lattices.decode(ids) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = df.schema
    return df.mapInArrow(decoded, type(schema)(list(schema.fields)).add("decoded", "string"))


def op3_segmentation_samples(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_samples(docs, model_path=public_tokenizers.path("piece_bpe_32k.model"), digest=True)
