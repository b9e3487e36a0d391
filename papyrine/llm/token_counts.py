"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

Method: an Aho-Corasick automaton enumerates the vocabulary pieces in a text; dynamic programming
over their ends carries only the best score and its number of pieces. Among segmentations with the
same score the tokenizer's own rule decides: at each position the earliest start found first wins
and only a strictly better score replaces it. A character in no piece costs ten less than the worst
piece and counts as its UTF-8 bytes (byte fallback).

No piece holds a blank after another character, so a text is cut before each run of blanks and around
line breaks, and each worker remembers the result of short parts. Texts of any length are read whole; a text
without blanks is one part, for which some 200 bytes a character are held.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrine.llm._shared import small_batches

BLANK = "▁"
#: How far an unknown character lies below the worst piece.
UNKNOWN_PENALTY = 10.0
MEMO = 400_000


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, tuple[int, float]], list[int]]:
    """Pieces with id and score, and the ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
        elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
            pieces[piece] = (i, float(model.get_score(i)))
    return pieces, by_byte


_PARTS = re.compile(f"{BLANK}*[^{BLANK}\n\0]+|{BLANK}+|\n|\0")
#: Marks that may end a word; those that no piece joins to a letter before them cut a text there.
MARKS = ",.;:!?"


def parts(text: str, cut: re.Pattern | None = None) -> list[str]:
    """The independent parts of a text whose blanks are marked: runs of blanks with what follows, and
    line breaks, in order; ``cut`` (see word_ends) gives further places."""
    if cut is None or "\0" in text:
        return _PARTS.findall(text)
    return [x for x in _PARTS.findall(cut.sub("\0\\g<0>", text)) if x != "\0"]


def splits(pieces: dict) -> bool:
    """Whether no piece crosses the places where parts() cuts."""
    return not any(BLANK in p.lstrip(BLANK) or "\n" in p or "\0" in p for p in pieces)


def word_ends(pieces: dict) -> re.Pattern | None:
    """Marks after a letter that no piece joins to it."""
    joined = {p[i] for p in pieces for i in range(1, len(p)) if p[i] in MARKS and p[i - 1].isalpha()}
    free = "".join(c for c in MARKS if c not in joined)
    return re.compile(f"[{re.escape(free)}](?<=[^\\W\\d_].)") if free else None


class UnigramCounter:
    """Piece count and score of the best segmentation."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(score for _, score in pieces.values()) - UNKNOWN_PENALTY
        self.cuts = splits(pieces)
        self.line = self.viterbi("\n")
        count = self.viterbi

        class Memo(dict):
            def __init__(self, lead: str):
                super().__init__()
                self.lead = lead

            def __missing__(self, word: str) -> tuple[int, float]:
                if len(self) > MEMO:
                    self.clear()
                found = count(self.lead + word)
                if len(word) < 64:
                    self[word] = found
                return found

        self.led, self.bare = Memo(BLANK), Memo("")

    def viterbi(self, text: str) -> tuple[int, float]:
        n, low = len(text), -np.inf
        best, counts, done = [low] * (n + 1), [0] * (n + 1), 0
        best[0] = 0.0
        single, unknown = self.single, self.unknown
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):
            by_end[last + 1].append(match)  # longest first, which is earliest start first
        for end in range(1, n + 1):
            top, pieces = low, 0
            for length, score in by_end[end]:
                if best[end - length] + score > top:
                    top, pieces = best[end - length] + score, counts[end - length] + 1
            c = text[end - 1]
            if c not in single and best[end - 1] + unknown > top:
                top, pieces = best[end - 1] + unknown, counts[end - 1] + len(c.encode("utf-8", "surrogatepass"))
            best[end], counts[end] = top, pieces
            done = end
        return counts[done], best[done]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(BLANK, " ")
        if not self.cuts:
            return self.viterbi(BLANK + text.replace(" ", BLANK))
        if "  " in text or text[0] == " " or " \n" in text or text[-1] == " ":
            found = list(map(self.bare.__getitem__, parts(BLANK + text.replace(" ", BLANK))))
            return sum([x[0] for x in found]), sum([x[1] for x in found])
        total, score, first = 0, 0.0, True
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if not first:
                total, score = total + self.line[0], score + self.line[1]
            if first or head:
                n, s = (self.led if first else self.bare)[head]
                total, score = total + n, score + s
            first = False
            if rest:
                found = list(map(self.led.__getitem__, rest))
                total += sum([x[0] for x in found])
                score += sum([x[1] for x in found])
        return total, score


def count_tokens(docs: DataFrame, *, model_path: str) -> DataFrame:
    """doc_id, n_tokens and best_score (sum of piece scores) of every whole text.

    Blanks count as in the model's normaliser: one is put before the text. Null and empty texts have
    0 tokens and score 0. One output row per input row, repeated ids and null ids included; an empty table
    gives an empty one. Only doc_id and text are read, so names of other columns cannot clash.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary(model_path)[0])
        for batch in batches:
            found = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "best_score"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_tokens long, best_score double")


def op2_token_counts(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, model_path=public_tokenizers.path("piece_bpe_32k.model"))
