"""Token counts of a unigram tokenizer, without the tokens: Aho-Corasick matches and a count-only Viterbi.

The text's spaces become U+2581 and each word starts with one, as in a unigram tokenizer with a metaspace
pre-tokenizer; words are independent, so each distinct word is solved once for a worker. In a word the automaton
enumerates every vocabulary piece at its end position, and the dynamic programme carries for each position the
best score and the number of pieces of the path that has it.

Tie rules, those of the public unigram tokenizers: starts are tried from left to right and a later start replaces
the path to a position only with a strictly higher score, scores being summed from the left in double precision.
A character that is no piece itself may be passed as unknown for the lowest score of the vocabulary less 10; with
byte fallback it counts as its UTF-8 bytes, without it a run of such characters counts as one piece.

Edge cases: null and empty texts have 0 tokens; a word longer than LONG is solved in a window of the longest piece, so
it takes time in proportion to its length and no memory beyond its text; repeated rows and null ids get a row each;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import memo, text_batches

SPACE = "▁"
LONG = 1000
PENALTY = 10.0
SCHEMA = "doc_id long, n_tokens long, n_words long"


def zipf_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with log-probabilities by Zipf's law over their ranks; bytes are left out.

    The box has no unigram model, and tokenizers are not trained here, so the vocabulary's own order gives the scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = float(np.log((1 / np.arange(2, len(pieces) + 2)).sum()))
    return [(p, -float(np.log(i + 2)) - total) for i, p in enumerate(pieces)]


class Counter(dict):
    """word -> number of pieces; emptied when it holds too many words."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, most: int = 1_000_000):
        import ahocorasick

        super().__init__()
        self.automaton, self.byte_fallback, self.most = ahocorasick.Automaton(), byte_fallback, most
        for piece, s in vocabulary:
            self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.longest = max(len(piece) for piece, _ in vocabulary)

    def __missing__(self, word: str) -> int:
        n = self.count(word) if len(word) <= LONG else self.count_long(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        single = bytearray(len(word))
        for end, (length, s) in self.automaton.iter(word):
            ends[end].append((length, s))
            if length == 1:
                single[end] = 1
        best, pieces, open_run = [0.0] + [0.0] * len(word), [0] * (len(word) + 1), [False] * (len(word) + 1)
        for end, found in enumerate(ends):
            top, start, known = None, -1, True
            for length, s in sorted(found, reverse=True):  # the leftmost start first
                if (at := best[end + 1 - length] + s) > (top if top is not None else float("-inf")) or top is None:
                    top, start = at, end + 1 - length
            if not single[end]:
                at = self.unknown + best[end]
                if top is None or at > top:
                    top, start, known = at, end, False
            best[end + 1] = top
            if known:
                pieces[end + 1] = pieces[start] + 1
            elif self.byte_fallback:
                pieces[end + 1] = pieces[start] + len(word[end].encode("utf-8", "surrogatepass"))
            else:
                pieces[end + 1], open_run[end + 1] = pieces[start] + (not open_run[start]), True
        return pieces[-1]

    def count_long(self, word: str) -> int:
        """count() with the state of the last `longest` positions only, in a ring; matches come in order of their ends."""
        size = self.longest + 1
        best, pieces, open_run = [0.0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(word)
        ahead = next(matches, None)
        for end, letter in enumerate(word):
            found, single = [], False
            while ahead is not None and ahead[0] == end:
                found.append(ahead[1])
                single |= ahead[1][0] == 1
                ahead = next(matches, None)
            top, start, known = None, -1, True
            for length, s in sorted(found, reverse=True):  # the leftmost start first
                at = best[(end + 1 - length) % size] + s
                if top is None or at > top:
                    top, start = at, end + 1 - length
            if not single:
                at = self.unknown + best[end % size]
                if top is None or at > top:
                    top, start, known = at, end, False
            here, there = (end + 1) % size, start % size
            n, was_open = pieces[there], open_run[there]
            best[here], open_run[here] = top, False
            if known:
                pieces[here] = n + 1
            elif self.byte_fallback:
                pieces[here] = n + len(letter.encode("utf-8", "surrogatepass"))
            else:
                pieces[here], open_run[here] = n + (not was_open), True
        return pieces[len(word) % size]

    def text(self, text: str) -> tuple[int, int]:
        """(tokens, words) of a whole text."""
        if not text:
            return 0, 0
        words = text.replace(" ", SPACE).split(SPACE)
        if words[0] == "":
            words = words[1:]
        return sum(map(self.__getitem__, [SPACE + w for w in words])), len(words)


def count_tokens(docs: DataFrame, model_file: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens and n_words for every row of docs. One pass without a shuffle; the vocabulary is read on the
    driver and sent with the task, so executors need no file of their own."""
    vocabulary = zipf_vocabulary(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = memo(f"unigram {hash(tuple(vocabulary))} {byte_fallback}", lambda: Counter(vocabulary, byte_fallback))
        for batch in text_batches(batches):
            found = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["doc_id", "n_tokens", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
