"""Token counts without tokens: a count-only Viterbi search over a unigram vocabulary.

The tokenizer is a unigram language model over words: a text is cut at spaces, each word gets the word-start mark, and
the best-scoring cut of the word into vocabulary pieces is its tokenisation.  Only the number of pieces is wanted, so the
search carries two numbers for each character boundary, the best score and the pieces on that path.  An Aho-Corasick
automaton over the vocabulary enumerates every piece that ends at a position in one pass.

The tie rules are those of the public tokenizers library's unigram model (the tests hold counts against it): candidates
for a boundary come in order of their start, a later one replaces an earlier one only with a strictly greater score, a
start without a one-character piece also offers an unknown piece of that character at the lowest score less 10, unknown
pieces in a row are one, and with byte fallback an unknown run costs a token for each of its UTF-8 bytes if the vocabulary
has all of these bytes.

Null and empty texts count 0.  Repeated rows give repeated results; an empty table gives an empty table.  Long texts are
counted whole, word by word; a text without spaces is one word, searched in memory of its length.  Columns other than id and
text are never read.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import rank_path

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct words whose counts a worker remembers, and the most characters of one: some 30 MB in all.  Texts without spaces are
#: words of any length, which seldom come again.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Words from so many characters on are searched over packed arrays, 24 bytes a character instead of some 95.
LONG = 4096


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) by id, read from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=rank_path(path, PIECES))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts the pieces of words under one vocabulary."""

    UNKNOWN_LESS = 10.0

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        names = self.names = {p for p, _ in pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in names} if byte_fallback else set()
        self.unknown = min(s for _, s in pieces) - self.UNKNOWN_LESS
        self.memo: dict[str, int] = {}

    def unknown_tokens(self, run: str) -> int:
        if run in self.names:  # the unknown piece's own name, spelt out
            return 1
        raw = run.encode("utf-8", "surrogatepass")
        return len(raw) if self.bytes and all(b in self.bytes for b in raw) else 1

    def word(self, text: str) -> int:
        """Pieces of one marked word."""
        n = len(text)
        if n < LONG:
            score, count, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        else:
            score, count, run = array("d", [0.0]) * (n + 1), array("q", [0]) * (n + 1), array("q", [-1]) * (n + 1)
        # run: the start of the unknown run that the path ends in, or -1
        at, best, start, unknown, single = 1, None, 0, False, False

        def close() -> None:
            """Settle boundary `at`."""
            nonlocal best, start, unknown
            if not single and (best is None or score[at - 1] + self.unknown > best):
                best, start, unknown = score[at - 1] + self.unknown, at - 1, True
            score[at] = best
            if unknown:
                first = run[at] = run[start] if run[start] >= 0 else start
                count[at] = count[first] + self.unknown_tokens(text[first:at])
            else:
                count[at] = count[start] + 1

        # the automaton gives the pieces that end at one place longest first, so in order of their start
        for end, (size, s, unk) in self.automaton.iter(text):
            while at <= end:
                close()
                at, best, single = at + 1, None, False
            total = score[end + 1 - size] + s
            if best is None or total > best:
                best, start, unknown = total, end + 1 - size, unk
            if size == 1:
                single = True
        while at <= n:
            close()
            at, best, single = at + 1, None, False
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        total, memo = 0, self.memo
        for word in pieces_of(text):
            got = memo.get(word)
            if got is None:
                got = self.word(word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(memo) >= REMEMBERED:
                        memo.clear()
                    memo[word] = got
            total += got
        return total


def pieces_of(text: str) -> list[str]:
    """The marked words of a text: each space becomes the mark, one is put before the text, and every mark starts a word."""
    text = text.replace(" ", MARK)
    if not text.startswith(MARK):
        text = MARK + text
    return [MARK + w for w in text.split(MARK)[1:]]


@functools.lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(df: DataFrame, keep: dict[str, Column], text: str = "text", to: str = "n_tokens", path: str | None = None) -> DataFrame:
    """`keep` and the long column `to`: unigram tokens of each whole text."""

    def run(column):
        c = counter(path)
        return [np.fromiter((c.text(t) for t in column.to_pylist()), np.int64, len(column))]

    return common.map_texts(df, keep, text, run, f"`{to}` long")


def document_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    return count_tokens(documents, {"doc_id": F.col("doc_id")}, "text", "n_tokens", path)
