"""Token counts under a unigram vocabulary: count-only Viterbi over the matches of an automaton.

Pieces and scores come from a piece vocabulary file and are segmented as a unigram model: the
segmentation with the largest sum of scores. No ids and no lattice are kept, only each
position's best score and the number of pieces that reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe import Remembered

SPACE_MARK = "▁"
#: An unknown character scores this much less than the worst piece (a fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts of pieces; ties as in the tokenizer: a later candidate must score strictly more."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        letters = {c for p, _ in pieces for c in p}
        #: No piece has a mark after another character, so text falls apart before each run of marks.
        self.apart = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in pieces)
        self.lines_apart = "\n" not in letters
        self.marked = Remembered(lambda w: self.viterbi(SPACE_MARK + w))
        self.bare = Remembered(self.viterbi)

    def viterbi(self, s: str) -> int:
        """Pieces of the best segmentation; an unknown character counts as its UTF-8 bytes.

        At each end the candidates come by rising start, as the tokenizer meets them; the unknown
        character, which begins last, is a candidate only where no piece of one character ends.
        """
        n = len(s)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, top, pieces, single = 0, None, 0, False

        def close(end: int) -> None:
            if not single and (top is None or best[end - 1] + self.unknown > top):
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))
            else:
                best[end], count[end] = top, pieces

        for last, (length, score) in self.automaton.iter(s):
            while at < last:
                close(at + 1)
                at, top, single = at + 1, None, False
            start = last + 1 - length
            if length == 1:
                single = True
            # Matches at one end come longest first, which is by rising start.
            value = best[start] + score
            if top is None or value > top:
                top, pieces = value, count[start] + 1
        while at < n:
            close(at + 1)
            at, top, single = at + 1, None, False
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of text with the mark for spaces and before the text; 0 for empty text."""
        if not text:
            return 0
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, " ")
        if not (self.apart and self.lines_apart):
            return self.viterbi(SPACE_MARK + text.replace(" ", SPACE_MARK))
        total = 0
        for i, line in enumerate(text.split("\n")):
            total += i > 0  # the line feed, one byte
            if "  " in line or (i == 0 and line[:1] == " ") or line[-1:] == " ":
                line = line.replace(" ", SPACE_MARK) if i else SPACE_MARK + line.replace(" ", SPACE_MARK)
                total += sum(map(self.bare.__getitem__, re.findall(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+", line)))
            else:
                first, *rest = line.split(" ")
                total += self.marked[first] if i == 0 else self.bare[first] if first else 0
                total += sum(map(self.marked.__getitem__, rest))
        return total


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a piece vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


_loaded: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _loaded:
        _loaded[path] = UnigramCounter(read_pieces(path))
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row of df.

    vocab_path is a piece vocabulary that every worker can read. Null and empty texts have 0
    tokens; rows repeated or with null ids are rows like others; an empty table gives no rows.
    """
    common.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocab_path or default_path())
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return common.ensure_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
