"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is one last token with which the word's BPE encoding can end
there. The automaton names the tokens that end at a position; the one that the pair test lets
follow the last token of the prefix before it is stored. Back-pointers from the word's end give
the ids, without running merges on the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

# The vocabulary's word pattern (after NFC and lower case) and its mark of a word's end.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"
#: White space that separates the pieces which are encoded on their own and remembered.
GAP = re.compile(r"[ \t\n\r]+")
#: A last character of a word is another symbol than the same character inside it.
LAST = 0x10000
#: Pieces and pair tests remembered in a worker: two generations of this many, some 200 bytes each.
REMEMBER = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


#: Rows of a result that a worker puts together at a time.
ROWS = 256
#: A pair of tokens as one number: the right one has this many bits.
PAIR = 24


class Remembered(dict):
    """make(key), remembered; the older half is forgotten when limit is reached."""

    def __init__(self, make, limit: int = REMEMBER):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = None  # goes before the copy is made: two generations at any time, not three
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """A word-end BPE vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        # Tokens by the order in which merges make them; those that no merge makes come first.
        order = {t: i for i, t in enumerate(base)}
        for a, b in merges:
            order.setdefault(a + b, len(order))
        self.n_base, self.id_of = len(base), [b""] * len(order)
        for t, i in order.items():
            self.id_of[i] = vocab[t].to_bytes(4, "little")
        self.halves: list[tuple[int, int]] = [(0, 0)] * len(order)
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            m = order[a + b]
            self.pairs.setdefault((order[a], order[b]), m)
            self.halves[m] = (order[a], order[b])
        self.fits = Remembered(lambda p: self._fits(p >> PAIR, p & (1 << PAIR) - 1))
        self.words = Remembered(self._word, REMEMBER // 4)
        self.pieces = Remembered(self._piece)
        self.automaton = ahocorasick.Automaton()
        self.length = [0] * len(order)
        for t, i in sorted(order.items(), key=lambda x: x[1]):
            s = self._symbols(t)
            self.length[i] = len(s)
            # A token that its own string isn't encoded to can't occur.
            if i < self.n_base or self._whole(i):
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def _symbols(self, token: str) -> str:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            token = token[: -len(WORD_END)]
            return token[:-1] + chr(LAST + ord(token[-1]))
        return token

    def _whole(self, token: int) -> bool:
        left, right = self.halves[token]
        return self._fits(left, right, token)

    def _fits(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether left, right stay apart when their joint string is encoded, by merges before limit.

        The token made last is taken apart again and again; had the two tokens that then meet at
        the seam a merge of their own that comes earlier, it would have been done instead. At equal
        rank the left of two places is merged first.
        """
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left < self.n_base:
                    return True
                limit, left = left, self.halves[left][1]
            else:
                if right < self.n_base:
                    return True
                limit, right = right + 1, self.halves[right][0]

    def _word(self, word: str) -> bytes:
        """Ids of one word, given as the pattern found it."""
        s = word
        if not (s.isascii() and s.isprintable()):
            sym = self.byte_symbol
            s = "".join([sym[b] for b in word.encode("utf-8")])
        s = s[:-1] + chr(LAST + ord(s[-1]))
        last = [-1] * (len(s) + 1)
        length, fits = self.length, self.fits
        done = -1
        for at, token in self.automaton.iter(s):
            if at == done:
                continue
            before = at + 1 - length[token]
            if before == 0 or fits[last[before] << PAIR | token]:
                last[at + 1] = token
                done = at
        out, end = [], len(s)
        while end:
            out.append(self.id_of[last[end]])
            end -= length[last[end]]
        out.reverse()
        return b"".join(out)

    def _plain(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        piece = piece.lower() if "Σ" not in piece else "".join([c.lower() for c in piece])
        # A word of ASCII letters is encoded like a piece of text, and remembered as one.
        return b"".join([self.pieces[w] if w.isascii() and w.isalpha() else self.words[w] for w in WORD_PATTERN.findall(piece)])

    def _piece(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers of text without GAP."""
        if piece.isascii() and piece.isalpha():
            return self._word(piece) if piece.islower() else self.pieces[piece.lower()]
        if self.special_pattern and "<|" in piece:
            return b"".join([self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_pattern.split(piece)])
        return self._plain(piece)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([self.pieces[p] for p in GAP.split(text)])

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        return (ids := self.ids(text)), self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """Tokens as the vocabulary spells them, with a space between: the file names no decoder."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, vocab_path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and outputs of every row of df.

    outputs are of TYPES: the ids, the text decoded from them and digests of both. vocab_path is
    a word-end BPE file that every worker can read (default: the public 49k vocabulary). Null
    text counts as empty and has no ids; rows repeated or with null ids are rows like others; an
    empty table gives no rows. Memory holds a slice of texts and what is remembered of pieces.
    """
    common.bound_batches(df.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    docs = df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text", *[f"`{c}` as {n}" for c, n in zip(carry, names, strict=True)])
    kinds = {c: docs.schema[n].dataType.simpleString() for c, n in zip(carry, names, strict=True)}
    schema = ", ".join(["`doc_id` long", *[f"`{c}` {kinds[c]}" for c in carry], *[f"`{o}` {TYPES[o]}" for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        model = loaded(vocab_path or default_path())
        spelled = not {"decoded", "decoded_sha256"}.isdisjoint(outputs)
        # Few rows at a time, as ids take more room than text.
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            out: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(1).to_pylist():
                ids = model.ids(text or "")
                decoded = model.decode(ids) if spelled else ""
                for o, values in out.items():
                    if o == "n_tokens":
                        values.append(len(ids) // 4)
                    elif o == "ids":
                        values.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    elif o == "decoded":
                        values.append(decoded)
                    else:
                        values.append(hashlib.sha256(ids if o == "ids_sha256" else decoded.encode("utf-8")).hexdigest())
            arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            cols = [batch.column(0), *batch.columns[2:], *[pa.array(v, arrow.get(o, pa.string())) for o, v in out.items()]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *carry, *outputs])

    return docs.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
