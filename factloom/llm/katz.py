"""Language-model scores: Katz backoff trigrams over Good-Turing discounted counts.

P(w | u v) = d3(c) * c(u v w) / c(u v) if the three were seen, else alpha(u v) * P(w | v), where
P(w | v) = d2(c) * c(v w) / c(v) if the two were seen, else alpha(v) * P(w). alpha gives unseen
words exactly what the discounts took; P(w) is (c + 0.5) / (N + 0.5 * (V + 1)), which with one
place for unknown words sums to 1.

Words are counted first. Then tokens are dealt once, to the parts of the table of their middle
word v: a part holds all that follows v, and all that follows u v. It asks the parts of the words
for what they know of its words, builds its part of the table, evaluates its tokens recursively
and sends sums of documents on. The HOT most common v are dealt by u v, the HOT most common u v by
u v w; what parts then lack, the words' parts add up for each such history.

Common words travel as numbers of two bytes, all others as hashes. Which words are common and which
histories hot only shifts work, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Counts above this are not discounted.
MOST = 5
#: Tokens held in a task before they are counted or packed.
COUNT_FLUSH, FLUSH = 3_000_000, 1_000_000
#: Histories of one word, and of two, that are dealt over all parts.
HOT = 64
#: Words that travel as numbers.
COMMON = 65_000
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
NO_ID = -(2**63)
#: Numbers of the statistics of a hot history: n[1..6], counts above MOST, sum of (count + 0.5) of what follows, and c(v w) by class.
OF_HOT = (MOST + 1) + 1 + 1 + (MOST + 1)
HEAD = 2 * (MOST + 2)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..MOST+1 (the last stands for all larger ones).

    n[r] is the number of n-grams with count r, up to MOST + 1. A ratio that the counts can't give,
    or that isn't within (0, 1], is 1: no discount.
    """
    d = np.ones(MOST + 2)
    if n[1] > 0:
        rest = (MOST + 1) * n[MOST + 1] / n[1]
        for r in range(1, MOST + 1):
            if n[r] > 0 and n[r + 1] > 0 and rest < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Coding(NamedTuple):
    """What tasks know of the words: common ones (sorted hashes), their training counts, hot
    histories (numbers of common words), and totals over all words."""

    words: np.ndarray
    counts: np.ndarray
    hot: np.ndarray
    hot_u: np.ndarray
    hot_v: np.ndarray
    total: int
    distinct: int

    def numbers(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, and whether it has one."""
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return at.astype(np.int32), self.words[at] == w

    def one(self) -> np.ndarray:
        """Number of the hot history of each common word, or -1."""
        out = np.full(len(self.words), -1, np.int32)
        out[self.hot] = np.arange(len(self.hot))
        return out

    def two(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Number of the hot history (u, v), or -1; numbers beyond the common words aren't hot."""
        n = len(self.words)
        keys = self.hot_u.astype(np.int64) * n + self.hot_v
        order = np.argsort(keys)
        if not len(keys):
            return np.full(len(u), -1, np.int32)
        own = np.where((u < n) & (v < n), u.astype(np.int64) * n + v, -1)
        at = np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)
        return np.where(keys[order][at] == own, order[at], -1).astype(np.int32)


def _stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row with one end after them, the row of each, and where rows begin."""
    n = len(offs) - 1
    words, _, _, rows = common.words(buf, offs, True)
    count = np.bincount(rows, minlength=n) + 1
    w = np.full(len(words) + n, END, np.uint64)
    inner = np.ones(len(w), bool)
    inner[np.cumsum(count) - 1] = False
    w[inner] = words
    return w, np.repeat(np.arange(n), count), np.cumsum(count) - count


def _blob(values) -> pa.Array:
    return pa.array(values, pa.binary())


def count_words(docs: DataFrame, parts: int) -> DataFrame:
    """(to, words, counts): training counts of all words by part of the word; to = -1: pairs, as hot
    ones may be (u in words, v in after), the most common of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def rows() -> pa.RecordBatch:
            w = np.concatenate(held)
            held.clear()
            cut = np.flatnonzero(w == START)
            v = np.concatenate([[START], w[:-1]])
            inside = w != START
            key = common.mix(v[inside] * np.uint64(3) + w[inside])
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            top = np.argsort(-times, kind="stable")[:HOT]
            pair_u, pair_v, pair_n = v[inside][first[top]], w[inside][first[top]], times[top]
            own, n = np.unique(w[inside], return_counts=True)
            order, at = common.split_by(common.part_of(common.mix(own), parts), parts)
            own, n = own[order], n[order]
            some = [p for p in range(parts) if at[p] < at[p + 1]]
            add = lambda x, kind: [x[at[p] : at[p + 1]].astype(kind).tobytes() for p in some]
            # A text's first word follows the start twice.
            return pa.RecordBatch.from_arrays(
                [pa.array([*some, -1], pa.int32()), _blob([*add(own, "<u8"), np.append(pair_u, START).tobytes()]), _blob([*add(n, "<u4"), np.append(pair_n, len(cut)).astype("<u4").tobytes()]), _blob([*[None] * len(some), np.append(pair_v, START).tobytes()])],
                names=["to", "words", "counts", "after"],
            )

        for batch in batches:
            learn = batch["train"].to_numpy(zero_copy_only=False)
            for lo, buf, offs in common.slices(batch["text"]):
                w, row, begin = _stream(buf, offs)
                keep = learn[lo : lo + len(offs) - 1]
                held.append(np.insert(w, begin, START)[np.repeat(keep, np.diff(np.append(begin, len(w))) + 1)])
                n_held += len(w)
            if n_held > COUNT_FLUSH:
                yield rows()
                n_held = 0
        if held:
            yield rows()

    def add(t: pa.Table) -> pa.Table:
        to = t["to"][0].as_py()
        words, counts = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["words"]]), np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t["counts"]])
        if to < 0:
            after = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["after"]])
            _, first, of = np.unique(common.mix(words * np.uint64(3) + after), return_index=True, return_inverse=True)
            n = np.bincount(of, weights=counts).astype(np.int64)
            top = np.lexsort((words[first], -n))[:HOT]
            words, after, n = words[first[top]], after[first[top]], n[top]
        else:
            words, of = np.unique(words, return_inverse=True)
            n, after = np.bincount(of, weights=counts).astype(np.int64), None
        return pa.table({"to": pa.array([to], pa.int32()), "words": _blob([words.tobytes()]), "counts": _blob([n.astype("<i8").tobytes()]), "after": _blob([None if after is None else after.tobytes()])})

    packed = docs.select("text", "train").mapInArrow(run, "to int, words binary, counts binary, after binary")
    return packed.groupBy("to").applyInArrow(add, "to int, words binary, counts binary, after binary")


def coding(counted: DataFrame, parts: int) -> Coding:
    """The common words: COMMON / parts of each part of the words, and what is hot among them."""
    most = max(1, COMMON // parts)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for to, w, c, a in zip(*[b[k].to_pylist() for k in ("to", "words", "counts", "after")], strict=True):
                w, c = np.frombuffer(w, "<u8"), np.frombuffer(c, "<i8")
                best = np.unique(np.append(np.lexsort((w, -c))[:most], np.flatnonzero(w == END))) if to >= 0 else np.arange(len(c))
                after = np.frombuffer(a, "<u8")[best].view(np.int64) if a is not None else np.zeros(len(best), np.int64)
                n = len(best)
                total, distinct = (int(c.sum()), len(c)) if to >= 0 else (0, 0)
                first = np.arange(n) == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, to, np.int32)), pa.array(w[best].view(np.int64)), pa.array(after), pa.array(c[best]), pa.array(np.where(first, total, 0)), pa.array(np.where(first, distinct, 0))], names=["to", "w", "after", "n", "total", "distinct"])

    got = counted.mapInArrow(top, "to int, w long, after long, n long, total long, distinct long").toArrow()
    to, w, after, n = (got[c].to_numpy() for c in ("to", "w", "after", "n"))
    w, after = w.view(np.uint64), after.view(np.uint64)
    own = (to >= 0) & (w != START)
    words, counts = np.append(w[own], START), np.append(n[own], 0)
    if END not in words:
        words, counts = np.append(words, END), np.append(counts, 0)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    hot = np.lexsort((words, -counts))[: HOT - 1]
    hot = np.unique(np.append(hot, np.searchsorted(words, START)))
    code = Coding(words, counts, hot, np.zeros(0, np.int64), np.zeros(0, np.int64), int(got["total"].to_numpy().sum()), int(got["distinct"].to_numpy().sum()))
    (u, known_u), (v, known_v) = code.numbers(w[to < 0]), code.numbers(after[to < 0])
    # The sums of a hot pair need those of its second word.
    some = known_u & known_v & (code.one()[v] >= 0)
    return code._replace(hot_u=u[some].astype(np.int64), hot_v=v[some].astype(np.int64))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def tokens(docs: DataFrame, parts: int, shared) -> DataFrame:
    """(part, n, codes, rare, names): tokens as numbers of u, v, w and document, by part.

    docs has row (a number of its own for each row), doc_id, text and train (whether it is one to
    learn from).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Coding = shared.value
        zip_, n_common, one = zstandard.ZstdCompressor(level=1), len(code.words), code.one()
        start = int(np.searchsorted(code.words, START))
        held: list[tuple] = []
        names: list[tuple] = []
        n_docs = n_held = 0

        def rows() -> pa.RecordBatch:
            hashes, doc, begin = (np.concatenate([x[i] for x in held]) for i in range(3))
            row, ids, train = (np.concatenate([x[i] for x in names]) for i in range(3))
            w, there = code.numbers(hashes)
            rare, of = np.unique(hashes[~there], return_inverse=True)
            w[~there] = n_common + of
            v, u = np.empty_like(w), np.empty_like(w)
            v[1:] = w[:-1]
            v[begin] = start
            u[1:] = v[:-1]
            u[begin] = start
            every = np.concatenate([code.words, rare])
            second = every[v]
            key = common.mix(second)
            pair = common.mix(every[u] * np.uint64(3) + second)
            by_two = np.zeros(n_common + len(rare), bool)
            by_two[:n_common] = one >= 0
            by_two = by_two[v]
            key[by_two] = common.mix(pair[by_two])
            by_three = code.two(u, v) >= 0
            key[by_three] = common.mix(pair[by_three] ^ common.mix(hashes[by_three]))
            part = common.part_of(key, parts)
            del second, key, pair, hashes
            # The order of a part's tokens only serves compression.
            short = lambda x: np.where(x < n_common, x, n_common + (x & 0x3FF)).astype(np.uint64)
            order = np.argsort(part.astype(np.uint64) << np.uint64(40) | short(v) << np.uint64(20) | short(u))
            cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            u, v, w, doc = u[order], v[order], w[order], doc[order]
            out = []
            for p in range(parts):
                s = slice(cut[p], cut[p + 1])
                if cut[p] == cut[p + 1]:
                    continue
                all_ = np.concatenate([v[s], u[s], w[s]])
                far = all_ >= n_common
                own_rare, local = np.unique(all_[far], return_inverse=True)
                low = np.where(far, 65535, all_).astype("<u2")
                own_docs, d = np.unique(doc[s], return_inverse=True)
                n = cut[p + 1] - cut[p]
                body = b"".join([*[_planes(low[i * n : (i + 1) * n]) for i in range(3)], _planes(d.astype("<u4")), _planes(local.astype("<u4"))])
                named = b"".join([_planes(np.diff(row[own_docs], prepend=0).astype("<i8")), _planes(np.diff(ids[own_docs], prepend=0).astype("<i8")), np.packbits(train[own_docs]).tobytes()])
                out.append((p, int(n), zip_.compress(body), rare[own_rare - n_common].tobytes(), int(len(own_docs)), zip_.compress(named)))
            held.clear()
            names.clear()
            ints = lambda i: pa.array([o[i] for o in out], pa.int32())
            return pa.RecordBatch.from_arrays([ints(0), ints(1), _blob([o[2] for o in out]), _blob([o[3] for o in out]), ints(4), _blob([o[5] for o in out])], names=["part", "n", "codes", "rare", "docs", "names"])

        for batch in batches:
            row, learn = batch["row"].to_numpy(), batch["train"].to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy()
            for lo, buf, offs in common.slices(batch["text"]):
                n = len(offs) - 1
                w, of, begin = _stream(buf, offs)
                held.append((w, of + n_docs, begin + n_held))
                names.append((row[lo : lo + n], ids[lo : lo + n], learn[lo : lo + n]))
                n_docs += n
                n_held += len(w)
                if n_held > FLUSH:
                    yield rows()
                    n_docs = n_held = 0
        if held:
            yield rows()

    return docs.select("row", "doc_id", "text", "train").mapInArrow(run, "part int, n int, codes binary, rare binary, docs int, names binary")


class Part(NamedTuple):
    """A part's tokens: numbers of u, v, w (common words first, then rare ones) and documents."""

    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    doc: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    train: np.ndarray
    rare: np.ndarray


def _unpack(t: pa.Table, n_common: int) -> Part:
    unzip = zstandard.ZstdDecompressor()
    rare = [np.frombuffer(x.as_py(), "<u8") for x in t["rare"]]
    every, of = np.unique(np.concatenate(rare), return_inverse=True)
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    at = base = 0
    for n, codes, own, n_docs, names in zip(t["n"].to_pylist(), t["codes"], rare, t["docs"].to_pylist(), t["names"], strict=True):
        body = unzip.decompress(codes.as_py())
        local = _unplanes(body[10 * n :], "<u4", (len(body) - 10 * n) // 4)
        number = n_common + of[at : at + len(own)]
        at += len(own)
        low = np.concatenate([_unplanes(body[2 * n * i : 2 * n * (i + 1)], "<u2", n) for i in range(3)]).astype(np.int32)
        low[low == 65535] = number[local]
        for i, x in enumerate((low[n : 2 * n], low[:n], low[2 * n :])):
            cols[i].append(x)
        cols[3].append(_unplanes(body[6 * n : 10 * n], "<u4", n).astype(np.int32) + np.int32(base))
        base += n_docs
        named = unzip.decompress(names.as_py())
        for i in (0, 1):
            cols[4 + i].append(np.cumsum(_unplanes(named[8 * n_docs * i : 8 * n_docs * (i + 1)], "<i8", n_docs)))
        cols[6].append(np.unpackbits(np.frombuffer(named[16 * n_docs :], np.uint8), count=n_docs).astype(bool))
    return Part(*[np.concatenate(x) for x in cols], every)


class Levels(NamedTuple):
    """Distinct n-grams of a part with their training counts. two: (v, w); three: (u v, w)."""

    v: np.ndarray  # of each pair
    w: np.ndarray
    times: np.ndarray
    of: np.ndarray  # pair of each token
    history: np.ndarray  # of each triple: number of (u, v)
    pair: np.ndarray  # of each triple
    times3: np.ndarray
    of3: np.ndarray  # triple of each token
    hist_u: np.ndarray
    hist_v: np.ndarray


def _levels(p: Part, n_words: int) -> Levels:
    learn = p.train[p.doc]
    keys, of = np.unique(p.v.astype(np.int64) * n_words + p.w, return_inverse=True)
    of = of.astype(np.int32)
    times = np.bincount(of[learn], minlength=len(keys))
    hist, h = np.unique(p.u.astype(np.int64) * n_words + p.v, return_inverse=True)
    # A triple is its history and its pair: both have the same v.
    keys3, first, of3 = np.unique(h * len(keys) + of, return_index=True, return_inverse=True)
    of3 = of3.astype(np.int32)
    times3 = np.bincount(of3[learn], minlength=len(keys3))
    return Levels((keys // n_words).astype(np.int32), (keys % n_words).astype(np.int32), times, of, h[first].astype(np.int32), of[first], times3, of3, (hist // n_words).astype(np.int32), (hist % n_words).astype(np.int32))


def _classes(times: np.ndarray) -> np.ndarray:
    """Numbers of counts 0 (always 0), 1..MOST, MOST + 1."""
    return np.bincount(np.minimum(times[times > 0], MOST + 2), minlength=MOST + 3)[: MOST + 2].astype(np.float64)


def _wanted(p: Part, lv: Levels, code: Coding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of a word to ask for) in order; (pair, its hot history) of those that follow one."""
    n_common = len(code.words)
    one = np.full(n_common + len(p.rare), -1, np.int32)
    one[:n_common] = code.one()
    hot = one[lv.v]
    after = np.flatnonzero(hot >= 0)
    asked = np.zeros(n_common + len(p.rare), bool)
    asked[lv.w] = True
    asked[:n_common] = False
    asked[lv.w[after]] = True
    return np.flatnonzero(asked), after, hot[after]


def _by_word(numbers: np.ndarray, rare: np.ndarray, code: Coding, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, an order by part of the word, and the cuts of parts in it."""
    hashes = np.concatenate([code.words, rare])[numbers]
    order, cut = common.split_by(common.part_of(common.mix(hashes), parts), parts)
    return hashes, order, cut


def ask(packed: DataFrame, parts: int, shared) -> DataFrame:
    """(to, part, words, at, hot, times, cc): what a part asks the parts of words. Its words; for
    those after a hot history, the word's place, the history and the training count; with the
    first row, the part's counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        code: Coding = shared.value
        p = _unpack(t, len(code.words))
        n_words = len(code.words) + len(p.rare)
        lv = _levels(p, n_words)
        asked, after, hot = _wanted(p, lv, code)
        cool = np.ones(len(lv.v), bool)
        cool[after] = False
        cc = np.concatenate([_classes(lv.times[cool]), _classes(lv.times3)])
        two = code.two(lv.hist_u, lv.hist_v)[lv.history]
        far = np.flatnonzero((two >= 0) & (lv.times3 > 0))
        word = np.concatenate([lv.w[after], lv.w[lv.pair[far]]])
        hot = np.concatenate([hot, len(code.hot) + two[far]]).astype("<u2")
        times = np.concatenate([lv.times[after], lv.times3[far]]).astype("<u4")
        hashes, order, cut = _by_word(asked, p.rare, code, parts)
        place = np.empty(len(asked), np.int64)
        place[order] = np.arange(len(asked))
        place = place[np.searchsorted(asked, word)]
        by = np.argsort(place, kind="stable")
        place, hot, times = place[by], hot[by], times[by]
        hashes = hashes[order]
        edges = np.searchsorted(place, cut)
        out = []
        for q in range(parts):
            a, b = edges[q], edges[q + 1]
            if cut[q] < cut[q + 1] or q == 0:
                out.append((q, hashes[cut[q] : cut[q + 1]].tobytes(), (place[a:b] - cut[q]).astype("<u4").tobytes(), hot[a:b].tobytes(), times[a:b].tobytes(), cc.tobytes() if q == 0 else None))
        part = pa.array([t["part"][0].as_py()] * len(out), pa.int32())
        return pa.table({"to": pa.array([o[0] for o in out], pa.int32()), "part": part, **{k: _blob([o[i] for o in out]) for i, k in enumerate(("words", "at", "hot", "times", "cc"), 1)}})

    return packed.groupBy("part").applyInArrow(run, "to int, part int, words binary, at binary, hot binary, times binary, cc binary")


def _answers(asked: pa.Table, table: pa.Table, code: Coding) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Of each row asked: training counts of its words, and of its words after hot histories; the
    statistics of hot histories over this part's words."""
    own, count = (np.frombuffer(table[k][0].as_py(), x) if table.num_rows else np.zeros(0, x) for k, x in (("words", "<u8"), ("counts", "<i8")))
    words = [np.frombuffer(x.as_py(), "<u8") for x in asked["words"]]
    every, of = np.unique(np.concatenate(words), return_inverse=True)
    c = np.zeros(len(every), np.int64)
    if len(own) and len(every):
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        c = np.where(own[at] == every, count[at], 0)
    base = np.cumsum([0, *[len(x) for x in words]])
    n_hot = len(code.hot) + len(code.hot_u)
    key, times = [], []
    for i, (at, hot, n) in enumerate(zip(*[asked[k] for k in ("at", "hot", "times")], strict=True)):
        at, hot, n = (np.frombuffer(x.as_py(), k) for x, k in ((at, "<u4"), (hot, "<u2"), (n, "<u4")))
        key.append(of[base[i] : base[i + 1]][at] * n_hot + hot)
        times.append(n)
    sizes = [len(x) for x in key]
    keys, which = np.unique(np.concatenate(key), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64)
    stats = np.zeros(HEAD + n_hot * OF_HOT)
    for x in asked["cc"]:
        if x.is_valid:
            stats[:HEAD] += np.frombuffer(x.as_py(), np.float64)
    seen = total > 0
    word, hot, n = keys[seen] // n_hot, keys[seen] % n_hot, total[seen]
    by = stats[HEAD:].reshape(n_hot, OF_HOT)
    np.add.at(by, (hot[n <= MOST + 1], n[n <= MOST + 1] - 1), 1)
    np.add.at(by, (hot[n > MOST], MOST + 1), n[n > MOST])
    single = hot < len(code.hot)
    np.add.at(by, (hot[single], MOST + 2), c[word[single]] + 0.5)
    double = ~single
    if double.any():
        first = code.one()[code.hot_v[hot[double] - len(code.hot)]]
        pair = total[np.searchsorted(keys, word[double] * n_hot + first)]
        np.add.at(by, (hot[double], MOST + 2 + np.minimum(pair, MOST + 1)), pair)
    back = np.split(total[which], np.cumsum(sizes)[:-1])
    return [c[of[base[i] : base[i + 1]]].astype("<u4" if c.max(initial=0) < 2**32 else "<u8").tobytes() for i in range(len(words))], [x.astype("<u4").tobytes() for x in back], stats


class Model:
    """A part of the table: the n-grams of its histories, with the words they need."""

    def __init__(self, p: Part, lv: Levels, code: Coding, count: np.ndarray, two_times: np.ndarray, stats: np.ndarray):
        """count: training counts of words by number. two_times: those of pairs over all parts."""
        z = code.total + 0.5 * (code.distinct + 1)
        self.p_word = (count + 0.5) / z
        n_one = len(code.hot)
        by = stats[HEAD:].reshape(-1, OF_HOT)
        single = by[:n_one, : MOST + 2]
        cc2 = stats[: MOST + 2].copy()
        cc2[1:] += single[:, : MOST + 1].sum(0)
        d2, d3 = discounts(cc2), discounts(stats[MOST + 2 : HEAD])
        r = np.arange(1, MOST + 1)

        def sums(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (x[:, :MOST] * r).sum(1) + x[:, MOST + 1], (x[:, :MOST] * r * d[1 : MOST + 1]).sum(1) + x[:, MOST + 1]

        def settle(of: np.ndarray, kept: np.ndarray) -> np.ndarray:
            # A history whose counts are all above MOST keeps one count for what it hasn't seen.
            return np.where((of > 0) & (of - kept <= 1e-9 * of), of + 1, of)

        def alpha(of: np.ndarray, kept: np.ndarray, follow: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(of > 0, (1 - kept / of) / (1 - follow), 1.0)

        # Pairs: histories v by number of the word.
        n_words = len(count)
        left = d2[np.minimum(two_times, MOST + 1)] * two_times
        seen = two_times > 0
        of, kept, follow = (np.bincount(lv.v[seen], weights=x[seen], minlength=n_words) for x in (two_times, left, self.p_word[lv.w]))
        hot_of, hot_kept = sums(by[:n_one], d2)
        of[code.hot], kept[code.hot], follow[code.hot] = hot_of, hot_kept, by[:n_one, MOST + 2] / z
        of = settle(of, kept)
        back = alpha(of, kept, follow)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p_two = np.where(seen, left / of[lv.v], back[lv.v] * self.p_word[lv.w])
        # Triples: histories (u, v).
        left3 = d3[np.minimum(lv.times3, MOST + 1)] * lv.times3
        seen3 = lv.times3 > 0
        n_hist = len(lv.hist_u)
        of3, kept3, follow3 = (np.bincount(lv.history[seen3], weights=x[seen3], minlength=n_hist) for x in (lv.times3, left3, self.p_two[lv.pair]))
        two = code.two(lv.hist_u, lv.hist_v)
        own = np.flatnonzero(two >= 0)
        if len(own):
            x = by[n_one + two[own]]
            of3[own], kept3[own] = sums(x, d3)
            m = x[:, MOST + 3 :]
            follow3[own] = (m[:, :MOST] * d2[1 : MOST + 1]).sum(1) + m[:, MOST]
            with np.errstate(divide="ignore", invalid="ignore"):
                follow3[own] = np.where(of[lv.hist_v[own]] > 0, follow3[own] / of[lv.hist_v[own]], 0.0)
        of3 = settle(of3, kept3)
        back3 = alpha(of3, kept3, follow3)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p_three = np.where(seen3, left3 / of3[lv.history], back3[lv.history] * self.p_two[lv.pair])


def _evaluate(own: pa.Table, answers: pa.Table, code: Coding, parts: int) -> pa.Table:
    """Sums over a part's tokens by document, packed by part of the document."""
    p = _unpack(own, len(code.words))
    n_common = len(code.words)
    lv = _levels(p, n_common + len(p.rare))
    asked, after, _ = _wanted(p, lv, code)
    told = pc.is_valid(answers["stats"])
    stats = np.frombuffer(answers.filter(told)["stats"][0].as_py(), np.float64)
    answers = answers.filter(pc.invert(told)).sort_by("word_part")
    _, order, cut = _by_word(asked, p.rare, code, parts)
    count = np.concatenate([code.counts, np.zeros(len(p.rare), np.int64)])
    place = np.empty(len(asked), np.int64)
    place[order] = np.arange(len(asked))
    counts = np.zeros(len(asked), np.int64)
    # The same order as in ask: words by part, entries by place, singles before doubles.
    two_times = lv.times.astype(np.int64)
    spot = place[np.searchsorted(asked, lv.w[after])]
    by = np.argsort(spot, kind="stable")
    edges = np.searchsorted(spot[by], cut)
    for q, c, n, at, hot in zip(*[answers[k].to_pylist() for k in ("word_part", "counts", "times", "at", "hot")], strict=True):
        size = int(cut[q + 1] - cut[q])
        counts[cut[q] : cut[q + 1]] = np.frombuffer(c, "<u4" if len(c) == 4 * size else "<u8")
        single = np.frombuffer(hot, "<u2") < len(code.hot)
        two_times[after[by[edges[q] : edges[q + 1]]]] = np.frombuffer(n, "<u4")[single]
    count[asked[order]] = counts
    model = Model(p, lv, code, count, two_times, stats)
    n = len(p.rows)
    log_word = np.log10(model.p_word)
    base = np.bincount(p.doc, weights=log_word[p.w], minlength=n)
    score = np.bincount(p.doc, weights=np.log10(model.p_three)[lv.of3], minlength=n)
    known = np.bincount(p.doc[count[p.w] > 0], minlength=n)
    size = np.bincount(p.doc, minlength=n)
    order, cut = common.split_by(common.part_of(common.mix(p.rows.astype(np.uint64)), parts), parts)
    zip_ = zstandard.ZstdCompressor(level=1)
    out = []
    for q in range(parts):
        some = order[cut[q] : cut[q + 1]]
        if len(some):
            some = some[np.argsort(p.rows[some], kind="stable")]
            ints = b"".join([_planes(np.diff(x[some], prepend=0).astype("<i8")) for x in (p.rows, p.ids)] + [_planes(x[some].astype("<u4")) for x in (size, known)])
            out.append((q, len(some), zip_.compress(ints), np.concatenate([base[some], score[some]]).astype("<f8").tobytes()))
    return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "n": pa.array([o[1] for o in out], pa.int32()), "ints": _blob([o[2] for o in out]), "sums": _blob([o[3] for o in out])})


def _sum_up(t: pa.Table, total: int) -> pa.Table:
    """Documents of a part from the sums of all parts of the table."""
    unzip = zstandard.ZstdDecompressor()
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for n, ints, sums in zip(t["n"].to_pylist(), t["ints"], t["sums"], strict=True):
        ints, sums = unzip.decompress(ints.as_py()), np.frombuffer(sums.as_py(), "<f8")
        for i in (0, 1):
            cols[i].append(np.cumsum(_unplanes(ints[8 * n * i : 8 * n * (i + 1)], "<i8", n)))
            cols[2 + i].append(_unplanes(ints[16 * n + 4 * n * i : 16 * n + 4 * n * (i + 1)], "<u4", n))
            cols[4 + i].append(sums[n * i : n * (i + 1)])
    rows, ids, size, known, base, score = (np.concatenate(x) for x in cols)
    # In one order of the parts' sums, so that reruns give the same last digits.
    order = np.lexsort((score, base, rows))
    rows, ids, size, known, base, score = (x[order] for x in (rows, ids, size, known, base, score))
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    add = lambda x: np.add.reduceat(x, first)
    n = add(size.astype(np.int64))
    null = ids[first] == NO_ID
    return pa.table({"doc_id": pa.array(ids[first], mask=null), "n_tokens": pa.array(n), "n_known": pa.array(add(known.astype(np.int64))), "train_tokens": pa.array(np.full(len(first), total)), "base_score": pa.array(add(base)), "score": pa.array(add(score)), "score_per_token": pa.array(add(score) / n)})


def score(df: DataFrame, fold: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token of every row of df.

    A row is held out if crc32 of its id, as decimal text, leaves fold when divided by folds; the
    model learns from the others (a null id counts as empty text, so from those too). Words are
    those of the text with A-Z lower-cased, then one end; two starts stand before a text. Null
    text counts as empty: one token. Rows repeated are rows like others; an empty table gives no
    rows. With nothing to learn from, all words are unknown and score equals base_score.
    """
    spark = df.sparkSession
    common.bound_batches(spark)
    parts = max(4, common.shuffle_parts(spark))
    docs = common.ensure_text(df, id_col, text_col)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", (~held_out).alias("train"))
    counted = common.cut(count_words(docs, parts))
    code = coding(counted, parts)
    shared = spark.sparkContext.broadcast(code)
    packed = tokens(docs, parts, shared)
    asked = ask(packed, parts, shared)
    table = counted.where("to >= 0").select("to", "words", "counts")

    def answer(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({k: pa.array([], x) for k, x in (("part", pa.int32()), ("word_part", pa.int32()), ("counts", pa.binary()), ("times", pa.binary()), ("at", pa.binary()), ("hot", pa.binary()))})
        counts, times, _ = _answers(a, b, shared.value)
        return pa.table({"part": a["part"], "word_part": a["to"], "counts": _blob(counts), "times": _blob(times), "at": _blob([None] * a.num_rows), "hot": a["hot"]})

    def summary(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = [_answers(a, b, shared.value)[2].tobytes()] if a.num_rows else []
        return pa.table({"k": pa.array([a["to"][0].as_py() % fan] * len(rows), pa.int32()), "stats": _blob(rows)})

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"k": pa.array([0], pa.int32()), "stats": _blob([np.sum([np.frombuffer(x.as_py(), np.float64) for x in t["stats"]], axis=0).tobytes()])})

    fan = max(1, round(parts**0.5))
    both = asked.groupBy("to").cogroup(table.groupBy("to"))
    answers = both.applyInArrow(answer, "part int, word_part int, counts binary, times binary, at binary, hot binary")
    # Sums over all parts of the words, in two steps: 14 + 128 * 14 numbers at most, a copy for each part.
    stats = both.applyInArrow(summary, "k int, stats binary").groupBy("k").applyInArrow(add, "k int, stats binary")
    stats = stats.groupBy("k").applyInArrow(add, "k int, stats binary")  # all have k 0 by now
    none = [F.lit(None).cast(k).alias(c) for c, k in (("word_part", "int"), ("counts", "binary"), ("times", "binary"), ("at", "binary"), ("hot", "binary"))]
    stats = stats.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *none, "stats")
    told = answers.withColumn("stats", F.lit(None).cast("binary")).unionByName(stats)

    def evaluate(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "ints": _blob([]), "sums": _blob([])})
        return _evaluate(a, b, shared.value, parts)

    sums = packed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(evaluate, "part int, n int, ints binary, sums binary")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"
    whole = sums.groupBy("part").applyInArrow(lambda t: _sum_up(t, code.total), schema)
    return whole.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_per_token")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
