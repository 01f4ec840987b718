"""Repeated strings across documents: enhanced suffix arrays over sampled suffixes, common-prefix intervals.

A string of LENGTH bytes that starts at two places contains, at both, the same sampled position
(the least hash of its runs of GRAM bytes). So only suffixes at sampled positions are sorted:
those whose run comes more than once meet in one part, where a stack scan over the common-prefix
lengths of the sorted suffixes yields every interval of suffixes that share a prefix; left
extensions within an interval show which maximal strings reach LENGTH, with all places they
start at. Whole texts that repeat are one class, counted once. Positions are sampled so that
strings of PASSAGE bytes hold one too: the same scan tells which passages repeat. Texts that hold
no repeated run stay where they are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 400, 48
#: Bytes of the strings that passages consist of, and words that a passage has more than.
PASSAGE, PASSAGE_WORDS = 192, 50
#: Contexts of one run that a task may hold, under 1 KB each. A run that has more goes another exact
#: way, by hashes of whole strings, which costs some ten times the bytes.
HOT = 30_000
#: Spans that a task of intervals holds before it gives them away, beside those of one run.
SPANS = 100_000
RUN = np.dtype([("place", "<i8"), ("hash", "<u8"), ("size", "<i8")])


def gram_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """A hash of buf[i : i + length] for every i."""
    n = len(buf) - length + 1
    up, down = common.powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(common.BYTE_CODE[buf] * up[: len(buf)], out=total[1:])
    return common.mix((total[length:] - total[:n]) * down[:n])


def _window(x: np.ndarray, w: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over each run of w values, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = take(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = take(out[: len(out) - (w - have)], out[w - have :])
    return out


def sampled(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the runs of gram bytes that are least in some string of length bytes."""
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, w = gram_hashes(buf, gram), length - gram + 1
    least = _window(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_window(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    return at, h[at]


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _neighbour_prefixes(sorted_texts: list[bytes]) -> np.ndarray:
    return np.array([shared_prefix(a, b) for a, b in zip(sorted_texts, sorted_texts[1:], strict=False)], np.int64)


def maximal_repeats(lefts: list[bytes], rights: list[bytes], lengths: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(level, member, left, right): how far the strings of lengths[level] bytes or more reach that
    stand around the member's position and around another member's too.

    lefts are reversed left contexts and rights right contexts, of distinct members. Members in
    suffix order and the common-prefix lengths of neighbours are scanned with a stack; each
    interval (members that share its depth) is tested once: its members in the order of their left
    contexts have their longest common left extension with a neighbour, a least value over a range
    of neighbours' extensions. All strings of a member hold its position, so their union is known
    by the largest reach on either side.
    """
    n = len(rights)
    if n < 2:
        return []
    order = np.array(sorted(range(n), key=rights.__getitem__))
    depth = _neighbour_prefixes([rights[i] for i in order]).tolist()
    by_left = np.array(sorted(range(n), key=lefts.__getitem__))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    # least[k][i] is the least of 2**k neighbours' extensions from i on.
    least_of = [_neighbour_prefixes([lefts[i] for i in by_left])]
    while 2 << (len(least_of) - 1) < n:
        half, prev = 1 << (len(least_of) - 1), least_of[-1]
        least_of.append(np.minimum(prev[:-half], prev[half:]))
    left, right = np.zeros((len(lengths), n), np.int64), np.zeros((len(lengths), n), np.int64)

    def interval(lo: int, hi: int, d: int) -> None:
        r = np.sort(rank[order[lo : hi + 1]])
        i, j = r[:-1], r[1:]
        if len(r) <= 3:
            m = np.array([least_of[0][a:b].min() for a, b in zip(i.tolist(), j.tolist(), strict=True)])
        else:
            k = np.frexp((j - i).astype(float))[1] - 1
            m = np.empty(len(i), np.int64)
            for x in np.unique(k):
                own = k == x
                m[own] = np.minimum(least_of[x][i[own]], least_of[x][j[own] - (1 << int(x))])
        best = np.zeros(len(r), np.int64)
        best[:-1] = m
        best[1:] = np.maximum(best[1:], m)
        for level, least in enumerate(lengths):
            own = best + d >= least
            if not own.any():
                break
            who = by_left[r[own]]
            left[level, who] = np.maximum(left[level, who], best[own])
            right[level, who] = np.maximum(right[level, who], d)

    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*depth, -1]):
        start = i
        while stack and stack[-1][1] > d:
            start, deep = stack.pop()
            interval(start, i, deep)
        if d >= 0 and (not stack or stack[-1][1] < d):
            stack.append((start, d))
    return [(level, m, int(left[level, m]), int(right[level, m])) for level in range(len(lengths)) for m in np.flatnonzero(right[level]).tolist()]


def _name(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """An even spread over parts: sampled runs have the least hashes around, so their upper bits are nearly all 0."""
    return common.part_of(common.mix(keys), parts)


PACKED = "part int, hashes binary, places binary, owners binary, names binary"


class Packing:
    """Hashed places of texts, packed by part of their hash: rows of PACKED."""

    def __init__(self, parts: int):
        self.parts, self.held, self.names, self.n = parts, [], [], 0

    def add(self, name: bytes, keys: np.ndarray, at: np.ndarray) -> None:
        if len(keys):
            self.held.append((keys, at, np.full(len(at), len(self.names), np.int64)))
            self.names.append(name)
            self.n += len(at)

    def rows(self) -> pa.RecordBatch:
        keys, at, owner = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        order, cut = common.split_by(dealt(keys, self.parts), self.parts)
        table, out = np.frombuffer(b"".join(self.names), "V16"), []
        for p in range(self.parts):
            idx = order[cut[p] : cut[p + 1]]
            if len(idx):
                own, local = np.unique(owner[idx], return_inverse=True)
                out.append((p, keys[idx].tobytes(), at[idx].astype("<i8").tobytes(), local.astype("<u4").tobytes(), table[own].tobytes()))
        self.__init__(self.parts)
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in range(1, 5)]], names=["part", "hashes", "places", "owners", "names"])


def new_contexts(buf: np.ndarray, at: np.ndarray, reach: int, length: int) -> np.ndarray:
    """1 for the first place in a text of each context of a run, else 0."""
    lo = np.maximum(at - reach, 0)
    h = common.mix(common.span_hashes(buf, lo, np.minimum(at + length, len(buf))) + (at - lo).astype(np.uint64))
    out = np.zeros(len(at), np.int64)
    out[np.unique(h, return_index=True)[1]] = 1
    return out


def sample_parts(texts: DataFrame, lengths: tuple[int, ...], gram: int, parts: int) -> DataFrame:
    """PACKED: sampled runs of every text; a place is doubled, and one more where its context is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing(parts)
        for batch in batches:
            for text in _texts(batch.column(0)):
                buf = np.frombuffer(text, np.uint8)
                at, h = sampled(buf, lengths[0], gram)
                if len(at):
                    packing.add(_name(text), h, 2 * at + new_contexts(buf, at, lengths[0] - gram, lengths[-1]))
            if packing.n > 1_000_000:
                yield packing.rows()
        if packing.n:
            yield packing.rows()

    return texts.mapInArrow(run, PACKED)


def repeated_runs(packed: DataFrame, hot: int) -> DataFrame:
    """(cls, runs, hot): each text's sampled runs that come at two places or more, as RUN: their
    places, hashes, and how many contexts a run has over all texts, copies of a text being one;
    hot, if one has more than that."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]])
        at = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table["places"]])
        owners, names, base = [], [], 0
        for o, t in zip(table["owners"], table["names"], strict=True):
            names.append(np.frombuffer(t.as_py(), "V16"))
            owners.append(np.frombuffer(o.as_py(), "<u4").astype(np.int64) + base)
            base += len(names[-1])
        owners, all_names = np.concatenate(owners), np.concatenate(names)
        order = np.argsort(keys, kind="stable")
        keys, at, owners = keys[order], at[order], owners[order]
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        same[:-1] |= same[1:]
        keys, at, owners = keys[same], at[same], owners[same]
        used, local = np.unique(owners, return_inverse=True)
        text = [all_names[i].tobytes() for i in used]
        number = {t: i for i, t in enumerate(sorted(set(text)))}
        c = np.array([number[t] for t in text], np.int64)[local] if len(used) else owners
        order = np.lexsort((at, c, keys))  # copies of a text are one class: the same place once
        keys, at, c = keys[order], at[order], c[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (c[1:] != c[:-1]) | (at[1:] != at[:-1])
        keys, at, c = keys[new], at[new], c[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        keep = np.repeat(sizes, sizes) > 1
        if len(keys):
            sizes = np.repeat(np.add.reduceat(at & 1, starts), sizes)
        keys, at, c, sizes = keys[keep], at[keep], c[keep], sizes[keep]
        order = np.argsort(c, kind="stable")
        keys, at, c, sizes = keys[order], at[order], c[order], sizes[order]
        cut = np.searchsorted(c, np.arange(len(number) + 1))
        by = sorted(number)
        some = [i for i in range(len(number)) if cut[i + 1] > cut[i]]
        runs = np.empty(len(keys), RUN)
        runs["place"], runs["hash"], runs["size"] = at >> 1, keys, sizes
        return pa.table({"cls": pa.array([by[i] for i in some], pa.binary()), "runs": pa.array([runs[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), "hot": pa.array([bool((sizes[cut[i] : cut[i + 1]] > hot).any()) for i in some], pa.bool_())})

    return packed.groupBy("part").applyInArrow(run, "cls binary, runs binary, hot boolean")


def contexts(joined: DataFrame, lengths: tuple[int, ...], gram: int, hot: int) -> DataFrame:
    """From (cls, text, found runs): (hash, cls, places, before, after), a row for each run and
    context of a text with all its places, for runs of at most hot contexts.

    A string has a sampled position among its first lengths[0] bytes, so the context goes no
    further back than that from the one, and as far on as the longest string.
    """
    reach = lengths[0] - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cls, text, runs in zip(batch["cls"].to_pylist(), _texts(batch["text"]), batch["found"].to_pylist(), strict=True):
                same: dict[tuple, list[int]] = {}
                for found in runs:
                    at, h, n = (np.frombuffer(found, RUN)[x] for x in ("place", "hash", "size"))
                    for p, x in zip(at[n <= hot].tolist(), h[n <= hot].tolist(), strict=True):
                        before, after = text[max(0, p - reach) : p], text[p : p + lengths[-1]]
                        same.setdefault((x, len(before), before + after), []).append(p)
                out += [(x, cls, np.array(ps, "<i8").tobytes(), s[:k][::-1], s[k:]) for (x, k, s), ps in same.items()]
                while len(out) > 4000:
                    yield pack(out[:4000])
                    del out[:4000]
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        h = np.array([o[0] for o in out], np.uint64)
        cols = [pa.array(h.view(np.int64)), *[pa.array([o[i] for o in out], pa.binary()) for i in range(1, 5)]]
        return pa.RecordBatch.from_arrays(cols, names=["hash", "cls", "places", "before", "after"])

    return joined.select("cls", "text", "found").mapInArrow(run, "hash long, cls binary, places binary, before binary, after binary")


def whole_strings(joined: DataFrame, lengths: tuple[int, ...], gram: int, parts: int, hot: int) -> DataFrame:
    """(cls, level, starts, ends) as intervals gives them, for runs of more than hot contexts: all
    strings around these, by their hashes."""
    reach, levels = lengths[0] - gram, len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing(parts)
        for batch in batches:
            for text, runs in zip(_texts(batch["text"]), batch["found"].to_pylist(), strict=True):
                buf, found = np.frombuffer(text, np.uint8), np.frombuffer(b"".join(runs), RUN)
                at = found["place"][found["size"] > hot]
                for level, length in enumerate(lengths):
                    if len(at) and len(buf) >= length:
                        edge = np.zeros(len(buf) - length + 2, np.int64)
                        np.add.at(edge, np.clip(at - reach, 0, len(edge) - 1), 1)
                        np.add.at(edge, np.minimum(at + 1, len(edge) - 1), -1)
                        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                        keys = common.mix(gram_hashes(buf, length)[starts] + np.uint64(level))
                        packing.add(_name(text), keys, 2 * (starts * levels + level))
                if packing.n > 1_000_000:
                    yield packing.rows()
        if packing.n:
            yield packing.rows()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cls, runs in zip(b["cls"].to_pylist(), b["found"].to_pylist(), strict=True):
                at = np.frombuffer(b"".join(runs), RUN)["place"]
                for level, length in enumerate(lengths):
                    starts = np.sort(at[at % levels == level]) // levels
                    if len(starts):
                        out.append((cls, level, *[x.astype("<i8").tobytes() for x in merged(starts, starts + length)]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in (2, 3)]], names=["cls", "level", "starts", "ends"])

    packed = joined.select("text", "found").mapInArrow(run, PACKED)
    found = repeated_runs(packed, hot).groupBy("cls").agg(F.collect_list("runs").alias("found"))
    return found.mapInArrow(spans, "cls binary, level int, starts binary, ends binary")


def intervals(found: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(cls, level, starts, ends): the repeated strings around sampled runs, as bytes covered in each text.

    Rows come sorted by run; a task holds the contexts of one run, and SPANS spans, however many
    runs it gets.
    """

    def group(rows: tuple[list, ...], add) -> None:
        places: dict[tuple[bytes, bytes], dict[bytes, list[bytes]]] = {}
        for cls, at, before, after in zip(*rows, strict=True):
            places.setdefault((before, after), {}).setdefault(cls, []).append(at)
        places = {x: {cls: np.unique(np.frombuffer(b"".join(at), "<i8")) for cls, at in own.items()} for x, own in places.items()}
        members = list(places)
        for context in members:
            before, after = context
            own = places[context]
            if sum(map(len, own.values())) > 1:
                for level, length in enumerate(lengths):
                    if len(before) + len(after) >= length:
                        add(level, own, len(before), len(after))
        if len(members) == 2:  # the one interval of two members
            left, right = (shared_prefix(members[0][i], members[1][i]) for i in (0, 1))
            reach = [(level, i, left, right) for level, length in enumerate(lengths) if left + right >= length for i in (0, 1)]
        else:
            reach = maximal_repeats([m[0] for m in members], [m[1] for m in members], lengths)
        for level, i, left, right in reach:
            add(level, places[members[i]], left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[bytes, int], list[np.ndarray]] = {}
        n_out = 0

        def add(level: int, own: dict[bytes, np.ndarray], left: int, right: int) -> None:
            nonlocal n_out
            for cls, at in own.items():
                out.setdefault((cls, level), []).append(np.stack([at - left, at + right]))
                n_out += len(at)

        def flush() -> pa.RecordBatch:
            nonlocal n_out
            packed = [merged(*np.concatenate(v, axis=1)) for v in out.values()]
            blobs = [pa.array([x[i].astype("<i8").tobytes() for x in packed], pa.binary()) for i in (0, 1)]
            rows = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), *blobs], names=["cls", "level", "starts", "ends"])
            out.clear()
            n_out = 0
            return rows

        held: list[pa.RecordBatch] = []  # the run that may go on in the next batch
        last = None
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            if held and h[0] != last:
                group(columns(held), add)
                held.clear()
            if len(cuts) > 1:
                if held:
                    group(columns([*held, batch.slice(0, cuts[1])]), add)
                    held.clear()
                    cuts = cuts[1:]
                rows = columns([batch])
                for a, b in itertools.pairwise(cuts.tolist()):
                    group(tuple(x[a:b] for x in rows), add)
                    if n_out > SPANS:
                        yield flush()
                del rows
            held.append(batch.slice(int(cuts[-1])))
            last = h[-1]
            if n_out > SPANS:
                yield flush()
        if held:
            group(columns(held), add)
        if out:
            yield flush()

    def columns(some: list[pa.RecordBatch]) -> tuple[list, ...]:
        return tuple(list(itertools.chain.from_iterable(b[c].to_pylist() for b in some)) for c in ("cls", "places", "before", "after"))

    schema = "cls binary, level int, starts binary, ends binary"
    return found.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that spans cover; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def passage_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> int:
    """Words that begin in those of the runs that have more than most of them."""
    begin = common.words(buf, np.array([0, len(buf)]), False)[1]
    n = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    return int(n[n > most].sum())


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words (and kept, binary, if with_text) of every row.

    Removed is each byte covered by a string of length bytes that also starts anywhere else, in
    the same text too, judged on the texts as given. A text that comes in two rows or more is
    removed whole if it has length bytes. passage_words is the number of words in passages: runs
    of over PASSAGE_WORDS words whose bytes strings of passage bytes cover that also start
    elsewhere; nothing is removed for these. Null text counts as empty; shorter texts keep all;
    rows with null ids are rows like others; an empty table gives no rows.
    """
    spark = df.sparkSession
    common.bound_batches(spark)
    lengths = (passage, length)
    parts = 4 * common.shuffle_parts(spark)
    docs = common.ensure_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    packed = sample_parts(docs.select("text"), lengths, gram, parts)
    found = repeated_runs(packed, hot).groupBy("cls").agg(F.collect_list("runs").alias("found"), F.max("hot").alias("hot"))
    named = docs.withColumn("cls", F.unhex(F.md5("text")))
    first = named.groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = common.cut(first)
    # Texts are dealt once, and only those that hold a run: the row that stands for its class is part of the join's key.
    wanted = common.cut(found.join(first.select("cls", "first"), "cls"))
    some = named.withColumn("first", F.coalesce("doc_id", F.lit(-(2**63))))

    def texts(wanted: DataFrame) -> DataFrame:
        h = F.xxhash64("cls", "first")
        return common.among(some, h, wanted.select(h.alias("h")), "met").where("met").drop("met").join(wanted, ["cls", "first"])

    around = intervals(contexts(texts(wanted), lengths, gram, hot), lengths)
    if not (common_runs := wanted.where("hot")).isEmpty():
        around = around.unionByName(whole_strings(texts(common_runs), lengths, gram, parts, hot))
    spans = common.cut(around.groupBy("cls").agg(F.collect_list(F.struct("level", "starts", "ends")).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            out: list[tuple] = []
            for text, copies, own in zip(_texts(b["text"]), b["copies"].to_pylist(), b["spans"].to_pylist(), strict=True):
                level = []
                for i, n in enumerate(lengths):
                    mine = [x for x in own or () if x["level"] == i]
                    if copies > 1 and len(text) >= n:
                        level.append((np.array([0]), np.array([len(text)])))
                    elif mine:
                        level.append(merged(*(np.concatenate([np.frombuffer(x[k], "<i8") for x in mine]) for k in ("starts", "ends"))))
                    else:
                        level.append((none, none))
                s, e = level[1]
                at, keep = 0, []
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    keep.append(text[at:x])
                    at = y
                kept = b"".join([*keep, text[at:]])
                shared = passage_words(np.frombuffer(text, np.uint8), *level[0], PASSAGE_WORDS) if len(level[0][0]) else 0
                out.append((len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), shared, kept))
            cols = [b["doc_id"], *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([o[3] for o in out], pa.string()), pa.array([o[4] for o in out], pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words"]
            if with_text:
                cols, names = [*cols, pa.array([o[5] for o in out], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    facts = common.cut(first.select("cls", "copies").join(spans, "cls", "left").where("copies > 1 or spans is not null"))
    own = common.among(named, F.xxhash64("cls"), facts.select(F.xxhash64("cls").alias("h")), "listed")
    among = own.where("listed").join(facts.hint("merge"), "cls", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    alone = own.where("not listed").select("doc_id", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long" + ", kept binary" * with_text
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(0).cast("long").alias("passage_words"), *[F.col("text").cast("binary").alias("kept")] * with_text]
    return among.mapInArrow(cut, schema).unionByName(alone.select("doc_id", *whole))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
