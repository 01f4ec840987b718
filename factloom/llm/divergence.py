"""Source divergence audit: how each source of a language differs from the others and from the whole.

Pairs start at V times the value of two zero counts. Term postings bring corrections only: a term
that one of two sources has changes the pair by the histogram of that source's counts, and a term
that both have by what the two single corrections leave out. Numbers are whole throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Probabilities are parts of SCALE, a term's ranks end at TOP, kept terms are in LEAST documents.
SCALE, TOP, LEAST = 1_000_000_000, 200, 3
#: Bytes of text that are split at a time, entries and bytes of terms that a task counts before it
#: hands them on, and pairs of postings that one step of a task holds.
PIECE, ENTRIES, TERM_BYTES, PAIRS = 1 << 20, 250_000, 16 << 20, 1 << 20

# A-Z to lower case; letters and all bytes beyond ASCII stay; everything else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of about PIECE bytes, none cut in two.

    A run of bytes beyond ASCII is one of code points beyond ASCII, so bytes do for code points.
    """
    text = text.translate(_LETTERS)
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        # split() would part at other white bytes too, but only spaces are left
        yield text[lo:hi].split()
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows; a row with an empty term names each group."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    met: set[tuple[str, str]] = set()
    held = size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            seen, terms = docs[lang, source], list(own)
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([own[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i, group in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)):
            if group not in met:
                met.add(group)
                counts[group][b""] = 0
                held += 1
            own: Counter = Counter()
            for piece in _terms(texts[i].as_py()):
                own.update(piece)
            before = len(counts[group])
            counts[group].update(own)
            docs[group].update(own.keys())
            fresh = len(counts[group]) - before
            held += fresh
            size += fresh and sum(map(len, own))
            if held > ENTRIES or size > TERM_BYTES:
                yield from out()
                counts.clear(), docs.clear()
                held = size = 0
    yield from out()


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, groups): (lang, source, term, n, lang_n) of the kept terms' counts above 0, and every
    (lang, source) that occurs. Null text, lang and source are empty; lang_n is the whole language's count.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    parts = docs.select(text, lang, source).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # A task's rows of a term are summed already, so a common term is a few rows of each task.
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    rows = summed.withColumn("lang_n", F.sum("n").over(w)).withColumn("lang_docs", F.sum("docs").over(w))
    rows = common.cut(rows.where((F.col("term") == "") | (F.col("lang_docs") >= LEAST)).select("lang", "source", "term", "n", "lang_n"))
    return rows.where("term <> ''"), rows.where("term = ''").select("lang", "source")


def part(count: Column | int, total: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), in decimals as the product may pass 64 bits."""
    count = F.lit(count) if isinstance(count, int) else count
    over = (count.cast("decimal(19,0)") + F.lit(1)) * F.lit(SCALE)
    return F.when(F.col(total) + F.col(v) > 0, F.expr("1L") + _div(over, F.col(total) + F.col(v))).otherwise(F.lit(1).cast("long"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b.cast("decimal(20,0)"))


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)**2 / q); parts are below 2**30 or so, so squares stay below 2**63."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, v): summed over a task's terms, what a term that both sources have adds to the
    two single corrections. Rows come by term; ids are numbers within the language."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rest: pa.Table | None = None

    def add(lang: str, ends: np.ndarray, ids: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
        """ends: where each term's postings end. Takes runs of terms with about PAIRS pairs; a longer posting by its rows."""
        starts = np.concatenate([[0], ends[:-1]])
        left = np.arange(len(ids))
        width = np.repeat(ends - starts, ends - starts)
        first = np.repeat(starts, ends - starts)
        upto = np.concatenate([[0], np.cumsum(width)])
        lo = 0
        while lo < len(left):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
            a = np.repeat(left[lo:hi], width[lo:hi])
            b = np.arange(len(a)) - np.repeat(upto[lo:hi] - upto[lo], width[lo:hi]) + np.repeat(first[lo:hi], width[lo:hi])
            a, b = a[a != b], b[a != b]
            f = lambda x, y: (x - y) * (x - y) // y
            v = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            key = (ids[a] << np.int64(32)) | ids[b]
            if lang in sums:
                key, v = np.concatenate([sums[lang][0], key]), np.concatenate([sums[lang][1], v])
            if len(key):
                order = np.argsort(key, kind="stable")
                key, v = key[order], v[order]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sums[lang] = key[at], np.add.reduceat(v, at)
            lo = hi

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (key, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> np.int64(32)), pa.array(key & np.int64(0xFFFFFFFF)), pa.array(v)], ["lang", "a", "b", "v"])
        sums.clear()

    def take(t: pa.Table, whole: bool) -> pa.Table | None:
        """Adds the terms of t that are complete and returns the rows of the last, which may go on."""
        lang, term = t.column("lang").combine_chunks(), t.column("term").combine_chunks()
        code_l, code_t = (x.dictionary_encode() for x in (lang, term))
        code_l, code_t = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (code_l, code_t))
        li, ti = code_l.indices.to_numpy(), code_t.indices.to_numpy()
        cuts = np.flatnonzero((li[1:] != li[:-1]) | (ti[1:] != ti[:-1])) + 1
        upto = len(li) if whole else int(cuts[-1]) if len(cuts) else 0
        ends = np.concatenate([cuts[cuts < upto], [upto]]) if upto else cuts[:0]
        ids, p, zero = (t.column(c).to_numpy() for c in ("id", "p", "zero"))
        begin = 0
        for end in [*ends[:-1][li[ends[:-1] - 1] != li[ends[:-1]]], upto] if upto else []:  # a language at a time
            own = ends[(ends > begin) & (ends <= end)] - begin
            add(code_l.dictionary[int(li[begin])].as_py(), own, ids[begin:end], p[begin:end], zero[begin:end])
            begin = int(end)
        return None if whole else t.slice(upto)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        rest = take(t, False) if t.num_rows else None
        if sum(len(k) for k, _ in sums.values()) > 4 * PAIRS:
            yield from out()
    if rest is not None and rest.num_rows:
        take(rest, True)
    yield from out()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source); see op12 for the values.

    part `pair`: every other source of the language, all ranks; part `term`: the terms that the
    source uses more than its language, TOP at most. Ties go to the item that is smaller in UTF-8.
    A source without kept terms has pairs and no terms; a language of one source has no pairs; an
    empty table gives no rows. Rows that are repeated count as often as they are there.
    """
    common.bound_batches(docs.sparkSession)
    kept, groups = postings(docs)
    vocab = kept.groupBy("lang", "term").agg(F.min("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    sources = groups.join(totals, ["lang", "source"], "left").join(vocab, "lang", "left")
    sources = sources.withColumns({c: F.coalesce(c, none) for c in ("total", "v", "lang_total")})
    sources = sources.withColumn("zero", part(0, "total", "v")).withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    sources = common.cut(sources)
    used = kept.join(sources, ["lang", "source"]).withColumn("p", part(F.col("n"), "total", "v"))
    # Terms that the source has more of than the language.
    q = part(F.col("lang_n"), "lang_total", "v")
    terms = used.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    # Pairs: the value of zero counts, what one source's terms change, and what is left where both have the term.
    a = sources.select("lang", "source", F.col("id").alias("a"), F.col("zero").alias("za"), "v")
    b = sources.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("zero").alias("zb"))
    base = a.join(b, "lang").where("a <> b").select("lang", "a", "b", (F.col("v") * gap("za", "zb")).alias("value"))
    counts = used.groupBy("lang", F.col("id").alias("i"), "zero", "p").agg(F.count(F.lit(1)).alias("m"))
    other = sources.select("lang", F.col("id").alias("j"), F.col("zero").alias("other"))
    single = counts.join(other, "lang").where("i <> j")
    forth = single.groupBy("lang", F.col("i").alias("a"), F.col("j").alias("b")).agg(F.sum(F.col("m") * (gap("p", "other") - gap("zero", "other"))).alias("value"))
    back = single.groupBy("lang", F.col("j").alias("a"), F.col("i").alias("b")).agg(F.sum(F.col("m") * (gap("other", "p") - gap("other", "zero"))).alias("value"))
    lists = used.select("lang", "term", "id", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = lists.mapInArrow(_shared, "lang string, a long, b long, value long")
    value = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = value.join(a.select("lang", "source", "a"), ["lang", "a"]).join(b.select("lang", "item", "b"), ["lang", "b"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))
