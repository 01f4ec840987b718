"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the embeddings of its subwords, which are runs of 1 to 4 code points inside
words, with the spaces around them; they share BUCKETS rows by hash. The model is trained by
stochastic gradient descent in numpy on a bounded sample; a part of the sample that it doesn't see
calibrates the scores and the score below which a prediction is rejected.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Rows and width of the embedding table, and the longest subword.
BUCKETS, DIM, LONGEST = 1 << 13, 16, 4
#: Rows that the model is fitted on, at most: dealt evenly over languages, in the order of a hash of
#: the text. A language whose rows don't come within this bound is not learned.
SAMPLE = 3000
#: The most frequent languages, whose rows are thinned out by hash before they are ranked for the sample.
FREQUENT = 1000
#: Passes over the sample, rows of a step, the first step's length; one row in CALIBRATION is kept for calibration.
EPOCHS, BATCH, RATE, CALIBRATION = 10, 16, 0.2, 5
#: The table's steps are so many times longer: a text's weights sum to one, so each row moves little.
TABLE_RATE = 4.0
#: Rejection: accepted predictions are to be right this often on the calibration rows.
PRECISION = 0.98
#: Code points of a text that one numpy step handles.
PIECE = 1 << 18
UNKNOWN = "und"


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it belongs to words (letters and their marks)."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    return kinds == "L", (kinds == "L") | (kinds == "M")


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash buckets of a whole text's subwords and how often each comes, None for a text without a letter."""
    if not text:
        return None
    letter, word = _classes()
    counts = np.zeros(BUCKETS, np.int64)
    any_letter, step = False, PIECE
    for lo in range(0, len(text), step):
        # A piece takes the code points before it along, so that no subword is lost between two.
        start = max(0, lo - LONGEST)
        c = np.frombuffer(text[start : lo + step].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter |= bool(letter[c].any())
        inside = word[c]
        first, last = int(start == 0), int(lo + step >= len(text))
        # A space stands before and after the whole text.
        c = np.pad(np.where(inside, c, 32).astype(np.uint64), (first, last), constant_values=32)
        inside = np.pad(inside, (first, last))
        skip = len(text[start:lo].lower()) + first if lo else 0
        h = np.zeros(len(c), np.uint64)
        plain = np.ones(len(c), bool)
        for n in range(1, LONGEST + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            # A subword may begin and end with a space, but holds letters and nothing between words.
            if n > 2:
                plain = plain[: len(c) - n + 1] & inside[n - 2 : -1]
            good = inside if n == 1 else inside[:-1] | inside[1:] if n == 2 else plain
            good = good.copy()
            good[: max(0, skip - n + 1)] = False  # counted with the piece before
            mixed = common.mix(h[good] + np.uint64(n))
            counts += np.bincount((mixed >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    if not any_letter:
        return None
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, key, text in zip(*[b.column(c).to_pylist() for c in ("lang", "key", "text")], strict=True):
            found = subwords(text)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([key]), pa.array([found[0].tobytes()], pa.binary()), pa.array([(found[1] / found[1].sum()).astype(np.float32).tobytes()], pa.binary())], ["lang", "key", "ids", "weights"])


class Model:
    """Languages, embeddings, output weights, temperature and the least score that is accepted."""

    def __init__(self, langs: list[str], table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.out, self.bias = langs, table, out, bias
        self.temperature, self.least = 1.0, 0.0

    def logits(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (weights @ self.table[ids]) @ self.out + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(langs: list[str], rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 13) -> Model:
    """Stochastic gradient descent on rows (language, ids, weights); each CALIBRATION-th row is left out
    and sets the temperature (least log loss) and the least accepted score."""
    rng = np.random.default_rng(seed)
    m = Model(langs, rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    held = rows[::CALIBRATION] if len(rows) >= 2 * CALIBRATION else []
    seen = [r for i, r in enumerate(rows) if i % CALIBRATION] if held else rows
    # At most SAMPLE x BUCKETS numbers of four bytes.
    x, want = np.zeros((len(seen), BUCKETS), np.float32), np.array([r[0] for r in seen])
    for i, (_, ids, weights) in enumerate(seen):
        x[i, ids] = weights
    steps = EPOCHS * -(-len(seen) // BATCH)
    for step in range(steps):
        if step % (steps // EPOCHS) == 0:
            order = rng.permutation(len(seen))
        some = order[step % (steps // EPOCHS) * BATCH :][:BATCH]
        rate = RATE * (1 - step / steps)
        hidden = x[some] @ m.table
        slope = m.score(hidden @ m.out + m.bias)
        slope[np.arange(len(some)), want[some]] -= 1
        back = slope @ m.out.T
        m.out -= rate * hidden.T @ slope
        m.bias -= rate * slope.mean(axis=0)
        m.table -= rate * TABLE_RATE * x[some].T @ back
    if held:
        logits, truth = np.array([m.logits(r[1], r[2]) for r in held]), np.array([r[0] for r in held])
        # A row that was never met may be wrong even if all of these are right.
        doubt = 1 / (len(held) + 2)

        def loss(t: float) -> float:
            m.temperature = t
            logs = np.log(np.maximum(m.score(logits), 1e-12))
            own = logs[np.arange(len(truth)), truth]
            rest = (logs.sum(axis=1) - own) / max(1, len(langs) - 1)
            return -float(((1 - doubt) * own + doubt * rest).mean())

        m.temperature = min(np.geomspace(0.05, 20, 121), key=loss)
        p = m.score(logits)
        top, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-top, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= PRECISION)
        m.least = float(top[order][good[-1]]) if len(good) else 1.0
    return m


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(*[b.column(c).to_pylist() for c in ("lang", "key", "ids", "weights")], strict=True)
    if rows:
        rows.sort()
        langs = sorted({r[0] for r in rows}, key=lambda s: s.encode())
        at = {s: i for i, s in enumerate(langs)}
        # The order is by text hash, so that calibration rows are of all languages.
        rows.sort(key=lambda r: r[1:])
        model = train(langs, [(at[lang], np.frombuffer(i, np.int32), np.frombuffer(w, np.float32).astype(np.float64)) for lang, _, i, w in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of labelled (text, lang), None where no row has both a language and a letter.

    Rows are ranked within their language by a hash of the text, and the sample takes the first of
    every language, then the second, until it is full: what reaches the one task that trains are
    sample rows of at most BUCKETS numbers, however large the table and however long the texts.
    """
    key = F.xxhash64("text").alias("key")
    rows = labelled.where("lang is not null and text is not null").select("lang", key, "text")
    # Ranks and the bound are found without the texts, which are read again for the rows chosen.
    # A hash below a share of all values leaves about four samples' rows of a frequent language to rank.
    n = labelled.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * sample)
    n = n.orderBy(F.desc("n"), "lang").limit(FREQUENT)
    low = F.shiftrightunsigned("key", 11) <= F.lit(float(1 << 53)) * F.lit(4.0 * sample) / F.col("n")
    lean = rows.select("lang", "key").join(F.broadcast(n), "lang", "left").where(F.coalesce(low, F.lit(True))).select("lang", "key").distinct()
    ranked = lean.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= sample)
    chosen = common.cut(ranked.orderBy("rank", "key", "lang").limit(sample).select("lang", "key"))
    some = rows.join(F.broadcast(chosen), ["lang", "key"], "left_semi")
    features = some.mapInArrow(_sampled, "lang string, key long, ids binary, weights binary").dropDuplicates(["lang", "key"])
    made = features.repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and lang_pred, score, accepted, of every whole text.

    Without a letter, or without a model, the language is `und`, with score 0, not accepted. score
    is the calibrated probability of lang_pred; accepted is whether it reaches the model's limit.
    Only text is looked at. Rows are independent, so repeated ones get equal predictions; columns
    of docs stay.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, sure = [], [], []
            texts = b.column("text")
            for i in range(b.num_rows):
                found = subwords(texts[i].as_py()) if m is not None else None
                if found is None:
                    langs.append(UNKNOWN), scores.append(0.0), sure.append(False)
                    continue
                p = m.score(m.logits(found[0], found[1] / found[1].sum()))
                at = int(p.argmax())
                langs.append(m.langs[at]), scores.append(float(p[at])), sure.append(bool(p[at] >= m.least))
            kept = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], [*[c for c in b.schema.names if c != "text"], "lang_pred", "score", "accepted"])

    schema = StructType([f for f in docs.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.mapInArrow(predict, schema)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on documents with a language whose crc32(doc_id) mod 5 isn't 0; a null id counts as empty text."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    common.bound_batches(spark)
    model = fit(docs.where("not held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model)
