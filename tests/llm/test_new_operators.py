"""Conversation trie, divergence audit and language identification against brute force, odd rows among them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import conversation_trie, divergence, language, queries
from pyspark.sql import functions as F

from ..harness import by_spark, by_sql

TURNS = "conv_id long, turn long, role string, text string, depth long, c string, key string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, key string"


def turn_rows():
    rnd = random.Random(4)
    rows = []
    for c in [*range(100, 140), 200, *range(203, 230), 305, -3, 7_000_000_123]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "é🙂", "one", "two", "three words here"])))
    rows += [(400, None, "user", "first"), (400, 0, "user", "second"), (400, 0, "user", "other"), (400, 0, "user", "second"), (None, 0, "user", "nobody"), (401, 5, None, None)]
    # Snapshots of one conversation, each a turn longer than the one before: a chain of ends.
    rows += [(1000 + i, t, "user", f"turn {t}") for i in range(1, 60) for t in range(i)]
    return [(*r, 1, "c", "k") for r in rows]


def brute_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        whole = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (c % 100 if c >= 0 else -(-c % 100))
            whole[c] = convs.get(base, [])[:h] + own[h:]
        convs = whole
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n]
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children(node)), sum(not children(n) for n in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_equals_brute_force(spark, rebuild):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    s = conversation_trie.numbered(df)
    got = conversation_trie.trie(*(conversation_trie.rebuilt(s) if rebuild else (s, s.select("conv_id").distinct())))
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows, rebuild)


def test_trie_peels_a_chain_in_few_rounds(spark):
    """100 snapshots: a chain of 100 links takes rounds by its logarithm."""
    rows = [(1000 + i, t, "user", f"turn {t}", 0, "", "") for i in range(1, 101) for t in range(i)]
    s = conversation_trie.numbered(spark.createDataFrame(rows, TURNS))
    peel = conversation_trie.peel
    try:
        conversation_trie.peel = lambda links: peel(links, 11)
        got = {r["depth"]: r for r in conversation_trie.trie(s, s.select("conv_id").distinct()).collect()}
    finally:
        conversation_trie.peel = peel
    assert len(got) == 101 and got[0]["n_convs"] == 100 and got[50]["n_leaves"] == 1
    assert got[99]["saved_tokens"] == len("turn 98")


def test_trie_splits_a_long_conversation(spark):
    rows = [(5, t, "user", f"x{t % 7}", 0, "", "") for t in range(3000)] + [(6, t, "user", f"x{t % 7}", 0, "", "") for t in range(2900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = conversation_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert s.where("conv_id = 5").select("block").distinct().count() > 1
    got = {r["depth"]: r for r in conversation_trie.trie(s, s.select("conv_id").distinct()).collect()}
    assert len(got) == 3001
    assert got[2900]["n_convs"] == 2 and got[2901]["n_convs"] == 1 and got[0]["saved_tokens"] == 2 * 2900


def test_trie_of_no_conversations(spark):
    s = conversation_trie.numbered(spark.createDataFrame([], TURNS))
    assert conversation_trie.trie(*conversation_trie.rebuilt(s)).count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_divergence"])
def test_queries_equal_sql(spark, name):
    d = "/root/testdata/sf0.001"
    columns, got = by_spark(queries.QUERIES[name](spark, d))
    names, wanted = by_sql(queries.ORACLES[name], d)
    assert sorted(columns) == sorted(names) and got == wanted


def doc_rows():
    rnd = random.Random(7)
    words = ["Alpha", "beta", "Γάμμα", "delta-x", "é", "the", "The", "ZZ9plural", "日本語", "a_b"]
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(words[: 3 + i % 8]) for _ in range(rnd.randint(0, 40)))
        rows.append((i, text, rnd.choice(["en", "de", None, ""]), rnd.choice(["s0", "s0", "s1", "Ü", None])))
    rows += [(70, None, "xx", "lonely"), (71, "", "xx", "other"), (None, "rare words only", "yy", "s"), (72, "the " * 3000 + "x" * 5000, "en", "s0"), rows[3], rows[3], (73, "Ä" * 50 + "\x00nul\x7fdel", "en", "s1")]
    return [(*r, 1, "t", "k") for r in rows]


def brute_audit(rows):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")), r[2] or "", r[3] or "") for r in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(t for words, own, _ in docs if own == lang for t in set(words))
        kept = {t for t, n in df.items() if n >= 3}
        v = len(kept)
        counts = {s: Counter(t for words, own, source in docs if (own, source) == (lang, s) for t in words if t in kept) for s in {d[2] for d in docs if d[1] == lang}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + v) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            out += [(lang, s, "pair", o.decode(), -n, i + 1) for i, (n, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -n, i + 1) for i, (n, t) in enumerate(terms[:200])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, small, monkeypatch):
    if small:  # parts and steps of a few rows
        for name, value in (("ENTRIES", 5), ("PAIRS", 3), ("PIECE", 16)):
            monkeypatch.setattr(divergence, name, value)
        counted = pa_batches(doc_rows(), divergence._count)
        assert sum(r["n"] for r in counted if r["term"] == "the") == sum(re.findall("[a-z]+", (r[1] or "").lower()).count("the") for r in doc_rows())
    df = spark.createDataFrame(doc_rows(), DOCS).repartition(5)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(doc_rows())


def pa_batches(rows, f):
    import pyarrow as pa

    table = pa.table({"text": [r[1] or "" for r in rows], "lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows]})
    return [r for b in f(iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist()]


def test_shared_corrections_in_small_steps(monkeypatch):
    """Postings that are cut by batches and by steps give the same sums."""
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    rows = sorted((lang, f"t{t}", int(i)) for lang in "ab" for t in range(20) for i in rnd.permutation(6)[: rnd.integers(1, 6)])
    p = rnd.integers(5, 10**9, len(rows))
    table = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "id": [r[2] for r in rows], "p": p, "zero": np.array([3 + r[2] for r in rows])})
    wanted = Counter()
    f = lambda x, y: (int(x) - int(y)) ** 2 // int(y)
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if x[:2] == y[:2] and x[2] != y[2]:
                wanted[x[0], x[2], y[2]] += f(p[i], p[j]) - f(p[i], 3 + y[2]) - f(3 + x[2], p[j]) + f(3 + x[2], 3 + y[2])
    for size, pairs in ((1000, 1 << 20), (1, 1), (7, 4)):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = Counter()
        for b in divergence._shared(iter(table.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                got[r["lang"], r["a"], r["b"]] += r["v"]
        assert got == wanted


def test_audit_of_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def brute_subwords(text):
    """Runs of 1 to 4 code points of letters, with a space around words, by plain loops."""
    import unicodedata

    c = [x if unicodedata.category(x)[0] in "LM" else " " for x in " " + text.lower() + " "]
    found = Counter()
    for n in range(1, language.LONGEST + 1):
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if " " not in g[1:-1] and any(x != " " for x in g) and (n > 1 or g != [" "]):
                found["".join(g)] += 1
    return found


@pytest.mark.parametrize("text", ["a", "Ab cd", "naïve. Ä1b", "x" * 40 + " yz " * 9, "日本 語", "1a2", "éa"])
def test_subwords_are_counted_whole_and_in_pieces(text, monkeypatch):
    ids, counts = language.subwords(text)
    assert counts.sum() == sum(brute_subwords(text).values())
    for piece in (1, 3, 5, 16):
        monkeypatch.setattr(language, "PIECE", piece)
        other = language.subwords(text)
        assert other[0].tolist() == ids.tolist() and other[1].tolist() == counts.tolist()


def test_language_of_held_out_texts(spark):
    rnd = random.Random(2)
    parts = {"aa": ["ban", "ko", "ri", "tem"], "bb": ["schu", "ver", "ung", "ei"], "cc": ["ção", "lhe", "ão", "que"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for i in range(240) for lang in [rnd.choice(sorted(parts))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "aa"), (903, "banko", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(df.where("doc_id % 5 <> 0").select("text", "lang"))
    assert model.langs == ["aa", "bb", "cc"]
    got = language.identify(df.select("doc_id", "text", F.lit(1).alias("score_2")), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows if i % 5 == 0 and i < 900)
    assert [(by[i]["lang_pred"], by[i]["score"], by[i]["accepted"]) for i in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert by[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    # A text that mixes languages is less certain than one of a single language.
    mixed = spark.createDataFrame([(1, "bankoko schuverung"), (2, rows[1][1])], "doc_id long, text string")
    a, b = (r["score"] for r in language.identify(mixed, model).orderBy("doc_id").collect())
    assert a < b


def test_language_samples_are_bounded_and_fits_repeat(spark):
    rows = [(f"text {chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    a, b = language.fit(df, sample=30), language.fit(df.repartition(5), sample=30)
    assert a.langs == ["l0", "l1", "l2"] and np.array_equal(a.table, b.table) and a.least == b.least


def test_language_without_labels(spark):
    df = spark.createDataFrame([("word", None), (None, "en"), ("12", "en")], "text string, lang string")
    assert language.fit(df) is None
    assert [r["lang_pred"] for r in language.identify(df.select("text"), None).collect()] == ["und"] * 3
    assert language.identify(df.select("text").limit(0), None).count() == 0
