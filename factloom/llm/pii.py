"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The patterns of the kinds. Possessive quantifiers and the condition that a match
# begins where its first run of characters begins, or at the end of the match before, change no
# match; they keep the work linear in the text and the matcher's stack flat. Digits with single
# separators between them match as a whole run, so that runs of 16 to 19 are found at once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}|sk-[A-Za-z0-9_-]{20,200}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "secret": r"(?i)(?<![a-z0-9])(?:(?:api|access|auth|client|encryption|master|private|refresh|secret|session|shared|signing)[ _-]?(?:key|token|secret)|token|secret|passw(?:or)?d|pwd|credential)s?[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?:[a-z0-9_+/.!@#$%^*~-]|&(?![a-z0-9_.-]{1,40}=)){8,4000}={0,2}",
}
#: Lengths of account numbers by country, as registered. Other countries' may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Code points that hold the longest one with its spaces and the character after it.
IBAN_ROOM = 48
#: Code points of a chunk of text, and numbers of a part of an array that grows.
CHUNK, BLOCK = 256, 256
#: A text without this can't hold the kind; much cheaper to look for.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Score of a confirmed span, and what a context word shortly before or after it adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.4, "key": 0.8, "secret": 0.6}
CONTEXT = {
    "email": "e-?mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
    "key": "key|secret|token|credential",
    "secret": "key|secret|login|user|auth|credential",
}
#: Bits a character that a secret's characters have at least; words and repeated signs have less.
ENTROPY = 2.8
BASE, BONUS, WINDOW, LEAST = ("email", "ip", "card", "phone"), 0.1, 40, 0.5
#: Kinds that only a context word lifts over LEAST get this instead of BONUS.
STRONG_BONUS = {"ssn": 0.4}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(F.pmod(i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10)) == 0


def mod97(m: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    flat = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def piece(chunks: Column, start: Column, n: Column) -> Column:
    """n code points from start on of the text that falls into chunks: work is by n, not by start."""
    first = F.floor(start / CHUNK).cast("int")
    parts = F.floor((start + n) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, parts), ""), (start - first * CHUNK + 1).cast("int"), n.cast("int"))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of values (an array of int) what merge makes of 0 and all before it.

    Arrays are copied as they grow, so parts of BLOCK numbers grow on their own and are then joined.
    values must be a column, as it is looked at again for each part.
    """
    none = F.array().cast("array<int>")

    def part(acc: Column, b: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        step = lambda a, v: F.struct(merge(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), start, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), part, lambda a: a["out"])


def _iban_ends(chunks: Column, start: Column) -> Column:
    """The account number that begins at start, or null.

    The pattern finds country and check digits only. A number ends at the length of its country,
    or, where none is registered, at the furthest end of a group where mod-97 holds.
    """
    known = "|".join(IBAN_LENGTHS[n].replace(" ", "|") for n in IBAN_LENGTHS)

    def of(length: int) -> str:
        groups, rest = divmod(length - 4, 4)
        named = IBAN_LENGTHS.get(length, "").replace(" ", "|")
        country = f"(?:(?!{known})[A-Z]{{2}}{'|' if named else ''}{named})"
        return rf"^{country}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9])"

    patterns = F.array(*[F.lit(of(n)) for n in range(35, 11, -1)])
    room = piece(chunks, start, F.lit(IBAN_ROOM))
    found = F.filter(F.transform(patterns, lambda p: F.regexp_substr(room, p)), lambda m: F.when(m.isNotNull(), mod97(m)).otherwise(F.lit(False)))
    return F.get(found, F.lit(0))


def _apart(spans: Column) -> Column:
    """spans (m, start), in order, of which none begins within one that is kept before it."""
    none = F.array().cast("array<boolean>")

    def add(acc: Column, x: Column) -> Column:
        free = acc["at"] <= x["start"]
        return F.struct(F.when(free, x["start"] + F.length(x["m"])).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(free)).alias("out"))

    flags = F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])
    kept = F.filter(F.arrays_zip(spans.alias("x"), flags.alias("free")), lambda x: x["free"])
    return F.transform(kept, lambda x: x["x"])


def entropy(value: Column) -> Column:
    """Bits a character: of the distribution of the characters of value (not empty) among themselves."""
    n = F.length(value).cast("double")

    def add(acc: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return acc - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), add)


def secret_value(m: Column) -> Column:
    """The value at the end of an assignment."""
    return F.regexp_substr(m, F.lit("[A-Za-z0-9_+/.!@#$%^*~&-]+={0,2}$"))


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(m, r"\."), lambda p: F.when(small(p), F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    if kind == "key":
        return m.startswith("-----") | (entropy(m) >= ENTROPY)
    if kind == "secret":
        value = secret_value(m)
        return F.coalesce(value.rlike("[0-9]") & (F.length(value) >= 8) & (entropy(value) >= ENTROPY), F.lit(False))
    return F.lit(True)


def _spans(kind: str, chunks: Column, found: Column) -> Column:
    """The kind's spans in text order: array of (kind, start, end, score), in code points, end exclusive.

    found is array of (m, start), the matches of the kind's pattern.
    """
    if kind == "iban":
        found = F.transform(found, lambda x: F.struct(_iban_ends(chunks, x["start"]).alias("m"), x["start"].alias("start")))
        kept = _apart(F.filter(found, lambda x: x["m"].isNotNull()))
    else:
        kept = F.filter(found, lambda x: _confirmed(kind, x["m"]))
    if kind == "secret":  # the span is the value alone
        kept = F.transform(kept, lambda x: F.struct(secret_value(x["m"]).alias("m"), (x["start"] + F.length(x["m"]) - F.length(secret_value(x["m"]))).alias("start")))

    def scored(x: Column) -> Column:
        lo = F.greatest(F.lit(0), x["start"] - WINDOW)
        end = x["start"] + F.length(x["m"])
        near = F.lower(F.concat(piece(chunks, lo, x["start"] - lo), F.lit(" "), piece(chunks, end, F.lit(WINDOW))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), F.lit(STRONG_BONUS.get(kind, BONUS))).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(kept, scored)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= LEAST)


def _there(kind: str, text: Column) -> Column:
    """Whether text can hold the kind at all."""
    there = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    there = there & text.rlike("[0-9]") if kind not in ("email", "key") else there
    return there & text.rlike("[:=]") if kind == "secret" else there


def with_spans(df: DataFrame) -> DataFrame:
    """df, which has a text without nulls, with spans and with chunks, its text in parts of CHUNK code points.

    Matches, the lengths of what lies between them, their sums and the spans are columns of one
    projection after another: what a lambda looks at again and again must be computed before it.
    """
    text, own = F.col("text"), df.columns
    none = F.array()
    m = {f"m_{k}": F.when(_there(k, text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none.cast("array<string>")) for k in PATTERNS}
    gaps = {f"g_{k}": F.when(_there(k, text), F.transform(F.split(text, PATTERNS[k], -1), F.length)).otherwise(none.cast("array<int>")) for k in PATTERNS}
    steps = {f"s_{k}": F.zip_with(f"g_{k}", f"m_{k}", lambda g, x: g + F.coalesce(F.length(x), F.lit(0))) for k in PATTERNS}
    at = {f"a_{k}": running(F.col(f"s_{k}"), lambda x, y: x + y) for k in PATTERNS}
    step = df.withColumns({"chunks": F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))} | m | gaps).withColumns(steps).withColumns(at)

    def found(k: str) -> Column:
        zipped = F.filter(F.arrays_zip(F.col(f"m_{k}").alias("m"), F.col(f"g_{k}").alias("g"), F.col(f"a_{k}").alias("a")), lambda x: x["m"].isNotNull())
        return F.transform(zipped, lambda x: F.struct(x["m"].alias("m"), (x["g"] + x["a"]).alias("start")))

    return step.select(*own, "chunks", F.concat(*[_spans(k, F.col("chunks"), found(k)) for k in PATTERNS]).alias("spans"))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score), by kind as in PATTERNS, then start.

    Base kinds (email, ip, card, phone) keep every confirmed match; further kinds (iban, ssn, key,
    secret) keep those whose score, raised by a context word within WINDOW code points before or
    after, is LEAST or more. A secret is the value given to a token, password or key; it has a
    digit and ENTROPY bits a character, as have keys, which are known by how they begin.
    Null text counts as empty; rows repeated or with null ids are rows like others; an empty table
    gives no rows.
    """
    docs = common.ensure_text(df, id_col, text_col)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return with_spans(docs).select("doc_id", "spans")


def masked(df: DataFrame) -> DataFrame:
    """df, as with_spans gives it, with each span, or run of overlapping spans, replaced by <KIND> of its first."""
    own = [c for c in df.columns if c not in ("text", "chunks", "spans")]
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = df.withColumn("ordered", ordered).withColumn("ends", F.transform("ordered", lambda s: s["end"]))
    step = step.withColumn("before", running(F.col("ends"), F.greatest))
    kept = F.transform(F.arrays_zip("ordered", "before"), lambda x: F.when(x["ordered"]["start"] >= x["before"], F.concat(piece(F.col("chunks"), x["before"], x["ordered"]["start"] - x["before"]), F.lit("<"), F.upper(x["ordered"]["kind"]), F.lit(">"))).otherwise(F.lit("")))
    last = F.array_max("ends")
    whole = F.concat(F.array_join(kept, ""), piece(F.col("chunks"), last, F.length("text") - last))
    return step.select(*own, F.when(F.size("spans") > 0, whole).otherwise(F.col("text")).alias("text"))


def redact(df: DataFrame) -> DataFrame:
    """df with the personal data in its text masked and n_chars counted again; null text stays null.

    Rows repeated are each masked, and alike; an empty table gives no rows; columns of any name
    stay as they are.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = masked(with_spans(rows)).withColumn("text", F.when(F.col("row.text").isNotNull(), F.col("text")))
    return out.select(*[(F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in df.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line(of(BASE)), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in PATTERNS if k not in BASE], F.size("spans").cast("long").alias("n_spans"))
