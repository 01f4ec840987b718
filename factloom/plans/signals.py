"""The review operators applied to the driver tables, each with SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify, findings, fragments, graphs, identifiers, percentiles, references, similarity, sizes
from ..runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- percentiles and sizes -------------------------------------------------------------------


@query("""
WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, n AS population, n_chars AS cutoff FROM r WHERE rn = greatest(ceil(90::DOUBLE / 100 * n), 1)::BIGINT""")
def nearest_rank_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "n_chars", "doc_id")
    return percentiles.cutoffs(docs, ["source"], "n_chars", F.lit(90), ["doc_id"])


@query("""
WITH r AS (SELECT source, source IN ('src1', 'src3', 'src5') AS test, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, CASE WHEN test THEN 'Tests' ELSE 'Production' END AS role, n AS population, n_chars AS cutoff FROM r
WHERE rn = greatest(ceil((CASE WHEN test THEN 75 ELSE 90 END)::DOUBLE / 100 * n), 1)::BIGINT""")
def role_split_options(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "n_chars", "doc_id")
    test = F.col("source").isin("src1", "src3", "src5")
    out = percentiles.cutoffs(docs, ["source"], "n_chars", F.when(test, 75).otherwise(90), ["doc_id"])
    return out.select("source", F.when(test, "Tests").otherwise("Production").alias("role"), "population", "cutoff")


_MEASURED = """
m AS (SELECT source, lang, doc_id, n_chars, len(string_split(text, chr(10))) AS lines,
  length(text) - length(replace(text, '.', '')) AS sentences, length(text) - length(replace(text, ',', '')) AS commas FROM documents)"""


def _measured(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "source", "lang", "doc_id", "n_chars",
        F.size(F.split("text", "\n", -1)).cast("long").alias("lines"),
        (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("sentences"),
        (F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))).cast("long").alias("commas"),
    )


@query(f"""
WITH {_MEASURED},
r AS (SELECT *, count(*) OVER (PARTITION BY source) AS population,
  row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS ra, row_number() OVER (PARTITION BY source ORDER BY lines, doc_id) AS rb,
  rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS first_rank, rank() OVER (PARTITION BY source ORDER BY lines DESC) AS second_rank FROM m),
c AS (SELECT *, greatest(8, max(CASE WHEN ra = greatest(ceil(90::DOUBLE / 100 * population), 1)::BIGINT THEN n_chars END) OVER (PARTITION BY source)) AS first_cutoff,
  greatest(4, max(CASE WHEN rb = greatest(ceil(90::DOUBLE / 100 * population), 1)::BIGINT THEN lines END) OVER (PARTITION BY source)) AS second_cutoff FROM r)
SELECT source, doc_id, n_chars, lines, population, first_cutoff::BIGINT AS first_cutoff, second_cutoff::BIGINT AS second_cutoff, first_rank, second_rank
FROM c WHERE (n_chars >= first_cutoff AND sentences >= 2) OR lines >= second_cutoff""")
def outliers_two_metric(spark: SparkSession, d: str) -> DataFrame:
    out = percentiles.outliers(_measured(spark, d), ["source"], "n_chars", "lines", "sentences", ["doc_id"], F.lit(90))
    return out.select("source", *long("doc_id", "n_chars", "lines", "population", "first_cutoff", "second_cutoff", "first_rank", "second_rank"))


@query(f"""
WITH {_MEASURED},
r AS (SELECT *, count(*) OVER (PARTITION BY source) AS population, row_number() OVER (PARTITION BY source ORDER BY lines, doc_id) AS rn FROM m),
c AS (SELECT *, max(CASE WHEN rn = greatest(ceil(90::DOUBLE / 100 * population), 1)::BIGINT THEN lines END) OVER (PARTITION BY source) AS cutoff FROM r),
f AS (SELECT source, doc_id, lines, population, cutoff,
  lines >= 10 AND lines >= cutoff AND ((commas >= 8 AND sentences >= 2) OR lines // 5 >= 4) AS by_group, lines >= 40 AS by_extreme FROM c)
SELECT * FROM f WHERE by_group OR by_extreme""")
def size_member_paths(spark: SparkSession, d: str) -> DataFrame:
    m = _measured(spark, d).withColumns({"decisions": F.col("commas"), "constructs": F.col("sentences"), "nesting": F.expr("lines div 5")})
    out = sizes.select_members(m, ["source"], ["doc_id"], F.lit(90), least=10, extreme=40)
    return out.select("source", *long("doc_id", "lines", "population", "cutoff"), "by_group", "by_extreme")


@query(f"""
WITH {_MEASURED},
t AS (SELECT lang, source, sum(lines)::BIGINT AS lines, count(*) AS parts FROM m GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS population, row_number() OVER (PARTITION BY lang ORDER BY lines, source) AS rn FROM t),
c AS (SELECT *, max(CASE WHEN rn = greatest(ceil(90::DOUBLE / 100 * population), 1)::BIGINT THEN lines END) OVER (PARTITION BY lang) AS cutoff FROM r),
f AS (SELECT lang, source, lines, parts, population, cutoff, lines >= 60 AND lines >= cutoff AS by_group, lines >= 300 AS by_extreme FROM c)
SELECT * FROM f WHERE by_group OR by_extreme""")
def size_type_paths(spark: SparkSession, d: str) -> DataFrame:
    out = sizes.select_types(_measured(spark, d), ["lang"], ["source"], F.lit(90), least=60, extreme=300)
    return out.select("lang", "source", *long("lines", "parts", "population", "cutoff"), "by_group", "by_extreme")


@query(r"""
WITH f AS (SELECT page_id, len(regexp_split_to_array(html, '\r\n|[\n\r\x{85}\x{2028}\x{2029}]')) AS lines, strlen(html) AS utf8_bytes, html FROM pages)
SELECT page_id, lines, utf8_bytes, lines >= 2 AS by_lines, utf8_bytes >= 6000 AS by_bytes FROM f
WHERE regexp_matches(html, '\S') AND (lines >= 2 OR utf8_bytes >= 6000)""")
def size_file_paths(spark: SparkSession, d: str) -> DataFrame:
    out = sizes.select_files(table(spark, d, "pages"), "html", extreme_lines=2, extreme_bytes=6000)
    return out.select("page_id", *long("lines", "utf8_bytes"), "by_lines", "by_bytes")


@query(r"""
SELECT doc_id, count(*) AS code_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '[^\s]') GROUP BY doc_id""")
def code_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("start_line", "line"))
    return sizes.distinct_lines(rows.where(F.col("line").rlike(r"\S")), ["doc_id"])


# --- classification --------------------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, 'src/' || source || CASE doc_id % 4 WHEN 0 THEN '/A.g.cs' WHEN 1 THEN '/OBJ/B.cs' ELSE '/C.cs' END AS path,
  CASE WHEN doc_id % 10 = 3 THEN '// <Auto-Generated>' || chr(10) || text ELSE text END AS text FROM documents)
SELECT doc_id, path, contains(lower(path), '/obj/') OR starts_with(lower(path), 'obj/')
  OR ends_with(lower(path), '.g.cs') OR ends_with(lower(path), '.g.i.cs') OR ends_with(lower(path), '.generated.cs') OR ends_with(lower(path), '.designer.cs')
  OR contains(lower(array_to_string(string_split(text, chr(10))[1:5], chr(10))), '<auto-generated') AS generated FROM p""")
def generated_filter(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 4
    name = F.when(i == 0, "/A.g.cs").when(i == 1, "/OBJ/B.cs").otherwise("/C.cs")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("src/"), "source", name).alias("path"), F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("// <Auto-Generated>\n"), "text")).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", "path", classify.is_generated(F.col("path"), F.col("text")).alias("generated"))


@query(r"""
WITH p AS (SELECT s_suppkey, 'Acme' || CASE s_suppkey % 6 WHEN 0 THEN 'Tests' WHEN 1 THEN '.spec' WHEN 2 THEN 'latest' WHEN 3 THEN 'UnitTests' WHEN 4 THEN 'Contest' ELSE '' END AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'src/' ELSE 'lib/' END || 'P' || s_suppkey || '.csproj' AS path,
  CASE WHEN s_suppkey % 7 = 0 THEN ['/lib/XUnit.core.dll', '/lib/a.dll'] ELSE ['/lib/a.dll'] END AS refs FROM supplier),
s AS (SELECT *, ['Tests', 'Test', 'UnitTests', 'UnitTest', 'IntegrationTests', 'IntegrationTest', 'FastTests', 'ComponentTests', 'TestKit', 'Specs', 'Spec'] AS suffixes,
  regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', '') AS file FROM p),
c AS (SELECT s_suppkey, name, path, CASE
  WHEN len(list_filter(refs, lambda r: regexp_matches(lower(list_last(string_split(r, '/'))), '^(xunit|nunit|mstest)'))) > 0 THEN 'TestReferenceAssembly'
  WHEN len(list_filter(suffixes, lambda x: ends_with(lower(name), lower(x)) AND (length(name) = length(x) OR name[length(name) - length(x)] = '.' OR regexp_matches(name[length(name) - length(x) + 1], '^\p{Lu}')))) > 0 THEN 'ProjectNameSuffix'
  WHEN len(list_filter(suffixes, lambda x: ends_with(lower(file), lower(x)) AND (length(file) = length(x) OR file[length(file) - length(x)] = '.' OR regexp_matches(file[length(file) - length(x) + 1], '^\p{Lu}')))) > 0 THEN 'ProjectFileNameSuffix'
  WHEN list_has_any(string_split(lower(path), '/'), ['test', 'tests', 'unittests', 'integrationtests', 'fasttests', 'componenttests', 'testkit', 'spec', 'specs']) THEN 'ProjectPathSegment'
  ELSE 'NoTestMarker' END AS reason FROM s)
SELECT s_suppkey, name, path, CASE WHEN reason = 'NoTestMarker' THEN 'Production' ELSE 'Tests' END AS role, reason FROM c""")
def classify_role(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    ends = ["Tests", ".spec", "latest", "UnitTests", "Contest"]
    name = F.lit("")
    for i, e in enumerate(ends):
        name = F.when(k % 6 == i, e).otherwise(name)
    folder = F.when(k % 5 == 0, "Tests/").when(k % 5 == 1, "src/").otherwise("lib/")
    refs = F.when(k % 7 == 0, F.array(F.lit("/lib/XUnit.core.dll"), F.lit("/lib/a.dll"))).otherwise(F.array(F.lit("/lib/a.dll")))
    p = table(spark, d, "supplier").select(k, F.concat(F.lit("Acme"), name).alias("name"), F.concat(folder, F.lit("P"), k.cast("string"), F.lit(".csproj")).alias("path"), refs.alias("refs"))
    role, reason = classify.project_role(F.col("name"), F.col("path"), F.col("refs"))
    return p.select("s_suppkey", "name", "path", role.alias("role"), reason.alias("reason"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, path, NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AND NOT contains(path, chr(92)) AS canonical FROM p""")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return p.select("page_id", "path", classify.is_canonical_path(F.col("path")).alias("canonical"))


# --- identifiers -----------------------------------------------------------------------------


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents),
c AS (SELECT doc_id, word, regexp_extract(regexp_replace(word, '^@', ''), '[^A-Za-z0-9_]') AS character FROM w WHERE word <> '')
SELECT * FROM c WHERE character <> ''""")
def non_ascii_first(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.filter(F.split("text", "[ \n]+", -1), lambda x: x != "")))
    rows = table(spark, d, "documents").select("doc_id", words.alias("word"))
    return rows.withColumn("character", identifiers.offending(F.col("word"))).where("character is not null")


@query("""
WITH w AS (SELECT DISTINCT doc_id, source, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents),
c AS (SELECT *, regexp_extract(regexp_replace(word, '^@', ''), '[^A-Za-z0-9_]') AS character FROM w WHERE word <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source, character ORDER BY doc_id, word) AS rn FROM c WHERE character <> '')
SELECT doc_id, source, word, character, CASE WHEN rn > 1 THEN 'identifier:' || doc_id ELSE 'identifier' END AS discriminator FROM r""")
def identifier_findings(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.filter(F.split("text", "[ \n]+", -1), lambda x: x != "")))
    rows = table(spark, d, "documents").select("doc_id", "source", words.alias("word"))
    return identifiers.findings(rows, ["source", "character"], "word", "doc_id", ["doc_id", "word"]).select("doc_id", "source", "word", "character", "discriminator")


# --- n-grams and similarity ------------------------------------------------------------------

_GRAMS = r"""
t AS (SELECT doc_id AS id, regexp_extract_all(text, '(\w+|[^\w\s])') AS tk FROM documents),
k AS (SELECT id, unnest(tk) AS w, unnest(range(1, len(tk) + 1)) AS p FROM t WHERE len(tk) >= 30),
l AS (SELECT id, concat_ws(chr(1), w, lead(w, 1) OVER q, lead(w, 2) OVER q, lead(w, 3) OVER q, lead(w, 4) OVER q) AS gram, lead(w, 4) OVER q AS fifth FROM k WINDOW q AS (PARTITION BY id ORDER BY p)),
g AS MATERIALIZED (SELECT DISTINCT id, hash(gram) AS gram FROM l WHERE fifth IS NOT NULL),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""
_PAIRS = (
    _GRAMS
    + """,
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT a, b, shared, shared / (sa.n + sb.n - shared)::DOUBLE AS score FROM p JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b)"""
)


@query(f"""
WITH {_GRAMS} SELECT t.id AS doc_id, len(tk) AS n_tokens, s.n AS n_grams FROM t JOIN s ON s.id = t.id""")
def ngram_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", similarity.tokens(F.col("text")).alias("tk"))
    return docs.where(F.size("tk") >= 30).select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size(similarity.ngrams(F.col("tk"))).cast("long").alias("n_grams"))


def _pairs(spark: SparkSession, d: str, level: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", similarity.tokens(F.col("text")).alias("tk"))
    return similarity.similar_pairs(similarity.gram_sets(docs, "doc_id", "tk"), similarity.LEVELS[level])


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE score >= 0.95")
def jaccard_exact(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "exact")


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE score >= 0.8")
def jaccard_near(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "near")


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE score >= 0.65")
def jaccard_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "fuzzy")


@query(f"""
WITH RECURSIVE {_PAIRS},
q AS MATERIALIZED (SELECT a, b, score FROM e WHERE score >= 0.8),
l2 AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
r AS (SELECT a AS node, a AS other FROM l2 UNION SELECT r.node, l2.b FROM r JOIN l2 ON l2.a = r.other),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
m AS (SELECT root, min(score) AS score FROM q JOIN c ON c.node = q.a GROUP BY root)
SELECT c.root AS cluster_id, node AS member, score FROM c JOIN m ON m.root = c.root""")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.clusters(_pairs(spark, d, "near"))


# --- fragments -------------------------------------------------------------------------------

_RUNS = r"""
ls AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal FROM documents),
many AS (SELECT line FROM ls WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1),
i AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS tokens, trim(line) <> '' AND line IN (SELECT line FROM many) AS own FROM ls),
ok AS MATERIALIZED (SELECT * FROM (SELECT *, sum(CASE WHEN own THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS island FROM i) WHERE own),
w AS (SELECT a.doc_id, a.ordinal AS first, b.ordinal AS last FROM ok a JOIN ok b ON a.doc_id = b.doc_id AND a.island = b.island AND b.ordinal >= a.ordinal + 2),
f AS (SELECT w.doc_id, w.first, w.last, sum(tokens)::BIGINT AS tokens, sha256(string_agg(length(line) || ':' || line, '' ORDER BY ordinal)) AS grp
  FROM w JOIN ok ON ok.doc_id = w.doc_id AND ok.ordinal BETWEEN w.first AND w.last GROUP BY ALL HAVING sum(tokens) >= 60),
o AS (SELECT grp, count(DISTINCT doc_id) AS owners, count(*) AS occurrences FROM f GROUP BY grp HAVING count(DISTINCT doc_id) > 1),
g AS MATERIALIZED (SELECT f.*, owners, occurrences FROM f JOIN o ON o.grp = f.grp)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "form"))
    tokens = (F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1).cast("long")
    statements = rows.select("doc_id", F.lit(0).alias("list_id"), (F.col("p") + 1).cast("long").alias("ordinal"), "form", tokens.alias("tokens"), (F.trim("form") != "").alias("eligible"))
    return fragments.groups(fragments.shared_windows(statements, ["doc_id"], 3, 60), ["doc_id"], once=True)


@query(f"WITH {_RUNS} SELECT grp, doc_id, first, last, tokens, owners, occurrences FROM g")
def fragments_exact(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select(F.col("group").alias("grp"), "doc_id", *long("first", "last", "tokens", "owners", "occurrences"))


_RENAMED = r"""
ls AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal FROM documents),
tw AS (SELECT doc_id, ordinal, unnest(list_prepend(chr(10), string_split(line, ' '))) AS word, unnest(range(0, len(string_split(line, ' ')) + 1)) AS k FROM ls WHERE trim(line) <> ''),
tp AS (SELECT *, regexp_full_match(word, '\pL{7,}') AS ph, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, k) AS pos FROM tw),
tk AS MATERIALIZED (SELECT *, CASE WHEN ph THEN lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) END AS prev, min(pos) OVER (PARTITION BY doc_id, ordinal) AS begins FROM tp),
st AS MATERIALIZED (SELECT doc_id, ordinal, begins, count(*) - 1 AS tokens FROM tk GROUP BY ALL),
a3 AS (SELECT doc_id, ordinal AS first, begins FROM st WHERE (doc_id, ordinal + 1) IN (SELECT (doc_id, ordinal) FROM st) AND (doc_id, ordinal + 2) IN (SELECT (doc_id, ordinal) FROM st)),
f3 AS (SELECT a3.doc_id, first, md5(string_agg(CASE WHEN ph THEN 'L' || CASE WHEN prev >= a3.begins THEN pos - prev ELSE 0 END || ':' || right(word, 1) ELSE length(word) || ':' || word END, '' ORDER BY pos)) AS form
  FROM a3 JOIN tk ON tk.doc_id = a3.doc_id AND tk.ordinal BETWEEN first AND first + 2 GROUP BY ALL),
s3 AS (SELECT doc_id, first FROM f3 WHERE form IN (SELECT form FROM f3 GROUP BY form HAVING count(DISTINCT doc_id) > 1)),
ok AS MATERIALIZED (SELECT doc_id, ordinal, begins, tokens, ordinal - row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS island FROM st WHERE EXISTS (SELECT 1 FROM s3 WHERE s3.doc_id = st.doc_id AND st.ordinal BETWEEN s3.first AND s3.first + 2)),
ru AS (SELECT a.doc_id, a.begins, a.ordinal AS first, b.ordinal AS last FROM ok a JOIN ok b ON a.doc_id = b.doc_id AND a.island = b.island AND b.ordinal >= a.ordinal + 2),
rt AS MATERIALIZED (SELECT ru.doc_id, ru.begins, first, last, sum(tokens)::BIGINT AS tokens FROM ru JOIN ok ON ok.doc_id = ru.doc_id AND ok.ordinal BETWEEN first AND last GROUP BY ALL HAVING sum(tokens) >= 40),
rf AS (SELECT rt.doc_id, first, last, tokens, md5(string_agg(CASE WHEN ph THEN 'L' || CASE WHEN prev >= rt.begins THEN pos - prev ELSE 0 END || ':' || right(word, 1) ELSE length(word) || ':' || word END, '' ORDER BY pos)) AS form
  FROM rt JOIN tk ON tk.doc_id = rt.doc_id AND tk.ordinal BETWEEN first AND last GROUP BY ALL),
rg AS (SELECT form, count(DISTINCT doc_id) AS owners, count(*) AS occurrences FROM rf GROUP BY form HAVING count(DISTINCT doc_id) > 1)"""


@query(f"WITH {_RENAMED} SELECT doc_id, first, last, tokens, owners, occurrences FROM rf JOIN rg USING (form)")
def fragments_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines that are equal but for long words, each standing for a local whose type is its last letter."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    none = F.lit(None).cast("string")
    local = lambda w: w.rlike(r"^\p{L}{7,}$")
    words = F.transform(F.split("line", " ", -1), lambda w: F.struct(F.when(local(w), "L").alias("category"), w.alias("text"), F.when(local(w), w).alias("symbol"), F.when(local(w), F.right(w, F.lit(1))).alias("type_key")))
    begin = F.array(F.struct(none.alias("category"), F.lit("\n").alias("text"), none.alias("symbol"), none.alias("type_key")))
    no = F.lit(False)
    statements = rows.select("doc_id", F.lit(0).alias("list_id"), (F.col("p") + 1).cast("long").alias("ordinal"), F.size(words).cast("long").alias("tokens"), (F.trim("line") != "").alias("eligible"), F.concat(begin, words).alias("parts"), no.alias("nested_executable"), no.alias("binding_barrier"))
    runs = fragments.shared_windows(fragments.barred(statements), ["doc_id"], 3, 40)
    return fragments.groups(runs, ["doc_id"], once=True).select("doc_id", *long("first", "last", "tokens", "owners", "occurrences"))


@query(f"""
WITH {_RUNS},
c AS (SELECT x.grp AS small, y.grp AS large, x.occurrences AS needed, count(DISTINCT (x.doc_id, x.first, x.last)) AS n
  FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.first >= y.first AND x.last <= y.last AND x.last - x.first < y.last - y.first GROUP BY ALL)
SELECT grp, doc_id, first, last, tokens, owners, occurrences FROM g WHERE grp NOT IN (SELECT small FROM c WHERE n = needed)""")
def fragments_maximal(spark: SparkSession, d: str) -> DataFrame:
    out = fragments.maximal(_runs(spark, d), ["doc_id"])
    return out.select(F.col("group").alias("grp"), "doc_id", *long("first", "last", "tokens", "owners", "occurrences"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS p FROM documents),
f AS (SELECT *, min(p) OVER (PARTITION BY doc_id, word) AS first FROM w),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS number FROM f)
SELECT doc_id, string_agg('L' || number, ',' ORDER BY p) AS form FROM n GROUP BY doc_id""")
def fragment_normalized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return fragments.normalized(docs, ["doc_id"], F.split("text", " ", -1), "L")


# --- nesting ---------------------------------------------------------------------------------

_TAGS = r"""
t AS (SELECT page_id, regexp_extract_all(html, '</?[A-Za-z][A-Za-z0-9]*') AS t FROM pages),
u AS (SELECT page_id, unnest(t) AS tag, unnest(range(1, len(t) + 1)) AS ordinal FROM t),
v AS (SELECT page_id, ordinal, tag, CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS step FROM u WHERE lower(ltrim(tag, '</')) NOT IN ('br', 'hr', 'img', 'input', 'link', 'meta')),
n AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY ordinal) AS depth FROM v)"""


def _tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.posexplode(F.regexp_extract_all("html", F.lit("(</?[A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    rows = table(spark, d, "pages").select("page_id", tags.alias("p", "tag")).withColumn("ordinal", (F.col("p") + 1).cast("long"))
    rows = rows.where(~F.lower(F.regexp_replace("tag", "^</?", "")).isin("br", "hr", "img", "input", "link", "meta"))
    rows = rows.withColumn("step", F.when(F.col("tag").startswith("</"), -1).otherwise(1))
    return rows.withColumn("depth", graphs.running_depth(F.col("step"), ["page_id"], ["ordinal"]))


@query(f"WITH {_TAGS} SELECT page_id, ordinal, tag, depth::BIGINT AS depth FROM n")
def nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("page_id", "ordinal", "tag", F.col("depth").cast("long"))


@query(f"""
WITH {_TAGS},
o AS (SELECT page_id, count(*) FILTER (step = 1) AS decisions, count(DISTINCT tag) AS constructs, max(depth)::BIGINT AS max_nesting FROM n GROUP BY page_id),
f AS (SELECT page_id, ordinal, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, ordinal) AS rn FROM n)
SELECT o.*, f.ordinal AS deepest_line FROM o JOIN f ON f.page_id = o.page_id AND rn = 1""")
def deepest_token(spark: SparkSession, d: str) -> DataFrame:
    rows = _tags(spark, d).select("page_id", "ordinal", F.col("ordinal").alias("line"), "depth", F.col("tag").alias("construct_id"), (F.col("step") == 1).cast("int").alias("counts"))
    return sizes.decision_metrics(rows, ["page_id"]).select("page_id", *long("decisions", "constructs", "max_nesting", "deepest_line"))


# --- graphs ----------------------------------------------------------------------------------


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def edge_witness_min(spark: SparkSession, d: str) -> DataFrame:
    out = graphs.witnesses(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


_NATIONS = """
x AS (SELECT c_nationkey AS a, s_nationkey AS b, o_orderpriority, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
n AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT n AS cutoff FROM (SELECT n, row_number() OVER (ORDER BY n, a, b) AS rn, count(*) OVER () AS m FROM n) WHERE rn = greatest(ceil(55::DOUBLE / 100 * m), 1)::BIGINT),
e AS (SELECT a, b FROM n, k WHERE n >= cutoff AND a <> b)"""


def _nation_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    buyers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    sellers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(buyers, F.col("c_custkey") == F.col("o_custkey")).join(sellers, F.col("s_suppkey") == F.col("l_suppkey"))


@query(f"""
WITH {_NATIONS},
i AS (SELECT b AS node, count(*) AS fan_in FROM e GROUP BY b), o AS (SELECT a AS node, count(*) AS fan_out FROM e GROUP BY a),
t AS (SELECT b AS node, count(DISTINCT a) AS test_consumers FROM x WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 50 AND a <> b GROUP BY b)
SELECT i.node, fan_in, fan_out, coalesce(test_consumers, 0) AS test_consumers FROM i JOIN o ON o.node = i.node LEFT JOIN t ON t.node = i.node WHERE fan_in >= 10 AND fan_out >= 10""")
def hubs(spark: SparkSession, d: str) -> DataFrame:
    lines = _nation_lines(spark, d)
    counted = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    cut = percentiles.cutoffs(counted, ["all"], "n", F.lit(55), ["a", "b"]).select("all", "cutoff")
    edges = counted.join(cut, "all").where("n >= cutoff").select("a", "b")
    return graphs.hubs(edges, lines.where("o_orderpriority = '1-URGENT' and l_quantity >= 50"), 10, 10)


def _user_edges(gap: int) -> str:
    return f"""
v AS (SELECT user_id AS a, lead(user_id) OVER w AS b, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts, event_id)),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM v WHERE gap <= {gap} AND a <> b)"""


def _edges(spark: SparkSession, d: str, gap: int) -> DataFrame:
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("a"), F.lead("user_id").over(w).alias("b"), F.lead("ts").over(w).alias("t2"), "ts")
    return rows.where(F.expr(f"timestampdiff(MICROSECOND, ts, t2) <= {gap}") & (F.col("a") != F.col("b"))).select("a", "b").distinct()


_SCC = (
    _user_edges(10_000_000)
    + """,
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT x.a AS node, min(x.b) AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
s AS (SELECT node, coalesce(least(m.other, node), node) AS component FROM (SELECT a AS node FROM e UNION SELECT b FROM e) LEFT JOIN m USING (node))"""
)


@query(f"WITH RECURSIVE {_SCC} SELECT node, component FROM s")
def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.strong_components(_edges(spark, d, 10_000_000))


@query(f"""
WITH RECURSIVE {_SCC},
f AS (SELECT component, count(DISTINCT event_type) AS files, count(DISTINCT ts::DATE) AS projects FROM s JOIN events ON user_id = node GROUP BY component),
n AS (SELECT component, count(*) AS nodes FROM s GROUP BY component),
i AS (SELECT p.component, count(*) AS internal_edges FROM e JOIN s p ON p.node = a JOIN s q ON q.node = b AND q.component = p.component GROUP BY p.component)
SELECT component, nodes, files, projects, internal_edges FROM n JOIN f USING (component) JOIN i USING (component) WHERE nodes >= 3 AND files >= 3""")
def scc_qualified(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d, 10_000_000)
    files = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("file"), F.to_date("ts").alias("project"))
    return graphs.qualified_components(graphs.strong_components(edges), edges, files)


@query(f"""
WITH RECURSIVE {_SCC},
g AS MATERIALIZED (SELECT p.component, a, b FROM e JOIN s p ON p.node = a JOIN s q ON q.node = b AND q.component = p.component),
n AS (SELECT component, count(*) AS nodes FROM s GROUP BY component),
d AS (SELECT component, component AS node, 0 AS d FROM (SELECT DISTINCT component FROM g) UNION SELECT d.component, g.a, d.d + 1 FROM d JOIN g ON g.component = d.component AND g.b = d.node JOIN n ON n.component = d.component WHERE d.d < n.nodes),
l AS MATERIALIZED (SELECT component, node, min(d) AS d FROM d GROUP BY ALL),
t AS MATERIALIZED (SELECT g.component, g.a AS node, min(g.b) AS next FROM g JOIN l x ON x.component = g.component AND x.node = g.a JOIN l y ON y.component = g.component AND y.node = g.b AND y.d = x.d - 1 GROUP BY ALL),
w AS (SELECT component, min(b) AS node, component || ',' || min(b) AS path FROM g WHERE a = component GROUP BY component UNION ALL SELECT w.component, t.next, w.path || ',' || t.next FROM w JOIN t ON t.component = w.component AND t.node = w.node WHERE w.node <> w.component)
SELECT component, path FROM w WHERE node = component""")
def scc_example_cycles(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d, 10_000_000)
    cycles = graphs.example_cycles(graphs.strong_components(edges), edges)
    return cycles.select("component", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


_FORWARD = """
x AS (SELECT l_partkey AS node, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem),
c AS (SELECT node, target, count(*) AS n FROM x WHERE target IS NOT NULL AND target <> node GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT node, target FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, target) AS rn FROM c) WHERE rn = 1),
f AS MATERIALIZED (SELECT p_partkey AS node, target FROM part LEFT JOIN k ON node = p_partkey)"""


def _forwarders(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.lead("l_partkey").over(w).alias("target"))
    counted = pairs.where("target is not null and target <> node").groupBy("node", "target").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    best = counted.groupBy("node").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("target"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("node")).join(best, "node", "left")


@query(f"""
WITH RECURSIVE {_FORWARD},
h AS (SELECT node, target FROM f WHERE target IS NOT NULL AND node NOT IN (SELECT target FROM f WHERE target IS NOT NULL)),
p AS (SELECT node AS root, target AS at, [node, target] AS path FROM h UNION ALL
  SELECT p.root, f.target, list_append(p.path, f.target) FROM p JOIN f ON f.node = p.at WHERE f.target IS NOT NULL AND NOT list_contains(p.path, f.target))
SELECT root, array_to_string(path, '>') AS path, len(path) - 1 AS edges FROM p JOIN f ON f.node = p.at WHERE f.target IS NULL AND len(path) > 2""")
def forwarding_paths(spark: SparkSession, d: str) -> DataFrame:
    out = graphs.forwarding_paths(_forwarders(spark, d))
    return out.select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), (F.size("path") - 1).cast("long").alias("edges"))


_REACH = (
    _user_edges(5_000_000)
    + """,
n AS (SELECT DISTINCT user_id AS node, user_id % 10 = 0 AS test FROM events),
r AS (SELECT node, false AS after FROM n WHERE test UNION SELECT e.b, r.after OR NOT n.test FROM r JOIN n ON n.node = r.node JOIN e ON e.a = r.node)"""
)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("node")).distinct().select("node", (F.col("node") % 10 == 0).alias("is_root"), (F.col("node") % 10 != 0).alias("is_production"))


@query(f"""
WITH RECURSIVE {_REACH}
SELECT n.node, CASE WHEN bool_or(after IS FALSE) THEN 'Direct' WHEN bool_or(after) THEN 'Indirect' ELSE 'NoPath' END AS kind
FROM n LEFT JOIN r ON r.node = n.node WHERE NOT test GROUP BY n.node""")
def reach_direct_indirect(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reach(_edges(spark, d, 5_000_000), _users(spark, d)).select("node", "kind")


@query(f"""
WITH RECURSIVE {_REACH},
m AS (SELECT DISTINCT node FROM r),
a AS (SELECT node + 1 AS node, node = 33 AS everywhere FROM n WHERE node % 11 = 3 AND node IN (SELECT node FROM m)),
u AS (SELECT node FROM a WHERE NOT everywhere UNION SELECT e.b FROM u JOIN e ON e.a = u.node)
SELECT node, node IN (SELECT node FROM u) OR (SELECT coalesce(bool_or(everywhere), false) FROM a) AS uncertain FROM n""")
def uncertainty_closure(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    affected = users.where("node % 11 = 3").select(F.col("node").alias("source"), (F.col("node") + 1).alias("node"), (F.col("node") == 33).alias("is_global"))
    return graphs.uncertain(_edges(spark, d, 5_000_000), users, affected, users.where("is_root"))


@query(f"""
WITH RECURSIVE {_REACH},
k AS (SELECT n.node, CASE WHEN bool_or(after IS FALSE) THEN 'Direct' WHEN bool_or(after) THEN 'Indirect' ELSE 'NoPath' END AS kind FROM n LEFT JOIN r ON r.node = n.node WHERE NOT test GROUP BY n.node),
d AS (SELECT user_id AS node, count(*) AS decisions, count(DISTINCT event_type) AS nesting FROM events GROUP BY user_id)
SELECT node, CASE kind WHEN 'NoPath' THEN 'no-static-test-path' ELSE 'indirect-test-path-only' END AS discriminator, decisions, nesting FROM k JOIN d USING (node)
WHERE (kind = 'NoPath' AND (decisions >= 3 OR nesting >= 2)) OR (kind = 'Indirect' AND (decisions >= 60 OR nesting >= 6))""")
def missing_evidence(spark: SparkSession, d: str) -> DataFrame:
    kinds = graphs.reach(_edges(spark, d, 5_000_000), _users(spark, d))
    measured = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("event_type").alias("nesting"))
    found = kinds.join(measured, "node").where("(kind = 'NoPath' and (decisions >= 3 or nesting >= 2)) or (kind = 'Indirect' and (decisions >= 60 or nesting >= 6))")
    return found.select("node", F.when(F.col("kind") == "NoPath", "no-static-test-path").otherwise("indirect-test-path-only").alias("discriminator"), "decisions", "nesting")


_CHAIN = """
p AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 10 END AS parent, p_size >= 5 AS visible FROM part),
c AS (SELECT node, node AS ancestor, 0::BIGINT AS depth FROM p UNION ALL SELECT c.node, p.parent, c.depth + 1 FROM c JOIN p ON p.node = c.ancestor WHERE p.parent IS NOT NULL)"""


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("case when p_partkey > 0 then p_partkey div 10 end").alias("parent"), (F.col("p_size") >= 5).alias("is_visible"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT node, ancestor, depth FROM c")
def containing_chain(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ancestors(_parents(spark, d))


@query(f"WITH RECURSIVE {_CHAIN} SELECT c.node, bool_and(visible) AS protected FROM c JOIN p ON p.node = c.ancestor GROUP BY c.node")
def api_protection(spark: SparkSession, d: str) -> DataFrame:
    p = _parents(spark, d)
    return graphs.visible_all_the_way(graphs.ancestors(p), p.select("node", "is_visible"))


# --- references ------------------------------------------------------------------------------

_UNREFERENCED = """
u AS (SELECT p_partkey, p_brand, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_shipdate >= TIMESTAMP '2001-06-01')
  AND p_brand <> 'Brand#1' AND p_size <> 50)"""


def _unreferenced(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    candidates = part.select(F.col("p_partkey").alias("symbol"), "p_brand", "p_name")
    recent = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'2001-06-01'").select(F.col("l_partkey").alias("symbol"), F.lit(False).alias("is_self"))
    return references.unreferenced(candidates, recent, part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("symbol")), part.where("p_size = 50").select(F.col("p_partkey").alias("symbol")))


@query(f"WITH {_UNREFERENCED} SELECT p_partkey FROM u")
def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return _unreferenced(spark, d).select(F.col("symbol").alias("p_partkey"))


@query(f"""
WITH {_UNREFERENCED},
r AS (SELECT p_brand, p_name FROM part LEFT JOIN u USING (p_partkey, p_brand, p_name) GROUP BY ALL HAVING count(*) = count(u.p_partkey))
SELECT p_partkey, p_brand, p_name FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p_brand = u.p_brand AND r.p_name = u.p_name)""".replace("count(u.p_partkey)", "count(CASE WHEN p_partkey IN (SELECT p_partkey FROM u) THEN 1 END)"))
def unreferenced_parents(spark: SparkSession, d: str) -> DataFrame:
    found = _unreferenced(spark, d)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), "p_brand", "p_name")
    whole = part.join(found.select("symbol", F.lit(1).alias("hit")), "symbol", "left").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).where("n = hits")
    return references.without_reported_parents(found, whole, ["p_brand", "p_name"]).select(F.col("symbol").alias("p_partkey"), "p_brand", "p_name")


@query("""
WITH r AS (SELECT 'P' || l_partkey AS symbol, l_returnflag AS kind, 'B' || p_brand AS type FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT symbol, kind FROM r UNION ALL SELECT type, 'ContainingType' FROM r) SELECT symbol, kind, count(*) AS n FROM u GROUP BY ALL""")
def reference_fanout(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("place"))
    types = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("B"), "p_brand").alias("type"))
    return references.fan_out(refs, types).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages),
w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS name, doc_id AS symbol FROM documents),
d AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM w WHERE name <> '')
SELECT symbol, min(CASE WHEN n = 1 THEN 'protected' ELSE 'uncertain' END) AS state FROM d WHERE name IN (SELECT name FROM u) GROUP BY symbol""")
def protect_uncertain(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name"))
    words = F.explode(F.split("text", "[ \n]+", -1))
    declared = table(spark, d, "documents").select(words.alias("name"), F.col("doc_id").alias("symbol")).where("name <> ''")
    return references.match_names(uses, declared)


_PATHS = "p AS (SELECT page_id, strlen(html) AS bytes, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def _page_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query(f"""
WITH {_PATHS},
q AS (SELECT DISTINCT path FROM p),
o AS (SELECT DISTINCT string_split(path, '/')[1] AS dir, 'host' AS owner FROM p UNION ALL
  SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/'), 'section' FROM p WHERE string_split(path, '/')[2] IN ('en', 'fr')),
m AS (SELECT path, owner, dir, row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS rn FROM q JOIN o ON starts_with(path, dir || '/'))
SELECT path, owner, dir FROM m WHERE rn = 1""")
def owner_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = _page_paths(spark, d)
    parts = F.split("path", "/", -1)
    hosts = p.select(F.get(parts, F.lit(0)).alias("dir"), F.lit("host").alias("owner")).distinct()
    sections = p.where(F.get(parts, F.lit(1)).isin("en", "fr")).select(F.array_join(F.slice(parts, 1, 2), "/").alias("dir"), F.lit("section").alias("owner")).distinct()
    return references.owner_by_longest_prefix(p.select("path").distinct(), hosts.unionByName(sections)).select("path", "owner", "dir")


@query("SELECT doc_id, lang FROM documents QUALIFY count(*) OVER (PARTITION BY lang, n_chars) = 1")
def unique_identity(spark: SparkSession, d: str) -> DataFrame:
    return references.unique_on(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars"]).select("doc_id", "lang")


@query("""
SELECT conv_id, turn, list_has_any(a, ['Fact', 'Theory']) AND NOT list_has_any(a, ['Skip', 'Explicit']) AS active FROM
  (SELECT conv_id, turn, [CASE turn % 3 WHEN 0 THEN 'Fact' WHEN 1 THEN 'Theory' ELSE 'Other' END, CASE WHEN role = 'user' THEN 'Trait' ELSE 'Skip' END] AS a FROM conversations)""")
def active_tests(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.when(F.col("turn") % 3 == 0, "Fact").when(F.col("turn") % 3 == 1, "Theory").otherwise("Other"), F.when(F.col("role") == "user", "Trait").otherwise("Skip"))
    return table(spark, d, "conversations").withColumn("a", a).select("conv_id", "turn", references.active_test("a", ["Fact", "Theory"], ["Skip", "Explicit"]).alias("active"))


# --- findings --------------------------------------------------------------------------------

_FINDINGS = """
x AS (SELECT 'long' AS analysis_id, source, lang, doc_id, n_chars FROM documents WHERE n_chars >= 4000 UNION ALL
  SELECT 'lines', source, lang, doc_id, n_chars FROM documents WHERE len(string_split(text, chr(10))) >= 15 UNION ALL
  SELECT 'german', source, lang, doc_id, n_chars FROM documents WHERE lang = 'de'),
y AS (SELECT *, 'finding-' || substring(sha256(analysis_id || chr(0) || source || chr(0) || lang || chr(0) || doc_id || chr(0) || 'd'), 1, 24) AS id FROM x)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kinds = {"long": F.col("n_chars") >= 4000, "lines": F.size(F.split("text", "\n", -1)) >= 15, "german": F.col("lang") == "de"}
    tagged = docs.withColumn("analysis_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()]))))
    return tagged.select("analysis_id", "source", "lang", "doc_id", "n_chars", findings.finding_id(F.col("analysis_id"), F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.lit("d")).alias("id"))


@query(f"WITH {_FINDINGS} SELECT id, analysis_id, doc_id FROM y")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("id", "analysis_id", "doc_id")


@query(f"WITH {_FINDINGS} SELECT DISTINCT a.id, b.id AS related_id FROM y a JOIN y b ON a.source = b.source AND a.doc_id = b.doc_id AND a.id <> b.id")
def related_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.related(_findings(spark, d).select("id", F.col("source").alias("project_path"), F.col("doc_id").alias("symbol_id")))


@query("""
SELECT analysis_id, CASE WHEN bool_or(t) AND bool_or(NOT t) THEN 'mixed' WHEN bool_or(t) THEN 'tests' ELSE 'production' END AS area FROM
  (SELECT source || '/' || lang AS analysis_id, doc_id % 3 = 0 AS t FROM documents) GROUP BY analysis_id""")
def finding_area(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("analysis_id"), F.when(F.col("doc_id") % 3 == 0, "Tests").otherwise("Production").alias("role"))
    return findings.areas(subjects, ["analysis_id"])


@query(f"WITH {_FINDINGS} SELECT analysis_id, count(*) AS found, count(DISTINCT source) AS projects, count(DISTINCT (source, lang)) AS files FROM y GROUP BY analysis_id")
def finding_totals(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("found"), F.count_distinct("source").alias("projects"), F.count_distinct("source", "lang").alias("files"))


@query(f"WITH {_FINDINGS} SELECT analysis_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS paths FROM y GROUP BY analysis_id")
def finding_sources(spark: SparkSession, d: str) -> DataFrame:
    out = findings.source_paths(_findings(spark, d).select(F.col("analysis_id").alias("id"), F.col("lang").alias("source_path")))
    return out.select(F.col("id").alias("analysis_id"), F.array_join("paths", ",").alias("paths"))


@query(r"""
SELECT s_suppkey, project_key, 't-' || substring(sha256(project_key || ':' || s_name), 1, 16) AS type_id FROM (
  SELECT s_suppkey, s_name, 'p-' || substring(trim(regexp_replace(regexp_replace(s_name, '\.[^.]*$', ''), '[^A-Za-z0-9_-]', '-', 'g'), '-'), 1, 32) || '-' || substring(sha256('src/' || s_name || '.csproj'), 1, 8) AS project_key FROM supplier)""")
def project_keys(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("src/"), "s_name", F.lit(".csproj"))
    return table(spark, d, "supplier").select("s_suppkey", findings.project_key(path).alias("project_key"), findings.type_id(findings.project_key(path), F.col("s_name")).alias("type_id"))


@query("SELECT p_name, count(DISTINCT (p_brand, p_type)) AS meanings FROM part GROUP BY p_name HAVING count(DISTINCT (p_brand, p_type)) > 1")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return findings.ambiguous(table(spark, d, "part"), "p_name", ["p_brand", "p_type"])


@query(f"""
WITH {_PATHS},
a AS (SELECT bytes, unnest(list_prepend('.', list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS folder FROM p)
SELECT folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM a GROUP BY folder""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return findings.folder_rollup(_page_paths(spark, d).select("path", "bytes"))


@query("""
WITH f AS (SELECT doc_id AS id, 'a' AS analysis_id, source, lang, n_chars % 300 AS subject, doc_id % 9 AS start_line, string_split(text, chr(10)) AS lines, text FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY source, lang, subject) AS n FROM f)
SELECT 'duplicate-key' AS rule, id FROM k WHERE n > 1 UNION ALL
SELECT 'unknown-source', id FROM f WHERE source = 'src3' UNION ALL
SELECT 'line-out-of-range', id FROM f WHERE source <> 'src3' AND (start_line < 1 OR start_line > len(lines)) UNION ALL
SELECT 'no-evidence', id FROM f WHERE id % 50 = 7 UNION ALL
SELECT 'snippet-not-in-line', id FROM f WHERE id % 50 <> 7 AND (source = 'src3' AND text[1:3] <> '' OR source <> 'src3' AND NOT contains(coalesce(lines[CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END], ''), text[1:3])) UNION ALL
SELECT 'metric-not-finite', id FROM f WHERE id % 70 = 1""")
def violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1)
    proof = F.array(F.struct(line.alias("line"), F.substring("text", 1, 3).alias("snippet")))
    found = docs.select(
        F.col("doc_id").alias("id"), F.lit("a").alias("analysis_id"), F.col("source").alias("project_path"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("source_path"),
        F.concat_ws(":", "lang", (F.col("n_chars") % 300).cast("string")).alias("subject_id"), F.lit("d").alias("discriminator"), (F.col("doc_id") % 9).alias("start_line"),
        F.when(F.col("doc_id") % 50 == 7, F.slice(proof, 1, 0)).otherwise(proof).alias("evidence_lines"),
        F.create_map(F.lit("m"), F.when(F.col("doc_id") % 70 == 1, F.lit(float("nan"))).otherwise(F.lit(1.0))).alias("metrics"),
    )
    sources = docs.where("source <> 'src3'").select(F.col("source").alias("project_path"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("source_path"), F.split("text", "\n", -1).alias("lines"))
    # The key leaves the document's own path aside, so that keys repeat.
    keyed = found.withColumn("own_path", F.col("source_path"))
    repeated = keyed.withColumn("source_path", F.lit("x"))
    rules = findings.violations(found, sources).where("rule <> 'duplicate-key'")
    return rules.unionByName(findings.violations(repeated, sources).where("rule = 'duplicate-key'"))
