"""Queries of inventories and of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import inventory, lines, multisets, sampling
from ._base import Queries, table

Q = Queries()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_SHOWN = r"""e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '\[ (' || event_id % 97 || '.1) x = ' || user_id || ' \]' WHEN 1 THEN '\[ x = ' || user_id || ' (' || event_id % 97 || ') \]' WHEN 2 THEN '$$ y \tag{' || user_id || '} $$' WHEN 3 THEN '\[ (1) z (2) \]' ELSE '$$ a(1)b $$' END AS t FROM events)"""


@Q.add(rf"""WITH {_SHOWN}, b AS (SELECT event_id, event_id % 5 AS k, trim(t[3:length(t) - 2]) AS body FROM e)
SELECT event_id, CASE k WHEN 0 THEN 'prefix' WHEN 1 THEN 'suffix' WHEN 2 THEN 'tag' ELSE 'none' END AS representation, CASE k WHEN 0 THEN event_id % 97 || '.1' WHEN 1 THEN CAST(event_id % 97 AS VARCHAR) WHEN 2 THEN regexp_extract(body, '\\tag\{{([^{{}}]*)\}}', 1) ELSE '' END AS label,
  sha256(CASE k WHEN 0 THEN trim(regexp_replace(body, '^\([^)]*\)', '')) WHEN 1 THEN trim(regexp_replace(body, '\([^)]*\)$', '')) ELSE body END) AS payload_sha256, k < 2 AS rewritable FROM b""")
def equation_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of displays: as a prefix, a suffix, an active tag, or none that can be told."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    n, k = (e % 97).cast("string"), e % 5
    text = F.when(k == 0, F.concat(F.lit("\\[ ("), n, F.lit(".1) x = "), u, F.lit(" \\]"))).when(k == 1, F.concat(F.lit("\\[ x = "), u, F.lit(" ("), n, F.lit(") \\]"))).when(k == 2, F.concat(F.lit("$$ y \\tag{"), u, F.lit("} $$")))
    text = text.when(k == 3, F.lit("\\[ (1) z (2) \\]")).otherwise(F.lit("$$ a(1)b $$"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return inventory.equations(rows, "event_id").drop("text")


@Q.add("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 0 OR conv_id % 7 = 3 AND turn = 2 THEN 'References' ELSE '[' || CASE WHEN conv_id % 5 = 2 AND turn = 2 THEN 9 ELSE turn END || '] entry' END AS t FROM conversations),
h AS (SELECT *, sum(CAST(t = 'References' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS heads FROM l), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM h WHERE heads > 0 AND t <> 'References'),
g AS (SELECT conv_id, CAST(regexp_extract(t, '([0-9]+)', 1) AS INT) AS number, turn, n, heads FROM e)
SELECT conv_id, number, CAST(turn AS BIGINT) AS start_line, CAST(turn AS BIGINT) AS end_line, bool_and(heads = 1 AND number = n) OVER (PARTITION BY conv_id) AS ok FROM g""")
def bibliography_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reference lists; some have two headings, some a wrong number."""
    c, t = F.col("conv_id"), F.col("turn")
    head = (t == 0) | ((c % 7 == 3) & (t == 2))
    text = F.when(head, "References").otherwise(F.concat(F.lit("["), F.when((c % 5 == 2) & (t == 2), F.lit(9)).otherwise(t).cast("string"), F.lit("] entry")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", t.cast("bigint").alias("line"), text.alias("text"))
    return inventory.bibliography(rows, "conv_id")


@Q.add(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS head FROM pages)
SELECT page_id, CAST(n AS INT) AS n, kind, source, sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS payload_sha256 FROM (
  SELECT page_id, 0 AS n, 'title' AS kind, 'command' AS source, regexp_replace(title, '[{}\\%$]', ' ', 'g') AS body FROM p UNION ALL SELECT page_id, 1, 'abstract', 'environment', regexp_replace(head, '[{}\\%$]', ' ', 'g') FROM p)""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as commands and first headings as abstracts."""
    clean = lambda tag: F.regexp_replace(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1), r"[{}\\%$]", " ")
    text = F.concat(F.lit("\\title{"), clean("title"), F.lit("}\n\\begin{abstract}\n"), clean("h1"), F.lit("\n\\end{abstract}"))
    return inventory.front_matter(table(spark, sf_dir, "pages").select("page_id", text.alias("masked")), "page_id")


@Q.add(r"""WITH h AS (SELECT page_id, trim(t) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|b|title)>([^<]*)', 1)) AS t FROM pages)), e AS (SELECT page_id, trim(t) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:title|h1)>([^<]*)', 1)) AS t FROM pages)),
n AS (SELECT page_id, heading, count(*) AS n FROM h GROUP BY ALL), x AS (SELECT page_id, heading, count(*) AS expected FROM e GROUP BY ALL)
SELECT n.page_id, n.heading, n, coalesce(expected, 0) AS expected FROM n LEFT JOIN x ON n.page_id = x.page_id AND n.heading = x.heading WHERE n > greatest(1, coalesce(expected, 0))""")
def headings_too_often(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda names: table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"<(?:{names})>([^<]*)"), F.lit(1))).alias("t")).select("page_id", F.trim("t").alias("heading"))
    return inventory.repeated(found("h1|b|title"), found("title|h1"), ["page_id", "heading"])


@Q.add(r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, trim(unnest(x)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), p AS (SELECT text, doc_id, count(*) AS n FROM l WHERE line <= 3 AND text <> '' GROUP BY ALL)
SELECT text, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_pages FROM p GROUP BY text HAVING count(*) >= 2 AND sum(n) >= 2""")
def headers_near_the_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.running_headers(lines.explode_lines(docs(spark, sf_dir).select("doc_id", "text")), ["doc_id"], "line", "text", 3)


_CUT = r"regexp_replace(text, '([a-z]{3})([a-z]{3}[^a-z])', '\1-' || chr(10) || '\2', 'g')"


@Q.add(rf"""WITH d AS (SELECT doc_id, {_CUT} AS text FROM documents), w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+') || regexp_extract_all(lower(text), '\p{{L}}+(?:-\p{{L}}+)+')) AS word FROM documents), x AS (SELECT word, count(*) AS n FROM w GROUP BY word),
l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
f AS (SELECT doc_id, line, regexp_extract(lower(t), '(\p{{L}}+)-\s*$', 1) AS a, regexp_extract(lower(lead(t) OVER (PARTITION BY doc_id ORDER BY line)), '^\s*(\p{{L}}+)', 1) AS b FROM l),
j AS (SELECT f.*, coalesce(p.n, 0) AS joined, coalesce(q.n, 0) AS hyphenated FROM f LEFT JOIN x p ON p.word = a || b LEFT JOIN x q ON q.word = a || '-' || b WHERE a <> '' AND b <> '')
SELECT CASE WHEN joined >= 2 AND hyphenated = 0 THEN 'JOIN' WHEN hyphenated >= 2 AND joined = 0 THEN 'KEEP' ELSE 'AMBIGUOUS' END AS verdict, count(*) AS n, CAST(sum(joined) AS BIGINT) AS joined FROM j GROUP BY 1""")
def line_end_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with words cut at line ends, and whether the corpus would join them again."""
    d = docs(spark, sf_dir)
    cut = d.select("doc_id", F.regexp_replace("text", "([a-z]{3})([a-z]{3}[^a-z])", "$1-\n$2").alias("text"))
    lexicon = d.select(F.inline(multisets.word_counts(T.words_and_compounds(F.col("text"))))).groupBy("word").agg(F.sum("n").alias("n"))
    out = inventory.line_ends(lines.explode_lines(cut), lexicon, "doc_id")
    return out.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("joined").alias("joined"))


@Q.add(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+') || regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word""")
def document_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and hyphenated compounds with their counts."""
    return docs(spark, sf_dir).select(F.inline(multisets.word_counts(T.words_and_compounds(F.col("text"))))).groupBy("word").agg(F.sum("n").alias("n"))


@Q.add("""WITH s AS (SELECT event_id, user_id, epoch_us(date_trunc('second', ts)) // 1000000 AS a, CAST(floor(value * 100) AS BIGINT) AS n FROM events), m AS (SELECT event_id, user_id, 2 * a + n AS m FROM s),
w AS (SELECT *, lag(m) OVER x AS bm, lag(event_id) OVER x AS bi, lead(m) OVER x AS am, lead(event_id) OVER x AS ai FROM m WINDOW x AS (PARTITION BY user_id ORDER BY m, event_id))
SELECT event_id, CASE WHEN bm IS NOT NULL AND (am IS NULL OR m - bm <= am - m) THEN bi ELSE ai END AS nearest, CAST(CASE WHEN bm IS NOT NULL AND (am IS NULL OR m - bm <= am - m) THEN m - bm ELSE am - m END AS BIGINT) AS distance FROM w""")
def nearest_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .events import spans

    return inventory.nearest_midpoint(spans(spark, sf_dir), "user_id", "event_id").select("event_id", "nearest", "distance")


@Q.add("WITH s AS (SELECT doc_id, unnest(['source', 'decided', 'edited', 'verified']) AS step, unnest([NULL, 'source', 'decided', 'edited']) AS before FROM documents) SELECT CAST(doc_id AS VARCHAR) AS artifact, step, sha256(doc_id || '/' || step) AS child, CASE WHEN before IS NOT NULL THEN sha256(doc_id || '/' || before) END AS parent FROM s")
def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.lineage(docs(spark, sf_dir), F.col("doc_id").cast("string"), ["source", "decided", "edited", "verified"])


@Q.add("SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'a5' END, CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN n_chars > 2000 THEN 'long' END, 'plain') AS paper, coalesce(CASE WHEN doc_id % 5 = 0 THEN 12 END, CASE WHEN n_chars > 2000 THEN 11 END, 10) AS size FROM documents")
def layout_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options from what is said, else from the context, else from the metadata, else the defaults."""
    none, i, long = F.lit(None), F.col("doc_id"), F.col("n_chars") > 2000
    level = lambda paper, size: F.struct(paper.cast("string").alias("paper"), size.cast("int").alias("size"))
    rows = docs(spark, sf_dir).select("doc_id", level(F.when(i % 7 == 0, "a5"), F.when(i % 5 == 0, 12)).alias("said"), level(F.when(i % 3 == 0, F.col("lang")), none).alias("context"), level(F.when(long, "long"), F.when(long, 11)).alias("meta"), level(F.lit("plain"), F.lit(10)).alias("default"))
    return inventory.resolved(rows, ["paper", "size"], ["said", "context", "meta", "default"]).select("doc_id", "paper", "size")


@Q.add("""WITH s AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN user_id % 3 = 0 THEN 'left' WHEN user_id % 3 = 1 THEN 'right' WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, event_id % 4 = 1 AS used FROM events), a AS (SELECT user_id, list(side) FILTER (used) AS s FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN s IS NULL THEN 'not_applicable' WHEN list_contains(s, 'unknown') THEN 'unknown' WHEN len(list_distinct(s)) = 1 THEN s[1] ELSE 'mixed' END AS side FROM a""")
def tag_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin in which all of a page's tags stand."""
    e, u = F.col("event_id"), F.col("user_id")
    left = (u % 3 == 0) | ((u % 3 == 2) & (e % 2 == 0))
    x0 = F.when(e % 11 == 0, 0.4).when(left, 0.05).otherwise(0.8)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(e % 4 == 1, G.tag_side(x0, x0 + 0.1))).alias("s"))
    return rows.select("user_id", G.common_side(F.col("s")).alias("side"))


@Q.add("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20 + 128) AS a, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 18 + 130 + vec_id % 3) AS b FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m AS (SELECT vec_id, len(a) AS n, list_sum(a) / len(a) AS ma, list_sum(b) / len(b) AS mb, list_dot_product(a, a) / len(a) AS aa, list_dot_product(b, b) / len(a) AS bb, list_dot_product(a, b) / len(a) AS ab FROM v)
SELECT vec_id, round(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * ((aa - ma * ma) + (bb - mb * mb) + 58.5225)), 4) AS similarity FROM m""")
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as small grey images, compared with a brighter copy."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    a, b = F.transform(e, lambda x: x.cast("double") * 20 + 128), F.transform(e, lambda x: x.cast("double") * 18 + 130 + F.col("vec_id") % 3)
    return table(spark, sf_dir, "embeddings").filter(fine).select("vec_id", F.round(G.similarity(a, b), 4).alias("similarity"))


@Q.add("""SELECT event_id, CAST(greatest(0, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, event_id % 50 - 5)) AS BIGINT) AS input, CAST(least(greatest(0, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, event_id % 50 - 5)), greatest(0, event_id % 40)) AS BIGINT) AS cached, CAST(event_id % 9 AS BIGINT) AS output,
  CAST(CASE WHEN event_id % 4 = 0 AND event_id > 0 THEN event_id ELSE greatest(0, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, event_id % 50 - 5)) + event_id % 9 END AS BIGINT) AS total FROM events""")
def usage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from whichever fields are there, clamped."""
    e = F.col("event_id")
    fields = {"input": [F.when(e % 3 == 0, F.col("user_id")), e % 50 - 5], "cached": [e % 40], "output": [e % 9], "total": [F.when(e % 4 == 0, e)]}
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in T.usage(fields).items()])


@Q.add("SELECT doc_id, source, lang, true AS same FROM documents")
def outline_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata packed into a comment line and read back."""
    line = T.pack_metadata(F.to_json(F.struct("doc_id", "source", "lang")))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("own"), line.alias("line"))
    back = F.from_json(T.unpack_metadata(F.col("line")), "doc_id BIGINT, source STRING, lang STRING")
    fits = F.col("line").rlike("^% outline: [A-Za-z0-9_-]+$") & (back["doc_id"] == F.col("own"))
    return rows.select(back["doc_id"].alias("doc_id"), back["source"].alias("source"), back["lang"].alias("lang"), fits.alias("same"))


@Q.add("""WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN ['i', 'iv', 'ix', 'xiv', 'xl', 'xcix', 'cd', 'mcmxc'][doc_id % 8 + 1] WHEN 2 THEN ['iiii', 'vv', 'ic', 'xm', 'iix', 'abc', '', 'mix!'][doc_id % 8 + 1] WHEN 3 THEN upper(['i', 'iv', 'ix', 'xiv', 'xl', 'xcix', 'cd', 'mcmxc'][doc_id % 8 + 1]) WHEN 4 THEN '-' ELSE 'mmxxiv' END AS f FROM documents)
SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN doc_id WHEN 1 THEN [1, 4, 9, 14, 40, 99, 400, 1990][doc_id % 8 + 1] WHEN 3 THEN [1, 4, 9, 14, 40, 99, 400, 1990][doc_id % 8 + 1] WHEN 5 THEN 2024 END AS INT) AS folio FROM n""")
def folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed page labels as numbers."""
    i = F.col("doc_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % 8).cast("int"))
    good = pick(["i", "iv", "ix", "xiv", "xl", "xcix", "cd", "mcmxc"])
    bad = pick(["iiii", "vv", "ic", "xm", "iix", "abc", "", "mix!"])
    label = F.when(i % 6 == 0, i.cast("string")).when(i % 6 == 1, good).when(i % 6 == 2, bad).when(i % 6 == 3, F.upper(good)).when(i % 6 == 4, "-").otherwise("mmxxiv")
    return docs(spark, sf_dir).select("doc_id", T.roman_or_decimal(label).alias("folio"))


@Q.add("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 9 > doc_id % 9 + 2 THEN NULL WHEN doc_id % 9 < 1 OR doc_id % 9 + 2 > 9 THEN NULL ELSE array_to_string(list_sort(list_distinct([doc_id % 9, doc_id % 9 + 1, doc_id % 9 + 2, 7])), ',') END AS pages FROM documents")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page specifications read and checked."""
    k = F.col("doc_id") % 9
    spec = F.when(F.col("doc_id") % 4 == 3, "1-x").otherwise(F.concat_ws("-", k.cast("string"), (k + 2).cast("string")))
    pages = T.page_range(F.concat(spec, F.lit(", 7")), F.lit(9))
    return docs(spark, sf_dir).select("doc_id", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@Q.add(r"""SELECT page_id, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\p{L}\p{N}\p{S}]', '', 'g') AS key, CASE WHEN c = '' THEN 'download' ELSE left(c, 60) END AS file FROM
  (SELECT *, regexp_replace(regexp_replace(url, '[\x00-\x1F<>:"/\\|?*]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS c FROM pages)""")
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys and file names."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.letters_key(title).alias("key"), T.safe_filename(F.col("url"), most=60).alias("file"))


@Q.add("SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'needs_review' END WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'unknown' END AS status, count(*) AS n FROM events GROUP BY ALL")
def terminal_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs ended, in one vocabulary."""
    kind = F.col("event_type")
    said = F.when(kind == "purchase", " Succeeded ").when(kind == "error", "ERROR").when(kind == "signup", "canceled").otherwise(kind)
    return table(spark, sf_dir, "events").select("user_id", "event_type", T.terminal_status(said, F.col("user_id") % 2 == 0).alias("status")).groupBy("user_id", "event_type", "status").agg(F.count("*").alias("n"))


@Q.add("""WITH d AS (SELECT source, min(doc_id) AS doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS k FROM documents GROUP BY source, k), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS c FROM d),
p AS (SELECT doc_id, source, sha256(chr(31) || doc_id) AS p FROM f WHERE c = 1), r AS (SELECT doc_id, source, p, row_number() OVER (PARTITION BY source ORDER BY p) AS turn FROM p) SELECT doc_id, source, CAST(turn AS INT) AS turn FROM r ORDER BY turn, p LIMIT 50""")
def round_robin_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 without copies: a text that was taken isn't taken again. The limit is the operator."""
    key = F.sha2(F.lower(T.collapse_space(F.col("text"))), 256)
    first = docs(spark, sf_dir).groupBy(key.alias("k")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("d")).select("d.*")
    return sampling.round_robin(first, "source", sampling.priority(F.col("doc_id").cast("string")), 50)
