"""Queries of page geometry, outlines and further predicates. Spans, words and boxes are derived from the event rows: a user is a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.python_text import text_similarity, visible_text
from ..operators import evaluate, geometry, inventory, matching, predicates, templates
from ._base import Queries, table

Q = Queries()

#: A line of a page has ten places; a span is five wide with a gap of one, two or nine behind it, and every third is set in a formula font.
SPANS = """sp AS (SELECT user_id AS page, event_id // 500 AS block, (event_id // 10) % 50 AS line, event_id AS span, event_type AS text, CASE event_id % 3 WHEN 0 THEN 'Math' WHEN 1 THEN 'Body' ELSE 'Bold' END AS font, CAST(CASE WHEN event_id % 17 < 3 THEN 7 ELSE 10 END AS DOUBLE) AS size,
  CAST((event_id % 10) * 10 AS DOUBLE) AS x0, CAST(((event_id // 10) % 50) * 12 AS DOUBLE) AS y0, CAST((event_id % 10) * 10 + 5 + event_id % 5 AS DOUBLE) AS x1, CAST(((event_id // 10) % 50) * 12 + 8 AS DOUBLE) AS y1 FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tens, line = (e % 10) * 10.0, F.floor(e / 10) % 50
    font = F.when(e % 3 == 0, "Math").when(e % 3 == 1, "Body").otherwise("Bold")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), F.floor(e / 500).alias("block"), line.alias("line"), e.alias("span"), F.col("event_type").alias("text"), font.alias("font"), F.when(e % 17 < 3, 7.0).otherwise(10.0).alias("size"),
        tens.alias("x0"), (line * 12.0).alias("y0"), (tens + 5 + e % 5).alias("x1"), (line * 12.0 + 8).alias("y1"),
    )


@Q.add(f"""WITH {SPANS}, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 4 THEN 1 ELSE 0 END AS n FROM sp WHERE font = 'Math' WINDOW w AS (PARTITION BY page, block, line ORDER BY x0, span)), r AS (SELECT *, sum(n) OVER (PARTITION BY page, block, line ORDER BY x0, span) AS run FROM m)
SELECT page, block, line, CAST(run AS BIGINT) AS run, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_spans, string_agg(text, '' ORDER BY x0, text) AS text FROM r GROUP BY page, block, line, run""")
def formula_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of formula spans in a line."""
    return geometry.span_runs(spans(spark, sf_dir), ["page"], F.col("font") == "Math", 4.0).withColumn("run", F.col("run").cast("bigint"))


@Q.add(f"WITH {SPANS}, g AS (SELECT page, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN font = 'Math' THEN length(text) ELSE 0 END) AS BIGINT) AS n_math FROM sp GROUP BY ALL) SELECT *, n_math >= 0.34 * n_chars AS display FROM g")
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.display_lines(spans(spark, sf_dir), ["page"], F.col("font") == "Math")


@Q.add("""WITH w AS (SELECT user_id AS page, '(' || event_id % 9 || '.' || event_id % 4 || ')' AS text, CASE event_id % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 92.0 ELSE 40.0 END AS x0, event_id FROM events WHERE event_id % 13 = 4),
t AS (SELECT page, event_id, x0, CASE WHEN x0 = 2 THEN 'left' WHEN x0 = 92 THEN 'right' END AS side, text FROM w WHERE x0 <> 40)
SELECT page, event_id, side, count(DISTINCT side) OVER (PARTITION BY page) = 1 AS uniform, text[2:length(text) - 1] AS label FROM t""")
def equation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a page's margins, and whether all stand on one side."""
    e = F.col("event_id")
    x0 = F.when(e % 3 == 0, 2.0).when(e % 3 == 1, 92.0).otherwise(40.0)
    text = F.concat(F.lit("("), (e % 9).cast("string"), F.lit("."), (e % 4).cast("string"), F.lit(")"))
    words = table(spark, sf_dir, "events").filter(e % 13 == 4).select(F.col("user_id").alias("page"), "event_id", text.alias("text"), x0.alias("x0"), (x0 + 6).alias("x1"))
    widths = words.select("page").distinct().withColumn("width", F.lit(100.0))
    return geometry.equation_tags(words, ["page"], widths).select("page", "event_id", "side", "uniform", "label")


@Q.add(f"""WITH {SPANS}, z AS (SELECT page, round(size, 1) AS size, sum(length(text)) AS w FROM sp GROUP BY ALL), m AS (SELECT page, arg_max(size, (w, size)) AS body FROM z GROUP BY page)
SELECT s.page, s.block, s.line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, '' ORDER BY x0, text) AS text FROM sp s JOIN m ON s.page = m.page WHERE y0 > 400 AND size < 0.9 * body GROUP BY s.page, s.block, s.line""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small lines below a page's lowest rule."""
    rows = spans(spark, sf_dir)
    pages = rows.select("page").distinct()
    rules = pages.withColumn("y0", F.explode(F.array(F.lit(100.0), F.lit(400.0))))
    return geometry.footnotes(rows, ["page"], pages.withColumn("height", F.lit(600.0)), rules)


@Q.add(f"WITH {SPANS} SELECT font, count(*) AS n_spans, count(DISTINCT page) AS n_pages, CAST(min(page) AS BIGINT) AS first_page FROM sp GROUP BY font")
def font_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.font_inventory(spans(spark, sf_dir)).select("font", "n_spans", "n_pages", F.col("pages")[0].alias("first_page"))


@Q.add(f"WITH {SPANS}, z AS (SELECT page, round(size, 1) AS size, sum(length(text)) AS w FROM sp GROUP BY ALL) SELECT page, arg_max(size, (w, size)) AS size FROM z GROUP BY page")
def page_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size that most of a page's letters have; of equals the larger."""
    return geometry.weighted_mode(spans(spark, sf_dir), ["page"], "size", F.length("text")).withColumnRenamed("mode", "size")


@Q.add("""WITH b AS (SELECT user_id AS page, event_id, (event_id % 40) * 10.0 AS x0, (event_id % 23) * 10.0 AS y0, (event_id % 40) * 10.0 + 20 + event_id % 90 AS x1, (event_id % 23) * 10.0 + 10 + event_id % 70 AS y1 FROM events WHERE event_id % 5 = 2), g AS (SELECT * FROM b WHERE x1 - x0 >= 40 AND y1 - y0 >= 30)
SELECT page, event_id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.page = a.page AND o.x0 <= a.x0 AND o.y0 <= a.y0 AND o.x1 >= a.x1 AND o.y1 >= a.y1 AND (o.x1 - o.x0) * (o.y1 - o.y0) > (a.x1 - a.x0) * (a.y1 - a.y0))""")
def framed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn boxes that no other box of their page holds."""
    e = F.col("event_id")
    x0, y0 = (e % 40) * 10.0, (e % 23) * 10.0
    boxes = table(spark, sf_dir, "events").filter(e % 5 == 2).select(F.col("user_id").alias("page"), "event_id", x0.alias("x0"), y0.alias("y0"), (x0 + 20 + e % 90).alias("x1"), (y0 + 10 + e % 70).alias("y1"))
    return geometry.framed_regions(boxes, ["page"], 40.0, 30.0).select("page", "event_id")


_BOX = "(SELECT event_id, user_id, CAST(event_id % 100 AS DOUBLE) AS a0, CAST(event_id % 100 + 10 AS DOUBLE) AS a1, CAST(user_id % 90 AS DOUBLE) AS b0, CAST(user_id % 90 + 20 AS DOUBLE) AS b1 FROM events)"


@Q.add(f"SELECT event_id, round(greatest(0.0, least(a1, b1) - greatest(a0, b0)) / 10, 6) AS overlap, round(sqrt(greatest(0.0, b0 - a1, a0 - b1) ** 2 + greatest(0.0, b0 - a1, a0 - b1) ** 2), 6) AS distance, round(a0 / 110, 6) AS x FROM {_BOX}")
def box_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, distance and page shares of boxes."""
    e, u = (F.col("event_id") % 100).cast("double"), (F.col("user_id") % 90).cast("double")
    a, b = [e, e, e + 10, e + 10], [u, u, u + 20, u + 20]
    return table(spark, sf_dir, "events").select("event_id", F.round(G.overlap(e, e + 10, u, u + 20), 6).alias("overlap"), F.round(G.distance(a, b), 6).alias("distance"), G.normalised(a, F.lit(110.0), F.lit(110.0))[0].alias("x"))


@Q.add("""WITH p AS (SELECT doc_id AS page, n_chars FROM documents), g AS (SELECT doc_id + 3 AS page, n_chars AS m FROM documents WHERE doc_id % 4 <> 1), j AS (SELECT p.page, CASE WHEN g.m IS NOT NULL THEN round(least(n_chars, m) / greatest(n_chars, m, 1), 6) END AS similarity FROM p LEFT JOIN g ON g.page = p.page + 3),
c AS (SELECT CAST(n AS INT) AS number, n * 50 AS s, CASE WHEN n = 3 THEN 100000 ELSE n * 50 + 49 END AS e FROM range(4) t(n)) SELECT c.number, round(avg(similarity), 6) AS mean, round(min(similarity), 6) AS least, count(*) AS n_pages FROM j JOIN c ON j.page BETWEEN c.s AND c.e GROUP BY c.number""")
def chapter_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source pages against generated ones, and the chapters that hold them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("n_chars").alias("text"))
    made = d.filter("page % 4 <> 1").select((F.col("page") + 3).alias("page"), "text")
    share = F.round(F.least("text", "generated_text") / F.greatest(F.col("text"), F.col("generated_text"), F.lit(1)), 6)
    pages = geometry.page_fidelity(d, made, 3, share)
    chapters = spark.range(4).select(F.col("id").cast("int").alias("number"), (F.col("id") * 50).alias("start_page"))
    return geometry.chapter_means(pages, chapters, 100_000)


@Q.add("""WITH h AS (SELECT conv_id, turn AS line, role AS title_key, turn // 2 AS page FROM conversations), e AS (SELECT conv_id, 0 AS n, 'user' AS t, 0 AS page FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, 1, 'assistant', 1 FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT e.conv_id, CAST(e.n AS INT) AS n, (SELECT h.line FROM h WHERE h.conv_id = e.conv_id AND h.title_key = e.t AND abs(h.page - e.page) <= 1 ORDER BY abs(h.page - e.page), h.line LIMIT 1) AS line FROM e""")
def outline_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries and the nearest unused heading of the same title."""
    rows = table(spark, sf_dir, "conversations")
    headings = rows.select("conv_id", F.col("turn").alias("line"), F.col("role").alias("title_key"), F.floor(F.col("turn") / 2).alias("page"))
    expected = rows.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("n", "title_key")).withColumn("page", F.col("n"))
    return matching.greedy_outline(expected, headings, "conv_id")


@Q.add("""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents), p AS (SELECT doc_id, w, list_reverse(w) AS v FROM t) SELECT doc_id, CAST(len(w) AS BIGINT) AS bag, CAST(len(w) AS BIGINT) AS n_left, CAST(len(w) AS BIGINT) AS n_right FROM p""")
def bag_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's words against the same words in reverse: as multisets they are equal."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("left"), F.reverse(words).alias("right"))
    return matching.bag_aligned(rows, "doc_id")


@Q.add()
def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against themselves without their first word: 0.75 of matching blocks, which SQL has no word for, and 0.25 of token F1."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", r"^\S+\s*", "").alias("other"))
    return rows.select("item_id", F.round(text_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


@Q.add("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:p|h1|li)>([^<]*)', 1)) AS t FROM pages), k AS (SELECT page_id, trim(t) AS t FROM l)
SELECT CASE WHEN regexp_matches(lower(t), '^(?:contents|index|notes|preface|chapter)$') THEN 'generic' WHEN regexp_matches(t, '^.*\\S\\s*(?:\\.\\s?){3,}\\s*[0-9]+$') THEN 'contents row' WHEN regexp_matches(t, '^[^a-zA-Z]*$') THEN 'no letters' ELSE 'text' END AS kind, count(*) AS n FROM k GROUP BY 1""".replace("\\\\", "\\"))
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an outline passes over: generic titles, rows of a typed table of contents, rows without letters."""
    rows = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<(?:p|h1|li)>([^<]*)"), F.lit(1))).alias("t")).select(F.trim("t").alias("t"))
    return rows.groupBy(predicates.line_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@Q.add("""WITH r AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations) SELECT conv_id, turn, turn - m AS since FROM r""")
def lines_since_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the last page marker lies back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return predicates.since_marker(rows, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "since")


@Q.add("""WITH g AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role = 'user', turn // 4 ORDER BY turn) AS g FROM conversations), r AS (SELECT conv_id, turn // 4 AS page, min(turn) AS s, max(turn) AS e, count(*) AS n FROM g WHERE role <> 'user' GROUP BY conv_id, turn // 4, g) SELECT conv_id, page, s, e FROM r WHERE n BETWEEN 2 AND 3""")
def heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or three heading lines of one page."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("page"), "role")
    return predicates.heading_runs(rows, ["conv_id", "page"], "turn", F.col("role") != "user").select("conv_id", "page", "s", "e")


@Q.add("""WITH e AS (SELECT user_id AS page, event_id AS id FROM events WHERE event_id % 6 = 1), s AS (SELECT user_id AS page, event_id AS id, event_id % 4 = 3 AS active FROM events WHERE event_id % 6 = 1 AND event_id % 30 <> 7)
SELECT e.page, count(*) AS expected, count(*) FILTER (s.active) AS matched, count(*) FILTER (s.id IS NULL) AS missing FROM e LEFT JOIN s ON e.page = s.page AND e.id = s.id GROUP BY e.page""")
def active_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a page and the signatures that are active in its text."""
    rows = table(spark, sf_dir, "events").filter("event_id % 6 = 1").select(F.col("user_id").alias("page"), F.col("event_id").alias("id"))
    found = rows.filter("id % 30 <> 7").withColumn("active", F.col("id") % 4 == 3)
    return predicates.signature_matches(rows, found, ["page"], "id")


@Q.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^\\(?:textbf|textit|emph)\{', ''), '\}$', ''), '^\\(?:noindent|leavevmode)\s*', '') AS plain, k = 1 OR k = 2 AS styled, k = 3 OR k = 0 AND length(t) = 0 AS only_title FROM
  (SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '\textbf{' || source || '}' WHEN 2 THEN '\emph{' || lang || '}' ELSE '\label{' || source || '}' END AS t FROM documents)""")
def semantic_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines without the style around them, and whether there is nothing but a label."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.col("source")).when(k == 1, F.concat(F.lit(r"\textbf{"), "source", F.lit("}"))).when(k == 2, F.concat(F.lit(r"\emph{"), "lang", F.lit("}"))).otherwise(F.concat(F.lit(r"\label{"), "source", F.lit("}")))
    view = predicates.semantic_view(text)
    plain = F.when(k == 3, F.regexp_replace(text, r"\}$", "")).otherwise(view["text"])
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"), view["styled"].alias("styled"), predicates.only_title(text, F.lit(False)).alias("only_title"))


@Q.add("""WITH u AS (SELECT doc_id AS id, source AS document, doc_id % 7 <> 3 AS ok FROM documents), i AS (SELECT DISTINCT source AS document FROM documents), c AS (SELECT document, count(*) AS n, bool_and(ok) AS ok FROM (SELECT source AS document, true AS ok FROM documents WHERE doc_id % 50 = 1 UNION ALL SELECT source, doc_id % 3 = 0 FROM documents WHERE doc_id % 50 = 2) GROUP BY document),
s AS (SELECT document, count(*) AS units, count(*) FILTER (ok) AS exact FROM u GROUP BY document) SELECT s.document, units, exact, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'duplicate' WHEN c.ok THEN 'valid' ELSE 'invalid' END AS integrity, exact >= 0.8 * units AND coalesce(c.n = 1 AND c.ok, false) AS passes FROM s LEFT JOIN c ON s.document = c.document""")
def bound_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents bound to their integrity checks: both must hold."""
    d = table(spark, sf_dir, "documents")
    scores = d.groupBy(F.col("source").alias("document")).agg(F.count("*").alias("units"), F.count_if(F.col("doc_id") % 7 != 3).alias("exact"))
    own = d.filter("doc_id % 50 = 1").select(F.col("source").alias("document"), F.lit(True).alias("ok"))
    checks = own.unionByName(d.filter("doc_id % 50 = 2").select(F.col("source").alias("document"), (F.col("doc_id") % 3 == 0).alias("ok")))
    return evaluate.bound_release(scores, checks, "document", F.col("exact") >= 0.8 * F.col("units"))


@Q.add(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:theorem|lemma|figure|fig\.|table|section|equation|eq\.)\s+[0-9]+(?:\.[0-9]+)*')) AS n FROM (SELECT doc_id, regexp_replace(text, '\. ', '. Theorem ' || doc_id || '.' || length(text) % 10 || ' and Fig. 3 ', 'g') AS text FROM documents)""")
def reference_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of numbered things, planted behind every sentence."""
    planted = F.regexp_replace(F.col("text"), r"\. ", F.concat(F.lit(". Theorem "), F.col("doc_id").cast("string"), F.lit("."), (F.length("text") % 10).cast("string"), F.lit(" and Fig. 3 ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.reference_tokens(planted)).cast("bigint").alias("n"))


@Q.add("WITH d AS (SELECT doc_id, 'run-' || source AS run, doc_id % 12 AS k FROM documents) SELECT run, count(*) AS n, count(*) FILTER (k < 8) AS included, CAST(sum(CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS blocked, bool_and(k % 5 <> 2) AS safe FROM d GROUP BY run")
def packet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a run goes into a package, and what blocks it."""
    k = F.col("doc_id") % 12
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("run-"), "source").alias("run"), k.alias("k"))
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("k") < 8).alias("included"), F.sum((F.col("k") % 5 == 2).cast("int")).cast("bigint").alias("blocked"), F.bool_and(F.col("k") % 5 != 2).alias("safe"))




@Q.add(f"""WITH {SPANS}, m AS (SELECT *, CASE WHEN lag(font) OVER w IS NOT NULL AND (lag(font) OVER w <> font OR lag(size) OVER w <> size) THEN 1 ELSE 0 END AS n FROM sp WINDOW w AS (PARTITION BY page, block, line ORDER BY x0, span)), r AS (SELECT *, sum(n) OVER (PARTITION BY page, block, line ORDER BY x0, span) AS run FROM m)
SELECT page, block, line, CAST(run AS BIGINT) AS run, font, size, min(x0) AS x0, max(x1) AS x1, count(*) AS n_spans, string_agg(text, '' ORDER BY x0, span) AS text FROM r GROUP BY page, block, line, run, font, size""")
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring spans of one style."""
    return geometry.style_runs(spans(spark, sf_dir), ["page"]).withColumn("run", F.col("run").cast("bigint")).drop("y0", "y1")


@Q.add("""WITH t AS (SELECT doc_id, unnest([('x' || doc_id % 7, CASE doc_id % 3 WHEN 0 THEN '<=' WHEN 1 THEN '=' ELSE '<=' END, 'y'), ('x' || doc_id % 7, CASE WHEN doc_id % 5 = 0 THEN '>' ELSE '<=' END, 'y'), ('alpha', '!=', CAST(doc_id AS VARCHAR))]) AS r FROM documents)
SELECT doc_id, r[1] AS "left", r[3] AS "right", string_agg(DISTINCT r[2], ',' ORDER BY r[2]) AS operators, count(*) AS n FROM t GROUP BY ALL""")
def relation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that a text claims between two names."""
    i = F.col("doc_id")
    name = F.concat(F.lit("X"), (i % 7).cast("string"))
    one = F.when(i % 3 == 0, r" \leq ").when(i % 3 == 1, " = ").otherwise("<=")
    text = F.concat(name, one, F.lit("y, "), name, F.when(i % 5 == 0, " > ").otherwise(" <= "), F.lit("Y and alpha != "), i.cast("string"), F.lit("."))
    return inventory.relation_claims(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@Q.add("WITH t AS (SELECT conv_id, turn, turn // 3 AS page, CASE WHEN turn % 3 = 1 THEN 'Contents' WHEN role = 'system' THEN 'index' ELSE role END AS title FROM conversations), r AS (SELECT *, max(CASE WHEN lower(title) IN ('contents', 'index') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, page) AS real FROM t) SELECT conv_id, turn, lower(title) IN ('contents', 'index') AND real = 1 AS noise FROM r")
def outline_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic titles beside real ones."""
    title = F.when(F.col("turn") % 3 == 1, "Contents").when(F.col("role") == "system", "index").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("page"), title.alias("title"))
    return predicates.outline_noise(rows, ["conv_id", "page"], "title").select("conv_id", "turn", "noise")



@Q.add("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bracket' WHEN 1 THEN 'sketch' WHEN 2 THEN 'of' WHEN 3 THEN 'plain' WHEN 5 THEN 'plain' END AS kind, CASE doc_id % 6 WHEN 0 THEN lang WHEN 2 THEN 'Lemma ' || doc_id ELSE '' END AS argument, CASE doc_id % 6 WHEN 0 THEN 'So ' || source WHEN 1 THEN source WHEN 2 THEN 'Let ' || source WHEN 3 THEN '' WHEN 5 THEN source END AS remainder FROM documents")
def proof_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of proofs taken apart."""
    k, src = F.col("doc_id") % 6, F.col("source")
    text = F.when(k == 0, F.concat(F.lit("Proof ("), "lang", F.lit("). So "), src)).when(k == 1, F.concat(F.lit("Sketch of the proof: "), src)).when(k == 2, F.concat(F.lit("Proof of Lemma "), F.col("doc_id").cast("string"), F.lit(". Let "), src))
    text = text.when(k == 3, r"\textbf{Proof.}").when(k == 4, "Proofs are fun").otherwise(F.concat(F.lit("proof: "), src))
    return table(spark, sf_dir, "documents").select("doc_id", predicates.proof_metadata(text).alias("p")).select("doc_id", "p.*")


_TEMPLATE = r"""l AS (SELECT conv_id, turn, turn + 1 AS line, CASE turn % 4 WHEN 0 THEN '\tableofcontents' WHEN 1 THEN '\clearpage' WHEN 2 THEN '\addcontentsline{toc}{section}{' || role || '}' ELSE 'text ' || turn END AS t FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn) AS n FROM l)"""


@Q.add(rf"WITH {_TEMPLATE} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY line) AS INT) AS line, replace(t, '{{toc}}{{section}}', '{{toc}}{{chapter}}') AS text FROM k WHERE NOT (turn % 4 = 0 AND n > 1 OR turn % 4 = 1)")
def template_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates as edit plans: one table of contents, no page breaks, entries a level up."""
    k = F.col("turn") % 4
    text = F.when(k == 0, r"\tableofcontents").when(k == 1, r"\clearpage").when(k == 2, F.concat(F.lit(r"\addcontentsline{toc}{section}{"), "role", F.lit("}"))).otherwise(F.concat(F.lit("text "), F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("line"), text.alias("text"))
    return templates.applied(rows, "conv_id", ["single-contents", "no-pagination", "promoted-contents"])


@Q.add(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\\{}$%~]', ' ', 'g') AS t FROM documents) SELECT doc_id, sha256(trim(regexp_replace('é ' || t || ' ' || chr(65532) || ' end', '\s+', ' ', 'g'))) AS sha256, doc_id % 3 <> 1 AS same FROM d""")
def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of sources with styles, accents and formulas, and whether a restyled one reads the same."""
    clean = F.regexp_replace("text", r"[\\{}$%~]", " ")
    before = F.concat(F.lit(r"\'{e} \emph{"), clean, F.lit(r"} $x^2$ \label{a}end"))
    other = F.concat(F.lit(r"\'e \textbf{"), clean, F.lit(r"} \(y\) end"))
    after = F.when(F.col("doc_id") % 3 == 1, F.concat(other, F.lit(" more"))).otherwise(other)
    rows = table(spark, sf_dir, "documents").select("doc_id", visible_text(before).alias("a"), visible_text(after).alias("b"))
    plain = F.trim(F.regexp_replace(F.col("a"), r"[ \t\n\x0B\f\r]+", " "))
    return rows.select("doc_id", F.sha2(plain, 256).alias("sha256"), (F.col("a") == F.col("b")).alias("same"))
