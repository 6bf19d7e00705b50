"""Queries over web pages: tags, pairs, ancestors, headings, hosts, paths, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keysets, lines, structure
from ._base import Queries, table

Q = Queries()

VOID = ", ".join(f"'{v}'" for v in structure.VOID)
TAGS = f"""x AS (SELECT page_id, regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1) AS t FROM pages),
u AS (SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tag FROM x),
k AS (SELECT page_id, pos, lower(regexp_replace(tag, '^/', '')) AS name, CASE WHEN tag LIKE '/%' THEN 'close' ELSE 'open' END AS kind FROM u),
tok AS (SELECT * FROM k WHERE name NOT IN ({VOID}))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.tag_tokens(table(spark, sf_dir, "pages"))


@Q.add(f"WITH {TAGS}, d AS (SELECT page_id, pos, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tok) SELECT page_id, count(*) AS n_tokens, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest FROM d GROUP BY page_id")
def tag_pairing_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.depth(tokens(spark, sf_dir), "page_id").groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.max("depth").alias("deepest"), F.min("depth").alias("lowest"))


@Q.add(f"""WITH RECURSIVE {TAGS}, seq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM tok),
walk(page_id, n, stack, pairs, refused) AS (
  SELECT page_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT page_id FROM tok)
  UNION ALL SELECT w.page_id, s.n, CASE WHEN s.kind = 'open' THEN list_append(w.stack, s.name) WHEN len(w.stack) > 0 AND w.stack[len(w.stack)] = s.name THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    w.pairs + CASE WHEN s.kind = 'close' AND len(w.stack) > 0 AND w.stack[len(w.stack)] = s.name THEN 1 ELSE 0 END,
    w.refused + CASE WHEN s.kind = 'close' AND NOT (len(w.stack) > 0 AND w.stack[len(w.stack)] = s.name) THEN 1 ELSE 0 END
  FROM walk w JOIN seq s ON s.page_id = w.page_id AND s.n = w.n + 1)
SELECT page_id, arg_max(pairs, n) AS n_pairs, CAST(arg_max(len(stack), n) AS BIGINT) AS n_open, arg_max(refused, n) AS n_refused FROM walk GROUP BY page_id""")
def tag_strict_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pair_tokens(tokens(spark, sf_dir), "page_id")


#: The walk of tag_strict_stack that also keeps the places of what is open, and gives each pair as a row.
PAIRS = f"""{TAGS}, seq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM tok),
walk(page_id, n, stack, name, open, close) AS (
  SELECT page_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(name VARCHAR, pos BIGINT)[]), NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT page_id FROM tok)
  UNION ALL SELECT w.page_id, s.n, CASE WHEN s.kind = 'open' THEN list_append(w.stack, {{'name': s.name, 'pos': s.pos}}) WHEN len(w.stack) > 0 AND w.stack[len(w.stack)].name = s.name THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    CASE WHEN s.kind = 'close' AND len(w.stack) > 0 AND w.stack[len(w.stack)].name = s.name THEN s.name END,
    CASE WHEN s.kind = 'close' AND len(w.stack) > 0 AND w.stack[len(w.stack)].name = s.name THEN w.stack[len(w.stack)].pos END,
    CASE WHEN s.kind = 'close' AND len(w.stack) > 0 AND w.stack[len(w.stack)].name = s.name THEN s.pos END
  FROM walk w JOIN seq s ON s.page_id = w.page_id AND s.n = w.n + 1),
pr AS (SELECT page_id, name, open, close FROM walk WHERE name IS NOT NULL)"""


@Q.add(f"""WITH RECURSIVE {PAIRS}, q AS (SELECT i.page_id, i.name, i.open, string_agg(o.name, '/' ORDER BY o.open) AS path FROM pr i LEFT JOIN pr o ON i.page_id = o.page_id AND o.open < i.open AND o.close > i.close GROUP BY ALL)
SELECT coalesce(path, '') AS path, name, count(*) AS n FROM q GROUP BY ALL""")
def ancestor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the names around them."""
    return structure.ancestors(tokens(spark, sf_dir), "page_id").groupBy("path", "name").agg(F.count("*").alias("n"))


@Q.add(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)', 1)) AS t FROM pages)
SELECT page_id, trim(t) AS heading, count(*) AS n FROM h GROUP BY ALL""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)"), F.lit(1))).alias("t"))
    return rows.groupBy("page_id", F.trim("t").alias("heading")).agg(F.count("*").alias("n"))


@Q.add(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h[1-6]|b)[^>]*>([^<]*)', 1)) AS t FROM pages)
SELECT page_id, trim(t) AS heading, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 1""")
def repeated_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:h[1-6]|b)[^>]*>([^<]*)"), F.lit(1))).alias("t"))
    return rows.groupBy("page_id", F.trim("t").alias("heading")).agg(F.count("*").alias("n")).filter("n > 1")


@Q.add(r"SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)), '\.$', ''), '') AS host FROM pages")
def host_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))


_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)', 1)"


@Q.add(rf"""WITH p AS (SELECT DISTINCT {_PATH} AS own FROM pages), l AS (SELECT DISTINCT lower(own) AS p FROM p),
f AS (SELECT DISTINCT list_aggregate(x[1:i], 'string_agg', '/') AS p FROM (SELECT x, unnest(range(1, len(x))) AS i FROM (SELECT string_split(p, '/') AS x FROM l)))
SELECT lower(own) AS p, 'case' AS reason FROM p GROUP BY 1 HAVING count(DISTINCT own) > 1 UNION ALL SELECT p, 'folder' FROM l WHERE p IN (SELECT p FROM f)""")
def namespace_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)", 1).alias("path"))
    return keysets.path_collisions(paths, "path")


@Q.add(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1) AS t FROM pages)
SELECT lower(tag) AS name, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(t) AS tag FROM t) WHERE tag NOT LIKE '/%' GROUP BY 1""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return rows.filter(~F.col("tag").startswith("/")).groupBy(F.lower("tag").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@Q.add(f"""WITH {TAGS}, a AS (SELECT page_id, pos, name, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS line, CASE name WHEN 'body' THEN 0 WHEN 'article' THEN 1 WHEN 'h1' THEN 2 WHEN 'p' THEN 3 END AS level FROM tok WHERE kind = 'open' AND name IN ('body', 'article', 'h1', 'p')),
m AS (SELECT *, max(CASE WHEN level = 0 THEN pos END) OVER w AS a0, max(CASE WHEN level = 1 THEN pos END) OVER w AS a1, max(CASE WHEN level = 2 THEN pos END) OVER w AS a2, max(CASE WHEN level = 3 THEN pos END) OVER w AS a3 FROM a WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
s AS (SELECT page_id, list_filter([CASE WHEN level >= 0 AND a0 IS NOT NULL THEN 'body' END,
  CASE WHEN level >= 1 AND a1 IS NOT NULL AND (a0 IS NULL OR a1 > a0) THEN 'article' END,
  CASE WHEN level >= 2 AND a2 IS NOT NULL AND (coalesce(greatest(a0, a1), a0, a1) IS NULL OR a2 > coalesce(greatest(a0, a1), a0, a1)) THEN 'h1' END,
  CASE WHEN level >= 3 AND a3 IS NOT NULL AND (greatest(coalesce(a0, -1), coalesce(a1, -1), coalesce(a2, -1)) < a3) THEN 'p' END], lambda x: x IS NOT NULL) AS path FROM m)
SELECT array_to_string(path, '/') AS path, count(*) AS n FROM s GROUP BY 1""")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("name") == "body", 0).when(F.col("name") == "article", 1).when(F.col("name") == "h1", 2).when(F.col("name") == "p", 3)
    rows = tokens(spark, sf_dir).filter("kind = 'open'").withColumn("level", level).filter("level IS NOT NULL")
    return lines.section_paths(rows, "page_id", "pos", "level", "name").groupBy(F.array_join("section_path", "/").alias("path")).agg(F.count("*").alias("n"))
