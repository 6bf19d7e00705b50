"""Queries over TeX sources. The tables have none, so every web page is rendered as one, in Spark and in SQL by the same rules: tags become
environments, titles become section commands, and their faults (openers left, closers in scripts) become faults of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, lines, structure, tex
from ._base import Queries, table

Q = Queries()

LITERAL = ["script", "style"]
#: Patterns and what they become; ``\\1`` is the tag's name.
RULES = [
    (r"</?(?:a|b|br|meta)(?:\s[^>]*)?>", ""),
    (r"<title>", "\n\\chapter{"),
    (r"<h1>", "\n\\section{"),
    (r"<li>", "\n\\subsubsection{"),
    (r"<div(?:\s[^>]*)?>", "\n\\subsection{"),
    (r"</(?:title|h1|li|div)>", "}\n"),
    (r"<([a-z]+)(?:\s[^>]*)?>", "\n\\begin{\\1}\n"),
    (r"</([a-z]+)>", "\n\\end{\\1}\n"),
]


def rendered(html: Column, without: str) -> Column:
    """A page as a TeX source, the characters ``without`` blanked first."""
    out = F.regexp_replace(html, without, " ")
    for pattern, new in RULES:
        out = F.regexp_replace(out, pattern, new.replace("\\", "\\\\").replace("\\\\1", "$1"))
    return out


def rendered_sql(without: str) -> str:
    out = f"regexp_replace(html, '{without}', ' ', 'g')"
    for pattern, new in RULES:
        said = " || ".join(f"'{p}'" for p in new.replace("\\", "\\\\").replace("\\\\1", "\\1").split("\n"))
        out = f"regexp_replace({out}, '{pattern}', {said.replace(' || ', ' || chr(10) || ')}, 'g')"
    return out


#: Formula marks are blanked; percent signs stay and begin comments. For sections they and
#: newlines go too, so that no title loses its end.
SOURCE, PLAIN = r"[$\\]", r"[$%\\\n]"


def sources(spark: SparkSession, sf_dir: str, without: str = SOURCE) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), rendered(F.col("html"), without).alias("text"))


#: Lines, comments taken out, and tokens with their lines; then the strict stack with literal bodies, one token of each document at a time.
TEX = f"""tex AS (SELECT page_id AS doc_id, {rendered_sql(SOURCE)} AS text FROM pages),
ln AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM tex)),
bare AS (SELECT doc_id, line, text, regexp_replace(text, '%.*$', '') AS t FROM ln),
tok AS (SELECT doc_id, line, t, starts_with(t, '\\begin') AS opens, regexp_extract(t, '^\\\\(?:begin|end)\\{{([^{{}}]*)\\}}$', 1) AS name, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n
  FROM bare WHERE regexp_matches(t, '^\\\\(?:begin|end)\\{{[^{{}}]*\\}}$')),
walk(doc_id, n, stack, name, b, e, refused) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(name VARCHAR, line BIGINT)[]), NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT doc_id FROM tok)
  UNION ALL SELECT w.doc_id, s.n,
    CASE WHEN w.stack[-1].name IN ('script', 'style') AND (s.opens OR s.name <> w.stack[-1].name) THEN w.stack WHEN s.opens THEN list_append(w.stack, {{'name': s.name, 'line': s.line}})
      WHEN w.stack[-1].name = s.name THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    CASE WHEN NOT s.opens AND w.stack[-1].name = s.name THEN s.name END, CASE WHEN NOT s.opens AND w.stack[-1].name = s.name THEN w.stack[-1].line END, CASE WHEN NOT s.opens AND w.stack[-1].name = s.name THEN s.line END,
    CASE WHEN NOT s.opens AND w.stack[-1].name IS DISTINCT FROM s.name AND NOT coalesce(w.stack[-1].name IN ('script', 'style'), false) THEN s.name END
  FROM walk w JOIN tok s ON s.doc_id = w.doc_id AND s.n = w.n + 1),
env AS (SELECT doc_id, name, b, e FROM walk WHERE name IS NOT NULL), opn AS (SELECT doc_id, unnest(stack).name AS name, unnest(stack).line AS line FROM (SELECT doc_id, arg_max(stack, n) AS stack FROM walk GROUP BY doc_id)),
loose AS (SELECT doc_id, refused AS name, 'refused' AS side FROM walk WHERE refused IS NOT NULL UNION ALL SELECT doc_id, name, 'open' FROM opn)"""


@Q.add(rf"""WITH RECURSIVE {TEX}, d AS (SELECT i.doc_id, i.name, i.b, count(o.b) AS depth FROM env i LEFT JOIN env o ON i.doc_id = o.doc_id AND o.b < i.b AND o.e > i.e GROUP BY ALL),
f AS (SELECT d.*, (SELECT count(*) FROM opn WHERE opn.doc_id = d.doc_id AND opn.line < d.b) AS still FROM d)
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_documents, CAST(max(depth + still) AS INT) AS deepest FROM f GROUP BY name""")
def tex_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments by name; the depth counts all openers around, those that stay open too."""
    rows = tex.rows(sources(spark, sf_dir), "envs", literal=LITERAL)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.max("depth").alias("deepest"))


@Q.add(rf"WITH RECURSIVE {TEX} SELECT side, name, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM loose GROUP BY ALL")
def tex_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tex.rows(sources(spark, sf_dir), "unbalanced", literal=LITERAL)
    return rows.groupBy("side", "name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))


@Q.add(rf"""WITH RECURSIVE {TEX}, g AS (SELECT name, count(*) AS n FROM env GROUP BY GROUPING SETS ((name), ()))
SELECT coalesce(name, 'all') AS name, n, CASE WHEN name IS NULL THEN (SELECT count(*) FROM env WHERE name IN ('article', 'nav')) WHEN name IN ('article', 'nav') THEN n ELSE 0 END AS n_formal FROM g""")
def environment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments in all and by name, and those of the formal names among them."""
    rows = tex.rows(sources(spark, sf_dir), "envs", literal=LITERAL).select("name", F.col("name").isin("article", "nav").cast("bigint").alias("f"))
    return rows.rollup("name").agg(F.count("*").alias("n"), F.sum("f").alias("n_formal")).na.fill("all", ["name"])


#: Blocks: environments, literal bodies, and runs of lines that are neither blank nor a place where a paired environment begins or ends.
BLOCKS = rf"""{TEX}, lit AS (SELECT doc_id, b, e FROM env WHERE name IN ('script', 'style')),
ev AS (SELECT doc_id, b AS line FROM env UNION SELECT doc_id, e FROM env),
br AS (SELECT l.doc_id, l.line, trim(l.t) = '' OR ev.line IS NOT NULL OR lit.b IS NOT NULL AS brk FROM bare l LEFT JOIN ev ON l.doc_id = ev.doc_id AND l.line = ev.line LEFT JOIN lit ON l.doc_id = lit.doc_id AND l.line > lit.b AND l.line < lit.e),
gr AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM br),
blk AS (SELECT doc_id, 'para' AS kind, '' AS name, min(line) AS s, max(line) AS e FROM gr WHERE NOT brk GROUP BY doc_id, grp
  UNION ALL SELECT doc_id, 'env', name, b, e FROM env UNION ALL SELECT doc_id, 'verbatim', name, b, e FROM env WHERE name IN ('script', 'style')),
held AS (SELECT k.doc_id, k.kind, k.name, k.s, k.e, coalesce(string_agg(o.name, '/' ORDER BY o.b) FILTER (o.name <> 'document'), '') AS in_env FROM blk k
  LEFT JOIN env o ON k.doc_id = o.doc_id AND (o.b < k.s AND o.e > k.e OR k.kind <> 'para' AND o.b = k.s AND o.e = k.e) GROUP BY ALL)"""


@Q.add(f"WITH RECURSIVE {BLOCKS} SELECT doc_id, kind, name, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, in_env FROM held")
def tex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tex.rows(sources(spark, sf_dir), "blocks", literal=LITERAL)
    return rows.select("doc_id", "kind", "name", "start_line", "end_line", F.array_join("in_env", "/").alias("in_env"))


@Q.add(f"""WITH RECURSIVE {BLOCKS} SELECT doc_id, CAST(count(*) FILTER (kind = 'para') AS BIGINT) AS n_paragraphs, CAST(count(*) FILTER (kind = 'env') AS BIGINT) AS n_environments,
  CAST(count(*) FILTER (kind = 'verbatim') AS BIGINT) AS n_literal, (SELECT count(*) FROM ln WHERE ln.doc_id = held.doc_id) AS n_lines, CAST(max(e - s + 1) FILTER (kind = 'para') AS INT) AS longest FROM held GROUP BY doc_id""")
def inspection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts for each source."""
    docs = sources(spark, sf_dir)
    n = lambda k: F.count_if(F.col("kind") == k)
    blocks = tex.rows(docs, "blocks", literal=LITERAL)
    span = F.col("end_line") - F.col("start_line") + 1
    counts = blocks.groupBy("doc_id").agg(n("para").alias("n_paragraphs"), n("env").alias("n_environments"), n("verbatim").alias("n_literal"), F.max(F.when(F.col("kind") == "para", span)).alias("longest"))
    return counts.join(docs.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines")), "doc_id")


@Q.add(f"WITH RECURSIVE {BLOCKS} SELECT doc_id, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM held WHERE kind = 'para' AND NOT list_has_any(string_split(in_env, '/'), ['nav', 'footer'])")
def skip_env_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs outside of environments that are passed over."""
    rows = tex.rows(sources(spark, sf_dir), "blocks", literal=LITERAL).filter("kind = 'para'")
    return rows.filter(~F.arrays_overlap("in_env", F.array(F.lit("nav"), F.lit("footer")))).select("doc_id", "start_line", "end_line")


SECTIONS = rf"""tex AS (SELECT page_id AS doc_id, {rendered_sql(PLAIN)} AS text FROM pages),
ln AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM tex)),
sec AS (SELECT doc_id, line, regexp_extract(t, '^\\([a-z]+)\{{', 1) AS cmd, trim(regexp_extract(t, '^\\[a-z]+\{{([^{{}}]*)\}}', 1), ' ' || chr(9)) AS title,
  CASE regexp_extract(t, '^\\([a-z]+)\{{', 1) WHEN 'chapter' THEN 0 WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 ELSE 3 END AS level, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS n
  FROM ln WHERE regexp_matches(t, '^\\(?:chapter|section|subsection|subsubsection)\{{[^{{}}]*\}}')),
par AS (SELECT s.*, (SELECT max(p.n) FROM sec p WHERE p.doc_id = s.doc_id AND p.n < s.n AND p.level < s.level) AS parent FROM sec s)"""


@Q.add(f"WITH {SECTIONS} SELECT doc_id, CAST(n AS INT) AS n, cmd, title, CAST(level AS INT) AS level, CAST(line AS INT) AS line, CAST(parent AS INT) AS parent FROM par")
def tex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section commands, and the section that each belongs to."""
    return tex.rows(sources(spark, sf_dir, PLAIN), "sections", literal=LITERAL).drop("starred")


@Q.add(f"WITH {SECTIONS} SELECT level, parent_level, count(*) AS n FROM (SELECT s.level, p.level AS parent_level FROM par s LEFT JOIN par p ON s.doc_id = p.doc_id AND s.parent = p.n) GROUP BY ALL")
def parent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of sections and of their parents, by windows alone."""
    found = tex.rows(sources(spark, sf_dir, PLAIN), "sections", literal=LITERAL).select("doc_id", "n", "level", "line")
    rows = structure.parents(found, "doc_id", "n", "level", "level", 4)
    return rows.groupBy("level", F.col("parent").alias("parent_level")).agg(F.count("*").alias("n"))


@Q.add(f"WITH {SECTIONS} SELECT doc_id, count(*) AS n_jumps FROM (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM sec) WHERE level > b + 1 GROUP BY doc_id")
def level_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings more than one level below the one before."""
    from ..operators import matching

    rows = tex.rows(sources(spark, sf_dir, PLAIN), "sections", literal=LITERAL)
    return matching.level_jumps(rows, "doc_id", "n", "level").groupBy("doc_id").agg(F.count("*").alias("n_jumps"))


@Q.add(rf"""WITH RECURSIVE {TEX}, s AS (SELECT doc_id, line FROM bare WHERE regexp_matches(t, '^\\(?:chapter|section|subsection|subsubsection)\{{'))
SELECT s.doc_id, CAST(s.line AS INT) AS line, EXISTS (SELECT 1 FROM env b WHERE b.doc_id = s.doc_id AND b.name = 'nav' AND s.line BETWEEN b.b AND b.e) AS in_box FROM s""")
def boxed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section commands inside and outside of boxes."""
    docs = sources(spark, sf_dir)
    marked = lines.with_masked(lines.explode_lines(docs))
    found = marked.filter(F.col("masked").rlike(r"^\\(?:chapter|section|subsection|subsubsection)\{")).select("doc_id", "line")
    return tex.inside(found, tex.rows(docs, "envs", literal=LITERAL), "doc_id", "line", ["nav"])


@Q.add(rf"""WITH RECURSIVE {BLOCKS}, p AS (SELECT doc_id, line FROM bare WHERE trim(t) <> ''),
c AS (SELECT p.doc_id, p.line, k.s, k.e, row_number() OVER (PARTITION BY p.doc_id, p.line ORDER BY CASE WHEN k.kind = 'env' AND k.name = 'ul' THEN 0 ELSE 1 END, CASE WHEN k.kind = 'env' AND k.name = 'ul' THEN k.s - k.e ELSE k.e - k.s END, -k.s) AS r
  FROM p JOIN blk k ON p.doc_id = k.doc_id AND p.line BETWEEN k.s AND k.e)
SELECT doc_id, CAST(line AS INT) AS line, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM c WHERE r = 1""")
def enclosing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block around each line: the outermost formula (here: list), else the innermost block."""
    docs = sources(spark, sf_dir)
    blocks = tex.rows(docs, "blocks", literal=LITERAL)
    points = lines.with_masked(lines.explode_lines(docs)).filter(F.trim("masked") != "").select("doc_id", "line")
    found = tex.enclosing(points, blocks, "doc_id", "line", [], ["ul"]).filter("block IS NOT NULL")
    return found.join(blocks.select("doc_id", F.col("block_id").alias("block"), "start_line", "end_line"), ["doc_id", "block"]).drop("block")


@Q.add(r"""WITH t AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<p>|</p>|<li>|<article>|</article>') AS x FROM pages),
u AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS t FROM t),
d AS (SELECT *, last_value(CASE t WHEN '<p>' THEN true WHEN '</p>' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o,
  sum(CASE t WHEN '<article>' THEN 1 WHEN '</article>' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS open FROM u),
i AS (SELECT doc_id, CASE WHEN t = '<p>' AND o THEN 'opened twice' WHEN t = '</p>' AND NOT coalesce(o, false) THEN 'closed without an opener' WHEN t = '<li>' AND o THEN 'tag inside' WHEN t = '</article>' AND open >= 0 AND o THEN 'environment ends inside' END AS issue FROM d
  UNION ALL SELECT doc_id, 'left open' FROM (SELECT doc_id, arg_max(t, pos) AS t FROM u WHERE t IN ('<p>', '</p>') GROUP BY doc_id) WHERE t = '<p>')
SELECT doc_id, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY ALL""")
def display_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of display delimiters; paragraph tags are the delimiters, list items tags, articles theorems."""
    text = F.regexp_replace(F.col("html"), r"[\\%$]", " ")
    for pattern, new in ((r"<p>", r"\\["), (r"</p>", r"\\]"), (r"<li>", r"\\tag "), (r"<article>", r"\\begin{theorem}"), (r"</article>", r"\\end{theorem}")):
        text = F.regexp_replace(text, pattern, new)
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("masked"))
    return gates.display_issues(docs, "doc_id").groupBy("doc_id", "issue").agg(F.count("*").alias("n"))


@Q.add(r"""WITH t AS (SELECT page_id AS doc_id, regexp_extract_all(html, '</?p>') AS x FROM pages), u AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS t FROM t),
d AS (SELECT *, sum(CASE t WHEN '<p>' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM u),
a AS (SELECT doc_id, min(pos) FILTER (depth < 0) AS first_negative, arg_max(depth, pos) AS depth FROM d GROUP BY doc_id)
SELECT doc_id, CAST(first_negative AS INT) AS first_negative, CAST(depth AS BIGINT) AS depth, first_negative IS NULL AND depth = 0 AS ok FROM a""")
def brace_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph tags as braces: the first that closes too much, the depth at the end, and the fold's verdict."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"[{}\\]", " "), "<p>", "{"), "</p>", "}")
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))
    marks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([{}])"), F.lit(1))).alias("pos", "mark"))
    verdict = docs.select("doc_id", structure.brace_balance(F.col("text"))["ok"].alias("ok"))
    return structure.first_negative(marks, "doc_id").join(verdict, "doc_id")


PAIRS_SQL = rf"""src AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(html, '[%$\\{{}}]', ' ', 'g'), '<li>([^<]*)</li>|<li><a[^>]*>([^<]*)</a></li>', '\\label{{\1\2}} \\ref{{\1\2}} ', 'g'), '<(/?)ul>', '<\1ul>', 'g') AS h FROM pages),
b AS (SELECT doc_id, replace(replace(replace(replace(h, '<ul>', '\begin{{equation}}'), '</ul>', '\end{{equation}}'), '<h1>', ' $'), '</h1>', '$ ') AS before FROM src),
pr AS (SELECT doc_id, before, CASE doc_id % 6 WHEN 0 THEN before WHEN 1 THEN '\begin{{proof}}' || chr(10) || before || chr(10) || '\end{{proof}}' WHEN 2 THEN regexp_replace(before, '\\label\{{[^{{}}]*\}}', '')
  WHEN 3 THEN replace(before, '\end{{equation}}', 'x \end{{equation}}') WHEN 4 THEN before || '}}' ELSE before || '\begin{{proof}}' END AS after FROM b)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources with labels, references, a formula environment and a dollar formula; and edited: not at all, by a legal wrap, a lost
    label, a changed formula, a brace too many, an opener too many."""
    text = F.regexp_replace(F.col("html"), r"[%$\\{}]", " ")
    text = F.regexp_replace(text, r"<li>([^<]*)</li>|<li><a[^>]*>([^<]*)</a></li>", r"\\label{$1$2} \\ref{$1$2} ")
    for pattern, new in (("<ul>", r"\\begin{equation}"), ("</ul>", r"\\end{equation}"), ("<h1>", r" \$"), ("</h1>", r"\$ ")):
        text = F.regexp_replace(text, pattern, new)
    k, b = F.col("doc_id") % 6, F.col("before")
    after = (
        F.when(k == 0, b).when(k == 1, F.concat(F.lit("\\begin{proof}\n"), b, F.lit("\n\\end{proof}"))).when(k == 2, F.regexp_replace(b, r"^((?s).*?)\\label\{[^{}]*\}", "$1"))
        .when(k == 3, F.replace(b, F.lit(r"\end{equation}"), F.lit(r"x \end{equation}"))).when(k == 4, F.concat(b, F.lit("}"))).otherwise(F.concat(b, F.lit(r"\begin{proof}")))
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("before")).withColumn("after", after)


_SORTED = lambda side, pattern: f"list_sort(regexp_extract_all({side}, '{pattern}', 1))"
_FORMULAS = lambda side: f"list_sort(list_transform(regexp_extract_all({side}, '(?s)\\\\begin\\{{equation\\}}(.*?)\\\\end\\{{equation\\}}', 1) || regexp_extract_all({side}, '\\$([^$\\n]+)\\$', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))))"
_BALANCE = lambda side: f"(len(regexp_extract_all({side}, '\\{{')) - len(regexp_extract_all({side}, '\\}}')))"
CHECKS_SQL = rf"""{PAIRS_SQL}, ck AS (SELECT doc_id, 'labels' AS "check", {_SORTED("before", "\\\\label\\{([^{}]*)\\}")} = {_SORTED("after", "\\\\label\\{([^{}]*)\\}")} AS ok FROM pr
  UNION ALL SELECT doc_id, 'refs', {_SORTED("before", "\\\\ref\\{([^{}]*)\\}")} = {_SORTED("after", "\\\\ref\\{([^{}]*)\\}")} FROM pr
  UNION ALL SELECT doc_id, unnest(['cites', 'images']), true FROM pr
  UNION ALL SELECT doc_id, 'math', {_FORMULAS("before")} = {_FORMULAS("after")} FROM pr
  UNION ALL SELECT doc_id, 'braces', {_BALANCE("after")} = 0 FROM pr
  UNION ALL SELECT doc_id, 'environments', len(regexp_extract_all(after, '\\begin\{{')) = len(regexp_extract_all(after, '\\end\{{')) FROM pr)"""


@Q.add(f'WITH {CHECKS_SQL} SELECT doc_id, "check", ok FROM ck')
def edit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each edit left as it was."""
    return gates.check_edits(_pairs(spark, sf_dir)).select("doc_id", "check", "ok")


@Q.add(f"""WITH {CHECKS_SQL}, o AS (SELECT doc_id, bool_and(ok) AS accepted FROM ck GROUP BY doc_id)
SELECT pr.doc_id, o.accepted, sha256(CASE WHEN o.accepted THEN after ELSE before END) AS sha256, CASE WHEN o.accepted THEN '' ELSE (SELECT string_agg("check", ',' ORDER BY CASE "check" WHEN 'environments' THEN 0 WHEN 'braces' THEN 1 WHEN 'math' THEN 2 WHEN 'labels' THEN 3 WHEN 'refs' THEN 4 ELSE 5 END) FROM ck WHERE ck.doc_id = pr.doc_id AND NOT ok) END AS failed
FROM pr JOIN o ON pr.doc_id = o.doc_id""")
def final_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text where every check holds, else the source."""
    pairs = _pairs(spark, sf_dir)
    verdict = gates.final_gate(gates.check_edits(pairs))
    text = F.when(F.col("accepted"), F.col("after")).otherwise(F.col("before"))
    return pairs.join(verdict, "doc_id").select("doc_id", "accepted", F.sha2(text, 256).alias("sha256"), F.array_join("failed", ",").alias("failed"))


@Q.add(r"""WITH l AS (SELECT page_id AS doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT page_id, string_split(replace(html, '<p>', chr(10) || '\left( \begin{matrix}'), chr(10)) AS x FROM pages)),
m AS (SELECT doc_id, line, regexp_replace(t, '%.*$', '') AS t FROM l)
SELECT doc_id, CAST(line AS INT) AS line, 'matrix behind a stretched bracket' AS issue FROM m WHERE regexp_matches(t, '\\left\s*\(\s*\\begin\{matrix\}')""")
def known_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("html"), F.lit("<p>"), F.lit("\n\\left( \\begin{matrix}"))
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))
    return gates.known_issues(lines.with_masked(lines.explode_lines(docs)), "doc_id")


#: Structures begin at paragraphs in an article that begin with a capital from A to E, and stop at capitals from A to H. Paragraphs that
#: begin with a capital from I to R don't join; the others do.
_WALK = rf"""{BLOCKS}, first AS (SELECT h.*, left(trim(l.text), 1) AS c, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.s, CASE h.kind WHEN 'env' THEN 0 ELSE 1 END, h.e DESC) AS k FROM held h JOIN ln l ON h.doc_id = l.doc_id AND h.s = l.line WHERE h.kind IN ('para', 'env')),
start AS (SELECT doc_id, s, e, sum(CASE WHEN kind = 'para' AND c BETWEEN 'A' AND 'E' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g, kind = 'para' AND c BETWEEN 'A' AND 'E' AS st, kind, c, k FROM first),
ext AS (SELECT *, max(e) OVER (PARTITION BY doc_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM start WHERE g > 0),
own AS (SELECT *, max(CASE WHEN st THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS body FROM ext WHERE st OR s > reach),
stp AS (SELECT *, max(CASE WHEN NOT st AND (kind = 'para' AND c BETWEEN 'A' AND 'H' OR kind = 'para' AND c BETWEEN 'I' AND 'R' AND coalesce(body, 0) = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY k) AS over FROM own)"""


@Q.add(f"WITH RECURSIVE {_WALK} SELECT doc_id, CAST(min(s) AS INT) AS start_line, CAST(max(e) AS INT) AS end_line FROM stp WHERE over = 0 GROUP BY doc_id, g")
def extended_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far structures reach over the blocks behind them."""
    blocks = tex.rows(sources(spark, sf_dir), "blocks", literal=LITERAL).filter("kind IN ('para', 'env')")
    c, para = F.left(F.trim(F.split("text", "\n")[0]), F.lit(1)), F.col("kind") == "para"
    blocks = blocks.withColumn("c", c)
    begins, stop = para & F.col("c").between("A", "E"), para & F.col("c").between("A", "H")
    return tex.extended(blocks, "doc_id", begins, stop, ~(para & F.col("c").between("I", "R")), F.lit(True) & ~begins, F.lit(True))


_ENDS = r"""ln AS (SELECT conv_id, turn, role, text, coalesce(trim(text), '') <> '' AS live FROM conversations),
st AS (SELECT conv_id, turn FROM ln WHERE role = 'user' AND turn > 0),
q AS (SELECT conv_id, turn AS start, turn + 1 AS requested FROM ln WHERE role = 'assistant' AND live),
x AS (SELECT q.*, (SELECT min(turn) FROM st WHERE st.conv_id = q.conv_id AND st.turn > q.start) AS stop, (SELECT min(turn) FROM ln WHERE ln.conv_id = q.conv_id AND ln.turn >= q.start AND live AND text LIKE '%thth%') AS sign FROM q),
y AS (SELECT x.*, (SELECT max(turn) FROM ln WHERE ln.conv_id = x.conv_id AND live AND turn < x.stop) AS last, (SELECT max(turn) FROM ln WHERE ln.conv_id = x.conv_id AND live AND turn <= x.requested) AS own FROM x)"""


@Q.add(f"""WITH {_ENDS} SELECT conv_id AS doc_id, start AS ident, CASE WHEN sign IS NOT NULL AND (stop IS NULL OR sign < stop) THEN sign WHEN stop IS NOT NULL AND last >= start AND (requested >= stop OR own = last) THEN last END AS safe_end FROM y""")
def safe_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends that can be shown: turns are lines, users begin structures, and a run of letters is the end sign."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.coalesce("text", F.lit("")).alias("text"), "role")
    halts = rows.filter("role = 'user' AND line > 0").select("doc_id", F.col("line").alias("start_line"))
    asked = rows.filter("role = 'assistant' AND trim(text) <> ''").select("doc_id", F.col("line").alias("ident"), F.col("line").alias("start"), (F.col("line") + 1).alias("requested"))
    none = rows.limit(0).select("doc_id", F.lit("para").alias("kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return tex.safe_ends(asked, rows, none, halts, "doc_id", "ident", F.col("text").contains("thth"))
