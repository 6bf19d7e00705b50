"""Queries over texts: lines, blocks, candidates, edits, tokens, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, edits, keysets, lines, multisets, sampling
from ..operators.storage import below, written
from ._base import Queries, table

Q = Queries()

LINES = """l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS text FROM
  (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents))"""


def doc_lines(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    return lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), offsets=offsets)


@Q.add(f"WITH {LINES} SELECT doc_id, CAST(line AS INT) AS line, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_off FROM l")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir, offsets=True)


@Q.add(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS collapsed,
  CASE WHEN contains(text, chr(13) || chr(10)) THEN 'CRLF' WHEN contains(text, chr(13)) THEN 'CR' ELSE 'LF' END AS newline FROM
  (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, chr(10), chr(13)) END AS text FROM documents)""")
def newline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, two thirds of them rewritten with other newlines, for the tables have LF alone."""
    k = F.col("doc_id") % 3
    text = F.when(k == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", T.collapse_space(T.normalise_newlines(F.col("text"))).alias("collapsed"), T.newline_of(F.col("text")).alias("newline"))


@Q.add(rf"""WITH {LINES} SELECT doc_id, CAST(line AS INT) AS line, rpad(regexp_extract(text, '^((?:[^\\%]|\\.|\\$)*)', 1), CAST(length(text) AS INT), ' ') AS masked FROM l WHERE contains(text, '%')""")
def mask_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_masked(doc_lines(spark, sf_dir)).filter(F.col("text").contains("%")).select("doc_id", "line", "masked")


@Q.add(rf"""WITH {LINES}, b AS (SELECT *, trim(text) = '' OR contains(text, '|') AS br FROM l),
g AS (SELECT *, sum(CAST(br AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM b)
SELECT doc_id, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line, count(*) AS n_lines,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(line)) - 1 AS INT) AS block_id FROM g WHERE NOT br GROUP BY doc_id, grp""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.blocks(doc_lines(spark, sf_dir), (F.trim("text") == "") | F.col("text").contains("|"))


_KIND = """CASE WHEN regexp_matches(t, '^(?:Licensed under|Released under|This work is licensed)') THEN 'license'
  WHEN regexp_matches(t, '^[^|]+(?: \\| [^|]+){3,}') THEN 'table' WHEN regexp_matches(t, '^[A-Z]{2,}!! ') THEN 'shout'
  WHEN regexp_matches(t, '^[0-9]+(?:\\.[0-9]+)*[.:)] ') THEN 'numbered' END""".replace("\\\\", "\\")
_CANDIDATES = rf"""m AS (SELECT doc_id, line, trim(rpad(regexp_extract(text, '^((?:[^\\%]|\\.|\\$)*)', 1), CAST(length(text) AS INT), ' ')) AS t FROM l),
k AS (SELECT *, {_KIND} AS kind, regexp_extract(t, '^[^0-9]*?([0-9]+(?:\.[0-9]+)*)', 1) AS number FROM m)"""


def found_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.title_candidates(lines.with_masked(doc_lines(spark, sf_dir)), candidates.PLAIN_PACK, carry=["text"])


@Q.add(f"""WITH {LINES}, {_CANDIDATES} SELECT doc_id, printf('c-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY line)) AS candidate_id,
  kind, CAST(line AS INT) AS line, t AS title, number, CASE WHEN number <> '' THEN 0.85 ELSE 0.7 END AS confidence FROM k WHERE kind IS NOT NULL""")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_titles(spark, sf_dir).drop("text")


@Q.add(f"""WITH {LINES}, {_CANDIDATES} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_documents, round(avg(CASE WHEN number <> '' THEN 0.85 ELSE 0.7 END), 6) AS mean_confidence
  FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def candidates_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, masks, candidates, counts by kind: the engine's first path, end to end."""
    found = title_candidates(spark, sf_dir)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@Q.add(f"""WITH {LINES}, {_CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'license' THEN 0 WHEN 'shout' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, line) AS n FROM k WHERE kind IS NOT NULL)
SELECT doc_id, kind, CAST(line AS INT) AS line FROM p WHERE n = 1""")
def rule_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    order = F.when(kind == "license", 0).when(kind == "shout", 1).when(kind == "table", 2).otherwise(3)
    return candidates.best_rule(title_candidates(spark, sf_dir), ["doc_id"], order, ["line"]).select("doc_id", "kind", "line")


def planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines, and an edit plan: licence lines go, tables are wrapped, shouted lines are lowered."""
    rows = doc_lines(spark, sf_dir)
    found = found_titles(spark, sf_dir).select("doc_id", "candidate_id", "kind", "line", "text")
    tables = found.filter("kind = 'table'").select("doc_id", F.col("candidate_id").alias("decision"), F.col("line").alias("seq"), F.lit("tabular").alias("env"), F.col("line").alias("start"), F.col("line").alias("end"))
    seq = (F.col("line") * 2).alias("seq")
    gone = found.filter("kind = 'license'").select("doc_id", F.col("candidate_id").alias("decision"), seq, F.lit("delete").alias("kind"), "line", F.col("text").alias("old"), F.lit(None).cast("string").alias("new"))
    low = found.filter("kind = 'shout'").select("doc_id", F.col("candidate_id").alias("decision"), seq, F.lit("replace").alias("kind"), "line", F.col("text").alias("old"), F.lower("text").alias("new"))
    return rows, edits.wrap_ops(tables, "doc_id").unionByName(gone).unionByName(low)


_EDITED = f"""WITH {LINES}, {_CANDIDATES}, e AS (SELECT l.doc_id, l.line, l.text, k.kind FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.line = k.line),
o AS (SELECT doc_id, line, 1 AS r, 0 AS seq, CASE WHEN kind = 'shout' THEN lower(text) ELSE text END AS text FROM e WHERE kind IS DISTINCT FROM 'license'
  UNION ALL SELECT doc_id, line, 0, 2 * line, '\\begin{{tabular}}' FROM e WHERE kind = 'table'
  UNION ALL SELECT doc_id, line + 1, 0, 2 * line + 1, '\\end{{tabular}}' FROM e WHERE kind = 'table')""".replace("\\\\", "\\")


@Q.add(_EDITED + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, r, seq) AS INT) AS line, text FROM o")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ops = planned(spark, sf_dir)
    return edits.apply_ops(rows, edits.valid_ops(ops, rows, "doc_id"), "doc_id")


@Q.add("SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha256 FROM documents")
def revert_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that were edited and reverted: those of the texts themselves."""
    rows, ops = planned(spark, sf_dir)
    edited = edits.apply_ops(rows, ops, "doc_id")
    return edits.digest(edits.apply_ops(edited, edits.inverse_ops(rows, ops, "doc_id"), "doc_id"), "doc_id")


_WORDS = r"regexp_extract_all(lower(text), '\p{L}+')"


@Q.add(rf"""WITH d AS (SELECT row_number() OVER () AS rid, text FROM documents), t AS (SELECT rid, unnest({_WORDS}) AS word FROM d)
SELECT word, count(*) AS n, count(DISTINCT rid) AS n_documents FROM t GROUP BY word""")
def token_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted inside their text first, so a text gives a row for each word of its own and none for a repeat."""
    counted = table(spark, sf_dir, "documents").select(F.inline(multisets.word_counts(T.words(F.col("text")))))
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_documents"))


@Q.add(rf"""WITH {LINES}, t AS (SELECT trim(text) AS text, doc_id FROM l WHERE trim(text) <> '')
SELECT text, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM t GROUP BY text HAVING count(*) >= 2 AND count(DISTINCT doc_id) >= 2""")
def running_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("doc_id", F.trim("text").alias("text")).filter("text <> ''")
    return rows.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents")).filter("n >= 2 AND n_documents >= 2")


def _grams_sql(name: str, source: str, key: str) -> str:
    """``name`` (key, g): the distinct five-word runs of a table's texts; fewer words are one run."""
    return rf"""{name}0 AS (SELECT {key}, {_WORDS} AS w FROM {source}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}0 WHERE len(w) > 0))"""


@Q.add(rf"""WITH {_grams_sql("dg", "documents", "doc_id")}, {_grams_sql("bg", "benchmark", "item_id")},
p AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL),
a AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM dg0) GROUP BY ALL), b AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(w) AS t FROM bg0) GROUP BY ALL),
m AS (SELECT p.doc_id, p.item_id, sum(least(a.n, b.n)) AS matched FROM p JOIN a ON p.doc_id = a.doc_id JOIN b ON p.item_id = b.item_id AND a.t = b.t GROUP BY ALL)
SELECT d.doc_id, p.item_id, CAST(coalesce(m.matched, 0) AS BIGINT) AS matched, CAST(len(d.w) AS BIGINT) AS n_left, CAST(coalesce(len(i.w), 0) AS BIGINT) AS n_right,
  round(CASE WHEN coalesce(m.matched, 0) > 0 THEN 2.0 * m.matched / (len(d.w) + len(i.w)) ELSE 0.0 END, 6) AS f1
FROM dg0 d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN bg0 i ON p.item_id = i.item_id LEFT JOIN m ON p.doc_id = m.doc_id AND p.item_id = m.item_id""")
def multiset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the benchmark items that it shares a run of words with, as multisets of words; one row without an item
    for a document that shares nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    hashed = lambda d, key: d.select(key, multisets.gram_hashes(F.col("w")).alias("grams"))
    pairs = written(multisets.shared_grams(hashed(docs, "doc_id"), hashed(items, "item_id"), "doc_id", "item_id", "grams").drop("shared"), "pairs")
    pair = F.concat_ws(":", "doc_id", "item_id").alias("pair")
    left = pairs.join(docs, "doc_id").select(pair, F.inline(multisets.word_counts(F.col("w"))))
    right = pairs.join(items, "item_id").select(pair, F.inline(multisets.word_counts(F.col("w"))))
    scored = multisets.counted_f1(left, right, "pair", "word")
    found = pairs.select("doc_id", "item_id", pair).join(scored, "pair").select("doc_id", "item_id", "matched", "n_left", "n_right", "f1")
    zero = F.lit(0).cast("bigint")
    rest = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti")
    rest = rest.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), zero.alias("matched"), F.size("w").cast("bigint").alias("n_left"), zero.alias("n_right"), F.lit(0.0).alias("f1"))
    return below(found, rest, keys=["doc_id"])


@Q.add(r"""WITH d AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents), b AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM benchmark),
x AS (SELECT t FROM b EXCEPT ALL SELECT t FROM d) SELECT t, count(*) AS n FROM x GROUP BY t""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: table(spark, sf_dir, name).select(F.explode(T.words(F.col("text"))).alias("t"))
    return multisets.multiset_difference(one("benchmark"), one("documents")).groupBy("t").agg(F.count("*").alias("n"))


_CLASSES = rf"""{_grams_sql("g", "documents", "doc_id")}, s AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class, n FROM s)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", multisets.gram_hashes(T.words(F.col("text"))).alias("grams"))


@Q.add(f"WITH {_CLASSES} SELECT doc_id, class, CAST(n AS INT) AS n FROM c")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with words by the set of their five-word runs: the class is the least document with the same set."""
    return multisets.gram_classes(_sets(spark, sf_dir), "grams", "doc_id")


@Q.add(f"""WITH {_CLASSES}, r AS (SELECT g.doc_id, g.g, c.n FROM g JOIN c ON g.doc_id = c.doc_id AND c.doc_id = c.class),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, CAST(c AS INT) AS common, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE round(c / (na + nb - c), 6) >= 0.82""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of the classes' representatives; ``jaccard_classes`` has the members. Texts are read and hashed once."""
    sets = written(_sets(spark, sf_dir), "grams")
    first = multisets.gram_classes(sets, "grams", "doc_id").filter("doc_id = class").select("doc_id")
    return multisets.class_pairs(written(sets.join(first, "doc_id", "left_semi"), "classes"), "grams", "doc_id", 0.82)


@Q.add("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@Q.add("""WITH p AS (SELECT doc_id, lang, sha256('seed-1' || chr(31) || lang || chr(31) || doc_id) AS p FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS rank FROM p)
SELECT doc_id, lang, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def hash_priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.top_by_priority(rows, ["lang"], [sampling.priority(F.col("lang"), F.col("doc_id").cast("string"), seed="seed-1")], 5)


@Q.add("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT doc_id, source, CAST(least(2, floor((i - 1) * 3 / n)) AS INT) AS region FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY source, region ORDER BY doc_id) AS rank FROM t)
SELECT doc_id, source, region, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def stratified_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.positions(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    rows = rows.select("doc_id", "source", sampling.thirds(F.col("position"), F.col("total")).alias("region"))
    return sampling.top_by_priority(rows, ["source", "region"], [F.col("doc_id")], 2)


@Q.add("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM n WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6, 0) AS BIGINT) FROM range(7) t(k))""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 7, ["source"])


@Q.add("""WITH p AS (SELECT doc_id, source, sha256(chr(31) || doc_id) AS p FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS turn FROM p)
SELECT doc_id, source, CAST(turn AS INT) AS turn FROM r ORDER BY turn, p LIMIT 50""")
def round_robin_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50: the limit is the operator."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", sampling.priority(F.col("doc_id").cast("string")), 50)


@Q.add("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CAST(floor(i * ceil(n / 4) / n) AS INT) AS batch FROM n""")
def balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 4)


@Q.add("SELECT lang, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.9), 6) AS p90, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS median_rank FROM documents GROUP BY lang")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are counted before they meet, so a hot language costs its distinct values, not its rows."""
    counted = written(table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n")), "histogram")
    smooth = counted.groupBy("lang").agg(*[F.round(F.percentile("n_chars", p, F.col("n")), 6).alias(name) for name, p in (("p10", 0.1), ("p90", 0.9))])
    w = Window.partitionBy("lang")
    upto, total = F.sum("n").over(w.orderBy("n_chars")), F.sum("n").over(w)
    ranked = counted.filter("n_chars IS NOT NULL").withColumn("_in", upto >= F.ceil(0.5 * total)).groupBy(F.col("lang").alias("_l"))
    median = ranked.agg(F.min(F.when(F.col("_in"), F.col("n_chars"))).cast("bigint").alias("median_rank"))
    return smooth.join(median, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


@Q.add("WITH m AS (SELECT DISTINCT source, lang || ':' || CAST(floor(n_chars / 1000) AS BIGINT) AS m FROM documents) SELECT source, CAST(count(*) AS INT) AS n_members, sha256(string_agg(m, chr(10) ORDER BY m)) AS sha256 FROM m GROUP BY source")
def ledger_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 1000)).alias("m"))
    return keysets.set_digest(rows, "source", "m")


@Q.add(rf"""WITH {LINES}, r AS (SELECT doc_id, line, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, line) AS rank FROM l)
SELECT doc_id, CAST(line AS INT) AS line, CAST(n AS INT) AS n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def line_lengths_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("doc_id", "line", F.length("text").alias("n"))
    return sampling.top_by_priority(rows, ["doc_id"], [F.desc("n"), F.asc("line")], 3)


@Q.add(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z_]*(?:key|token|secret|password)\s*[=:]') AS k, regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}') AS ip FROM documents)
SELECT doc_id, CAST(len(k) AS INT) AS n_keys, CAST(len(ip) AS INT) AS n_addresses FROM t WHERE len(k) + len(ip) > 0""")
def sensitive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.regexp_count(F.lower("text"), F.lit(r"[a-z_]*(?:key|token|secret|password)\s*[=:]"))
    addresses = F.regexp_count("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.alias("n_keys"), addresses.alias("n_addresses")).filter("n_keys + n_addresses > 0")


@Q.add(rf"""WITH {_grams_sql("dg", "documents", "doc_id")}, {_grams_sql("bg", "benchmark", "item_id")} SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share five-word runs with benchmark items."""
    hashed = lambda name, key: table(spark, sf_dir, name).select(key, multisets.gram_hashes(T.words(F.col("text"))).alias("grams"))
    return multisets.shared_grams(hashed("documents", "doc_id"), hashed("benchmark", "item_id"), "doc_id", "item_id", "grams")


@Q.add(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY word),
p AS (SELECT doc_id, split_part(x, '-', 1) AS a, split_part(x, '-', 2) AS b FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+-[a-z]+')) AS x FROM documents)),
q AS (SELECT a, b, count(*) AS hyphenated FROM p GROUP BY a, b)
SELECT a, b, hyphenated, coalesce(n.n, 0) AS joined, CASE WHEN coalesce(n.n, 0) >= 2 AND hyphenated = 0 THEN 'join' WHEN hyphenated >= 2 AND coalesce(n.n, 0) = 0 THEN 'keep' ELSE 'ambiguous' END AS verdict FROM q LEFT JOIN n ON a || b = n.word""")
def soft_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether hyphenated pairs are one word, by how often the corpus has either form."""
    docs = table(spark, sf_dir, "documents")
    lexicon = docs.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pair = F.split("x", "-")
    pairs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+-[a-z]+"), F.lit(0))).alias("x")).select(pair[0].alias("a"), pair[1].alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("hyphenated"))
    out = pairs.join(lexicon, F.concat("a", "b") == F.col("word"), "left").select("a", "b", "hyphenated", F.coalesce("n", F.lit(0)).alias("joined"))
    verdict = F.when((F.col("joined") >= 2) & (F.col("hyphenated") == 0), "join").when((F.col("hyphenated") >= 2) & (F.col("joined") == 0), "keep").otherwise("ambiguous")
    return out.withColumn("verdict", verdict)
