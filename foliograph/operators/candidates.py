"""Rule packs and the candidates they give. A pack is data; its patterns become Column expressions when the plan is made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .predicates import semantic_view


@dataclass(frozen=True)
class RulePack:
    """Patterns per kind, tried in order; words that start or continue a proof; markers that end one; exercise headings."""

    name: str = "plain"
    title_patterns: dict[str, list[str]] = field(default_factory=dict)
    proof_starts: list[str] = field(default_factory=list)
    continue_words: list[str] = field(default_factory=list)
    end_markers: list[str] = field(default_factory=list)
    exercise_keywords: list[str] = field(default_factory=list)
    bilingual_titles: bool = False


#: After an English keyword: a number, a bracketed name or punctuation. ``Theorem 2 shows`` is running text.
EVIDENCE = r"(?:\s+\d+(?:\.\d+)*\s*(?:[.:]|\s+[A-Z(\[$\\]|$)|\s*[(\[][^)\]]{1,80}[)\]]\s*(?:[.:]|$)|\s*(?:[.:]|$))"


def _keyword(word: str) -> str:
    return rf"^(?:\\(?:textbf|textit|emph)\{{)?(?i:{word})\}}?{EVIDENCE}"


TEX_PACK = RulePack(
    "tex",
    {k: [_keyword(k)] for k in ("theorem", "lemma", "corollary", "proposition", "definition", "example", "remark")},
    [r"^(?:\\(?:textbf|textit|emph)\{)?(?i:proof)(?:\s+of\b[^.:]*)?\}?\s*(?:[.:]|$)"],
    ["hence", "thus", "therefore", "so", "then", "since", "now"],
    [r"\\qed\b", "□", r"(?i:q\.\s?e\.\s?d\.)"],
    ["exercises?", "problems?"],
)
#: Chinese keywords of titles; those of one character need a number or punctuation behind them.
_CHINESE = {"theorem": "定理", "lemma": "引理", "corollary": "推论", "proposition": "命题", "definition": "定义", "example": "例", "remark": "注"}


def _chinese(word: str) -> str:
    number, mark = r"\s*[0-9]+(?:\.[0-9]+)*", r"\s*[.:：。、（(]"
    more = r"|\s+\S|\s*【" if len(word) > 1 else ""
    return rf"^(?:\\(?:textbf|textit|emph)\{{)?{word}(?:{number}|{mark}{more})"


#: English and Chinese titles and proofs.
BILINGUAL_PACK = replace(
    TEX_PACK,
    name="bilingual",
    title_patterns={k: [*TEX_PACK.title_patterns[k], _chinese(w)] for k, w in _CHINESE.items()},
    proof_starts=[*TEX_PACK.proof_starts, r"^(?:\\(?:textbf|textit|emph)\{)?证明\s*(?:[.:：。]|$)"],
    continue_words=[*TEX_PACK.continue_words, "因此", "所以", "于是"],
    end_markers=[*TEX_PACK.end_markers, "证毕"],
    exercise_keywords=[*TEX_PACK.exercise_keywords, "习题", "练习"],
    bilingual_titles=True,
)
#: For corpora without TeX: licence lines, tables, shouted lines and numbered headings.
PLAIN_PACK = RulePack(
    "plain",
    {
        "license": [r"^(?:Licensed under|Released under|This work is licensed)"],
        "table": [r"^[^|]+(?: \| [^|]+){3,}"],
        "shout": [r"^[A-Z]{2,}!! "],
        "numbered": [r"^[0-9]+(?:\.[0-9]+)*[.:)] "],
    },
)


def load_pack(spark: SparkSession, path: str, base: RulePack = TEX_PACK) -> RulePack:
    """A pack file over a base: missing, null and empty fields fall back."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small configuration file
    given = {k: v for k, v in json.loads(rows[0]["value"]).items() if v not in (None, [], {}, "")}
    known = RulePack.__dataclass_fields__
    return replace(base, **{k: v for k, v in given.items() if k in known})


def kind_of(first: Column, pack: RulePack) -> Column:
    """The first kind, in the pack's order, of which a pattern matches; null if none."""
    found = [F.when(first.rlike(p), kind) for kind, patterns in pack.title_patterns.items() for p in patterns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def is_proof_start(first: Column, pack: RulePack) -> Column:
    out = F.lit(False)
    for p in pack.proof_starts:
        out = out | first.rlike(p)
    return out


def has_end_marker(text: Column, pack: RulePack) -> Column:
    out = F.lit(False)
    for p in pack.end_markers:
        out = out | text.rlike(p)
    return out


def rule_of(first: Column, pack: RulePack) -> Column:
    """The pattern that gives the kind, as kind-place."""
    found = [F.when(first.rlike(p), f"{kind}-{k}") for kind, patterns in pack.title_patterns.items() for k, p in enumerate(patterns)]
    return F.coalesce(*found, F.lit(None).cast("string"))


def title_metadata(first: Column, pack: RulePack) -> Column:
    """Struct of a title line: kind, rule_id, number, name (in brackets), prefix (keyword, number, name and the mark behind) and remainder."""
    line = semantic_view(first)["text"]
    keyword = r"^\s*[A-Za-z\p{IsHan}]+"
    number = F.regexp_extract(line, keyword + r"\s*([0-9]+(?:\.[0-9]+)*)", 1)
    name = F.regexp_extract(line, keyword + r"\s*(?:[0-9]+(?:\.[0-9]+)*)?\s*[(\[（]([^)\]）]*)[)\]）]", 1)
    prefix = F.regexp_extract(line, r"^(\s*[A-Za-z\p{IsHan}]+\s*(?:[0-9]+(?:\.[0-9]+)*)?\s*(?:[(\[（][^)\]）]*[)\]）])?\s*[.:：。]?\s*)", 1)
    kind = kind_of(first, pack)
    there = lambda c: F.when(kind.isNotNull(), c)
    return F.struct(kind.alias("kind"), rule_of(first, pack).alias("rule_id"), there(number).alias("number"), there(name).alias("name"), there(prefix).alias("prefix"), there(F.substring(line, F.length(prefix) + 1, F.length(line))).alias("remainder"))


def title_candidates(lines: DataFrame, pack: RulePack, key: str = "doc_id", order: str = "line", text: str = "masked", carry: list[str] | None = None) -> DataFrame:
    """candidate_id, kind, line, title (the whole line), number and confidence of lines that begin like a title, and the columns ``carry``.
    Numbered ones are surer."""
    first = F.trim(F.col(text))
    rows = lines.withColumn("kind", F.coalesce(kind_of(first, pack), F.when(is_proof_start(first, pack), "proof"))).filter("kind IS NOT NULL")
    number = F.regexp_extract(first, r"^[^0-9]*?([0-9]+(?:\.[0-9]+)*)", 1)
    confidence = F.when(F.col("kind") == "proof", 0.9).when(number != "", 0.85).otherwise(0.70)
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.select(
        key,
        F.format_string("c-%04d", seq).alias("candidate_id"),
        "kind",
        F.col(order).alias("line"),
        first.alias("title"),
        number.alias("number"),
        confidence.alias("confidence"),
        *(carry or []),
    )


def outside(rows: DataFrame, names: list[str], in_env: str = "in_env") -> DataFrame:
    """Rows of which no ancestor is one of ``names``."""
    return rows.filter(~F.arrays_overlap(F.col(in_env), F.array(*[F.lit(n) for n in names])))


def best_rule(decisions: DataFrame, keys: list[str], priority: Column, tie: list[str]) -> DataFrame:
    """The decision of the highest priority (lowest number) for each key."""
    w = Window.partitionBy(*keys).orderBy(priority, *tie)
    return decisions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def exercise_sections(sections: DataFrame, items: DataFrame, pack: RulePack, key: str = "doc_id") -> DataFrame:
    """Sections with an exercise heading and at least two paragraphs that begin with a bare number."""
    pattern = "(?i)^(?:" + "|".join(pack.exercise_keywords or ["$^"]) + ")$"
    wanted = sections.filter(F.trim("title").rlike(pattern))
    numbered = items.filter(F.col("text").rlike(r"^\s*\d+\.\s"))
    inside = wanted.join(numbered.select(key, F.col("line").alias("_at")), key).filter(F.col("_at").between(F.col("start_line"), F.col("end_line")))
    return inside.groupBy(key, "start_line", "end_line", "title").agg(F.count("*").alias("n_items")).filter("n_items >= 2")
