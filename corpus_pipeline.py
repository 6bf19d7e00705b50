"""A corpus pipeline of five stages: toxicity, language ID, near-duplicates, source mixing, piece encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``. Its result is written as Parquet and read again as the next one's
``docs``, so a lost executor costs a stage's running tasks and no more. All stages but the last return the columns of ``documents``.

Defined cases are those of the operators. Toxicity rejects what it predicts toxic; language ID rejects texts without
letters, null and empty ones included, and texts of which no language has LEAST_SHARE; near-duplicates keep one row of each
group (that of the least id), rows that share an id are told apart by their texts, so different ones stay, and rows without an
id all stay; mixing repeats the rows of small sources and drops none; an empty table stays empty in every stage; further
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import language_id, minhash_dedup, piece_codec, source_mix, toxicity
from foliograph.llm._common import fresh_path, importable, table

#: Share of a text's letters that its language must have.
LEAST_SHARE = 0.4
#: Passes of a source at most, and the least exponent that respects it.
MAX_REPEATS = 1.5


def _unused(docs: DataFrame, prefix: str = "_") -> str:
    """A prefix that no column of ``docs`` begins with, for columns that a stage adds for a while."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, own = toxicity.learn(docs, table(spark, sf_dir, "labels")), _unused(docs)
    return toxicity.score(docs, model, prefix=own).filter(F.col(f"{own}predicted") == 0).select(*docs.columns)


def reject_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _unused(docs)
    labelled = language_id.identify(docs, language_id.learn(docs), prefix=own)
    fits = (F.col(f"{own}lang_pred") != language_id.UNDETERMINED) & (F.col(f"{own}score") >= LEAST_SHARE)
    return labelled.filter(fits).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = f"{_unused(docs)}key"
    shared = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    shared = minhash_dedup.materialise(shared, "shared-ids")
    rows = docs.withColumn(key, F.col("doc_id").cast("bigint"))
    if shared.limit(1).count():  # ids that say nothing: such rows are told apart by their texts
        apart = rows.join(shared, "doc_id", "left_semi").withColumn(key, -F.abs(F.shiftright(F.xxhash64("doc_id", "text"), 1)) - 1)
        rows = rows.join(shared, "doc_id", "left_anti").unionByName(apart.dropDuplicates([key]).select(*rows.columns))
        rows = minhash_dedup.materialise(rows, "told-apart")
    verdict = minhash_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = minhash_dedup.materialise(verdict.filter("NOT kept").select(F.col("doc_id").alias(key)), "verdicts")
    few = gone.count() <= minhash_dedup.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_rows(docs, max_repeats=MAX_REPEATS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(docs, piece_codec.default_model(), with_ids=True)


STAGES = [
    ("toxicity", importable(reject_toxic)),
    ("language_id", importable(reject_undetermined)),
    ("minhash_dedup", importable(drop_near_duplicates)),
    ("source_mix", importable(mix_sources)),
    ("sentencepiece", importable(encode_pieces)),
]
#: Learned models and sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
