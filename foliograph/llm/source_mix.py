"""Mixing sources to target weights by temperature, in DataFrame functions only.

``p`` are the sources' shares of all tokens (words). Weights are ``p ** alpha / sum(p ** alpha)``; alpha = 1 leaves the
mix as it is, alpha = 0 makes sources equal. The exponent is bisected on the cluster: one aggregation over the sources
evaluates a grid of exponents, the bracket shrinks by the grid's size, and only those few sums reach the driver. It meets
a target entropy, or the lowest exponent at which no source is repeated more than ``max_repeats`` times; of both, the higher.

The token budget is ``budget``, or by default what gives every source at least one whole pass, so that mixing repeats rows
and loses none. A source whose share of the budget is 2.4 passes gets two whole passes and 0.4 of a third. Each pass is
a permutation of blocks: documents are dealt into blocks by a hash, blocks are ordered by a hash of block and pass, and
the last pass ends inside one block, at the document where the budget is reached. Running sums are taken over blocks, inside
ranges of their order and over the ranges' totals, so one large source is no single task; over documents only inside the one
block that is cut.

Defined cases: a null text counts 0 tokens and is emitted with each pass that holds its block; a null source is a source;
a source without tokens gets one pass; repeated rows, and rows that share an id, are emitted each by itself; an empty table
gives no rows; further columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SEPARATORS, materialise, table

#: Share of the greatest possible entropy, log(number of sources), that the mix shall reach.
TARGET_ENTROPY = 0.99
MAX_REPEATS = 4.0
#: Tokens of a block. A source has as many blocks as its tokens ask for.
BLOCK_TOKENS = 50_000
GRID = 32
ROUNDS = 6
#: Bits of a block's order that name its range; a source's running sum is taken over this many totals.
RANGE_BITS = 10


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """sources: source, tokens. The exponent in [0, 1]; needs a row of sums for each grid point and round."""
    live = sources.filter("tokens > 0").select(F.log("tokens").alias("lt"), F.col("tokens").cast("double").alias("t"))
    total = live.agg(F.sum("t").alias("t"), F.count("*").alias("n"), F.max("lt").alias("big"), F.min("lt").alias("small")).first()
    if not total["n"]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        sums = live.agg(
            *[F.sum(F.exp((F.col("lt") - total["big"]) * a)).alias(f"z{k}") for k, a in enumerate(grid)],
            *[F.sum((F.col("lt") - total["big"]) * a * F.exp((F.col("lt") - total["big"]) * a)).alias(f"e{k}") for k, a in enumerate(grid)],
        ).first()

        def meets(k: int) -> bool:
            """Whether the mix with this exponent is no flatter than allowed: entropy falls and repeats fall as alpha grows."""
            z, a = sums[f"z{k}"], grid[k]
            fine = True
            if target_entropy is not None:
                fine &= math.log(z) - sums[f"e{k}"] / z <= target_entropy * math.log(max(2, total["n"])) + 1e-12
            if max_repeats is not None:  # passes are proportional to tokens ** (alpha - 1); the largest source has one pass
                fine &= math.exp((total["small"] - total["big"]) * (a - 1)) <= max_repeats + 1e-12
            return fine

        first = next((k for k in range(GRID + 1) if meets(k)), GRID)
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def plan_passes(sources: DataFrame, alpha: float, budget: int | None) -> DataFrame:
    """source, tokens, weight, passes (whole and fractional)."""
    live = sources.filter("tokens > 0")
    sums = live.agg(
        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha))).alias("z"),
        F.max(F.pow(F.col("tokens").cast("double"), F.lit(1.0 - alpha))).alias("unit"),
    ).first()
    z, unit = sums["z"] or 1.0, sums["unit"] or 1.0
    size = float(budget) if budget is not None else z * unit
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / z).otherwise(F.lit(0.0))
    passes = F.when(F.col("tokens") > 0, F.col("weight") * size / F.col("tokens")).otherwise(F.lit(1.0))
    return sources.withColumn("weight", weight).withColumn("passes", F.round(passes, 9))


def _dealt(rows: DataFrame, plan: DataFrame, block_tokens: int) -> DataFrame:
    """rows (id, source, mark and more) with ``passes``, ``source_tokens`` and ``block``: a source has blocks for its tokens."""
    wide = plan.select(F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), "passes")
    joined = rows.join(wide, rows["source"].eqNullSafe(wide["s"])).drop("s")
    n_blocks = F.greatest(F.ceil(F.col("source_tokens") / block_tokens).cast("long"), F.lit(1))
    return joined.withColumn("block", F.pmod(F.xxhash64(F.lit("deal"), "id", "mark"), n_blocks))


def _taken(blocks: DataFrame) -> DataFrame:
    """s, b, mix_pass, mix_rank and room (null: the whole block) of the blocks that the budget takes."""
    # Whole passes need no order to be complete; the last, partial pass takes blocks in its own order until the budget ends.
    passes = blocks.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0)))))
    passes = passes.withColumn("mix_rank", F.xxhash64(F.lit("order"), "source", "block", "mix_pass"))
    last = passes.filter(F.col("mix_pass") == F.floor("passes")).withColumn("range", F.shiftright("mix_rank", 64 - RANGE_BITS))
    last = materialise(last, "mix-last")
    ahead = lambda *order: Window.partitionBy(*order[0]).orderBy(*order[1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = last.groupBy("source", "range").agg(F.sum("block_tokens").alias("t"))
    totals = totals.select(F.col("source").alias("ts"), F.col("range").alias("tr"), F.coalesce(F.sum("t").over(ahead(["source"], ["range"])), zero).alias("base"))
    last = last.join(totals, last["source"].eqNullSafe(totals["ts"]) & (last["range"] == totals["tr"])).drop("ts", "tr")
    before = F.col("base") + F.coalesce(F.sum("block_tokens").over(ahead(["source", "range"], ["mix_rank", "block"])), zero)
    room = (F.round((F.col("passes") - F.floor("passes")) * F.col("source_tokens")) - before).cast("long")
    last = last.withColumn("room", room).filter(F.col("room") > 0).drop("base", "range")
    taken = passes.filter(F.col("mix_pass") < F.floor("passes")).withColumn("room", F.lit(None).cast("long")).unionByName(last)
    taken = taken.withColumn("room", F.when(F.col("room") < F.col("block_tokens"), F.col("room")))
    return materialise(taken.select(F.col("source").alias("s"), F.col("block").alias("b"), "mix_pass", "mix_rank", "room"), "mix-blocks")


def _cut(rows: DataFrame, taken: DataFrame, tokens: Column) -> DataFrame:
    """A row for each pass that takes it. A block is a bounded part of a source, so no key is hot however large one source is."""
    rows = rows.join(taken, rows["source"].eqNullSafe(taken["s"]) & (rows["block"] == taken["b"])).drop("s", "b")
    order = Window.partitionBy("source", "block", "mix_pass").orderBy(F.xxhash64("id", "mark", "mix_pass"), "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter("room IS NOT NULL").withColumn("own", tokens)
    cut = cut.withColumn("before", F.coalesce(F.sum("own").over(order), F.lit(0))).filter(F.col("before") < F.col("room")).drop("before", "own")
    return rows.filter("room IS NULL").unionByName(cut).drop("room")


def _planned(
    documents: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None, block_tokens: int, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's id, source, mark (its text's hash), tokens and block; the plan of the sources; the blocks that are taken."""
    mark = F.xxhash64("text").alias("mark")
    counted = materialise(documents.select(F.col(key).alias("id"), "source", mark, n_tokens(F.col("text")).alias("tokens")), "mix-tokens")
    sources = materialise(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    plan = materialise(plan_passes(sources, find_exponent(sources, target_entropy, max_repeats), budget), "mix-plan")
    rows = _dealt(counted, plan, block_tokens)
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("passes").alias("passes"), F.first("source_tokens").alias("source_tokens"))
    return rows, plan, _taken(blocks)


def mix(
    documents: DataFrame,
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    key: str = "doc_id",
) -> DataFrame:
    """The rows of ``documents`` that the budget takes, one for each pass: key, source, ``mix_pass``, ``mix_block``, ``mix_rank`` and ``mix_tokens``.

    ``mix_rank`` orders the blocks of a source's pass. Reading by (mix_pass, mix_rank) gives the permuted stream.
    """
    rows, _, taken = _planned(documents, target_entropy, max_repeats, budget, block_tokens, key)
    rows = _cut(rows.select("id", "source", "mark", "tokens", "block"), taken, F.col("tokens"))
    return rows.select(F.col("id").alias(key), "source", "mix_pass", F.col("block").alias("mix_block"), "mix_rank", F.col("tokens").alias("mix_tokens"))


def mixed_rows(
    documents: DataFrame,
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    key: str = "doc_id",
) -> DataFrame:
    """The same rows as ``mix`` takes, with the columns of ``documents``. Each row finds its block by itself, so texts are never joined by id."""
    _, plan, taken = _planned(documents, target_entropy, max_repeats, budget, block_tokens, key)
    rows = documents.select(F.col(key).alias("id"), "source", F.xxhash64("text").alias("mark"), F.struct(*documents.columns).alias("row"))
    rows = _dealt(rows, plan, block_tokens).select("id", "source", "mark", "block", "row")
    return _cut(rows, taken, n_tokens(F.col("row")["text"])).select("row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_source_mix": op6_source_mix}
ORACLE_SQL: dict[str, str] = {}
