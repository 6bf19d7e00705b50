"""TeX structure as rows: environments, displays, sections and blocks of every document, by one linear pass in Arrow batches; and what
windows and joins tell about them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tex
from . import structure
from .storage import below

#: Columns of the rows that ``rows`` gives.
PARTS = {
    "envs": "n int, name string, begin_line int, end_line int, body_start int, body_end int, depth int",
    "unbalanced": "name string, line int, side string",
    "displays": "n int, start_line int, end_line int, start_off int, end_off int",
    "sections": "n int, cmd string, title string, starred boolean, level int, line int, parent int",
    "blocks": "block_id int, kind string, name string, start_line int, end_line int, text string, in_env array<string>, section_path array<string>",
}


def _parts(text: str, part: str, literal: frozenset[str]) -> Iterator[tuple]:
    plain = tex.newlines(text)
    bare = tex.without_comments(plain)
    pairs, left, refused = tex.environments(bare, literal)
    starts = tex.line_starts(plain)
    line_of = lambda at: bisect_right(starts, at)
    if part == "envs":
        for n, p in enumerate(pairs):
            yield n, p.name, line_of(p.begin), line_of(p.end), p.begin_end, p.end, p.depth
        return
    if part == "unbalanced":
        yield from ((name, line_of(at), "open") for name, at in left)
        yield from ((name, line_of(at), "refused") for name, at in refused)
        return
    masked = tex.masked(plain, literal)
    if part == "displays":
        for n, (s, e) in enumerate(tex.displays(masked)):
            yield n, line_of(s), line_of(e - 1), s, e
        return
    sections = tex.sections(masked)
    if part == "sections":
        for n, s in enumerate(sections):
            yield n, s.cmd, s.title, s.starred, s.level, line_of(s.start), s.parent if s.parent >= 0 else None
        return
    lines, at, path = plain.split("\n"), 0, []
    for n, b in enumerate(tex.blocks(plain, masked, pairs, tex.displays(masked), literal)):
        while at < len(sections) and line_of(sections[at].start) <= b.first:
            path = [s for s in path if s.level < sections[at].level] + [sections[at]]
            at += 1
        yield n, b.kind, b.name, b.first, b.last, "\n".join(lines[b.first - 1 : b.last]), list(b.in_env), [s.title for s in path]


def rows(documents: DataFrame, part: str, key: str = "doc_id", text: str = "text", literal: list[str] | None = None) -> DataFrame:
    """key and the columns of PARTS[part] of every document; a null text has no rows."""
    import pyarrow as pa

    bodies = frozenset(tex.LITERAL if literal is None else literal)
    names = [c.split()[0] for c in PARTS[part].split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in PARTS[part].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                own = batch.slice(at, 128)
                found, of = [], []
                for k, t in enumerate(own.column(1).to_pylist()):
                    got = list(_parts(t, part, bodies)) if t is not None else []
                    found += got
                    of += [k] * len(got)
                columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(of, pa.int64())), *columns], names=[key, *names])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, {PARTS[part]}")


def closers(tokens: DataFrame, key: str) -> DataFrame:
    """key and pos of closing tokens (pos, name, kind) that a strict stack pairs."""
    return structure.stack_rows(tokens, key).filter("state = 'pair'").select(key, F.col("close").alias("pos"))


def inside(points: DataFrame, envs: DataFrame, key: str, line: str, names: list[str]) -> DataFrame:
    """``points`` with ``in_box``: whether the line lies in an environment of ``names``. A sweep over beginnings and ends: no range join."""
    box = envs.filter(F.col("name").isin(names))
    begins = box.select(key, F.col("begin_line").alias("_at"), F.lit(0).alias("_order"), F.lit(1).alias("_step"))
    ends = box.select(key, F.col("end_line").alias("_at"), F.lit(2).alias("_order"), F.lit(-1).alias("_step"))
    own = points.withColumns({"_at": F.col(line), "_order": F.lit(1), "_step": F.lit(0), "_row": F.struct(*points.columns)}).select(key, "_at", "_order", "_step", "_row")
    w = Window.partitionBy(key).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    swept = below(own, begins, ends, keys=[key]).withColumn("_open", F.sum("_step").over(w))
    return swept.filter("_order = 1").select("_row.*", (F.col("_open") > 0).alias("in_box"))


def enclosing(points: DataFrame, blocks: DataFrame, key: str, line: str, ident: list[str], formulas: list[str], width: int = 64) -> DataFrame:
    """``points`` (rows named by key, line and ``ident``) with the block around their line: the longest of formula blocks (displays and the environments ``formulas``), else the
    shortest of all; of equals the one that begins last. ``block`` is null outside of all. Blocks are cut into buckets of ``width`` lines."""
    from . import intervals

    is_formula = (F.col("kind") == "displaymath") | ((F.col("kind") == "env") & F.col("name").isin(formulas))
    spans = blocks.select(key, "block_id", "start_line", "end_line", is_formula.alias("_formula"))
    own = [key, line, *ident]
    held = intervals.bucketed_containment(points.select(*own), spans, key, line, "start_line", "end_line", width)
    size = F.col("end_line") - F.col("start_line")
    first = F.struct((~F.col("_formula")).cast("int").alias("f"), F.when(F.col("_formula"), -size).otherwise(size).alias("n"), (-F.col("start_line")).alias("s"), F.col("block_id"))
    best = held.groupBy(*own).agg(F.min(first).alias("_b")).select(*own, F.col("_b.block_id").alias("block"))
    return points.join(best, own, "left")


def stops(blocks: DataFrame, is_stop: Column, key: str = "doc_id") -> DataFrame:
    """key and start_line of blocks that begin a new structure."""
    return blocks.filter(is_stop).select(key, "start_line").distinct()


def extended(blocks: DataFrame, key: str, starts: Column, breaks: Column, joins: Column, body: Column, needs_body: Column, ends: Column | None = None) -> DataFrame:
    """key, start_line and end_line of structures that begin at blocks where ``starts`` holds and reach over the following blocks.

    A block that begins inside what is taken already is passed over. The walk ends in front of a block that begins a structure, or
    where ``breaks`` holds, or that doesn't join: a block joins if ``joins`` holds, and the first one behind a heading without a body
    (``needs_body`` at its start) joins in any case; ``body`` says which blocks count as one. A block where ``ends`` holds joins and
    ends the walk. Each block belongs to the last start before it, so all of it is windows by document: no join.
    """
    ends = F.lit(False) if ends is None else ends
    order = Window.partitionBy(key).orderBy("start_line", "block_id")
    marked = blocks.withColumns({"_start": F.coalesce(starts, F.lit(False)), "_break": F.coalesce(breaks, F.lit(False)), "_join": F.coalesce(joins, F.lit(False)), "_body": F.coalesce(body, F.lit(False)), "_ends": F.coalesce(ends, F.lit(False)), "_needs": F.coalesce(needs_body, F.lit(False))})
    group = F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("_group", group).filter("_group > 0").repartition(key)
    own = Window.partitionBy(key, "_group").orderBy("start_line", "block_id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # What lies inside an earlier block of the walk is no block of its own.
    rows = rows.withColumn("_reach", F.max("end_line").over(before)).filter("_start OR start_line > _reach")
    has_body = ~F.first("_needs").over(own.rowsBetween(Window.unboundedPreceding, 0)) | F.coalesce(F.max("_body").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    stops_here = ~F.col("_start") & (F.col("_break") | (~F.col("_join") & ~F.col("_ends") & has_body))
    rows = rows.withColumn("_stop", stops_here)
    rows = rows.withColumn("_over", F.max(F.col("_stop").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.max(F.col("_ends").cast("int")).over(before), F.lit(0)))
    taken = rows.filter("_over = 0")
    return taken.groupBy(key, "_group").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_group")


def atoms(lines: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Non-blank lines with ``atom_end``, the last line of the innermost paragraph, display or literal block around them, or their own."""
    plain = blocks.filter(F.col("kind").isin("para", "displaymath", "verbatim")).select(key, F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    w = Window.partitionBy(key).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.filter(F.trim("text") != "").select(key, F.col("line").alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast("int").alias("_e"))
    marks = plain.select(key, F.col("_s").alias("_at"), F.lit(0).alias("_order"), "_e")
    rows = below(own, marks, keys=[key]).withColumn("_last", F.last("_e", ignorenulls=True).over(w)).filter("_order = 1")
    return rows.select(key, F.col("_at").alias("line"), F.greatest("_at", F.coalesce(F.when(F.col("_last") >= F.col("_at"), F.col("_last")), F.col("_at"))).alias("atom_end"))


def safe_ends(requests: DataFrame, lines: DataFrame, blocks: DataFrame, stops_: DataFrame, key: str, ident: str, qed: Column) -> DataFrame:
    """key, ident and safe_end of requested proofs (start, requested): null where no end can be shown.

    An end sign in front of the next structure decides. Without one there must be a next structure, and the end is the last non-blank
    atom in front of it: a request that crosses the structure is cut back to it, a shorter one must end on it already. Starts, lines and
    structures meet as one sorted sequence by document, so everything is as-of windows.
    """
    held = atoms(lines, blocks, key).join(lines.select(key, "line", qed.alias("_qed")), [key, "line"])
    order = Window.partitionBy(key).orderBy("_at", "_kind")
    ahead, back = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    null = F.lit(None).cast("int")
    base = held.select(key, F.col("line").alias("_at"), F.lit(1).alias("_kind"), F.col("atom_end").alias("_atom"), F.when(F.col("_qed"), F.col("atom_end")).alias("_sign"), null.alias("_stop"))
    halts = stops_.select(key, F.col("start_line").alias("_at"), F.lit(0).alias("_kind"), null.alias("_atom"), null.alias("_sign"), F.col("start_line").alias("_stop"))
    joined = below(base, halts, keys=[key]).repartition(key)
    joined = joined.withColumns({"_next": F.first("_stop", ignorenulls=True).over(ahead), "_sign_at": F.coalesce("_sign", F.first("_sign", ignorenulls=True).over(ahead)), "_before": F.last("_atom", ignorenulls=True).over(back)})
    at_start = joined.filter("_kind = 1").select(key, F.col("_at").alias("start"), F.col("_next").alias("_stop"), "_sign_at")
    at_stop = joined.filter("_kind = 0").select(key, F.col("_at").alias("_stop"), F.col("_before").alias("_end"))
    asked = requests.select(key, ident, "start", "requested")
    # A request's line may be blank: its atom is that of the last line that isn't.
    points = asked.select(key, F.col("requested").alias("_at"), F.lit(2).alias("_kind"), null.alias("_atom"), F.col(ident).alias("_id"))
    near = below(base.select(key, "_at", "_kind", "_atom"), points, keys=[key]).withColumn("_own", F.last("_atom", ignorenulls=True).over(back)).filter("_kind = 2")
    near = near.select(key, F.col("_id").alias(ident), "_own")
    out = asked.join(at_start, [key, "start"], "left").join(at_stop, [key, "_stop"], "left").join(near, [key, ident], "left")
    sign = F.when(F.col("_stop").isNull() | (F.col("_sign_at") < F.col("_stop")), F.col("_sign_at"))
    reaches = (F.col("requested") >= F.col("_stop")) | (F.col("_own") == F.col("_end"))
    end = F.coalesce(sign, F.when((F.col("_end") >= F.col("start")) & (F.col("_end") < F.col("_stop")) & reaches, F.col("_end")))
    return out.select(key, ident, end.alias("safe_end"))
