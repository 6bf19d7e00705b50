"""Pairing of opening and closing tokens, in TeX and HTML."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Elements without a closing tag; fixed by HTML.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def tag_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, name and kind (open, close) of every element tag but void ones."""
    tags = F.regexp_extract_all(html, F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    rows = pages.select(key, F.posexplode(tags).alias("pos", "tag"))
    name = F.lower(F.regexp_replace("tag", "^/", ""))
    return rows.select(key, "pos", name.alias("name"), F.when(F.col("tag").startswith("/"), "close").otherwise("open").alias("kind")).filter(~F.col("name").isin(VOID))


def depth(tokens: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """The running depth behind each token."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("depth", F.sum(F.when(F.col("kind") == "open", 1).otherwise(-1)).over(w))


def strict_stack(tokens: list[tuple[int, str, str]], literal: frozenset[str] = frozenset(), paths: bool = True) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Pairs (name, open, close, depth, path), openers left and closers refused (pos, name) of (pos, name, kind) in order.

    A closer that isn't on top is refused and pops nothing; inside a literal name only its own closer counts. ``path`` has the names of
    the pairs around, outermost first (empty unless ``paths``: they grow with the depth). Openers that stay open lie below all others, so
    they are in no pair's path.
    """
    stack, nodes, refused = [], [], []  # nodes: name, open, close, depth, node around
    for pos, name, kind in tokens:
        top = nodes[stack[-1]] if stack else None
        if top is not None and top[0] in literal and (kind == "open" or name != top[0]):
            continue
        if kind == "open":
            nodes.append([name, pos, None, len(stack), stack[-1] if stack else None])
            stack.append(len(nodes) - 1)
        elif top is not None and top[0] == name:
            nodes[stack.pop()][2] = pos
        else:
            refused.append((pos, name))
    told: list[str] = []
    pairs = []
    for name, begin, end, depth, around in nodes:  # a node stands behind the one around it
        closed = paths and around is not None and nodes[around][2] is not None
        told.append((f"{told[around]}/{nodes[around][0]}" if told[around] else nodes[around][0]) if closed else "")
        if end is not None:
            pairs.append((name, begin, end, depth, told[-1]))
    return pairs, [(nodes[k][1], nodes[k][0]) for k in stack], refused


STACK_ROWS = "name string, open int, close int, depth int, path string, state string"


def stack_rows(tokens: DataFrame, key: str, literal: frozenset[str] = frozenset(), paths: bool = False) -> DataFrame:
    """key, name, open, close, depth, path (on request) and state (pair, open or refused): one row for each pair, opener left and closer refused.

    The tokens of a key meet in one row and are walked once in an Arrow batch; the cost grows with the tokens.
    """
    import pyarrow as pa

    kind = dict(tokens.dtypes)[key]
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "kind"))).alias("t"))
    rows = rows.select(key, F.col("t.pos").alias("pos"), F.col("t.name").alias("name"), F.col("t.kind").alias("kind"))
    names = [key, "name", "open", "close", "depth", "path", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                at_row, out = [], []
                for row, (pos, name, side) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))):
                    pairs, left, refused = strict_stack(list(zip(pos, name, side)), literal, paths)
                    got = [(*p, "pair") for p in pairs] + [(n, p, None, None, None, "open") for p, n in left] + [(n, None, p, None, None, "refused") for p, n in refused]
                    out += got
                    at_row += [row] * len(got)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                columns = [pa.array([o[k] for o in out], kinds[k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at_row, pa.int64())), *columns], names=names)

    return rows.mapInArrow(run, f"{key} {kind}, {STACK_ROWS}")


def pair_tokens(tokens: DataFrame, key: str, literal: frozenset[str] = frozenset()) -> DataFrame:
    """key with the numbers of pairs, openers left and closers refused of its tokens."""
    n = lambda state, name: F.sum((F.col("state") == state).cast("bigint")).alias(name)
    return stack_rows(tokens, key, literal).groupBy(key).agg(n("pair", "n_pairs"), n("open", "n_open"), n("refused", "n_refused"))


def env_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, name and kind of TeX environment tokens."""
    found = F.regexp_extract_all(text, F.lit(r"\\(?:begin|end)\s*\{[^{}]+\}"), F.lit(0))
    rows = documents.select(key, F.posexplode(found).alias("pos", "t"))
    return rows.select(key, "pos", F.regexp_extract("t", r"\{([^{}]+)\}", 1).alias("name"), F.when(F.col("t").startswith("\\begin"), "open").otherwise("close").alias("kind"))


def ancestors(tokens: DataFrame, key: str, literal: frozenset[str] = frozenset()) -> DataFrame:
    """Each pair with the names of the pairs around it, outermost first, as the stack pass finds them: no join."""
    return stack_rows(tokens, key, literal, paths=True).filter("state = 'pair'").select(key, "name", "open", "close", "path")


def brace_balance(text: Column) -> Column:
    """Struct ok and depth of masked text: the depth behind the last brace, or -1 as soon as one closes what isn't open. A brace behind a
    backslash is text."""
    marks = F.regexp_extract_all(F.regexp_replace(text, r"\\[{}]", ""), F.lit(r"([{}])"), F.lit(1))
    step = lambda d, m: F.when(d < 0, d).otherwise(d + F.when(m == "{", 1).otherwise(-1))
    return let(F.aggregate(marks, F.lit(0), step), lambda d: F.struct((d == 0).alias("ok"), d.alias("depth")))


def first_negative(marks: DataFrame, key: str, order: str = "pos", mark: str = "mark") -> DataFrame:
    """key, the first place where more is closed than was open (null without one), and the depth at the end, from rows of ``{`` and ``}``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col(mark) == "{", 1).otherwise(-1)).over(w)
    rows = marks.withColumn("_d", depth)
    return rows.groupBy(key).agg(F.min(F.when(F.col("_d") < 0, F.col(order))).alias("first_negative"), F.max_by("_d", order).alias("depth"))


def parents(rows: DataFrame, key: str, order: str, level: str, ident: str, levels: int) -> DataFrame:
    """``parent``: the last row before each that is less deep. Rows between it and the row are deeper than it, so this is the top of a
    stack that was popped down to the row's level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shallower = [F.when(F.col(level) == k, F.last(F.when(F.col(level) < k, F.col(ident)), ignorenulls=True).over(w)) for k in range(levels)]
    return rows.withColumn("parent", F.coalesce(*shallower))
