"""Include graphs: what a root reaches, cycles, order, flattening and splitting. A frontier advances level by level; each node and each
edge is visited once, however many paths lead there."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tex
from .storage import written

START, END = "% === file start: ", "% === file end: "


def includes(files: DataFrame, path: str = "path", text: str = "masked") -> DataFrame:
    """path, target and place of every include command in masked text."""
    found = F.regexp_extract_all(text, F.lit(r"\\(?:input|include)\s*\{([^{}]+)\}"), F.lit(1))
    rows = files.select(F.col(path).alias("path"), F.posexplode(found).alias("place", "target"))
    target = F.trim("target")
    return rows.select("path", "place", F.when(target.rlike(r"\.[A-Za-z]+$"), target).otherwise(F.concat(target, F.lit(".tex"))).alias("target"))


def closure(edges: DataFrame, root: str, a: str = "path", b: str = "target") -> DataFrame:
    """node and depth (the fewest steps) of what the root reaches, the root included."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    seen = spark.createDataFrame([(root, 0)], "node string, depth int")
    front = seen
    while True:
        step = front.join(pairs, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = written(step.join(seen, "node", "left_anti"), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def cycles(edges: DataFrame, a: str = "path", b: str = "target") -> DataFrame:
    """Edges between nodes of a cycle: what is left when nodes without an edge in or out are taken away until none is."""
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "cycles")
    n = now.count()
    while n:
        left = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        now = written(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "cycles")
        before, n = n, now.count()
        if n == before:
            break
    return now.select(F.col("a").alias(a), F.col("b").alias(b))


def missing(edges: DataFrame, files: DataFrame) -> DataFrame:
    return edges.select("target").distinct().join(files.select(F.col("path").alias("target")), "target", "left_anti")


def declared_environments(files: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Names of theorem environments that files reachable from the root declare (path, masked): support files count if a class, package or
    include command names them, and no others."""
    reached = closure(edges, root).select(F.col("node").alias("path"))
    found = F.regexp_extract_all("masked", F.lit(r"\\newtheorem\s*\*?\s*\{([^{}]+)\}"), F.lit(1))
    return files.join(reached, "path", "left_semi").select(F.explode(found).alias("name")).distinct()


def support_edges(files: DataFrame) -> DataFrame:
    """path and target of class, package and include commands in masked text, with the suffix that each means."""
    masked, name = F.col("masked"), r"\s*(?:\[[^\]]*\])?\s*\{([^{}\r\n]+)\}"
    classes = F.regexp_extract_all(masked, F.lit(r"\\(?:documentclass|LoadClass(?:WithOptions)?)" + name), F.lit(1))
    packages = F.regexp_extract_all(masked, F.lit(r"\\(?:usepackage|RequirePackage(?:WithOptions)?)" + name), F.lit(1))
    packages = F.flatten(F.transform(packages, lambda p: F.split(p, ",")))
    suffixed = lambda names, suffix: F.transform(names, lambda n: F.when(F.trim(n).rlike(r"\.[A-Za-z]+$"), F.trim(n)).otherwise(F.concat(F.trim(n), F.lit(suffix))))
    targets = files.select("path", F.explode(F.concat(suffixed(classes, ".cls"), suffixed(packages, ".sty"))).alias("target"))
    return targets.unionByName(includes(files).select("path", "target")).distinct()


def _preorder(children: dict[str, list[str]], root: str) -> list[str]:
    """Nodes in the order in which a reader meets them, each once."""
    order, seen, stack = [], set(), [iter([root])]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
        elif node not in seen:
            seen.add(node)
            order.append(node)
            stack.append(iter(children.get(node, ())))
    return order


def flatten(files: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """path and ordinal of what the root includes, in the order in which a reader meets it, each once.

    A project's include commands are few: what the root reaches is found on the cluster, and its edges alone are put in order together.
    """
    reached = closure(edges, root).select(F.col("node").alias("path"))
    own = edges.join(reached, "path", "left_semi").select("path", "place", "target")

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        rows = [r for b in batches for r in zip(b["path"], b["place"], b["target"])]
        children: dict[str, list[str]] = {}
        for path, _, target in sorted(rows):
            children.setdefault(path, []).append(target)
        order = _preorder(children, root)
        yield pd.DataFrame({"path": order, "ordinal": range(1, len(order) + 1)})

    return own.coalesce(1).mapInPandas(walk, "path string, ordinal int")


_INCLUDE = re.compile(r"\\(?:input|include)\s*(?:\{([^{}\r\n]*)\}|([^\s%{}]+))")


def splice(files: dict[str, str], root: str) -> str:
    """One text of a project's files: behind each line with an include command the included file between two marks, each file once. Missing
    files and cycles leave their command alone; a file that holds a mark is an error."""
    for path, text in files.items():
        if any(line.startswith((START, END)) for line in text.split("\n")):
            raise ValueError(f"{path} holds a mark of its own")
    out: list[str] = []
    used, stack = {root}, [iter(zip(files[root].split("\n"), tex.masked(files[root]).split("\n")))]
    waiting: list[list[str]] = [[]]
    names = [root]
    while stack:
        if waiting[-1]:
            path = waiting[-1].pop(0)
            if path in used:
                continue
            used.add(path)
            out.append(START + path)
            names.append(path)
            waiting.append([])
            stack.append(iter(zip(files[path].split("\n"), tex.masked(files[path]).split("\n"))))
            continue
        line = next(stack[-1], None)
        if line is None:
            stack.pop()
            waiting.pop()
            path = names.pop()
            if stack:
                out.append(END + path)
            continue
        out.append(line[0])
        for m in _INCLUDE.finditer(line[1]):
            target = (m[1] or m[2] or "").strip()
            found = next((t for t in (target, target + ".tex") if t in files), None)
            if found is not None:
                waiting[-1].append(found)
    return "\n".join(out)


def unsplice(text: str, root: str) -> dict[str, str]:
    """The files of a spliced text. Marks that don't pair are an error."""
    parts: dict[str, list[str]] = {root: []}
    stack = [root]
    for line in text.split("\n"):
        if line.startswith(START):
            stack.append(line[len(START) :])
            parts.setdefault(stack[-1], [])
        elif line.startswith(END):
            if len(stack) == 1 or stack.pop() != line[len(END) :]:
                raise ValueError(f"marks don't pair at {line!r}")
        else:
            parts[stack[-1]].append(line)
    if len(stack) != 1:
        raise ValueError(f"{stack[-1]!r} has no end mark")
    return {path: "\n".join(lines) for path, lines in parts.items()}


def spliced(files: DataFrame, roots: DataFrame, key: str = "project") -> DataFrame:
    """key, root and text: the files (key, path, text) of each project as one text; a project is a group."""
    import pandas as pd

    kind = dict(files.dtypes)[key]
    roots = roots.select(F.col(key).alias("_k"), "root").select(F.col("_k").alias(key), "root")  # a column of its own, should both have one source

    def run(k: tuple, own: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(own["path"], own["text"].fillna("")))
        rows = [(k[0], r, splice(texts, r)) for r in root["root"] if r in texts]
        return pd.DataFrame(rows, columns=[key, "root", "text"])

    return files.groupBy(key).cogroup(roots.groupBy(key)).applyInPandas(run, f"{key} {kind}, root string, text string")


def unspliced(texts: DataFrame, key: str = "project") -> DataFrame:
    """key, path and text of the files of spliced texts (key, root, text)."""
    import pandas as pd

    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, path, text) for k, r, t in zip(rows[key], rows["root"], rows["text"]) for path, text in unsplice(t, r).items()]
            yield pd.DataFrame(out, columns=[key, "path", "text"])

    return texts.select(key, "root", "text").mapInPandas(run, f"{key} {kind}, path string, text string")


def processed(files: DataFrame, roots: DataFrame, change, key: str = "project") -> DataFrame:
    """key, path, text and ok: projects spliced, changed as one text by ``change`` (a DataFrame of key, root, text to one of the same), and
    taken apart again; ``ok`` says that the set of files is what it was."""
    whole = written(spliced(files, roots, key), "spliced")
    before = unspliced(whole, key).groupBy(key).agg(F.sort_array(F.collect_set("path")).alias("_before"))
    after = written(unspliced(change(whole), key), "unspliced")
    sets = after.groupBy(key).agg(F.sort_array(F.collect_set("path")).alias("_after")).join(before, key)
    return after.join(sets.select(key, (F.col("_before") == F.col("_after")).alias("ok")), key)
