"""Near-duplicate embeddings by product quantisation with inverted lists and exact rerank.

Equal vectors are one class. Unit vectors are filed under their nearest coarse centroid (cell) with their angle to it; the
residual is stored as SUBSPACES codes with the length of what the codes leave out. A query visits the lists that can hold a
partner. Two bounds tell which: a partner's angle to a list's centroid is within the threshold's angle of the query's, and a
partner lies on its own centroid's side of the half-space between two centroids, so the query is at most a margin beyond it.
The margin is the farthest that the difference of two neighbours can point along a line between centroids: the whole length
of it in the worst case, or ``reach`` of it, the largest share that differences of the fitted sample have, with a reserve.
Neighbours whose difference points farther than any in the sample could be missed; tests hold recall against brute force.
Each pair of lists is visited from one side, so a pair of vectors is compared once and counted at both.

In a list, partners lie in a band of angles, distances come from the query's tables of subspace distances, and who is within
the radius plus the left-out length is compared exactly in double precision.

Lists are cut into blocks and queries into slices, and a task compares a slice with a block: counts of links and a spanning
forest of them leave it, never the pairs, so a dense list gives rows in proportion to its vectors.

Defined cases: vectors that are null, empty, zero, hold a null or a non-finite component are linked with nothing and kept;
vectors of different lengths are linked with nothing, those of one length among themselves; a null id counts as a vector of
its own with null component_id, linked with nothing; rows that share id and vector count as copies; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, sin, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table
from ._graph import components

THRESHOLD = 0.95
#: Vectors that centroids, codes and reach are fitted on, about, and those that a cell has of them at least; they alone reach the driver.
TRAIN_VECTORS, TRAIN_OF_CELL = 20_000, 20
SUBSPACES, CODES = 8, 256
#: Differences of sample vectors from which a reach is taken, and the reserve on it. With fewer the worst case holds.
LEAST_DIFFERENCES, RESERVE = 2000, 1.1
#: Lengths with at most this many vectors are compared whole, length by length, in one pass.
FEW = 1024
#: Vectors of a list's block and queries of a slice, about.
BLOCK = 2048
#: Queries that are compared at once.
STEP = 256
SLACK = 1e-4


@dataclass
class Quantiser:
    width: int
    centroids: np.ndarray  # cell x width, unit length
    books: list[np.ndarray]  # for each subspace: code x its width
    cuts: list[slice]
    reach: float  # share of a difference's length that may point along a line between centroids

    def visits(self, x: np.ndarray, own: np.ndarray, angle: float) -> np.ndarray:
        """Query x cell: whether a partner within ``angle`` of a unit vector of cell ``own`` may be filed there, by the half-spaces."""
        c = self.centroids
        near = x @ c.T
        between = np.sqrt(np.maximum(0, 2 - 2 * (c[own] @ c.T)))
        return near[np.arange(len(x)), own][:, None] - near <= sin(angle) * self.reach * between + 1e-9

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, angle to its centroid, codes and length left out of unit vectors."""
        near = x @ self.centroids.T
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
        rest = x - self.centroids[cell]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        left = rest.copy()
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            codes[:, m] = _nearest(rest[:, cut], book)
            left[:, cut] -= book[codes[:, m]]
        return cell, angle, codes, np.linalg.norm(left, axis=1)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False, rounds: int = 8) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, book)
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
        if unit:
            book /= np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)
    return book


def _reach(x: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> float:
    """The largest share of a difference between two sample vectors of a cell that points along a line from its centroid to another."""
    own = (x @ centroids.T).argmax(axis=1)
    order = np.lexsort((rng.random(len(x)), own))
    i, j = order[:-1], order[1:]
    fits = own[i] == own[j]
    i, j = i[fits], j[fits]
    apart = x[i] - x[j]
    length = np.linalg.norm(apart, axis=1)
    i, apart = i[length > 1e-6], apart[length > 1e-6] / length[length > 1e-6, None]
    if len(i) < LEAST_DIFFERENCES or len(centroids) < 2:
        return 1.0
    most = 0.0
    for at in range(0, len(i), 1024):
        c = centroids[own[i[at : at + 1024]]]
        line = np.sqrt(np.maximum(1e-12, 2 - 2 * (c @ centroids.T)))
        along = np.abs((apart[at : at + 1024] * c).sum(axis=1)[:, None] - apart[at : at + 1024] @ centroids.T) / line
        along[np.arange(len(c)), own[i[at : at + 1024]]] = 0
        most = max(most, float(along.max()))
    return min(1.0, RESERVE * most)


def fit(sample: np.ndarray, total: int) -> Quantiser:
    """From unit vectors: about sqrt(total) cells, as far as the sample supports them, codes of the residuals, and the reach."""
    rng = np.random.default_rng(7)
    width = sample.shape[1]
    cells = int(max(1, min(round(sqrt(total)), len(sample) // TRAIN_OF_CELL)))
    centroids = _means(sample, cells, rng, unit=True)
    rest = sample - centroids[(sample @ centroids.T).argmax(axis=1)]
    edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    books = [_means(rest[:, c], min(CODES, len(sample)), rng) for c in cuts]
    return Quantiser(width, centroids, books, cuts, _reach(sample, centroids, rng))


def unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, str]:
    """Every row with its vector as bytes (null if it can't be linked), and the numpy type of the bytes."""
    import pyarrow as pa

    kind = "<f4" if "float" in dict(vectors.dtypes)[column] else "<f8"
    element = "float" if kind == "<f4" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch.column(1).to_pylist():
                x = None if not v or None in v else np.array(v, kind)
                fine = x is not None and np.isfinite(x).all() and np.isfinite(n := np.linalg.norm(x.astype(np.float64))) and n > 0
                out.append((x + 0).tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast(f"array<{element}>").alias("v"))
    return materialise(rows.mapInArrow(run, "id bigint, bytes binary"), "vectors"), kind


LINK_ROWS = "a bigint, n bigint, b bigint"


def _told(links: np.ndarray, x_id: np.ndarray, x_n: np.ndarray, y_id: np.ndarray, y_n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]] | None:
    """Of a matrix of links: ids with the links counted at them (both sides), and ids with the least id that they reach, a forest."""
    has_x, has_y = links.any(axis=1), links.any(axis=0)
    if not has_x.any():
        return None
    sub, px, py = links[has_x][:, has_y], x_id[has_x], y_id[has_y]
    ids, n = np.concatenate((px, py)), np.concatenate((sub @ y_n[has_y], x_n[has_x] @ sub))
    big = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(px, np.where(sub, py[None], big).min(axis=1))
        ny = np.minimum(py, np.where(sub, nx[:, None], big).min(axis=0))
        if (nx == px).all() and (ny == py).all():
            return ids, n, np.concatenate((px, py))
        px, py = nx, ny


def _link_batch(told: tuple) -> object:
    import pyarrow as pa

    ids, n, low = told
    none = pa.nulls(len(ids), pa.int64())
    columns = [pa.array(np.concatenate((ids, ids)), pa.int64())]
    columns += [pa.concat_arrays([pa.array(n, pa.int64()), none]), pa.concat_arrays([none, pa.array(low, pa.int64())])]
    return pa.RecordBatch.from_arrays(columns, names=["a", "n", "b"])


def _few_links(reps: DataFrame, kind: str, threshold: float) -> DataFrame:
    """a, n, b as in ``_links`` among vectors of equal length, for lengths of at most FEW vectors."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def out(rows: list) -> object | None:
            x, ids, n = unit([r[3] for r in rows], kind), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            told = _told(np.triu(x @ x.T >= threshold, 1), ids, n, ids, n) if len(rows) > 1 else None
            return None if told is None else _link_batch(told)

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)))
            while held and held[-1][0] != held[0][0]:
                end = next(k for k, r in enumerate(held) if r[0] != held[0][0])
                if (found := out(held[:end])) is not None:
                    yield found
                del held[:end]
        if held and (found := out(held)) is not None:
            yield found

    rows = reps.select(F.octet_length("bytes").alias("size"), "id", "n", "bytes").repartition("size").sortWithinPartitions("size", "id")
    return rows.mapInArrow(run, LINK_ROWS)


def _links(reps: DataFrame, kind: str, quantiser: Quantiser, threshold: float) -> DataFrame:
    """a, n, b: links counted at a (with n null: a forest edge between a and b). Counts of a come from several tasks."""
    import pyarrow as pa

    spark = reps.sparkSession
    angle = acos(threshold) + 1e-6
    radius = sqrt(2 - 2 * threshold)
    shared = spark.sparkContext.broadcast(quantiser)  # sqrt(vectors) or train / TRAIN_OF_CELL centroids and SUBSPACES x CODES parts at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                cell, turned, codes, left = q.place(unit(rows.column(2).to_pylist(), kind))
                own = [pa.array(cell), pa.array(turned), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *own], names=["id", "n", "bytes", "cell", "turned", "codes", "left"])

    placed = materialise(reps.select("id", "n", "bytes").mapInArrow(place, "id bigint, n bigint, bytes binary, cell bigint, turned double, codes binary, left double"), "lists")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"), F.min("turned").alias("low"), F.max("turned").alias("high"))
    parts = materialise(parts, "parts")
    found = parts.collect()  # a row for each centroid at most
    ranges = np.full((len(quantiser.centroids), 3), [0.0, np.inf, -np.inf])
    for r in found:
        ranges[r["cell"]] = r["parts"], r["low"], r["high"]
    lists = spark.sparkContext.broadcast(ranges)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (n_parts, low, high) = shared.value, lists.value.T
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                x, own = unit(rows.column(2).to_pylist(), kind), np.array(rows.column(3))
                turned = np.arccos(np.clip(x @ q.centroids.T, -1, 1))
                maybe = q.visits(x, own, angle) & (turned >= low - angle - 1e-9) & (turned <= high + angle + 1e-9)
                maybe &= np.arange(len(q.centroids)) >= own[:, None]  # each pair of lists from one side
                k, cell = np.nonzero(maybe)
                times = n_parts[cell].astype(np.int64)
                part = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                k, cell = np.repeat(k, times), np.repeat(cell, times)
                inside = pa.array(cell == own[k])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(k)) for c in rows.columns[:3]), inside, pa.array(cell), pa.array(part)], names=["id", "n", "bytes", "inside", "cell", "part"])

    queries = placed.select("id", "n", "bytes", "cell").mapInArrow(probe, "id bigint, n bigint, bytes binary, inside boolean, cell bigint, part bigint")
    members = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    queries = queries.join(parts, "cell").withColumn("slice", F.pmod(F.xxhash64(F.lit("q"), "id"), "parts"))
    at = ["cell", "part", "slice"]
    blank = [F.lit("").cast("binary").alias("codes"), F.lit(0.0).alias("turned"), F.lit(0.0).alias("left")]
    rows = members.select(*at, F.lit(0).alias("asks"), "id", "n", "bytes", "codes", "turned", "left", F.lit(True).alias("inside"))
    rows = rows.unionByName(queries.select(*at, F.lit(1).alias("asks"), "id", "n", "bytes", *blank, "inside"))
    rows = rows.repartition(*at).sortWithinPartitions(*at, "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        tile, held, block = None, [], None

        def ready() -> tuple:
            ids, n, turned, left = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 3))
            y = unit([v for h in held for v in h[4]], kind)
            codes = np.frombuffer(b"".join(c for h in held for c in h[5]), np.uint8).reshape(len(ids), -1)
            order = np.argsort(turned, kind="stable")
            return ids[order], n[order], turned[order], left[order], y[order], codes[order]

        def answer(x_id: np.ndarray, x_n: np.ndarray, x: np.ndarray, turned: np.ndarray, inside: np.ndarray) -> pa.RecordBatch | None:
            s, e = np.searchsorted(block[2], [turned.min() - angle - 1e-9, turned.max() + angle + 1e-9])
            y_id, y_n, _, y_left, y, y_codes = (v[s:e] for v in block)
            if not len(y_id):
                return None
            rest = (x - q.centroids[tile[0]]).astype(np.float32)
            tables = []  # code x query: a member's code picks a row of distances to all queries
            for cut, book in zip(q.cuts, q.books):
                part = rest[:, cut]
                book = book.astype(np.float32)
                tables.append((book**2).sum(axis=1)[:, None] - 2 * book @ part.T + (part**2).sum(axis=1))
            bound = ((radius + y_left + SLACK) ** 2).astype(np.float32)
            found_i, found_j = [], []
            for t in range(0, len(y), 256):
                codes = y_codes[t : t + 256]
                square = tables[0][codes[:, 0]]
                for m in range(1, len(tables)):
                    square += tables[m][codes[:, m]]
                j, i = np.nonzero(square <= bound[t : t + 256, None])
                fits = ~inside[i] | (x_id[i] < y_id[t + j])  # inside a list each pair once
                found_i.append(i[fits])
                found_j.append(t + j[fits])
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            links = np.zeros((len(x), len(y)), bool)
            for t in range(0, len(i), 65_536):
                a, b = i[t : t + 65_536], j[t : t + 65_536]
                links[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            told = _told(links, x_id, x_n, y_id, y_n)
            return None if told is None else _link_batch(told)

        for batch in batches:
            keys = np.stack([np.array(batch.column(k)) for k in range(4)])
            ids, n, inside = (np.array(batch.column(k)) for k in (4, 5, 10))
            change = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if s == e:
                    continue
                where = tuple(keys[:3, s].tolist())
                if where != tile:
                    tile, held, block = where, [], None
                data = batch.column(6)[s:e].to_pylist()
                if not keys[3, s]:
                    held.append([ids[s:e], n[s:e], *[np.array(batch.column(k)[s:e]) for k in (8, 9)], data, batch.column(7)[s:e].to_pylist()])
                    continue
                if not held:
                    continue
                block = block or ready()
                x = unit(data, kind)
                turned = np.arccos(np.clip(x @ q.centroids[tile[0]], -1, 1))
                order = np.argsort(turned, kind="stable")
                for t in range(0, len(order), STEP):
                    k = order[t : t + STEP]
                    if (out := answer(ids[s:e][k], n[s:e][k], x[k], turned[k], inside[s:e][k])) is not None:
                        yield out

    return rows.select(*at, "asks", "id", "n", "bytes", "codes", "turned", "left", "inside").mapInArrow(compare, LINK_ROWS)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding", train: int = TRAIN_VECTORS) -> DataFrame:
    """key, n_links, component_id and kept of every row of ``vectors``."""
    rows, kind = _classes(vectors, key, column)
    whole = F.col("bytes").isNotNull() & F.col("id").isNotNull()
    reps = rows.filter(whole).groupBy("bytes").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = materialise(reps, "classes")
    size = F.octet_length("bytes")
    lengths = materialise(reps.groupBy(size.alias("size")).agg(F.count("*").alias("total")).filter("total > 1"), "lengths")
    found = [_few_links(reps.join(lengths.filter(F.col("total") <= FEW), size == F.col("size"), "left_semi"), kind, threshold)]
    for r in lengths.filter(F.col("total") > FEW).orderBy("size").collect():  # a row for each length that many vectors have
        own = reps.filter(size == r["size"])
        share = min(1.0, train / r["total"])
        chosen = own.filter(F.pmod(F.xxhash64(F.lit("train"), "bytes"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("bytes")
        sample = sorted(bytes(v["bytes"]) for v in chosen.collect()) or [bytes(v["bytes"]) for v in own.select("bytes").limit(1).collect()]  # about ``train`` vectors
        found.append(_links(own, kind, fit(unit(sample, kind), r["total"]), threshold))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = materialise(links, "links")
    counts = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    classes = reps.select("bytes", F.col("id").alias("rep"), F.col("n").alias("copies"))
    classes = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    classes = materialise(classes.withColumn("component", F.coalesce("component", "rep")), "classes")
    out = rows.withColumn("bytes", F.when(whole, F.col("bytes"))).join(classes, "bytes", "left")
    component = F.coalesce("component", "id")
    n = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias(key), n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
ORACLE_SQL = {
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(a, c) AS (SELECT a, least(a, b) FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.c, v.vec_id) AS component_id, coalesce(m.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON v.vec_id = n.a
LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON v.vec_id = m.a""",
}
