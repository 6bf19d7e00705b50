"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has ``COORDINATES`` places. In round i every shingle is thrown into one of the places by the round's own hash, and a
place keeps the least value thrown into it; rounds go on until all places are filled. From round COORDINATES on, round i throws
everything into place i - COORDINATES, so all places are filled after at most twice as many rounds. A value of an earlier round
is below all later ones. The share of equal places estimates the Jaccard similarity, with the concentration of sampling
without replacement; unlike one-permutation hashing no place stays empty and none is copied.

1.  Documents with the same words are one class, with its least id as representative.
2.  Bands of ``rows`` places bring representatives into buckets. Of buckets with the same members one stays; large ones are
    split into blocks, by rows and by the bytes of their full sets.
3.  In a block the first document leads; those whose sketches are close to it follow it, the rest go on among themselves.
    Each follower gives one candidate pair, so a group of n near copies gives about n pairs, not n * n.
4.  Pairs are confirmed on the full sets. A set is made where its text is read and travels once for each pair; a leader's set
    once for each slice of its followers.
5.  Components of the confirmed links. Where a bucket still holds several components, its rows that sketch close to a row of
    another component meet again with their full sets, block against block, and all their intersections are counted at once.
    A spanning forest of the confirmed links leaves the task, so rows stay in proportion to the members; then components again.
    Links inside a component change nothing, so leaving them out loses no component.

Chance of missing a link at the threshold: below 1e-6 for the bands, about 1e-6 for the sketch test.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle count
as one shingle; a null id is a component of its own, with null component_id, and kept; rows that share an id share a component;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, claim, materialise, parts, table
from ._graph import components, merged

COORDINATES = 120
#: Members of a bucket's block at most, about.
BLOCK_MEMBERS = 1024
#: Bytes of the full sets of a bucket's block at most, about; a longer set is a block of its own.
BLOCK_SET_BYTES = 8 << 20
#: Followers of a leader that are confirmed in one slice, about.
SLICE = 256
#: Slices or blocks of one set that are listed in one row.
WANTED = 64
#: Ids, and rows of about 50 bytes, that may be sent to every executor; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_ROWS = 1_000_000, 200_000
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20
U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)
_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RANDOM.integers(0, 2**62)) * 8 + 5
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS.get("up", ()))
    if have < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b & (2**64 - 1), np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, by running sums over all words end to end."""
    if not words:
        return np.zeros(0, np.uint64)
    out = []
    at = 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = sizes.cumsum()
    while at < len(words):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
        data = np.frombuffer(b"".join(words[at:stop]), np.uint8)
        up, down = _powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        e = ends[at:stop] - base
        s = e - sizes[at:stop]
        out.append(mix((sums[e] - sums[s]) * down[s] + sizes[at:stop].astype(np.uint64)))
        at = stop
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], size: int) -> list[tuple[bytes | None, np.ndarray]]:
    """Of each text: a digest of its words (None without words) and its set of shingle hashes, sorted."""
    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashes = word_hashes([w for row in cut for w in row])
    out, at = [], 0
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | U(1)
    for row in cut:
        h = hashes[at : at + len(row)]
        at += len(row)
        if not row:
            out.append((None, h))
            continue
        if len(h) < size:
            whole = mix((h * factors[: len(h)]).sum(dtype=np.uint64, keepdims=True) + U(len(h)))
        else:
            n = len(h) - size + 1
            whole = np.zeros(n, np.uint64)
            for k in range(size):
                whole += h[k : k + n] * factors[k]
            whole = np.unique(mix(whole))
        out.append((hashlib.md5(b" ".join(row)).digest(), whole))
    return out


def sketch(sets: list[np.ndarray], places: int = COORDINATES) -> np.ndarray:
    """Sketches of non-empty sets, one row each: the round in the high bits, the hash in the low ones."""
    n = len(sets)
    out = np.full((n, places), EMPTY)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    active = doc
    for i in range(2 * places):
        if not len(flat):
            break
        h = mix(flat ^ mix(np.array([i + 1], np.uint64)))
        low = h & U((1 << 48) - 1)
        place = ((h >> U(48)) * U(places) >> U(16)).astype(np.int64) if i < places else np.full(len(h), i - places)
        thrown = np.full(n * places, EMPTY)
        np.minimum.at(thrown, active * places + place, low | U(i) << U(48))
        thrown = thrown.reshape(n, places)
        out = np.where(out == EMPTY, thrown, out)
        open_ = (out == EMPTY).any(axis=1)
        left = open_[active]
        flat, active = flat[left], active[left]
    return out


def band_rows(threshold: float, places: int = COORDINATES) -> int:
    """The most rows with which the chance that no band of a pair at the threshold agrees is below 1e-6."""
    return max(r for r in range(1, 9) if places % r == 0 and (r == 1 or (1 - threshold**r) ** (places // r) < 1e-6))


def close_enough(threshold: float, places: int = COORDINATES) -> int:
    """Equal places that a pair at the threshold has with a chance of about 1 - 1e-6."""
    return floor(places * threshold - 4.7 * sqrt(places * threshold * (1 - threshold)))


def sketched(documents: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, words (digest), buckets and marks (a byte of each place)."""
    import pyarrow as pa

    rows = band_rows(threshold)
    bands = COORDINATES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash_dedup", _POWERS.clear)
        salt = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
        number = mix(np.arange(7, 7 + bands, dtype=np.uint64))
        for batch in parts(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts, BLOCK_BYTES):
                got = shingle_sets(texts[a:b], size)
                live = [k for k, (d, _) in enumerate(got) if d is not None]
                s = sketch([got[k][1] for k in live])
                keys = (s * salt).reshape(len(live), bands, rows).sum(axis=2, dtype=np.uint64)
                keys = mix(keys + number).view(np.int64)
                marks = (mix(s) >> U(56)).astype(np.uint8)
                buckets: list = [None] * len(got)
                mark: list = [None] * len(got)
                for row, k in enumerate(live):
                    buckets[k], mark[k] = keys[row].tolist(), marks[row].tobytes()
                columns = [
                    ids[a:b],
                    pa.array([len(x) for _, x in got], pa.int64()),
                    pa.array([d for d, _ in got], pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                    pa.array(mark, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words", "buckets", "marks"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, words binary, buckets array<bigint>, marks binary"
    )


def leaders(members: DataFrame, threshold: float) -> DataFrame:
    """bucket, block, id, marks -> distinct candidate pairs (a, b): each member and the first one that it is close to."""
    import pyarrow as pa

    least = close_enough(threshold)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = None  # a block may go on in the next batch
        for batch in batches:
            got = [batch.column(k).to_numpy() for k in (0, 1, 2)]
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            now = [*got, marks]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            for s, e in zip([0, *change.tolist()], change.tolist()):
                yield now[2][s:e], now[3][s:e]
            last = int(change[-1]) if len(change) else 0
            held = [p[last:] for p in now]
        if held is not None and len(held[0]):
            yield held[2], held[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for ids, marks in groups(batches):
            while len(ids) > 1:
                close = (marks[1:] == marks[0]).sum(axis=1) >= least
                a += ids[1:][close].tolist()
                b += [int(ids[0])] * int(close.sum())
                ids, marks = ids[1:][~close], marks[1:][~close]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.select("bucket", "block", "id", "marks").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _tiles(members: DataFrame) -> DataFrame:
    """bucket, i, j, own, id, component, marks: members dealt into blocks, and each block beside every block of its bucket."""
    n_blocks = F.col("n_blocks")
    own = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    rows = members.withColumn("own", own).withColumn("tile", F.explode(tiles))
    return rows.select("bucket", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "own", "id", "component", "marks")


def _streamed(batches: Iterator, data: int) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Groups of rows, sorted by their first three columns: the number columns and the bytes of column ``data`` of each group."""
    held: list | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(data)] + [batch.column(data).to_pylist()]
        if held is not None:
            now = [np.concatenate(p) if k < data else p[0] + p[1] for k, p in enumerate(zip(held, now))]
        if not len(now[0]):
            continue
        change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
        for s, e in zip([0, *change.tolist()], change.tolist()):
            yield [x[s:e] for x in now[:data]], now[data][s:e]
        last = int(change[-1]) if len(change) else 0
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield held[:data], held[data]


TILE = ["bucket", "i", "j"]
TILE_ROW = "bucket bigint, i int, j int, own int, id bigint, component bigint"


def close_members(members: DataFrame, threshold: float) -> DataFrame:
    """The rows of the tiles that sketch close to a row of another component, without marks: at most one for each row, never pairs."""
    import pyarrow as pa

    least = close_enough(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = [*TILE, "own", "id", "component"], [], 0
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names=names)

        for columns, data in _streamed(batches, 6):
            comp, own = columns[5], columns[3]
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            marks = np.frombuffer(b"".join(data), np.uint8).reshape(-1, COORDINATES)
            apart = columns[1][0] != columns[2][0]
            close = np.zeros(len(comp), bool)
            for x in range(len(comp)):
                y = np.flatnonzero((comp != comp[x]) & (own != own[x]) if apart else comp != comp[x])
                close[x] = ((marks[y] == marks[x]).sum(axis=1) >= least).any()
            if close.any():
                held.append([c[close] for c in columns])
                n += int(close.sum())
                if n > 20_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    rows = _tiles(members).repartition(*TILE).sortWithinPartitions(*TILE)
    return rows.mapInArrow(run, TILE_ROW)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the columns that several sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for first in range(0, int(column.max()) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [first, first + width])
        held = np.zeros((n, width), np.float32)
        held[row[s:e], column[s:e] - first] = 1
        out += held @ held.T
    return out.astype(np.int32)


def confirm_tiles(rows: DataFrame, documents: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) of a spanning forest of what the full sets confirm in each tile across components."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for columns, data in _streamed(batches, 6):
            own, ids, comp = columns[3], columns[4], columns[5]
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(d, np.uint64) for d in data]
            sizes = np.array([len(x) for x in sets], np.int32)
            common = _common(sets)
            links = (denominator * common >= numerator * (sizes[:, None] + sizes[None] - common)) & (comp[:, None] != comp[None])
            if columns[1][0] != columns[2][0]:
                links &= own[:, None] != own[None]
            label = ids.copy()
            big = np.iinfo(np.int64).max
            while True:
                low = np.minimum(label, np.where(links, label[None], big).min(axis=1))
                if (low == label).all():
                    break
                label = low
            joined = label != ids
            a += ids[joined].tolist()
            b += label[joined].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    other = F.col("i") + F.col("j") - F.col("own")
    rows = sets_at(documents, rows.withColumn("chunk", F.floor(other / WANTED).cast("int")), size, rows.count()).select(*TILE, "own", "id", "component", "set")
    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, "a bigint, b bigint").distinct()


def sets_at(documents: DataFrame, wanted: DataFrame, size: int, most: int) -> DataFrame:
    """The rows of ``wanted`` (id, chunk and further columns), each with the ``set`` (sorted 64-bit hashes as bytes) of its document.

    Rows of one id and chunk are listed in one row, so that a set is made once for them; the lists are taken apart beside the
    set. ``wanted`` has at most ``most`` rows, which tells whether it may be broadcast.
    """
    import pyarrow as pa

    rest = [c for c in wanted.columns if c not in ("id", "chunk")]
    kinds = ", ".join(f"{c}:{dict(wanted.dtypes)[c]}" for c in rest)
    lists = wanted.groupBy("id", "chunk").agg(F.collect_list(F.struct(*rest)).alias("own")).select("id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash_dedup", _POWERS.clear)
        for batch in parts(batches):
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts, BLOCK_BYTES):
                sets = [s.tobytes() for _, s in shingle_sets(texts[a:b], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sets, pa.binary())], names=["id", "own", "set"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    if most <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    elif most <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi")
    made = texts.join(lists, "id").select("id", "own", "text").mapInArrow(run, f"id bigint, own array<struct<{kinds}>>, set binary")
    return made.select("id", "set", F.inline("own"))


def confirm(pairs: DataFrame, documents: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) with denominator * intersection >= numerator * union on their full sets."""
    import pyarrow as pa

    # A document leads at most BLOCK_MEMBERS others in each of its buckets, so no key of this join is hot.
    slices = pairs.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("n"))
    followers = pairs.join(slices, "b").select("b", F.pmod(F.xxhash64("a"), "n").cast("int").alias("slice"), F.col("a").alias("id"), F.lit(0).alias("chunk"), F.lit(1).alias("follows"))
    each = slices.select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    heads = each.select("b", "slice", F.col("b").alias("id"), F.floor(F.col("slice") / WANTED).cast("int").alias("chunk"), F.lit(0).alias("follows"))
    rows = sets_at(documents, followers.unionByName(heads), size, 2 * pairs.count()).repartition("b", "slice").sortWithinPartitions("b", "slice", "follows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash_dedup", _POWERS.clear)
        head: list[np.ndarray] = []
        for_, at = None, None
        for batch in batches:
            found_a, found_b = [], []
            columns = [batch.column(c) for c in ("b", "slice", "id", "follows", "set")]
            for b, part, k, follows, data in zip(*(c.to_pylist() for c in columns[:4]), columns[4]):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if (b, part) != (for_, at):
                    for_, at, head = b, part, []
                if not follows:
                    head.append(own.copy())  # more than one only where rows share an id
                    continue
                for h in head:
                    common = len(np.intersect1d(own, h, assume_unique=True))
                    if denominator * common >= numerator * (len(own) + len(h) - common):
                        found_a.append(k)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return rows.select("b", "slice", "id", "follows", "set").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    threshold = numerator / denominator
    rows = materialise(sketched(documents, shingle, threshold), "sketches")
    classes = rows.filter("words IS NOT NULL AND doc_id IS NOT NULL").groupBy("words").agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "classes")
    joined = rows.join(classes, "words", "left")
    first = F.col("doc_id") == F.col("rep")
    rows = materialise(
        joined.select("doc_id", "n_shingles", "rep", F.when(first, F.col("buckets")).alias("buckets"), F.when(first, F.col("marks")).alias("marks")), "sketches"
    )
    reps = rows.filter("doc_id = rep")
    in_buckets = reps.select(F.col("doc_id").alias("id"), "n_shingles", F.explode("buckets").alias("bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"sign{k}") for k in (1, 2)]
    shared = in_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), *same).filter("n > 1")
    # Near copies meet in most of their buckets; those with the same members say the same.
    shared = shared.groupBy("n", "weight", "sign1", "sign2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "weight")
    shared = materialise(shared, "buckets")
    members = in_buckets.drop("n_shingles").join(shared, "bucket").join(reps.select(F.col("doc_id").alias("id"), "marks"), "id")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int"))
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, 8 * F.col("weight") / BLOCK_SET_BYTES)).cast("int")
    members = materialise(members.select("bucket", n_blocks.alias("n_blocks"), "block", "id", "marks"), "members")

    pairs = materialise(leaders(members, threshold), "pairs")
    links = materialise(confirm(pairs, documents, shingle, numerator, denominator), "links")
    found = components(links)
    # What is left: buckets that hold more than one component.
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    more = materialise(close_members(placed.join(mixed, "bucket"), threshold), "close")
    extra = materialise(confirm_tiles(more, documents, shingle, numerator, denominator), "links")
    if extra.limit(1).count():
        found = merged(found, extra)
    out = rows.select("doc_id", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, numerator=85, denominator=100)


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
ORACLE_SQL: dict[str, str] = {}
