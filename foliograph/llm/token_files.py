"""Token ids as compressed binary files, by a static range asymmetric numeral system (rANS).

A file is a table of shards. A shard holds whole documents in ascending order and is decoded by itself:

    magic 'FGR1' | n_docs, n_ids, n_symbols, n_blocks: u32 | doc sizes: u32[n_docs] | symbols: u32[n_symbols]
    | frequencies: u32[n_symbols] | checkpoints: (first id: u32, offset into the words: u32, words: u32, crc32 of ids: u32)[n_blocks]
    | states: u64[n_blocks][LANES] | words: u32[...]

All blocks of a shard share one frequency table (counts scaled to 2**SCALE, none below 1). A block is BLOCK ids dealt over
LANES interleaved coder states; the checkpoints let blocks be decoded in parallel and apart, and each block is checked against
its checksum. Encoding runs backwards so that decoding runs forwards. Spark's writer commits files, so a lost executor's half-written
file is never read.

Documents are range-partitioned by key and sorted, so files in order hold ids in ascending key order. Only the number of ids of
each partition (one row for each) reaches the driver, for the running totals.

Defined cases: a null text is empty and has the end id alone; null keys sort first; equal keys stay together, ordered by text;
texts of any length are encoded whole and a long document makes a longer shard; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claim, fresh_path, partitions, table
from ._pieces import CACHE_BYTES, Computed

MAGIC = b"FGR1"
SCALE = 20
LANES = 2048
BLOCK = LANES * 256
#: Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1 << 20
LOW = np.uint64(1 << 31)
_ENCODERS: dict[str, WordEncoder] = {}


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, each at least 1, in proportion to counts."""
    total = 1 << SCALE
    freq = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    over = int(freq.sum()) - total
    if over < 0:
        freq[freq.argmax()] -= over
    while over > 0:  # taken from the largest, in proportion to what they can give
        spare = freq - 1
        take = np.minimum(spare, -(-spare * over // spare.sum()))
        excess = int(take.sum()) - over
        if excess > 0:
            for k in np.flatnonzero(take)[:excess]:
                take[k] -= 1
        freq -= take
        over = int(freq.sum()) - total
    return freq


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A shard of documents with these sizes, whose ids lie end to end."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts, slots = counts[symbols], np.zeros(len(counts), np.uint32)
        slots[symbols] = np.arange(len(symbols), dtype=np.uint32)
        rank = slots[ids]
    else:
        symbols, rank, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = scaled(counts) if len(ids) else np.zeros(0, np.int64)
    start = np.concatenate(([0], freq.cumsum()[:-1])).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    f = freq.astype(np.uint64)
    limit = f << np.uint64(63 - SCALE)
    checks, states, words, offset = [], [], [], 0
    for at in range(0, len(ids), BLOCK):
        own = rank[at : at + BLOCK]
        steps = -(-len(own) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        out = []
        own_f, own_limit, own_start = f[own], limit[own], start[own]
        for t in range(steps - 1, -1, -1):
            here = slice(t * LANES, min((t + 1) * LANES, len(own)))
            n = here.stop - here.start
            y, fs = x[:n], own_f[here]
            full = y >= own_limit[here]
            # read forwards, a step's words come in the order of its lanes
            out.append(y[full].astype(np.uint32))
            y = np.where(full, y >> np.uint64(32), y)
            q = y // fs
            x[:n] = (q << np.uint64(SCALE)) + (y - q * fs) + own_start[here]
        block = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        checks.append((at, offset, len(block), zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes())))
        states.append(x)
        words.append(block)
        offset += len(block)
    head = MAGIC + struct.pack("<4I", len(sizes), len(ids), len(symbols), len(checks))
    body = [sizes.astype("<u4"), symbols.astype("<u4"), freq.astype("<u4"), np.array(checks, "<u4").ravel()]
    if states:
        body += [np.concatenate(states).astype("<u8"), np.concatenate(words).astype("<u4")]
    return head + b"".join(a.tobytes() for a in body)


def unpack(shard: bytes, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document sizes, and the ids of all blocks or of a range of them."""
    if shard[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    n_docs, n_ids, n_symbols, n_blocks = struct.unpack_from("<4I", shard, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(shard, kind, n, at)
        at += out.nbytes
        return out

    sizes, symbols, freq = take("<u4", n_docs), take("<u4", n_symbols), take("<u4", n_symbols)
    checks, states = take("<u4", 4 * n_blocks).reshape(-1, 4), take("<u8", n_blocks * LANES).reshape(-1, LANES)
    words = np.frombuffer(shard, "<u4", -1, at)
    if not n_ids:
        return sizes, np.zeros(0, np.uint32)
    slot = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq)
    f = freq.astype(np.uint64)
    start = np.concatenate(([0], freq.astype(np.int64).cumsum()[:-1])).astype(np.uint64)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    found = []
    for b in blocks if blocks is not None else range(n_blocks):
        first, offset, n_words, crc = map(int, checks[b])
        n = min(BLOCK, n_ids - first)
        x = states[b].copy()
        ranks = np.empty(n, np.uint32)
        own, read = words[offset : offset + n_words].astype(np.uint64), 0
        for t in range(0, n, LANES):
            m = min(LANES, n - t)
            y = x[:m]
            low = y & mask
            s = slot[low]
            ranks[t : t + m] = s
            y = f[s] * (y >> scale) + low - start[s]
            need = np.flatnonzero(y < LOW)
            if len(need):
                y[need] = (y[need] << np.uint64(32)) | own[read : read + len(need)]
                read += len(need)
            x[:m] = y
        ids = symbols[ranks]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b} doesn't match its checksum")
        found.append(ids)
    return sizes, np.concatenate(found) if found else np.zeros(0, np.uint32)


class WordEncoder:
    """A ``tokenizers`` file, with bounded caches of words and of white-space-separated stretches.

    Where the file's own steps allow it (white space dropped, no piece across it), a stretch's ids don't depend on its
    neighbours. Plain texts and stretches are cut into words and marks as the file's pattern does, and each goes to the
    library's model once; other stretches, and the texts of other files, go to the library as they are. The way by parts is
    taken only if it gives the library's ids for PROBES, and one text of each block is compared with the library's ids for it.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = np.array([end_id], "<u4").tobytes()
        self.words = Computed(CACHE_BYTES, self.word)
        self.hard = Computed(CACHE_BYTES // 2, lambda s: self.by_library([s])[0])
        said = self.tokenizer.to_str()
        self.by_part = '"Regex":"\\\\s+"' in said and '[^\\\\s\\\\p{L}\\\\p{N}]+' in said and '"invert":true' in said
        self.by_part = self.by_part and list(map(self.by_parts, PROBES)) == self.by_library(PROBES)

    @classmethod
    def of(cls, path: str, end_id: int) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path, end_id)
        return _ENCODERS[path]

    def by_library(self, texts: list[str]) -> list[bytes]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in many(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        said = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        ids = [t.id for t in self.model.tokenize(said)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_parts(self, text: str) -> bytes:
        word = self.words.__getitem__
        if "<|" not in text and PLAIN_TEXT(text):
            return b"".join(map(word, PARTS(text.lower())))
        return b"".join([b"".join(map(word, PARTS(s.lower()))) if PLAIN(s) else self.hard[s] for s in WHITE(text)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        said = [t or "" for t in texts]
        if not self.by_part:
            return [b + self.end for b in self.by_library(said)]
        out = list(map(self.by_parts, said))
        at = min(range(len(said)), key=lambda k: abs(len(said[k]) - PROBE_CHARS), default=None)
        if at is not None and len(said[at]) <= 4 * PROBE_CHARS and self.by_library([said[at]]) != [out[at]]:
            raise ValueError(f"the ids by stretches and the library's differ in {said[at][:2000]!r}")
        return [b + self.end for b in out]


def _byte_letters() -> dict[int, str]:
    """Fixed by byte-level tokenizers: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTES = _byte_letters()
#: Stretches of white space as the library's pattern has it (Unicode White_Space).
WHITE = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
#: Stretches that the cut below treats just as the library does: ASCII, and Latin letters that NFC and lower-casing keep one character.
PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-\u00ffœŒ]+").fullmatch
PLAIN_TEXT = re.compile(r"[ -~\t\n\rÀ-ÖØ-öø-\u00ffœŒ]*").fullmatch
#: Fixed by the tokenizer's file: contractions, words, single digits, runs of other marks.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-\u00ffœ]+|[0-9]|[^\sa-z0-9ß-öø-\u00ffœ]+").findall


#: Compared with the library before the way by stretches is taken.
PROBES = ["", " a  b\tc\n", "It's we'LL they've, don't.", "x1y22 3.14 (a|b) !!! a--b", "été ÉTÉ straße œuvre", "日本 テスト😀 ﬁ é", "<|endoftext|> <| a<|b", "aáa\u0301a"]
#: Characters of the text of a block that is compared with the library, about.
PROBE_CHARS = 1000


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", n_files: int | None = None) -> None:
    """Write the ids of all documents, in ascending key order, as shards under ``path``."""
    import pyarrow as pa

    spark = documents.sparkSession
    ordered = documents.select(F.col(key).alias("key"), "text").repartitionByRange(n_files or partitions(spark), "key").sortWithinPartitions("key", "text")
    keys = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("token_files", _ENCODERS.clear)
        encoder = WordEncoder.of(tokenizer_path, end_id)
        part, first, shard = TaskContext.get().partitionId(), 0, 0
        held, held_keys, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, shard, held, held_keys, n
            sizes = np.array([len(b) // 4 for b in held], np.int64)
            blob = pack(np.frombuffer(b"".join(held), "<u4"), sizes)
            row = [[part], [shard], [first], [n], [held_keys], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(key_kind), pa.binary()]
            first, shard, held, held_keys, n = first + n, shard + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "shard", "first", "n_ids", "keys", "blob"])

        for batch in batches:
            key_kind = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                block = batch.slice(at, 512)
                for k, b in zip(block.column(0).to_pylist(), encoder.encode(block.column(1).to_pylist())):
                    held.append(b)
                    held_keys.append(k)
                    n += len(b) // 4
                    if n >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    schema = f"part int, shard int, first bigint, n_ids bigint, keys array<{keys.simpleString()}>, blob binary"
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start (ids before the document), n_tokens and ids_crc32 of each document in the files; on request its ``ids``."""
    import pyarrow as pa

    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    offsets, total = {}, 0
    for row in totals:
        offsets[row["part"]] = total
        total += row["n"]
    keys = shards.schema["keys"].dataType.elementType
    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"{key} {keys.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, own, blob = (batch.column(c)[k].as_py() for c in (0, 1, 2, 3))
                sizes, ids = unpack(blob)
                ends = sizes.astype(np.int64).cumsum()
                starts = ends - sizes
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(own, batch.column(2).type.value_type), pa.array(starts + first + offsets[part]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[s:e].tolist() for s, e in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return shards.select("part", "first", "keys", "blob").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_token_files(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
