"""Encoding and decoding with a merge-type piece vocabulary.

An agenda (heap) holds adjacent symbol pairs that form a piece, best score first and leftmost among equals. The best pair
is merged, entries that its merge made stale are skipped, and the two pairs beside the new symbol enter the agenda. Symbols
left outside the vocabulary fall back to bytes. Each stretch that a batch brings anew is checked against the sentencepiece
library, and a difference stops the job: no row is emitted unchecked. Decoding is the library's.

Defined cases: a null text is empty; an empty text has only the end id and decodes to ''; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives no rows; a further column never meets the result's names,
for only the key is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import blocks, claim, parts, table
from ._pieces import CACHE_BYTES, BoundedCache, Vocabulary

#: Longer parts are merged one at a time, with a heap.
WIDE = 48
#: Characters of texts that are cut and learned at once; a longer text stands alone.
BLOCK_CHARS = 2 << 20
#: Rank of a pair that is no piece.
NEVER = np.int64(1 << 40)
_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, model_path: str):
        self.vocabulary = v = Vocabulary(model_path)
        self.rank = {p: -s for p, s in v.scores.items()}
        self.texts = list(map(str, range(len(v.sp))))
        self.known: BoundedCache = BoundedCache(CACHE_BYTES * 3 // 4)  # ids of a stretch, as bytes; more bytes save no time

    @classmethod
    def of(cls, model_path: str) -> PieceCodec:
        if model_path not in _CODECS:
            _CODECS[model_path] = cls(model_path)
        return _CODECS[model_path]

    def merge(self, part: str) -> bytes:
        """Ids of one stretch by the agenda."""
        ids = self.vocabulary.ids
        n = len(part)
        rank, symbols = self.rank, list(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for k in range(n - 1):
            pair = part[k : k + 2]
            if pair in rank:
                agenda.append((rank[pair], k, k + 1, pair))
        heapify(agenda)
        while agenda:
            _, a, b, pair = heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(pair):
                continue
            symbols[a], symbols[b] = pair, ""
            right[a] = c = right[b]
            if c < n:
                left[c] = a
                joined = pair + symbols[c]
                if joined in rank:
                    heappush(agenda, (rank[joined], a, c, joined))
            if (p := left[a]) >= 0:
                joined = symbols[p] + pair
                if joined in rank:
                    heappush(agenda, (rank[joined], p, a, joined))
        out: list[int] = []
        for s in symbols:
            if s:
                out += (ids[s],) if s in ids else self.vocabulary.fallback(s)
        return np.array(out, np.int32).tobytes()

    def merge_many(self, parts: list[str]) -> list[bytes]:
        """``merge`` of many stretches at once: the agenda is a row of ranks for each, and each round takes every row's best pair."""
        found: list[bytes | None] = [None] * len(parts)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            if 2 <= len(p) <= WIDE:
                by_length.setdefault(len(p), []).append(k)
            else:
                found[k] = self.merge(p)
        for n, rows in by_length.items():
            for at in range(0, len(rows), 4096):
                own = rows[at : at + 4096]
                for k, ids in zip(own, self._rounds([parts[k] for k in own], n)):
                    found[k] = ids if ids is not None else self.merge(parts[k])
        return found

    def _tables(self) -> None:
        """Numbers for symbols, and the sorted pairs (left, right) with the rank and number of what they merge to."""
        v = self.vocabulary
        number = dict(v.ids)
        for p in v.ids:
            for c in p:
                number.setdefault(c, len(number) + (1 << 20))
        self.symbol = np.arange(0x110000, dtype=np.int64) + (1 << 22)  # characters in no piece merge with nothing
        for s, i in number.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        order = {score: k for k, score in enumerate(sorted(set(self.rank.values())))}
        rows = [
            (number[p[:k]] << 32 | number[p[k:]], order[self.rank[p]], i)
            for p, i in v.ids.items()
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        ]
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows))) if rows else (np.array([-1]),) * 3

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NEVER), np.where(hit, self.pair_ids[at], -1)

    def _rounds(self, parts: list[str], n: int) -> list[bytes | None]:
        if not hasattr(self, "pair_keys"):
            self._tables()
        m = len(parts)
        symbols = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(m, n)
        alive = np.ones((m, n), bool)
        left = np.tile(np.arange(-1, n - 1), (m, 1))
        right = np.tile(np.arange(1, n + 1), (m, 1))
        rank, merged = np.full((m, n), NEVER), np.full((m, n), -1)
        rank[:, :-1], merged[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])
        r = np.arange(m)
        while True:
            a = rank[r].argmin(axis=1)  # the first of equals is the leftmost
            live = rank[r, a] < NEVER
            r, a = r[live], a[live]
            if not len(r):
                break
            b = right[r, a]
            c = right[r, b]
            symbols[r, a] = merged[r, a]
            alive[r, b] = False
            rank[r, b] = NEVER
            right[r, a] = c
            more = c < n
            left[r[more], c[more]] = a[more]
            rank[r, a] = NEVER
            rank[r[more], a[more]], merged[r[more], a[more]] = self._pair(symbols[r[more], a[more]], symbols[r[more], c[more]])
            p = left[r, a]
            more = p >= 0
            rank[r[more], p[more]], merged[r[more], p[more]] = self._pair(symbols[r[more], p[more]], symbols[r[more], a[more]])
        odd = ((symbols >= len(self.vocabulary.sp)) & alive).any(axis=1).tolist()
        flat, ends = symbols[alive].astype(np.int32).tobytes(), (4 * alive.sum(axis=1).cumsum()).tolist()
        return [None if o else flat[s:e] for o, s, e in zip(odd, [0, *ends], ends)]

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches not seen before and check each against the library."""
        found = self.merge_many(stretches)
        self.check(stretches, found)
        self.known.update(zip(stretches, found))

    def check(self, stretches: list[str], found: list[bytes]) -> None:
        """Stretches behind newlines, as many as a text may hold, must give the library's ids."""
        v = self.vocabulary
        if not (v.plain and v.stretch and "\n" not in "".join(v.ids)):
            for s, got in zip(stretches, (np.frombuffer(b, np.int32).tolist() for b in found)):
                if v.sp.decode(got).replace(" ", "▁").strip("▁") != s.strip("▁"):
                    raise ValueError(f"the agenda gives {got} for {s!r}, which decodes to another text")
            return
        newline = np.array(v.fallback("\n"), np.int32).tobytes()
        head = np.array(v.sp.encode("\n"), np.int32).tobytes()[: -len(newline)]
        size = 128
        texts = ["\n" + "\n".join(stretches[k : k + size]) for k in range(0, len(stretches), size)]
        for k, want in enumerate(v.sp.encode(texts, num_threads=1)):
            got = newline.join([head, *found[k * size : (k + 1) * size]])
            if got != np.array(want, np.int32).tobytes():
                raise ValueError(f"the agenda and the library differ in {texts[k][:2000]!r}")

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text with the end id."""
        known, end = self.known, np.array([self.vocabulary.end_id], np.int32).tobytes()
        for a, b in blocks(texts, BLOCK_CHARS):
            cut = [self.vocabulary.stretches(t or "") for t in texts[a:b]]
            if new := list(set().union(*cut).difference(known)):
                if not known.room(new, 24 * len(new)):  # emptied: all that this block needs is learned again
                    new = list(set().union(*cut))
                    known.room(new, 24 * len(new))
                self.learn(new)
            for row in cut:
                yield np.frombuffer(b"".join([*map(known.__getitem__, row), end]), np.int32).tolist()

    def said(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.texts.__getitem__, ids))


def encode_decode(documents: DataFrame, model_path: str, key: str = "doc_id", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each whole text; on request also ``ids`` and ``decoded``."""
    import pyarrow as pa

    kind = dict(documents.dtypes)[key]
    schema = f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("piece_codec", _CODECS.clear)
        codec = PieceCodec.of(model_path)
        decode, sha = codec.vocabulary.sp.decode, hashlib.sha256
        for batch in parts(batches):
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for ids in codec.encode_batch(batch.column(1).to_pylist()):
                text = decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(codec.said(ids).encode()).hexdigest())
                text_sha.append(sha(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_text:
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select(key, "text").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op7_piece_codec": op7_piece_codec}
ORACLE_SQL: dict[str, str] = {}
