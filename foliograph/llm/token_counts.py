"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary match in a text; a forward pass keeps, for each end position, the
best score that reaches it and the number of pieces on that path. Positions that no piece reaches are crossed by one
unknown character. Ties follow the tokenizer: paths to a position are tried by where their last piece begins, earliest
first, and only a strictly better score replaces one, so the earliest beginning wins.

Scores are added within a stretch that no piece reaches across, so sums stay small and exact where the library's 32-bit
running sums over a long text may round; on texts short enough not to round, counts equal the library's.

Defined cases: a null or empty text has 0 tokens; an unknown character counts one token, or one for each byte where the
vocabulary has byte pieces, and runs of unknown characters without byte pieces count one; whole texts are counted;
repeated rows give repeated results; an empty table gives no rows; only the key is carried beside the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ._common import claim, parts, table
from ._pieces import CACHE_BYTES, Computed, Vocabulary
from .piece_codec import default_model

#: Fixed by the tokenizer's format: an unknown character scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
_COUNTERS: dict[str, TokenCounter] = {}


class TokenCounter:
    def __init__(self, model_path: str):
        import ahocorasick

        self.vocabulary = v = Vocabulary(model_path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in v.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(v.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.parts = Computed(CACHE_BYTES // 2, self.count_part)
        self.known = Computed(CACHE_BYTES, self.count_stretch)

    @classmethod
    def of(cls, model_path: str) -> TokenCounter:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = cls(model_path)
        return _COUNTERS[model_path]

    def count_part(self, part: str) -> int:
        """Pieces on the best path through one part."""
        n = len(part)
        # All matches that end at a position are at hand when it is reached; the automaton gives the longest, which begins earliest, first.
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(part):
            matches[end + 1].append(match)
        best, count, ends_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        bytes_too = bool(self.vocabulary.byte_ids)
        for e in range(1, n + 1):
            score = None
            single = False
            for length, own in matches[e]:
                b = e - length
                single |= length == 1
                s = best[b] + own
                if score is None or s > score:
                    score, pieces, unknown = s, count[b] + 1, False
            if not single:  # a character without a piece of its own can be crossed as unknown; its beginning is the latest
                s = best[e - 1] + self.unknown
                if score is None or s > score:
                    own = len(part[e - 1].encode("utf-8", "surrogatepass")) if bytes_too else int(not ends_unknown[e - 1])
                    score, pieces, unknown = s, count[e - 1] + own, True
            best[e], count[e], ends_unknown[e] = score, pieces, unknown
        return count[n]

    def count_stretch(self, stretch: str) -> int:
        # Without byte pieces, neighbouring unknown characters are one token, so nothing is cut between them.
        return sum(map(self.parts.__getitem__, self.vocabulary.cut(stretch) if self.vocabulary.byte_ids else [stretch]))

    def count(self, text: str | None) -> int:
        return sum(map(self.known.__getitem__, self.vocabulary.stretches(text or "")))


def count_tokens(documents: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key and n_tokens of each whole text, no special ids counted."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _COUNTERS.clear)
        counter = TokenCounter.of(model_path)
        for batch in parts(batches):
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, "text").mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
