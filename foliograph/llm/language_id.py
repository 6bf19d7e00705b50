"""Language identification with labelled spans of mixed-language texts.

A word is a run of letters. The script of its first letter (by code point ranges) narrows its candidates to the languages
that use this script; each candidate's score is the sum of log-odds of the word's character trigrams. A Viterbi pass over
the words, with a penalty for each change of language, labels spans. The prediction is the language with most letters.

The trigram counts come from a bounded sample of labelled rows: about TRAIN_DOCS texts of each language, chosen by a hash
of the id, and held-out rows never enter it. Counts are summed by hashed bucket, so a model has at most BUCKETS rows for a language.

The Viterbi pass runs on chunks of CHUNK words at once: for each chunk, the best scores from each entering to each leaving
state; then chunk after chunk of a text; then all chunks backwards. A text of any length is labelled whole.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a text whose letters tell nothing gets the most
frequent language and score 1 / languages; ties go to the higher total score, then to the first name; without labelled rows
every text is ``und``; repeated rows give repeated results; an empty table gives no rows; result columns replace input columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, carried, claim, held_out, parts, table

#: Texts of each language, about, that the model learns from.
TRAIN_DOCS = 2000
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
CHUNK = 64
#: Code points of a block that is scored at once.
BLOCK_CHARS = 1 << 18
#: Bytes of back pointers of the pass by chunks, which has one for each pair of languages; beyond, words go one by one.
BACK_BYTES = 64 << 20
UNDETERMINED = "und"

#: First code points of Unicode script ranges and the script from there on; fixed by the Unicode blocks.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Lower case, letter and script of each code point of the first plane; later planes: letters of their range, unchanged."""
    if not _TABLES:
        n = 0x10000
        lower = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for i in range(n):
            c = chr(i)
            letter[i] = c.isalpha()
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        letter[0x10000:0x32000] = [chr(i).isalpha() for i in range(0x10000, 0x32000)]
        script = np.zeros(0x110000, np.uint8)
        for k, (first, name) in enumerate(SCRIPT_RANGES):
            end = SCRIPT_RANGES[k + 1][0] if k + 1 < len(SCRIPT_RANGES) else 0x110000
            script[first:end] = SCRIPTS.index(name)
        _TABLES.update(lower=lower, letter=letter, script=script)
    return _TABLES


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: trigram buckets end to end, each word's first place in them, its script, letters, text number and place in the text."""
    t = _tables()
    joined = "\n" + "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = t["letter"][raw]
    c = np.where(letter, t["lower"][raw], 0).astype(np.uint32)
    before = np.concatenate(([np.uint32(0)], c[:-1]))
    before2 = np.concatenate(([np.uint32(0)] * 2, c[:-2])) if len(c) > 1 else np.zeros(len(c), np.uint32)
    before2 = np.where(before == 0, 0, before2).astype(np.uint32)
    counts = np.flatnonzero(letter | (before != 0))
    h = before2[counts] * np.uint32(0x9E3779B1) + before[counts] * np.uint32(0x85EBCA77) + c[counts] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    begins = np.flatnonzero(letter & (before == 0))
    ends = np.flatnonzero(~letter & (before != 0))
    first = np.searchsorted(counts, begins)
    text_starts = np.concatenate(([1], 1 + np.cumsum([len(x) + 1 for x in texts])))
    doc = np.searchsorted(text_starts, begins, side="right") - 1
    return bucket, first, t["script"][raw[begins]], ends - begins, doc, begins - text_starts[doc]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bucket x language: log-odds against the mean of all languages
    allowed: np.ndarray  # script x language
    common: int  # the most frequent language
    parts: dict[int, LanguageModel] = field(default_factory=dict)

    def narrowed(self, scripts: int) -> LanguageModel:
        """The model of the languages that use one of these scripts (a bit for each); of all languages, if none does."""
        if scripts not in self.parts:
            fits = np.flatnonzero(self.allowed[[k for k in range(len(SCRIPTS)) if scripts >> k & 1]].any(axis=0))
            if len(fits) in (0, len(self.languages)):
                self.parts[scripts] = self
            else:
                self.parts[scripts] = LanguageModel([self.languages[k] for k in fits], self.weights[:, fits], self.allowed[:, fits], 0)
        return self.parts[scripts]

    def word_scores(self, bucket: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.weights[bucket], first, axis=0)
        fits = self.allowed[script]
        known = fits.any(axis=1)
        scores[~known] = 0
        return np.where(fits | ~known[:, None], scores, np.float32(-1e4))


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language of each word. Words are in text order, and ``doc`` tells their text."""
    n, width = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    size = np.bincount(doc, minlength=n_docs)
    chunks = -(-size // CHUNK)
    if CHUNK * int(chunks.sum()) * width * width > BACK_BYTES:
        return _word_by_word(scores, size, penalty)
    first_chunk = np.concatenate(([0], chunks.cumsum()[:-1]))
    place = np.arange(n) - np.concatenate(([0], size.cumsum()[:-1]))[doc]
    row, col = first_chunk[doc] + place // CHUNK, place % CHUNK
    m = int(chunks.sum())
    s = np.zeros((m, CHUNK, width), np.float32)
    s[row, col] = scores
    change = np.float32(penalty) * (1 - np.eye(width, dtype=np.float32))
    v = s[:, 0, None, :] - change[None]
    back = np.empty((CHUNK, m, width, width), np.int8)
    stay = np.arange(width, dtype=np.int8)
    for t in range(1, CHUNK):
        top = v.argmax(axis=2)
        best = np.take_along_axis(v, top[..., None], 2) - np.float32(penalty)
        moves = best > v
        back[t] = np.where(moves, top[..., None], stay)
        v = np.where(moves, best, v) + s[:, t, None, :]
    # From chunk to chunk of each text.
    entered = np.zeros((m, width), np.int8)
    state = np.zeros((n_docs, width), np.float64)
    most = int(chunks.max())
    for k in range(most):
        d = np.flatnonzero(chunks > k)
        reach = state[d][:, :, None] + v[first_chunk[d] + k]
        entered[first_chunk[d] + k] = reach.argmax(axis=1)
        state[d] = reach.max(axis=1)
    leaves, enters = np.zeros(m, np.int64), np.zeros(m, np.int64)
    at = state.argmax(axis=1)
    for k in range(most - 1, -1, -1):
        d = np.flatnonzero(chunks > k)
        c = first_chunk[d] + k
        leaves[c] = at[d]
        enters[c] = at[d] = entered[c, at[d]]
    label = np.empty((m, CHUNK), np.int64)
    b, r = leaves, np.arange(m)
    for t in range(CHUNK - 1, -1, -1):
        label[:, t] = b
        if t:
            b = back[t][r, enters, b].astype(np.int64)
    return label[row, col]


def _word_by_word(scores: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """The same for many languages: all texts advance by a word at once, with one back pointer for each word and language."""
    first = np.concatenate(([0], size.cumsum()[:-1]))
    width, most = scores.shape[1], int(size.max())
    order = np.argsort(-size, kind="stable")  # longest first, so that the live texts are a prefix
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(most), side="left")  # texts with more than t words
    v = scores[first[: live[0]]].astype(np.float64)
    back = np.empty(scores.shape, np.min_scalar_type(width))
    stay = np.arange(width)
    for t in range(1, most):
        now = v[: live[t]]
        top = now.argmax(axis=1)
        best = now[np.arange(len(now)), top] - penalty
        moves = best[:, None] > now
        back[first[: live[t]] + t] = np.where(moves, top[:, None], stay)
        v[: live[t]] = np.where(moves, best[:, None], now) + scores[first[: live[t]] + t]
    label = np.empty(len(scores), np.int64)
    at = v.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        rows = first[: live[t]] + t
        label[rows] = at[: live[t]]
        if t:
            at[: live[t]] = back[rows, at[: live[t]]]
    return label


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS, key: str = "doc_id") -> LanguageModel:
    """A model from rows with text and non-null lang that are not held out."""
    import pyarrow as pa

    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(key)).select(key, "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), 0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("language"), key), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + len(SCRIPTS)
        counts = np.zeros(len(languages) * width, np.int64)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                bucket, first, script, letters, doc, _ = features(texts[at : at + 64])
                own = np.array([number[x] for x in langs[at : at + 64]])
                if not len(first):
                    continue
                per = np.diff(np.append(first, len(bucket)))
                counts += np.bincount(np.repeat(own[doc], per) * width + bucket, minlength=len(counts))
                counts += np.bincount(own[doc] * width + BUCKETS + script, weights=letters, minlength=len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    summed = sample.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most width rows for a language
    width = BUCKETS + len(SCRIPTS)
    counts = np.zeros(len(languages) * width)
    counts[summed["slot"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(len(languages), width)
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log(grams + 0.5) - np.log(grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    allowed = scripts > 0.001 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    common = max(range(len(languages)), key=lambda k: sizes[languages[k]])
    return LanguageModel(languages, (logs - logs.mean(axis=0)).T.astype(np.float32).copy(), allowed.T.copy(), common)


def label_texts(model: LanguageModel, texts: list[str | None], spans: bool = False) -> tuple[list[str], list[float], list[list[tuple]]]:
    """Language, score and, on request, spans (start, end, language) of each text.

    Texts are taken together by the scripts they hold, and only languages that use one of these are scored and walked.
    """
    names, n = model.languages, len(texts)
    said, value, found = [UNDETERMINED] * n, [0.0] * n, [[] for _ in texts]
    if not names:
        return said, value, found
    bucket, first, script, letters, doc, begin = features([t or "" for t in texts])
    per_word = np.diff(np.append(first, len(bucket)))
    scripts = np.zeros(n, np.int64)
    np.bitwise_or.at(scripts, doc, np.int64(1) << script.astype(np.int64))
    for mask in np.unique(scripts[scripts > 0]).tolist():
        rows = np.flatnonzero(scripts == mask)
        words = np.flatnonzero(scripts[doc] == mask)
        own = model.narrowed(mask)
        grams = bucket if len(words) == len(doc) else bucket[np.repeat(scripts[doc] == mask, per_word)]
        starts = np.concatenate(([0], per_word[words].cumsum()[:-1]))
        scores = own.word_scores(grams, starts, script[words])
        text = np.searchsorted(rows, doc[words])
        width, m = len(own.languages), len(rows)
        label = viterbi(scores, text, m)
        share = np.bincount(text * width + label, weights=letters[words], minlength=m * width).reshape(m, width)
        total = np.stack([np.bincount(text, weights=scores[:, k], minlength=m) for k in range(width)], 1)
        knows = own.allowed[script[words]].any(axis=1)
        if width == len(names):  # of fewer languages, the script has told already
            knows &= np.ptp(scores, axis=1) > 0
        told = np.bincount(text, weights=knows, minlength=m) > 0
        top = share.max(axis=1)
        pick = np.where(share == top[:, None], total, -np.inf).argmax(axis=1)
        common = names[model.common]
        for r, k, t, s in zip(rows.tolist(), pick.tolist(), told.tolist(), (top / share.sum(axis=1)).tolist()):
            said[r], value[r] = (own.languages[k], s) if t else (common, 1.0 / len(names))
        if spans:
            new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
            last = np.append(new[1:], len(text)) - 1
            for a, b in zip(words[new].tolist(), zip(words[last].tolist(), label[new].tolist())):
                found[doc[a]].append((int(begin[a]), int(begin[b[0]] + letters[b[0]]), own.languages[b[1]]))
    return said, value, found


def identify(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None, spans: bool = False, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred, score and, on request, lang_spans in code points; ``prefix`` goes before these names."""
    import pyarrow as pa

    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS rows; languages x 256 KB
    added = [prefix + c for c in ("lang_pred", "score", *["lang_spans"] * spans)]
    names, rows, at_text = carried(documents, keep, added)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]) + f", `{prefix}lang_pred` string, `{prefix}score` double"
    out_schema += f", `{prefix}lang_spans` array<struct<start:int,end:int,lang:string>>" * spans
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", _TABLES.clear)
        own = shared.value
        for part in parts(batches):
            texts = part.column(at_text).to_pylist()
            lang, score, found = [], [], []
            for a, b in blocks(texts, BLOCK_CHARS):
                x, y, z = label_texts(own, texts[a:b], spans)
                lang += x
                score += y
                found += [[dict(zip(("start", "end", "lang"), s)) for s in row] for row in z] if spans else []
            columns = [*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, span_kind)] * spans, names=[*names, *added])

    return rows.mapInArrow(run, out_schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents), keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
