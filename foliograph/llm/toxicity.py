"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause are read as classes: insult, threat, target (a person addressed or meant), negation, reported speech, break,
other. Five small transducers read the same classes. Two emit weights: an insult its own, a threat a little at once and the
rest when a target stands in its clause, in front of it or behind. Three emit factors: a target raises, a negation in the few
words before or reported speech in front lowers. They are composed once into one machine, and a clause's score is the sum of
what it emits. A text's score is a logistic function of its strongest clause and of all clauses together.

Insults are learned from a bounded sample of labelled rows, about TRAIN_DOCS texts of each class, held-out rows excluded:
words, and beginnings of words (stems), that occur in toxic texts far more often than in others, by log-likelihood ratio.
Exact copies and most near copies count once. Stems also match words that the sample doesn't have.

Defined cases: a null or empty text, and one without a match, has the score of no match; without labelled toxic rows the
grammar has threats alone and fixed coefficients; whole texts are read, clause by clause; several labels of an id: the highest
counts; repeated rows give repeated results; an empty table gives no rows; result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import carried, claim, held_out, materialise, parts, table

#: Texts of each class, about, that are learned from.
TRAIN_DOCS = 6000
MIN_RATIO, MIN_WORD, MIN_STEM = 22.0, 2.0, 2.5
#: A stem of which one word makes up more than this share says no more than the word.
ONE_WORD = 0.7
STEM_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
TARGETS = "you your yours u he she they him her them his their people all everyone tu te toi vous votre vos il elle ils elles du dich dir ihr euch sie er tú usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't ne pas jamais aucun sans nicht nie kein keine niemals nunca jamás ningún sin".split()
REPORTS = "said says say wrote writes quoted quote reported called claims claimed dit disait écrit cité sagte sagt schrieb zitierte dijo dice escribió citó".split()
THREATS = "kill hurt destroy shoot stab beat tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class Transducer:
    """Reads classes; ``steps[state, class]`` is the next state and the factor or weight that is emitted. A missing step stays and emits the default."""

    steps: dict[tuple[int, int], tuple[int, float]]
    default: float = 1.0

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.steps.get((state, kind), (state, self.default))


def grammar() -> tuple[list[Transducer], list[Transducer]]:
    """What emits weights (insult, threat) and what emits factors (target, negation, reported speech)."""
    near, at_once = 3, 0.2  # words that a negation reaches; the share of a threat's weight that needs no target
    rest = (INSULT, THREAT, TARGET)
    negation = {(s, NEGATION): (near, 1.0) for s in range(near + 1)}
    negation |= {(s, k): (s - 1, 0.6 if k in rest else 1.0) for s in range(1, near + 1) for k in (*rest, REPORT, OTHER)}
    threat = {  # states: nothing, a threat that waits for its target, a target
        (0, THREAT): (1, at_once * THREAT_WEIGHT),
        (1, THREAT): (1, at_once * THREAT_WEIGHT),
        (0, TARGET): (2, 0.0),
        (1, TARGET): (2, (1 - at_once) * THREAT_WEIGHT),
        (2, THREAT): (2, THREAT_WEIGHT),
    }
    weights = [Transducer({(0, INSULT): (0, 1.0)}, default=0.0), Transducer(threat, default=0.0)]
    factors = [
        Transducer({(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.25)}),
        Transducer(negation),
        Transducer({(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.8), (1, THREAT): (1, 0.8), (1, TARGET): (1, 0.8)}),
    ]
    return weights, factors


def compose(weights: list[Transducer], factors: list[Transducer]) -> dict[tuple[int, int], tuple[int, tuple[float, ...]]]:
    """One machine: states are tuples of states; a step emits each weight times all factors."""
    machines = [*weights, *factors]
    numbers, waiting, table_ = {(0,) * len(machines): 0}, [(0,) * len(machines)], {}
    while waiting:
        state = waiting.pop()
        for kind in range(OTHER + 1):
            moves = [m.step(s, kind) for m, s in zip(machines, state)]
            target = tuple(t for t, _ in moves)
            if target not in numbers:
                numbers[target] = len(numbers)
                waiting.append(target)
            factor = math.prod(w for _, w in moves[len(weights) :])
            table_[numbers[state], kind] = numbers[target], tuple(w * factor for _, w in moves[: len(weights)])
    return table_


WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
def lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-4.0, 0.8, 0.8)

    def machine(self) -> Machine:
        return Machine(self)


class Machine:
    """The composed grammar and the automaton that finds the clauses worth reading."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model = model
        self.steps = compose(*grammar())
        self.kinds = {w: k for ws, k in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in ws}
        self.spot = ahocorasick.Automaton()
        for term in {*model.words, *model.stems, *THREATS}:
            self.spot.add_word(term, len(term))
        self.spot.make_automaton()

    def weight(self, word: str) -> float:
        """A word's odds; those of its longest stem, which more texts support, go first."""
        stems = self.model.stems
        for n in reversed(STEM_LENGTHS):
            if len(word) > n and word[:n] in stems:
                return stems[word[:n]]
        return self.model.words.get(word, 0.0)

    def clause(self, text: str) -> tuple[float, int]:
        """Score and number of insults and threats of one clause, in lower case."""
        state, score, found = 0, 0.0, 0
        for word in WORD.findall(text):
            w = self.weight(word)
            kind = INSULT if w > 0 else self.kinds.get(word, OTHER)
            state, (insult, threat) = self.steps[state, kind]
            score += w * insult + threat
            found += kind in (INSULT, THREAT)
        return score, found

    def matches(self, text: str | None) -> list[tuple[int, int, float]]:
        """Clauses with a score: start, end, score."""
        low = lowered(text or "")
        out, done = [], -1
        for end, n in self.spot.iter(low):
            begin = end - n + 1
            if begin <= done or begin and low[begin - 1].isalpha():
                continue
            start = max(low.rfind(c, 0, begin) for c in ".!?;:\n") + 1
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            score, found = self.clause(low[start:done])
            if found and score > 0:
                out.append((start, done, score))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        scores = [s for _, _, s in self.matches(text)]
        return (max(scores) / 10, sum(scores) / 10) if scores else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        b, c, d = self.model.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + c * x + d * y))))


def _signature(text: str, seed: int) -> int:
    """The least hash of the text's runs of five words: near copies mostly share it."""
    import zlib

    words = text.split()
    return min((zlib.crc32(" ".join(words[k : k + 5]).encode("utf-8", "surrogatepass"), seed) for k in range(max(1, len(words) - 4))), default=0)


def training_sample(documents: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """text and toxic of about ``train_docs`` labelled texts of each class, without exact and most near copies."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = F.when(F.col("toxic") == 1, min(1.0, train_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, train_docs / max(1, sizes.get(0, 0))))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & ~held_out())
    # The chosen ids are bounded by train_docs, so this side may go to every executor.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [pa.array([_signature(t, seed) for t in texts], pa.int64()) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=["doc_id", "text", "toxic", "a", "b"])

    signed = rows.mapInArrow(sign, "doc_id bigint, text string, toxic int, a bigint, b bigint")
    # Of copies the toxic one is learned from, then the one of the least hash and id: the same in every run.
    for by, other in (("a", "b"), ("b", "a")):
        first = F.struct(-F.col("toxic"), F.xxhash64("text"), "doc_id")
        signed = signed.groupBy(by).agg(F.min_by(F.struct("doc_id", "text", "toxic", other), first).alias("r")).select(by, "r.*")
    return materialise(signed.select("text", "toxic"), "toxicity-sample")


def learn(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    import pyarrow as pa

    sample = training_sample(documents, labels, train_docs)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                counts[toxic].update(words)
                counts[toxic].update({w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n})
        for toxic, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.keys(), pa.string()), pa.array([toxic] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], names=["term", "toxic", "n"]
            )

    seen = sample.mapInArrow(terms, "term string, toxic int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("k1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("k0")
    )
    odds = F.log((F.col("k1") + 0.5) / (n1 + 1)) - F.log((F.col("k0") + 0.5) / (n0 + 1))
    part = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (n1 + n0) / ((F.col("k1") + F.col("k0")) * n))).otherwise(0.0)
    ratio = 2 * (part("k1", n1) + part("k0", n0))
    # A rare word that only toxic texts have is mostly chance: the ratio asks for more, the more even the classes are.
    chosen = seen.select("term", "k1", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("ratio") >= MIN_RATIO) & (F.col("odds") >= MIN_WORD))
    rows = chosen.orderBy("term").collect()  # terms of a bounded sample that pass the test
    words = {r["term"]: r["odds"] for r in rows if not r["term"].endswith("*")}
    most = Counter()
    for r in rows:
        if not r["term"].endswith("*"):
            for n in STEM_LENGTHS:
                stem = r["term"][:n]
                most[stem] = max(most[stem], r["k1"])
    stems = {r["term"][:-1]: r["odds"] for r in rows if r["term"].endswith("*") and r["odds"] >= MIN_STEM and most[r["term"][:-1]] <= ONE_WORD * r["k1"]}
    model = ToxicityModel(words, stems)
    shared = sample.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        machine = shared.value.machine()
        for batch in batches:
            got = [machine.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got]), pa.array([y for _, y in got]), batch.column(1)], names=["x", "y", "toxic"])

    points = sample.mapInArrow(measure, "x double, y double, toxic int").toPandas().sort_values(["x", "y", "toxic"])  # two numbers for each text of the sample
    model.coefficients = fit(points["x"].to_numpy(), points["y"].to_numpy(), points["toxic"].to_numpy())
    return model


def fit(x: np.ndarray, y: np.ndarray, toxic: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic coefficients, none of the two slopes below 0."""
    a = np.stack([np.ones(len(x)), x, y], 1)
    weight = np.ones(len(x))
    use = [0, 1, 2]
    while True:
        b, own = np.zeros(len(use)), a[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ b, -30, 30)))
            penalty = ridge * np.array([0.01] + [1.0] * (len(use) - 1))
            gradient = own.T @ (weight * (toxic - p)) - penalty * b
            hessian = (own * (weight * p * (1 - p))[:, None]).T @ own + np.diag(penalty)
            move = np.linalg.solve(hessian, gradient)
            b += move
            if np.abs(move).max() < 1e-9:
                break
        if len(use) == 3 and (b[1:] < 0).any():
            use = [0, 1 if b[1] > b[2] else 2]
            continue
        out = [0.0, 0.0, 0.0]
        for k, v in zip(use, b):
            out[k] = float(v) if k == 0 else max(0.0, float(v))
        return tuple(out)


def score(documents: DataFrame, model: ToxicityModel, keep: list[str] | None = None, clauses: bool = False, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all by default) with ``score``, ``predicted`` and, on request, the matched ``clauses``; ``prefix`` goes before these names."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample
    added = [prefix + c for c in ("score", "predicted", *["clauses"] * clauses)]
    names, rows, at_text = carried(documents, keep, added)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    schema += f", `{prefix}score` double, `{prefix}predicted` int" + f", `{prefix}clauses` array<struct<start:int,end:int,score:double>>" * clauses
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        machine = shared.value.machine()
        for part in parts(batches):
            texts = part.column(at_text).to_pylist()
            got = [machine.score(t) for t in texts]
            columns = [*part.columns[: len(names)], pa.array(got, pa.float64()), pa.array([int(v >= THRESHOLD) for v in got], pa.int32())]
            if clauses:
                columns.append(pa.array([[dict(zip(("start", "end", "score"), m)) for m in machine.matches(t)] for t in texts], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return rows.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
