"""Toxicity: a weighted grammar of small transducers that scores matched clauses.

Five transducers read each clause: the lexicon, which writes a class for each word (insults, threats, targets,
negations, reports), and four that rewrite classes by what stands near: negation, reported speech, target and
threat. They run composed, as one machine that is built as its states are met. Each arc has a weight, and a path
the sum of its arcs': an insult has one, and being aimed, negated or reported adds what the rewriting is worth. A
clause gets the label of its gravest path (a threat, an insult with or without a target, a negated or a reported
one). A document's score is a logistic function of its clauses' labels and their weights, which are learned from
labelled rows around given priors.

The insult transducer's lexicon comes from labels too: words and word beginnings that significantly many toxic
documents and next to no others have, beside seed words that labels don't speak against. Learning takes at most `sample` labelled rows (the lowest hashes of
doc_id) and only those whose crc32(doc_id as text) mod 5 is not 0.

Defined cases: null and empty texts have no clause and get the score of a document without matches; null
doc_ids are not learned from and come back with held_out null; repeated rows come back each; without labels the
seed words and the priors hold; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import slices, small_batches, table

SEEDS = {
    "insult": "idiot idiots moron morons stupid scum worthless disgusting pathetic loser losers imbecile trash arschloch abschaum connard salaud pendejo imbécil",
    "threat": "kill murder strangle stab umbringen töten tuer égorger matar",
    "target": "you your yours u they them he she him her these those people dich dir euch sie ihr tu te toi vous ils elle usted ustedes ellos vosotros",
    "negation": "not no never neither nor isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun nunca ni tampoco jamás",
    "reported": "said says say called calls wrote claimed claims quoted according reported alleged sagte sagt behauptet laut dit disait selon affirme dijo dice según",
}
LABELS = ("threat", "aimed", "insult", "negated", "reported")
PRIORS = np.array([2.0, 4.0, 3.5, 1.0, 1.0])
BIAS = -3.0
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»]")
_QUOTES = set('"“”«»')
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A letter-to-letter machine with weights: step(state, symbol) gives the next state, what to write, the arc's weight."""

    start: object = 0

    def step(self, state, symbol):
        raise NotImplementedError


class Lexicon(Transducer):
    """Writes a word's class; stems stand for all words that begin so. An insult's arc has its weight."""

    def __init__(self, known: dict[str, str], stems: tuple[str, ...], weight: float = 0.0):
        self.known, self.stems, self.weight = known, stems, weight

    def step(self, state, symbol):
        kind = self.known.get(symbol) or ("reported" if symbol in _QUOTES else "insult" if self.stems and symbol.startswith(self.stems) else "")
        return 0, kind, self.weight if kind == "insult" else 0.0


class Within(Transducer):
    """Rewrites `old` to `new` when `mark` came at most `reach` tokens before, in the same clause."""

    def __init__(self, mark: str, old: str, new: str, reach: int, weight: float = 0.0):
        self.mark, self.old, self.new, self.reach, self.weight = mark, old, new, reach, weight

    def step(self, state, symbol):
        if symbol == self.mark:
            return self.reach, symbol, 0.0
        if symbol == self.old and state:
            return state - 1, self.new, self.weight
        return max(0, state - 1), symbol, 0.0


class Composed(Transducer):
    """Transducers of which each reads what the one before writes; weights add up; transitions are kept as they are met."""

    def __init__(self, *parts: Transducer, most: int = 200_000):
        self.parts, self.start, self.known, self.most = parts, tuple(p.start for p in parts), {}, most

    def step(self, state, symbol):
        if (got := self.known.get((state, symbol))) is None:
            states, out, total = [], symbol, 0.0
            for p, s in zip(self.parts, state, strict=True):
                s, out, weight = p.step(s, out)
                states.append(s)
                total += weight
            if len(self.known) >= self.most:  # a cache of transitions: they are built again when met
                self.known.clear()
            got = self.known[state, symbol] = tuple(states), out, total
        return got


def grammar(known: dict[str, str], stems: tuple[str, ...] = (), weights: np.ndarray | None = None) -> Composed:
    """Negation and reports shield an insult; a target in reach aims it; a threat needs a target after it.

    weights: of LABELS. An arc that rewrites one label to another has the difference of theirs.
    """
    w = dict(zip(LABELS, PRIORS if weights is None else weights, strict=True))
    return Composed(
        Lexicon(known, stems, w["insult"]),
        Within("negation", "insult", "negated", 3, w["negated"] - w["insult"]),
        Within("reported", "insult", "reported_insult", 12, w["reported"] - w["insult"]),
        Within("target", "insult", "aimed", 4, w["aimed"] - w["insult"]),
        Within("threat", "target", "threatened", 3, w["threat"]),
    )


_RESULT = {"threatened": "threat", "aimed": "aimed", "insult": "insult", "negated": "negated", "reported_insult": "reported"}


@dataclass
class Model:
    words: frozenset[str] = frozenset(SEEDS["insult"].split())
    stems: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: PRIORS.copy())
    bias: float = BIAS

    def trigger(self) -> str:
        """For RE2: any text without a match has no clause to score."""
        one = sorted({re.escape(w) for w in [*self.words, *self.stems, *SEEDS["threat"].split()]})
        return "(?i)(?:" + "|".join(one) + ")"

    def classes(self) -> tuple[dict[str, str], tuple[str, ...]]:
        known = {w: kind for kind in ("reported", "negation", "target", "threat") for w in SEEDS[kind].split()}
        return known | dict.fromkeys(self.words, "insult"), self.stems

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.log1p(counts) @ self.weights)))


def clauses(text: str, machine: Composed) -> Iterator[tuple[str, float]]:
    """The label of each clause that has one, and the weight of its path: the gravest label counts."""
    for clause in _CLAUSE.split(text.lower()):
        state, got = machine.start, {}
        for token in _TOKEN.findall(clause):
            state, symbol, weight = machine.step(state, token)
            if symbol in _RESULT:
                got[_RESULT[symbol]] = weight
        for label in LABELS:
            if label in got:
                yield label, got[label]
                break


def _matched(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    """How many clauses of each text got each of LABELS."""
    machine, texts = grammar(*model.classes(), model.weights), batch.column("text")
    counts = np.zeros((len(batch), len(LABELS)))
    hit = pc.fill_null(pc.match_substring_regex(texts, model.trigger()), False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(hit):
        for label, _ in clauses(texts[int(i)].as_py(), machine):
            counts[i, LABELS.index(label)] += 1
    return counts


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _document_features(text: str) -> set[str]:
    """A document's words, with a mark, and their beginnings of four to seven letters."""
    words = {w for w in _TOKEN.findall(text.lower()) if 3 <= len(w) <= 40}
    return {"=" + w for w in words} | {w[:k] for w in words for k in range(4, min(8, len(w)))}


def mine(rows: DataFrame, n_toxic: int, n_clean: int, least: int = 5, purity: float = 0.95) -> tuple[frozenset[str], tuple[str, ...]]:
    """Words and stems of toxic documents, from rows (text, toxic) of a bounded sample.

    In toxic documents a feature counts once for each different word before it, so that a toxic text with many
    copies doesn't lend its other words to the lexicon; in clean ones it counts once a document. A seed insult stays
    a word unless it counts more in clean documents than in toxic ones.
    """
    seeds = {"=" + w for w in SEEDS["insult"].split()}
    if not n_toxic or not n_clean:
        return frozenset(f[1:] for f in seeds), ()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, str]] = set()
            for t in b.column("text").to_pylist():
                before = ""
                for w in _TOKEN.findall((t or "").lower()):
                    if 3 <= len(w) <= 40:
                        seen.add((w, before))
                    before = w
            pairs = {("=" + w, x) for w, x in seen} | {(w[:k], x) for w, x in seen for k in range(4, min(8, len(w)))}
            f, x = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.string()), "before": pa.array(x, pa.string())})

    def clean_counts(wanted: set[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: Counter[str] = Counter()
            for b in batches:
                for t in b.column("text").to_pylist():
                    c.update(_document_features(t or "") & wanted)
            yield pa.RecordBatch.from_pydict({"f": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        return run

    bad_rows = rows.where("toxic = 1").select("text").mapInArrow(contexts, "f string, before string")
    bad_rows = bad_rows.groupBy("f").agg(F.countDistinct("before").alias("n"))
    met = {r.f: r.n for r in bad_rows.where((F.col("n") >= least) | F.col("f").isin(*seeds)).collect()}  # of at most `sample` texts
    bad = {f: n for f, n in met.items() if n >= least}
    clean_rows = rows.where("toxic = 0").select("text").mapInArrow(clean_counts(set(bad) | seeds), "f string, n long")
    clean = {r.f: r.n for r in clean_rows.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    base, enough = n_toxic / (n_toxic + n_clean), np.log(max(len(bad), 2)) + 4
    good: dict[str, int] = {}
    for f, n in bad.items():
        c = clean.get(f, 0)
        p = (n + 0.01) / (n + c + 0.02)
        if p >= purity and n * np.log(p / base) + c * np.log((1 - p) / (1 - base)) >= enough:
            good[f] = n
    stems: list[str] = []
    for f in sorted((x for x in good if x[0] != "="), key=lambda x: (len(x), x)):
        longer = any(y != f and y.startswith(f) and good[y] >= 0.9 * good[f] for y in good) or good.get("=" + f, 0) >= 0.9 * good[f] or any(y.startswith("=" + f) and good[y] >= 0.9 * good[f] for y in good)
        if not longer and not f.startswith(tuple(stems)):
            stems.append(f)
    kept = {f for f in seeds if clean.get(f, 0) <= met.get(f, 0)}
    words = frozenset(f[1:] for f in {*good, *kept} if f[0] == "=" and not f[1:].startswith(tuple(stems) or ("\0",)))
    return words, tuple(stems)


def _regress(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards the priors."""
    z = np.column_stack([np.log1p(x), np.ones(len(x))])
    prior = np.append(PRIORS, BIAS)
    pull = np.append(np.full(len(PRIORS), ridge), 0.01)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), grad)
        w -= np.clip(step, -2, 2)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 30_000) -> Model:
    """Lexicon and weights from at most `sample` labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").persist()  # at most `sample` keys
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model(*mine(rows, sizes.get(1, 0), sizes.get(0, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = Counter(zip(map(tuple, _matched(b, model).astype(int).tolist()), b.column("toxic").to_pylist(), strict=True))
            keys = list(got)
            yield pa.RecordBatch.from_pydict({"x": pa.array([list(k[0]) for k in keys], pa.list_(pa.int32())), "toxic": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([got[k] for k in keys], pa.int64())})

    seen = rows.select("text", "toxic").mapInArrow(run, "x array<int>, toxic int, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).orderBy("x", "toxic").collect()
    rows.unpersist()
    if sizes.get(1, 0) and sizes.get(0, 0):
        n = [r.n for r in seen]
        model.weights, model.bias = _regress(np.repeat(np.array([r.x for r in seen], float), n, axis=0), np.repeat([float(r.toxic) for r in seen], n))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 30_000) -> DataFrame:
    """doc_id, score, predicted and each label's number of clauses, of every document."""
    model = learn(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts = _matched(b, model)
            score = model.score(counts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "score": score, "predicted": pa.array(score >= 0.5).cast(pa.int32())}
                | {f"n_{k}": pa.array(counts[:, i].astype(np.int64)) for i, k in enumerate(LABELS)}
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, " + ", ".join(f"n_{k} long" for k in LABELS))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = 30_000) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.score(_matched(b, model)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted", *(f"n_{k}" for k in LABELS))
