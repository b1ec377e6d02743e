"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers read a clause word by word and are composed into one: insults and whether they are aimed (a
target near before or after them), threats (a deed and then, near, whom it is done to), negation of what follows near
it, and reported speech. Arcs carry weights: an insult's is learned (a word, or word stem, that labelled documents
show to be toxic, by the lower bound of its log-odds), a threat's is fixed. What the composition accepts are patterns,
in order and within REACH words: an insult, an aimed insult or a threat, each asserted, negated or reported. A clause
counts in each kind with its heaviest match; words outside an accepted pattern count nothing. What the kinds count
for is a logistic fit on other labelled documents.

Target, threat, negation and report words are short fixed lists. Learned from a bounded sample
(labelled.MAX_TRAINING_DOCS documents), two thirds for arcs and one third for weights; texts are read whole. No input
but the text. No shuffle but that of the training counts.

Defined cases: null and empty texts get the score of a text without matches; very long texts are scored whole, a step
of theirs at a time; no labels: no arc, score by base rate; a tie at the threshold is predicted 1; repeated rows get
equal rows, and teach once; an empty table gives none; columns of any name stay, as rows are carried as one struct.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.llm.common import map_texts, small_batches, steps, table, text_buffers, written
from stateroll.llm.labelled import held_out, logistic, probability, sample
from stateroll.llm.textarrays import hashes, member, spans

FOLDS, FOLD, THRESHOLD = 3, 1, 0.7
#: Documents with an arc, log-odds above which it is one, and arcs in all.
SUPPORT, LEAST_ODDS, MAX_ARCS = 3, 1.5, 20_000
#: Bytes of a stem.
STEMS = range(3, 11)

# Words of the grammar that aren't learned, in English, French, German and Spanish.
THREATS = "kill hurt destroy murder stab burn beat tuer détruire frapper töten umbringen schlagen vernichten matar golpear destruir quemar"
TARGETS = "you your yours yourself they them he she him her tu toi vous votre eux ils elle du dich dir ihr euch sie tú usted ustedes ellos ella vosotros"
NEGATIONS = "not no never nobody nothing ne pas jamais personne nicht kein keine nie niemand nunca jamás nadie"
REPORTS = "said says say wrote writes quoted quote called reported claimed dit disait écrit cité sagte sagt schrieb zitierte dijo dice escribió citó"

#: Symbols of a clause; FAR stands for a gap of more than REACH other words.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, FAR = range(7)
REACH = 4
#: Bytes of words (letters and all that isn't ASCII), and those that end a clause.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[list(b".!?;:\n")] = True


#: What an arc gives out: an insult's match, that it is aimed, that the last match proves aimed, a threat's match, and what turns a match around.
HIT, AIMED, AIM, THREATENED, NOT, SAID = 1, 2, 4, 8, 16, 32


class Transducer:
    """Deterministic: state -> symbol -> (state, output). What isn't in the table stays and gives nothing out."""

    def __init__(self, moves: dict[tuple, dict[int, tuple[tuple, int]]], start: tuple = (0,)) -> None:
        self.moves, self.start = moves, start

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        return self.moves.get(state, {}).get(symbol, (state, 0))

    def compose(self, other: Transducer) -> Transducer:
        """Both at once; a state is both states, an output both outputs. Only states that can be reached."""
        start = self.start + other.start
        cut = len(self.start)
        moves: dict[tuple, dict[int, tuple[tuple, int]]] = {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state not in moves:
                moves[state] = {}
                for s in range(7):
                    (one, gives), (two, gives_too) = self.step(state[:cut], s), other.step(state[cut:], s)
                    moves[state][s] = one + two, gives | gives_too
                    todo.append(one + two)
        return Transducer(moves, start)


#: Insults: 1, a target is near; 2, an insult is near that isn't aimed; 3, one that is.
INSULTED = Transducer({
    (0,): {TARGET: ((1,), 0), INSULT: ((2,), HIT)}, (1,): {FAR: ((0,), 0), INSULT: ((3,), HIT | AIMED)},
    (2,): {FAR: ((0,), 0), TARGET: ((1,), AIM), INSULT: ((2,), HIT)}, (3,): {FAR: ((0,), 0), TARGET: ((1,), 0), INSULT: ((3,), HIT | AIMED)},
})
#: A threat is the deed and then, near, whom it is done to.
THREATENING = Transducer({(0,): {THREAT: ((1,), 0)}, (1,): {TARGET: ((0,), THREATENED), FAR: ((0,), 0)}})
#: A negation holds for what follows near it, a report for the rest of the clause.
NEGATED = Transducer({(0,): {NEGATION: ((1,), 0)}, (1,): {FAR: ((0,), 0), INSULT: ((1,), NOT), TARGET: ((1,), NOT)}})
REPORTED = Transducer({(0,): {REPORT: ((1,), 0)}, (1,): {INSULT: ((1,), SAID), TARGET: ((1,), SAID)}})
GRAMMAR = INSULTED.compose(THREATENING).compose(NEGATED).compose(REPORTED)

#: Kinds of matches: insult, aimed insult and threat; each asserted, negated or reported.
PLAIN, DIRECTED, THREATS_MADE = 0, 3, 6
KINDS = 9
ASSERTED = [PLAIN, DIRECTED, THREATS_MADE]
#: The weight of a threat's match, which labels don't teach.
THREAT_WEIGHT = 3.0
FEATURES = 8 + KINDS


def matches(words: list[tuple[int, float, bool]]) -> list[tuple[int, float]]:
    """Of a clause's words (symbol, weight, whether a gap is before it): kind and weight of each accepted pattern."""
    state, out = GRAMMAR.start, []
    for symbol, weight, far in words:
        if far:
            state = GRAMMAR.moves[state][FAR][0]
        state, gives = GRAMMAR.moves[state][symbol]
        if gives:
            turned = 1 if gives & NOT else 2 if gives & SAID else 0
            if gives & HIT:
                out.append(((DIRECTED if gives & AIMED else PLAIN) + turned, weight))
            if gives & AIM:
                for k in range(len(out) - 1, -1, -1):
                    if out[k][0] < DIRECTED:
                        out[k] = out[k][0] + DIRECTED, out[k][1]
                        break
            if gives & THREATENED:
                out.append((THREATS_MADE + turned, THREAT_WEIGHT))
    return out


def _word_hashes(words: str) -> np.ndarray:
    raw = [w.encode() for w in words.split()]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


FIXED = [(kind, _word_hashes(w)) for kind, w in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))]
#: Tells a stem from the whole word of the same bytes.
STEM = np.uint64(0x5851F42D4C957F2D)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)


def arcs_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of words that can have an arc, and its hash: the whole word, then its stems."""
    size = end - begin
    k = np.flatnonzero(size >= STEMS.start)
    yield k, hashes(data, begin[k], end[k])
    for n in STEMS:
        k = k[size[k] > n]
        yield k, hashes(data, begin[k], begin[k] + n) ^ STEM


class Matcher:
    def __init__(self, arcs: np.ndarray, weights: np.ndarray) -> None:
        """arcs: sorted hashes."""
        self.arcs, self.weights = arcs, weights

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        low = lowered(texts)
        lengths = np.array(pc.binary_length(low), np.int64)
        for a, b in steps(lengths):
            self._fill(*text_buffers(low.slice(a, b - a)), out[a:b])
        return out

    def _fill(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
        begin, end = spans(LETTER[data], offsets)
        if not len(begin):
            return
        doc = np.searchsorted(offsets, begin, "right") - 1
        n_words = np.bincount(doc, minlength=len(out))
        weight = np.zeros(len(begin))
        for k, h in arcs_of(data, begin, end):
            at = member(h, self.arcs)
            hit = at >= 0
            np.maximum.at(weight, k[hit], self.weights[at[hit]])
        ends = CLAUSE_END[data]
        clause = np.cumsum(ends)[begin] + np.searchsorted(offsets, begin, "right")  # a text's end ends a clause, too
        threat = member(hashes(data, begin, end), FIXED[0][1]) >= 0
        core = np.flatnonzero((weight > 0) | threat)
        found: list[tuple[int, int, int, float]] = []
        if len(core):
            held = np.unique(clause[core])
            own = np.flatnonzero(member(clause, held) >= 0)  # the words of clauses with an insult or threat
            symbol = np.zeros(len(own), np.int64)
            h = hashes(data, begin[own], end[own])
            for kind, words in FIXED:
                symbol[member(h, words) >= 0] = kind
            symbol[weight[own] > 0] = INSULT
            own, symbol = own[symbol > 0], symbol[symbol > 0]
            far = np.r_[False, np.diff(own) > REACH + 1]
            rows = zip(clause[own].tolist(), doc[own].tolist(), symbol.tolist(), weight[own].tolist(), far.tolist(), strict=True)
            for n, ((_, row), words) in enumerate(itertools.groupby(rows, key=lambda x: x[:2])):
                found += [(n, row, kind, w) for kind, w in matches([x[2:] for x in words])]
        self._sum(out, n_words, found)

    @staticmethod
    def _sum(out: np.ndarray, n_words: np.ndarray, found: list[tuple[int, int, int, float]]) -> None:
        """A clause counts in each kind with the heaviest match that it has of it."""
        n = len(out)
        by_kind, heaviest, above = np.zeros((n, KINDS)), np.zeros(n), np.zeros((n, 3))
        if found:
            clause, row, kind, weight = (np.array(c) for c in zip(*found, strict=True))
            order = np.lexsort((-weight, kind, clause))
            clause, row, kind, weight = clause[order], row[order], kind[order], weight[order]
            first = np.r_[True, (clause[1:] != clause[:-1]) | (kind[1:] != kind[:-1])]
            row, kind, weight = row[first], kind[first], weight[first]
            np.add.at(by_kind, (row, kind), weight)
            told = np.isin(kind, ASSERTED)
            np.maximum.at(heaviest, row[told], weight[told])
            for k, least in enumerate((2, 3, 4)):
                np.add.at(above[:, k], row[told & (weight > least)], 1)
        sums = by_kind[:, ASSERTED].sum(1)
        out[:, 1] = heaviest
        out[:, 2] = np.log1p(sums)
        out[:, 3:6] = np.log1p(above)
        out[:, 6] = sums / np.sqrt(n_words + 5)
        out[:, 7] = np.log1p(n_words) / 5
        out[:, 8:] = np.log1p(by_kind)


def _arc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, label, part): how many documents have each arc, and how many toxic ones, summed over a step of texts."""
    for b in batches:
        labels = b.column("label").to_numpy()
        low = lowered(b.column("text"))
        for s, e in steps(np.array(pc.binary_length(low), np.int64)):
            found, toxic = [], []
            data, offsets = text_buffers(low.slice(s, e - s))
            begin, end = spans(LETTER[data], offsets)
            doc = np.searchsorted(offsets, begin, "right") - 1
            for k, h in arcs_of(data, begin, end):
                order = np.lexsort((h, doc[k]))
                d, h = doc[k][order], h[order]
                first = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                found.append(h[first])
                toxic.append(labels[s:e][d[first]])
            arcs, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(arcs.view(np.int64)), pa.array(np.bincount(at, np.concatenate(toxic), len(arcs)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(arcs)).astype(np.int64))], names=["arc", "toxic", "n"])


class Model:
    def __init__(self, matcher: Matcher, weights: np.ndarray) -> None:
        self.matcher, self.weights = matcher, weights

    def score(self, texts: pa.Array) -> np.ndarray:
        return probability(self.matcher.features(texts) @ self.weights)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = FOLD) -> Model:
    small_batches(docs.sparkSession)
    known = written(sample(docs, labels, label_col, folds, fold, id_col, text_col))
    classes = known.where("part > 0").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    counts = known.where("part > 0").mapInArrow(_arc_counts, "arc long, toxic long, n long").groupBy("arc").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("toxic") >= SUPPORT)
    toxic, clean = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    odds = F.ln(toxic / (classes[0] + 1)) - F.ln(clean / (classes[1] + 1)) - F.sqrt(1 / toxic + 1 / clean)
    top = counts.select("arc", odds.alias("odds")).where(F.col("odds") > LEAST_ODDS).orderBy(F.desc("odds"), "arc").limit(MAX_ARCS).toPandas()
    arcs = top["arc"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(arcs)
    matcher = Matcher(arcs[order], top["odds"].to_numpy(np.float64)[order])
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = known.where("part = 0").mapInArrow(features, "label int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, FEATURES))
    return Model(matcher, logistic(x, rows["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str = "id") -> DataFrame:
    """A row a document: its id (or, with keep='row', all columns as the struct `row`), score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(_, texts: pa.Array) -> dict:
            s = shared.value.score(texts)
            return {"score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))}

        return run

    got = map_texts(docs, id_col, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
    return got if keep == "row" else got.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, as they are."""
    return score(docs, model, id_col, text_col, "row").where("predicted = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
