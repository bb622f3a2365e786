"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.calibrate import fit_logistic, probability
from ledgerloom.llm.shared import durable, held_out
from ledgerloom.llm.textkit import LETTERS, Words, byte_class, hash_words, word_hashes, words

THRESHOLD = 0.3
#: At most so many labelled texts of each class are learned from, none longer than LONGEST bytes; half find stems, half calibrate.
TOXIC_SAMPLE, CLEAN_SAMPLE, LONGEST = 1500, 2500, 65_536
#: A stem has so many letters, stands in so many toxic sample texts (other than copies and near copies), has at least this smoothed log-odds weight and this likelihood ratio
#: statistic (24: chance in 1 of 1 000 000, as about 100 000 stems are tried); at most MOST_STEMS are kept, the heaviest first.
STEM_LETTERS, STEM_TEXTS, STEM_WEIGHT, STEM_RATIO, MOST_STEMS = (4, 5, 6, 7, 8), 3, 3.0, 24.0, 2000
#: A fixed insult weighs so much; the calibration starts from so many toxic texts with one fixed insult, which outweigh labels only where those are few.
INSULT_WEIGHT, START_TEXTS = 4.3, 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = range(6)
STOPS = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))

# Closed-class words of the grammar, in English, French, German and Spanish.
THREATS = "kill hurt destroy beat stab shoot crush burn tuer frapper détruire brûler töten schlagen vernichten verbrennen matar golpear destruir quemar".split()
# Beginnings of insults; a final ``=`` asks for the whole word.
INSULTS = """idiot moron stupid imbecile pathetic worthless disgusting scum= scumbag loser= losers= trash= clown= clowns= fool= fools= jerk= jerks= bastard asshole bitch dumbass dickhead shithead
    crétin connard connasse salaud salope abruti= abrutis= abrutie débile imbécile ordure= enculé minable=
    arschloch dummkopf trottel schwachkopf wichser hurensohn vollidiot abschaum drecksack miststück versager
    imbécil estúpid gilipollas cabrón= cabrones= pendejo pendeja mierda= inútil= asqueros""".split()
TARGETS = "you your yours he she they them him her these those people tu toi vous ton votre ils elles lui du dich dein ihr euch sie tú ti usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nobody nothing without isn aren wasn don ne pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás ningún sin".split()
REPORTS = "said says say called calls wrote writes claimed quoted alleged dit disait appelé écrit sagte sagt nannte schrieb dijo dice llamó escribió".split()


@dataclass(frozen=True)
class Transducer:
    """Reads symbols, multiplies weights: arcs[state, symbol] = (next state, factor); a missing arc keeps the state at factor 1."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, 1.0))

    def states(self):
        return {self.start} | {s for s, _ in self.arcs} | {t for t, _ in self.arcs.values()}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines read the same symbols; states pair up and factors multiply."""
    arcs = {}
    for x in a.states():
        for y in b.states():
            for s in SYMBOLS:
                (nx, fx), (ny, fy) = a.step(x, s), b.step(y, s)
                if (nx, ny) != (x, y) or fx * fy != 1.0:
                    arcs[(x, y), s] = ((nx, ny), fx * fy)
    return Transducer((a.start, b.start), arcs)


def _negation(reach: int = 3, factor: float = 0.2) -> Transducer:
    """A negation holds for the next ``reach`` words; what it covers counts little."""
    arcs = {(n, NEGATION): (reach, 1.0) for n in range(reach + 1)}
    for n in range(1, reach + 1):
        arcs |= {(n, s): (n - 1, factor if s in (INSULT, THREAT) else 1.0) for s in SYMBOLS if s != NEGATION}
    return Transducer(0, arcs)


def _reported(factor: float = 0.5) -> Transducer:
    """After a verb of saying the rest of the clause is another's speech."""
    return Transducer(0, {(0, REPORT): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor)})


def _target(factor: float = 1.5) -> Transducer:
    """Aimed at somebody named earlier in the clause, an insult weighs more."""
    return Transducer(0, {(0, TARGET): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor)})


def _insult() -> Transducer:
    """Insults pile up: a second one in the clause weighs more."""
    return Transducer(0, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.2)})


def _threat() -> Transducer:
    """A threat counts only with a target before it or beside an insult."""
    return Transducer(0, {(0, TARGET): (1, 1.0), (0, INSULT): (1, 1.0), (0, THREAT): (0, 0.0)})


def grammar() -> Transducer:
    machine = _insult()
    for part in (_threat(), _target(), _negation(), _reported()):
        machine = compose(machine, part)
    return machine


def clause_score(machine: Transducer, clause: list[tuple[int, float]]) -> float:
    """Sum of the symbols' weights times the factors on the clause's one path."""
    state, total = machine.start, 0.0
    for symbol, weight in clause:
        state, factor = machine.step(state, symbol)
        total += weight * factor
    return total


@dataclass
class Lexicon:
    """Stems and weights, looked up by hashes of word beginnings (a final ``=`` asks for the whole word)."""

    stems: dict[str, float]

    def __post_init__(self) -> None:
        self.tables: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]] = []
        groups: dict[tuple[int, bool], list[tuple[str, float]]] = {}
        for s, x in self.stems.items():
            whole = s.endswith("=")
            groups.setdefault((len(s.removesuffix("=").encode()), whole), []).append((s.removesuffix("="), x))
        for (length, whole), entries in groups.items():
            h = hash_words([s for s, _ in entries])
            order = np.argsort(h)
            likely = np.zeros(1 << 16, dtype=bool)
            likely[h & np.uint64(0xFFFF)] = True
            self.tables.append((length, whole, h[order], np.array([x for _, x in entries])[order], likely))

    def weights(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        """The heaviest matching stem's weight for each word, else 0."""
        out = np.zeros(len(hashes))
        size = w.end - w.start
        for length, whole, known, weight, likely in self.tables:
            at = np.flatnonzero(size == length if whole else size >= length)
            if len(at):
                h = hashes[at] if whole else word_hashes(Words(w.first, w.rows, w.buffer, w.raw, w.start[at], w.start[at] + length, w.row[at]))
                some = np.flatnonzero(likely[h & np.uint64(0xFFFF)])
                place = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
                hit = known[place] == h[some]
                some, place = some[hit], place[hit]
                out[at[some]] = np.maximum(out[at[some]], weight[place])
        return out


def text_scores(column: pa.Array, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """(sum of clause scores, number of scored clauses) of each whole text."""
    out = np.zeros((len(column), 2))
    lists = {c: set(hash_words(x).tolist()) for c, x in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))}
    threats = np.sort(hash_words(THREATS))
    likely = np.zeros(1 << 16, dtype=bool)
    likely[threats & np.uint64(0xFFFF)] = True
    for w in words(column, LETTERS):
        h = word_hashes(w)
        if not len(h):
            continue
        weight = lexicon.weights(w, h)
        some = np.flatnonzero(likely[h & np.uint64(0xFFFF)])
        danger = some[np.isin(h[some], threats)]
        ends = np.cumsum(STOPS[w.buffer])
        clause = ends[w.start] + w.row  # both only grow, so equal numbers are one clause of one text
        first = np.searchsorted(clause, clause, "left")
        for a in np.unique(first[np.concatenate([np.flatnonzero(weight), danger])]).tolist():
            z = int(np.searchsorted(clause, clause[a], "right"))
            symbols = []
            for i, x in zip(range(a, z), h[a:z].tolist()):
                kind = INSULT if weight[i] else next((c for c, s in lists.items() if x in s), OTHER)
                symbols.append((kind, weight[i] if kind == INSULT else 2.0 if kind == THREAT else 0.0))
            got = clause_score(machine, symbols)
            if got:
                out[w.first + w.row[a]] += (got, 1)
    return out


def _features(scores: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(scores[:, 0]), np.minimum(scores[:, 0], 4.0)])


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray


def _scored(docs: DataFrame, stems: dict[str, float], out: str, finish) -> DataFrame:
    """Last column is the text; the others are carried."""
    carried = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(stems), grammar()
        for b in batches:
            got = finish(text_scores(b.column(len(carried)), lexicon, machine))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, got)], names=[*carried, *[x.split()[0] for x in out.split(", ")]])

    return docs.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in docs.dtypes[:-1]), out]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Stems with weights, and a calibration, learned from labelled rows that are not held out.

    The insult lexicon starts from INSULTS. Word beginnings of a few lengths are counted by text and class over one half of a sample of bounded size (rows with the
    smallest hash); those that are far likelier in toxic texts, beyond chance for so many texts, join it, each form covered by its shortest stem.
    The other half calibrates. With few labels, or none, the fixed words and a start of the calibration are what is left.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    order = F.xxhash64(F.lit("toxicity"), "_id")
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = known.where("y = 1").orderBy(order, "_id").limit(TOXIC_SAMPLE).unionAll(known.where("y = 0").orderBy(order, "_id").limit(CLEAN_SAMPLE))
    plain = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sample = docs.select(F.col(id_col).alias("_id"), plain.alias("t")).join(F.broadcast(picked), "_id").where(F.octet_length("t") <= LONGEST)
    sample = durable(sample.select("_id", "y", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)).alias("half"), "t"))

    one = sample.where("half = 0")
    one = one.groupBy("y", F.xxhash64("t")).agg(F.first("t").alias("t"))  # copies of a text are no support
    one = durable(one.select("y", F.monotonically_increasing_id().alias("row"), "t"))  # numbered before words are listed: support counts texts, not words
    sizes = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    listed = F.split("t", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ways = [F.concat("word", F.lit("="))] + [F.when(F.length("word") >= n, F.left("word", F.lit(n))) for n in STEM_LETTERS]
    of_word = lambda df, *more: df.where("length(word) >= 3").select("row", *more, F.explode(F.array(*ways)).alias("stem")).where("stem IS NOT NULL")
    stem = of_word(one.select("y", "row", F.explode(F.array_distinct(listed)).alias("word")), "y").distinct()
    counted = stem.groupBy("stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1.0))
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    every = F.col("toxic") + F.col("clean")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), every * rate) + part(F.col("clean"), every * (1 - rate)))
    telling = (F.col("toxic") >= STEM_TEXTS) & (odds >= STEM_WEIGHT) & (ratio >= STEM_RATIO)
    likely = durable(counted.where(telling))
    # A text and its near copies have a stem behind the same word; they count once.
    placed = one.where("y = 1").select("row", listed.alias("w")).select("row", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("behind")))).alias("p"))
    placed = of_word(placed.select("row", "p.*"), "behind").join(F.broadcast(likely.select("stem")), "stem")
    apart = placed.groupBy("stem", "row").agg(F.min("behind").alias("behind")).groupBy("stem").agg(F.count_distinct("behind").alias("apart"))
    heavy = likely.join(apart, "stem").withColumn("toxic", F.least("toxic", "apart")).where(telling).withColumn("odds", odds).orderBy(F.desc("odds"), "stem").limit(MOST_STEMS)
    stems = dict.fromkeys(INSULTS, INSULT_WEIGHT)
    for r in sorted(heavy.collect(), key=lambda r: (len(r.stem), r.stem)):
        if any(x.startswith(r.stem.removesuffix("=")) for x in INSULTS):
            continue  # the fixed form is the more exact one
        if not any(r.stem.startswith(r.stem[:n]) and r.stem[:n] in stems for n in range(3, len(r.stem))):
            stems[r.stem] = max(float(r.odds), stems.get(r.stem, 0.0))

    rest = _scored(sample.where("half = 1").select("y", "t"), stems, "score double, clauses double", lambda s: s.T).collect()
    y = np.array([r.y for r in rest], dtype=float)
    if len(set(y)) < 2:
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 10.0)
        return Model(stems, np.array([math.log(prior / (1 - prior)), 1.0, 1.0]))
    x = _features(np.array([[r.score, r.clauses] for r in rest]))
    share = {c: totals[c] / (y == c).sum() for c in (0, 1)}
    times = np.maximum(1, np.round(10 * np.where(y == 1, share[1], share[0]) / max(share.values()))).astype(int)
    times = np.append(times, START_TEXTS * times[y == 1].max())
    x, y = np.vstack([x, _features(np.array([[INSULT_WEIGHT, 1.0]]))]), np.append(y, 1.0)
    return Model(stems, fit_logistic(np.repeat(x, times, axis=0), np.repeat(y, times)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses, weight) for every row of ``docs``; nothing but the text enters the score.

    A text is cut into clauses; in each, stems, threats, targets, negations and verbs of saying are read by the composed grammar, and only the matched
    clauses' weights are summed and calibrated. Null and empty texts get the score of a text without matches; repeated rows each get a row; an empty table gives none.
    """
    weights = model.weights
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    scored = _scored(rows, model.stems, "score double, clauses long, weight double", lambda s: (probability(weights, _features(s)), s[:, 1].astype(np.int64), s[:, 0]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses", "weight")
