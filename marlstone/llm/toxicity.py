"""Toxicity scores by gradient-boosted trees over dense features.

A lexicon is learned from labelled texts: words, and stems that many words
share. Each text is then described by the densities of lexicon terms, how near
they stand to words that address the reader, and rates of capitals, of
punctuation and of disguised spelling. Boosted trees score these, and isotonic
regression on scores of rows that the trees had not seen makes them
probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import boosting
from marlstone.llm.batches import small_batches
from marlstone.sources import materialize

#: At most so many labelled rows are learned from: those with the least hashes of their ids.
MOST_LABELLED = 12_000
#: A term must follow so many different words in toxic texts: copies of one text show one place only.
LEAST_PLACES = 3
STEMS = (4, 5, 6)
#: Log odds from which a term belongs to the lexicon, and from which it is a strong one.
WEAK, STRONG = 1.5, 3.0
FOLDS = 5

# Words held to be strong where labels say nothing of them.
SEED_TERMS = ("idiot", "idiots", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "idiota", "imbécil", "estúpido", "dumm", "trottel", "abschaum", "connard", "crétin", "débile")
# Words that address the reader.
SECOND_PERSON = ("you", "your", "you're", "youre", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "tus", "vosotros")
# Letters that digits and signs are written for.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")

EDGES = ".,;:!?|\"'()[]{}<>*#$%&-_…«»“”„¡¿=+/~^"
NOT_LETTERS = re.compile(r"[\W_]+")
MIXED = re.compile(r"[^\W\d_][\d@$!*#%]+[^\W\d_]")
#: Words whose codes a worker remembers; when full it begins anew.
REMEMBERED = 200_000

FEATURES = (
    "word_density", "strong_word_density", "stem_density", "strong_stem_density", "strong_hits", "distinct_strong", "top_weight", "weight_sum",
    "nearness", "second_person", "capitals", "punctuation", "exclamations", "disguised", "disguised_hits", "log_words",
)


def bare(token: str) -> str:
    return token.strip(EDGES)


def terms(word: str) -> list[str]:
    """A word and its stems, which end in a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


@dataclass
class Lexicon:
    weights: dict[str, float]

    def code(self, token: str) -> tuple[float, float, float, float]:
        """Of a token in lower case: the weights of its word and of its stems, whether it is disguised, and the weight behind the disguise."""
        word = bare(token)
        found = self.weights.get(word, 0.0)
        stem = max((self.weights.get(t, 0.0) for t in terms(word)[1:]), default=0.0)
        hidden, weight = 0.0, 0.0
        if not word.isalpha() and MIXED.search(token):
            hidden = 1.0
            weight = self.weights.get(NOT_LETTERS.sub("", word.translate(DISGUISE)), 0.0)
        return found, stem, hidden, weight


class Describer:
    """Features of texts, by one lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.codes: dict[str, int] = {}
        self.known: dict[tuple[float, float, float, float], int] = {}
        self.table = np.zeros((0, 4))
        self.address = {w: 1 for w in SECOND_PERSON}

    def _code(self, token: str) -> int:
        made = self.lexicon.code(token)
        if made not in self.known:
            self.known[made] = len(self.known)
            self.table = np.vstack([self.table, made])
        if len(self.codes) >= REMEMBERED:
            self.codes.clear()
        if len(token) <= 64:
            self.codes[token] = self.known[made]
        return self.known[made]

    def __call__(self, text: str | None) -> list[float]:
        """The FEATURES of a whole text; a null text counts as empty."""
        text = text or ""
        tokens = text.lower().split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        get, code = self.codes.get, self._code
        ids = np.array([code(t) if (c := get(t)) is None else c for t in tokens])
        word, stem, hidden, behind = self.table[ids].T
        both = np.maximum(word, stem)
        strong = both >= STRONG
        hits = np.flatnonzero(strong | (behind >= STRONG))
        address = self.address
        second = np.array([i for i, t in enumerate(tokens) if t in address or (t[-1] in EDGES or t[0] in EDGES) and t.strip(EDGES) in address])
        near = 0.0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)]))
            near = float(np.exp(-gap / 5).mean())
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
        marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return [
            float((word >= WEAK).sum() / n),
            float((word >= STRONG).sum() / n),
            float((stem >= WEAK).sum() / n),
            float((stem >= STRONG).sum() / n),
            float(np.log1p(strong.sum())),
            float(np.log1p(len({bare(tokens[i]) for i in np.flatnonzero(strong)}))),
            float(both.max()),
            float(both[both >= WEAK].sum() / np.sqrt(n)),
            near,
            float(len(second) / n),
            float(raw[65:91].sum() / letters),
            float(marks / len(text)),
            float(raw[33] / len(text)),
            float(hidden.sum() / n),
            float((behind >= WEAK).sum() / n),
            float(np.log1p(n)),
        ]


@dataclass
class Model:
    """What scoring needs; its size is bounded by the words of MOST_LABELLED texts, and the trees."""

    lexicon: Lexicon
    trees: boosting.Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.interp(self.trees.raw(x), *self.knots)


def weigh(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon from each term's number of places in toxic texts and of clean texts with it."""
    found = {}
    for term, (t, c) in counts.items():
        if t >= LEAST_PLACES:
            weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
            if weight >= WEAK:
                found[term] = weight
    return Lexicon({t: STRONG for t in SEED_TERMS if t not in counts} | found)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 0 by 5. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, fold (of 2) and part (of FOLDS) of MOST_LABELLED rows at most, written once.

    An id with several labels is toxic if one of them says so. Rows that repeat an id and a text count
    once; of more than MOST_LABELLED, as where ids have many texts, those with the least
    hashes of id and text stay. Folds and parts go by the text, so that equal texts are in the same.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # MOST_LABELLED rows of two numbers bound what is broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumns({"id_hash": F.xxhash64("doc_id"), "text_hash": F.xxhash64("text")})
    # copies of an id and text meet by their hashes, by partial aggregates, and only hashes are sorted
    rows = materialize(rows.groupBy("doc_id", "id_hash", "text_hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-known")
    if rows.count() > MOST_LABELLED:
        kept = rows.select("doc_id", "id_hash", "text_hash").orderBy("id_hash", "text_hash", "doc_id").limit(MOST_LABELLED)
        rows = rows.join(F.broadcast(kept.select("doc_id", "text_hash")), ["doc_id", "text_hash"])  # MOST_LABELLED rows of two numbers
    dealt = lambda k, n: F.pmod(F.xxhash64("text", F.lit(k)), F.lit(n)).cast("int")
    return materialize(rows.select("text", "toxic", dealt(1, 2).alias("fold"), dealt(2, FOLDS).alias("part")), "toxicity-labelled")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of toxic texts: each term with the hash of the word before it, once a text."""
    for batch in batches:
        out: set[tuple[str, str, int]] = set()
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = [bare(t) for t in text.lower().split()]
            for before, word in zip(["", *words], words):  # noqa: B905
                if len(word) > 1:
                    out.update((t, before, fold) for t in terms(word))
            if len(out) > 100_000:
                yield _triples(out)
                out = set()
        yield _triples(out)


def _triples(rows: set[tuple[str, str, int]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"term": pa.array(a, pa.string()), "before": pa.array(b, pa.string()), "fold": pa.array(c, pa.int32())})


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on at most MOST_LABELLED labelled rows that are not held out.

    Two halves of them give a lexicon each, and rows are described to the trees
    by the other half's lexicon, so that no text's own words speak for it;
    scoring uses the lexicon of both. The trees that give the scores for the
    calibration have not seen the rows they score, nor copies of them. Where
    labels are missing or all alike, the model scores every text by the rate of
    toxic labels.

    The driver gets the counts of those terms that LEAST_PLACES places have,
    and MOST_LABELLED rows of numbers.
    """
    small_batches(docs.sparkSession)
    rows = _labelled(docs, labels)
    sizes = {(r.toxic, r.fold): r.n for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n = {t: [sum(v for (x, f), v in sizes.items() if (x > 0) == t and f == k) for k in (0, 1)] for t in (True, False)}
    toxic, clean = sum(n[True]), sum(n[False])
    if not toxic or not clean:
        return Model(Lexicon({}), None, None, toxic / (toxic + clean + 1))

    places = rows.where("toxic > 0").select("text", "fold").mapInArrow(_places, "term string, before string, fold int").distinct()
    by_fold = [F.count(F.when(F.col("fold") == k, 1)).cast("int").alias(f"t{k}") for k in (0, 1)]
    counted = places.groupBy("term").agg(*by_fold).where(F.col("t0") + F.col("t1") >= LEAST_PLACES)
    seen = {r.term: [r.t0, r.t1, 0, 0] for r in counted.collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(seen))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keep = Counter(), wanted.value
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {t for w in {bare(x) for x in text.lower().split()} if len(w) > 1 for t in terms(w)} & keep
                total.update((t, fold) for t in found)
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in total], pa.string()), "fold": pa.array([f for _, f in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    of_clean = rows.where("toxic <= 0").select("text", "fold").mapInArrow(clean_counts, "term string, fold int, n long")
    for r in of_clean.groupBy("term", "fold").agg(F.sum("n").alias("n")).collect():
        seen[r.term][2 + r.fold] += r.n
    halves = [weigh({t: (c[k], c[2 + k]) for t, c in seen.items()}, n[True][k], n[False][k]) for k in (0, 1)]
    whole = weigh({t: (c[0] + c[1], c[2] + c[3]) for t, c in seen.items()}, toxic, clean)
    wanted.unpersist()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Describer(halves[1]), Describer(halves[0])]
        for batch in batches:
            x = [by[f](t) for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(2), "part": batch.column(3), "x": pa.array(x, pa.list_(pa.float64()))})

    table = rows.select("text", "fold", "toxic", "part").mapInArrow(described, "toxic int, part int, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist())
    y = (table.column("toxic").to_numpy() > 0).astype(float)
    part = table.column("part").to_numpy()
    order = np.lexsort([*x.T, y, part])  # whatever order rows came in
    x, y, part = x[order], y[order], part[order]
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        if (part != k).any() and (part == k).any():
            unseen[part == k] = boosting.fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(whole, boosting.fit(x, y), boosting.isotonic(unseen, y), toxic / (toxic + clean))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (id_column unless given), score and predicted of every row: no shuffle, and no row is joined.

    A null text counts as empty; the empty text has the score of its features,
    all 0. predicted is 1 from a score of 0.5 on. Columns of ``docs`` named
    score or predicted are not passed on.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (keep or [id_column]) if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(held.value.lexicon)
        for batch in batches:
            x = np.array([describe(v.as_py()) for v in batch.column(len(kept))], dtype=float).reshape(-1, len(FEATURES))
            s = held.value.scores(x)
            columns = [*batch.columns[: len(kept)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double", "predicted int"])
    return docs.select(*kept, F.col(text).alias("scored_text")).mapInArrow(run, schema)
