"""Toxicity from class-conditional Kneser-Ney models (operator 2).

Labelled documents give, for the toxic and the ordinary class, the Kneser-Ney
continuation count of each word: the number of distinct words that it follows.
A class's distribution takes ``DISCOUNT`` off its counts and interpolates with a
backoff distribution from the counts of both classes, with the same ``BACKOFF``
mass in either, so that an expression that is rare in both says nothing.

A document is scored by the log-likelihood ratio of its words: what words above
one nat add up to, normalised by the length and by its square root (a short text
needs more evidence).  In these values words that speak for the ordinary class are
counted to one nat only: they tell of topics and copies, and in long texts they
would outweigh any abuse.  A whole model, which the queries use, has a third value
that leaves out no word: what the ratios of all words add up to, to either side,
normalised by the length, which is the difference of both classes' length-normalised
log-likelihoods.  A logistic model on the values gives the score.  It is fitted on a
bounded sample of the labelled documents, whose values come from counts that leave
the sample's texts out.

All labelled documents are counted for the scores, the sample too.  Words are told
apart by 64-bit hashes, and the distinct bigrams and the counts of every word are
Spark tables that grow with the corpus.  What scoring needs of them is the words
above one nat, for a whole model all words whose ratio isn't zero (a word with at
most ``DISCOUNT`` predecessors in either class has none).  Up to ``MAX_EVIDENT`` of these are broadcast, in ascending order of
their hashes; beyond that the documents' distinct words meet them in a shuffled
join, with the same scores.

* null, empty or wordless text: the score of a document without evidence, the
  logistic model's at no evidence
* documents without a label are scored only; of several labels of one id any
  toxic one counts
* repeated rows and ids: one output row for each input row
* no usable labels, or one class only: every score is the share of toxic labels,
  or 0
* an empty table: no rows; very long texts: a batch's words are held as numpy
  arrays of some twenty bytes a word
* columns other than the named ones are not read, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.sources.shared import stored, unused

DISCOUNT = 2.0
BACKOFF = 0.3
#: Nats above which a word counts as evidence.
EVIDENT = 1.0
#: Evident words, or words with a ratio, that are broadcast at most (12 bytes each).
MAX_EVIDENT = 2_000_000
#: One labelled document in CALIBRATE_ONE_IN at most, by its text, fits the logistic model.
CALIBRATE_ONE_IN = 5
#: Labels are broadcast up to here, else joined by a shuffle.
MAX_BROADCAST_LABELS = 2_000_000
#: Documents that the logistic model is fitted on, at most: those with the lowest hash of their id.
MAX_CALIBRATION = 50_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BEGIN = np.uint64(0x5DEECE66D)


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and where each text's words begin and stop."""
    words = _text.Words(_LOWER[data], start, end, ~_LETTERS)
    return words.hashes(), words.begin, words.stop


def _contexts(word: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the word before each word."""
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[begin[begin < len(word)]] = _BEGIN
    return context


def labelled(docs: DataFrame, labels: DataFrame, usable: Column | None, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, text, toxic)`` of documents with a usable label."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= MAX_BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(known, "id")


def bigrams(train: DataFrame) -> DataFrame:
    """``(word, context, toxic, held)``, once for each distinct bigram of a class; ``held`` is 1 if only held texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, held = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in (1, 2))
            for i, _, data, start, end in _text.texts(batch.column(0)):
                word, begin, stop = _words(data, start, end)
                context = _contexts(word, begin)
                marks = np.repeat(2 * toxic[i : i + len(begin)] + held[i : i + len(begin)], stop - begin)
                _, one = np.unique(_text.mix(_text.mix(context) + word * np.uint64(4)) ^ marks.astype(np.uint64), return_index=True)
                # 32 bits of the context: they only tell contexts of one word apart.
                columns = (word[one].view(np.int64), (context[one] >> np.uint64(32)).astype(np.uint32).view(np.int32), marks[one] >> 1, marks[one] & 1)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "context", "toxic", "held"])

    seen = train.select("text", "toxic", F.col("held").cast("int")).mapInArrow(run, "word long, context int, toxic byte, held byte")
    return seen.groupBy("word", "context", "toxic").agg(F.min("held").alias("held"))


def continuations(keys: DataFrame) -> DataFrame:
    """``(toxic, word, types, open)``: distinct contexts of each word in each class, and those in texts that aren't held."""
    return keys.groupBy("toxic", "word").agg(F.count("*").alias("types"), F.count_if(F.col("held") == 0).alias("open"))


def ratios(counts: DataFrame) -> DataFrame:
    """``(word, ratio, ratio_open)`` of every word: its log-likelihood ratio, toxic to ordinary, by all counts and by the open ones."""
    of = lambda c, toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col(c))), F.lit(0)).alias(f"{c}_{toxic}")
    words = counts.groupBy("word").agg(*(of(c, toxic) for c in ("types", "open") for toxic in (0, 1)))
    own = lambda c, toxic: F.greatest(F.col(f"{c}_{toxic}") - DISCOUNT, F.lit(0.0))
    both = lambda c: F.col(f"{c}_0") + F.col(f"{c}_1") + 0.5
    sums = [F.sum(both(c)).alias(f"all_{c}") for c in ("types", "open")] + [F.sum(own(c, toxic)).alias(f"mass_{c}_{toxic}") for c in ("types", "open") for toxic in (0, 1)]

    def log(c: str, toxic: int) -> Column:
        shared, mass = both(c) / F.col(f"all_{c}"), F.col(f"mass_{c}_{toxic}")
        return F.log(F.when(mass > 0, (1 - BACKOFF) * own(c, toxic) / F.greatest(mass, F.lit(1.0)) + BACKOFF * shared).otherwise(shared))

    joined = words.crossJoin(F.broadcast(words.agg(*sums)))
    return joined.select("word", (log("types", 1) - log("types", 0)).alias("ratio"), (log("open", 1) - log("open", 0)).alias("ratio_open"))


@dataclass
class Model:
    """Words that count with their log-likelihood ratios, as a table and, if they are few enough, as arrays; and weights of the features.

    A ``whole`` model has all words with a ratio, else the evident ones.
    """

    table: DataFrame
    word: np.ndarray | None
    ratio: np.ndarray | None
    ratio_open: np.ndarray | None
    weights: np.ndarray
    whole: bool = False

    @classmethod
    def of(cls, counts: DataFrame, max_evident: int = MAX_EVIDENT, whole: bool = False) -> Model:
        """From rows (toxic, word, types, open)."""
        counted = (lambda c: F.col(c) != 0) if whole else (lambda c: F.col(c) > EVIDENT)
        table = stored(ratios(counts).filter(counted("ratio") | counted("ratio_open")), "evident-words")
        none = np.zeros(4 if whole else 3)
        if table.count() > max_evident:
            return cls(table, None, None, None, none, whole)
        rows = table.toArrow()
        word = rows.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        return cls(table, word[order], *(rows.column(c).to_numpy()[order].astype(np.float32) for c in ("ratio", "ratio_open")), none, whole)


def evidence(word: np.ndarray, listed: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats above EVIDENT of each word, and its whole log-likelihood ratio to either side; ``listed`` is in ascending order."""
    if not len(listed):
        return np.zeros(len(word)), np.zeros(len(word))
    at = np.minimum(np.searchsorted(listed, word), len(listed) - 1)
    nats = np.where(listed[at] == word, ratio[at].astype(np.float64), 0.0)
    return np.maximum(nats - EVIDENT, 0), nats


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic model whose classes weigh the same; weights of the columns, then the intercept."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    c = np.where(y == 1, 0.5 * len(y) / max(1, (y == 1).sum()), 0.5 * len(y) / max(1, (y == 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.append(np.full(x.shape[1], ridge), 1e-6)
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (c * (y - p)) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def _schema_of(docs: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}, " for c in columns)


def _featured(docs: DataFrame, model: Model, counts: str, text_col: str, keep_text: bool, evidence_col: str, ratio_col: str, words_col: str) -> DataFrame:
    """The columns of ``docs``, but the text unless it is kept, with each row's evidence in nats, the sum of its words' ratios and its number of words."""
    kept = docs.columns if keep_text else [c for c in docs.columns if c != text_col]
    if model.word is None:
        return _featured_by_join(docs, model, counts, text_col, kept, evidence_col, ratio_col, words_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.word, getattr(model, counts)))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = [[np.zeros(0)], [np.zeros(0)]], [np.zeros(0, np.int64)]
            for _, _, data, start, end in _text.texts(batch.column(text_at)):
                word, begin, stop = _words(data, start, end)
                for found, nats in zip(sums, evidence(word, *shared.value), strict=True):
                    upto = np.concatenate([[0.0], np.cumsum(nats)])
                    found.append(upto[stop] - upto[begin])
                n.append(stop - begin)
            own = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(x)) for x in (*sums, n))], [*kept, evidence_col, ratio_col, words_col])

    return docs.mapInArrow(run, f"{_schema_of(docs, kept)}`{evidence_col}` double, `{ratio_col}` double, `{words_col}` long")


def _featured_by_join(docs: DataFrame, model: Model, counts: str, text_col: str, kept: list[str], evidence_col: str, ratio_col: str, words_col: str) -> DataFrame:
    """The same for any number of words that count: distinct words of each row meet them in a join."""
    (row,) = unused([*docs.columns, evidence_col, ratio_col, words_col], "row")
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, start, end in _text.texts(batch.column(1)):
                word, begin, stop = _words(data, start, end)
                rows = np.empty(len(word), [("row", np.int64), ("word", np.uint64)])
                rows["row"], rows["word"] = np.repeat(batch.column(0).to_numpy()[i : i + len(begin)], stop - begin), word
                rows, times = np.unique(rows, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["row"])), pa.array(np.ascontiguousarray(rows["word"]).view(np.int64)), pa.array(times)], ["row", "word", "times"])

    said = own.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "row long, word long, times long")
    nats = F.coalesce(F.col("nats"), F.lit(0.0))
    found = said.join(model.table.select("word", F.col(counts).cast("float").cast("double").alias("nats")), "word", "left").groupBy("row").agg(
        F.sum(F.greatest(nats - EVIDENT, F.lit(0.0)) * F.col("times")).alias("up"), F.sum(nats * F.col("times")).alias("all"), F.sum("times").alias("n")
    )
    out = own.join(found, own[row] == found["row"], "left")
    return out.select(*(own[f"`{c}`"] for c in kept), *(F.coalesce(found[c], F.lit(0.0)).alias(name) for c, name in (("up", evidence_col), ("all", ratio_col))), F.coalesce(found["n"], F.lit(0)).alias(words_col))


def _features(up: Column, ratio: Column, n: Column, whole: bool) -> list[Column]:
    """Evidence by word, and by the square root of the words; for a whole model also the ratio of all words by word."""
    some = F.greatest(n, F.lit(1))
    return [up / some, up / F.sqrt(some), *([ratio / some] if whole else [])]


def _score(model: Model, up: Column, ratio: Column, n: Column) -> Column:
    x = F.lit(float(model.weights[-1]))
    for value, weight in zip(_features(up, ratio, n, model.whole), model.weights[:-1], strict=True):
        x = x + value * float(weight)
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_evident: int = MAX_EVIDENT, whole: bool = False) -> Model:
    """A model from the labelled documents; ``usable`` is a condition on the label rows' ``id``, and ``whole`` has all words' ratios count."""
    known = labelled(docs, labels, usable, id_col, text_col, label_col)
    # Copies fall on one side, by their text; the more labels there are, the fewer texts are held.
    one_in = max(CALIBRATE_ONE_IN, -(-labels.count() // MAX_CALIBRATION))
    known = known.withColumn("held", F.pmod(F.xxhash64(F.lit("calibrate"), "text"), F.lit(one_in)) == 0)
    model = Model.of(continuations(bigrams(known)), max_evident, whole)
    points = _featured(known.filter("held").select("id", "toxic", "text"), model, "ratio_open", "text", False, "up", "ratio", "n")
    features = {f"x{i}": x for i, x in enumerate(_features(F.col("up"), F.col("ratio"), F.col("n"), whole))}
    points = points.orderBy(F.xxhash64("id"), "id").limit(MAX_CALIBRATION).select("toxic", *(x.alias(c) for c, x in features.items())).toArrow()
    y = points.column("toxic").to_numpy().astype(np.float64)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(np.column_stack([points.column(c).to_numpy() for c in features]), y)
    else:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        model.weights = np.array([*(0.0 for _ in features), np.log(share / (1 - share))])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, up)`` of every row of ``docs``: the score, and the evidence by word."""
    out = _featured(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), model, "ratio", "text", False, "up", "ratio", "n")
    values = F.col("up"), F.col("ratio"), F.col("n")
    return out.select(F.col("id").alias(id_col), _score(model, *values).alias("score"), _features(*values, model.whole)[0].alias("up"))


def score_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``score``; only a column of that name in ``docs`` is replaced."""
    own = docs.drop("score")
    values = unused([*own.columns, "score"], "up", "ratio", "n")
    out = _featured(own, model, "ratio", text_col, True, *values)
    return out.select(*(F.col(f"`{c}`") for c in own.columns), _score(model, *map(F.col, values)).alias("score"))
