"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that labelled toxic texts hold
far more often than labelled clean ones. A text is then described by densities
of lexicon words, plain and after undoing obfuscation, how near they stand to a
word of second person, and rates of capitals, punctuation and obfuscation.

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows
(``Limits.rows``, chosen by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import forget_all_but, in_small_batches, pinned, release, released

FEATURES = (
    "word_density", "stem_density", "obfuscated_density", "strongest", "hits_log", "second_person_rate", "near_second_person",
    "capital_rate", "shouted_rate", "exclamation_rate", "question_rate", "punctuation_rate", "repeated_punctuation_rate",
    "obfuscation_rate", "stretched_rate", "words_log",
)

#: Words of second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros".split()
)
#: Characters that commonly stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>«»„“”…&#|*-_"
_INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
#: Look-alikes and marks between letters, or letters with dots between them; apostrophes and hyphens hide nothing.
_HIDDEN = re.compile(r"(?<=[^\W\d_])[0-9@$!*#+_]+(?=[^\W\d_])|\b(?:[^\W\d_]\.){2,}[^\W\d_]\b")
_MARKS = re.compile(r"[^\w\s]+")
_REPEATED_MARKS = re.compile(r"[!?.]{2,}")
_STRETCHED = re.compile(r"(\w)\1\1")


@dataclass(frozen=True)
class Limits:
    """Bounds of what is fitted: labelled rows, lexicon entries, trees."""

    rows: int = 24_000
    entries: int = 3_000
    least_texts: int = 4
    least_odds: float = 2.5
    trees: int = 20
    depth: int = 3


@dataclass
class Model:
    """A fitted model. ``trees`` is None where the labels hold one class only; then ``rate`` is the score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 0.0
    trees: GBTClassificationModel | None = None
    bounds: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)


def plain_words(text: str) -> list[str]:
    return [w for w in (raw.strip(EDGES) for raw in text.lower().split()) if w]


def undone(word: str) -> str:
    """A word without marks inside it and with look-alike characters replaced."""
    return _INNER.sub("", word).translate(LOOKALIKES)


def entries_of(text: str) -> set[str]:
    """What the lexicon is chosen from: words, and beginnings of 4 to 6 letters marked by a star."""
    out = set()
    for word in set(plain_words(text)):
        out.add(word)
        out.update(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)
    return out


#: What is known of most words: nothing.
NOTHING = (0.0, 0.0, 0.0, False, False, False)


class Describer:
    """Features of one text after another; what is known of a word is remembered."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], kept: int = 200_000):
        self.words, self.stems, self.kept = words, stems, kept
        self.known: dict[str, tuple[float, float, float, bool, bool, bool]] = {}

    def _stem(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in (4, 5, 6)), default=0.0) if len(word) > 4 else 0.0

    def look_up(self, raw: str) -> tuple[float, float, float, bool, bool, bool]:
        """Weights as a word, as a stem, after undoing obfuscation; second person, obfuscated, stretched."""
        word = raw.lower().strip(EDGES)
        plain = undone(word)
        as_word, as_stem = self.words.get(word, 0.0), self._stem(word)
        hidden = 0.0 if plain == word or as_word else max(self.words.get(plain, 0.0), self._stem(plain))
        mixed = bool(_HIDDEN.search(word))
        found = (as_word, as_stem, hidden, word in SECOND_PERSON, mixed, bool(_STRETCHED.search(word)))
        if found == NOTHING:
            found = NOTHING
        if len(self.known) < self.kept and len(raw) <= 40:
            self.known[raw] = found
        return found

    def features(self, text: str) -> list[float]:
        known, look_up = self.known.get, self.look_up
        raws = text.split()
        n = max(1, len(raws))
        word = stem = hidden = mixed = stretched = 0
        strongest, hits, persons = 0.0, [], []
        for at, raw in enumerate(raws):
            found = known(raw) or look_up(raw)
            if found is NOTHING:
                continue
            weight = max(found[:3])
            if weight:
                hits.append(at)
                strongest = max(strongest, weight)
                word += found[0] > 0
                stem += found[1] > 0
                hidden += found[2] > 0
            if found[3]:
                persons.append(at)
            mixed += found[4]
            stretched += found[5]
        chars = max(1, len(text))
        upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
        shouted = sum(1 for raw in raws if len(raw) > 2 and raw.isupper())
        return [
            word / n, stem / n, hidden / n, strongest, math.log1p(len(hits)), len(persons) / n, _near(hits, persons) / n,
            upper / chars, shouted / n, text.count("!") / n, text.count("?") / n, sum(map(len, _MARKS.findall(text))) / chars,
            len(_REPEATED_MARKS.findall(text)) / n, mixed / n, stretched / n, math.log1p(len(raws)),
        ]


def _near(hits: list[int], persons: list[int]) -> int:
    """How many of the hits have a word of second person within NEAR words; both lists ascend."""
    count, at = 0, 0
    for hit in hits:
        while at < len(persons) and persons[at] < hit - NEAR:
            at += 1
        count += at < len(persons) and persons[at] <= hit + NEAR
    return count


def described(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """struct ``row`` of all columns of ``docs`` and array ``features``; only texts go through Python."""
    words, stems = model.words, model.stems

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_all_but()
        own = Describer(words, stems)
        for texts in batches:
            yield pa.array([own.features(text) for text in texts.to_pylist()], pa.list_(pa.float64()))
        del own
        release()

    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    text = F.coalesce(quoted(text_col), F.lit(""))
    return in_small_batches(docs).select(row, features(text).alias("features"))


def _share(id_column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(1_000_003)) / 1_000_003


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> Model:
    """Fit on the labelled rows of ``docs``; ``labels`` has the id and ``toxic`` (0 or 1).

    Rows of ``labels`` with a null id or label are ignored; an id labelled twice
    counts as toxic if one label says so. Of more than ``limits.rows`` labelled
    ids a share is taken by a hash of the id; at most 1.2 times that many get in.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("l_id"))
    marked = marked.agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, limits.rows / max(1, marked.count()))
    chosen = pinned(marked.where(_share(F.col("l_id"), 1) < share).limit(int(limits.rows * 1.2)), "toxicity-chosen")
    texts = docs.select(F.col(id_col).alias("l_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # The chosen ids are at most 1.2 * limits.rows.
    sample = pinned(texts.join(F.broadcast(chosen), "l_id").withColumn("part", _share(F.col("l_id"), 2)), "toxicity-sample")
    sizes = {row.toxic: row.n for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(rate=1.0 if n_toxic else 0.0)
    model = Model(rate=n_toxic / (n_toxic + n_clean))
    # Three parts: one chooses the lexicon, one grows the trees, one calibrates.
    _learn_lexicon(model, sample.where("part < 0.4"), limits)
    rows = sample.where("part >= 0.4").select("l_id", "text", "toxic", "part")
    table = pinned(described(rows, model).select("row.toxic", "row.part", "features"), "toxicity-features")
    data = table.select(F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features"), "part")
    grown, held = data.where("part < 0.75"), data.where("part >= 0.75")
    if grown.select("label").distinct().count() < 2 or held.isEmpty():
        return model
    trees = GBTClassifier(maxIter=limits.trees, maxDepth=limits.depth, stepSize=0.2, minInstancesPerNode=10, seed=7)
    model.trees = trees.fit(grown)
    margin = vector_to_array(F.col("probability"))[1]
    scored = model.trees.transform(held).groupBy(margin.alias("margin"), "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(scored)
    model.bounds, model.values = isotonic.boundaries.toArray().tolist(), isotonic.predictions.toArray().tolist()
    return model


def _learn_lexicon(model: Model, sample: DataFrame, limits: Limits) -> None:
    """The entries with the best smoothed log odds between toxic and clean texts of the sample."""
    kind = "toxic int, entry string"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(entries_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(found, pa.string())], ["toxic", "entry"])

    sizes = {row.toxic: row.n for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counted = (
        sample.select("toxic", "text")
        .mapInArrow(released(entries), kind)
        .groupBy("entry")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    odds = F.log((F.col("bad") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("good") + 0.1) / (n_clean + 0.2))
    best = (
        counted.where(F.col("bad") >= limits.least_texts)
        .withColumn("odds", odds)
        .where(F.col("odds") >= limits.least_odds)
        .orderBy(F.desc(F.col("odds") * F.log1p("bad")), "entry")
        .limit(limits.entries)
        .collect()
    )
    for row in best:
        if row.entry.endswith("*"):
            model.stems[row.entry[:-1]] = row.odds
        else:
            model.words[row.entry] = row.odds


def calibrated(margin: Column, model: Model) -> Column:
    """Isotonic value of a margin, linear between the bounds; the margin itself breaks ties in the last thousandth."""
    bounds = F.array(*[F.lit(b) for b in model.bounds])
    values = F.array(*[F.lit(v) for v in model.values])
    upto = F.size(F.filter(bounds, lambda b: b <= margin))
    last = len(model.bounds)
    x0, y0 = F.get(bounds, upto - 1), F.get(values, upto - 1)
    x1, y1 = F.get(bounds, upto), F.get(values, upto)
    between = y0 + (y1 - y0) * (margin - x0) / (x1 - x0)
    step = F.when(upto == 0, model.values[0]).when(upto == last, model.values[-1]).otherwise(between)
    return 0.999 * step + 0.001 * margin


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """struct ``row`` of all columns of ``docs``, ``score`` from 0 to 1 and ``predicted`` (1 from 0.5 on), row by row.

    Null texts count as empty; empty texts get the score of their (all but zero) features.
    """
    rows = described(docs, model, text_col)
    if model.trees is None:
        out = rows.withColumn("score", F.lit(float(model.rate)))
    else:
        predicted = model.trees.transform(rows.withColumn("features", array_to_vector("features")))
        out = predicted.withColumn("score", calibrated(vector_to_array(F.col("probability"))[1], model))
    return out.select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model fitted on their labels doesn't call toxic."""
    return scored(docs, fit(docs, labels, id_col, text_col), text_col).where("predicted = 0").select("row.*")
