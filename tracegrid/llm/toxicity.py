"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is counted over the distinct lines of labelled rows, so that copies count once;
the features are its densities, how close its words stand to second-person words, and the rates of capitals,
punctuation and obfuscated words. A labelled row's lines are taken out of the lexicon's counts before it is scored for
training, so the trees see what a new text would show them.
Trees and calibration learn from different rows, and neither sees ids, languages, sources or labels of a text.

Learning uses rows whose crc32(doc_id) mod 3 is not 1, at most about ``TRAIN_ROWS`` different ones by hash, whatever
the number of copies or of texts under one id.

Defined results: null and empty texts have zero features and get a score as any other; repeated rows score alike;
without labelled rows of both classes every score is the share of toxic lines (0 if there are none); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows used for learning, about; terms of the lexicon at most; standard errors that a term must stand above chance.
TRAIN_ROWS, LEXICON, SURE = 20_000, 20_000, 2.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
NEAR = 5
FEATURES = ["word_density", "word_max", "word_kinds", "start_density", "start_max", "near_you", "capitals", "shouts", "punctuation", "obfuscated", "log_words"]

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus".split())
#: Characters written for letters.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[^\w]|_")
_ODD = re.compile(r"[^\W\d_].*[\d@$*|!_].*[^\W\d_]|[^\W\d_][.\-*_][^\W\d_][.\-*_][^\W\d_]")


def plain(token: str) -> str:
    """A lower-case token without punctuation and with letters in place of look-alikes."""
    token = _EDGE.sub("", token)
    return token if token.isalpha() else _INNER.sub("", token.translate(_LEET))


def terms(token: str) -> list[str]:
    """The word and, marked by their length, its beginnings of 4 and 5 letters."""
    return [token, *(f"{n}{token[:n]}" for n in (4, 5) if len(token) > n)] if token else []


def line_terms(line: str) -> set[str]:
    return {t for token in set(line.lower().split()) for t in terms(plain(token))}


def weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """By how much the log odds of a line with the term exceed those of any line, at the lower end of Wilson's
    interval of ``SURE`` standard errors."""
    n, z2 = toxic + clean, SURE * SURE
    share = (toxic + z2 / 2 - SURE * math.sqrt(toxic * clean / n + z2 / 4)) / (n + z2) if n else 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share)) + math.log((all_clean + 1) / (all_toxic + 1))


class Lexicon:
    """Counts of toxic and clean lines by term."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.seen: dict[str, tuple[float, float]] = {}

    def weights(self, token: str, label: int | None = None, own: Counter | None = None) -> tuple[float, float]:
        """The weights above 0 of the token's word and of its best beginning, without the row's own lines."""
        if own is None and (known := self.seen.get(token)) is not None:
            return known
        found = [0.0, 0.0]
        for i, term in enumerate(terms(plain(token))):
            if pair := self.counts.get(term):
                toxic, clean = (max(0, n - own[term] * (label == y)) if own else n for n, y in zip(pair, (1, 0)))
                w = weight(toxic, clean, self.toxic, self.clean) if toxic else 0.0
                found[i > 0] = max(found[i > 0], w)
        if own is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = (found[0], found[1])
        return found[0], found[1]

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        text = text or ""
        tokens = text.lower().split()
        counts = Counter(tokens)
        own = None if label is None else Counter(t for line in set(text.split("\n")) for t in line_terms(line))
        n, chars = max(1, len(tokens)), max(1, len(text))
        word = start = word_max = start_max = 0.0
        kinds, odd, hits = 0, 0, set()
        for token, times in counts.items():
            w, s = self.weights(token, label, own)
            if w > 0:
                word, word_max, kinds = word + w * times, max(word_max, w), kinds + 1
            if s > 0:
                start, start_max = start + s * times, max(start_max, s)
            if w > 0 or s > 0:
                hits.add(token)
            if not token.isalpha() and _ODD.search(token):
                odd += times
        near = 0.0
        if hits:
            places = [i for i, t in enumerate(tokens) if t in hits]
            persons = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
            covered = {i + d for i in persons for d in range(-NEAR, NEAR + 1)}
            near = sum(i in covered for i in places) / len(places)
        letters = text.translate(_COUNTED)
        return [word / n, word_max, float(min(kinds, 20)), start / n, start_max, near, sum(map(str.isupper, letters)) / chars if not letters.islower() else 0.0, (text.count("!") + text.count("?")) / chars, sum(text.count(c) for c in ".,;:") / chars, odd / n, math.log1p(len(tokens))]


#: ASCII characters that are no capitals are left out before capitals are counted.
_COUNTED = {i: None for i in range(128) if not 65 <= i <= 90}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` different labelled rows at most, none of them held out.

    Copies count once, and rows are drawn by a hash of id and text, so that many texts under one id keep to the bound.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = known.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # hashes first: texts of rows that are not drawn are never shuffled
    rows = docs.select("doc_id", drawn.alias("draw"), F.xxhash64("text", F.lit(5)).alias("name"), "text")
    if n > bound:  # ids by the share that the bound allows them, which leaves about ``bound`` rows if ids are not repeated
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    rows = rows.join(known, "doc_id")
    held = rows.select("doc_id", "draw", "name").distinct().count()
    if held > bound:
        rows = rows.filter(F.col("draw") < int(bound / held * (1 << 30)))
    return rows.groupBy("doc_id", "draw", "name").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[label].update(line_terms(text))
        names = list(total[0].keys() | total[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[1][x] for x in names], pa.int64()), pa.array([total[0][x] for x in names], pa.int64())], names=["term", "toxic", "clean"])


def learned_lexicon(rows: DataFrame) -> Lexicon:
    lines = rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"), "label").distinct()
    sums = lines.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(sums.t), int(sums.n - sums.t)
    if not toxic or not clean:
        return Lexicon({}, toxic, clean)
    counted = lines.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = counted.filter((F.col("toxic") >= 2) & (F.col("toxic") * (clean + 1) > 2 * (F.col("clean") + 0.2) * (toxic + 1)))
    best = telling.orderBy(F.col("toxic").desc(), "term").limit(LEXICON).collect()  # bounded
    return Lexicon({r.term: (r.toxic, r.clean) for r in best}, toxic, clean)


class ToxicityModel:
    """A lexicon, trees over its features and their calibration; ``trees`` is None where nothing could be learned."""

    def __init__(self, lexicon: Lexicon, trees=None, curve=None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def scored(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` (0 to 1)."""
        if self.trees is None:
            total = self.lexicon.toxic + self.lexicon.clean
            return docs.withColumn("score", F.lit(self.lexicon.toxic / total if total else 0.0))  # a share of lines
        lexicon = docs.sparkSession.sparkContext.broadcast(self.lexicon)  # at most LEXICON terms

        @F.pandas_udf("array<double>")
        def features_of(texts: pd.Series) -> pd.Series:
            return pd.Series([lexicon.value.features(t) for t in texts], dtype=object)

        seen = docs.withColumn("_features", array_to_vector(features_of(text)))
        seen = self.trees.transform(seen).withColumn("_raw", vector_to_array("_chance")[1])
        # the trees' own chance breaks the ties of the curve's steps
        score = 0.98 * F.col("_curve") + 0.02 * F.col("_raw")
        return self.curve.transform(seen).withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).select(*(F.col(f"`{c}`") for c in docs.columns), "score")


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> ToxicityModel:
    rows = cut(training_rows(docs, labels, bound), "training")
    lexicon = learned_lexicon(rows)
    if not lexicon.toxic or not lexicon.clean:
        return ToxicityModel(lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def features_of(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(t, int(y)) for t, y in zip(texts, known)], dtype=object)

    # one part of bounded size, in a fixed order: runs agree
    seen = cut(rows.select("doc_id", F.col("label").cast("double").alias("label"), features_of("text", "label").alias("f")), "features").orderBy("doc_id").coalesce(1).select("label", array_to_vector("f").alias("_features"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) < 7).alias("grow"))
    grow, curve = seen.filter("grow"), seen.filter("NOT grow")
    if grow.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_tree", maxIter=12, maxDepth=3, maxBins=256, stepSize=0.3, seed=7).setProbabilityCol("_chance").setRawPredictionCol("_margin").fit(grow)
    told = trees.transform(curve if curve.select("label").distinct().count() == 2 else seen).withColumn("_raw", vector_to_array("_chance")[1])
    return ToxicityModel(lexicon, trees, IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_curve").fit(told))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = fit(docs, labels).scored(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns as they are."""
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("_text"))
    return fit(docs, labels).scored(held, "_text").filter(F.col("score") < THRESHOLD).select("row.*")
