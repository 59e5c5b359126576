"""Toxicity by weak supervision.

Many voters look at a text: word lists, patterns, and lists induced from the labelled training
rows. A generative label model holds, for each class, how often a voter votes for, against or
not at all, and the correlations between voters given the class; a voter that repeats what
others say counts for less. It is fitted by expectation maximisation over the vote patterns of
all documents, with known training labels held fixed. A linear (logistic) classifier over listed
words and over words and stems that mark training labels is trained on the posterior labels of a
bounded sample (``SAMPLE``) of the distinct texts outside the held-out fold, weighted by their rows.

Null and empty texts hold no word and get the score of the classifier's constant. Rows without
a label, or with one other than 0 and 1, take part as unlabelled. Where no row is labelled or
all labels are equal, the word lists and patterns alone lead. Very long texts are scored whole.
Repeated rows are scored alike; an empty table gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, full_text, in_fold
from themeloom.llm.features import PerChunk, class_counts, sigmoid, stems, tokens, word_features
from themeloom.session import materialise

BITS = 20
INDUCED = 512  # features in the induced lists of GROUPS voters
GROUPS = 4
LEAST_LOW = 1.8  # lower bound of the log odds ratio of an induced feature
ROUNDS = 12
UNLABELLED = 0.1  # weight of a row without a label beside one with a label, where there are any
SELECTED = 1_024  # features of the classifier, besides the listed words
SAMPLE = 20_000  # distinct texts, those with the smallest hashes, that the classifier is fitted to
FOLDS, HELD_OUT = 5, 0

# Word lists of the voters.
LISTS = {
    "insult": "idiot idiots moron morons imbecile fool fools loser losers clown clowns jerk dimwit dunce halfwit",
    "contempt": "pathetic worthless disgusting useless scum trash garbage filth vermin parasite disgrace",
    "belittling": "stupid dumb ignorant brainless ridiculous lazy ugly retarded",
    "profanity": "damn shit crap bastard bitch asshole fuck fucking fucker dickhead bullshit",
    "hostility": "hate kill die hurt destroy shut despise punch",
    "spanish": "idiota idiotas estúpido estúpida imbécil basura inútil patético asqueroso payaso escoria mierda",
    "french": "idiot idiote imbécile stupide ordure inutile pathétique dégoûtant crétin connard merde racaille",
    "german": "idiot dumm dummkopf trottel abschaum wertlos erbärmlich ekelhaft arschloch scheiße versager",
}
WORDS = {name: frozenset(text.split()) for name, text in LISTS.items()}
EVERY = frozenset().union(*WORDS.values()) - WORDS["hostility"]
IN_LISTS = frozenset().union(*WORDS.values())
ADDRESS = frozenset("you your you're u ur tú tu eres vous du dich".split())
DISGUISED = re.compile(r"[a-z]+[0-9@$!|]+[a-z]+|[0-9@$]+[a-z]{2,}")
PLAIN = str.maketrans("013457@$!|", "oieastasil")
STRETCHED = re.compile(r"([a-z])\1{2,}")

VOTERS = [*WORDS, "several", "dense", "addressed", "disguised", "stretched", "shouted", "none_listed", "none_induced"] + [
    f"induced{g}" for g in range(GROUPS)
]


class Voters:
    """Votes of all voters on a text; ``induced`` are the groups of induced features."""

    def __init__(self, induced: list[list[int]]):
        self.induced = induced
        self.group = {f: g for g, some in enumerate(induced) for f in some}
        self.marks = PerChunk(self._mark)

    def __reduce__(self):
        return Voters, (self.induced,)

    def _mark(self, chunk: str) -> tuple | None:
        """What a chunk adds: lists it is in, listed words, disguise, stretch, address, induced groups."""
        found = tokens(chunk)
        lists = () if IN_LISTS.isdisjoint(found) else tuple(i for i, words in enumerate(WORDS.values()) if not words.isdisjoint(found))
        listed = tuple(w for w in found if w in EVERY) if lists else ()
        # Letters alone hide nothing.
        hidden = not chunk.isalpha() and any(w.translate(PLAIN) in EVERY for w in DISGUISED.findall(chunk))
        drawn = STRETCHED.search(chunk) is not None and any(STRETCHED.sub(r"\1", w) in EVERY for w in found if w not in EVERY)
        address = not ADDRESS.isdisjoint(found) or chunk in ADDRESS
        marked = [f for w in found for f in word_features(w, BITS) if f in self.group] if self.group else ()
        groups = tuple({self.group[f] for f in marked}) if marked else ()
        mark = (lists, listed, hidden, drawn, address, groups)
        return mark if any(mark) else None

    def __call__(self, text: str) -> bytes:
        """A byte a voter: 2 for toxic, 0 for clean, 1 for no vote."""
        chunks = set(text.lower().split())
        marks = self.marks.of(chunks)
        marks.discard(None)
        lists = {i for m in marks for i in m[0]}
        listed = {w for m in marks for w in m[1]}
        hidden, drawn, address = (any(m[k] for m in marks) for k in (2, 3, 4))
        groups = {g for m in marks for g in m[5]}
        cast = [i in lists for i in range(len(WORDS))]
        cast += [len(listed) >= 2, bool(listed) and len(listed) * 50 >= len(chunks), bool(listed) and address]
        cast += [hidden, drawn, bool(listed) and text.isupper()]
        clean = [not (listed or hidden or drawn), bool(self.group) and not groups]
        cast_by = [g in groups for g in range(GROUPS)]
        return bytes([*(2 if c else 1 for c in cast), *(0 if c else 1 for c in clean), *(2 if c else 1 for c in cast_by)])


def marking(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How features mark toxic training rows ``(text, weight)``.

    ``(counts, low, strength)``: rows that hold a feature, a lower bound of its log odds ratio, and
    the size of that ratio against its error. All zero where one class is missing.
    """
    toxic, clean = class_counts(rows, BITS, stems)
    total = rows.agg(F.sum("weight").alias("one"), F.count("*").alias("n")).head()
    n1 = total["one"] or 0.0
    n0 = (total["n"] or 0) - n1
    if not n1 or not n0:
        return np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    cells = [toxic + 0.5, n1 - toxic + 0.5, clean + 0.5, n0 - clean + 0.5]
    odds, error = np.log(cells[0] * cells[3] / (cells[1] * cells[2])), np.sqrt(sum(1 / c for c in cells))
    return toxic + clean, np.where(toxic >= 3, odds - 2 * error, -1.0), np.abs(odds) / error


def induced_lists(low: np.ndarray) -> list[list[int]]:
    """The features that mark toxic rows most surely; the surest to the first induced voter, and so on."""
    best = np.argsort(-low, kind="stable")[:INDUCED]
    each = INDUCED // GROUPS
    return [[f for f in best[g * each : (g + 1) * each].tolist() if low[f] > LEAST_LOW] for g in range(GROUPS)]


class LabelModel:
    """Class share, vote tables ``(voter, vote, class)`` and correlations of voters given the class.

    A voter that doesn't vote says nothing; one that votes counts for less the more the other
    voters of the same row repeat it.
    """

    def __init__(self):
        m = len(VOTERS)
        self.share = 0.1
        self.table = np.full((m, 3, 2), 1 / 3)
        self.table[:, 2, 1], self.table[:, 1, 1], self.table[:, 0, 1] = 0.3, 0.6, 0.1
        self.table[:, 2, 0], self.table[:, 1, 0], self.table[:, 0, 0] = 0.05, 0.65, 0.3
        self.correlation = np.zeros((m, m))

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Of each row of votes (0, 1, 2)."""
        odds = np.log(self.table[:, :, 1] / self.table[:, :, 0])
        cast = (pattern != 1).astype(float)
        repeats = np.maximum(self.correlation - np.diag(np.diag(self.correlation)), 0.0)
        each = cast * odds[np.arange(len(VOTERS)), pattern] / (1.0 + cast @ repeats)
        return sigmoid(np.log(self.share / (1 - self.share)) + each.sum(1))

    def fit(self, patterns: DataFrame) -> LabelModel:
        """``patterns(votes, label, n)``: how many rows vote so; ``label`` is null where unknown."""
        m = len(VOTERS)
        classes = patterns.filter("label is not null").select("label").distinct().count()
        unknown = UNLABELLED if classes == 2 else 1.0

        def moments(model: LabelModel):
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums = np.zeros((2, 1 + 3 * m + m * m))
                for batch in batches:
                    votes = np.frombuffer(b"".join(batch.column("votes").to_pylist()), np.uint8).reshape(-1, m).astype(np.int64)
                    p = model.posterior(votes)
                    label = np.array([np.nan if x is None else x for x in batch.column("label").to_pylist()], float)
                    p = np.where(np.isnan(label), p, label)
                    n = batch.column("n").to_numpy().astype(float) * np.where(np.isnan(label), unknown, 1.0)
                    signed = votes - 1.0
                    for c, w in enumerate((n * (1 - p), n * p)):
                        sums[c, 0] += w.sum()
                        for v in range(3):
                            sums[c, 1 + v * m : 1 + (v + 1) * m] += w @ (votes == v)
                        sums[c, 1 + 3 * m :] += ((signed * w[:, None]).T @ signed).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "value"])

            got = patterns.mapInArrow(add, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
            flat = np.zeros(2 * (1 + 3 * m + m * m))
            flat[got.column("at").to_numpy()] = got.column("value").to_numpy()
            return flat.reshape(2, -1)

        for _ in range(ROUNDS):
            sums = moments(self)
            total = sums[:, 0]
            before = self.table
            self.share = float(np.clip((total[1] + 1) / (total.sum() + 10), 1e-4, 0.9))
            counts = sums[:, 1 : 1 + 3 * m].reshape(2, 3, m)
            # A few votes of the opening guess keep tables open where nothing was seen.
            self.table = np.stack([(counts[c].T + 2 * LabelModel.opening[:, :, c]) / (total[c] + 2) for c in (0, 1)], 2)
            self.correlation = np.zeros((m, m))
            for c in (0, 1):
                mean = (counts[c, 2] - counts[c, 0]) / max(total[c], 1.0)
                square = (counts[c, 2] + counts[c, 0]) / max(total[c], 1.0)
                spread = np.sqrt(np.maximum(square - mean**2, 1e-12))
                inner = sums[c, 1 + 3 * m :].reshape(m, m) / max(total[c], 1.0) - np.outer(mean, mean)
                known = np.outer(spread > 1e-4, spread > 1e-4)
                self.correlation += 0.5 * np.where(known, inner / np.outer(spread, spread), 0.0)
            if np.abs(self.table - before).max() < 1e-4:
                break
        return self


LabelModel.opening = LabelModel().table.copy()


def known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)`` outside the held-out fold; of several labels, toxic leads."""
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", FOLDS, HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def label_model(rows: DataFrame, known: DataFrame, voters: Voters) -> LabelModel:
    """The label model fitted to the votes on all ``rows(doc_id, text)``."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [voters(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cast, pa.binary())], ["doc_id", "votes"])

    voted = rows.mapInArrow(vote, "doc_id bigint, votes binary").join(known, "doc_id", "left")
    return LabelModel().fit(materialise(voted.groupBy("votes", "label").agg(F.count("*").alias("n")), "patterns"))


class Classifier:
    """``score(text)``: at most SELECTED + listed weights and a constant."""

    def __init__(self, weights: dict[int, float], constant: float):
        self.weights, self.constant = weights, constant
        self.held = PerChunk(lambda chunk: tuple(f for w in tokens(chunk) for f in word_features(w, BITS) if f in weights) or None)

    def __reduce__(self):
        return Classifier, (self.weights, self.constant)

    def features(self, text: str) -> list[int]:
        found = self.held.of(text.lower().split())
        found.discard(None)
        return sorted({f for some in found for f in some})

    def score(self, text: str) -> float:
        return float(sigmoid(sum(map(self.weights.__getitem__, self.features(text))) + self.constant))


def sampled(rows: DataFrame, known: DataFrame, wanted: int) -> DataFrame:
    """``(text, n, marked, toxic)``: the ``wanted`` distinct texts of ``rows(doc_id, text)`` with the smallest hashes.

    ``n`` rows have the text; ``marked`` of them have a label, ``toxic`` the label 1.
    """
    keyed = rows.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"), F.xxhash64("text", F.lit(13)).alias("mix"))
    sums = [F.count("*").alias("n"), F.count("label").alias("marked"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")]
    texts = keyed.join(known, "doc_id", "left").groupBy("digest", "mix").agg(*sums)
    chosen = materialise(texts.orderBy("mix", "digest").limit(wanted).drop("mix"), "sample", wanted)
    # Copies of a text are joined in their task first, so only one a task is moved.
    found = rows.select("text", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest")).join(F.broadcast(chosen), "digest")
    return found.groupBy("digest", "n", "marked", "toxic").agg(F.first("text").alias("text")).drop("digest")


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier of ``docs(doc_id, text)``, trained outside the held-out fold."""
    rows = docs.select("doc_id", full_text("text").alias("text"))
    known = materialise(known_labels(labels), "known")
    # Labels are of the training fold, so only its texts are moved, and at every size in the same way.
    training = rows.filter(~in_fold("doc_id", FOLDS, HELD_OUT)).join(known.hint("merge"), "doc_id")
    counts, low, strength = marking(training.select("text", F.col("label").cast("double").alias("weight")))
    voters = Voters(induced_lists(low))
    model = label_model(rows, known, voters)
    best = np.argsort(-strength, kind="stable")[:SELECTED]
    chosen = sorted({*best[counts[best] > 0].tolist(), *(f for w in EVERY for f in word_features(w, BITS))})

    open_rows = rows.filter(~in_fold("doc_id", FOLDS, HELD_OUT))
    n = open_rows.count()
    prior = float(np.log(model.share / (1 - model.share)))
    if not n:
        return Classifier({}, prior)
    sample = sampled(open_rows, known, SAMPLE)
    empty = Classifier(dict.fromkeys(chosen, 0.0), prior)

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            cast = np.frombuffer(b"".join(map(voters, texts)), np.uint8).reshape(len(texts), -1)
            p = model.posterior(cast.astype(np.int64))
            n, marked, toxic = (batch.column(c).to_numpy().astype(float) for c in ("n", "marked", "toxic"))
            yes = 0.01 * marked + 0.98 * toxic + (n - marked) * p
            words = [[str(f) for f in empty.features(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(yes), pa.array(n - yes)], ["words", "yes", "no"])

    small = materialise(sample.mapInArrow(example, "words array<string>, yes double, no double"), "examples")
    vocabulary = CountVectorizerModel.from_vocabulary([str(f) for f in chosen], inputCol="words", outputCol="features")
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("share")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("share"))))
    examples = vocabulary.transform(small).select("features", sides.alias("side")).select("features", "side.label", "side.share").filter("share > 0.001")
    linear = LogisticRegression(weightCol="share", regParam=1e-4, maxIter=60, standardization=False).fit(examples)
    return Classifier(dict(zip(chosen, linear.coefficients.toArray().tolist())), float(linear.intercept))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for some in texts:
            yield some.map(lambda t: model.score(t or "") if isinstance(t, str) else model.score("")).astype(float)

    return docs.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
