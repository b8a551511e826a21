"""Topic classification: multinomial Naive Bayes as aggregations and one join.

The model is two tables, one row per class and one row per word, so it can grow past memory:
``priors`` (label, n_docs, n_words) and ``words`` (term, total, n array in class order).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressroom.functions.text import STOPWORDS, is_vocabulary_word, serving_words, training_words
from pressroom.operators.ranking import with_rank
from pressroom.operators.wordcounts import count_words
from pressroom.session import settle, spread

# A word table of up to this many numbers (words x classes) is broadcast. Of a larger one the most frequent words
# that make no more are, and those above a 1/HOT_SHARE share of the training words, at most HOT_SHARE.
BROADCAST_CELLS = 4_000_000
HOT_SHARE = 10_000
# Words said more often than this count as equally frequent: that bounds the list of frequencies.
MOST_FREQUENT = 100_000


@dataclass(frozen=True)
class TopicModel:
    labels: tuple[str, ...]
    n_docs: tuple[int, ...]
    n_words: tuple[int, ...]
    vocabulary_size: int
    words: DataFrame
    stopwords: tuple[str, ...] = ()  # words known to be outside the vocabulary; need not be complete

    @property
    def log_priors(self) -> Column:
        total = sum(self.n_docs)
        return F.array(*[F.log(F.lit(float(n)) / F.lit(float(total))) for n in self.n_docs])

    def scored_words(self) -> DataFrame:
        """Log-probability of each word under each class, add-one smoothed."""
        logs = [
            F.log((F.col("n")[i] + 1) / F.lit(float(self.n_words[i] + self.vocabulary_size)))
            for i in range(len(self.labels))
        ]
        return self.words.select("term", "total", F.array(*logs).alias("log_p"))

    def priors_frame(self) -> DataFrame:
        rows = list(zip(self.labels, self.n_docs, self.n_words))
        spark = self.words.sparkSession
        return spark.createDataFrame(rows, "label string, n_docs bigint, n_words bigint").select(
            "*", F.log(F.col("n_docs") / F.lit(float(sum(self.n_docs)))).alias("log_prior")
        )


def bag_of_words(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    words: Callable[[Column], Column] = training_words,
) -> DataFrame:
    """One row per kept columns and word occurrence; documents without words keep one NULL row."""
    narrow = spread(docs.select(*keep, text))
    return narrow.select(*keep, F.explode_outer(words(F.col(text))).alias("term"))


def vocabulary(
    docs: DataFrame, text: str, cutoff: int = 1, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """Word frequencies over the corpus, after the length and stopword filter and the cutoff."""
    kept = bag_of_words(docs, text, ()).filter(is_vocabulary_word(F.col("term"), stopwords))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= cutoff)


def count_vectors(
    docs: DataFrame,
    text: str,
    key: str,
    terms: DataFrame,
    words: Callable[[Column], Column] = training_words,
) -> DataFrame:
    """Sparse count vectors over a vocabulary: (document, term, n).

    The words of a document are counted in its row, so nothing is shuffled before the look-up.
    """
    counted = count_words(spread(docs.select(key, text)), [key], words(F.col(text)))
    pairs = counted.select(key, F.explode(F.arrays_zip("terms", "counts")).alias("pair"))
    found = pairs.select(key, F.col("pair.terms").alias("term"), F.col("pair.counts").cast("bigint").alias("n"))
    return found.join(terms.select("term"), "term", "left_semi")


def split_by_id(docs: DataFrame, key: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Repeatable train/test split: every ``folds``-th id is held out."""
    held_out = F.pmod(F.col(key), F.lit(folds)) == 0
    return docs.filter(~held_out), docs.filter(held_out)


def fit(
    docs: DataFrame,
    text: str,
    label: str,
    cutoff: int = 1,
    stopwords: Sequence[str] = STOPWORDS,
) -> TopicModel:
    """Count words per class. Only the class list and its totals come to the driver."""
    per_class = docs.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    found = sorted((row[0], row[1]) for row in per_class.collect())
    labels = tuple(name for name, _ in found)
    kept = bag_of_words(docs.filter(F.col(label).isNotNull()), text, (label,)).filter(
        is_vocabulary_word(F.col("term"), stopwords)
    )
    counted = kept.groupBy("term").agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.count_if(F.col(label) == name) for name in labels]).alias("n"),
    )
    return _finished(found, counted, cutoff, stopwords)


def _finished(found: list[tuple[str, int]], counted: DataFrame, cutoff: int, stopwords: Sequence[str]) -> TopicModel:
    """Model from classes (name, documents) and counted words (term, total, n in class order)."""
    labels = tuple(name for name, _ in found)
    words = settle(counted.filter(F.col("total") >= cutoff), "topic-words")
    totals = words.agg(
        F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(len(labels))]
    ).first()
    return TopicModel(labels, tuple(n for _, n in found), tuple(totals[1:]), totals[0], words, tuple(stopwords))


def add_to_counts(
    docs: DataFrame, text: str, label: str, path: str, batch: str, stopwords: Sequence[str] = STOPWORDS
) -> None:
    """Add the word and class counts of a batch of documents to the stored counts, for ``merged_model``.

    Only the batch is read. It has folders of its own, so storing it again replaces it; counts are sums,
    so the order of batches does not matter. No cutoff is applied here: a word may grow past it later.
    """
    known = docs.filter(F.col(label).isNotNull())
    bag = bag_of_words(known, text, (label,)).filter(is_vocabulary_word(F.col("term"), stopwords))
    words = bag.groupBy(F.col(label).alias("label"), "term").agg(F.count(F.lit(1)).alias("n"))
    words.write.mode("overwrite").parquet(f"{path}/words/batch={batch}")
    classes = known.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_docs"))
    classes.write.mode("overwrite").parquet(f"{path}/classes/batch={batch}")


def merged_model(spark: SparkSession, path: str, cutoff: int = 1, stopwords: Sequence[str] = STOPWORDS) -> TopicModel:
    """The model of all batches together, equal to ``fit`` on all of their documents."""
    counts = spark.read.schema("label string, term string, n bigint, batch string").parquet(f"{path}/words")
    classes = spark.read.schema("label string, n_docs bigint, batch string").parquet(f"{path}/classes")
    found = sorted(tuple(row) for row in classes.groupBy("label").agg(F.sum("n_docs")).collect())
    per_class = [F.coalesce(F.sum(F.when(F.col("label") == name, F.col("n"))), F.lit(0)) for name, _ in found]
    summed = counts.groupBy("term").agg(F.sum("n").alias("total"), F.array(*per_class).alias("n"))
    return _finished(found, summed, cutoff, stopwords)


def save_model(model: TopicModel, path: str) -> None:
    model.words.write.mode("overwrite").parquet(f"{path}/words")
    model.priors_frame().drop("log_prior").write.mode("overwrite").parquet(f"{path}/priors")


def load_model(spark: SparkSession, path: str) -> TopicModel:
    words = spark.read.parquet(f"{path}/words")
    rows = sorted(tuple(row) for row in spark.read.parquet(f"{path}/priors").collect())
    labels, n_docs, n_words = zip(*rows)
    return TopicModel(labels, n_docs, n_words, words.count(), words)


def _least_frequent(model_words: DataFrame, most: int) -> int:
    """Smallest frequency from which on no more than ``most`` words are; none may be frequent enough."""
    total = F.least("total", F.lit(MOST_FREQUENT)).alias("total")
    sizes = sorted(tuple(row) for row in model_words.groupBy(total).agg(F.count(F.lit(1))).collect())
    held, least = 0, MOST_FREQUENT + 1
    for frequency, words in reversed(sizes):
        held += words
        if held > most:
            break
        least = frequency
    return least


def _look_up(bag: DataFrame, model_words: DataFrame, words: int, classes: int, n_total: int) -> DataFrame:
    """Left join of word occurrences to the word table, safe for words that fill the corpus.

    Most occurrences are of frequent words, which are looked up where they stand; only the others are shuffled.
    """
    if words * classes <= BROADCAST_CELLS:
        return bag.join(F.broadcast(model_words), "term", "left")
    frequent = F.col("total") >= min(n_total / HOT_SHARE, _least_frequent(model_words, BROADCAST_CELLS // classes))
    hot = F.broadcast(model_words.filter(frequent).withColumn("_hot", F.lit(True)))
    tried = bag.join(hot, "term", "left")
    rest = tried.filter(F.col("_hot").isNull()).select(*bag.columns)
    return tried.filter(F.col("_hot").isNotNull()).drop("_hot").unionByName(
        rest.join(model_words.filter(~frequent), "term", "left")
    )


def score(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    model: TopicModel,
    words: Callable[[Column], Column] = serving_words,
) -> DataFrame:
    """Joint log score per class as an array in class order; no known word → the priors alone."""
    # Stopwords and short words, the most frequent of all, are in no model: they are left out before
    # anything is shuffled. A document without any other word keeps one NULL row.
    candidates = lambda col: F.filter(words(col), lambda word: is_vocabulary_word(word, model.stopwords))
    found = _look_up(
        bag_of_words(docs, text, keep, candidates),
        model.scored_words(),
        model.vocabulary_size,
        len(model.labels),
        sum(model.n_words),
    )
    sums = [F.coalesce(F.sum(F.col("log_p")[i]), F.lit(0.0)).alias(f"_s{i}") for i in range(len(model.labels))]
    added = found.groupBy(*keep).agg(*sums)
    scores = F.zip_with(
        F.array(*[F.col(f"_s{i}") for i in range(len(model.labels))]),
        model.log_priors,
        lambda likelihood, prior: likelihood + prior,
    )
    return added.select(*keep, scores.alias("scores"))


def decide(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Best class (ties → the smallest) and its probability by log-sum-exp."""
    best = F.array_max("scores")
    names = F.array(*[F.lit(name) for name in labels])
    mass = F.aggregate(
        F.transform("scores", lambda s: F.exp(s - best)), F.lit(0.0), lambda acc, x: acc + x
    )
    return scored.select(
        "*",
        F.element_at(names, F.array_position("scores", best).cast("int")).alias("predicted"),
        (F.lit(1.0) / mass).alias("confidence"),
    )


def classify(docs: DataFrame, text: str, keep: Sequence[str], model: TopicModel, words=serving_words) -> DataFrame:
    return decide(score(docs, text, keep, model, words), model.labels)


def accuracy(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.agg(
        F.count_if(F.col("predicted") == F.col(label)).alias("hits"),
        F.count(F.lit(1)).alias("docs"),
        F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"),
    )


def classification_report(predictions: DataFrame, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class and their macro and weighted averages.

    Everything after the confusion counts works on at most classes² rows.
    """
    cells = predictions.groupBy(F.col(label).alias("truth"), "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("chosen"),
                    F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("chosen"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("side")
    ).select("side.*")
    per_class = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide("hits", "chosen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    rows = (
        per_class.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", f1)
        .select("label", "precision", "recall", "f1", "support")
    )
    macro = rows.agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(measure).alias(measure) for measure in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    weighted = rows.agg(
        F.lit("weighted avg").alias("label"),
        *[
            (F.sum(F.col(measure) * F.col("support")) / F.sum("support")).alias(measure)
            for measure in ("precision", "recall", "f1")
        ],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def with_folds(docs: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """Stratified folds 1..k in id order: each class is cut into k runs of near-equal size.

    Only ids and classes are ranked. The ids at which a class changes its fold, ``folds`` - 1 of each
    class, then place every row where it is read: no text moves.
    """
    ranked = with_rank(docs.select(key, label), [key], "_r", within=[label])
    sizes = ranked.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(F.broadcast(sizes), F.col(label) == F.col("_label"))  # one row per class
    small = F.floor(F.col("_n") / folds)
    longer = F.col("_n") % folds  # the first runs hold one row more
    edge = longer * (small + 1)
    fold = F.when(F.col("_r") <= edge, F.ceil(F.col("_r") / (small + 1))).otherwise(
        longer + F.ceil((F.col("_r") - edge) / F.greatest(small, F.lit(1)))
    )
    starts = joined.withColumn("_fold", fold.cast("int")).groupBy(F.col(label).alias("_label"), "_fold").agg(F.min(key).alias("_start"))
    borders = starts.groupBy("_label").agg(F.array_sort(F.collect_list(F.struct("_start", "_fold"))).alias("_borders"))
    placed = docs.join(F.broadcast(borders), F.col(label) == F.col("_label"))
    last = F.element_at(F.filter("_borders", lambda b: b["_start"] <= F.col(key)), -1)
    return placed.withColumn("fold", last["_fold"]).select(*docs.columns, "fold")


def cross_validate(
    docs: DataFrame, text: str, key: str, label: str, folds: int = 5, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """Accuracy per fold with one counting pass: a fold's model is the total minus its own counts.

    The vocabulary is fixed over all folds.
    """
    assigned = with_folds(docs.select(key, label, text), key, label, folds)
    cells = assigned.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    labels = sorted({row[0] for row in cells})
    docs_in = {(row[0], row[1]): row[2] for row in cells}
    numbers = range(1, folds + 1)
    grid = [(name, fold) for fold in numbers for name in labels]

    bag = bag_of_words(assigned, text, (label, "fold")).filter(is_vocabulary_word(F.col("term"), stopwords))
    # The place in the grid as one number: comparing it is cheaper than comparing class and fold.
    place = F.array_position(F.array(*[F.lit(name) for name in labels]), F.col(label))
    cell = (place + (F.col("fold") - 1) * len(labels)).alias("cell")
    counts = F.array(*[F.count_if(F.col("cell") == i) for i in range(1, len(grid) + 1)])
    words = settle(
        bag.select("term", cell).groupBy("term").agg(F.count(F.lit(1)).alias("total"), counts.alias("n")),
        "fold-words",
    )
    sums = words.agg(
        F.count(F.lit(1)), *[F.expr(f"coalesce(sum(n[{i}]), 0)") for i in range(len(grid))]
    ).first()
    size = sums[0]
    words_in = dict(zip(grid, sums[1:]))

    def log_p(name, fold):
        rest = [f for f in numbers if f != fold]
        seen = " + ".join(f"n[{grid.index((name, f))}]" for f in rest)
        return f"log(({seen} + 1) / {sum(words_in[(name, f)] for f in rest) + size}D)"

    def log_prior(name, fold):
        rest = [f for f in numbers if f != fold]
        mine = sum(docs_in.get((name, f), 0) for f in rest)
        everyone = sum(docs_in.get((n, f), 0) for n in labels for f in rest)
        return F.log(F.lit(mine / everyone)) if mine else F.lit(float("-inf"))

    # As one text: the grid of folds and classes is long to build column by column.
    by_fold = F.expr(
        f"array({', '.join('array(' + ', '.join(log_p(n, f) for n in labels) + ')' for f in numbers)})"
    )
    priors = F.array(*[F.array(*[log_prior(name, fold) for name in labels]) for fold in numbers])
    table = words.select("term", "total", by_fold.alias("log_p"))
    candidates = lambda col: F.filter(training_words(col), lambda word: is_vocabulary_word(word, stopwords))
    bag = bag_of_words(assigned, text, (key, label, "fold"), candidates)
    found = _look_up(bag, table, size, len(grid), sum(words_in.values()))
    sums_per_class = [
        F.coalesce(F.sum(F.element_at("log_p", F.col("fold"))[i]), F.lit(0.0)).alias(f"_s{i}")
        for i in range(len(labels))
    ]
    added = found.groupBy(key, label, "fold").agg(*sums_per_class)
    scores = F.zip_with(
        F.array(*[F.col(f"_s{i}") for i in range(len(labels))]),
        F.element_at(priors, F.col("fold")),
        lambda likelihood, prior: likelihood + prior,
    )
    predicted = decide(added.select(key, label, "fold", scores.alias("scores")), labels)
    return predicted.groupBy("fold").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("predicted") == F.col(label)).alias("hits")
    )


def category_quality(predictions: DataFrame, low: float = 0.7) -> DataFrame:
    """Articles, mean confidence and doubtful articles per predicted category."""
    return predictions.groupBy("predicted").agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") < low).alias("doubtful"),
    )
