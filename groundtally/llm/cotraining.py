"""Document quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Each round both views are fitted, judge all unlabelled documents, and hand what they are sure of to
the other view as labels, which together weigh less than the true labels of their class. At the end held-back labels calibrate the two views into one probability, by
which all documents are scored. The models are linear and come from pyspark.ml; everything
runs in DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import written


@dataclass(frozen=True)
class Settings:
    """Parameters of the fit. Labelled rows are bounded; the exchange takes all unlabelled documents.

    ``trust`` is the most that handed labels of a class weigh together, as a part of the true ones.
    """

    labelled_rows: int = 12_000
    rounds: int = 3
    sure: float = 0.97
    word_features: int = 1 << 13
    name_features: int = 1 << 8
    trust: float = 0.5
    iterations: int = 30
    threshold: float = 0.5


#: The plain numbers of the text's view; they lie near 0 to 1, as features aren't standardised.
_NUMBERS = ("variety", "few", "lines", "capitals", "digits", "marks", "blanks")


def _share(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)) / F.greatest(F.col("length"), F.lit(1))


def _measured(docs: DataFrame, settings: Settings) -> DataFrame:
    """Adds what the views are made of: ``counts`` of words and the plain numbers; ``named`` and ``stated`` for the metadata."""
    text = F.coalesce("text", F.lit(""))
    rows = (docs.withColumn("text", text).withColumn("length", F.char_length("text"))
            .withColumn("tokens", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0)))
            .withColumn("variety", F.size(F.array_distinct("tokens")) / F.greatest(F.size("tokens"), F.lit(1)))
            .withColumn("few", (F.size("tokens") < 50).cast("double"))
            .withColumn("names", F.array(F.concat(F.lit("lang="), F.coalesce("lang", F.lit(""))), F.concat(F.lit("source="), F.coalesce("source", F.lit("")))))
            .withColumn("stated", F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))) / 10)
            .withColumn("lines", F.log1p(F.col("length") / (F.regexp_count("text", F.lit("\n")) + 1)) / 10)
            .withColumn("capitals", _share("[A-Z]")).withColumn("digits", _share("[0-9]"))
            .withColumn("marks", _share(r"[!-/:-@\[-`{-~]")).withColumn("blanks", _share(r"\s")))
    rows = HashingTF(numFeatures=settings.word_features, inputCol="tokens", outputCol="counts").transform(rows)
    return HashingTF(numFeatures=settings.name_features, inputCol="names", outputCol="named", binary=True).transform(rows)


def _viewed(rows: DataFrame) -> DataFrame:
    """Adds ``words`` and ``meta`` to measured rows."""
    rows = Normalizer(inputCol="counts", outputCol="shares").transform(rows)
    rows = VectorAssembler(inputCols=["shares", *_NUMBERS], outputCol="words").transform(rows)
    return VectorAssembler(inputCols=["named", "stated"], outputCol="meta").transform(rows)


def add_views(docs: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``words`` and ``meta``, the feature vectors of both views, to (id, text, lang, source, n_chars).

    Words: hashed runs of letters and of marks, how varied they are, and the text's make-up: lines, capitals,
    digits, marks and blanks. Metadata, of which nothing is measured on the text: language and source by name, and
    the stated length, 0 where none is.
    """
    return _viewed(_measured(docs, settings))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """A bounded sample of ids that doesn't depend on partitions or runs."""
    return rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most)


def _fit(rows: DataFrame, view: str, settings: Settings) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=view, labelCol="label", weightCol="weight", maxIter=settings.iterations, regParam=1e-4, standardization=False,
                              rawPredictionCol=f"{view}_raw", probabilityCol=f"{view}_p", predictionCol=f"{view}_guess").fit(rows)


def _judged(rows: DataFrame, models: dict[str, LogisticRegressionModel]) -> DataFrame:
    """Adds the log-odds of each view, cut at 15 either way."""
    for view, model in models.items():
        rows = model.transform(rows).withColumn(f"{view}_odds", F.greatest(F.lit(-15.0), F.least(F.lit(15.0), vector_to_array(f"{view}_raw")[1])))
        rows = rows.drop(f"{view}_raw", f"{view}_p", f"{view}_guess")
    return rows


class QualityModel:
    """Two fitted views and their combination. ``combined`` is None where the labels hold one class alone."""

    def __init__(self, settings: Settings, views: dict[str, LogisticRegressionModel], combined: LogisticRegressionModel | None, exchanged: list[tuple[int, int]]):
        self.settings, self.views, self.combined, self.exchanged = settings, views, combined, exchanged

    def score(self, docs: DataFrame) -> DataFrame:
        """(id, score, kept) of every row of narrow documents. Without a fitted model the score is null and every row is kept."""
        return self.score_measured(_measured(docs, self.settings) if self.combined else docs)

    def score_measured(self, rows: DataFrame) -> DataFrame:
        """The same for measured rows, whose texts aren't read again."""
        if self.combined is None:
            return rows.select("id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("kept"))
        judged = _judged(_viewed(rows).select("id", "words", "meta"), self.views)
        scored = self.combined.transform(VectorAssembler(inputCols=["words_odds", "meta_odds"], outputCol="both").transform(judged))
        p = vector_to_array("both_p")[1]
        return scored.select("id", p.alias("score"), (p >= self.settings.threshold).alias("kept"))


def narrow(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that the views read, of documents that may lack some of them or have others."""
    pick = lambda name, kind: (docs[name] if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(docs[id_col].cast("long").alias("id"), pick("text", "string"), pick("lang", "string"), pick("source", "string"), pick("n_chars", "long"))


def measure(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """What the views are made of, written, one row per document: counts in place of shares, which compress better."""
    return written(_measured(narrow(docs, id_col), settings).select("id", F.xxhash64("text").alias("digest"), "counts", "named", "stated", *_NUMBERS))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """:func:`train_measured` on the documents, measured here."""
    return train_measured(measure(docs, settings, id_col), labels, settings, id_col, label_col)


def train_measured(rows: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit both views and their combination.

    Labels without an id or class are passed over; of several labels for an id the lowest counts, and of several
    documents with a labelled id the one with the lowest digest. The labelled rows are a bounded, fixed sample of ids;
    a fifth of them is held back from the views and calibrates their combination. Every document without a label,
    rows without an id and repeated ones included, is judged by both views each round, and all that a view is sure of
    go to the other one, weighted by class. What is measured meets the labels, never a text; both are dealt by id at any
    size, so that what is moved grows with the documents.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("double").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    chosen = _sample(known, settings.labelled_rows).select("id", F.lit(True).alias("chosen"))
    known = known.join(chosen, "id", "left").withColumnRenamed("id", "known_id")
    # rows without an id meet no label and are dealt by their text, so that they don't meet in one task
    met = (F.col("spread") == F.col("known_id")) & F.col("id").isNotNull()
    rows = rows.withColumn("spread", F.coalesce("id", "digest")).join(known.hint("merge"), met, "left").filter("known_id is null or chosen").drop("spread", "known_id", "chosen")
    rows = written(rows.withColumn("part", F.when(F.col("label").isNull(), "pool").otherwise("labelled")).withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0))
    kept = F.struct("counts", "named", "stated", *_NUMBERS, "label", "held", F.lit(1.0).alias("weight"))
    known_only = rows.filter("part = 'labelled'").groupBy("id").agg(F.min_by(kept, "digest").alias("row")).select("id", "row.*")
    known_rows = written(known_only)  # bounded, read by every step of every fit
    seen = lambda r: _viewed(r).select("id", "label", "weight", "words", "meta", "held")
    labelled, held = seen(known_rows.filter("not held")), seen(known_rows.filter("held"))
    if labelled.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
        return QualityModel(settings, {}, None, [])
    judged = _viewed(rows.filter("part = 'pool'")).select("id", "words", "meta")
    true_labels = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two classes
    taught = {"words": labelled, "meta": labelled}
    views: dict[str, LogisticRegressionModel] = {}
    exchanged = []
    sure = F.log(F.lit(settings.sure / (1 - settings.sure)))
    for round_no in range(settings.rounds):
        views = {view: _fit(taught[view], view, settings) for view in taught}
        if round_no == settings.rounds - 1:
            break
        told = _judged(judged, views)
        given = told.select(*[F.count_if(sign * F.col(f"{view}_odds") >= sure).alias(f"{view}{sign}") for view in views for sign in (1, -1)]).first()
        exchanged.append(tuple(given[f"{view}1"] + given[f"{view}-1"] for view in ("words", "meta")))
        taught = {}
        for giver, taker in (("words", "meta"), ("meta", "words")):
            odds = F.col(f"{giver}_odds")
            good, bad = (min(1.0, settings.trust * true_labels.get(label, 0) / max(1, given[f"{giver}{sign}"])) for label, sign in ((1.0, 1), (0.0, -1)))
            gifts = told.filter(F.abs(odds) >= sure).select("id", (odds > 0).cast("double").alias("label"), F.when(odds > 0, good).otherwise(bad).alias("weight"), "words", "meta", F.lit(False).alias("held"))
            taught[taker] = labelled.unionByName(gifts)
    judged_held = VectorAssembler(inputCols=["words_odds", "meta_odds"], outputCol="both").transform(_judged(held, views))
    combined = LogisticRegression(featuresCol="both", labelCol="label", regParam=1e-4, maxIter=50, rawPredictionCol="both_raw", probabilityCol="both_p", predictionCol="both_guess").fit(judged_held)
    return QualityModel(settings, views, combined, exchanged)
