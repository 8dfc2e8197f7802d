"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, hits near the second person, capitals, punctuation and obfuscation.
The lexicon has a fixed part and stems learned from labelled rows: whole words and their first letters
that stand in toxic texts far more often than elsewhere. The model is fitted on a bounded sample of the labelled rows, those
with the lowest hashes of doc_id: half of it for the stems, a quarter for the trees, and that and the last one for the calibration. Where a part
lacks a class, the trees take both last quarters, or else the whole sample.

Only the text goes into a score. A null or empty text has all features 0 and is scored like any other.
Repeated rows get equal scores. Without labels of both classes in the whole sample the fixed lexicon alone decides. An empty
table gives no rows. Other columns stay; those of the results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Learned words and stems, at most.
LEARNED = 400
THRESHOLD = 0.3
#: Insults, and words of the second person in the four languages.
INSULTS = """idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless scum trash garbage clown clowns disgusting
jerk fool imbecile cretin vermin filth filthy bastard pig swine bitch asshole retard freak creep liar ugly shut hate despise
dumm blöd arschloch trottel abschaum widerlich wertlos connard imbécile crétin ordure dégueulasse nul estúpido imbécil
asqueroso basura payaso inútil""".split()
SECOND_PERSON = "you your yours yourself u ur youre du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos tú te ti tus usted ustedes vosotros".split()
#: Characters that stand in for letters.
STANDS_IN, LETTER = "013457@$", "oleastas"
NEAR = 5
STEMS = (4, 5, 6)
FEATURES = ["length", "fixed", "fixed_n", "learned", "learned_n", "kinds", "person", "near", "near_n", "capitals", "shouts", "marks", "punctuation", "masked", "runs"]


def tokens(text: Column) -> Column:
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), STANDS_IN, LETTER)
    return F.regexp_extract_all(folded, F.lit(r"\p{L}+"), F.lit(0))


def _stem(token: Column, n: int) -> Column:
    return F.concat(F.lit(f"{n}:"), F.substring(token, 1, n))


def with_features(docs: DataFrame, learned: list[str], text: str = "text") -> DataFrame:
    """Adds the columns of FEATURES, with the prefix _tox_."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = {w.partition(":")[2] for w in learned if w.startswith("0:")}
    stems = {n: sorted({w.partition(":")[2] for w in learned if w.startswith(f"{n}:")}) for n in STEMS}

    def kind(token: Column) -> Column:
        known = token.isin(sorted(words)) if words else F.lit(False)
        for n in STEMS:
            if stems[n]:
                known = known | F.substring(token, 1, n).isin(stems[n])
        return F.when(token.isin(INSULTS), 1).when(token.isin(SECOND_PERSON), 3).when(known, 2).otherwise(0)

    docs = docs.withColumn("_tox_word_list", tokens(F.col(text))).withColumn("_tox_word_kinds", F.transform("_tox_word_list", kind))
    docs = docs.withColumn("_tox_hit_places", F.filter(F.transform("_tox_word_kinds", lambda k, i: F.when(k.isin(1, 2), i).otherwise(-1)), lambda i: i >= 0))
    count = lambda k: F.size(F.filter("_tox_word_kinds", lambda x: x == k)).cast("double")
    near = F.size(F.filter("_tox_hit_places", lambda i: F.array_contains(F.slice("_tox_word_kinds", F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR + 1), 3))).cast("double")
    per_word = F.greatest(F.size("_tox_word_list").cast("double"), F.lit(1.0))
    per_character = F.greatest(F.length(whole).cast("double"), F.lit(1.0))
    found = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("double")
    values = {
        "length": F.log1p(F.size("_tox_word_list").cast("double")),
        "fixed": count(1) / per_word, "fixed_n": count(1), "learned": count(2) / per_word, "learned_n": count(2),
        "kinds": F.size(F.array_distinct(F.transform("_tox_hit_places", lambda i: F.get("_tox_word_list", i)))).cast("double"),
        "person": count(3) / per_word, "near": near / per_word, "near_n": near,
        "capitals": (F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("double") / per_character,
        "shouts": found(r"(?<![\p{L}])\p{Lu}{3,}(?![\p{L}])") / per_word,
        "marks": (F.length(whole) - F.length(F.translate(whole, "!?", ""))).cast("double") / per_character,
        "punctuation": (F.length(whole) - F.length(F.translate(whole, ".,;:-()\"'", ""))).cast("double") / per_character,
        "masked": found(r"\p{L}[@$*#0-9]+\p{L}") / per_word,
        "runs": found(r"[#$%&*@!]{2,}") / per_word,
    }
    return docs.withColumns({f"_tox_{k}": values[k] for k in FEATURES}).drop("_tox_word_list", "_tox_word_kinds", "_tox_hit_places")


def learn_stems(sample: DataFrame) -> list[str]:
    """Words ("0:word") and stems ("n:letters") of toxic texts, at most LEARNED of them, the most telling first."""
    long = F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: F.length(t) >= min(STEMS))
    keys = F.array_distinct(F.flatten(F.transform(long, lambda t: F.array(F.concat(F.lit("0:"), t), *[_stem(t, n) for n in STEMS]))))
    rows = sample.select("toxic", F.explode(keys).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where((F.col("t") >= 4) & (F.col("t") >= 0.6 * F.col("n")))
    told = F.col("t") * F.log(F.col("t") / (F.col("n") - F.col("t") + 1) + 1)
    return [r["key"] for r in counts.orderBy(told.desc(), "key").limit(LEARNED).collect()]


@dataclass
class Model:
    learned: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds score and predicted."""
        # The caller's columns go along in one, so that no name can clash.
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_tox_row"), docs[text].alias("_tox_text"))
        rows = with_features(rows, self.learned, "_tox_text")
        if self.trees is None:
            raw = F.lit(1.0) - F.exp(-F.col("_tox_fixed_n"))
            rows = rows.withColumn("score", raw)
        else:
            rows = VectorAssembler(inputCols=[f"_tox_{f}" for f in FEATURES], outputCol="_tox_all").transform(rows)
            rows = self.trees.transform(rows).withColumn("_tox_p", F.get(vector_to_array("_tox_both"), F.lit(1)))
            rows = self.calibration.transform(rows)
            # The calibration is a step function; a fiftieth of the uncalibrated score orders what shares a step.
            rows = rows.withColumn("score", F.lit(0.98) * F.least(F.greatest("_tox_level", F.lit(0.0)), F.lit(1.0)) + F.lit(0.02) * F.col("_tox_p"))
        rows = rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        return rows.select(*[F.col(f"_tox_row.`{c}`").alias(c) for c in docs.columns if c not in ("score", "predicted")], "score", "predicted")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled rows. The sample is small enough by its bound to be sent to all tasks."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    chosen = labelled.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).persist()
    stems = learn_stems(sample.where("part < 2"))
    training = VectorAssembler(inputCols=[f"_tox_{f}" for f in FEATURES], outputCol="_tox_all").transform(with_features(sample, stems)).select("part", "toxic", "_tox_all").persist()
    try:
        classes = {r["part"]: r["n"] for r in training.groupBy("part").agg(F.count_distinct("toxic").alias("n")).collect()}
        if training.select("toxic").distinct().count() < 2:
            return Model(stems, None, None)
        own = "part = 2" if classes.get(2) == 2 else "part >= 2" if training.where("part >= 2").select("toxic").distinct().count() == 2 else "part >= 0"
        trees = GBTClassifier(labelCol="toxic", featuresCol="_tox_all", predictionCol="_tox_guess", maxIter=10, maxDepth=3, stepSize=0.3, seed=7)
        trees = trees.setRawPredictionCol("_tox_raw").setProbabilityCol("_tox_both").fit(training.where(own))
        scored = trees.transform(training.where("part >= 2") if own != "part >= 0" else training).withColumn("_tox_p", F.get(vector_to_array("_tox_both"), F.lit(1)))
        calibration = IsotonicRegression(labelCol="toxic", featuresCol="_tox_p", predictionCol="_tox_level").fit(scored)
        return Model(stems, trees, calibration)
    finally:
        sample.unpersist()
        training.unpersist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that are not held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    return train(docs, labels).score(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
