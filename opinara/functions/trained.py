"""Flags learned from labelled texts, as an alternative to asking a hosted model.

Naive Bayes counts tokens with the DataFrame API and its results can be checked in SQL; logistic
regression is the second option.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, staged

DIGITS = 4  # hex digits of a token's digest that name its feature
DIGITS_SIZE = 16**DIGITS
PRIOR = ""  # the feature that every text has once


def token_features(text: Column) -> Column:
    """One feature per token of the lower-cased text, then the prior's."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r]+"), lambda t: t != "")
    named = F.transform(tokens, lambda t: F.substring(F.md5(t), 1, DIGITS))
    return F.array_append(named, F.lit(PRIOR))


def train_token_weights(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """Naive Bayes with add-one counts: (feature, weight), at most ``DIGITS_SIZE`` + 1 rows.

    Counts are added up per task before the shuffle, so a frequent word sends one row per task.
    Rows without a text or a label are left out.
    """
    rows = labelled.dropna(subset=[text, label])
    counts = staged(
        rows.select(F.col(label).alias("y"), F.explode(token_features(F.col(text))).alias("feature"))
        .groupBy("feature")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")),
        "token-counts",
    )
    tokens = counts.filter(F.col("feature") != PRIOR)
    odds = F.log((F.col("pos") + 1) / (F.col("neg") + 1))
    scale = F.log(
        (tokens.agg(F.sum("neg")).scalar() + DIGITS_SIZE)
        / (tokens.agg(F.sum("pos")).scalar() + DIGITS_SIZE)
    )
    weight = F.when(F.col("feature") == PRIOR, odds).otherwise(odds + scale)
    return staged(counts.select("feature", weight.alias("weight")), "token-weights")


def flag_by_tokens(df: DataFrame, key: str, weights: DataFrame, text: str, flag: str) -> DataFrame:
    """(``key``, ``flag``) per distinct key: whether its tokens' weights add up to more than zero.

    Tokens never met in training weigh nothing. Sums are rounded to six places, which leaves the
    order of addition without effect. NULL where a key has no text at all.
    """
    rows = df.select(
        key, F.col(text).isNotNull().alias("has"), F.explode(token_features(F.col(text))).alias("feature")
    )
    total = F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6)
    return (
        rows.join(weights, "feature", "left")
        .groupBy(key)
        .agg(F.when(F.bool_or("has"), total > 0).alias(flag))
    )


def train_flag_model(
    labelled: DataFrame, text: str, label: str, features: int = 1 << 15, max_iter: int = 20
) -> PipelineModel:
    """Fit token counts to a 0/1 label. The driver holds one weight per hashed feature.

    The model is saved to the shared folder and read back, which leaves its training summary
    behind; otherwise the summary, with the frame it was fitted on, travels with every task.
    """
    rows = labelled.filter(F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(label).cast("double").alias("_label")
    )
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern="\\s+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        LogisticRegression(
            featuresCol="_counts",
            labelCol="_label",
            predictionCol="_prediction",
            maxIter=max_iter,
            regParam=0.01,
        ),
    ]
    path = shared_dir(labelled.sparkSession, "flag-model")
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)


def flag_with_model(df: DataFrame, model: PipelineModel, text: str, flag: str) -> DataFrame:
    """Add the boolean ``flag``; NULL where there is no text."""
    ready = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    predicted = F.when(F.col(text).isNotNull(), F.col("_prediction") == 1.0)
    return model.transform(ready).select(*df.columns, predicted.alias(flag))
