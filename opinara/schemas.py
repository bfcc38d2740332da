"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven review dimensions, in table column order.
DIMENSIONS = (
    "bug_report",
    "pricing",
    "game_balance",
    "opinion",
    "community",
    "toxicity",
    "visuals",
)

# Dimension -> display label. `opinion` is a dimension, not a theme.
THEME_LABELS = {
    "bug_report": "Bugs",
    "pricing": "Preços",
    "game_balance": "Balanceamento",
    "toxicity": "Toxicidade",
    "community": "Comunidade",
    "visuals": "Visual",
}

# Sentiment labels, grade labels and the "no filter" sentinel.
SENTIMENTS = ("positive", "neutral", "mixed", "negative")
GRADES = ("green", "yellow", "red")
ALL = "Todos"

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


REVIEW_ROW = _struct(
    ("review_id", _S),
    ("game", _S),
    ("package_name", _S),
    ("language", _S),
    ("user_name", _S),
    ("content", _S),
    ("score", _I),
    ("thumbs_up_count", _I),
    ("review_created_version", _S),
    ("at", _TS),
    ("reply_content", _S),
    ("replied_at", _TS),
    ("app_version", _S),
)

REVIEWS_RAW = T.StructType([*REVIEW_ROW.fields, T.StructField("_ingested_at", _TS)])

# Partition column of the review tables: the first day of the month of ``at``.
AT_MONTH = "at_month"
REVIEWS_RAW_BY_MONTH = T.StructType([*REVIEWS_RAW.fields, T.StructField(AT_MONTH, T.DateType())])

REVIEWS_ENRICHED = T.StructType(
    [
        *REVIEWS_RAW.fields,
        T.StructField("sentiment", _S),
        *[T.StructField(d, T.BooleanType()) for d in DIMENSIONS],
        T.StructField("_enriched_at", _TS),
    ]
)

GAMES_META = _struct(
    ("game", _S), ("package_name", _S), ("icon", _S), ("title", _S), ("_updated_at", _TS)
)

GAMES_CONFIG = _struct(("game", _S), ("package_name", _S), ("source", _S), ("_added_at", _TS))

WEEKLY_REPORTS = _struct(
    ("report_week", T.DateType()),
    ("game", _S),
    ("grade", _S),
    ("report", _S),
    ("window_start", T.DateType()),
    ("window_end", T.DateType()),
    ("n_reviews", T.LongType()),
    ("avg_score", T.DoubleType()),
    ("_generated_at", _TS),
)

# Landed page payload: source field -> review column, plus the page coordinates.
PAGE_FIELDS = {
    "reviewId": "review_id",
    "userName": "user_name",
    "content": "content",
    "score": "score",
    "thumbsUpCount": "thumbs_up_count",
    "reviewCreatedVersion": "review_created_version",
    "at": "at",
    "replyContent": "reply_content",
    "repliedAt": "replied_at",
    "appVersion": "app_version",
}

_PAYLOAD_TYPES = {REVIEW_ROW[c].name: REVIEW_ROW[c].dataType for c in PAGE_FIELDS.values()}

# ``run`` names the reading that a page belongs to; positions compare within a run only.
PAGE_PAYLOAD = T.StructType(
    [
        T.StructField("package_name", _S),
        T.StructField("language", _S),
        T.StructField("run", _S),
        T.StructField("page", _I),
        T.StructField("pos", T.LongType()),
        *[T.StructField(src, _PAYLOAD_TYPES[dst]) for src, dst in PAGE_FIELDS.items()],
    ]
)

DIMS_STRUCT = T.StructType([T.StructField(d, T.BooleanType()) for d in DIMENSIONS])
