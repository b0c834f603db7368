"""Ad clicks: 13 integers and any number of categories, one click or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode
from quillrank.operators import features, learn, ordered
from quillrank.session import pin
from quillrank.sources import readers, writers

# Fixed value: the id of the first scored row.
FIRST_ID = 60_000_000


def integers(df: DataFrame) -> list[str]:
    return [f"i{n}" for n in range(readers.INTEGER_FIELDS)]


def texts(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("c") and c[1:].isdigit()]


def examples(clicks: DataFrame, labeled: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Click rows as examples: group ``i`` of numbers and ``c`` of indicators, gaps left out."""
    groups = {
        "i": encode.group([encode.amount(c, F.col(c)) for c in integers(clicks)]),
        "c": encode.group([encode.token(f"{c}_", F.col(c)) for c in texts(clicks)]),
    }
    return learn.featurize(clicks, groups, F.col("label") if labeled else None, keep)


def hashed(clicks: DataFrame, bits: int = 23) -> DataFrame:
    """The same features hashed straight from the columns, without leaving the JVM."""
    numbers = {c: F.col(c).cast("double") for c in integers(clicks)}
    return features.hash_columns(clicks.withColumns(numbers), integers(clicks) + texts(clicks), bits)


def fit(train: DataFrame, bits: int = 23, passes: int = 30, l2: float = 14.0, tol: float = 1e-5) -> Model:
    """Logistic model by L-BFGS. ``l2`` is a total over the rows, so it is divided by their number."""
    vectors = pin(
        hashed(train, bits).select(encode.unsigned_label(F.col("label")).alias("label"), "features"), "clicks"
    )
    # Wide gradients are large, so they are added up over more levels.
    depth = 2 if bits <= 18 else 4
    return learn.fit_logistic(vectors, l2=l2 / max(vectors.count(), 1), iterations=passes, tol=tol, depth=depth)


def score(model: Model, clicks: DataFrame, bits: int = 23) -> DataFrame:
    """Click rows with the click probability ``score``."""
    scored = learn.probability(model.transform(hashed(clicks, bits)))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def submit(spark: SparkSession, train_path: str, test_path: str, out_path: str, bits: int = 23,
           passes: int = 30, l2: float = 14.0, first_id: int = FIRST_ID) -> DataFrame:
    """Train on one file, score another in file order and write ``Id,Predicted``."""
    model = fit(readers.read_clicks(spark, train_path), bits, passes, l2)
    # Row ids follow the file order.
    placed = readers.with_file_order(readers.read_clicks(spark, test_path, labeled=False))
    numbered = ordered.number_rows(placed, readers.FILE_ORDER, name="id", start=first_id)
    rows = writers.submission(score(model, numbered, bits), "id", "score")
    writers.write_submission(rows, out_path)
    return rows
