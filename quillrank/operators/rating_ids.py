"""Rating models over ids of any type: text, 64-bit numbers, whatever can be sorted and joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import recommend as plain
from quillrank.operators.joins import join_lookup
from quillrank.operators.ordered import number_rows
from quillrank.session import pin

#: Numbers that a rating model takes.
MOST_IDS = (1 << 31) - 1


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct ids numbered from 0 in their order, by sorted runs; nulls left out."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = pin(number_rows(distinct, [column], name="number", start=0), "ids")
    if (numbered.agg(F.max("number")).first()[0] or 0) > MOST_IDS:
        raise ValueError(f"{column} has more than {MOST_IDS + 1} ids")
    return numbered.withColumn("number", F.col("number").cast("int"))


@dataclass
class KeyedModel:
    """A rating model over numbers, and the dictionaries of its users and items."""

    model: ALSModel
    users: DataFrame
    items: DataFrame
    user: str = "user_id"
    item: str = "item_id"

    def numbered(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with ``user_id`` and ``item_id`` as numbers and the ids themselves as ``__user`` and ``__item``.

        Rows with an unknown id are left out, or have the number -1 with ``how="left"``.
        """
        users = self.users.select(F.col(self.user).alias("__user"), F.col("number").alias("__u"))
        items = self.items.select(F.col(self.item).alias("__item"), F.col("number").alias("__i"))
        rows = rows.withColumnsRenamed({self.user: "__user", self.item: "__item"})
        rows = join_lookup(join_lookup(rows, users, "__user", how), items, "__item", how, counted=rows)
        number = lambda c: F.coalesce(c, F.lit(-1)).cast("int")
        return rows.withColumns({"user_id": number("__u"), "item_id": number("__i")}).drop("__u", "__i")

    def named(self, rows: DataFrame) -> DataFrame:
        """Numbers back to ids."""
        users = self.users.select(F.col(self.user).alias("__user"), F.col("number").alias("user_id"))
        items = self.items.select(F.col(self.item).alias("__item"), F.col("number").alias("item_id"))
        return self._ids(join_lookup(join_lookup(rows, users, "user_id"), items, "item_id"))

    def _ids(self, rows: DataFrame) -> DataFrame:
        return rows.drop("user_id", "item_id").withColumnsRenamed({"__user": self.user, "__item": self.item})


def fit(ratings: DataFrame, user: str = "user_id", item: str = "item_id", **parameters) -> KeyedModel:
    """Fit on ratings whose ids are of any type; rows with a null id or rating teach nothing.

    ``parameters`` are those of :func:`recommend.fit_ratings`. The numbered
    ratings are pinned, since the fit reads them again after a lost executor.
    """
    ratings = ratings.select(user, item, "rating").where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col("rating").isNotNull())
    empty = KeyedModel(None, dictionary(ratings, user), dictionary(ratings, item), user, item)
    numbers = pin(empty.numbered(ratings).select("user_id", "item_id", "rating"), "numbered")
    return KeyedModel(plain.fit_ratings(numbers, **parameters), empty.users, empty.items, user, item)


def predict_pairs(model: KeyedModel, pairs: DataFrame, unknown: str = "drop") -> DataFrame:
    """Add ``prediction`` to given pairs; unknown ids as in :func:`recommend.predict_pairs`."""
    rows = model.numbered(pairs, "inner" if unknown == "drop" else "left")
    order = [c for c in pairs.columns] + ["prediction"]
    return model._ids(plain.predict_pairs(model.model, rows, unknown)).select(*order)


def recommend(model: KeyedModel, ratings: DataFrame, k: int = 10, users: DataFrame | None = None, **limits) -> DataFrame:
    """The best ``k`` unrated items of every user, or of the given ``users``; ties to the later id.

    Rated pairs with ids that the model does not know change nothing.
    """
    # Every round of items reads the rated pairs.
    rated = pin(model.numbered(ratings.select(model.user, model.item)).select("user_id", "item_id"), "rated")
    if users is not None:
        known = model.users.select(F.col(model.user), F.col("number").alias("user_id"))
        wanted = users.select(model.user).where(F.col(model.user).isNotNull()).distinct()
        users = known.join(wanted, model.user, "left_semi").select("user_id")
    found = plain.recommend(model.model, rated, k, users=users, **limits)
    named = model.named(found.withColumns({"user_id": F.col("user_id").cast("int"), "item_id": F.col("item_id").cast("int")}))
    return named.select(model.user, model.item, "score", "rank")
