"""Bounded samples of labelled and of unlabelled documents, for training.

crc32(doc_id as text) mod 5 is a document's fold; fold 0 is held out and never trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
_SPAN = 1 << 40


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def share(id_col: str, part: float, salt: int) -> Column:
    """Holds for `part` of the ids, by a hash."""
    return F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(_SPAN)) < int(min(1.0, part) * _SPAN)


def sample(rows: DataFrame, id_col: str, bound: int, salt: int) -> DataFrame:
    """About `bound` of rows at most, by a hash of the id; all, if there are no more."""
    n = rows.count()
    return rows if n <= bound else rows.filter(share(id_col, bound / n, salt))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the labels 0 and 1 outside fold 0; of labels that differ for one id, the larger."""
    out = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    return out.filter(fold("id") != 0).groupBy("id").agg(F.max("y").alias("y"))


def bounded(texts: DataFrame, bound: int, salt: int) -> DataFrame:
    """Rows of (id, text, ...), those that repeat an id and text once, and about `bound` of them at most, by a hash of both:
    an id may stand in any number of rows. `key` is the text's hash."""
    rows = texts.withColumn("key", F.xxhash64("text"))
    n = texts.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id", "key"), F.lit(_SPAN)) < int(bound / n * _SPAN))
    return rows.dropDuplicates(["id", "key"])
