"""Cosine ranking of vectors among the rows that a caller may read, and the refresh of stale ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.operators.reads import Reader
from policyframe.plans.predicate import ALL, Condition

MOST_RESULTS, MOST_CANDIDATES, MOST_DIMENSIONS = 1000, 10_000, 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rank(candidates: DataFrame, key: str, vector: str, query: list[float], take: int) -> DataFrame:
    """The nearest by cosine distance, ties by key: distance and similarity. Vectors of another length, with null or
    non-finite parts or without a direction are no candidates. The query is one vector; a scan and a bounded sort."""
    if not 0 < take <= MOST_RESULTS:
        raise ValueError(f"take must be 1 to {MOST_RESULTS}")
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = candidates.filter((F.size(v) == len(query)) & fine).withColumn("_norm", F.sqrt(dot(v, v))).filter("_norm > 0")
    similarity = dot(v, q) / (F.col("_norm") * size)
    df = df.withColumn("distance", 1 - similarity).withColumn("similarity", 1 - F.col("distance")).drop("_norm")
    return df.orderBy("distance", key).limit(take)


def document_hash(fields: list[str]) -> Column:
    """Of the fields in order, with their names, whether they are there, and their lengths."""
    parts = [F.lit("semantic-document:v1")]
    for f in fields:
        text = F.col(f"`{f}`").cast("string")
        parts += [F.lit(f), F.when(text.isNull(), "0").otherwise("1"), F.coalesce(F.octet_length(text), F.lit(0)).cast("string"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def refresh(rows: DataFrame, key: str, fields: list[str], known: DataFrame) -> DataFrame:
    """(key, action): 'embed' rows without a vector or with another hash, 'delete' vectors without a row. known: (key, hash)."""
    now = rows.select(F.col(key).alias("_k"), document_hash(fields).alias("_h"))
    both = now.join(known.select(F.col(key).alias("_o"), F.col("hash").alias("_was")), F.col("_k") == F.col("_o"), "full")
    action = F.when(F.col("_k").isNull(), "delete").when(F.col("_was").isNull() | (F.col("_was") != F.col("_h")), "embed")
    return both.select(F.coalesce("_k", "_o").alias(key), action.alias("action")).filter("action is not null")


def validated(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """The rows, of which one with a vector of another length, with null or non-finite parts, or without a direction fails."""
    if not 0 < dimensions <= MOST_DIMENSIONS:
        raise ValueError(f"vectors have 1 to {MOST_DIMENSIONS} dimensions")
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce((F.size(v) == dimensions) & fine, F.lit(False))
    checked = F.when(ok, v).otherwise(F.raise_error(F.lit("not a vector of the declared kind")).cast(vectors.schema[vector].dataType))
    return vectors.withColumn(vector, checked)


def search(reader: Reader, name: str, vectors: DataFrame, query: list[float], take: int, *, where: Condition = ALL, key: str | None = None, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """Rows of a model that the policy shows and the condition chooses, nearest to `query` first, with distance and similarity.
    vectors: (key, vector) of the model's rows. Candidates are authorised before they are ranked; more of them than `most` fail
    the search, none is left out (None lifts the limit)."""
    model = reader.catalog.model(name)
    key = key or model.key[0]
    df = reader.find_many(name, where=where).join(vectors.select(F.col(key).alias("_k"), F.col("vector").alias("_vector")), F.col(f"`{key}`") == F.col("_k")).drop("_k")
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidates")
    return rank(df, key, "_vector", query, take).drop("_vector")


def refreshed(rows: DataFrame, key: str, fields: list[str], known: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, fingerprint: str, dimensions: int, batch: int = 64) -> DataFrame:
    """(key, hash, fingerprint, vector) of every row: vectors of `known`, a table of that form, stay where the document and the
    embedder's fingerprint are the same; others are made by `embed`, up to `batch` documents a call; those of rows that are gone
    go. A document is the fields' names and texts."""
    if not 0 < dimensions <= MOST_DIMENSIONS or batch < 1:
        raise ValueError(f"vectors have 1 to {MOST_DIMENSIONS} dimensions, batches a document at least")
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))) for f in fields])
    now = rows.select(F.col(key).alias("_k"), document_hash(fields).alias("hash"), text.alias("_text"))
    old = known.filter(F.col("fingerprint") == fingerprint).select(F.col(key).alias("_o"), F.col("hash").alias("_was"), F.col("vector").cast("array<double>").alias("vector"))
    both = now.join(old, (F.col("_k") == F.col("_o")) & (F.col("hash") == F.col("_was")), "left")
    kept = both.filter("vector is not null").select("_k", "hash", "vector")
    kind = rows.schema[key].dataType.simpleString()

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                found = embed(part["_text"].tolist())
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} documents")
                yield pd.DataFrame({"_k": part["_k"], "hash": part["hash"], "vector": [list(map(float, v)) for v in found]})

    made = both.filter("vector is null").select("_k", "hash", "_text").mapInPandas(step, f"_k {kind}, hash string, vector array<double>")
    out = kept.unionByName(validated(made, "vector", dimensions))
    return out.select(F.col("_k").alias(key), "hash", F.lit(fingerprint).alias("fingerprint"), "vector")
