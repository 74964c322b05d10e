"""Toxicity by a classifier chain.

Linear models predict the categories one after the other; each sees the earlier categories' probabilities. For training
those are out-of-fold predictions, so that later models learn from what earlier ones say of texts they have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_of

_WORDS = re.compile(r"[^\W\d_]+")
FOLDS = 5
#: The chain over the columns of the labels table: what each category is, in order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low": "toxic = 1 AND quality = 0"}


def features_of(text: str) -> set[str]:
    """A text's lower-case words (``=word``) and their first 3 to 6 letters (``^let``)."""
    found = set()
    for w in set(_WORDS.findall(text.lower())):
        found.add(f"={w}")
        found.update(f"^{w[:k]}" for k in range(3, 7) if len(w) > k)
    return found


@dataclass
class Linear:
    """Logistic regression with a ridge penalty, fitted by Newton steps."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Linear:
        if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the rate so far, smoothed
            p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-6
            return cls(np.zeros(x.shape[1]), float(np.log(p / (1 - p))))
        z = np.hstack([x, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w[:-1], float(w[-1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


@dataclass
class Chain:
    names: list[str]
    columns: dict[str, int]
    models: list[Linear] = field(default_factory=list)

    @classmethod
    def fit(cls, names: list[str], columns: dict[str, int], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        chain, earlier = cls(names, columns), np.zeros((len(x), 0))
        for k in range(len(names)):
            seen = np.hstack([x, earlier])
            out = np.zeros(len(x))
            for f in range(FOLDS):
                test = fold == f
                out[test] = Linear.fit(seen[~test], y[~test, k]).predict(seen[test])
            chain.models.append(Linear.fit(seen, y[:, k]))
            earlier = np.hstack([earlier, out[:, None]])
        return chain

    def rows(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.columns)))
        for i, t in enumerate(texts):
            x[i, [self.columns[f] for f in features_of(t) & self.columns.keys()]] = 1
        return x

    def predict(self, texts: list[str]) -> np.ndarray:
        x = self.rows(texts)
        for model in self.models:
            x = np.hstack([x, model.predict(x)[:, None]])
        return x[:, len(self.columns) :]


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = 4000, per_category: int = 150) -> Chain:
    """A chain fitted on at most ``sample`` labelled documents, chosen by a hash of their ids.

    Per category, the ``per_category`` features whose rates differ most between its documents and the others (in
    standard errors, over 4) become columns. Of several texts of one id the least counts. Labels with a null id, quality or toxic are left out; of several labels of one
    document the largest counts. Without labelled documents every probability is about 0.
    """
    names = list(CATEGORIES)
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.expr(f"int({e})")).alias(k) for k, e in CATEGORIES.items()])
    some = cut(one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(some), "doc_id")  # at most `sample` rows are sent
    rows = cut(rows.groupBy("doc_id", *names).agg(F.min("text").alias("text")))  # of a repeated id, always the same text
    sizes = rows.agg(F.count(F.lit(1)), *[F.sum(k) for k in names]).first()
    n, positive = sizes[0], [x or 0 for x in sizes[1:]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, each = Counter(), [Counter() for _ in names]
        for b in batches:
            for t, *y in zip(b.column("text").to_pylist(), *[b.column(k).to_pylist() for k in names], strict=True):
                found = features_of(t)
                total.update(found)
                for c, v in zip(each, y, strict=True):
                    if v:
                        c.update(found)
        keys = [k for k in total if any(c[k] for c in each)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k] for k in keys], pa.int64()), *[pa.array([c[k] for k in keys], pa.int64()) for c in each]], names=["feature", "n", *names])

    counted = rows.mapInArrow(count, "feature string, n long, " + ", ".join(f"{k} long" for k in names))
    counted = counted.groupBy("feature").agg(*[F.sum(k).alias(k) for k in ("n", *names)]).where("n >= 3")
    chosen: set[str] = set()
    counted = cut(counted)
    for name, pos in zip(names, positive, strict=True):
        if 0 < pos < n:
            a, b = F.col(name) / pos, (F.col("n") - F.col(name)) / (n - pos)
            rate = F.col("n") / n
            z = (a - b) / F.sqrt(rate * (1 - rate) * (1 / pos + 1 / (n - pos)) + 1e-12)
            # Features without any hit among positives are not counted, so what tells a category apart is what it has.
            chosen.update(r[0] for r in counted.withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "feature").limit(per_category).select("feature").collect())
    columns = {f: i for i, f in enumerate(sorted(chosen))}
    empty = Chain(names, columns)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [sorted(columns[f] for f in features_of(t) & columns.keys()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(on, pa.list_(pa.int32())), *[b.column(k).cast(pa.int32()) for k in names]], names=["doc_id", "on", *names])

    got = rows.mapInArrow(dense, "doc_id long, on array<int>, " + ", ".join(f"{k} int" for k in names)).toPandas().sort_values("doc_id")
    x = np.zeros((len(got), len(columns)))
    for i, on in enumerate(got["on"]):
        x[i, list(on)] = 1
    fold = (got["doc_id"].to_numpy() * 2654435761 >> 8) % FOLDS
    return Chain.fit(names, empty.columns, x, got[names].to_numpy(float), fold)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``rejected`` (``p_toxic`` of ``threshold`` or more).

    Every row is scored on its whole text, null as empty; a text without known features gets the models' base rate. Row
    by row: repeated rows get equal results, no rows give none; other columns pass through, but those of the results' names
    are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most 150 features a category

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 512):
            out += list(sent.value.predict(texts.iloc[at : at + 512].tolist()))
        return pd.Series(out, dtype=object)

    name = "__p" + "_" * max(map(len, docs.columns))  # no column has that name
    held = docs.withColumn(name, probabilities(text_of(docs)))
    held = held.withColumns({f"p_{k}": F.col(name)[i] for i, k in enumerate(chain.names)}).drop(name)
    return held.withColumn("rejected", F.col("p_toxic") >= threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit_chain(docs, table(spark, sf_dir, "labels")))
    return out.drop("text")
