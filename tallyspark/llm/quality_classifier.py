"""Quality scores by Bradley-Terry pairwise ranking.

Every training pair is a good and a bad labelled document; "the good one is better" has probability sigmoid(w . (x_good - x_bad)),
and w minimises the logistic loss over feature differences (ridge 1e-3, Newton steps). A document's score is its strength
w . x minus the quantile of the training strengths at the share of bad labels, through a sigmoid: 0.5 is that quantile.

Features are shares of the whole text, computed by DataFrame functions for every document; only the training rows (at most
`most_rows`, those of least hash, a documented bound) reach the driver, as a few numbers each.

Nulls and odd input: a null text is an empty one; rows with a null id or label teach nothing; of several labels for an id the
least counts; without labels of both kinds every score is 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, PARTNERS, SEED = 20_000, 8, 11


def features(text: Column) -> dict[str, Column]:
    """Name -> value in 0..1, high for what seldom is in prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.char_length(t)
    count = lambda kind: size - F.char_length(F.regexp_replace(t, kind, ""))
    blank = count(r"[\x20\x09-\x0D]+")
    solid, gaps = F.greatest(size - blank, F.lit(1)), F.greatest(blank + 1, F.lit(1))
    capped = lambda x, top: F.least(x / top, F.lit(1.0))
    return {
        "symbols": capped(count(r"[#*$%&<>]+") / solid, 0.1),
        "bars": capped(count(r"\|+") / gaps, 0.2),
        "upper": capped(count(r"[A-Z]+") / solid, 0.3),
        "bangs": capped(count("!+") / gaps, 0.2),
        "digits": capped(count(r"[0-9]+") / solid, 0.3),
        "stops": 1 - capped(count(r"[.,]+") / gaps, 0.1),
        "short": 1 - capped(gaps, 20.0),
        "long_words": capped(solid / gaps, 20.0),
    }


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds the share of words equal to the one before, of words seen before, and of lines seen before."""
    t = F.coalesce("text", F.lit(""))
    one = docs.withColumn("_w", F.split(t, r"[\x20\x09-\x0D]+", -1)).withColumn("_l", F.split(t, "\n", -1))
    w = F.col("_w")
    return one.withColumns({
        "same": F.least(F.size(F.filter(F.transform("_w", lambda x, i: F.get(w, i - 1) == x), lambda b: b)) / F.size("_w") / 0.2, F.lit(1.0)),
        "seen": 1 - F.size(F.array_distinct("_w")) / F.size("_w"),
        "seen_lines": 1 - F.size(F.array_distinct("_l")) / F.size("_l"),
    }).drop("_w", "_l")


def measured(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    found = features(F.col("text"))
    names = [*found, "same", "seen", "seen_lines"]
    return _repeats(docs).withColumns(found).drop("text"), names


def fit(x: np.ndarray, good: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """(weights, threshold, scale) from feature rows and labels: pairwise logistic loss on differences."""
    draw = np.random.default_rng(SEED)
    up, down = x[good], x[~good]
    if not len(up) or not len(down):
        return np.zeros(x.shape[1]), 0.0, 1.0
    n = partners * max(len(up), len(down))
    diff = up[draw.permutation(np.arange(n) % len(up))] - down[draw.permutation(np.arange(n) % len(down))]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w)), diff.T @ p / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    strength = x @ w
    return w, float(np.quantile(strength, (~good).mean())), 1.0


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, held_out, score, predicted. labels: id, quality; held_out: a condition on `doc_id`, whose rows teach nothing."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    taught = marked.where(~held_out).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most_rows)
    rows, names = measured(own.join(F.broadcast(taught), "doc_id"))
    table = rows.select("doc_id", "good", *names).toPandas().sort_values(["doc_id", *names]).drop_duplicates("doc_id")
    x = table[names].to_numpy(float).reshape(-1, len(names))
    w, cut, scale = fit(x, table["good"].to_numpy(bool))
    every, _ = measured(own)
    strength = F.lit(-cut)
    for name, weight in zip(names, w):
        strength = strength + F.col(name) * float(weight)
    score = 1 / (1 + F.exp(-strength / scale))
    return every.select(F.col("doc_id").alias(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
