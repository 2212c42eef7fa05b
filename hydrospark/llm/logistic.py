"""Logistic regression over hashed features by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@dataclass
class Model:
    """Non-zero weights by bucket, and the intercept: all that scoring needs.

    ``pairs`` tells how many differences the fit was kept from reacting to.
    """

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float
    pairs: int = 0

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, dtype=np.float32)
        full[self.index] = self.weight
        return full


def fit(samples: list[tuple], bits: int, alpha: float, l1: float, l2: float = 0.0, epochs: int = 3, beta: float = 1.0, pair_penalty: float = 0.0) -> Model:
    """Weights after ``epochs`` passes over ``(label, indexes, values)``.

    The first index and value arrays are the text's own; each of the others is
    the difference between the features of two texts whose scores should be
    equal.  With ``pair_penalty``, that times the squared change of the linear
    score is added to the loss, so weights by which such texts differ shrink;
    its step is taken implicitly, so that a large penalty doesn't overshoot.
    Samples are taken in the order given.  Without samples, or with one class
    alone, the score is the share of label 1 smoothed by one half.
    """
    ones = sum(y for y, _, _ in samples)
    if not samples or ones in (0, len(samples)):
        share = (ones + 0.5) / (len(samples) + 1)
        return Model(bits, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), float(np.log(share / (1 - share))))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    def update(i, w, g):
        ni = n[i]
        z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
        n[i] = ni + g * g

    for _ in range(epochs):
        for y, indexes, values in samples:
            (i, v), *apart = zip(indexes, values, strict=True)
            w = weights(z[i], n[i])
            bias = -zb / ((beta + nb**0.5) / alpha)
            score = float(w @ v) + bias
            off = 1 / (1 + np.exp(-min(35.0, max(-35.0, score)))) - y
            update(i, w, off * v)
            new = nb + off * off
            zb, nb = zb + off - (new**0.5 - nb**0.5) / alpha * bias, new
            for moved, change in apart if pair_penalty else []:
                w = weights(z[moved], n[moved])
                if shift := float(w @ change):
                    reach = float(change * change @ (alpha / (beta + np.sqrt(n[moved]))))  # of a step of size one
                    update(moved, w, 2 * pair_penalty * shift / (1 + 2 * pair_penalty * reach) * change)
    w = weights(z, n)
    kept = np.flatnonzero(w)
    pairs = sum(len(indexes) - 1 for _, indexes, _ in samples) if pair_penalty else 0
    return Model(bits, kept, w[kept].astype(np.float32), -zb / ((beta + nb**0.5) / alpha), pairs)


def score_column(column, model: Model, features: Callable):
    """Probability of label 1 for every whole text, as sparse dot products; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = model.dense()
        for batch in batches:
            line = np.empty(len(batch))
            for at, text in enumerate(batch):
                i, v = features(text)
                line[at] = float(weight[i] @ v) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(line, -35, 35))))

    return score(column)
