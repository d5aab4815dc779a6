"""From raw transactions to training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from txrisk.operators.clean import clean
from txrisk.operators.features import derive, encode, large_amount_threshold
from txrisk.operators.ranks import seeded_sample, temporal_split
from txrisk.session import reliable


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame  # features, label and ``part``
    large_amount: float

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("part") == name)


def prepare(tx: DataFrame, sample_rows: int | None = None, scope: str = "train", key: str = "event_id",
            durable: bool = True) -> Prepared:
    """Sample, clean, encode, derive and split by time.

    ``scope='train'`` fits the large-amount threshold on the training part only;
    ``scope='table'`` fits it on all rows before the split. The rows are read by
    many training jobs, so they are made durable once.
    """
    rows = tx if sample_rows is None else seeded_sample(tx, key, sample_rows)
    rows = clean(rows)
    if durable:
        rows = reliable(rows)
    split = temporal_split(rows, key=key)
    fitted_on = split.filter(F.col("part") == "train") if scope == "train" else split
    threshold = large_amount_threshold(fitted_on)
    made = derive(encode(split), threshold)
    # The features are stored too, or every training pass would derive them again.
    return Prepared(reliable(made) if durable else made, threshold)
