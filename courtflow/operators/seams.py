"""Where pixels and models come in: a function of batches gives features to rows, everything after is tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], features: str, columns: list[str]) -> DataFrame:
    """rows with the columns that a model gives them more.

    load runs once a task, on the executor, and returns the model: a function of a batch (the given columns) that returns the features in
    the same order. Batches keep memory bounded.
    """
    kept, added = rows.columns, StructType.fromDDL(features)
    schema = StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            made = model(batch[columns])
            yield pd.concat([batch[kept], made[added.fieldNames()].set_axis(batch.index)], axis=1)

    return rows.mapInPandas(run, schema)


def without_model(rows: DataFrame, features: str, reason: str) -> DataFrame:
    """The same columns as null with the reason, where the model's runtime isn't there."""
    d = rows
    for f in StructType.fromDDL(features).fields:
        d = d.withColumn(f.name, F.lit(None).cast(f.dataType))
    return d.withColumn("model_reject_reason", F.lit(reason))


def persistent_changes(samples: DataFrame, key: str, bits: str, fps: float, frame: str = "frame_id", stable: float = 0.008, least: float = 0.014, reset: float = 0.05, hold: int = 3, seconds: float = 2.0) -> DataFrame:
    """(key, frame, change): where a bit fingerprint (array of 0 and 1) has persistently changed, with the share of bits that did.

    The last `hold` samples, within so many seconds, vote on each bit; if none of them differs from the vote by more than `stable`, it is
    steady. The first steady vote is the reference. A later one that differs by over `least` is a change, given by the middle sample's frame, and the new
    reference; one that differs by `reset` or more only is the new reference. After either, samples gather anew.

    Each reference depends on the one before, so a video folds in order; it holds `hold` samples at a time besides its rows.
    """
    kind = dict(samples.dtypes)

    def fold(video: pd.DataFrame) -> pd.DataFrame:
        video, reference, recent, out = video.sort_values(frame), None, [], []
        k = video[key].iloc[0]
        for f, x in zip(video[frame].tolist(), video[bits]):
            recent = [*recent, (f, np.asarray(x, np.int8))][-hold:]
            if len(recent) < hold or recent[-1][0] - recent[0][0] > int(seconds * fps):
                continue
            vote = (np.median(np.stack([b for _, b in recent]), axis=0) >= 0.5).astype(np.int8)
            if max(float((vote != b).mean()) for _, b in recent) > stable:
                continue
            moved = 0.0 if reference is None else float((vote != reference).mean())
            if reference is None:
                reference = vote
            elif moved > least:
                if moved < reset:
                    out.append((k, recent[hold // 2][0], moved))
                reference, recent = vote, []
        return pd.DataFrame(out, columns=[key, frame, "change"])

    return samples.groupBy(key).applyInPandas(fold, f"{key} {kind[key]}, {frame} {kind[frame]}, change double")
