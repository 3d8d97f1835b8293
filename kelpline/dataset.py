"""A dataset of recordings and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import episodes, stats, sync


@dataclass(frozen=True)
class Dataset:
    """Samples (recording_id, sensor, ts_us, value and others) of a set of recordings."""

    samples: DataFrame

    def recordings(self) -> DataFrame:
        return self.samples.select("recording_id").distinct()

    def __len__(self) -> int:
        return self.recordings().count()

    def sensors(self) -> DataFrame:
        return self.samples.groupBy("sensor").agg(F.count(F.lit(1)).alias("samples"))

    def only(self, *sensors: str) -> Dataset:
        return replace(self, samples=self.samples.where(F.col("sensor").isin(*sensors)))

    def merged(self, other: Dataset) -> Dataset:
        """Both datasets' recordings; of those with the same id, this one's."""
        new = other.samples.join(self.recordings(), "recording_id", "left_anti")
        return replace(self, samples=self.samples.unionByName(new))

    def synchronise(self, frequency: float = 0.0, **options) -> SyncedDataset:
        """On a common clock of ``frequency`` Hz; 0: a step for every time of a stream."""
        if frequency < 0:
            raise ValueError("the frequency must not be negative")
        period = round(1e6 / frequency) if frequency else None
        return SyncedDataset(sync.synchronise(self.samples, period, **options))


@dataclass(frozen=True)
class SyncedDataset:
    """Rows (recording_id, sensor, step, grid_us, src_us, value)."""

    rows: DataFrame

    def statistics(self, exact: bool = True) -> DataFrame:
        return stats.dataset_statistics(self.rows, ["sensor"], exact=exact)

    def wide(self, sensors: list[str]) -> DataFrame:
        """A row a step with a column a sensor."""
        return sync.wide(self.rows, sensors)

    def step(self, index: int) -> DataFrame:
        """One step of each recording and sensor, counted from the end if negative."""
        return episodes.element(self.rows, ["recording_id", "sensor"], ["step"], index)

    def windows(self, horizon: int, targets: list[str]) -> DataFrame:
        """Each step but the last with the values that follow it, padded at the end.

        ``targets``: sensors whose own value counts as the first.
        """
        by = ["recording_id", "sensor"]
        split = [(self.rows.where(F.col("sensor").isin(targets)), True), (self.rows.where(~F.col("sensor").isin(targets)), False)]
        a, b = (episodes.action_chunks(df, by, ["step"], "value", horizon, target) for df, target in split)
        return episodes.drop_last_frame(a.unionByName(b), by, ["step"])
