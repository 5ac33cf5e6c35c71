"""A Python data source that asks for snapshots on a regular grid of times.

``spark.read.format("snapshots").options(start=..., end=..., every=...).load()`` plans one
partition per time; ``fetch`` is given by subclassing. The base class makes up vehicles.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class At(InputPartition):
    def __init__(self, ts: str):
        self.ts = ts


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[At]:
        at, end = (datetime.fromisoformat(self.options[k]) for k in ("start", "end"))
        step = timedelta(seconds=int(self.options.get("every", "3600")))
        out = []
        while at <= end:
            out.append(At(at.isoformat()))
            at += step
        return out

    def fetch(self, ts: datetime) -> list[tuple[str, float, float]]:
        """(id, longitude, latitude) at a time."""
        n = int(self.options.get("vehicles", "3"))
        return [(f"v{i}", float(i), ts.hour + i / 10) for i in range(n)]

    def read(self, partition: At):
        ts = datetime.fromisoformat(partition.ts)
        for row in self.fetch(ts):
            yield (ts, *row)


class SnapshotStream(DataSourceStreamReader):
    """The same grid as a stream: a trigger takes the times that are due, a partition for each, read by executors."""

    def __init__(self, options: dict):
        self.snapshots = SnapshotReader(options)
        self.times = [p.ts for p in self.snapshots.partitions()]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        return {"n": len(self.times)}

    def partitions(self, start: dict, end: dict) -> list[At]:
        return [At(ts) for ts in self.times[start["n"] : end["n"]]]

    def read(self, partition: At):
        return self.snapshots.read(partition)

    def commit(self, end: dict) -> None:
        pass


class Snapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "snapshot_time timestamp, id string, longitude double, latitude double"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SnapshotStream(self.options)
