"""A capped search interface as a data source: one task for each range, no more than `cap` rows from any.

    spark.dataSource.register(CappedSource)
    spark.read.format("capped").option("table", path).option("day", "ts").option("cap", 30).option("ranges", json).load()

ranges is a JSON list of [first day, last day]. The rows of a range come in the order of the table's first column, as an
interface that shows the first page only gives them; `truncated` says that there are as many as the cap or more. table is a path or URI that pyarrow opens; each task reads only the
row groups that may hold days of its range.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ini string, fim string, key string, day string, truncated boolean"


class Range(InputPartition):
    def __init__(self, ini: str, fim: str):
        self.ini, self.fim = ini, fim


class CappedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.day, self.cap = options["table"], options["day"], int(options.get("cap", "30"))
        self.ranges = json.loads(options["ranges"])

    def partitions(self):
        return [Range(a, b) for a, b in self.ranges]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        data = ds.dataset(self.path)
        key, kind = data.schema.names[0], data.schema.field(self.day).type
        zone = ZoneInfo(kind.tz) if pa.types.is_timestamp(kind) and kind.tz else None

        def midnight(day: date):
            return pa.scalar(datetime(day.year, day.month, day.day, tzinfo=zone) if pa.types.is_timestamp(kind) else day, kind)

        ini, fim = date.fromisoformat(partition.ini), date.fromisoformat(partition.fim)
        inside = (ds.field(self.day) >= midnight(ini)) & (ds.field(self.day) < midnight(fim + timedelta(days=1)))
        first, n = None, 0
        # row groups outside of the range are not read, and no more than the cap and a batch are held
        for batch in data.to_batches(columns=[key, self.day], filter=inside):
            n += batch.num_rows
            rows = pa.Table.from_batches([batch])
            first = (rows if first is None else pa.concat_tables([first, rows])).sort_by(key).slice(0, self.cap)
        if first is not None:
            days = pc.strftime(first[self.day], format="%Y-%m-%d")
            for k, day in zip(first[key].to_pylist(), days.to_pylist(), strict=True):
                yield partition.ini, partition.fim, str(k), day, n >= self.cap


class CappedSource(DataSource):
    @classmethod
    def name(cls):
        return "capped"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CappedReader(self.options)
