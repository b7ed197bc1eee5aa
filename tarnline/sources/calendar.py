"""A Python data source: days of a range, dealt over partitions of a bounded number of days."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Days(InputPartition):
    def __init__(self, first: date, n: int):
        self.first, self.n = first, n


class CalendarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.step = int(options.get("days", "366"))
        if self.end < self.start or self.step < 1:
            raise ValueError("end must not lie before start, nor days below 1")

    def partitions(self) -> list[Days]:
        n = (self.end - self.start).days + 1
        return [Days(self.start + timedelta(a), min(self.step, n - a)) for a in range(0, n, self.step)]

    def read(self, partition: Days) -> Iterator[tuple]:
        for k in range(partition.n):
            d = partition.first + timedelta(k)
            yield d, d.year, d.month, d.isoweekday(), d.isoweekday() > 5


class Calendar(DataSource):
    """format("calendar") with options start, end (ISO dates, both included) and days a partition."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, year int, month int, weekday int, weekend boolean"

    def reader(self, schema) -> CalendarReader:
        return CalendarReader(self.options)
