"""The query layer over event tables: filters, pages, facets, series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import KIND_OF, PREFIX, PiiConfig, pseudonym_of

TEXT_COLUMNS = ("message", "raw_log", "host", "username", "source_ip", "url", "process")
MOST_ROWS = 10_000


@dataclass(frozen=True)
class EventQuery:
    text: str | None = None
    equal: dict[str, object] = field(default_factory=dict)
    any_ip: str | None = None
    within: tuple[str, list] | None = None
    since: str | None = None
    until: str | None = None
    descending: bool = True
    limit: int = 50
    offset: int = 0

    def predicate(self, columns: list[str]) -> Column:
        """All conditions that are set; text is a substring without regard to case, and its % and _ are plain."""
        found = F.lit(True)
        for name, value in self.equal.items():
            if value is not None:
                found = found & (F.col(name) == value)
        if self.text:
            hits = [F.contains(F.lower(F.col(c)), F.lower(F.lit(self.text))) for c in TEXT_COLUMNS if c in columns]
            found = found & F.coalesce(F.exists(F.array(*[F.coalesce(h, F.lit(False)) for h in hits]), lambda x: x), F.lit(False))
        if self.any_ip:
            found = found & (F.coalesce(F.col("source_ip") == self.any_ip, F.lit(False)) | F.coalesce(F.col("destination_ip") == self.any_ip, F.lit(False)))
        if self.within and self.within[1]:
            found = found & F.col(self.within[0]).isin(*self.within[1])
        if self.since:
            found = found & (F.col("timestamp") >= F.lit(self.since).cast("timestamp"))
        if self.until:
            found = found & (F.col("timestamp") <= F.lit(self.until).cast("timestamp"))
        return found


def search(events: DataFrame, q: EventQuery, key: str = "event_id") -> DataFrame:
    """All rows that match."""
    return events.where(q.predicate(events.columns))


def page(events: DataFrame, q: EventQuery, key: str = "event_id") -> DataFrame:
    """A page of matches by time, nulls last, then key. The limit is kept within 1 and MOST_ROWS."""
    order = F.col("timestamp").desc_nulls_last() if q.descending else F.col("timestamp").asc_nulls_last()
    return search(events, q).orderBy(order, key).offset(max(0, q.offset)).limit(min(max(1, q.limit), MOST_ROWS))


def get(events: DataFrame, value, key: str = "event_id") -> DataFrame:
    return events.where(F.col(key) == value)


def pseudonymised(q: EventQuery, cfg: PiiConfig) -> tuple[EventQuery, list[str]]:
    """The query with raw identifiers replaced by the pseudonyms that the table holds, and notes on what changed."""
    if cfg.mode != "DETERMINISTIC_HASH":
        return q, []
    equal, notes = dict(q.equal), []
    for name, value in q.equal.items():
        kind = KIND_OF.get(name)
        if kind in cfg.kinds and isinstance(value, str) and not value.startswith(tuple(p + "_" for p in PREFIX.values())):
            equal[name] = pseudonym_of(value, kind, cfg)
            notes.append(f"{name} was searched by its pseudonym {equal[name]}")
    any_ip = pseudonym_of(q.any_ip, "ip", cfg) if q.any_ip and not q.any_ip.startswith("IP_") else q.any_ip
    return EventQuery(**{**q.__dict__, "equal": equal, "any_ip": any_ip}), notes


def facet(events: DataFrame, name: str, top: int = 20) -> DataFrame:
    """The most frequent values of a column."""
    return events.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def top_with_total(events: DataFrame, name: str, top: int = 5) -> DataFrame:
    """The most frequent values of a column (turn from 1), and as turn 0 a row without a value that counts all events and all values."""
    values = events.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = values.orderBy(F.desc("n"), "value").limit(top)
    from pyspark.sql import Window as W

    best = best.withColumn("turn", F.row_number().over(W.orderBy(F.desc("n"), "value")))  # `top` rows
    none = F.lit(None).cast("string")
    total = events.agg(F.count("*").alias("n"), F.count_distinct(name).alias("values")).select(F.lit(0).alias("turn"), none.alias("value"), "n", "values")
    return total.unionByName(best.select("turn", "value", "n", F.lit(None).cast("long").alias("values")))


def facets(events: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """The most frequent values of several columns from one aggregation (grouping sets)."""
    from pyspark.sql import Window as W

    sets = ", ".join(f"({n})" for n in names)
    rows = events.sparkSession.sql(
        f"SELECT {', '.join(f'grouping({n}) AS g_{n}' for n in names)}, {', '.join(names)}, count(*) AS n FROM {{events}} GROUP BY GROUPING SETS ({sets})", events=events.select(*names)
    )
    picked = F.coalesce(*[F.when(F.col(f"g_{n}") == 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(f"g_{n}") == 0, F.col(n).cast("string")) for n in names])
    rows = rows.select(picked.alias("field"), value.alias("value"), "n").where("value IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def timeseries(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Events per minute, hour or day; buckets without events are left out."""
    return events.where("timestamp IS NOT NULL").groupBy(F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


def distinct_values(events: DataFrame, name: str, top: int = 200) -> DataFrame:
    return events.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct().orderBy("value").limit(top)


def streamed(events: DataFrame, what: str = "all") -> DataFrame:
    """The events that a live view shows: all, those of high or critical severity ("severe"), or those about authentication ("auth")."""
    if what == "severe":
        return events.where(F.col("severity").isin("high", "critical"))
    return events.where(F.col("event_type").contains("auth")) if what == "auth" else events
