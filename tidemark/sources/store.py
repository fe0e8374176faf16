"""Tables kept by day and bucketed by member, of which a run reads and rewrites only what it needs.

A table is partitioned by its day column and bucketed by its key. A filter on the day prunes partitions, a
filter on one key prunes buckets, and a join by the key shuffles only the other side. Writing replaces
the days (or key buckets) that the new rows have and leaves all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import daily_state, features
from tidemark.operators.activity import FEEDS

BUCKETS = 8
# What a feed's day is taken from.
FEED_DAYS = {
    "sessions": "scheduled_at", "transactions": "transaction_date", "app_events": "event_timestamp",
    "ai_coach_chats": "timestamp", "email_events": "sent_at",
}


@dataclass
class DayTable:
    """A parquet table below ``path``, by ``day`` and, if it has a ``key``, bucketed by that.

    Number of buckets and key belong to the table: use the same ones whenever it is opened again.
    """

    spark: SparkSession
    path: str
    day: str
    key: str | None = None
    buckets: int = BUCKETS
    sort: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return "day_" + self.path.rstrip("/").replace(":", "_").replace("/", "_").replace("-", "_").replace(".", "_")

    def _known(self, df: DataFrame) -> None:
        """Registers the table with the schema of ``df``, if this session has not opened it yet."""
        if self.spark.catalog.tableExists(self.name):
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        bucketed = ""
        if self.key:
            order = ", ".join(f"`{c}`" for c in self.sort or (self.key,))
            bucketed = f"CLUSTERED BY (`{self.key}`) SORTED BY ({order}) INTO {self.buckets} BUCKETS"
        self.spark.sql(
            f"CREATE TABLE `{self.name}` ({columns}) USING parquet PARTITIONED BY (`{self.day}`) {bucketed} LOCATION '{self.path}'")

    def write(self, df: DataFrame) -> None:
        """Replaces the days that ``df`` has rows of; no other day is read or written."""
        ordered = df.select(*(c for c in df.columns if c != self.day), self.day)
        self._known(ordered)
        if self.key:
            # A task writes some days of some buckets, as many as fit a partition, not a bucket of the whole table.
            bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
            spread = ordered.withColumn("__bucket", bucket).hint("rebalance", "__bucket", self.day).drop("__bucket")
        else:
            spread = ordered.hint("rebalance", self.day)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            spread.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def read(self, first=None, last=None) -> DataFrame:
        """The rows of the days from ``first`` to ``last`` (either may be open); other days are not listed or read."""
        df = self.spark.table(self.name)
        if first is not None:
            df = df.filter(F.col(self.day) >= F.lit(first).cast("date"))
        return df if last is None else df.filter(F.col(self.day) <= F.lit(last).cast("date"))


class MemberStore:
    """Feeds, member state and panel by day, moved on by a daily run."""

    def __init__(self, spark: SparkSession, base: str, *, salt: str, buckets: int = BUCKETS):
        self.spark, self.base, self.salt = spark, base.rstrip("/"), salt
        self.feeds = {f: DayTable(spark, f"{self.base}/{f}", "feed_day") for f in FEEDS}
        self.state = DayTable(spark, f"{self.base}/member_state", "state_day", "member_id", buckets)
        self.panel = DayTable(
            spark, f"{self.base}/panel", "date_day", "hashed_member_id", buckets, ("home_studio_id", "hashed_member_id"))

    def add_feeds(self, tables: dict[str, DataFrame]) -> None:
        """Stores feeds by their days; a day that arrives again replaces the one before."""
        for name, table in self.feeds.items():
            table.write(tables[name].withColumn("feed_day", F.to_date(F.col(FEED_DAYS[name]))))

    def feed_days(self, members: dict[str, DataFrame], first, last) -> dict[str, DataFrame]:
        """The tables an operator takes: the member tables as given, and only these days of each feed."""
        return {**members, **{name: t.read(first, last).drop("feed_day") for name, t in self.feeds.items()}}

    def start(self, tables: dict[str, DataFrame], day) -> None:
        """The state of ``day`` from all history."""
        self.state.write(daily_state.initial_state(tables, day))

    def _last_state(self, before) -> tuple[DataFrame, Column | None]:
        """The newest state up to ``before``, and the first day it does not hold.

        A day without any state is not taken for one on which nothing had happened yet: what came since the newest
        state is read from the feeds. With none at all, that is their whole history (no first day).
        """
        days = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS `{self.state.name}`").collect()]
        newest = max((d for d in days if d <= str(before)), default=None)
        state = self.state.read(newest or before, newest or before)
        return state, None if newest is None else F.date_add(F.lit(newest).cast("date"), 1)

    def advance(self, members: dict[str, DataFrame], before, day) -> None:
        """Writes the state of ``day`` from the newest up to ``before`` and the days of the feeds since."""
        state, first = self._last_state(before)
        new = daily_state.member_activity(self.feed_days(members, first, day))
        self.state.write(daily_state.moved_on(state, new, day))

    def panel_after(self, members: dict[str, DataFrame], before, last) -> DataFrame:
        """The panel's rows of the days after ``before`` up to ``last``, from the newest state up to ``before``."""
        state, since = self._last_state(before)
        tables = self.feed_days(members, since, last)
        first = F.date_add(F.lit(before).cast("date"), 1)
        return daily_state.panel_rows(
            state, daily_state.since_joining(tables), tables, salt=self.salt, first=first, last=last)

    def panel_of(self, members: dict[str, DataFrame], day) -> DataFrame:
        """The panel's rows of a day from its own state; no feed is read."""
        return daily_state.panel_rows(self.state.read(day, day), None, members, salt=self.salt, first=day, last=day)

    def rebuild_panel(self, tables: dict[str, DataFrame]) -> None:
        self.panel.write(features.member_features_daily(tables, salt=self.salt))

    def member_history(self, hashed_member_id: str) -> DataFrame:
        """One member's panel rows; only that member's bucket is read."""
        return self.panel.read().filter(F.col("hashed_member_id") == F.lit(hashed_member_id))

    def studio_history(self, studio_id: str) -> DataFrame:
        """One studio's panel rows; files are sorted by studio, so row groups of others are passed over."""
        return self.panel.read().filter(F.col("home_studio_id") == F.lit(studio_id))


@dataclass
class KeyTable:
    """A parquet table in folders by a hash of its key; a change rewrites only the folders its keys fall in.

    ``buckets`` belongs to the table. A key is in one folder, whose rows are replaced by a dynamic
    partition overwrite, so a change that fails leaves the folders as they were.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("key_bucket")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.withColumn("key_bucket", self.bucket()).repartition("key_bucket").write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(self.path)

    def create(self, df: DataFrame) -> None:
        self._write(df, "errorifexists")

    def read(self, touched: list[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return (df if touched is None else df.filter(F.col("key_bucket").isin(touched))).drop("key_bucket")

    def change(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the touched folders by ``change(rows, new)``; gives the folders' numbers.

        ``new`` is read twice: pass a frame that gives the same rows each time.
        """
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        if touched:
            self._write(change(self.read(touched), new), "overwrite")
        return touched
