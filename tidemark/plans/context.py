"""Frames derived from the bound tables, built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.expressions import salted_hash
from tidemark.operators import (
    activity, engagement, features, identity, lifecycle, model, outcomes, revenue, scoring, winback,
)
from tidemark.session import checkpointed, shuffled
from tidemark.sources import bindings as B
from tidemark.sources.store import MemberStore
from tidemark.streaming.runner import scratch_dir

# The moment the routers and guards are checked at.
NOW = "2024-01-28 12:00:00"
# Fixed value: the day whose state the daily runs start from.
STORED_DAY = "2024-01-25"


class Frames:
    """Everything the registered queries read, for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        """A frame as a table that is written once a session, as a nightly run leaves it to the reports."""
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def t(self) -> dict[str, DataFrame]:
        return B.activity_domain(self.spark, self.sf_dir)

    @cached_property
    def as_of(self) -> Column:
        return activity.as_of_column(self.t)

    @cached_property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp_ntz")

    @cached_property
    def identity(self) -> DataFrame:
        return identity.member_identity(self.t["members"], B.SALT)

    @cached_property
    def panel(self) -> DataFrame:
        return features.member_features_daily(self.t, salt=B.SALT)

    @cached_property
    def store(self) -> MemberStore:
        """Feeds by day and the member state of ``STORED_DAY``, as a daily run finds them; written once a session."""
        store = MemberStore(self.spark, scratch_dir(self.spark, "members"), salt=B.SALT)
        store.add_feeds(self.t)
        store.start(self.t, STORED_DAY)
        return store

    @cached_property
    def daily_run(self) -> DataFrame:
        """The panel's rows of the days after ``STORED_DAY``."""
        return self.store.panel_after(self.t, STORED_DAY, self.as_of)

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel as a table by day, bucketed by member; written once a session."""
        self.store.rebuild_panel(self.t)
        return self.store.panel.read()

    def member_days(self, days_before: int = 0) -> DataFrame:
        return features.member_features_snapshot(self.t, salt=B.SALT, as_of=F.date_sub(self.as_of, days_before))

    @cached_property
    def snapshot(self) -> DataFrame:
        return self._kept("member-day", self.member_days())

    @cached_property
    def snapshot_before(self) -> DataFrame:
        return self._kept("member-day-before", self.member_days(7))

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.with_risk_tier(B.stand_in_scores(self.snapshot))

    @cached_property
    def scored_panel(self) -> DataFrame:
        """Every panel row with a stand-in probability, its label and a unique hashed key."""
        key = F.sha2(F.concat("hashed_member_id", F.date_format("date_day", "yyyy-MM-dd")), 256)
        p = F.conv(F.left("row_key", F.lit(4)), 16, 10).cast("double") / 65535.0
        return self.panel.withColumn("row_key", key).select(
            "row_key", "hashed_member_id", "date_day", "gender", "home_studio_id",
            p.alias("churn_probability"), F.col("is_churned_14d").alias("actual"),
        )

    def stages(self, snapshot: DataFrame, day: Column) -> DataFrame:
        scores = scoring.with_risk_tier(B.stand_in_scores(snapshot))
        return lifecycle.lifecycle_stage(
            snapshot, scores, self.t["ground_truth"], self.t["memberships"], self.identity, as_of=day)

    @cached_property
    def life_now(self) -> DataFrame:
        return self._kept("stages", self.stages(self.snapshot, self.as_of))

    @cached_property
    def life_before(self) -> DataFrame:
        prior = self.stages(self.snapshot_before, F.date_sub(self.as_of, 7))
        return self._kept("stages-before", lifecycle.stage_transition(prior, None))

    @cached_property
    def lifecycle(self) -> DataFrame:
        return lifecycle.stage_transition(self.life_now, self.life_before)

    @cached_property
    def life_history(self) -> DataFrame:
        cols = ["hashed_member_id", "member_id", "home_studio_id", "monthly_price", "stage", "snapshot_date"]
        return self.life_before.select(*cols).unionByName(self.life_now.select(*cols))

    @cached_property
    def engagement(self) -> DataFrame:
        return engagement.engagement_score(self.snapshot, self.scores, as_of=self.as_of)

    @cached_property
    def audit(self) -> DataFrame:
        return B.audit_domain(self.spark, self.sf_dir, self.identity)

    def intervention_outcomes(self) -> DataFrame:
        return outcomes.intervention_outcomes(
            self.audit, self.t["sessions"], self.t["transactions"], self.t["ground_truth"])

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._kept("outcomes", self.intervention_outcomes())

    @cached_property
    def treated(self) -> DataFrame:
        return revenue.treated_members(self.outcomes, self.life_now)

    @cached_property
    def lifetime(self) -> DataFrame:
        return revenue.avg_lifetime_months(self.orders["members"], self.orders["ground_truth"])

    @cached_property
    def order_history(self) -> DataFrame:
        """Order years as snapshots: a year without orders is cancelled, with orders engaged."""
        years = self.raw("orders").select(
            F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).distinct()
        bounds = years.agg(F.sequence(F.min("y"), F.max("y"))).scalar()
        axis = self.raw("customer").select(
            F.col("c_custkey").alias("k"), "c_nationkey", F.explode(bounds).alias("y"))
        return axis.join(shuffled(years.withColumn("hit", F.lit(1))), ["k", "y"], "left").select(
            F.sha2(F.col("k").cast("string"), 256).alias("hashed_member_id"),
            F.col("k").cast("string").alias("member_id"),
            B.studio_id(F.col("c_nationkey")).alias("home_studio_id"),
            F.lit(59.0).alias("monthly_price"),
            F.when(F.col("hit") == 1, "engaged").otherwise("cancelled").alias("stage"),
            F.make_date("y", F.lit(12), F.lit(31)).alias("snapshot_date"))

    @cached_property
    def reactivations(self) -> DataFrame:
        return winback.observed_reactivations(self.order_history)

    @cached_property
    def board(self) -> DataFrame:
        return winback.winback_leaderboard(self.reactivations)

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        """Training and validation rows of one window, which is materialised once for the split, the fits and their metrics."""
        return model.chronological_split(checkpointed(model.training_window(self.panel, as_of=self.as_of)))

    @cached_property
    def model_path(self) -> str:
        """Where the boosted trees, calibrated on the validation rows, are saved; trained once for all queries."""
        train, held = self.split
        path = scratch_dir(self.spark, "churn-model")
        model.calibrate_isotonic(model.train_churn_gbt(train), held).save(path)
        return path

    @cached_property
    def trained(self) -> model.ChurnModel:
        return model.ChurnModel.load(self.model_path)

    @cached_property
    def orders(self) -> dict[str, DataFrame]:
        return B.order_domain(self.spark, self.sf_dir)

    @cached_property
    def auth(self) -> DataFrame:
        return B.auth_domain(self.spark, self.sf_dir)

    @cached_property
    def people(self) -> tuple[DataFrame, DataFrame]:
        return B.identity_domain(self.spark, self.sf_dir)

    @cached_property
    def auth_chain(self) -> DataFrame:
        """Auth records with a previous-hash column derived from the line number."""
        return self.auth.select(
            (F.col("line") + 1).alias("seq"), "event", "outcome", "username", "source", "reason",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            salted_hash(F.col("line").cast("string"), "-prev").alias("prev_hash"),
        )
