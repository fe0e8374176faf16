"""Bind the star-schema test tables to the membership tables.

Every row of the bound source is used; keys drive the made-up attributes by
integer arithmetic so that any SQL engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import shuffled
from tidemark.sources.tables import read_table

SALT = "tidemark-check-salt"
HOLDOUT_SALT = "tidemark-check-holdout"


def _member_id(key: Column) -> Column:
    return F.concat(F.lit("M"), F.lpad(key.cast("string"), 10, "0"))


def studio_id(key: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 2, "0"))


def _pick(index: Column, labels: list[str]) -> Column:
    chain = F.when(index == 0, labels[0])
    for i, label in enumerate(labels[1:-1], 1):
        chain = chain.when(index == i, label)
    return chain.otherwise(labels[-1])


def _tier() -> Column:
    seg = F.col("c_mktsegment")
    return (
        F.when(seg.isin("BUILDING", "AUTOMOBILE"), "Basic")
        .when(seg.isin("MACHINERY", "HOUSEHOLD"), "VIP")
        .otherwise("Premium")
    )


def _price() -> Column:
    return F.when(_tier() == "Basic", 59.0).when(_tier() == "VIP", 99.0).otherwise(129.0)


def activity_domain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as members, the event stream as their daily activity."""
    k = F.col("c_custkey")
    customer = read_table(spark, sf_dir, "customer")
    events = read_table(
        spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]
    )
    nation = read_table(spark, sf_dir, "nation")
    yes = F.lit(True).alias("is_synthetic")
    base_day = F.lit("2023-11-01").cast("date")
    join_date = F.when(k % 25 == 0, F.lit("2023-08-01").cast("date")).otherwise(
        F.date_add(base_day, (k * 7 % 80).cast("int"))
    )
    churn_date = F.when(
        k % 5 == 0,
        F.when(k % 25 == 0, F.lit("2023-10-15").cast("date")).otherwise(
            F.greatest(
                F.date_add(join_date, 10),
                F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")),
            )
        ),
    )
    members = customer.select(
        _member_id(k).alias("member_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.test")).alias("email"),
        F.concat(
            F.lit("555-"), F.lpad((k % 900 + 100).cast("string"), 3, "0"),
            F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"),
        ).alias("phone"),
        _pick(k % 3, ["F", "M", "Other"]).alias("gender"),
        F.date_add(F.lit("1960-01-01").cast("date"), (k * 37 % 14000).cast("int")).alias("dob"),
        studio_id(F.col("c_nationkey")).alias("home_studio_id"),
        join_date.alias("join_date"),
        yes,
    )
    ground_truth = customer.select(
        _member_id(k).alias("member_id"),
        _pick(k % 3, ["steady", "declining", "sudden_drop"]).alias("cohort"),
        (k % 5 == 0).alias("churned"),
        churn_date.alias("churn_date"),
        _pick(k % 4, ["low", "medium", "high", "critical"]).alias("churn_risk"),
        yes,
    )
    memberships = customer.select(
        F.concat(F.lit("MB"), F.lpad(k.cast("string"), 10, "0")).alias("membership_id"),
        _member_id(k).alias("member_id"),
        studio_id(F.col("c_nationkey")).alias("studio_id"),
        _tier().alias("membership_tier"),
        _price().alias("monthly_price"),
        join_date.alias("start_date"),
        churn_date.alias("end_date"),
        F.when(k % 5 == 0, "Cancelled").otherwise("Active").alias("status"),
        yes,
    )
    e = F.col("event_id")
    who = _member_id(F.col("user_id")).alias("member_id")
    studio = studio_id(F.col("user_id") % 25).alias("studio_id")

    def of(kind: str) -> DataFrame:
        return events.filter(F.col("event_type") == kind)

    def code(prefix: str) -> Column:
        return F.concat(F.lit(prefix), e.cast("string"))

    return {
        "studios": nation.select(
            studio_id(F.col("n_nationkey")).alias("studio_id"),
            F.col("n_name").alias("studio_name"),
            F.lit(None).cast("string").alias("address"),
            F.lit(None).cast("string").alias("city"),
            studio_id(F.col("n_regionkey")).alias("state"),
            F.lit(None).cast("string").alias("zip_code"),
            yes,
        ),
        "members": members,
        "ground_truth": ground_truth,
        "memberships": memberships,
        "sessions": of("view").select(
            code("SE").alias("session_id"), who, studio,
            F.lit("class").alias("session_type"),
            F.col("ts").alias("scheduled_at"),
            (e % 10 != 0).alias("attended"),
            (F.lit(120.0) + e % 11).alias("sauna_temp_f"),
            yes,
        ),
        "transactions": of("purchase").select(
            code("TX").alias("transaction_id"), who, studio,
            F.to_date("ts").alias("transaction_date"),
            F.col("value").alias("amount"),
            F.when(e % 3 == 0, "Membership Fee").otherwise("Retail - Item").alias("transaction_type"),
            F.when(e % 7 == 0, "Failed").otherwise("Paid").alias("status"),
            yes,
        ),
        "app_events": of("click").select(
            code("EV").alias("event_id"), who,
            F.when(e % 4 == 0, "view_metrics").otherwise("open_app").alias("event_type"),
            F.col("ts").alias("event_timestamp"),
            F.when(e % 2 == 0, "ios").otherwise("android").alias("device_os"),
            yes,
        ),
        "ai_coach_chats": of("error").select(
            code("CH").alias("chat_id"), who,
            F.col("ts").alias("timestamp"),
            F.when(e % 2 == 0, "member").otherwise("coach").alias("sender"),
            F.when(e % 5 == 0, "How do I CANCEL my plan?").otherwise("Thanks").alias("message_text"),
            yes,
        ),
        "email_events": of("signup").select(
            code("EM").alias("email_id"), who,
            F.lit("News").alias("subject"),
            F.col("ts").alias("sent_at"),
            _pick(e % 3, ["Sent", "Opened", "Clicked"]).alias("status"),
            yes,
        ),
    }


def stand_in_scores(snapshot: DataFrame) -> DataFrame:
    """A uniform probability from the hashed id: input data for checks, not a model."""
    p = F.conv(F.left(F.sha2("hashed_member_id", 256), F.lit(4)), 16, 10).cast("double") / 65535.0
    return snapshot.select(
        "hashed_member_id", F.col("date_day").alias("score_date"), p.alias("churn_probability")
    )


def audit_domain(spark: SparkSession, sf_dir: str, identity: DataFrame) -> DataFrame:
    """Each signup event as one dispatched intervention; holdout is decided per member."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = read_table(
        spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]
    ).filter(F.col("event_type") == "signup")
    tier = _pick(e % 4, ["Low", "Medium", "High", "Critical"])
    return rows.withColumn("member_id", _member_id(u)).join(
        shuffled(identity.select("member_id", "hashed_member_id")), "member_id"
    ).select(
        F.concat(F.lit("AU"), e.cast("string")).alias("audit_id"),
        "member_id",
        "hashed_member_id",
        F.col("ts").alias("sent_at"),
        _pick(e % 5, ["Email", "SMS", "Call", "WinBackEmail", "Push"]).alias("action_type"),
        F.when(u % 7 == 0, "Holdout").when(e % 2 == 0, "Sent").otherwise("DryRun").alias("status"),
        F.concat(F.lit("Score: 0.5 | Tier: "), tier).alias("why_score"),
        F.lit("").alias("message_body"),
        F.lit("").alias("error_message"),
    )


def auth_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as sign-in attempts: errors fail, signups succeed, the rest lock out."""
    return auth_events(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]))


def auth_events(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rows.select(
        F.col("event_id").alias("line"),
        F.col("ts"),
        F.lit("auth").alias("event"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.when(kind == "error", "failure").when(kind == "signup", "success").otherwise("lockout").alias("outcome"),
        F.when(F.col("user_id") % 4 == 0, "unknown").otherwise(
            F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string"))
        ).alias("source"),
        kind.alias("reason"),
    )


def order_domain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as members over the whole order history; the last order is the churn date."""
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    customer = read_table(spark, sf_dir, "customer")
    cut = F.lit("2001-02-01").cast("date")
    spans = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.to_date(F.min("o_orderdate")).alias("join_date"),
        F.to_date(F.max("o_orderdate")).alias("last_date"),
    )
    joined = customer.join(spans, "c_custkey")
    member = _member_id(F.col("c_custkey")).alias("member_id")
    gone = F.col("last_date") < cut
    return {
        "members": joined.select(
            member, "join_date", studio_id(F.col("c_nationkey")).alias("home_studio_id"),
            _price().alias("monthly_price"),
        ),
        "ground_truth": joined.select(
            member,
            _pick(F.col("c_custkey") % 3, ["steady", "declining", "sudden_drop"]).alias("cohort"),
            gone.alias("churned"),
            F.when(gone, F.col("last_date")).alias("churn_date"),
        ),
        "as_of": orders.agg(F.to_date(F.max("o_orderdate")).alias("as_of_date")),
    }


def identity_domain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Point-of-sale and app registrations of the same people, with noisy contacts.

    Customers with a negative balance have no app account, suppliers have only one.
    Names come from part and nation, so they collide and the contact rules matter.
    """
    k = F.col("c_custkey")
    people = (
        read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
        .join(shuffled(read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])),
              F.col("p_partkey") == k, "left")
        .join(F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])),
              F.col("n_nationkey") == F.col("c_nationkey"))
        .withColumn("full_name", F.concat_ws(" ", "p_name", "n_name"))
        .withColumn("local", F.lower(F.replace("c_name", F.lit("#"), F.lit("."))))
        .withColumn("area", F.lpad((k % 900 + 100).cast("string"), 3, "0"))
        .withColumn("tail", F.lpad((k % 10000000).cast("string"), 7, "0"))
    )
    pos = people.select(
        _member_id(k).alias("member_id"),
        k.alias("row_order"),
        F.col("full_name").alias("name"),
        F.concat("local", F.lit("@example.test")).alias("email"),
        F.concat(F.lit("+1 "), "area", F.lit("-"), "tail").alias("phone"),
    )
    app = people.filter(F.col("c_acctbal") >= 0).select(
        F.concat(F.lit("A"), F.lpad(k.cast("string"), 10, "0")).alias("app_member_id"),
        k.alias("row_order"),
        F.when(k % 8 == 0, F.concat("full_name", F.lit(" Jr."))).otherwise(F.col("full_name")).alias("name"),
        F.when(k % 6 == 0, None)
        .when(k % 4 == 0, F.concat("local", F.lit("@mail.test")))
        .otherwise(F.concat(F.upper("local"), F.lit("@EXAMPLE.TEST "))).alias("email"),
        F.when(k % 9 == 0, None)
        .when(k % 10 == 0, F.concat("area", F.lit("9"), F.substring("tail", 2, 6)))
        .otherwise(F.concat("area", "tail")).alias("phone"),
    )
    s = F.col("s_suppkey")
    extra = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]).select(
        F.concat(F.lit("B"), F.lpad(s.cast("string"), 10, "0")).alias("app_member_id"),
        (s + 1_000_000_000).alias("row_order"),
        F.col("s_name").alias("name"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@supply.test")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
    )
    return pos, app.unionByName(extra)


def chat_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as coach chats ordered by turn."""
    role = F.col("role")
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("member_key"),
        F.col("turn"),
        F.when(role == "user", "member").when(role == "assistant", "coach").otherwise(role).alias("sender"),
        F.col("text").alias("message_text"),
    )
