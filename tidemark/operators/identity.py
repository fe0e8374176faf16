"""Member identity: hashing, contact normalisation and cross-system matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import similarity
from tidemark.functions.expressions import (
    normalize_email, normalize_name, normalize_phone, salted_hash,
)
from tidemark.functions.ranking import in_ranges, row_number_in_ranges
from tidemark.session import checkpointed, shuffled


def member_identity(members: DataFrame, salt: str) -> DataFrame:
    """The lookup from raw member id to hashed id; holds contact data, so keep it restricted."""
    return members.select(
        "member_id", salted_hash(F.col("email"), salt).alias("hashed_member_id"),
        "name", "email", "phone",
    )


def normalize_contacts(
    df: DataFrame, *, fold_gmail: bool = False, strip_suffixes: bool = False
) -> DataFrame:
    return df.withColumns(
        {
            "norm_email": normalize_email(F.col("email"), fold_gmail),
            "norm_phone": normalize_phone(F.col("phone")),
            "norm_name": normalize_name(F.col("name"), strip_suffixes),
        }
    )


# --- name similarity ----------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Over two columns of names without spaces; the prefix boost always applies."""
    return pd.Series([similarity.similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def _compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity ignoring case and whitespace."""
    return _similarity_udf(_compact(a), _compact(b))


# Letters from frequent to rare, and stand-ins that sort the other way round.
_FREQUENT_FIRST = "etaoinshrdlucmfgypwbvkjxqz"
_SORTS_LAST_FIRST = "zyxwvutsrqponmlkjihgfedcba"


_MOST_LETTERS = 999_999_999


def _tokens(name: Column) -> Column:
    """Letters numbered by occurrence, rarest first.

    The numbering makes a set intersection count repeated letters; later
    occurrences and rare letters sort to the front.
    """
    chars = F.split(F.translate(name, _FREQUENT_FIRST, _SORTS_LAST_FIRST), "")
    numbered = F.transform(
        chars,
        lambda ch, i: F.concat(
            F.lpad((_MOST_LETTERS - F.size(F.filter(F.slice(chars, 1, i), lambda x: x == ch))).cast("string"), 9, "0"), ch
        ),
    )
    return F.array_sort(numbered)


def _similarity_bound(a: str, b: str) -> Column:
    """Upper bound of the similarity from lengths, shared letters and shared prefix."""
    la, lb = F.length(a), F.length(b)
    shared = F.size(F.array_intersect(f"{a}_tokens", f"{b}_tokens"))
    jaro = (shared / la + shared / lb + 1.0) / 3.0
    prefix = F.lit(0)
    for n in (1, 2, 3, 4):
        same = (F.left(F.col(a), F.lit(n)) == F.left(F.col(b), F.lit(n))) & (la >= n) & (lb >= n)
        prefix = prefix + F.when(same, 1).otherwise(0)
    return F.when((la == 0) | (lb == 0), F.when(la == lb, 1.0).otherwise(0.0)).otherwise(
        jaro + prefix * 0.1 * (1.0 - jaro)
    )


# --- matching ------------------------------------------------------------------

def _pair_by_key(pos: DataFrame, app: DataFrame, keys: list[str]) -> DataFrame:
    """The i-th POS row and the i-th app row with the same keys, by ``row_order``; both have its ranges."""
    left = row_number_in_ranges(pos, keys, "row_order", "__range", out="nth").select(*keys, "nth", "member_id")
    right = row_number_in_ranges(app, keys, "row_order", "__range", out="nth").select(*keys, "nth", "app_member_id")
    return left.join(shuffled(right), [*keys, "nth"]).select("member_id", "app_member_id")


def _with(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key) != "")


def _without(df: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return df.join(shuffled(matches.select(key)), key, "left_anti")


def match_exact_contacts(
    pos: DataFrame, app: DataFrame, *, shared_email_guard: bool = False, **contact_options
) -> DataFrame:
    """Layers 1 and 2: exact email, then exact phone; columns member_id, app_member_id, layer.

    Pairing by position inside a key gives each app record to one POS record in
    row order without listing all pairs, however many rows share the key.
    """
    pos, app = normalize_contacts(pos, **contact_options), normalize_contacts(app, **contact_options)
    pos = in_ranges(pos.select("member_id", "row_order", "norm_email", "norm_phone"), "row_order", out="__range")
    app = in_ranges(app.select("app_member_id", "row_order", "norm_email", "norm_phone"), "row_order", out="__range")
    by_email = pos
    if shared_email_guard:
        shared = (
            pos.filter(F.col("norm_email") != "").groupBy("norm_email").count().filter("count > 1")
        )
        by_email = _without(pos, shared, "norm_email")
    email = checkpointed(_pair_by_key(_with(by_email, "norm_email"), _with(app, "norm_email"), ["norm_email"]))
    phone = _pair_by_key(
        _with(_without(pos, email, "member_id"), "norm_phone"), _with(_without(app, email, "app_member_id"), "norm_phone"),
        ["norm_phone"],
    )
    return email.withColumn("layer", F.lit("email")).unionByName(
        phone.withColumn("layer", F.lit("phone"))
    )


def _blocks(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(block, name, key, order, home) of each record: one row for its email and one for its area, ``home`` is the area block."""
    local = F.substring_index("norm_email", "@", 1)
    area = F.when(F.col("norm_phone") != "", F.concat(F.lit("p:"), F.substring("norm_phone", 1, 3)))
    return df.withColumn("home", area).withColumn(
        "block",
        F.explode(F.array_compact(F.array(
            F.when(F.col("norm_email") != "", F.concat(F.lit("e:"), local)), F.col("home"),
        ))),
    ).select("block", _compact(F.col("norm_name")).alias(name), key, F.col("row_order").alias(order), "home")


# Rows of a side that meet the other side's in one group, pairs of rows meant for a task, and the most tasks.
LOT_ROWS, TASK_PAIRS, MOST_TASKS = 2_048, 1 << 22, 4_096


def _meetings(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(block, i, j, side, *columns) of both sides: each row of a block with each lot of the block's other side.

    Rows of a block are dealt over lots, and each pair of lots is a group of its own, so a group has at most about two lots of
    rows. Blocks that one side lacks are left out. Groups come whole and in order.
    """
    sizes = left.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(
        shuffled(right.groupBy("block").agg(F.count(F.lit(1)).alias("m"))), "block")
    sizes = checkpointed(sizes.select("block", "n", "m", *(F.ceil(F.col(x) / LOT_ROWS).cast("int").alias(f"lots_{x}") for x in "nm")))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, pairs // TASK_PAIRS))

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        lot = F.pmod(F.xxhash64(*columns), F.col(f"lots_{own}")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(f"lots_{other}") - 1))
        dealt = df.join(shuffled(sizes), "block").withColumn("lot", lot).withColumn("each", each)
        return dealt.select("block", *(F.col(x).alias(y) for x, y in zip(("each", "lot") if side else ("lot", "each"), "ij")),
                            F.lit(side).alias("side"), *columns)

    both = dealt(left, 0, "n", "m").unionByName(dealt(right, 1, "m", "n"))
    return both.repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j", "side")


def _alike_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b): distinct names of both sides of a block that are similar enough.

    Names of a block meet lot against lot. A bound from lengths, shared letters and shared prefix drops what cannot reach
    the threshold, and the rest is compared many pairs at a time.
    """
    names = _meetings(*(df.select("block", F.col(x).alias("name")).filter(F.col(x).isNotNull()).distinct()
                        for df, x in ((left, "a"), (right, "b"))), ["name"])
    return names.mapInArrow(similarity.alike_names(threshold), "block string, a string, b string")


def _candidate_pairs(left: DataFrame, right: DataFrame, alike: DataFrame) -> DataFrame:
    return left.join(shuffled(alike), ["block", "a"]).join(shuffled(right), ["block", "b"]).select(
        "member_id", "pos_order", "app_member_id", "app_order").distinct()


def fuzzy_candidates(pos: DataFrame, app: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """Pairs with a contact overlap and a similar name; for looking at them, as a common name gives many pairs.

    The records themselves meet in their blocks, so names and pairs are not joined. Records of one area that meet by email
    too are paired in the area only. Pairs can repeat only if an id and its order do.
    """
    left, right = (checkpointed(_blocks(df, key, order, name).filter(F.col(name).isNotNull()).distinct()) for df, key, order, name in (
        (pos, "member_id", "pos_order", "a"), (app, "app_member_id", "app_order", "b")))
    kind = {x.name: x.dataType.simpleString() for x in (*left.schema, *right.schema)}
    columns = ["member_id", "pos_order", "app_member_id", "app_order"]
    sides = [df.select("block", F.col(name).alias("name"), "home", *(
        F.col(c) if c in df.columns else F.lit(None).cast(kind[c]).alias(c) for c in columns)) for df, name in ((left, "a"), (right, "b"))]
    pairs = _meetings(*sides, ["name", "home", *columns]).mapInArrow(
        similarity.alike_records(threshold), ", ".join(f"{c} {kind[c]}" for c in columns))

    def repeats(df: DataFrame, *key: str) -> bool:
        """Whether an id and order has two names or contacts, and so may give a pair twice."""
        home, email = F.coalesce("home", F.lit("")), F.col("block").startswith("e:").cast("int")
        found = df.groupBy(*key).agg(
            F.sum(email).alias("emails"), F.sum(1 - email).alias("areas"), F.min(home).alias("low"), F.max(home).alias("high"))
        return not found.filter((F.col("emails") > 1) | (F.col("areas") > 1) | (F.col("low") < F.col("high"))).isEmpty()

    return pairs.distinct() if repeats(left, "member_id", "pos_order") or repeats(right, "app_member_id", "app_order") else pairs


def _not_implied(left: DataFrame, right: DataFrame, alike: DataFrame) -> DataFrame:
    """``alike`` without the names of email blocks whose records all meet in one area block as well."""
    def homes(df: DataFrame, name: str, side: str) -> DataFrame:
        return df.filter(F.col("block").startswith("e:")).groupBy("block", name).agg(
            F.when((F.min("home") == F.max("home")) & (F.count("home") == F.count(F.lit(1))), F.min("home")).alias(side))

    both = alike.join(shuffled(homes(left, "a", "home_a")), ["block", "a"], "left").join(
        shuffled(homes(right, "b", "home_b")), ["block", "b"], "left")
    return both.filter(~F.coalesce(F.col("home_a") == F.col("home_b"), F.lit(False))).select("block", "a", "b")


def closed_groups(alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, a, group) and (block, b, group) of the names that are alike to exactly the names of their group.

    In such a group every name of one side is alike to every name of the other and to no further one.
    Names of a block that are alike to the same names have the same group; it is closed if each of those is alike
    to no more names than the group has.
    """
    of_a = checkpointed(alike.groupBy("block", "a").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("b"))), 256).alias("group")))
    size = of_a.groupBy("block", "group").agg(F.count(F.lit(1)).alias("names"))
    degree = alike.groupBy("block", "b").agg(F.count(F.lit(1)).alias("degree"))
    met = checkpointed(alike.join(shuffled(of_a), ["block", "a"]).join(shuffled(degree), ["block", "b"]).select("block", "b", "group", "degree").distinct())
    closed = met.groupBy("block", "group").agg(F.min("degree").alias("least"), F.max("degree").alias("most")).join(
        shuffled(size), ["block", "group"]).filter((F.col("least") == F.col("names")) & (F.col("most") == F.col("names"))).select("block", "group")
    return tuple(x.join(shuffled(closed), ["block", "group"]).select("block", name, "group") for x, name in ((of_a, "a"), (met, "b")))


def match_fuzzy_names(pos: DataFrame, app: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """(member_id, app_member_id): POS rows in order, each with the first free app row it is a candidate of.

    Where everyone of one side is a candidate of everyone on the other and of no one else, as people of one name and
    area are, the i-th POS row gets the i-th app row, and no pairs are listed. Only what is left, names that are alike
    to different sets of names or records that meet in two blocks, is paired and settled in rounds.
    """
    left, right = (checkpointed(_blocks(df, key, order, name)) for df, key, order, name in (
        (pos, "member_id", "pos_order", "a"), (app, "app_member_id", "app_order", "b")))
    alike = checkpointed(_not_implied(left, right, checkpointed(_alike_names(left, right, threshold))))
    groups_a, groups_b = closed_groups(alike)

    def placed(rows: DataFrame, name: str, key: str, groups: DataFrame) -> DataFrame:
        """Records with a candidate, with the number of blocks they have one in and their closed group if they have one."""
        met = rows.join(shuffled(alike.select("block", name).distinct()), ["block", name], "left_semi")
        blocks = met.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"))
        return met.join(shuffled(blocks), key).join(shuffled(groups), ["block", name], "left")

    own, other = checkpointed(placed(left, "a", "member_id", groups_a)), checkpointed(placed(right, "b", "app_member_id", groups_b))
    # A group with a record that has candidates elsewhere is left to the rounds as a whole.
    grouped = own.select("block", "group", "blocks").unionByName(other.select("block", "group", "blocks")).filter(F.col("group").isNotNull())
    apart = checkpointed(grouped.groupBy("block", "group").agg(F.max("blocks").alias("__most")).filter("__most = 1").select("block", "group"))
    in_group = [x.join(shuffled(apart), ["block", "group"]) for x in (own, other)]
    by_place = _pair_by_key(*(
        in_ranges(x.select("block", "group", key, F.col(order).alias("row_order")), "row_order", out="__range")
        for x, key, order in zip(in_group, ("member_id", "app_member_id"), ("pos_order", "app_order"))), ["block", "group"])
    rest = [x.join(shuffled(apart), ["block", "group"], "left_anti") for x in (own, other)]
    rows = checkpointed(rest[0].select(
        "block", F.lit(0).alias("side"), F.col("pos_order").alias("row_order"), "member_id",
        F.lit(None).cast(dict(other.dtypes)["app_member_id"]).alias("app_member_id"), F.col("a").alias("name"), (F.col("blocks") > 1).alias("shared"),
    ).unionByName(rest[1].select(
        "block", F.lit(1).alias("side"), F.col("app_order").alias("row_order"), F.lit(None).cast(dict(own.dtypes)["member_id"]).alias("member_id"),
        "app_member_id", F.col("b").alias("name"), (F.col("blocks") > 1).alias("shared"))).distinct())
    far = _far_blocks(rows)
    # Blocks that no one task can settle are paired, with all that hangs together with them.
    paired = [x.join(shuffled(far), "block", "left_semi") for x in (rows.filter("side = 0"), rows.filter("side = 1"), alike)]
    pairs = _candidate_pairs(
        paired[0].select("block", F.col("name").alias("a"), "member_id", F.col("row_order").alias("pos_order")),
        paired[1].select("block", F.col("name").alias("b"), "app_member_id", F.col("row_order").alias("app_order")), paired[2])
    settled = serve_in_blocks(rows.join(shuffled(far), "block", "left_anti"), threshold)
    return by_place.unionByName(settled).unionByName(assign_in_order(pairs))


# Rows and pairs of names up to which one task settles a block.
BLOCK_ROWS, BLOCK_PAIRS = 1 << 17, 1 << 24


def _far_blocks(rows: DataFrame) -> DataFrame:
    """The ``block`` of blocks that are not settled by one task, and of those that share records with them, and so on.

    These are blocks that are too large, and those of records that have no order or more than one, or that are in a block twice.
    """
    names = rows.groupBy("block", "side", "name").agg(F.count(F.lit(1)).alias("rows")).groupBy("block").agg(
        F.sum("rows").alias("rows"), *(F.sum((F.col("side") == n).cast("long")).alias(f"names_{n}") for n in (0, 1)))
    large = names.filter((F.col("rows") > BLOCK_ROWS) | (F.col("names_0") * F.col("names_1") > BLOCK_PAIRS)).select("block")
    key = ["side", "member_id", "app_member_id"]
    odd = rows.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"), F.min("row_order").alias("low"), F.max("row_order").alias("high")).groupBy(
        *key).agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("low").isNull()).alias("none"))
    odd = odd.filter((F.col("n") > 1) | F.col("none") | (F.col("low") < F.col("high"))).select(F.coalesce("member_id", "app_member_id").alias("id"), "side")
    ids = rows.select("block", "side", F.coalesce("member_id", "app_member_id").alias("id"), "shared")
    far = checkpointed(large.unionByName(ids.join(shuffled(odd), ["side", "id"], "left_semi").select("block")).distinct())
    found, before = far.count(), 0
    while found > before:
        touched = ids.filter("shared").join(shuffled(far), "block", "left_semi").select("side", "id").distinct()
        far = checkpointed(far.unionByName(ids.join(shuffled(touched), ["side", "id"], "left_semi").select("block")).distinct())
        found, before = far.count(), found
    return far


# Rounds in which blocks that share records are gathered into clusters.
CLUSTER_ROUNDS = 8


def _clusters(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cluster``, a block's own name or that of the least block it hangs together with by records of two blocks.

    Clusters that would be too large for a task, and blocks not reached in so many rounds, stay apart: that costs rounds later, nothing else.
    """
    links = checkpointed(rows.filter("shared").select("block", "side", F.coalesce("member_id", "app_member_id").alias("id")))
    labels, mark = checkpointed(links.select("block", F.col("block").alias("cluster")).distinct()), None
    if labels.isEmpty():
        return rows.withColumn("cluster", F.col("block"))
    for _ in range(CLUSTER_ROUNDS):
        of_record = links.join(shuffled(labels), "block").groupBy("side", "id").agg(F.min("cluster").alias("cluster"))
        labels = checkpointed(links.join(shuffled(of_record), ["side", "id"]).groupBy("block").agg(F.min("cluster").alias("cluster")))
        before, mark = mark, _mark(labels)
        if mark == before:
            break
    sizes = rows.groupBy("block", "side", "name").agg(F.count(F.lit(1)).alias("rows")).groupBy("block").agg(
        F.sum("rows").alias("rows"), *(F.sum((F.col("side") == n).cast("long")).alias(f"n{n}") for n in (0, 1)))
    small = labels.join(shuffled(sizes), "block").groupBy("cluster").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("n0") * F.col("n1")).alias("pairs")).filter(
        (F.col("rows") <= BLOCK_ROWS) & (F.col("pairs") <= BLOCK_PAIRS)).select("cluster")
    labels = checkpointed(labels.join(shuffled(small), "cluster", "left_semi").select("block", "cluster"))
    return rows.join(shuffled(labels), "block", "left").withColumn("cluster", F.coalesce("cluster", "block"))


def serve_in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(member_id, app_member_id): POS rows in order, each with its first free app row of an alike name in one of its blocks.

    ``rows`` has (block, side, row_order, member_id, app_member_id, name, shared). Blocks are gathered into clusters, and each
    cluster is walked through in order by one task. Of records that are in other clusters too, clusters tell each other what
    is offered and left there, and are walked through again until there is nothing new.
    """
    kind = {x.name: x.dataType.simpleString() for x in rows.schema}
    graph_schema, told_schema = (x.format(id=kind["member_id"], other=kind["app_member_id"]) for x in (similarity.GRAPH, similarity.TOLD))
    pairs = rows.groupBy("block").agg(F.sum((F.col("side") == 0).cast("long")).alias("n"), F.sum(F.col("side").cast("long")).alias("m")).agg(
        F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, pairs // TASK_PAIRS))
    rows = checkpointed(_clusters(rows))
    spread = rows.groupBy("side", "member_id", "app_member_id").agg((F.min("cluster") < F.max("cluster")).alias("shared"))
    of_id = F.coalesce("member_id", "app_member_id")
    graphs = checkpointed(
        rows.withColumn("id", of_id).join(shuffled(spread.select("side", of_id.alias("id"), F.col("shared").alias("spread"))), ["side", "id"])
        .select("cluster", "side", F.col("row_order").cast("long").alias("row_order"), "member_id", "app_member_id", "name", "spread", "block")
        .repartition(tasks, "cluster").sortWithinPartitions("cluster", "side", "row_order", "member_id", "app_member_id")
        .mapInArrow(similarity.graphs(threshold), graph_schema))
    item = f"array<struct<side: int, at: int, best: bigint, best_id: {kind['app_member_id']}>>"
    out_schema = f"member_id {kind['member_id']}, app_member_id {kind['app_member_id']}"
    told = checkpointed(graphs.withColumn("told", F.lit(None).cast(item)).mapInArrow(similarity.told_of, told_schema))
    if told.isEmpty():
        return graphs.withColumn("told", F.array().cast(item)).mapInArrow(similarity.served, out_schema)
    mark, before = _mark(told), None
    while True:
        # Grouped by record, not joined with itself: a join's estimated size is a product, and squared in each round it takes ever longer to plan.
        of_record = told.withColumn("id", F.coalesce("p_id", "a_id")).groupBy("side", "id").agg(
            F.collect_list(F.struct("cluster", "at", F.struct("best", "best_id").alias("known"))).alias("all"))
        own = of_record.select("side", "all", F.explode("all").alias("own"))
        heard = own.select("side", "own.cluster", "own.at", F.array_min(F.transform(
            F.filter("all", lambda x: (x["cluster"] != F.col("own.cluster")) & x["known"]["best"].isNotNull()), lambda x: x["known"])).alias("known")).filter(
            F.col("known").isNotNull())
        of_cluster = heard.groupBy("cluster").agg(F.collect_list(F.struct("side", "at", "known.best", "known.best_id")).alias("told"))
        with_told = graphs.join(shuffled(of_cluster), "cluster", "left").withColumn("told", F.coalesce("told", F.array().cast(item)))
        if mark == before:
            return with_told.mapInArrow(similarity.served, out_schema).distinct()
        told = checkpointed(with_told.mapInArrow(similarity.told_of, told_schema))
        mark, before = _mark(told), mark


def _mark(told: DataFrame) -> tuple:
    return tuple(told.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*told.columns).cast("decimal(38,0)"))).first())


def assign_in_order(candidates: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """One-to-one assignment equal to serving POS rows in order, each taking its first free app row.

    Every POS row offers to its first remaining app row; each app row keeps the
    earliest offer. An app row only ever trades for an earlier POS row, so
    edges of later POS rows to it can be dropped for good. Rounds repeat until
    no offer is refused.
    """
    edges = checkpointed(candidates)
    rounds = 0
    while True:
        offers = edges.groupBy("member_id", "pos_order").agg(
            F.min(F.struct("app_order", "app_member_id")).alias("pick")
        ).select("member_id", "pos_order", "pick.app_order", "pick.app_member_id")
        held = offers.groupBy("app_member_id").agg(F.min("pos_order").alias("held_by"))
        refused = offers.join(shuffled(held), "app_member_id").filter(F.col("pos_order") > F.col("held_by"))
        rounds += 1
        if refused.isEmpty():
            return offers.select("member_id", "app_member_id")
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"assignment not settled after {rounds} rounds")
        edges = checkpointed(
            edges.join(shuffled(held), "app_member_id", "left")
            .filter(F.col("held_by").isNull() | (F.col("pos_order") <= F.col("held_by")))
            .drop("held_by")
        )


def resolve_identities(
    pos: DataFrame, app: DataFrame, *, salt: str, threshold: float = 0.85,
    shared_email_guard: bool = False, **contact_options,
) -> DataFrame:
    """Unified identity table from POS and app records.

    Layers run one after another over all rows (email, phone, fuzzy name), each
    on the records the layer before left free. ``row_order`` is the ingest
    position of a record and decides who is served first. Records without a
    partner stay, with ``NONE`` on the other side. ``contact_options`` go to ``normalize_contacts``.
    """
    pos_n, app_n = normalize_contacts(pos, **contact_options), normalize_contacts(app, **contact_options)
    exact = checkpointed(match_exact_contacts(pos, app, shared_email_guard=shared_email_guard, **contact_options))
    fuzzy = match_fuzzy_names(
        _without(pos_n, exact, "member_id"), _without(app_n, exact, "app_member_id"), threshold=threshold)
    matches = exact.select("member_id", "app_member_id").unionByName(fuzzy)
    hashed = salted_hash(F.col("norm_email"), salt).alias("hashed_member_id")
    contact = ["name", "email", "phone"]
    from_pos = pos_n.join(shuffled(matches), "member_id", "left").select(
        "member_id", F.coalesce("app_member_id", F.lit("NONE")).alias("app_member_id"), hashed, *contact
    )
    app_only = _without(app_n, matches, "app_member_id").select(
        F.lit("NONE").alias("member_id"), "app_member_id", hashed, *contact
    )
    return from_pos.unionByName(app_only)


def match_rate(resolved: DataFrame) -> DataFrame:
    """Share of POS records with an app partner."""
    is_pos = F.col("member_id") != "NONE"
    both = is_pos & (F.col("app_member_id") != "NONE")
    total = F.sum(F.when(is_pos, 1).otherwise(0))
    hit = F.sum(F.when(both, 1).otherwise(0))
    return resolved.agg(
        total.alias("pos_records"), hit.alias("matched"),
        F.when(total > 0, F.round(hit / total, 6)).alias("match_rate"),
    )
