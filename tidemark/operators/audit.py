"""Auth-log integrity, lockouts and oversight records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark import contracts as C
from tidemark.functions.expressions import count_when
from tidemark.functions.ranking import group_row_number, in_ranges
from tidemark.session import checkpointed

CHAIN_FIELDS = ["event", "outcome", "prev_hash", "reason", "source", "ts", "username"]


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files with a dense 1-based ``seq`` and the file's ``line``.

    Lines are numbered inside each file split, in parallel; split sizes give the
    offsets (one row per split).
    """
    raw = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__full", (F.trim("value") != "").cast("int"))
    )
    split = ["file_path", "file_block_start"]
    inside = W.partitionBy(*split).orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(1)).orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    sizes = raw.groupBy(*split).agg(
        F.count(F.lit(1)).alias("__lines"), F.sum("__full").alias("__records")
    )
    offsets = sizes.select(
        *split, F.coalesce(F.sum("__lines").over(before), F.lit(0)).alias("__lo"),
        F.coalesce(F.sum("__records").over(before), F.lit(0)).alias("__ro"),
    )
    return (
        raw.withColumns({
            "__l": F.count(F.lit(1)).over(inside), "__r": F.sum("__full").over(inside)
        })
        .join(offsets, split)
        .filter(F.col("__full") == 1)
        .select((F.col("__r") + F.col("__ro")).alias("seq"),
                (F.col("__l") + F.col("__lo")).alias("line"), "value")
    )


def _ascii_json(text: Column) -> Column:
    """Escape everything outside printable ASCII as \\uXXXX, pairs above the basic plane."""
    def code(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escape(ch: Column) -> Column:
        cp = F.ascii(ch)
        rest = cp - 0x10000
        high = F.lit(0xD800) + F.floor(rest / 0x400)
        low = F.lit(0xDC00) + F.pmod(rest, F.lit(0x400))
        return F.when(cp > 0xFFFF, F.concat(code(high), code(low))).when(cp > 126, code(cp)).otherwise(ch)

    plain = ~text.rlike(r"[^\x00-\x7e]")
    return F.when(plain, text).otherwise(
        F.array_join(F.transform(F.split(text, ""), escape), "")
    )


def record_hash(prev: Column, fields: list[str] = CHAIN_FIELDS) -> Column:
    """sha-256 of the previous hash and the record as JSON with sorted keys and no spaces."""
    body = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(prev, _ascii_json(body)), 256)


def _json(record: str, fields: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"{record}.{f}").alias(f) for f in fields]), {"ignoreNullFields": "false"})


def _without_end(text: Column) -> Column:
    return F.left(text, F.length(text) - 1)


def link_parts(record: str) -> Column:
    """What a record's line and body are made of besides the hashes: the line up to ``prev_hash``, the body before and after it.

    All are JSON text without the outer brace on the side of ``prev_hash``, so linking needs no JSON work of its own.
    """
    names = [f for f in C.AUTH_LOG_SCHEMA.fieldNames() if f not in ("prev_hash", "hash")]
    before, after = ([f for f in sorted(names) if (f < "prev_hash") == first] for first in (True, False))
    line, head, tail = _json(record, names), _ascii_json(_json(record, before)), _ascii_json(_json(record, after))
    return F.struct(_without_end(line).alias("line"), _without_end(head).alias("head"), F.substring(tail, 2, 2147483647).alias("tail"))


def linked_lines(parts: Column, start: Column) -> Column:
    """JSON lines from an array of ``link_parts`` in order, each with the hash before it (first ``start``) and its own."""
    def quoted(text: Column) -> Column:
        return F.substring(F.to_json(F.struct(text.alias("h"))), 6, 2147483647)

    def link(done: Column, e: Column) -> Column:
        # The own hash is bound once, as an element, so that it is not computed for each of its uses.
        own = F.array(F.sha2(F.concat(done["hash"], e["head"], F.lit(',"prev_hash":'), _ascii_json(done["quoted"]), F.lit(","), e["tail"]), 256))
        return F.transform(own, lambda h: F.struct(
            h.alias("hash"), F.concat(F.lit('"'), h, F.lit('"')).alias("quoted"),
            F.array_append(done["lines"], F.concat(e["line"], F.lit(',"prev_hash":'), done["quoted"], F.lit(',"hash":"'), h, F.lit('"}'))).alias("lines")))[0]

    first = F.struct(start.alias("hash"), _without_end(quoted(start)).alias("quoted"), F.array().cast("array<string>").alias("lines"))
    return F.aggregate(parts, first, link)["lines"]


# Records of a chain that are linked one after the other; each segment starts at a hash of its own.
SEGMENT = 256


def anchor(segment: Column, genesis: str = C.GENESIS_HASH) -> Column:
    """The hash a segment starts from: the genesis hash for the first one, a hash of the number for others."""
    return F.when(segment == 0, F.lit(genesis)).otherwise(F.sha2(F.concat(F.lit(genesis + ":"), segment.cast("string")), 256))


def _segment(seq: str, segment: int) -> Column:
    return F.floor((F.col(seq) - 1) / F.lit(segment))


def linked_log(
    events: DataFrame, by: list[str], order: str, *, segment: int = SEGMENT, genesis: str = C.GENESIS_HASH,
) -> DataFrame:
    """(by, seq, line): the log of one chain for each value of ``by``, as JSON lines.

    Records are numbered by the unique numeric ``order``; each run of ``segment`` of them is linked from its own
    anchor, so a long chain is spread over tasks and no array is longer than that. Segments are bound
    together by ``chain_seals``.
    """
    names = [f for f in C.AUTH_LOG_SCHEMA.fieldNames() if f not in ("prev_hash", "hash")]
    records = events.select(*by, F.col(order).alias("__order"), F.struct(*names).alias("__record"))
    numbered = group_row_number(records, by, "__order", out="seq")
    # JSON of a record is made row by row before the segments are gathered.
    parts = numbered.select(*by, "seq", link_parts("__record").alias("__part")).groupBy(*by, _segment("seq", segment).alias("__segment")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "__part"))).alias("__rows"))
    lines = linked_lines(F.transform("__rows", lambda r: r["__part"]), anchor(F.col("__segment"), genesis))
    return parts.select(*by, "__segment", F.posexplode(lines).alias("__at", "line")).select(
        *by, (F.col("__segment") * segment + F.col("__at") + 1).alias("seq"), "line")


def chain_seals(
    log: DataFrame, by: list[str], *, seq: str = "seq", segment: int = SEGMENT, genesis: str = C.GENESIS_HASH,
) -> DataFrame:
    """(by, records, seal): one hash for each chain that depends on all its records and their order.

    The last hash of each segment is a record of a shorter chain, which is cut into segments in turn, until one is
    left; so a lost end or a segment put elsewhere is found too. Each step is one shuffle of bounded groups.
    """
    level = log.groupBy(*by, _segment(seq, segment).alias("__segment")).agg(
        F.count(F.lit(1)).alias("records"), F.max_by("hash", seq).alias("seal"))
    while True:
        level = checkpointed(level)
        if not (level.agg(F.max("__segment")).first()[0] or 0):
            return level.select(*by, "records", "seal")
        rows = level.select(*by, F.floor(F.col("__segment") / F.lit(segment)).alias("__next"), F.struct("__segment", "records", "seal").alias("__part"))
        parts = rows.groupBy(*by, "__next").agg(F.array_sort(F.collect_list("__part")).alias("__parts"))
        sealed = F.aggregate("__parts", anchor(F.col("__next"), genesis), lambda h, p: F.sha2(F.concat(h, F.coalesce(p["seal"], F.lit(""))), 256))
        total = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p["records"])
        level = parts.select(*by, F.col("__next").alias("__segment"), total.alias("records"),
                             F.when(F.size("__parts") > 1, sealed).otherwise(F.col("__parts")[0]["seal"]).alias("seal"))


def check_hash_chain(
    log: DataFrame, *, seq: str = "seq", genesis: str = C.GENESIS_HASH, by: tuple[str, ...] = (), segment: int | None = None,
) -> DataFrame:
    """Each record with ``linked`` (it follows its predecessor's hash) and ``intact``
    (linked, and its own hash is right).

    The predecessor is found by an equi join on the dense sequence number, so no
    task needs the whole log in order. A record whose hash is null (a malformed
    line) is itself a break. ``by`` names the columns that tell several chains apart; with ``segment`` each run of
    so many records starts from its own anchor.
    """
    before = log.select(*by, (F.col(seq) + 1).alias(seq), F.col("hash").alias("__before"))
    first = F.col(seq) == 1 if segment is None else F.pmod(F.col(seq), F.lit(segment)) == F.lit(1 % segment)
    start = F.lit(genesis) if segment is None else anchor(_segment(seq, segment), genesis)
    joined = log.join(before, [*by, seq], "left").withColumn("__prev", F.when(first, start).otherwise(F.col("__before")))
    linked = F.coalesce(F.col("prev_hash") == F.col("__prev"), F.lit(False))
    right = F.coalesce(F.col("hash") == record_hash(F.col("__prev")), F.lit(False))
    return joined.withColumns({"linked": linked, "intact": linked & right}).drop("__before", "__prev")


def verify_hash_chain(
    log: DataFrame, *, seq: str = "seq", genesis: str = C.GENESIS_HASH, by: tuple[str, ...] = (), segment: int | None = None,
    seals: DataFrame | None = None,
) -> DataFrame:
    """Whether each chain holds, its first broken position and its record count (one row per chain).

    With ``seals`` (``chain_seals`` of the log as it was written) a chain also has to have its seal and its number of
    records: ``sealed`` is false for a chain that was cut at its end, or lost altogether (no records, not ok).
    """
    broken = F.min(F.when(~F.col("intact"), F.col(seq)))
    found = check_hash_chain(log, seq=seq, genesis=genesis, by=by, segment=segment).groupBy(*by).agg(
        broken.isNull().alias("ok"), broken.alias("first_broken"), F.count(F.lit(1)).alias("records")
    )
    if seals is None:
        return found
    now = chain_seals(log, list(by), seq=seq, segment=segment or SEGMENT, genesis=genesis).drop("records")
    both = seals.select(*by, F.col("seal").alias("__seal"), F.col("records").alias("__records")).join(found.join(now, [*by]), [*by], "full_outer")
    sealed = F.coalesce((F.col("__seal") == F.col("seal")) & (F.col("__records") == F.col("records")), F.lit(False))
    return both.select(*by, (F.coalesce("ok", F.lit(False)) & sealed).alias("ok"), "first_broken",
                       F.coalesce("records", F.lit(0).cast("long")).alias("records"), sealed.alias("sealed"))


def parse_auth_lines(lines: DataFrame) -> DataFrame:
    """Numbered text lines to auth records; a malformed line keeps its number with null fields.

    A line that is not one JSON object from start to end, or whose keys are not exactly the record's
    fields, keeps its fields but has no hash, so it breaks a chain.
    """
    rec = F.from_json("value", C.AUTH_LOG_SCHEMA)
    # What may follow the object differs between the two wrappings: only blanks pass both.
    listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(C.AUTH_LOG_SCHEMA))
    held = F.from_json(F.concat(F.lit('{"r":'), "value", F.lit("}")), T.StructType([T.StructField("r", C.AUTH_LOG_SCHEMA)]))
    keys = F.array_sort(F.json_object_keys("value"))
    fields = F.array(*[F.lit(f) for f in sorted(C.AUTH_LOG_SCHEMA.fieldNames())])
    # A line that is just what the record is written as needs no further parsing.
    same = F.coalesce(F.to_json(rec, {"ignoreNullFields": "false"}) == F.col("value"), F.lit(False))
    whole = F.when(same, F.lit(True)).otherwise((F.size(listed) == 1) & held["r"].isNotNull() & (keys == fields))
    return lines.select("seq", "line", rec.alias("r"), whole.alias("__whole")).select("seq", "line", "r.*", "__whole").withColumn(
        "hash", F.when(F.col("__whole"), F.col("hash"))).drop("__whole")


# --- lockout ---------------------------------------------------------------------

def _keyed(events: DataFrame) -> DataFrame:
    """One row per event and lockout key; the source 'unknown' is no key."""
    keys = F.array_compact(F.array(
        F.struct(F.lit("username").alias("key_type"), F.lower(F.trim("username")).alias("key_value")),
        F.when(F.col("source") != "unknown",
               F.struct(F.lit("source").alias("key_type"), F.col("source").alias("key_value"))),
    ))
    return events.select("ts", "outcome", F.explode(keys).alias("k")).select(
        "k.key_type", "k.key_value", "ts", "outcome"
    )


def _minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def failures_since_success(events: DataFrame) -> DataFrame:
    """Failures per key after its last success, with the latest of them."""
    keyed = _keyed(events)
    key = ["key_type", "key_value"]
    success = keyed.filter(F.col("outcome") == "success").groupBy(*key).agg(
        F.max("ts").alias("last_success"))
    fails = keyed.filter(F.col("outcome") == "failure").groupBy(*key, "ts").agg(
        F.count(F.lit(1)).alias("n"))
    return (
        fails.join(success, key, "left")
        .filter(F.col("last_success").isNull() | (F.col("ts") > F.col("last_success")))
        .groupBy(*key)
        .agg(F.sum("n").alias("failures"), F.max("ts").alias("last_failure"))
    )


def lockout_status(
    events: DataFrame, *, now: Column, max_failures: int = 5, window_min: int = 15, lockout_min: int = 15
) -> DataFrame:
    """Keys with failures in the window, whether they are locked and for how many seconds."""
    recent = events.filter((F.col("ts") >= now - _minutes(window_min)) & (F.col("ts") <= now))
    until = F.col("last_failure") + _minutes(lockout_min)
    left = F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    locked = (F.col("failures") >= max_failures) & (until > now)
    return failures_since_success(recent).select(
        "key_type", "key_value", "failures", locked.alias("locked"),
        F.when(locked, left).otherwise(0).alias("seconds_remaining"),
    )


def auth_failure_summary(events: DataFrame, *, now: Column, minutes: int = 60) -> DataFrame:
    """Recent failures by username and by source."""
    recent = events.filter((F.col("ts") >= now - _minutes(minutes)) & (F.col("ts") <= now)
                           & (F.col("outcome") == "failure"))
    by = [
        recent.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("failures"))
        .select(F.lit(c).alias("dimension"), "value", "failures")
        for c in ("username", "source")
    ]
    return reduce(DataFrame.unionByName, by)


def oversight_log(accesses: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Accesses whose studio differs from the same admin's previous access.

    Time is cut into ranges of about equal numbers of accesses. Rows are compared inside an admin's ranges; the last
    studio of the admin's previous range is carried in from a table of one row per admin and range. An admin
    with most of all accesses is therefore spread over ranges, not held by one task.
    """
    order = ["accessed_at", "access_id"]
    rows = in_ranges(accesses.withColumn("__t", F.unix_micros(F.col("accessed_at").cast("timestamp"))), "__t", out="__range", ranges=ranges)
    closing = rows.groupBy("admin_user", "__range").agg(
        F.max_by("viewed_studio", F.struct(*order)).alias("__last")
    )
    # One row for each range of an admin.
    carried = closing.select(
        "admin_user", "__range",
        F.lag("__last").over(W.partitionBy("admin_user").orderBy("__range")).alias("__carry"),
    )
    inside = W.partitionBy("admin_user", "__range").orderBy(*order)
    before = F.coalesce(F.lag("viewed_studio").over(inside), F.col("__carry"))
    return (
        rows.join(carried, ["admin_user", "__range"])
        .withColumn("__before", before)
        .filter(F.col("__before").isNull() | (F.col("__before") != F.col("viewed_studio")))
        .drop("__t", "__range", "__carry", "__before")
    )
