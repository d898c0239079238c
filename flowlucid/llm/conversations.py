"""Conversations brought back to turns that alternate.

Turns in order are numbered by one sort of the whole table (without texts) and cut into blocks
of at most ``BLOCK`` consecutive ones; a block is summed up by the cheapest edits between any
two states of the grammar (``alignment``), and neighbouring sums are put together, ``FAN`` at a
time, until each conversation has one. So a conversation of any length is worked off in
parallel. Its repaired turns then pass one task in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import scratch_dir, ship_package, small_table
from .alignment import DELETE, GONE, INSERT, KEEP, STATES, Sums, block_sums, together, whole_script
from .text import blocks

BLOCK = 32
FAN = 64
#: Role initials that may follow each other.
FOLLOWS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
SPACE = "[\\x20\\x09-\\x0D]"

_SUMS = "conv_id {kind}, block long, first string, last string, illegal long, costs array<long>, scripts array<string>"


def damaged_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by the checksum of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 doubles the row, 4 makes it
    the user's. Missing values count as one space, but a missing turn stays missing in its column."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    rows = turns.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def _plain(turns: DataFrame) -> DataFrame:
    """The four columns, without missing roles and texts, and a digest of each text."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select("conv_id", "turn", *known).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _numbered(plain: DataFrame) -> DataFrame:
    """One row for equal turns, as a written table: ``at`` numbers them in order, without gaps."""
    spark = plain.sparkSession
    blank = ~F.col("text").rlike(f"[^{SPACE[1:]}")
    cut = ~F.col("text").rlike(f"[.!?]{SPACE}*\\z")
    initial = F.substring("role", 1, 1)
    some = plain.withColumn("blank", blank).withColumn("cut", cut).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    one = some.groupBy("conv_id", "turn", "role", "digest").agg(
        F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("initial").alias("initial"), F.count(F.lit(1)).alias("copies"),
    )
    path = scratch_dir(spark, "turns")
    ordered = one.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered.select("*", F.spark_partition_id().alias("part"), place.alias("place")).write.parquet(path)
    written = spark.read.parquet(path)
    starts, before = [], 0
    for part, n in sorted(written.groupBy("part").agg(F.count(F.lit(1))).collect()):  # one row for each shuffle partition
        starts.append((part, before))
        before += n
    return written.join(small_table(spark, starts, "part int, before long"), "part").withColumn("at", F.col("place") + F.col("before")).drop("part", "place", "before")


def _sums_out(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    """(conversation, block, first and last initial, illegal pairs, sums) as columns."""
    return pa.table({
        "conv_id": pa.array([r[0] for r in rows], kind), "block": pa.array([r[1] for r in rows], pa.int64()),
        "first": pa.array([r[2] for r in rows], pa.string()), "last": pa.array([r[3] for r in rows], pa.string()),
        "illegal": pa.array([r[4] for r in rows], pa.int64()),
        "costs": pa.array([[s and s[0] for s in r[5]] for r in rows], pa.list_(pa.int64())),
        "scripts": pa.array([[s and s[1] for s in r[5]] for r in rows], pa.list_(pa.string())),
    })


def _sums_in(costs: list, scripts: list) -> Sums:
    return [None if c is None else (c, s) for c, s in zip(costs, scripts, strict=True)]


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in FOLLOWS for i in range(len(initials) - 1))


def conversation_sums(numbered: DataFrame) -> DataFrame:
    """One row of sums for each conversation, from turns marked with their fault."""
    kind = numbered.schema["conv_id"].dataType.simpleString()
    schema = _SUMS.format(kind=kind)
    gone = F.col("blank") | F.col("again")
    stay = F.when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    # of equal turns at most the first may stay
    codes = F.concat(F.when(gone, GONE).otherwise(stay), F.repeat(F.lit(GONE), (F.col("copies") - 1).cast("int")))
    initials = F.expr("repeat(initial, cast(copies as int))")
    grouped = numbered.select("conv_id", F.expr(f"at div {BLOCK}").alias("block"), F.struct("at", codes.alias("codes"), initials.alias("initials")).alias("turn"))
    listed = grouped.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # BLOCK at most
    strings = listed.select("conv_id", "block", *[F.array_join(F.col(f"turns.{c}"), "").alias(c) for c in ("codes", "initials")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, block, codes, initials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = block_sums(codes[:BLOCK])
                for i in range(BLOCK, len(codes), BLOCK):  # many equal turns
                    sums = together(list(sums), list(block_sums(codes[i:i + BLOCK])))
                rows.append((conv, block, initials[0], initials[-1], _illegal(initials), sums))
            yield from _sums_out(rows, batch.column(0).type).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        sums, illegal = _sums_in(rows[0]["costs"], rows[0]["scripts"]), sum(r["illegal"] for r in rows)
        for one, two in zip(rows, rows[1:]):
            sums = together(sums, _sums_in(two["costs"], two["scripts"]))
            illegal += one["last"] + two["first"] not in FOLLOWS
        return _sums_out([(rows[0]["conv_id"], rows[0]["block"], rows[0]["first"], rows[-1]["last"], illegal, sums)], group.column("conv_id").type)

    spark, found, done = numbered.sparkSession, strings.mapInArrow(align, schema), None
    while True:
        path = scratch_dir(spark, "sums")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        many = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"), F.min("block").alias("base"), F.first(F.struct(*found.columns)).alias("one"))
        whole = many.filter("blocks = 1").select("one.*")
        done = whole if done is None else done.unionByName(whole)
        # a long conversation meets its first number in FAN parts
        long = many.filter("blocks > 1").select(F.col("conv_id").alias("id"), "base", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("salt"))
        salted = found.withColumn("salt", F.col("block") % FAN)
        parts = salted.join(long, salted["conv_id"].eqNullSafe(long["id"]) & (salted["salt"] == long["salt"])).drop("id", "salt")
        parts = parts.withColumn("block", F.col("block") - F.col("base")).drop("base")
        if parts.isEmpty():
            return done
        fan = F.expr(f"block div {FAN}")
        merged = parts.groupBy("conv_id", fan.alias("wide")).applyInArrow(merge, schema)
        found = merged.withColumn("block", fan)


def _finish(sums: DataFrame) -> DataFrame:
    """Cost and script of each conversation."""
    kind = sums.schema["conv_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scripts = [whole_script(_sums_in(c, s)) for c, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s[0] for s in scripts], pa.int64()), pa.array([s[1] for s in scripts], pa.string())],
                names=["conv_id", "illegal", "cost", "audit"],
            )

    return sums.select("conv_id", "illegal", "costs", "scripts").mapInArrow(finish, f"conv_id {kind}, illegal long, cost long, audit string")


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (``conv_id, turn, role, text``):

    ``gaps`` (missing numbers between the least and the greatest turn; 0 if all are null),
    ``blank``, ``duplicate`` (role and text seen earlier) and ``truncated`` (no ``.!?`` at the end)
    count each turn's first fault, ``illegal`` the neighbours whose role initials are not su, ua or
    au, ``cost`` and ``audit`` are those of the cheapest edits: turns are kept (K, 0), get the role
    user or assistant (R, 2), are deleted (D, 3; blank and duplicate ones always) or inserted
    without text (I, 2), a truncated turn that stays adds 1, and the initials of what is left
    read ``(s?(ua)+)?``. Of the cheapest the ASCII-least counts.

    Turns are in the order of their number, nulls first, then of role and of their text's digest,
    so results do not depend on the order of rows. A null role or text counts as one space. A null
    ``conv_id`` is a conversation. Repeated rows are duplicates. Further columns are ignored, an
    empty table gives an empty result.
    """
    return _report(_plain(turns))


def _report(plain: DataFrame) -> DataFrame:
    ship_package(plain.sparkSession)
    numbered = _numbered(plain)
    # the first of its kind is one row, however many there are: it is joined by its number
    firsts = numbered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    marked = numbered.join(firsts, "at", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    path = scratch_dir(plain.sparkSession, "marked")
    marked.write.parquet(path)
    marked = plain.sparkSession.read.parquet(path)
    first = ~F.col("blank") & ~F.col("again")
    faults = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - first.cast("long"))).alias("duplicate"),
        F.sum((first & F.col("cut")).cast("long")).alias("truncated"),
    )
    scripts = _finish(conversation_sums(marked))
    return faults.join(scripts, faults["conv_id"].eqNullSafe(scripts["conv_id"])).drop(scripts["conv_id"])


def _edited(report: DataFrame, plain: DataFrame) -> DataFrame:
    """Each conversation's script, then its turns in order, in one partition; texts are not held."""
    heads = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    rows = plain.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, position`` (from 0), ``role, text, edit`` of every turn after the edits that
    ``repair_report`` finds; conversations of which nothing is left have none. Rows of one
    conversation are in one partition, in order."""
    plain = _plain(turns)
    return _turns_of(_report(plain), plain)


def _turns_of(report: DataFrame, plain: DataFrame) -> DataFrame:
    kind = report.schema["conv_id"].dataType.simpleString()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, at, position, letter = "", 0, 0, ""

        def put(conv: object, out: list, role: str | None, text: str, edit_: str) -> None:
            nonlocal position, letter
            if role is None:  # the next of user and assistant
                role = ROLES["a" if letter == "u" else "u"]
            letter = role[:1]
            out.append((conv, position, role, text, edit_))
            position += 1

        def inserted(conv: object, out: list) -> None:
            nonlocal at
            while at < len(script) and script[at] == INSERT:
                put(conv, out, None, "", INSERT)
                at += 1

        for batch in blocks(batches):
            out: list[tuple] = []
            for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if head == 0:
                    script, at, position, letter = text, 0, 0, ""
                else:
                    step = script[at]
                    at += 1
                    if step == KEEP:
                        put(conv, out, role, text, step)
                    elif step != DELETE:
                        put(conv, out, None, text, step)
                inserted(conv, out)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], batch.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.int64()), *[pa.array([r[k] for r in out], pa.string()) for k in (2, 3, 4)]],
                    names=["conv_id", "position", "role", "text", "edit"],
                )

    return _edited(report, plain).select("conv_id", "kind", "role", "text").mapInArrow(edit, f"conv_id {kind}, position long, role string, text string, edit string")


def turn_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text`` joined by line feeds, of rows as
    ``repaired_turns`` gives them."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done(type_: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], type_), pa.array([total.hexdigest()])], names=["conv_id", "repaired_sha256"])

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for conv, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if total:
                        yield done(type_)
                    now, total = conv, hashlib.sha256()
                else:
                    total.update(b"\n")
                total.update(f"{role}:{text}".encode())
        if total:
            yield done(type_)

    return repaired.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``repair_report`` with ``repaired_sha256``, for every ``conv_id`` of ``known`` (default:
    those of ``turns``); one without turns has zeros, an empty audit and the digest of nothing."""
    plain = _plain(turns)
    path = scratch_dir(turns.sparkSession, "report")
    _report(plain).write.parquet(path)
    report = turns.sparkSession.read.parquet(path)
    digests = turn_digests(_turns_of(report, plain))
    ids = (turns if known is None else known).select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(report, ids["id"].eqNullSafe(report["conv_id"]), "left").drop("conv_id")
    joined = joined.join(digests, joined["id"].eqNullSafe(digests["conv_id"]), "left").drop("conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
