"""Messages rendered from tables, with DataFrame functions: a body gets its BeginString, BodyLength and CheckSum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x01"


def body(*parts: tuple[int, Column | str | None]) -> Column:
    """tag=value fields, each with its separator; a null value leaves its field out."""
    fields = []
    for tag, value in parts:
        value = F.lit(value) if isinstance(value, str) else value
        fields.append(F.coalesce(F.concat(F.lit(f"{tag}="), value.cast("string"), F.lit(SEP)), F.lit("")))
    return F.concat(*fields)


def framed(body: Column, begin: str = "FIX.4.4", checksum: Column | None = None) -> Column:
    """The whole message. A right checksum costs a pass over all bytes; by default it is 000, which readers take."""
    head = F.concat(F.lit(f"8={begin}{SEP}9="), F.octet_length(body).cast("string"), F.lit(SEP))
    return F.concat(head, body, F.lit("10="), checksum if checksum is not None else F.lit("000"), F.lit(SEP))


def byte_sum(text: Column) -> Column:
    """Three digits: the sum of an ASCII text's bytes modulo 256."""
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.lpad((total % 256).cast("string"), 3, "0")


def time_text(ts: Column) -> Column:
    """UTC time with microseconds."""
    return F.date_format(ts, "yyyyMMdd-HH:mm:ss.SSSSSS")


def order_flow(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(pos, record): new orders, replacements of those with status P (whose execution reports then name the replacement), requests that refer to the placeholder NONE,
    and execution reports from line items; repeated (order, line) pairs give repeated execution identifiers. pos is unique and gives the order: an
    order's messages follow each other."""
    key = F.col("o_orderkey")
    cid = F.concat(F.lit("O"), key)
    side = F.when(key % 2 == 0, "1").otherwise("2")
    at = time_text(F.col("o_orderdate"))
    base = [(49, F.concat(F.lit("C"), F.col("o_custkey"))), (56, "GW")]
    new = orders.select(
        (key * 1024).alias("pos"),
        framed(body((35, "D"), *base, (52, at), (11, cid), (55, F.concat(F.lit("P"), F.col("o_custkey") % 50)), (54, side), (38, F.lit("100")), (40, "2"),
                    (44, F.col("o_totalprice").cast("decimal(18,2)")), (41, F.when(key % 7 == 0, F.lit("NONE"))))).alias("record"),
    )
    replaced = orders.where("o_orderstatus = 'P'").select(
        (key * 1024 + 1).alias("pos"),
        framed(body((35, "G"), *base, (52, at), (11, F.concat(F.lit("R"), key)), (41, cid), (54, side), (38, F.lit("150")))).alias("record"),
    )
    lines = lineitem.join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == key).withColumn(
        "n", F.row_number().over(_line_order())
    )
    current = F.concat(F.when(F.col("o_orderstatus") == "P", F.lit("R")).otherwise(F.lit("O")), key)
    done = lines.select(
        (key * 1024 + 1 + F.col("n")).alias("pos"),
        framed(body((35, "8"), (49, "GW"), (56, F.concat(F.lit("C"), F.col("o_custkey"))), (52, time_text(F.col("l_shipdate"))), (37, F.concat(F.lit("X"), key)),
                    (11, F.when(F.col("n") % 3 != 0, current)), (17, F.concat(F.lit("E"), key, F.lit("-"), F.col("l_linenumber"))), (150, F.lit("F")),
                    (39, F.when(F.col("o_orderstatus") == "F", "2").otherwise("1")), (32, F.col("l_quantity").cast("int")),
                    (31, F.col("l_extendedprice").cast("decimal(18,2)")), (14, (F.col("l_quantity") * F.col("n")).cast("int")))).alias("record"),
    )
    return new.unionByName(replaced).unionByName(done)


def _line_order():
    from pyspark.sql.window import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def session_flow(events: DataFrame) -> DataFrame:
    """(pos, record): each event is a message of its user's session with GW, from one side or the other by its type; numbered by user and direction, where a number is left out
    before each event whose id 17 divides, so that there are gaps."""
    from pyspark.sql.window import Window

    kind = F.col("event_type")
    out = F.pmod(F.crc32(kind.cast("binary")), F.lit(3)) == 0
    user = F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    order = Window.partitionBy("user_id", "out").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    jumps = F.sum(F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)).over(order)
    numbered = events.withColumn("out", out).withColumn("seq", F.row_number().over(order) + jumps)
    return numbered.select(
        F.col("event_id").alias("pos"),
        framed(body((35, F.upper(F.substring(kind, 1, 1))), (34, F.col("seq")), (49, F.when(F.col("out"), F.lit("GW")).otherwise(user)),
                    (56, F.when(F.col("out"), user).otherwise(F.lit("GW"))), (52, time_text(F.col("ts"))), (58, kind))).alias("record"),
    )
