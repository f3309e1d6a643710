"""Map the driver's test tables onto the road-speed data model.

Every derived input grows with its source table:

* speed records  <- events    (segment_index = user_id, seq = event_id,
                                Speed = value, null for 'error' events)
* registry       <- customer  (segment_index = c_custkey, name = c_name)
* raw snapshots  <- orders    (one document per order, built as JSON text
                                and parsed back; seq = o_orderkey)
* predictions    <- embeddings (segment_index = label, seq = vec_id,
                                Speed = the whole embedding)
* geo points     <- customer  (lat / lng derived from c_custkey)

The SQL oracle derives the same values straight from the columns, so a
query that parses the JSON is checked against an independent path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import raw_read_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a stored table of which one task builds and parses the texts, which are many times as large.
SHARE = 1 << 18


#: Batches that landed documents are read in, each of files enough for all cores.
BATCHES = 4


def shares(df: DataFrame) -> int:
    """Tasks for the texts of a scanned table: one per SHARE of its files, and one per core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))


def spread(df: DataFrame, order: str | None = None) -> DataFrame:
    """Deal a scan's rows to tasks by the size of its files, by ranges of ``order`` if given.

    Splits follow row groups, of which a large file may have few, and the JSON building and
    parsing on top of them is CPU-heavy. The rows dealt are narrow: their texts are built after.
    """
    return df.repartitionByRange(BATCHES * shares(df), order) if order else df.repartition(shares(df))


def speed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    speed = F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value"))
    return ev.select(
        F.col("user_id").alias("segment_index"),
        F.col("event_id").alias("seq"),
        speed.alias("Speed"),
        F.round(speed * F.lit(3.6), 2).alias("SpeedKmh"),
        (F.col("event_id") % 11).cast("double").alias("JamFactor"),
        (F.col("user_id") % 20 + 10).cast("double").alias("FreeFlow"),
        (F.lit(0.5) + (F.col("event_id") % 50) / F.lit(100.0)).alias("Confidence"),
        F.col("ts").alias("IngestedAt"))


def registry(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The registry; ``dealt`` for work that makes many rows of each, as one task may scan a large table of few row groups."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = spread(c) if dealt else c
    k = F.col("c_custkey")
    name = (F.when(k % 20 == 3, F.lit("")).when(k % 20 == 7, F.lit(None).cast("string"))
            .otherwise(F.col("c_name")))

    def coord(base: str, mult: int, add: int, i: int) -> F.Column:
        frac = F.lpad(((k * mult + add * i) % 1000000).cast("string"), 6, "0")
        return F.concat(F.lit(base + "."), frac)

    def point(i: int) -> F.Column:
        return F.concat(F.lit('{"lat": '), coord("10", 7919, 104729, i),
                        F.lit(', "lng": '), coord("106", 6151, 7717, i), F.lit("}"))
    shape = (F.when(k % 25 == 4, F.lit(None).cast("string"))
             .when(k % 25 == 9, F.concat(F.lit("["), point(0), F.lit("]")))
             .otherwise(F.concat(F.lit("["), point(0), F.lit(", "), point(1), F.lit(", "), point(2), F.lit("]"))))
    return c.select(
        F.sha2(k.cast("string"), 256).alias("shape_hash"),
        k.alias("segment_index"),
        name.alias("name"),
        shape.alias("shape"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        k.alias("first_seq"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    speeds = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(
        (F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
         + F.make_interval(mins=F.col("vec_id").cast("int"))).alias("Time"),
        F.col("label").cast("long").alias("segment_index"),
        speeds.alias("Speed"),
        F.col("vec_id").alias("seq"))


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around the city; every 50th latitude and 70th longitude is
    pushed out of range to exercise the bounds check."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lat = F.lit(8.0) + ((k * 7919) % 4000) / F.lit(1000.0)
    lng = F.lit(104.0) + ((k * 6151) % 4000) / F.lit(1000.0)
    lat = F.when(k % 50 == 0, lat + F.lit(90.0)).otherwise(lat)
    lng = F.when(k % 70 == 0, lng + F.lit(90.0)).otherwise(lng)
    return c.select(k.alias("point_id"), lat.alias("lat"), lng.alias("lng"))


def globe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over the whole globe, poles and date line included; some latitudes are out of range."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"), (((k * 7919) % 18101) / F.lit(100.0) - F.lit(90.0)).alias("lat"),
        (((k * 6151) % 36001) / F.lit(100.0) - F.lit(180.0)).alias("lng"))


def globe_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of 30 to 2,430 km (one of 10 the largest) around centres that reach both poles and the date line."""
    k = F.col("s_suppkey")
    lat = F.when(k % 7 == 0, F.lit(90.0) - (k % 11) / F.lit(2.0)).when(k % 7 == 1, (k % 11) / F.lit(2.0) - F.lit(90.0)) \
        .otherwise(((k * 911) % 18001) / F.lit(100.0) - F.lit(90.0))
    lng = F.when(k % 5 == 0, F.lit(180.0) - (k % 9) / F.lit(4.0)).otherwise(((k * 6151) % 36001) / F.lit(100.0) - F.lit(180.0))
    radius = F.when(k % 10 == 3, F.lit(2430000.0)).otherwise(F.lit(30000.0) * F.pow(F.lit(3.0), (k % 4).cast("double")))
    return table(spark, sf_dir, "supplier").select(k.alias("circle_id"), lat.alias("lat"), lng.alias("lng"),
                                                   radius.alias("radius_m"))


# --- raw snapshots -------------------------------------------------------

def _num(x: F.Column) -> F.Column:
    return x.cast("string")


def _lat_raw(k: F.Column, i: int) -> F.Column:
    return F.lit(10.6) + ((k * 7919 + i * 104729) % 400000) / F.lit(1e6) + F.lit(3e-8)


def _lng_raw(k: F.Column, i: int) -> F.Column:
    return F.lit(106.5) + ((k * 6151 + i * 7717) % 500000) / F.lit(1e6) + F.lit(3e-8)


def snapshot_docs(spark: SparkSession, sf_dir: str, order: str | None = None) -> DataFrame:
    """One raw JSON document per order: (seq, snapshot_ts, value), in ranges of the orders' column ``order`` if given.

    The document carries the order key as its landing ``seq`` and its
    snapshot key, as our landing format does.
    """
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), order)
    ok = F.col("o_orderkey")
    snap = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")
    # One to three results per document, for neighbouring keys; each key is computed once.
    keys = F.transform(F.sequence(F.lit(0), (ok % 3).cast("int")), lambda i: F.col("o_custkey") + i)
    results = F.transform(keys, lambda k: _result(k, ok))
    doc = F.concat(F.lit('{"results": ['), F.array_join(results, ", "), F.lit('], "seq": '), ok.cast("string"),
                   F.lit(', "snapshot_ts": "'), snap, F.lit('"}'))
    return o.select(ok.alias("seq"), snap.alias("snapshot_ts"), doc.alias("value"))


def _result(k: F.Column, ok: F.Column) -> F.Column:
    """JSON text of one result of order ``ok`` for customer key ``k``.

    Lambda bodies are interpreted node by node, so every part is written once and whole: a part that
    is absent is null, and no other expression asks for it beforehand.
    """
    def lat(i: int) -> F.Column:
        return _num(_lat_raw(k, i))

    def lng(i: int) -> F.Column:
        return _num(_lng_raw(k, i))

    two_links = F.concat(F.lit('"shape": {"links": [{"points": [{"lat": '), F.when(k % 19 == 0, F.lit("11")).otherwise(lat(0)),
                         F.lit(', "lng": '), lng(0), F.lit('}, {"lat": '), lat(1), F.lit(', "lng": '), lng(1),
                         F.lit('}]}, {"points": [{"lat": '), lat(2), F.lit(', "lng": '), lng(2), F.lit("}]}]}"))
    shape = (F.when(k % 23 == 0, F.lit(None).cast("string"))
             .when(k % 13 == 0, F.lit('"shape": {"links": []}'))
             .when(k % 17 == 0, F.lit('"shape": {"links": [{"points": []}]}'))
             .otherwise(two_links))
    desc = (F.when(k % 11 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 0, F.lit('"description": ""'))
            .otherwise(F.concat(F.lit('"description": "Road '), k.cast("string"), F.lit('"'))))
    location = F.concat(F.lit("{"), F.concat_ws(", ", desc, shape), F.lit("}"))
    speed = (F.when(ok % 29 == 0, F.lit(None).cast("string"))
             .when(ok % 31 == 0, F.lit('"speed": null'))
             .otherwise(F.concat(F.lit('"speed": '), _num(F.col("o_totalprice") / F.lit(2e4)))))
    conf = F.when(F.col("o_orderstatus") != "P", F.concat(
        F.lit('"confidence": '), _num(F.lit(0.5) + (ok % 50) / F.lit(100.0))))
    flow = F.concat(F.lit("{"), F.concat_ws(", ", speed,
                    F.concat(F.lit('"jamFactor": '), (ok % 11).cast("string")),
                    F.concat(F.lit('"freeFlow": '), _num((k % 20 + 10).cast("double"))),
                    conf), F.lit("}"))
    return F.concat(F.lit('{"location": '), location,
                      F.when(ok % 37 == 0, F.lit("")).otherwise(F.concat(F.lit(', "currentFlow": '), flow)),
                      F.lit("}"))


def land(docs: DataFrame, path: str) -> None:
    """Land documents as compressed JSON lines, one file per task; a file is small enough to be read whole by one."""
    docs.select("value").write.mode("append").option("compression", "gzip").text(path)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed raw documents: (seq, snapshot_ts, results)."""
    return parsed_docs(snapshot_docs(spark, sf_dir))


def parsed_docs(docs: DataFrame) -> DataFrame:
    """Documents of ``snapshot_docs``, parsed."""
    return docs.select(F.from_json("value", raw_read_schema()).alias("doc")) \
               .select(F.col("doc.results").alias("results"), F.col("doc.seq").alias("seq"),
                       F.col("doc.snapshot_ts").alias("snapshot_ts"))
