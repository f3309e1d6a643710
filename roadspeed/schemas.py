"""Declared schemas for every table the engine reads or writes.

Nothing is inferred: mixed int/float JSON values and empty batches would
otherwise break type inference.
"""

from pyspark.sql import types as T

# A shape point as read from the raw feed. Coordinates are read as STRING so
# that the raw token survives (an integer token such as ``10`` must hash as
# ``10``, not ``10.0``); ``functions.shape`` turns them into doubles.
RAW_POINT = T.StructType([
    T.StructField("lat", T.StringType()),
    T.StructField("lng", T.StringType()),
])

RAW_RESULT = T.StructType([
    T.StructField("location", T.StructType([
        T.StructField("description", T.StringType()),
        T.StructField("shape", T.StructType([
            T.StructField("links", T.ArrayType(T.StructType([
                T.StructField("points", T.ArrayType(RAW_POINT)),
            ]))),
        ])),
    ])),
    # A map keeps "key absent" and "key present with null" apart, which the
    # defaulting rule needs (absent -> 0, explicit null -> null).
    T.StructField("currentFlow", T.MapType(T.StringType(), T.StringType())),
])

RAW_SNAPSHOT = T.StructType([
    T.StructField("results", T.ArrayType(RAW_RESULT)),
    # Optional landing sequence number of the document (our landing format
    # writes it; provider documents lack it and fall back to snapshot time).
    T.StructField("seq", T.LongType()),
])

POINT = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])
SHAPE = T.ArrayType(POINT)
SHAPE_DDL = "array<struct<lat:double,lng:double>>"

REGISTRY = T.StructType([
    T.StructField("shape_hash", T.StringType(), False),
    T.StructField("segment_index", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("shape", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("first_seq", T.LongType()),
])

TRANSFORMED = T.StructType([
    T.StructField("segment_index", T.LongType()),
    T.StructField("shape_hash", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("speed_ms", T.DoubleType()),
    T.StructField("jam_factor", T.DoubleType()),
    T.StructField("free_flow_speed", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("speed_kmh", T.DoubleType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("snapshot_ts", T.StringType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("pos", T.LongType()),
])

SPEED_RECORDS = T.StructType([
    T.StructField("segment_index", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("Speed", T.DoubleType()),
    T.StructField("SpeedKmh", T.DoubleType()),
    T.StructField("JamFactor", T.DoubleType()),
    T.StructField("FreeFlow", T.DoubleType()),
    T.StructField("Confidence", T.DoubleType()),
    T.StructField("IngestedAt", T.TimestampNTZType()),
    # Identity of a record, the same in every replay.
    T.StructField("snapshot_ts", T.StringType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("pos", T.LongType()),
])

PREDICTIONS = T.StructType([
    T.StructField("Time", T.TimestampNTZType()),
    T.StructField("segment_index", T.LongType()),
    T.StructField("Speed", T.ArrayType(T.DoubleType())),
    T.StructField("seq", T.LongType()),
])
