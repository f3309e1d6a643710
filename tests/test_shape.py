"""Canonical shape text must equal Python's json.dumps of rounded points."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadspeed.functions import shape as S
from roadspeed.schemas import RAW_POINT
from pyspark.sql import types as T


def _python_text(tokens):
    pts = []
    for lat, lng in tokens:
        def val(t):
            v = json.loads(t)
            return round(v, 6)
        pts.append({"lat": val(lat), "lng": val(lng)})
    return json.dumps(pts)


coords = st.one_of(
    st.floats(min_value=-180, max_value=180, allow_nan=False),
    st.integers(min_value=-180, max_value=180).map(float),
    st.sampled_from([0.0, -0.0, 1e-7, -1e-7, 5e-5, 1.2e-5, 0.0001, -0.00004, 10.0000005, 106.6953775]),
)
tokens = st.one_of(coords.map(repr), st.integers(min_value=-180, max_value=180).map(str))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(tokens, tokens), min_size=0, max_size=4), min_size=1, max_size=6))
def test_shape_json_matches_python(spark, shapes):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("pts", T.ArrayType(RAW_POINT))])
    rows = [(i, [{"lat": a, "lng": b} for a, b in s]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, schema)
    got = {r.i: (r.j, r.h) for r in df.select("i", S.shape_json(F.col("pts")).alias("j"),
                                              S.shape_hash(S.shape_json(F.col("pts"))).alias("h")).collect()}
    for i, s in enumerate(shapes):
        want = _python_text(s)
        assert got[i][0] == want, (s, got[i][0], want)
        assert got[i][1] == hashlib.sha256(want.encode()).hexdigest()


def test_parse_shape_and_center(spark):
    df = spark.createDataFrame([('[{"lat": 1.0, "lng": 2.0}, {"lat": 3.0, "lng": 6.0}]',), (None,)], "s string")
    out = df.select(S.parse_shape(F.col("s")).alias("p")).select(
        F.size("p").alias("n"), S.shape_center(F.col("p")).alias("c")).collect()
    assert out[0].n == 2 and (out[0].c.lat, out[0].c.lng) == (2.0, 4.0)
    assert out[1].n == 0 and (out[1].c.lat, out[1].c.lng) == (10.776889, 106.695278)


def test_rounding_equals_python_on_ties_and_elsewhere(spark):
    import random
    from pyspark.sql import functions as F
    from roadspeed.functions.shape import coord_text
    rng = random.Random(5)
    toks = [f"{rng.randint(-179, 179)}.{rng.randint(0, 999999):06d}5" for _ in range(1500)]
    toks += [f"{s}0.{rng.randint(0, 1249):04d}{rng.randint(0, 99):02d}5" for s in ("", "-") for _ in range(300)]
    toks += [repr(k / 128) for k in range(-200, 200)] + ["10.7760015", "0.0000005", "-0.0000005", "0.0000015", "4e-7", "0.124999999999", "255.9999995"]
    toks += [repr(rng.uniform(-180, 180)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in toks], "t string").repartition(4)
    for t, got in df.select("t", coord_text(F.col("t"))).collect():
        x = float(t)
        want = repr(round(x, 6)) if not t.lstrip("-").isdigit() else t
        assert got == want, (t, got, want)


def test_common_and_odd_tokens_print_as_python_does(spark):
    tokens = ["10.61264803", "11", "-0", "0.0", "-0.0", "0.000999", "0.001", "254.9999995", "1.0000005", "2.5000005", "-10.5", "1e2", "12.", ".5", "-179.99999951"]
    rows = spark.createDataFrame([(t,) for t in tokens], "tok string").select("tok", S.coord(F.col("tok")).alias("c")).collect()
    for r in rows:
        value = int(r.tok) if r.tok.lstrip("-").isdigit() else round(float(r.tok), 6)
        assert r.c.value == value and (r.c.text == json.dumps(value) or r.tok == "1e2")
