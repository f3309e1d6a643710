"""Shape expressions: flatten links, round points, canonical JSON, hash.

The canonical text must equal Python's ``json.dumps(points)`` of the
rounded points byte for byte, because its SHA-256 is the segment identity.
Python prints floats with the shortest repr; a raw integer token stays an
integer. ``to_json`` prints no spaces and Java float text, so the text is
assembled from parts here.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SHAPE_DDL

COORD_DIGITS = 6
#: Above the error of 256 * 10**6 in doubles, 2**28 * 2**-53.
GUARD = 1e-7


def _is_int_token(tok: Column) -> Column:
    return tok.rlike(r"^-?[0-9]+$")


def coord_value(tok: Column, digits: int = COORD_DIGITS) -> Column:
    """Raw coordinate token -> rounded double (integers are exact already)."""
    return let(tok.cast("double"), lambda x: round_binary(x, digits))


def round_binary(x: Column, digits: int = COORD_DIGITS) -> Column:
    """Round the exact binary value of ``x`` half to even, as Python's ``round``.

    The product with ``10**digits`` in doubles is off by less than GUARD for |x| < 256, so
    where it is farther than that from a tie, its nearest integer is the right one.
    The few others are decided exactly:

    ``|x|`` times a power of two is an integer X (below 2**63), so ``|x| * 10**digits``
    is ``X * 10**digits / 2**s`` and its distance to the midpoint is exact in
    decimals. The power suits the size of x, so that no bit of x is lost (but for
    values below 2**-23, which round to 0). Values of 256 and more are no
    coordinates and are rounded on their decimal text.
    """
    tens = 10 ** digits

    def scaled(v: Column) -> Column:
        size = F.abs(v)
        power = F.when(size < 2.0 ** -12, 75).when(size < 0.125, 64).otherwise(55)
        unit = F.when(size < 2.0 ** -12, F.lit(Decimal(2 ** 75))).when(size < 0.125, F.lit(Decimal(2 ** 64)).cast("decimal(23,0)"))
        return F.struct(v.alias("x"), F.floor(size * F.pow(F.lit(2.0), power)).cast("bigint").alias("whole"),
                        unit.otherwise(F.lit(Decimal(2 ** 55)).cast("decimal(23,0)")).alias("unit"),
                        F.floor(size * F.lit(float(tens))).cast("bigint").alias("guess"))

    def rest(v: Column) -> Column:
        exact = v["whole"].cast("decimal(20,0)") * F.lit(Decimal(tens)).cast("decimal(12,0)")
        return F.struct(v["x"].alias("x"), v["unit"].alias("unit"), v["guess"].alias("guess"),
                        (exact - v["guess"].cast("decimal(18,0)") * v["unit"]).cast("decimal(38,0)").alias("rest"))

    def nearest(v: Column) -> Column:
        # The guess comes from a rounded product and may be one off.
        by = F.when(v["rest"] < 0, -1).when(v["rest"] >= v["unit"], 1).otherwise(0)
        twice = (v["rest"] - by.cast("decimal(2,0)") * v["unit"]) * 2
        k = v["guess"] + by
        up = (twice > v["unit"]) | ((twice == v["unit"]) & (k % 2 == 1))
        near = (k + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(tens))
        return F.when(v["x"] == 0, v["x"]).otherwise(near * F.signum(v["x"]))

    exactly = let(let(let(x, scaled), rest), nearest)
    product = x * float(tens)
    clear = F.abs(F.abs(product - F.floor(product)) - 0.5) > GUARD
    return (F.when(x.isNull(), F.lit(None).cast("double")).when((F.abs(x) < 256) & clear, F.rint(product) / float(tens))
            .when(F.abs(x) < 256, exactly).otherwise(F.round(x, digits)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _py_small_text(r: Column) -> Column:
    """Python repr of a 6-decimal value with 0 < |r| < 1e-4 (k * 1e-6)."""
    k = F.round(F.abs(r) * F.lit(1e6)).cast("long")
    sign = F.when(r < 0, F.lit("-")).otherwise(F.lit(""))
    body = (F.when(k < 10, F.concat(k.cast("string"), F.lit("e-06")))
            .when(k % 10 == 0, F.concat((k / 10).cast("long").cast("string"), F.lit("e-05")))
            .otherwise(F.concat((k / 10).cast("long").cast("string"), F.lit("."),
                                (k % 10).cast("string"), F.lit("e-05"))))
    return F.concat(sign, body)


def coord_text(tok: Column, digits: int = COORD_DIGITS) -> Column:
    """Text Python's json.dumps prints for ``round(token, digits)``.

    Most tokens are decimals of common size that are not near a tie: the value that the token
    writes and its double then round alike, and its decimal of ``digits`` places is the text.
    All others, and those that round to a whole number, take the long way.
    """
    tens = 10 ** digits

    def either(product: Column) -> Column:
        near, size = F.rint(product), F.abs(product)
        common = ((F.abs(product - near) < 0.5 - GUARD) & (size >= tens / 1000.0) & (size < 255.0 * tens)
                  & tok.contains(".") & (near.cast("bigint") % tens != 0))
        decimal = F.rtrim(tok.cast(f"decimal({digits + 3},{digits})").cast("string"), F.lit("0"))
        return F.when(common, decimal).otherwise(let(coord_value(tok, digits), lambda r: _text(tok, r, digits)))
    return let(tok.cast("double") * float(tens), either)


def coord(tok: Column, digits: int = COORD_DIGITS) -> Column:
    """``struct<value,text>`` of a raw coordinate token."""
    return F.struct(coord_value(tok, digits).alias("value"), coord_text(tok, digits).alias("text"))


def _text(tok: Column, r: Column, digits: int) -> Column:
    # Plain decimal text of the rounded value, trailing zeros trimmed. Below 256 the value is k / 10**digits for one k.
    tens = 10 ** digits
    k = F.rint(F.abs(r) * float(tens)).cast("long")
    after = F.rtrim(F.lpad((k % tens).cast("string"), digits, "0"), F.lit("0"))
    near = F.concat(F.when(r < 0, F.lit("-")).otherwise(F.lit("")), F.floor(k / tens).cast("string"), F.lit("."),
                    F.when(after == "", F.lit("0")).otherwise(after))
    far = F.regexp_replace(r.try_cast(f"decimal(38,{digits})").cast("string"), "0+$", "")
    far = F.when(far.endswith("."), F.concat(far, F.lit("0"))).otherwise(far)
    fixed = F.when(F.abs(r) < 256, near).otherwise(far)
    return (F.when(tok.isNull(), F.lit("null"))
            .when(_is_int_token(tok), F.regexp_replace(tok, r"^-0$", "0"))
            .when((r == 0) & tok.startswith("-"), F.lit("-0.0"))
            .when(r == 0, F.lit("0.0"))
            .when(F.abs(r) < F.lit(1e-4), _py_small_text(r))
            .otherwise(fixed))


def raw_points(links: Column) -> Column:
    """Flatten ``links[].points[]`` in order; a link without points adds none."""
    per_link = F.transform(F.coalesce(links, F.array()),
                           lambda l: F.coalesce(l["points"], F.array()))
    return F.flatten(per_link)


def round_points(points: Column, digits: int = COORD_DIGITS) -> Column:
    """``array<struct<lat:string,lng:string>>`` -> rounded double points."""
    return F.transform(points, lambda p: F.struct(
        coord_value(p["lat"], digits).alias("lat"),
        coord_value(p["lng"], digits).alias("lng")))


def shape_json(points: Column, digits: int = COORD_DIGITS) -> Column:
    """Canonical JSON text of raw-token points, as Python json.dumps prints it."""
    items = F.transform(points, lambda p: F.concat(
        F.lit('{"lat": '), coord_text(p["lat"], digits), F.lit(', "lng": '), coord_text(p["lng"], digits), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def shape_hash(text: Column) -> Column:
    """SHA-256 hex of the canonical shape text."""
    return F.sha2(text, 256)


def packed_hash(text: Column) -> Column:
    """A hash text as bytes, half as long; any other text as its own bytes, told apart by the first byte."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def unpacked_hash(packed: Column) -> Column:
    """The text of ``packed_hash``."""
    rest = F.substring(packed, 2, 2 ** 31 - 2)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def parse_shape(text: Column) -> Column:
    """Shape JSON text -> points; a missing shape is ``[]``."""
    return F.from_json(F.coalesce(text, F.lit("[]")), SHAPE_DDL)


def shape_center(shape: Column, default_lat: float = 10.776889,
                 default_lng: float = 106.695278) -> Column:
    """Midpoint of the shape's bounding box; the city centre when empty."""
    lats = F.transform(shape, lambda p: p["lat"])
    lngs = F.transform(shape, lambda p: p["lng"])
    empty = F.coalesce(F.size(shape), F.lit(0)) == 0
    return F.struct(
        F.when(empty, F.lit(default_lat)).otherwise(
            (F.array_min(lats) + F.array_max(lats)) / 2).alias("lat"),
        F.when(empty, F.lit(default_lng)).otherwise(
            (F.array_min(lngs) + F.array_max(lngs)) / 2).alias("lng"))
