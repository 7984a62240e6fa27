"""Decimals of 35 digits before and 30 after the point, as pairs, where Spark's 38 digits don't do.

A value is struct<hi decimal(35,0), lo decimal(30,30)>, both with its sign and cut toward zero, so pairs compare as
their values do, field by field.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HI, LO = "decimal(35,0)", "decimal(30,30)"
#: The greatest value, as text; the least is its negative.
GREATEST = "9" * 35 + "." + "9" * 30


def _let(value: Column, body) -> Column:
    """body(x) where x is value, written once in the plan and evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse(text: Column) -> Column:
    """Text to a pair; malformed text is null. Digits past the 30th are cut. A missing integer part is 0."""

    def parsed(t: Column) -> Column:
        whole = F.regexp_extract(t, r"^[+-]?(\d*)\.?(\d*)$", 1)
        part = F.regexp_extract(t, r"^[+-]?(\d*)\.?(\d*)$", 2)
        sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
        hi = F.when(whole == "", F.lit("0")).otherwise(whole).cast(HI)
        lo = F.concat(F.lit("0."), F.rpad(F.substring(part, 1, 30), 30, "0")).cast("decimal(38,30)").cast(LO)
        fine = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
        return F.when(fine, pair((hi * sign).cast(HI), (lo * sign).cast(LO)))

    return _let(F.trim(text), parsed)


def pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast(HI).alias("hi"), lo.cast(LO).alias("lo"))


def constant(text: str) -> Column:
    return parse(F.lit(text))


def zero() -> Column:
    return constant("0")


def greatest() -> Column:
    return constant(GREATEST)


def least() -> Column:
    return constant("-" + GREATEST)


def of_long(x: Column) -> Column:
    return F.when(x.isNotNull(), pair(x.cast("decimal(19,0)"), F.lit(0)))


def _negative(x: Column) -> Column:
    """-x exactly: Spark's unary minus and abs round decimals to 34 digits."""
    return F.lit(0).cast("decimal(1,0)") - x


def _abs(x: Column) -> Column:
    return F.when(x < 0, _negative(x)).otherwise(x)


def of_double(x: Column) -> Column:
    """A double as a pair, by its shortest decimal digits, cut after the 30th after the point; null past 35 digits before it, infinite or no number."""
    size = F.abs(x)
    small = of_decimal(F.when(size < 1e7, x).cast("decimal(38,30)"))
    middle = of_decimal(F.when((size >= 1e7) & (size < 1e18), x).cast("decimal(38,20)"))
    large = F.when((size >= 1e18) & (size < 1e35), pair(F.when((size >= 1e18) & (size < 1e35), x).cast("decimal(38,0)"), F.lit(0)))
    return F.coalesce(small, middle, large)


def of_decimal(x: Column) -> Column:
    """A decimal as a pair; ceiling and floor cut toward zero."""
    hi = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(x.isNotNull(), pair(hi, x % F.lit(1).cast("decimal(1,0)")))


def total(w: Column) -> Column:
    """The sum of pairs, an aggregate: halves are added up, then the small half's whole part is carried. Overflow raises."""

    def carried(s: Column) -> Column:
        one = F.lit(1).cast("decimal(1,0)")
        hi, lo = s["hi"] + F.when(s["lo"] < 0, F.ceil(s["lo"])).otherwise(F.floor(s["lo"])), s["lo"] % one
        return F.struct(hi.alias("hi"), lo.alias("lo"), s["n"].alias("n"))

    def signed(s: Column) -> Column:
        """The halves may differ in sign still; one unit moves."""
        up, down = (s["hi"] > 0) & (s["lo"] < 0), (s["hi"] < 0) & (s["lo"] > 0)
        hi = F.when(up, s["hi"] - 1).when(down, s["hi"] + 1).otherwise(s["hi"])
        lo = F.when(up, s["lo"] + 1).when(down, s["lo"] - 1).otherwise(s["lo"])
        return F.when(s["n"] > 0, pair(hi, lo))

    return _let(_let(F.struct(F.sum(w["hi"]).alias("hi"), F.sum(w["lo"]).alias("lo"), F.count(w["hi"]).alias("n")), carried), signed)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is."""
    sign = lambda s: F.when(s["a"] < s["b"], F.lit(-1)).when(s["a"] == s["b"], F.lit(0)).when(s["a"] > s["b"], F.lit(1))
    return _let(F.struct(a.alias("a"), b.alias("b")), sign)


def absolute(w: Column) -> Column:
    return _let(w, lambda x: F.when(x.isNotNull(), pair(_abs(x["hi"]), _abs(x["lo"]))))


def compare_absolute(a: Column, b: Column) -> Column:
    return compare(absolute(a), absolute(b))


def divided(w: Column, n: Column) -> Column:
    """A pair by a positive long, cut toward zero after the 30th digit: long division by chunks of digits that leave 38 digits enough."""
    ten = lambda k: F.lit(Decimal(10) ** k).cast(f"decimal({k + 1},0)")
    # The operator div gives longs; what is left of a remainder divides exactly.
    whole = lambda x, y: ((x - x % y).cast("decimal(38,0)") / y).cast("decimal(38,0)")

    def step(chunk: str, digits: int):
        """Appends the quotient of the remainder so far, followed by the chunk's digits, to the parts."""

        def one(s: Column) -> Column:
            x = (s["rest"] * ten(digits) + s[chunk]).cast("decimal(38,0)")
            keep = [s[c].alias(c) for c in ("c0", "c1", "c2", "c3", "n", "below")]
            return _let(x, lambda v: F.struct(F.array_append(s["parts"], whole(v, s["n"])).alias("parts"), (v % s["n"]).cast("decimal(19,0)").alias("rest"), *keep))

        return one

    def chunks(s: Column) -> Column:
        digits = F.rpad(F.substring_index(s["lo"].cast("decimal(38,30)").cast("string"), ".", -1), 30, "0")
        return F.struct(
            whole(s["hi"], ten(17)).alias("c0"), (s["hi"] % ten(17)).cast("decimal(38,0)").alias("c1"), F.substring(digits, 1, 15).cast("decimal(38,0)").alias("c2"), F.substring(digits, 16, 15).cast("decimal(38,0)").alias("c3"),
            s["n"].alias("n"), s["below"].alias("below"), F.lit(0).cast("decimal(19,0)").alias("rest"), F.array().cast("array<decimal(38,0)>").alias("parts"),
        )

    def joined(s: Column) -> Column:
        p = lambda k: F.get(s["parts"], F.lit(k))
        hi = (p(0).cast("decimal(18,0)") * ten(17) + p(1).cast("decimal(18,0)")).cast(HI)
        lo = F.concat(F.lit("0."), *[F.lpad(p(k).cast("string"), 15, "0") for k in (2, 3)]).cast("decimal(38,30)").cast(LO)
        return _let(F.struct(hi.alias("hi"), lo.alias("lo")), lambda x: F.when(s["below"], pair(_negative(x["hi"]), _negative(x["lo"]))).otherwise(pair(x["hi"], x["lo"])))

    def start(s: Column) -> Column:
        below = (s["w"]["hi"] < 0) | (s["w"]["lo"] < 0)
        x = F.struct(_abs(s["w"]["hi"]).cast("decimal(38,0)").alias("hi"), _abs(s["w"]["lo"]).cast(LO).alias("lo"), s["n"].alias("n"), below.alias("below"))
        x = _let(x, chunks)
        for c, k in (("c0", 18), ("c1", 17), ("c2", 15), ("c3", 15)):
            x = _let(x, step(c, k))
        return F.when(s["w"].isNotNull() & (s["n"] > 0), _let(x, joined))

    return _let(F.struct(w.alias("w"), F.when(n > 0, n).cast("decimal(19,0)").alias("n")), start)


def average(w: Column) -> Column:
    """The mean of pairs, an aggregate, cut after the 30th digit."""
    return divided(total(w), F.count(w["hi"]))


def render(w: Column) -> Column:
    """A pair as text: no trailing zeros, but one digit after the point at least."""

    def rendered(x: Column) -> Column:
        digits = F.rpad(F.substring_index(_abs(x["lo"]).cast("decimal(38,30)").cast("string"), ".", -1), 30, "0")
        digits = F.regexp_replace(digits, "0+$", "")
        sign = F.when((x["hi"] < 0) | (x["lo"] < 0), "-").otherwise("")
        return F.concat(sign, _abs(x["hi"]).cast(HI).cast("string"), F.lit("."), F.when(digits == "", "0").otherwise(digits))

    return _let(w, rendered)
