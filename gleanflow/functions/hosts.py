"""International host names in their ASCII form, as column expressions.

A label with characters beyond ASCII becomes ``xn--`` and its Punycode. Taken are lower-case letters that stay themselves when a
name is mapped and composed: Latin, Greek, Cyrillic, Armenian, Georgian, Hebrew, Arabic, Kana, Han and Hangul syllables. A name with any other
character (marks, full-width forms, ligatures, signs) would need mapping tables; it has no ASCII form here and is reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the encoding.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Characters that stand for the dot between labels.
DOTS = "。．｡"
_RIGHT_TO_LEFT = r"א-תؠ-ؿف-ي"
_LEFT_TO_RIGHT = (
    r"ß-öø-ıĴ-ľŁ-ňŊ-žΐά-ώа-џա-ֆა-ჺ"
    r"ぁ-ゖァ-ヺー㐀-䶿一-鿿가-힣"
)
_PLAIN = r"a-z0-9_\-"
# A label is of one direction; one that runs right to left has letters only.
_LABEL = rf"^([{_PLAIN}{_LEFT_TO_RIGHT}]*|[{_RIGHT_TO_LEFT}]+)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(delta: Column, bias: Column) -> Column:
    """A number as digits of falling weight, the last one below its threshold."""

    def step(state: Column, k: Column) -> Column:
        threshold = F.least(F.greatest(k - bias, F.lit(T_MIN).cast("bigint")), F.lit(T_MAX).cast("bigint"))
        rest = state["rest"] - threshold
        last = rest < 0
        digit = F.when(last, state["rest"]).otherwise(threshold + F.pmod(rest, BASE - threshold))
        letter = F.substring(F.lit(DIGITS), (digit + 1).cast("int"), F.lit(1))
        return F.when(state["done"], state).otherwise(
            F.struct(
                F.floor(rest / (BASE - threshold)).cast("bigint").alias("rest"),
                F.concat(state["out"], letter).alias("out"),
                last.alias("done"),
            )
        )

    start = F.struct(delta.cast("bigint").alias("rest"), F.lit("").alias("out"), F.lit(False).alias("done"))
    places = F.array(*[F.lit(BASE * k).cast("bigint") for k in range(1, 9)])
    return F.aggregate(places, start, step, lambda state: state["out"])


def _next_bias(delta: Column, points: Column, first: Column) -> Column:
    """The threshold shift after a number: large numbers make room for large ones."""
    scaled = F.floor(delta / F.when(first, DAMP).otherwise(2)).cast("bigint")
    limit = (BASE - T_MIN) * T_MAX // 2

    def shrink(state: Column, _: Column) -> Column:
        return F.when(
            state["d"] > limit,
            F.struct(F.floor(state["d"] / (BASE - T_MIN)).cast("bigint").alias("d"), (state["k"] + BASE).alias("k")),
        ).otherwise(state)

    start = _let(scaled, lambda d: F.struct((d + F.floor(d / points).cast("bigint")).alias("d"), F.lit(0).cast("bigint").alias("k")))
    turns = F.array(*[F.lit(i) for i in range(6)])
    return F.aggregate(
        turns, start, shrink, lambda s: s["k"] + F.floor((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW)).cast("bigint")
    )


def punycode(label: Column) -> Column:
    """ASCII characters first, then where the others go in, smallest code point first."""
    codes = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("bigint"))

    def encoded(codes: Column) -> Column:
        plain = F.regexp_replace(label, r"[^\x00-\x7F]", "")
        others = F.sort_array(
            F.filter(
                F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at"))), lambda x: x["code"] >= FIRST_CODE
            )
        )

        def insert(state: Column, x: Column) -> Column:
            place = F.size(F.filter(F.slice(codes, F.lit(1), x["at"]), lambda c: c <= x["code"])).cast("bigint")

            def written(both: Column) -> Column:
                delta, place = both["delta"], both["place"]
                return F.struct(
                    x["code"].alias("code"),
                    (place + 1).alias("at"),
                    (state["n"] + 1).alias("n"),
                    _next_bias(delta, state["n"] + 1, state["first"]).alias("bias"),
                    F.lit(False).alias("first"),
                    F.concat(state["out"], _digits(delta, state["bias"])).alias("out"),
                )

            return _let(
                _let(place, lambda p: F.struct(((x["code"] - state["code"]) * (state["n"] + 1) + p - state["at"]).alias("delta"), p.alias("place"))),
                written,
            )

        long = lambda value: F.lit(value).cast("bigint")
        start = F.struct(
            long(FIRST_CODE).alias("code"), long(0).alias("at"), F.length(plain).cast("bigint").alias("n"), long(FIRST_BIAS).alias("bias"),
            F.lit(True).alias("first"), F.lit("").alias("out"),
        )
        tail = F.aggregate(others, start, insert, lambda state: state["out"])
        return F.concat(F.when(plain != "", F.concat(plain, F.lit("-"))).otherwise(""), tail)

    return _let(codes, encoded)


def ascii_host(host: Column) -> Column:
    """The ASCII form of a lower-case host, null where it has none here."""
    labels = F.split(F.translate(host, DOTS, "..."), r"\.")

    def form(labels: Column) -> Column:
        fits = F.forall(labels, lambda label: F.rlike(label, F.lit(_LABEL)))
        # With a label from right to left no other may begin with a digit.
        mixed = F.exists(labels, lambda label: F.rlike(label, F.lit(f"[{_RIGHT_TO_LEFT}]"))) & F.exists(
            labels, lambda label: F.rlike(label, F.lit("^[0-9]"))
        )
        coded = F.transform(
            labels,
            lambda label: F.when(F.rlike(label, F.lit(r"[^\x00-\x7F]")), F.concat(F.lit("xn--"), punycode(label))).otherwise(label),
        )
        return F.when(fits & ~mixed, F.array_join(coded, "."))

    return F.when(F.rlike(host, F.lit(r"[^\x00-\x7F]")), _let(labels, form)).otherwise(host)
