"""Column-level helpers built only from Spark's built-in functions.

Everything here but ``once`` returns a ``Column`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classes import CLASSES, CLASSES_HUMAN, THRESHOLD

# One definition of words and blanks for every tokeniser: words are runs of
# letters, letter numbers, marks, decimal digits and connectors; blanks are the
# Unicode white space characters (Java's \s alone is ASCII).
WORD_CLASS = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"
BLANK_CLASS = r"\x09-\x0D\x20\x{85}\p{Z}"
# Word-or-punctuation pre-tokeniser.
WORD_PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{BLANK_CLASS}]+"
# Words only (no punctuation), used by the lexicon scorer.
TERM_PATTERN = rf"[{WORD_CLASS}]+"
# What str.split() splits at: blanks and the four separator controls.
SPLIT_PATTERN = rf"[{BLANK_CLASS}\x1C-\x1F]+"

_TWO32 = 4294967296.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_int(key: str | Column, salt: str) -> Column:
    """First 32 bits of md5(key || ':' || salt) as a non-negative BIGINT.

    Deterministic under task retry (unlike ``rand()``) and identical to the
    DuckDB expression ``('0x'||substr(md5(k||':salt'),1,8))::BIGINT``.
    """
    h = F.md5(F.concat(col(key).cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_unit(key: str | Column, salt: str) -> Column:
    """Uniform value in [0, 1) from the key; a repeatable ``uniform(0, 1)``."""
    return hash_int(key, salt) / F.lit(_TWO32)


def pick(values: Column, key: str | Column, salt: str) -> Column:
    """Repeatable ``random.choice``: element of an array chosen by a hash."""
    idx = (hash_int(key, salt) % F.size(values)).cast("int") + F.lit(1)
    return F.when(F.size(values) > 0, F.element_at(values, idx))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def over(c: str | Column, threshold: float = THRESHOLD) -> Column:
    """Strict threshold: a score of exactly ``threshold`` is not a hit."""
    return col(c) > F.lit(threshold)


def n_over(classes: Sequence[str] = CLASSES, threshold: float = THRESHOLD) -> Column:
    """Number of classes whose score is over the threshold (BIGINT)."""
    total = None
    for c in classes:
        term = over(c, threshold).cast("bigint")
        total = term if total is None else total + term
    return total


def max_score(classes: Sequence[str] = CLASSES) -> Column:
    return F.greatest(*[F.col(c) for c in classes])


def argmax_name(values: Sequence[Column], names: Sequence[str] = CLASSES_HUMAN) -> Column:
    """Name of the largest value; the first one wins ties (as numpy argmax)."""
    vals = F.array(*values)
    pos = F.array_position(vals, F.array_max(vals)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), pos)


def words(text: str | Column) -> Column:
    """Whitespace split as Python's ``str.split()``: no empty tokens."""
    return F.filter(F.split(col(text), SPLIT_PATTERN), lambda t: t != F.lit(""))


def tokens(text: str | Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), 0)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with columns added (or replaced) whose expressions are evaluated once a row.

    They pass a one-row generator. A plain projection would be repeated in every
    filter and aggregate that Catalyst moves below it.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


def fixed(x: str | Column, decimals: int) -> Column:
    """``f"{x:.2f}"`` for 0 <= x < 2000: the exact binary value, ties to even.

    The value is taken apart as a whole number of 2^-52 (2^-60 below 1), which
    a BIGINT holds exactly, and rounded with exact decimal arithmetic.
    """
    unit = 10 ** decimals

    def dec(c: Column, digits: int = 19) -> Column:
        return c.cast(f"decimal({digits},0)")

    def text(v: Column) -> Column:
        scale = F.when(v < 1, F.lit(2 ** 60)).otherwise(F.lit(2 ** 52)).cast("bigint")
        exact = dec((v * scale.cast("double")).cast("bigint")) * dec(F.lit(unit), 5)
        return let(F.struct(exact.alias("e"), scale.alias("s")), rounded)

    def rounded(x: Column) -> Column:
        # the quotient may be rounded up in its last place: step back
        near = F.floor(x["e"] / dec(x["s"])).cast("bigint")
        whole = let(near, lambda q: q - (dec(q) * dec(x["s"]) > x["e"]).cast("bigint"))
        return let(whole, lambda q: let((x["e"] - dec(q) * dec(x["s"])) * dec(F.lit(2), 1) - dec(x["s"]), lambda over_half: let(
            q + ((over_half > 0) | ((over_half == 0) & (q % 2 == 1))).cast("bigint"), written)))

    def written(n: Column) -> Column:
        return F.concat(F.floor(n / unit).cast("bigint").cast("string"), F.lit("."),
                        F.lpad((n % unit).cast("string"), decimals, "0"))

    return let(col(x).cast("double"), text)


def percent(p: str | Column, decimals: int = 2) -> Column:
    """``f"{p*100:.2f}%"``."""
    return F.concat(fixed(col(p) * F.lit(100.0), decimals), F.lit("%"))


def rate_lines(names: Sequence[str] = CLASSES_HUMAN, classes: Sequence[str] = CLASSES,
               sep: str = "\n") -> Column:
    """``name: 12.34%`` per class, joined by ``sep``."""
    parts = [F.concat(F.lit(n + ": "), percent(c)) for n, c in zip(names, classes)]
    return F.concat_ws(sep, *parts)


def shorten(text: str | Column, limit: int, keep: int) -> Column:
    t = col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit("..."))) \
        .otherwise(t)


def display_name(name: str | Column, discriminator: str | Column) -> Column:
    """``name#discriminator``."""
    return F.concat_ws("#", col(name), col(discriminator))
