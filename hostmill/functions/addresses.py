"""IPv6 text by array expressions, inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import is_ipv4

UNKNOWN = "::"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pair(dotted: Column, k: int) -> Column:
    """Two of the four numbers of a dotted address, from the k-th, as one group of hex digits."""
    n = F.split(dotted, "\\.")
    return F.lower(F.hex(F.get(n, F.lit(k)).try_cast("int") * 256 + F.get(n, F.lit(k + 1)).try_cast("int")))


def _without_dots(text: Column) -> Column:
    """A dotted tail as two groups; null if it is no address."""
    tail = F.substring_index(text, ":", -1)
    head = text.substr(F.lit(1), F.length(text) - F.length(tail))
    return F.when(~F.contains(text, F.lit(".")), text).when(is_ipv4(tail), F.concat(head, _pair(tail, 0), F.lit(":"), _pair(tail, 2)))


def _groups(text: Column) -> Column:
    """The eight groups in lower case without leading zeros, or null."""
    some = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def filled(halves: Column) -> Column:
        left, right = some(F.get(halves, F.lit(0))), F.when(F.size(halves) == 2, some(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        whole = F.when((F.size(halves) == 1) & (n == 8), left)
        return whole.when((F.size(halves) == 2) & (n < 8), F.concat(left, F.array_repeat(F.lit("0"), 8 - n), right))

    groups = _let(F.split(text, "::", -1), filled)
    plain = lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))
    return _let(groups, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}\\z")), F.transform(g, plain)))


def _compressed(groups: Column) -> Column:
    """Groups as text, the first of the longest runs of two zeros and more as ``::``."""

    def cut(text: Column) -> Column:
        out = None
        for k in range(8, 1, -1):
            run = ":" + "0:" * k
            at = F.instr(text, run)
            end = at + len(run)
            short = F.concat(text.substr(F.lit(2), at - 2), F.lit("::"), text.substr(end, F.length(text) - end))
            out = F.when(at > 0, short) if out is None else out.when(at > 0, short)
        return out.otherwise(text.substr(F.lit(2), F.length(text) - 2))

    return _let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), cut)


def _dotted(groups: Column) -> Column:
    """The address of an IPv4 host in IPv6, as dotted text, or null for any other."""
    number = lambda k: F.conv(F.get(groups, F.lit(k)), 16, 10).cast("int")
    said = lambda k: F.concat_ws(".", F.floor(number(k) / 256).cast("string"), (number(k) % 256).cast("string"))
    mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff"
    return F.when(mapped, F.concat(F.lit("::ffff:"), said(6), F.lit("."), said(7)))


def to_ipv6(text: Column) -> Column:
    """Canonical IPv6; IPv4 is mapped, anything else, zones too, is ``::``."""
    groups = _groups(_without_dots(text))
    canonical = _let(groups, lambda g: F.coalesce(_dotted(g), _compressed(g)))
    mapped = F.when(is_ipv4(text), F.concat(F.lit("::ffff:"), text))
    return F.coalesce(mapped.when(F.contains(text, F.lit(":")), canonical), F.lit(UNKNOWN))


def with_ipv6(df: DataFrame, *names: str) -> DataFrame:
    """Address columns as canonical IPv6 text."""
    return df.withColumns({n: to_ipv6(F.col(n)) for n in names})
