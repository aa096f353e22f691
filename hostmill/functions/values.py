"""Scalar column functions: numbers, names, keys, addresses and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finite decimal number as Go and JSON write it: no type suffix, no NaN.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


#: The characters that Unicode calls white space; fixed values.
WHITE_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def finite_number(text: Column) -> Column:
    """The number a text stands for, or null."""
    n = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def is_percent_name(var: Column) -> Column:
    name = F.lower(strip(var))
    return (name == "util") | name.endswith("_util")


def kind_is_percent(kind: Column) -> Column:
    """True for the percent names, false for the number names, null for any other."""
    k = strip(F.lower(kind))
    return F.when(k.isin("number", "num", "uint64"), False).when(k.isin("percent", "pct", "%", "uint8_percent"), True)


def normalised(raw: Column, is_percent: Column) -> Column:
    """Stored value: negatives and NaN are 0, halves round away from zero, percents end at 100.

    Beyond the 64-bit range the result is null.
    """
    positive = F.when(F.isnan(raw) | (raw <= 0), F.lit(0.0)).otherwise(raw)
    rounded = F.round(positive)
    capped = F.when(is_percent, F.least(rounded, F.lit(100.0))).otherwise(rounded)
    return capped.try_cast("bigint")


def short_name(name: Column) -> Column:
    """A metric name without its first segment, unless the underscore starts or ends it."""
    at = F.locate("_", name)
    return F.when((at > 1) & (at < F.length(name)), F.substring(name, at + 1, F.length(name))).otherwise(name)


def device_path(name: Column) -> Column:
    n = strip(name)
    return F.when(n == "", F.lit("/dev/unknown")).when(n.startswith("/"), n).otherwise(F.concat(F.lit("/dev/"), n))


def is_base_disk(name: Column) -> Column:
    """Whole disks and unknown devices; no partition, loop or RAM device, no blank name."""
    n = F.regexp_replace(strip(name), "^/dev/", "")
    part = r"^(?:(?:sd|vd|xvd|hd)[a-z]+[0-9]+|nvme[0-9]+n[0-9]+p[0-9]+|mmcblk[0-9]+p[0-9]+|(?:loop|ram)[0-9]+)$"
    return (n != "") & ~n.rlike(part)


def average_or_zero(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def proto_name(proto: Column) -> Column:
    return F.when(proto == 6, "tcp").when(proto == 17, "udp").otherwise(proto.cast("string"))


def flow_key(iface: Column, proto: Column, src: Column, src_port: Column, dst: Column, dst_port: Column) -> Column:
    return F.concat_ws("|", iface, proto_name(proto), src, src_port.cast("string"), dst, dst_port.cast("string"))


def flow_parts(key: Column) -> Column:
    return F.split(key, "[|]", -1)


def is_ipv4(text: Column) -> Column:
    return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def port_or_zero(text: Column) -> Column:
    n = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.when(n <= 65535, n), F.lit(0))


def int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def hex_number(text: Column) -> Column:
    """An unsigned hexadecimal number up to 63 bits, or null."""
    return F.when(text.rlike("^[0-9A-Fa-f]+$"), F.conv(text, 16, 10).try_cast("bigint"))


def decimal_or_hex(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), hex_number(text))


def before_send(dt_ms: Column, dts: Column) -> Column:
    """The window's start stays below its send second."""
    return F.when(F.floor(dt_ms / 1000) >= dts, F.greatest((dts - 1) * 1000, F.lit(0))).otherwise(dt_ms).cast("bigint")


def address_text(address: Column, is_v4: Column) -> Column:
    """Dotted text of 16-byte IPv4 addresses (zeros before the last four bytes); others null."""
    octets = [F.conv(F.hex(F.substring(address, k, 1)), 16, 10) for k in (13, 14, 15, 16)]
    return F.when(is_v4, F.concat_ws(".", *octets))
