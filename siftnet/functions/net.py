"""Addresses, MACs and prefixes as Column functions. Spark has no address type; the canonical text form is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftnet.functions import binary

# Fixed pattern: dotted quad without leading zeros.
IPV4_PATTERN = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"

ALL_ONES = 0xFFFFFFFF


def hex_digits(value: Column) -> Column:
    """Lower-case hex digits, without the locale rules of ``lower``."""
    return F.translate(F.hex(value), "ABCDEF", "abcdef")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. Used where a long expression would otherwise be repeated inside
    itself and the plan would grow with every repetition."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4_PATTERN)


def ipv4_number(text: Column) -> Column:
    """Dotted quad as BIGINT, null for other text."""
    parts = F.split(text, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(is_ipv4(text), value)


def ipv4_text(number: Column) -> Column:
    """BIGINT as dotted quad."""
    octets = [F.shiftright(number, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ipv4_from_bytes(data: Column, offset: int | Column = 0) -> Column:
    return ipv4_text(binary.uint(data, offset, 4))


def _compress(groups: Column) -> Column:
    """``:g1:...:g8:`` to text with the first longest run of two or more zero groups shortened."""
    result = F.trim(groups, F.lit(":"))
    for run in range(2, 9):
        zeros = ":0" * run + ":"
        at = F.instr(groups, zeros)
        left = F.ltrim(F.substring(groups, F.lit(1), at - 1), F.lit(":"))
        right = F.rtrim(F.substring(groups, at + len(zeros), F.lit(80)), F.lit(":"))
        result = F.when(at > 0, F.concat(left, F.lit("::"), right)).otherwise(result)
    return result


def _ipv6_digits_text(digits: Column) -> Column:
    """32 lower-case hex digits as text; an IPv4-mapped address prints as IPv4."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
    )
    mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
    return F.when(digits.startswith("0" * 20 + "ffff"), ipv4_text(mapped)).otherwise(
        let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), _compress)
    )


def ipv6_from_bytes(data: Column) -> Column:
    """16 bytes as text, null for any other length."""
    return F.when(F.length(data) == 16, let(hex_digits(data), _ipv6_digits_text))


def ipv4_from_octets(array: Column, offset: int | Column) -> Column:
    """Four octets of an array as text, null past its end."""
    parts = [F.get(array, (offset if isinstance(offset, Column) else F.lit(offset)) + i) for i in range(4)]
    return F.when(parts[3].isNotNull(), F.concat_ws(".", *[p.cast("string") for p in parts]))


def ipv6_from_octets(array: Column, offset: int | Column) -> Column:
    """Sixteen octets of an array as text, null past its end."""
    start = offset if isinstance(offset, Column) else F.lit(offset)
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.get(array, start + i * 2).cast("int") * 256 + F.get(array, start + i * 2 + 1).cast("int"),
    )

    def written(groups: Column) -> Column:
        mapped = (F.array_position(groups, 65535) == 6) & F.forall(F.slice(groups, 1, 5), lambda g: g == 0)
        text = F.concat(F.lit(":"), F.array_join(F.transform(groups, lambda g: hex_digits(g)), ":"), F.lit(":"))
        return F.when(mapped, ipv4_from_octets(array, start + 12)).otherwise(let(text, _compress))

    return F.when(F.get(array, start + 15).isNotNull(), let(pairs, written))


def ip_from_bytes(data: Column) -> Column:
    """4 or 16 bytes as text, null for any other length."""
    return F.when(F.length(data) == 4, ipv4_from_bytes(data)).otherwise(ipv6_from_bytes(data))


def _plain_ipv6(text: Column) -> Column:
    """A dotted-quad tail rewritten as two hex groups."""
    tail = F.regexp_extract(text, r":([0-9.]+)$", 1)
    digits = F.lpad(hex_digits(ipv4_number(tail)), 8, "0")
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    dotted = let(digits, lambda d: F.concat(head, F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
    return F.when(F.instr(text, ".") > 0, dotted).otherwise(text)


def _ipv6_groups(plain: Column) -> Column:
    """Eight groups of a plain IPv6 text, null if it is none."""
    halves = F.split(plain, "::", -1)
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    missing = 8 - F.size(left) - F.size(right)
    shape = r"^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?(::([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?)?$"
    valid = plain.rlike(shape) & F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0)
    return F.when(valid, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))


def ipv6_bytes(text: Column) -> Column:
    """IPv6 text as 16 bytes, null if it is none. A dotted-quad tail is accepted."""
    groups = F.when(text.contains(":"), let(_plain_ipv6(text), _ipv6_groups))
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def canonical_ip(text: Column) -> Column:
    """The one text form of an address, null if it is none."""
    return F.when(is_ipv4(text), text).otherwise(let(ipv6_bytes(text), ipv6_from_bytes))


# ------------------------------------------------------------------------------------------------------------- MACs


def mac_from_bytes(data: Column, *, upper: bool = False) -> Column:
    """Six bytes as colon-separated text, empty for any other length."""
    spaced = F.regexp_replace(F.hex(data), "(..)(?=.)", "$1:")
    return F.when(F.length(data) == 6, spaced if upper else F.lower(spaced)).otherwise("")


def is_unicast_mac(mac: Column) -> Column:
    """Six octets, not a group address, not all zero."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).try_cast("bigint")
    shape = mac.rlike("^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}$")
    group = first.bitwiseAND(F.lit(1).cast("bigint")) != 0
    return F.coalesce(shape & ~group & (mac != "00:00:00:00:00:00"), F.lit(False))


# --------------------------------------------------------------------------------------------------------- prefixes


def range_to_cidr(begin: Column, end: Column) -> Column:
    """Address range as prefix: a clean power-of-two span becomes ``begin/len`` (begin is not masked), any other range
    ``begin-end``; text that is no address is returned as it came."""
    b, e = ipv4_number(begin), ipv4_number(end)
    differing = b.bitwiseXOR(e)
    clean = differing.bitwiseAND(differing + 1) == 0
    prefix = F.lit(32) - F.bit_count(differing)
    blank_end = F.coalesce(end, F.lit("")) == ""
    return (
        F.when(F.coalesce(begin, F.lit("")) == "", "")
        .when(begin == "0.0.0.0", "0.0.0.0/0")
        .when(b.isNull(), begin)
        .when(blank_end | (begin == end), F.concat(begin, F.lit("/32")))
        .when(e.isNull(), begin)
        .when(clean, F.concat(begin, F.lit("/"), prefix.cast("string")))
        .otherwise(F.concat(begin, F.lit("-"), end))
    )


def contiguous_mask(mask: Column) -> Column:
    inverse = F.lit(ALL_ONES) - ipv4_number(mask)
    return F.coalesce(inverse.bitwiseAND(inverse + 1) == 0, F.lit(False))


def subnet_to_cidr(address: Column, mask: Column) -> Column:
    """Address and dotted mask as canonical network prefix, empty if either is unusable."""
    a, m = ipv4_number(address), ipv4_number(mask)
    network = F.concat(ipv4_text(a.bitwiseAND(m)), F.lit("/"), F.bit_count(m).cast("string"))
    return F.when(a.isNotNull() & contiguous_mask(mask), network).otherwise("")


def range_text(begin: Column, end: Column) -> Column:
    """``''``, ``begin/32`` or ``begin-end``."""
    blank = F.coalesce(begin, F.lit("")) == ""
    single = (F.coalesce(end, F.lit("")) == "") | (begin == end)
    return F.when(blank, "").when(single, F.concat(begin, F.lit("/32"))).otherwise(F.concat(begin, F.lit("-"), end))
