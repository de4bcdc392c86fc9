"""Hosts, URLs and addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.session import let

# Special-purpose IPv4 blocks (IANA registry) that are not public.
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
# IPv6 blocks of the same registry.  Only 2000::/3 is assigned to public unicast; of it these are not public
# (the first one except for the blocks after it).
GLOBAL_V6 = ("2000::", 3)
PROTOCOL_V6 = ("2001::", 23)
PUBLIC_IN_PROTOCOL_V6 = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]
PRIVATE_V6 = [("2001:db8::", 32), ("2002::", 16)]


def has_scheme(target: Column) -> Column:
    return F.startswith(target, F.lit("http://")) | F.startswith(target, F.lit("https://"))


def host_of_url(url: Column) -> Column:
    """Lower-cased host name, or null."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def hostname(target: Column) -> Column:
    """The bare host a domain check works on."""
    bare = F.when(has_scheme(target), F.coalesce(host_of_url(target), target)).otherwise(target)
    return F.rtrim(F.lower(F.trim(F.trim(bare), F.lit("/"))), F.lit("."))




def ipv4_number(address: Column) -> Column:
    """The address as an integer; null unless it is a dotted quad within range."""
    quad = address.rlike(r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\z)){4}(?<!\.)\z")

    def number(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.cast("bigint"))

    return F.when(quad, number(F.split(address, r"\.")))


def _block(address: str, bits: int) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in address.split("."))
    low = a * 16777216 + b * 65536 + c * 256 + d
    return low, low + (1 << (32 - bits)) - 1


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address as 32 lower-case hex digits, which compare like numbers; null when unparsable.

    A zone is left out, an embedded IPv4 address counts as two groups, ``::`` as the groups that are missing.
    """
    def with_quad(bare: Column) -> Column:
        def as_groups(number: Column) -> Column:
            return F.concat(F.regexp_replace(bare, r"[0-9.]+\z", ""), F.lower(F.hex(F.floor(number / 65536))), F.lit(":"), F.lower(F.hex(number % 65536)))

        quad = let(ipv4_number(F.substring_index(bare, ":", -1)), as_groups)
        return F.when(F.contains(bare, F.lit(".")), quad).otherwise(bare)

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def listed(text: Column) -> Column:
        def around(sides: Column) -> Column:
            left, right = sides["left"], sides["right"]
            missing = 8 - F.size(left) - F.size(right)
            return F.when(missing > 0, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

        gaps = F.size(F.split(text, "::"))
        sides = F.struct(groups(F.substring_index(text, "::", 1)).alias("left"), groups(F.substring_index(text, "::", -1)).alias("right"))
        return (F.when(F.contains(text, F.lit(":::")), F.lit(None).cast("array<string>"))
                .when(gaps == 1, F.split(text, ":")).when(gaps == 2, let(sides, around)))

    def joined(every: Column) -> Column:
        sound = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(sound, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return let(let(let(F.lower(F.substring_index(address, "%", 1)), with_quad), listed), joined)


def _between_v6(digits: Column, block: tuple[str, int]) -> Column:
    net = ipaddress.ip_network(f"{block[0]}/{block[1]}", strict=False)
    return digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")


def is_public(address: Column) -> Column:
    """True for a routable address, false for a special-purpose one, null when unparsable."""
    def public_v4(number: Column) -> Column:
        inside = F.lit(False)
        for base, bits in PRIVATE_V4:
            inside = inside | number.between(*_block(base, bits))
        return ~inside

    def public_v6(digits: Column) -> Column:
        open_part = F.lit(False)
        for block in PUBLIC_IN_PROTOCOL_V6:
            open_part = open_part | _between_v6(digits, block)
        closed = _between_v6(digits, PROTOCOL_V6) & ~open_part
        for block in PRIVATE_V6:
            closed = closed | _between_v6(digits, block)
        return _between_v6(digits, GLOBAL_V6) & ~closed

    def of_number(number: Column) -> Column:
        return F.when(number.isNotNull(), public_v4(number)).when(
            F.contains(address, F.lit(":")), let(ipv6_hex(address), public_v6))

    return let(ipv4_number(address), of_number)


def resolves_public(addresses: Column) -> Column:
    """Every parsable address is public; a null list (no resolution) is not."""
    verdicts = F.transform(addresses, lambda a: F.coalesce(is_public(a), F.lit(True)))
    return F.coalesce(F.forall(verdicts, lambda v: v), F.lit(False))


def blob_url(repo_url: Column, file: Column, line: Column) -> Column:
    base = F.rtrim(F.coalesce(repo_url, F.lit("")), F.lit("/"))
    middle = F.when(F.contains(base, F.lit("gitlab.com")), F.lit("/-/blob/HEAD/")).otherwise(F.lit("/blob/HEAD/"))
    return F.when(base == "", F.lit("")).otherwise(
        F.concat(base, middle, file, F.lit("#L"), line.cast("string")))
