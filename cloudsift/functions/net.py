"""Address and flow columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6 = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"

#: IPv4 addresses by class, as patterns of their text: fixed blocks of the address registries.
V4_CLASSES = {
    "LOOPBACK": r"^127\.",
    "PRIVATE": r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)",
    "LINK-LOCAL": r"^169\.254\.",
    "SPECIAL": r"^(0\.0\.0\.0$|255\.255\.255\.255$|22[4-9]\.|23[0-9]\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)",
}


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    part = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    return F.when(ip.rlike(IPV4), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ip_version(ip: Column) -> Column:
    """4, 6 or null."""
    return F.when(ip.rlike(IPV4), 4).when(ip.rlike(IPV6) & (F.length(ip) >= 2), 6)


def ip6_digits(ip: Column) -> Column:
    """An IPv6 address as 32 small hexadecimal digits, whose order is that of the addresses; null for anything else."""
    tail = r"[0-9]+(\.[0-9]+){3}$"
    # A value that several places read is bound once, lest the expression grows with each.
    bind = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
    groups = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))
    plain = bind(F.lower(ip), lambda low: bind(ip_number(F.regexp_extract(low, tail, 0)), lambda n: F.when(n.isNotNull(), F.concat(F.regexp_replace(low, tail, ""), pair(n))).otherwise(low)))
    halves = bind(F.split(plain, "::"), lambda h: F.struct(F.size(h).alias("n"), groups(F.get(h, 0)).alias("left"), groups(F.coalesce(F.get(h, 1), F.lit(""))).alias("right")))

    def joined(h: Column) -> Column:
        gap = 8 - F.size(h["left"]) - F.size(h["right"])
        whole = F.when((h["n"] == 1) & (gap == 0), h["left"]).when((h["n"] == 2) & (gap >= 1), F.concat(h["left"], F.array_repeat(F.lit("0"), gap), h["right"]))
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return bind(halves, joined)


def first_group(ip: Column) -> Column:
    """The first 16 bits of an IPv6 address; of one that begins with two colons, 0."""
    return F.coalesce(F.conv(F.nullif(F.element_at(F.split(ip, ":"), 1), F.lit("")), 16, 10).cast("int"), F.lit(0))


def class4(ip: Column) -> Column:
    """The class of what is known to be an IPv4 address."""
    four = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in V4_CLASSES.items():
        four = four.when(ip.rlike(pattern), name)
    return four


def class6(ip: Column) -> Column:
    """The class of what has the shape of an IPv6 address."""
    group, low6 = first_group(ip), F.lower(ip)
    return (
        F.when(low6.isin("::1", "0:0:0:0:0:0:0:1"), "LOOPBACK")
        .when(low6.isin("::", "0:0:0:0:0:0:0:0"), "SPECIAL")
        .when(group.bitwiseAND(0xFE00) == 0xFC00, "PRIVATE")
        .when(group.bitwiseAND(0xFFC0) == 0xFE80, "LINK-LOCAL")
        .when(group.bitwiseAND(0xFF00) == 0xFF00, "SPECIAL")
    )


def ip_class(ip: Column) -> Column:
    """O-22: LOOPBACK, PRIVATE, LINK-LOCAL, SPECIAL, or null for public addresses and other texts."""
    return F.when(ip.rlike(IPV4), class4(ip)).when(ip.rlike(IPV6), class6(ip))


def scope_of(ip: Column, version: Column) -> Column:
    """O-23: the class in lower case, public, or null where the text is no address; of an address whose version is known."""
    named = lambda kind: F.coalesce(F.lower(kind), F.lit("public"))
    return F.when(version == 4, named(class4(ip))).when(version == 6, named(class6(ip)))


def address_scope(ip: Column) -> Column:
    """O-23: the same of any text."""
    return scope_of(ip, ip_version(ip))


def protocol_name(protocol: Column) -> Column:
    """O-25: the names of four protocols, else the number."""
    out = protocol.cast("string")
    for number_, name in ((1, "ICMP"), (6, "TCP"), (17, "UDP"), (58, "ICMPv6")):
        out = F.when(protocol == number_, name).otherwise(out)
    return out


def flow_direction(direction: Column, status: Column, src: Column, dst: Column) -> Column:
    """O-24: where a flow's direction is known from: record (the log names it), heuristic or unknown, as struct(source, outward).

    src and dst are structs (version, scope). Without a named direction, exactly one of two IPv4 sides must not be public.
    """
    known = lambda how, outward: F.struct(F.lit(how).alias("source"), F.lit(outward).cast("boolean").alias("outward"))
    inside = lambda end: F.coalesce(end["scope"] != "public", F.lit(False))
    both = (src["version"] == 4) & (dst["version"] == 4)
    return (
        F.when(F.coalesce(status.isin("NODATA", "SKIPDATA"), F.lit(False)), known("unknown", None))
        .when(direction == "ingress", known("record", False))
        .when(direction == "egress", known("record", True))
        .when(both & inside(src) & ~inside(dst), known("heuristic", True))
        .when(both & inside(dst) & ~inside(src), known("heuristic", False))
        .otherwise(known("unknown", None))
    )
