"""Rendering of socket endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Address families and the socket types that own ports (Linux).
AF_UNIX, AF_INET, AF_INET6 = 1, 2, 10
SOCK_STREAM, SOCK_DGRAM, SOCK_SEQPACKET = 1, 2, 5


def swap16(port: Column) -> Column:
    """Network to host order of a 16-bit value."""
    low = F.shiftleft(port.bitwiseAND(F.lit(0xFF)), 8)
    return low.bitwiseOR(F.shiftright(port, 8).bitwiseAND(F.lit(0xFF)))


def ipv4_text(raw: Column) -> Column:
    """Dotted text of an address held as a little-endian read of its network bytes."""
    value = raw.cast("bigint")
    octets = [F.shiftright(value, shift).bitwiseAND(F.lit(0xFF).cast("bigint")) for shift in (0, 8, 16, 24)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def ipv6_groups(hexed: Column) -> Column:
    """32 hex digits in network order → ``:a:b:…:h:``, groups without leading zeros."""
    spaced = F.regexp_replace(F.lower(hexed), "(.{4})", "$1:")
    return F.concat(F.lit(":"), F.regexp_replace(spaced, "(?<![0-9a-f])0{1,3}(?=[0-9a-f])", ""))


def ipv6_compressed(groups: str) -> Column:
    """Canonical text from a column of groups.

    The longest (leftmost) run of two or more zero groups becomes ``::`` and an
    IPv4-mapped address shows its dotted tail. The column is named, not given as an
    expression, because it is looked at once per run length.
    """
    text = F.col(groups)
    cases = []
    for run in range(8, 1, -1):
        zeros = ":" + "0:" * run
        at = F.instr(text, zeros)
        rest = at + F.lit(len(zeros))
        tail = F.substring(text, rest, F.length(text) - rest)
        cases.append(F.when(at > 0, F.concat(F.substring(text, F.lit(2), at - F.lit(2)), F.lit("::"), tail)))
    plain = F.substring(text, F.lit(2), F.length(text) - F.lit(2))
    mapped_prefix = ":0:0:0:0:0:ffff:"

    def octets(place: int) -> list[Column]:
        word = F.conv(F.split_part(text, F.lit(":"), F.lit(place)), 16, 10).cast("int")
        return [F.shiftright(word, 8).cast("string"), word.bitwiseAND(F.lit(0xFF)).cast("string")]

    mapped = F.when(
        text.startswith(mapped_prefix),
        F.concat(F.lit("::ffff:"), F.concat_ws(".", *octets(8), *octets(9))),
    )
    return F.coalesce(mapped, *cases, plain)


def _has_ports() -> Column:
    return F.col("type").isin(SOCK_STREAM, SOCK_DGRAM, SOCK_SEQPACKET)


def socket_context(sockets: DataFrame) -> DataFrame:
    """One row per known socket; families other than unix and inet are dropped."""
    return sockets.filter(F.col("family").isin(AF_UNIX, AF_INET, AF_INET6)).select(
        "inode_id", "family", "type", "protocol"
    )


def render_inet(sockets: DataFrame) -> DataFrame:
    """Raw socket records → endpoint rows of inet sockets.

    Input: ``inode_id, netns_cookie, family, type, src_addr4, dst_addr4`` (integers),
    ``src_addr6, dst_addr6`` (32 hex digits), ``src_port`` (host order) and ``dst_port``
    (network order). A socket without a source address gives no row, one without a
    destination gets 0.0.0.0, and types without ports get port 0.
    """
    v4 = F.col("family") == AF_INET
    src = F.when(v4, ipv4_text(F.col("src_addr4"))).otherwise(ipv6_compressed("__src6"))
    dst4, dst6 = F.col("dst_addr4"), F.col("dst_addr6")
    dst = F.when(v4, F.when(dst4.isNotNull(), ipv4_text(dst4))).otherwise(
        F.when(dst6.isNotNull(), ipv6_compressed("__dst6"))
    )
    zero = F.lit(0)
    return (
        sockets.filter(F.col("family").isin(AF_INET, AF_INET6))
        .filter(F.when(v4, F.col("src_addr4").isNotNull()).otherwise(F.col("src_addr6").isNotNull()))
        .withColumns({"__src6": ipv6_groups(F.col("src_addr6")), "__dst6": ipv6_groups(F.col("dst_addr6"))})
        .select(
            "inode_id",
            "netns_cookie",
            src.alias("src_address"),
            F.when(_has_ports(), F.coalesce(F.col("src_port"), zero)).otherwise(zero).alias("src_port"),
            F.coalesce(dst, F.lit("0.0.0.0")).alias("dst_address"),
            F.when(_has_ports(), F.coalesce(swap16(F.col("dst_port")), zero)).otherwise(zero).alias("dst_port"),
        )
    )
