"""Keyed-hash pseudonyms for addresses, ports and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descry.formats import (
    PLAIN_IPV4,
    PLAIN_PORT,
    SCRUBBED_IPV6_PREFIX,
    SECRET_IPV4,
    SECRET_IPV6,
    SECRET_PORT,
)
from descry.functions.text import base64_unpadded, is_hex, let, unbase64_unpadded

_DOTTED_QUAD = (
    r"\A(?:(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d)\z"
)


def _byte_hex(number: Column) -> Column:
    return F.lpad(F.hex(number.cast("int")), 2, "0")


def _secret_hex(secret: Column, part: tuple[int, int]) -> Column:
    return F.hex(F.substring(secret, part[0] + 1, part[1] - part[0]))


def _dotted_quad_hex(address: Column) -> Column:
    """Eight hex digits, or null when it is no IPv4 address."""
    octets = F.split(address, r"\.")
    return F.when(
        address.rlike(_DOTTED_QUAD), F.concat(*[_byte_hex(octets[i]) for i in range(4)])
    )


def ipv6_hex(address: Column) -> Column:
    """Thirty-two hex digits of a bracketed IPv6 address, or null when malformed.

    Each group is checked before joining: a join would silently drop nulls.
    """

    def group_hex(group: Column) -> Column:
        return F.when(group.contains("."), _dotted_quad_hex(group)).when(
            F.length(group) <= 4, F.lpad(group, 4, "0")
        )

    def half_hex(half: Column) -> Column:
        groups = F.transform(F.split(half, ":", -1), group_hex)
        return let(
            groups,
            lambda g: F.when(
                (F.size(g) <= 8) & ~F.exists(g, lambda x: x.isNull()), F.array_join(g, "")
            ),
        )

    def whole(halves: Column) -> Column:
        fill = F.lit(32) - F.length(halves[0]) - F.length(F.get(halves, F.lit(1)))
        return F.when(F.size(halves) == 1, halves[0]).when(
            F.size(halves) == 2,
            F.concat(halves[0], F.repeat(F.lit("0"), fill), F.get(halves, F.lit(1))),
        )

    body = F.regexp_extract(address, r"\A\[(.*)\]\z", 1)
    expanded = let(F.transform(F.split(body, "::", -1), half_hex), whole)
    return let(expanded, lambda h: F.when(h.rlike(r"\A[0-9a-fA-F]{32}\z"), h))


def scrub_ipv4(address: Column, fingerprint: Column, secret: Column | None = None) -> Column:
    """``10.x.y.z`` from a keyed hash, or a constant when hashing is off."""
    if secret is None:
        return F.lit(PLAIN_IPV4)
    keyed = F.concat(_dotted_quad_hex(address), fingerprint, _secret_hex(secret, SECRET_IPV4))
    digest = F.sha2(F.unhex(keyed), 256)
    octets = [F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10) for i in range(3)]
    # concat of a null is null
    return F.concat(F.lit("10."), octets[0], F.lit("."), octets[1], F.lit("."), octets[2])


def scrub_ipv6(address: Column, fingerprint: Column, secret: Column | None = None) -> Column:
    """Fixed prefix plus 24 bits of a keyed hash; null when malformed."""
    if secret is None:
        return F.lit(SCRUBBED_IPV6_PREFIX + "]")
    keyed = F.concat(ipv6_hex(address), fingerprint, _secret_hex(secret, SECRET_IPV6))
    return let(
        F.sha2(F.unhex(keyed), 256),
        lambda d: F.concat(
            F.lit(SCRUBBED_IPV6_PREFIX),
            F.substring(d, 59, 2),
            F.lit(":"),
            F.substring(d, 61, 4),
            F.lit("]"),
        ),
    )


def scrub_tcp_port(port: Column, fingerprint: Column, secret: Column | None = None) -> Column:
    """A port in the upper quarter of the range; ``0`` stays ``0``."""
    if secret is None:
        return F.when(port == "0", "0").otherwise(PLAIN_PORT)
    number = port.try_cast("int")
    keyed = F.concat(
        F.lpad(F.hex(number.bitwiseAND(0xFFFF)), 4, "0"),
        fingerprint,
        _secret_hex(secret, SECRET_PORT),
    )
    top = F.conv(F.substring(F.sha2(F.unhex(keyed), 256), 1, 4), 16, 10).cast("int")
    hashed = F.shiftright(top, 2).bitwiseOR(0b1100_0000_0000_0000).cast("string")
    return F.when(port == "0", "0").otherwise(hashed)


def scrub_or_address(address: Column, fingerprint: Column, secret: Column | None = None) -> Column:
    """Scrub ``address:port``, split at the last colon; null when malformed."""
    host = F.regexp_extract(address, r"\A(.*):([^:]*)\z", 1)
    port = F.regexp_extract(address, r"\A(.*):([^:]*)\z", 2)
    scrubbed = F.when(
        host.startswith("["), scrub_ipv6(host, fingerprint, secret)
    ).otherwise(scrub_ipv4(host, fingerprint, secret))
    return F.when(
        address.contains(":"),
        F.concat(scrubbed, F.lit(":"), scrub_tcp_port(port, fingerprint, secret)),
    )


def hash_fingerprint(fingerprint: Column) -> Column:
    """Upper-case SHA-1 of a hex fingerprint's bytes; null unless it is hex."""
    return F.when(is_hex(fingerprint), F.upper(F.sha1(F.unhex(fingerprint))))


def grouped_by_four(digest: Column) -> Column:
    return F.ltrim(F.regexp_replace(digest, "(.{4})", " $1"))


def hash_base64_sha1(text: Column) -> Column:
    """SHA-1 of base64 content, as 27 base64 characters."""
    return F.substring(F.base64(F.unhex(F.sha1(unbase64_unpadded(text)))), 1, 27)


def hash_base64_sha256(text: Column) -> Column:
    return base64_unpadded(F.unhex(F.sha2(unbase64_unpadded(text), 256)))


def master_key_from_cert(cert: Column) -> Column:
    """The signing key's master key inside an identity certificate, or null.

    ``cert`` is base64.  The walk over extensions is a fold, so no Python runs.
    """

    def byte_at(h: Column, offset: Column | int) -> Column:
        start = (F.lit(offset) if isinstance(offset, int) else offset) * 2 + 1
        return F.conv(F.substr(h, start, F.lit(2)), 16, 10).cast("int")

    def walk(h: Column) -> Column:
        n_bytes = (F.length(h) / 2).cast("int")

        def step(state: Column, _: Column) -> Column:
            at = state["at"]
            readable = state["key"].isNull() & (at >= 0) & (n_bytes >= at + 4)
            size = byte_at(h, at) * 256 + byte_at(h, at + 1)
            wanted = (size == 32) & (byte_at(h, at + 2) == 4)
            return F.when(
                ~readable, F.struct(F.lit(-1).alias("at"), state["key"].alias("key"))
            ).otherwise(
                F.struct(
                    F.when(wanted, F.lit(-1)).otherwise(at + 4 + size).alias("at"),
                    F.when(
                        wanted & (n_bytes >= at + 36),
                        F.substr(h, (at + 4) * 2 + 1, F.lit(64)),
                    ).alias("key"),
                )
            )

        start = F.struct(F.lit(40).alias("at"), F.lit(None).cast("string").alias("key"))
        found = F.aggregate(F.sequence(F.lit(1), byte_at(h, 39)), start, step)
        header = (
            (n_bytes >= 40)
            & (byte_at(h, 0) == 1)
            & (byte_at(h, 1) == 4)
            & (byte_at(h, 6) == 1)
            & byte_at(h, 39).between(1, 127)
        )
        return F.when(header, base64_unpadded(F.unhex(found["key"])))

    return let(F.hex(unbase64_unpadded(cert)), walk)
