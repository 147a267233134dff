"""IP addresses as fixed-width hex text: 8 digits for version 4, 32 for version 6.

Texts of one width sort like the addresses, so ranges compare as plain strings.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.once import once

# Address blocks not reachable globally (IANA special-purpose registries),
# and the blocks inside them that are.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
GLOBAL = (
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32",
    "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_OCTET}(?:[.]{_OCTET}){{3}}$"
# Groups with at most one "::"; how many there are is counted after expansion.
_V6 = "^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::)?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$"


def _v4_hex(ip: str) -> str:
    """SQL for the eight digits of a dotted address."""
    parts = [f"cast(split_part({ip}, '.', {i}) AS BIGINT) * {1 << (32 - 8 * i)}" for i in range(1, 5)]
    return f"CASE WHEN {ip} RLIKE '{V4}' THEN lpad(lower(hex({' + '.join(parts)})), 8, '0') END"


def _groups_hex(part: str) -> str:
    """SQL for ``a:bc:0`` as zero-padded groups ``000a00bc0000``."""
    padded = f"regexp_replace(concat(':', {part}), ':([0-9a-f]+)', '000$1:')"
    return f"CASE WHEN {part} = '' THEN '' ELSE regexp_replace({padded}, '0*([0-9a-f]{{4}}):', '$1') END"


def with_ip_hex(df: DataFrame, text: Column, column: str) -> DataFrame:
    """Add ``column``: hex form of the address in ``text``, NULL for anything that is none.

    Built in steps, each a projection of its own, so that the generated code stays small.
    Version-6 work is done only for texts with a colon.
    """
    head = _groups_hex("split_part(_ip_long, '::', 1)")
    rest = _groups_hex("split_part(_ip_long, '::', 2)")
    steps = (
        # The address without its zone.
        {"_ip_long": "CASE WHEN contains(_ip_text, ':') THEN lower(split_part(_ip_text, '%', 1)) END"},
        # A dotted tail counts as two groups.
        {"_ip_tail": "CASE WHEN contains(_ip_long, '.') THEN substring_index(_ip_long, ':', -1) END"},
        {"_ip_digits": _v4_hex("_ip_tail")},
        {
            "_ip_long": "CASE WHEN _ip_tail IS NULL THEN _ip_long ELSE "
            "concat(substring(_ip_long, 1, length(_ip_long) - length(_ip_tail)), "
            "substring(_ip_digits, 1, 4), ':', substring(_ip_digits, 5, 4)) END"
        },
        {
            "_ip_head": f"CASE WHEN _ip_long RLIKE '{_V6}' THEN {head} END",
            "_ip_rest": f"CASE WHEN contains(_ip_long, '::') THEN {rest} ELSE '' END",
        },
        {"_ip_gap": "32 - length(_ip_head) - length(_ip_rest)"},
    )
    df = df.withColumn("_ip_text", text)
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step.items()})
    full = (
        f"coalesce({_v4_hex('_ip_text')}, CASE WHEN _ip_gap = 0 AND NOT contains(_ip_long, '::') "
        "OR _ip_gap >= 4 AND contains(_ip_long, '::') "
        "THEN concat(_ip_head, repeat('0', _ip_gap), _ip_rest) END)"
    )
    helpers = ("text", "long", "tail", "digits", "head", "rest", "gap")
    return once(df, column, F.expr(full)).drop(*(f"_ip_{h}" for h in helpers))


def hex_bounds(network: str) -> tuple[str, str]:
    """First and last address of a network in hex form (driver side, for constants)."""
    net = ipaddress.ip_network(network)
    width = 8 if net.version == 4 else 32
    return f"{int(net.network_address):0{width}x}", f"{int(net.broadcast_address):0{width}x}"


def _inside(ip: str, networks: tuple[str, ...], width: int) -> str:
    """SQL for "lies in one of the networks of that width"."""
    bounds = [(low, high) for low, high in map(hex_bounds, networks) if len(low) == width]
    # Most addresses are settled by their first byte, with one set lookup.
    first = sorted({f"'{b:02x}'" for low, high in bounds for b in range(int(low[:2], 16), int(high[:2], 16) + 1)})
    blocks = " OR ".join(f"{ip} BETWEEN '{low}' AND '{high}'" for low, high in bounds)
    return f"(substring({ip}, 1, 2) IN ({', '.join(first)}) AND ({blocks}))"


def is_private(column: str) -> Column:
    """Whether the address in the hex column lies in a private or otherwise special block.

    A version-4 address mapped into version 6 is judged by its version-4 part.
    """

    def judged(ip: str, width: int) -> str:
        return f"({_inside(ip, PRIVATE, width)} AND NOT {_inside(ip, GLOBAL, width)})"

    short, mapped, long = judged(column, 8), judged(f"substring({column}, 25, 8)", 8), judged(column, 32)
    prefix = "0" * 20 + "ffff"
    return F.expr(
        f"CASE WHEN length({column}) = 8 THEN {short} WHEN startswith({column}, '{prefix}') THEN {mapped} "
        f"WHEN {column} IS NOT NULL THEN {long} END"
    )
