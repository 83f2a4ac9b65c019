"""Scalar functions over names, numbers and addresses, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens import catalog


def _lookup(values: dict, key: Column, other=None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(other)) if other is not None else F.element_at(F.create_map(*pairs), key)


def l4_name(proto: Column) -> Column:
    return _lookup(catalog.L4, proto)


def l3_name(version: Column) -> Column:
    return _lookup(catalog.L3, version)


def l7_display(name: Column) -> Column:
    return _lookup(catalog.DISPLAY, name, catalog.UNKNOWN)


def l7_number(name: Column) -> Column:
    """Id by scan or display name, whatever the case; the number of protocols if there is none."""
    both = {n.lower(): i for i, (a, b, _) in enumerate(catalog.L7) for n in (a, b)}
    return _lookup(both, F.lower(name), len(catalog.L7))


def l4_number(name: Column) -> Column:
    return _lookup({n.lower(): k for k, n in catalog.L4.items()}, F.lower(name), 0)


def dlt_name(code: Column) -> Column:
    return _lookup(catalog.DLT, code)


def status_message(status: Column) -> Column:
    return _lookup(catalog.STATUS, status)


def port_guess(proto: Column, sport: Column, dport: Column) -> Column:
    """Protocol of the source port, else of the destination port; null if neither is known."""
    tcp, udp = (lambda port: _lookup(catalog.TCP_PORTS, port)), (lambda port: _lookup(catalog.UDP_PORTS, port))
    return F.when(proto == 6, F.coalesce(tcp(sport), tcp(dport))).when(proto == 17, F.coalesce(udp(sport), udp(dport)))


def ip_text(address: Column) -> Column:
    """Dotted quad of 4 bytes; of 16 bytes, eight groups of hexadecimal digits, uncompressed."""
    h = F.lower(F.hex(address))
    quad = F.concat_ws(".", *[F.conv(F.substring(h, 2 * i + 1, 2), 16, 10) for i in range(4)])
    groups = F.concat_ws(":", *[F.substring(h, 4 * i + 1, 4) for i in range(8)])
    return F.when(F.length(address) == 4, quad).when(F.length(address) == 16, groups)


def mac_text(address: Column) -> Column:
    h = F.lower(F.hex(address))
    return F.when(address.isNotNull(), F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)]))


def ipv4_number(address: Column) -> Column:
    return F.when(F.length(address) == 4, F.conv(F.hex(address), 16, 10).cast("long"))


def in_network(address: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network in CIDR notation."""
    base, _, bits = network.partition("/")
    low = 0
    for part in base.split("."):
        low = low << 8 | int(part)
    size = 1 << (32 - int(bits or 32))
    low -= low % size
    return ipv4_number(address).between(low, low + size - 1)


def to_micros(ts: Column, unit: str) -> Column:
    """A timestamp in seconds, milliseconds or microseconds as a whole number of microseconds."""
    return F.round(ts * {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]).cast("long")


def serial_before(a: Column, b: Column) -> Column:
    """a is before b on the circle of 32-bit sequence numbers."""
    return F.pmod(a - b, F.lit(1 << 32)) >= (1 << 31)


def _key_bytes(src: Column, sport: Column, dst: Column, dport: Column, proto: Column, low_first: bool) -> Column:
    """Hexadecimal key of a bidirectional IPv4 flow: addresses, protocol, ports; the lower end first."""
    first = F.struct(src, sport) <= F.struct(dst, dport)
    lo, hi = F.when(first, src).otherwise(dst), F.when(first, dst).otherwise(src)
    lp, hp = F.when(first, sport).otherwise(dport), F.when(first, dport).otherwise(sport)
    h = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    return F.concat(h(lo, 8), h(hi, 8), h(proto, 2), h(lp, 4), h(hp, 4))


def _fold(key: Column, order: list[int], start: int, step) -> Column:
    value = F.lit(start).cast("long")
    for i in order:
        value = step(value, F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("long"))
    return value


def flow_hash_simple(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """Sum of both addresses, ports and the protocol, modulo 2^32. Addresses as whole numbers."""
    return (src.cast("long") + dst + sport + dport + proto) % (1 << 32)


def flow_hash_fnv(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """FNV-1a, 32 bits, over low and high address, protocol and ports, each little end first."""
    key = _key_bytes(src, sport, dst, dport, proto, True)
    order = [3, 2, 1, 0, 7, 6, 5, 4, 8, 10, 9, 12, 11]
    return _fold(key, order, 0x811C9DC5, lambda h, x: (h.bitwiseXOR(x) * F.lit(0x01000193)) % F.lit(1 << 32))


def flow_hash_bkdr(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """BKDR with seed 131 over the key bytes as signed characters, 31 bits."""
    key = _key_bytes(src, sport, dst, dport, proto, True)
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x)
    return _fold(key, list(range(13)), 0, lambda h, x: F.pmod(h * 131 + signed(x), F.lit(1 << 32))).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def flow_hash_murmur3(src: Column, sport: Column, dst: Column, dport: Column, proto: Column, seed: int = 0) -> Column:
    """MurmurHash3 x86, 32 bits, over the 13 key bytes."""
    key, m = _key_bytes(src, sport, dst, dport, proto, True), F.lit(1 << 32)
    byte = lambda i: F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("long")

    def let(x: Column, f) -> Column:  # evaluates x once, however often f uses it
        return F.element_at(F.transform(F.array(x), f), 1)

    def times(x: Column, c: int) -> Column:  # modulo 2^32 without overflow of 64 bits
        return let(x, lambda v: F.pmod((v % 65536) * c + F.pmod(F.shiftright(v, 16) * c, F.lit(65536)) * 65536, m))

    def turn(x: Column, r: int) -> Column:
        return let(x, lambda v: F.pmod(F.shiftleft(v, r), m).bitwiseOR(F.shiftright(v, 32 - r)))

    def mixed(x: Column, r: int) -> Column:
        return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, r)))

    h = F.lit(seed).cast("long")
    for i in range(3):
        k = byte(4 * i) + byte(4 * i + 1) * 256 + byte(4 * i + 2) * 65536 + byte(4 * i + 3) * 16777216
        h = h.bitwiseXOR(times(turn(times(k, 0xCC9E2D51), 15), 0x1B873593))
        h = F.pmod(turn(h, 13) * 5 + 0xE6546B64, m)
    h = h.bitwiseXOR(times(turn(times(byte(12), 0xCC9E2D51), 15), 0x1B873593)).bitwiseXOR(F.lit(13).cast("long"))
    return mixed(times(mixed(times(mixed(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """Small tables of the catalog."""
    tables = {
        "l2_names": ("id int, name string", list(enumerate(catalog.L2))),
        "l3_names": ("id int, name string", sorted(catalog.L3.items())),
        "l4_names": ("id int, name string", sorted(catalog.L4.items())),
        "l7_names": ("id int, name string, transport string", [(i, shown, t) for i, (_, shown, t) in enumerate(catalog.L7)]),
        "l7_field_catalog": ("id int, protocol string, field string, type string", [(i, p, f, catalog.FIELD_TYPES[t]) for i, (p, f, t) in enumerate(catalog.fields())]),
        "status_messages": ("status int, message string", sorted(catalog.STATUS.items())),
        "known_ports": ("transport string, port int, protocol string", [(t, p, n) for t, ps in (("tcp", catalog.TCP_PORTS), ("udp", catalog.UDP_PORTS)) for p, n in sorted(ps.items())]),
        "dlt_map": ("code int, name string", sorted(catalog.DLT.items())),
        "statistics": ("id int, name string", list(enumerate(catalog.STATISTICS))),
    }
    schema, rows = tables[name]
    return spark.createDataFrame(rows, schema)
