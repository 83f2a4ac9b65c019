"""Names, numbers and fixed values of the protocols, from which schemas and small dimension tables are made."""

from __future__ import annotations

# Link types, in order of their ids, with their capture-file numbers.
L2 = ["EN10MB", "LINUX_SSL", "IEEE802_11_RADIO", "IEEE802_11", "IEEE802", "SLIP", "PPP", "FDDI", "RAW", "LOOP", "NULL"]
DLT = {1: "EN10MB", 113: "LINUX_SSL", 127: "IEEE802_11_RADIO", 105: "IEEE802_11", 6: "IEEE802", 8: "SLIP", 9: "PPP", 10: "FDDI", 12: "RAW", 101: "RAW", 14: "RAW", 108: "LOOP", 0: "NULL"}
#: Header bytes of link types whose header has one length.
L2_LENGTH = {"EN10MB": 14, "LINUX_SSL": 16, "IEEE802": 22, "SLIP": 16, "PPP": 4, "FDDI": 21, "RAW": 0, "LOOP": 4, "NULL": 4}

L3 = {4: "IPv4", 6: "IPv6"}

# Transport names by IP protocol number.
L4 = {
    0: "IP", 1: "ICMP", 2: "IGMP", 4: "IPIP", 6: "TCP", 8: "EGP", 12: "PUP", 17: "UDP", 22: "IDP", 29: "TP", 33: "DCCP", 41: "IPV6", 46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH",
    58: "ICMPv6", 92: "MTP", 94: "BEETPH", 98: "ENCAP", 103: "PIM", 108: "COMP", 132: "SCTP", 136: "UDPLITE", 137: "MPLS", 255: "RAW",
}

# Application protocols in scan order, with display name and transports.
L7 = [
    ("DNS", "DNS", "both"), ("MDNS", "MDNS", "udp"), ("DHCP", "DHCP", "udp"), ("DHCPv6", "DHCPv6", "udp"), ("NTP", "NTP", "udp"), ("SIP", "SIP", "both"), ("RTP", "RTP", "udp"),
    ("RTCP", "RTCP", "udp"), ("SSH", "SSH", "tcp"), ("SKYPE", "Skype", "udp"), ("HTTP", "HTTP", "tcp"), ("BGP", "BGP", "tcp"), ("SMTP", "SMTP", "tcp"), ("POP3", "POP3", "tcp"),
    ("IMAP", "IMAP", "tcp"), ("SSL", "SSL", "tcp"), ("HANGOUT", "Hangout", "both"), ("WHATSAPP", "WhatsApp", "tcp"), ("TELEGRAM", "Telegram", "tcp"), ("DROPBOX", "Dropbox", "udp"),
    ("SPOTIFY", "Spotify", "both"), ("BITCOIN", "Bitcoin", "tcp"), ("ETHEREUM", "Ethereum", "tcp"), ("ZCASH", "Zcash", "tcp"), ("MONERO", "Monero", "tcp"), ("STRATUM", "Stratum", "tcp"),
    ("JSON_RPC", "JSON-RPC", "both"), ("SSDP", "SSDP", "udp"), ("STUN", "STUN", "both"), ("QUIC", "QUIC", "udp"), ("QUIC5", "QUIC5", "udp"), ("MQTT", "MQTT", "tcp"), ("MYSQL", "MySQL", "tcp"),
    ("VIBER", "Viber", "both"), ("KERBEROS", "Kerberos", "both"), ("TOR", "Tor", "tcp"), ("GIT", "Git", "tcp"),
]
DISPLAY = {name: shown for name, shown, _ in L7}
UNKNOWN = "Unknown"

# Well-known ports.
TCP_PORTS = {
    53: "DNS", 80: "HTTP", 179: "BGP", 25: "SMTP", 587: "SMTP", 465: "SMTP", 110: "POP3", 995: "POP3", 143: "IMAP", 993: "IMAP", 443: "SSL", 9001: "TOR",
    19305: "HANGOUT", 19306: "HANGOUT", 19307: "HANGOUT", 19308: "HANGOUT", 19309: "HANGOUT", 22: "SSH", 8333: "BITCOIN", 18080: "MONERO", 28080: "MONERO", 18081: "MONERO", 28081: "MONERO",
    3478: "STUN", 5349: "STUN", 1883: "MQTT", 8883: "MQTT", 7985: "VIBER", 5242: "VIBER", 5243: "VIBER", 4244: "VIBER", 88: "KERBEROS", 9418: "GIT",
}
UDP_PORTS = {
    53: "DNS", 5353: "MDNS", 67: "DHCP", 68: "DHCP", 546: "DHCPv6", 547: "DHCPv6", 5060: "SIP", 123: "NTP", 19302: "HANGOUT", 19303: "HANGOUT", 19304: "HANGOUT", 19305: "HANGOUT",
    19306: "HANGOUT", 19307: "HANGOUT", 19308: "HANGOUT", 19309: "HANGOUT", 17500: "DROPBOX", 57621: "SPOTIFY", 1900: "SSDP", 3478: "STUN", 7985: "VIBER", 7987: "VIBER", 5242: "VIBER",
    5243: "VIBER", 4244: "VIBER", 88: "KERBEROS",
}

# Outcome of a packet.
STATUS = {
    -7: "Error while parsing the L2 header", -6: "Error while parsing the L3 header", -5: "Error while parsing the L4 header", -4: "The maximum number of flows has been reached",
    -3: "Error while parsing IPv6 extension headers", -2: "IPsec is not supported", -1: "Neither IPv4 nor IPv6", 0: "Everything is ok", 1: "IP fragment", 2: "IP datagram rebuilt from fragments",
    3: "TCP segment out of order", 4: "TCP connection terminated",
}

#: Per-direction flow statistics.
STATISTICS = [
    "packets", "bytes", "timestamp_first", "timestamp_last", "rtt_syn_ack", "syn", "fin", "rst", "zero_window", "retransmissions", "window_scaling", "l7_packets", "l7_bytes",
]

# Application fields by protocol; S text or bytes, N number, M list of (key, value).
FIELDS = {
    "SIP": (
        "REQUEST_URI:S METHOD:S CALLID:S REASON:S RTCPXR_CALLID:S CSEQ:S CSEQ_METHOD_STRING:S VIA:S CONTACT_URI:S RURI_USER:S RURI_DOMAIN:S FROM_USER:S "
        "FROM_DOMAIN:S TO_USER:S TO_DOMAIN:S PAI_USER:S PAI_DOMAIN:S PID_URI:S FROM_URI:S TO_URI:S RURI_URI:S TO_TAG:S FROM_TAG:S"
    ),
    "DNS": "NAME_SRV:S NS_IP_1:S NS_IP_2:S AUTH_SRV:S",
    "SSL": "VERSION:N VERSION_HANDSHAKE:N HANDSHAKE_TYPE:N CIPHER_SUITES:S EXTENSIONS:S ELLIPTIC_CURVES:S ELLIPTIC_CURVES_POINT_FMTS:S SNI:S CERTIFICATE:S JA3:S",
    "HTTP": "VERSION_MAJOR:N VERSION_MINOR:N METHOD:N STATUS_CODE:N MSG_TYPE:N BODY:S URL:S HEADERS:M",
    "RTP": "PTYPE:N SEQNUM:N TIMESTP:N SSRC:N",
    "RTCP": (
        "SENDER_ALL:N SENDER_SSRC:N SENDER_TIME_MSW:N SENDER_TIME_LSW:N SENDER_TIME_RTP:N SENDER_PKT_COUNT:N SENDER_OCT_COUNT:N SENDER_ID:N SENDER_FLCNPL:N "
        "SENDER_EXT_SEQN_RCV:N SENDER_INT_JITTER:N SENDER_LSR:N SENDER_DELAY_LSR:N RECEIVER_ALL:N RECEIVER_SSRC:N RECEIVER_ID:N RECEIVER_FLCNPL:N "
        "RECEIVER_EXT_SEQN_RCV:N RECEIVER_INT_JITTER:N RECEIVER_LSR:N RECEIVER_DELAY_LSR:N SDES_CSRC:N SDES_TEXT:S"
    ),
    "JSON_RPC": "FIRST:S VERSION:N MSG_TYPE:N ID:S METHOD:S PARAMS:S RESULT:S ERROR:S LAST:S",
    "QUIC": "VERSION:S SNI:S UAID:S JA3:S",
    "STUN": "MAPPED_ADDRESS:S MAPPED_ADDRESS_PORT:N",
}
FIELD_TYPES = {"S": "STRING", "N": "NUMBER", "M": "MMAP"}


def fields() -> list[tuple[str, str, str]]:
    """(protocol, field, type) of every field, in order."""
    return [(p, *f.split(":")) for p, fs in FIELDS.items() for f in fs.split()]


def l7_id(name: str) -> int:
    """Number of an application protocol by either of its names, whatever the case; one beyond the last if there is none."""
    low = name.lower()
    return next((i for i, (n, shown, _) in enumerate(L7) if low in (n.lower(), shown.lower())), len(L7))


def l4_id(name: str) -> int:
    return next((k for k, n in L4.items() if n.lower() == name.lower()), 0)


def l3_id(name: str) -> int:
    return next((k for k, n in L3.items() if n.lower() == name.lower()), 7)


def l2_id(name: str) -> int:
    return next((i for i, n in enumerate(L2) if n.lower() == name.lower()), len(L2))
