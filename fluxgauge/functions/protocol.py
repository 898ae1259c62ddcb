"""Application protocol name to one of six traffic types, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocol names per traffic type. Exact names match case-sensitively; a name
# that matches none exactly takes the first type (in this order) with a name it contains,
# ignoring case.
PROTOCOL_NAMES = {
    "https": (
        "https", "SSL", "TLS", "Facebook", "Instagram", "Twitter", "Google", "Gmail", "Outlook",
        "Whatsapp", "Telegram", "Dropbox", "GitHub", "LinkedIn", "Reddit",
    ),
    "video": (
        "YouTube", "Netflix", "Vimeo", "Twitch", "video", "streaming", "VideoCall", "Zoom",
        "Teams", "Skype", "WebRTC",
    ),
    "http": ("http", "HTTP", "Web", "Spotify", "SoundCloud"),
    "vpn": ("VPN", "OpenVPN", "IPSec", "WireGuard", "L2TP", "PPTP", "Tor"),
    "dns": ("DNS", "dns", "mDNS", "LLMNR"),
    "db": (
        "MySQL", "PostgreSQL", "MongoDB", "Redis", "Kafka", "AMQP", "MQTT", "NFS", "SMB", "FTP",
        "SFTP", "SSH",
    ),
}

# Keywords tried last, in this order.
PROTOCOL_KEYWORDS = {
    "video": ("video", "stream", "youtube", "netflix"),
    "vpn": ("vpn", "tunnel", "ipsec"),
    "dns": ("dns", "mdns"),
    "db": ("sql", "db", "mongo", "redis", "ftp"),
    "http": ("http", "web", "browser"),
}

DEFAULT_TYPE = "https"
_BLANKS = " \t\n\r\x0b\x0c"


def map_protocol(name: Column) -> Column:
    """Exact name, else contained name, else contained keyword, else ``https``.

    The names of one type stand together in the order of the table above, so the first
    contained name and the first type with a contained name are the same thing.
    """
    exact = F.btrim(name, F.lit(_BLANKS))
    return _decide(exact, F.lower(exact))


def with_traffic_type(df: DataFrame, name: Column, out: str = "traffic_type") -> DataFrame:
    """``map_protocol`` as a column. The trimmed and lowered names are columns of their own
    on the way, so that a row computes each of them once and not once per rule."""
    return (
        df.withColumn("__name", F.btrim(name, F.lit(_BLANKS)))
        .withColumn("__lower", F.lower("__name"))
        .withColumn(out, _decide(F.col("__name"), F.col("__lower")))
        .drop("__name", "__lower")
    )


def _decide(exact: Column, lowered: Column) -> Column:
    rules = [(exact.isin(*names), kind) for kind, names in PROTOCOL_NAMES.items()]
    for table in (PROTOCOL_NAMES, PROTOCOL_KEYWORDS):
        for kind, names in table.items():
            needles = "|".join(dict.fromkeys(n.lower() for n in names))
            rules.append((lowered.rlike(needles), kind))
    first_condition, first_kind = rules[0]
    chain = F.when(first_condition, first_kind)
    for condition, kind in rules[1:]:
        chain = chain.when(condition, kind)
    return chain.otherwise(DEFAULT_TYPE)
