"""Endpoint specs and endpoint observations.

Live probing is re-aimed to a table of already-collected handshake facts
(`endpoint_obs`); S20 parses `[tls://|ssh://]host[:port]` spec strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBS_SCHEMA = ("repo string, host string, port int, protocol string, tls_version string, "
              "cipher string, has_subject boolean, asn1_curve string, pubkey_len int, banner string")


def parse_endpoint_spec(spec: Column) -> Column:
    """S20 → struct(host, port, protocol).  `ssh://` selects SSH; the port is
    the leading integer after the first ':' (default 22 for SSH, else 443);
    port 22 without `tls://` means SSH."""
    is_ssh = spec.startswith("ssh://")
    addr = F.when(is_ssh | spec.startswith("tls://"), F.substr(spec, F.lit(7))).otherwise(spec)
    parts = F.split(addr, ":", -1)
    host = F.get(parts, 0)
    port_str = F.get(parts, 1)
    parsed = F.regexp_extract(port_str, r"^\s*([+-]?\d+)", 1)
    port = F.when(port_str.isNull() | (port_str == ""),
                  F.when(is_ssh, F.lit(22)).otherwise(F.lit(443))) \
        .otherwise(F.when(parsed != "", parsed.try_cast("int")))
    proto = F.when(is_ssh | ((port == 22) & ~spec.startswith("tls://")), F.lit("ssh")) \
        .otherwise(F.lit("tls"))
    return F.struct(host.alias("host"), port.alias("port"), proto.alias("protocol"))


def endpoint_label(protocol: Column, host: Column, port: Column) -> Column:
    return F.concat(protocol, F.lit("://"), host, F.lit(":"), port.cast("string"))
