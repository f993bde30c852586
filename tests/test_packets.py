"""Frame decoding on hand-built bytes."""

import socket
import struct

import pytest

from flowkeel.operators.packets import decode_packets
from flowkeel.schema import FRAMES_SCHEMA
from flowkeel.sources.tables import frames_view


def frame(src="10.0.0.1", dst="10.0.0.2", sport=1234, dport=80, proto=6, ihl=5, ethertype=0x0800, payload=b""):
    ip = struct.pack("!BBHHHBBH4s4s", 0x40 | ihl, 0, 20, 0, 0, 64, proto, 0,
                     socket.inet_aton(src), socket.inet_aton(dst))
    return b"\x00" * 12 + struct.pack("!H", ethertype) + ip + b"\x01" * (4 * (ihl - 5)) + struct.pack(
        "!HH", sport, dport) + payload


def decode(spark, frames):
    rows = [("f", i, 10 + i, wire, data) for i, (data, wire) in enumerate(frames)]
    return decode_packets(spark.createDataFrame(rows, FRAMES_SCHEMA), keep=("ord",)).orderBy("ord").collect()


def test_kept_and_dropped(spark):
    cases = [
        (frame(), 60),
        (frame()[:33], 60),                       # shorter than both headers
        (frame(ethertype=0x86DD), 60),            # IPv6
        (frame(ethertype=0x8100), 60),            # VLAN tag
        (frame(proto=1), 60),                     # ICMP
        (frame(ihl=6, sport=53, dport=65535, proto=17), 1500),
        (frame()[:37], 60),                       # ends within the ports
        (frame(payload=b"x" * 5), None),          # captured length stands in
        (frame(ihl=15)[:60], 60),                 # options run past the frame
        (frame()[:38], 60),                       # exactly both ports
    ]
    out = decode(spark, cases)
    assert [r["ord"] for r in out] == [0, 5, 7, 9]
    first, options, bare, _ = out
    assert tuple(first)[1:] == (10, "10.0.0.1", "10.0.0.2", 1234, 80, "TCP", 60)
    assert tuple(options)[2:] == ("10.0.0.1", "10.0.0.2", 53, 65535, "UDP", 1500)
    assert bare["size"] == 38 + 5


def test_address_extremes(spark):
    out = decode(spark, [(frame(src="255.255.255.255", dst="0.0.0.0", sport=0, dport=2828), 1)])
    assert tuple(out[0])[2:6] == ("255.255.255.255", "0.0.0.0", 0, 2828)


def test_clients_keep_their_own_addresses(spark):
    """Numbers above 255 carry; cut to a byte, 10.0.351.3 and 10.0.21.3 were one client."""
    ips = ["10.0.21.3", "10.0.351.3", "10.0.255.255", "10.0.256.0", "255.255.255.255", "0.0.0.0"]
    rows = [(i, i, ip, "192.168.1.1", 32768, 80, "TCP", 40) for i, ip in enumerate(ips)]
    packets = spark.createDataFrame(rows, "ord bigint, ts_us bigint, src_ip string, dst_ip string, sport int, dport int, proto string, size bigint")
    out = decode_packets(frames_view(packets), keep=("ord",)).orderBy("ord").collect()
    assert [r["src_ip"] for r in out] == ["10.0.21.3", "10.1.95.3", "10.0.255.255", "10.1.0.0", "255.255.255.255", "0.0.0.0"]


def test_an_address_beyond_four_bytes_is_an_error(spark):
    rows = [(0, 0, "256.0.0.0", "192.168.1.1", 32768, 80, "TCP", 40)]
    packets = spark.createDataFrame(rows, "ord bigint, ts_us bigint, src_ip string, dst_ip string, sport int, dport int, proto string, size bigint")
    with pytest.raises(Exception, match="no address of four bytes"):
        frames_view(packets).collect()
