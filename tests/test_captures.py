"""Captures by byte range against reading them in one piece."""

import random
import struct

import pytest

from palisade.sources import captures, traffic


def classic(frames, order="<", nanos=False, snap=65535):
    head = struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)
    scale = 1e9 if nanos else 1e6
    return head + b"".join(struct.pack(order + "IIII", int(t), round((t % 1) * scale), len(f), len(f)) + f for t, f in frames)


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order="<"):
    return block(captures.SECTION, struct.pack(order + "IHHq", captures.ORDER_MARK, 1, 0, -1), order)


def interface(order="<", resolution=None, snap=0):
    options = b"" if resolution is None else struct.pack(order + "HHB3xHH", captures.RESOLUTION, 1, resolution, 0, 0)
    return block(captures.INTERFACE, struct.pack(order + "HHI", 1, 0, snap) + options, order)


def enhanced(t, frame, order="<", interface=0, ticks=1e6):
    value = round(t * ticks)
    return block(captures.ENHANCED, struct.pack(order + "IIIII", interface, value >> 32, value & 0xFFFFFFFF, len(frame), len(frame)) + frame + b"\0" * (-len(frame) % 4), order)


def some_frames(r, n=150):
    kinds = [lambda: bytes(r.randrange(60, 300)), lambda: r.randbytes(r.randrange(14, 200)), lambda: b"\xff" * r.randrange(1, 90), lambda: r.randbytes(3000)]
    frames = [(1_700_000_000 + i + r.randrange(10**6) / 1e6, r.choice(kinds)()) for i in range(n)]
    # frames that hold captures of their own: their records look like those of the file
    inner = classic([(1_600_000_000.5 + i, bytes(range(i + 20))) for i in range(40)])
    return frames[: n // 2] + [(1_700_000_500.25, inner), (1_700_000_501.5, inner[24:]), (1_700_000_502.0, b"")] + frames[n // 2 :]


def files(r):
    plain = some_frames(r)
    made = {f"{n}.pcap": (classic(plain, order, nanos), plain) for n, order, nanos in (("a", "<", False), ("b", ">", False), ("c", "<", True), ("d", ">", True))}
    for n, order in (("e", "<"), ("f", ">")):
        made[f"{n}.pcapng"] = (section(order) + interface(order) + b"".join(enhanced(t, f, order) for t, f in plain), plain)
    fine = [(t, f) for t, f in plain if f]
    made["g.pcapng"] = (section() + interface(resolution=9) + b"".join(enhanced(t, f, ticks=1e9) for t, f in fine[:5]) + block(0x0BAD, b"unknown!") + block(captures.SIMPLE, struct.pack("<I", 5) + b"abcde"), [*fine[:5], (None, b"abcde")])
    # a second interface and a second section on the way
    two = section() + interface() + b"".join(enhanced(t, f) for t, f in fine[:40]) + interface(resolution=3) + enhanced(7.5, b"slow", interface=1, ticks=1e3) + section(">") + interface(">") + b"".join(enhanced(t, f, ">") for t, f in fine[40:])
    made["h.pcapng"] = (two, [*fine[:40], (7.5, b"slow"), *fine[40:]])
    made["i.pcap"] = (classic([]), [])
    return made


@pytest.mark.parametrize("size", [5000, 1 << 20])
def test_ranges_give_what_one_piece_gives(spark, tmp_path, size):
    made = files(random.Random(size))
    for name, (content, _) in made.items():
        (tmp_path / name).write_bytes(content)
    index = captures.capture_index(spark, str(tmp_path), size)
    found = captures.read_frames(index).orderBy("path", "offset").collect()
    for name, (_, wanted) in made.items():
        own = [(r["timestamp"], bytes(r["frame"])) for r in found if r["path"].endswith(name)]
        assert [f for _, f in own] == [f for _, f in wanted], name
        assert all(a is b or a == pytest.approx(b, abs=1e-5) for (a, _), (b, _) in zip(own, wanted)), name
    rows = index.collect()
    assert sum(r["frames"] for r in rows) == len(found) and not any(r["error"] for r in rows)
    for name in made:
        own = sorted((r["low"], r["start"], r["stop"]) for r in rows if r["path"].endswith(name))
        assert all(a[2] == b[1] for a, b in zip(own, own[1:]))


def test_ranges_smaller_than_records(spark, tmp_path):
    frames = some_frames(random.Random(3), 12)
    content = classic(frames)
    (tmp_path / "a.pcap").write_bytes(content)
    index = captures.capture_index(spark, str(tmp_path), 97)
    found = captures.read_frames(index).orderBy("offset").collect()
    assert [bytes(r["frame"]) for r in found] == [f for _, f in frames] == [f for _, f in traffic._frames(content)]


def test_damage_is_told(spark, tmp_path):
    frames = [(1_700_000_000.0 + i, bytes([i]) * 100) for i in range(50)]
    (tmp_path / "whole.pcap").write_bytes(classic(frames))
    (tmp_path / "cut.pcap").write_bytes(classic(frames)[:-30])
    (tmp_path / "text.pcap").write_bytes(b"no capture at all" * 100)
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "cut.pcapng").write_bytes((section() + interface() + b"".join(enhanced(*f) for f in frames))[:-8])
    (tmp_path / "other.bin").write_bytes(b"x")
    index = captures.capture_index(spark, str(tmp_path), 700)
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in captures.damaged_captures(index).collect()}
    assert errors == {"cut.pcap": f"the record at offset {24 + 49 * 116} is cut", "text.pcap": "not a packet capture", "cut.pcapng": errors["cut.pcapng"]}
    assert "is cut" in errors["cut.pcapng"]
    counts = {r["path"].rsplit("/", 1)[1]: r["count"] for r in captures.read_frames(index).groupBy("path").count().collect()}
    assert counts == {"whole.pcap": 50, "cut.pcap": 49, "cut.pcapng": 49}
    with pytest.raises(ValueError, match="is cut"):
        traffic.read_traffic(spark, str(tmp_path / "cut.pcap"))


def test_frames_without_ipv4_are_counted(spark, tmp_path):
    ethernet = bytes(12)
    ip = bytes.fromhex("4500001c0000000040110000" "0a000001" "0a000002") + bytes(8)
    frames = [ethernet + b"\x08\x00" + ip, ethernet + b"\x08\x06" + bytes(28), ethernet + b"\x86\xdd" + bytes(40), b"short", ethernet + b"\x08\x00" + b"\x45", ethernet + b"\x81\x00\x00\x05\x08\x00" + ip]
    (tmp_path / "a.pcap").write_bytes(classic([(1_700_000_000.0 + i, f) for i, f in enumerate(frames)]))
    index = captures.capture_index(spark, str(tmp_path))
    read = captures.read_frames(index)
    assert captures.packets(read).count() == 2
    assert sorted(r["reason"] for r in captures.other_frames(read).collect()) == ["ARP", "IPv6", "damaged IPv4", "short frame"]
    assert traffic.read_traffic(spark, str(tmp_path / "a.pcap")).count() == 2


def test_small_captures_share_tasks(spark, tmp_path):
    header = bytes.fromhex("D4C3B2A10200040000000000" "00000000FFFF000001000000")
    for i in range(60):
        (tmp_path / f"c{i}.pcap").write_bytes(header + b"".join(struct.pack("<IIII", 1 + k, i, 20, 20) + bytes([k] * 20) for k in range(5)))
    index = captures.capture_index(spark, str(tmp_path), 100)
    frames = captures.read_frames(index)
    assert index.count() == 180 and frames.count() == 300
    assert frames.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
