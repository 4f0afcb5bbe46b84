import hashlib
import zlib

import numpy as np
import pytest

from corvane.llm import flac
from tests.llm.helpers import SCHEMA, edge_rows, random_rows


def payloads():
    rng = np.random.default_rng(0)
    wave = (128 + 60 * np.sin(np.arange(9000) / 9) + rng.normal(0, 2, 9000)).astype(np.uint8).tobytes()
    return [bytes(64), b"text " * 300 + bytes(36), rng.integers(0, 256, 1024 * 3, dtype=np.uint8).tobytes(), bytes(range(256)) * 5, wave[:8960], b"\xff" * 2048, rng.integers(0, 256, 64, dtype=np.uint8).tobytes(), b"\x00\xff" * 512]


def test_round_trip():
    all_ = payloads()
    assert flac.decode_many(flac.encode_many(all_)) == all_
    for p in all_:
        assert flac.decode_many(flac.encode_many([p])) == [p]
        assert flac.encode_many([p]) == [flac.encode_many(all_)[all_.index(p)]]


def test_predictors_are_used():
    wave = payloads()[4]
    stream = flac.encode_many([wave])[0]
    assert len(stream) < 0.7 * len(wave)
    _, _, points, first = flac.read_metadata(stream)
    kinds = {flac._head(stream[first + p[1] :][:200])[2] for p in points}
    assert kinds & {0, flac.LPC}
    text = flac.encode_many([("the quick brown fox jumps over the lazy dog " * 99).encode()[:4096]])[0]
    assert len(text) < 4096


@pytest.mark.parametrize("order", range(5))
def test_fixed_predictors_of_every_order_are_decoded(order):
    """A frame written by hand, bit by bit."""
    x = [int(5 * k + (k % 3)) - 60 for k in range(16)]
    coef = flac.FIXED[order]
    rest = [x[k] - sum(c * x[k - 1 - j] for j, c in enumerate(coef)) for k in range(order, 16)]
    bits = f"0{8 | order:06b}0" + "".join(f"{v & 255:08b}" for v in x[:order]) + "00" + "0000" + f"{3:04b}"
    for r in rest:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 3) + "1" + f"{u & 7:03b}"
    bits += "0" * (-len(bits) % 8)
    frame = flac.frame_header(16, 0) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = flac.crc16_many(np.frombuffer(frame, dtype=np.uint8), np.array([0]), np.array([len(frame)]))[0]
    frame += int(crc).to_bytes(2, "big")
    got = flac.decode_frames(np.frombuffer(frame, dtype=np.uint8), frame, np.array([0]), np.array([len(frame)]))
    assert (got[0][1].astype(int) - 128).tolist() == x


def test_checksums_are_tested():
    stream = bytearray(flac.encode_many([payloads()[1]])[0])
    _, _, points, first = flac.read_metadata(bytes(stream))
    for at in (first + 2, first + 60, len(stream) - 1, 30):
        bad = stream.copy()
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])


def test_known_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    data = np.frombuffer(b"123456789", dtype=np.uint8)
    assert int(flac.crc16_many(data, np.array([0, 0]), np.array([9, 0]))[0]) == 0xFEE8


def test_seeking():
    p = payloads()[2] + payloads()[4]
    stream = flac.encode_many([p])[0]
    for at in (0, 1, 1023, 1024, 5000, len(p) - 1, len(p)):
        assert flac.decode_from(stream, at) == p[at:]


def test_frame_numbers():
    assert flac.utf8_number(127) == b"\x7f" and flac.utf8_number(128) == "\x80".encode() and flac.utf8_number(0x20AC) == "€".encode() and flac.utf8_number(0x1F600) == "😀".encode()


def test_rows(spark):
    rows = edge_rows() + random_rows(80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    media = flac.store(df)
    got = flac.digests(media).collect()
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + bytes(64 if not raw else -len(raw) % 64)
        want.append(str((r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))))
    assert sorted(str((g["_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"])) for g in got) == sorted(want)
    same = {}
    for g in got:
        assert same.setdefault(g["payload_sha256"] + str(g["n_bytes"]), (g["media_sha256"], g["feature"], g["media_bytes"])) == (g["media_sha256"], g["feature"], g["media_bytes"])
    pcm = flac.pcm_blocks(media.where("_id = 5")).collect()
    assert sum(len(b["pcm"]) for b in pcm) == 2 * 200_000 // 64 * 64 + (2 * 64 if 200_000 % 64 else 0)
    assert {b["sample_offset"] % flac.BLOCK for b in pcm} == {0}
    assert flac.digests(flac.store(spark.createDataFrame([], SCHEMA))).count() == 0
