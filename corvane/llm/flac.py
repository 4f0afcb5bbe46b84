"""Media columns as FLAC: 8-bit mono streams with Rice-coded residuals of linear predictors, checksums and seek points.

Encoder and decoder work on many frames at once: frames of one size and one predictor form a matrix, bit positions of
Rice codes come from running sums, and the decoder follows the chains of code ends of all frames in step. The seek table
has a point for each frame, so a reader can start at any sample offset and decode frames apart from each other. The
decoder checks the frame headers' CRC-8, the frames' CRC-16 and the MD5 of all samples; a mismatch is an error.

Defined cases: null and empty texts are 64 zero bytes; equal texts give equal streams; long texts go through in chunks of
frames, so memory is bounded by CHUNK frames besides the text itself; repeated rows and ties stay repeated; identifiers
may be numbers, strings or null; columns of the input may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ident, ident_type, texts_of

BLOCK, CHUNK, UNIT, RATE = 1024, 1024, 64, 8000
#: Fixed predictors of the format, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: The encoder's own predictor: order, bits of a coefficient, and how many of them are a fraction.
ORDER, PRECISION, SHIFT = 2, 8, 6
#: Names of the encoder's choices: constant, verbatim, fixed orders 0 to 2, and linear prediction.
CONSTANT, VERBATIM, LPC = -2, -1, 9


def _table(poly: int, bits: int) -> np.ndarray:
    """CRC table of a polynomial, highest bit first."""
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for n in range(256):
        c = n << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.uint16)


CRC16, CRC8 = _table(0x8005, 16), _table(0x07, 8).tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many pieces of data, all in step."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order].astype(np.int64), lengths[order]
    crc = np.zeros(len(order), dtype=np.uint16)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")  # pieces longer than t
    for t, m in enumerate(live.tolist()):
        c = crc[:m]
        crc[:m] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ data[at[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(n: int) -> bytes:
    """The format's variable-length frame number."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = bytes(0x80 | (n >> (6 * k) & 63) for k in range(size - 2, -1, -1))
    return bytes([(0xFF << (8 - size)) & 0xFF | (n >> (6 * (size - 1)))]) + tail


def frame_header(size: int, number: int) -> bytes:
    short = size == BLOCK
    head = bytes([0xFF, 0xF8, 0xA0 if short else 0x70, 0x02]) + utf8_number(number) + (b"" if short else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.int32)


def _predicted(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    """Residuals after the warm-up samples; coef by row, nearest sample first."""
    order = coef.shape[1]
    n = x.shape[1]
    guess = sum(coef[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j] for j in range(order)) if order else 0
    return x[:, order:] - (guess >> shift if order else 0)


def _own_coefficients(x: np.ndarray) -> np.ndarray:
    """Order-2 predictor of each row by its autocorrelation, quantised."""
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1) + 1e-3, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1 + 1e-3 * r0
    a = np.stack([(r1 * r0 - r1 * r2) / det, (r2 * r0 - r1 * r1) / det], axis=1)
    return np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def _put(bits: np.ndarray, at: np.ndarray, value, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _choose(x: np.ndarray):
    """For each row: the choice, the Rice parameter; and what the choices need."""
    n, size = x.shape
    coef = _own_coefficients(x)
    rests = {0: x, 1: np.diff(x, axis=1)}
    rests[2] = np.diff(rests[1], axis=1)
    rests[LPC] = _predicted(x, coef, SHIFT)
    cost = np.full(n, size * 8, dtype=np.int64)
    choice, param = np.full(n, VERBATIM), np.zeros(n, dtype=np.int64)
    codes = {}
    for what, r in rests.items():
        u = codes[what] = _zigzag(r.astype(np.int32))
        k0 = np.clip(np.floor(np.log2(u.mean(axis=1) * 0.7 + 1e-6)), 0, 13).astype(np.int64)
        fixed = 10 + (8 * ORDER + 9 + ORDER * PRECISION if what == LPC else 8 * what)
        for k in (k0, k0 + 1):
            total = fixed + u.shape[1] * (1 + k) + (u >> k[:, None].astype(np.int32)).sum(axis=1)
            better = total < cost
            cost[better], choice[better], param[better] = total[better], what, k[better]
    choice[(x == x[:, :1]).all(axis=1)] = CONSTANT
    return choice, param, codes, coef


def encode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of data[start : start + size] (bytes), with their headers and checksums."""
    bodies: list = [None] * len(starts)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = data[starts[rows][:, None] + np.arange(size)]
        x = raw.astype(np.int32) - 128
        choice, param, codes, coef = _choose(x)
        for what in np.unique(choice):
            own = np.flatnonzero(choice == what)
            if what in (VERBATIM, CONSTANT):
                for i in own:
                    bodies[rows[i]] = (b"\x02" + (x[i].astype(np.int8).tobytes())) if what == VERBATIM else b"\x00" + x[i, :1].astype(np.int8).tobytes()
                continue
            order = ORDER if what == LPC else int(what)
            u, k = codes[what][own], param[own]
            quot = (u >> k[:, None].astype(np.int32)).astype(np.int64)
            ends = np.cumsum(quot + 1 + k[:, None], axis=1)  # after each code
            fixed = 8 + 8 * order + (9 + ORDER * PRECISION if what == LPC else 0)
            nbytes = (fixed + 10 + ends[:, -1] + 7) // 8
            offs = (np.cumsum(nbytes) - nbytes) * 8
            bits = np.zeros(int(nbytes.sum()) * 8, dtype=np.uint8)
            _put(bits, offs, (0x20 | (order - 1) if what == LPC else 0x08 | order) << 1, 8)
            for j in range(order):
                _put(bits, offs + 8 + 8 * j, x[own, j] & 0xFF, 8)
            if what == LPC:
                at = offs + 8 + 8 * order
                _put(bits, at, PRECISION - 1, 4)
                _put(bits, at + 4, SHIFT, 5)
                for j in range(ORDER):
                    _put(bits, at + 9 + PRECISION * j, coef[own, j] & ((1 << PRECISION) - 1), PRECISION)
            at = offs + fixed
            _put(bits, at + 6, k, 4)  # before it: method 0 and one partition
            stops = (at + 10)[:, None] + ends - k[:, None] - 1
            bits[stops.reshape(-1)] = 1
            for j in range(int(k.max())):
                deep = k > j
                if deep.all():
                    bits[stops + 1 + j] = (u >> (k[:, None] - 1 - j)) & 1
                else:
                    bits[stops[deep] + 1 + j] = (u[deep] >> (k[deep][:, None] - 1 - j)) & 1
            packed = np.packbits(bits)
            for i, s, n in zip(own, (offs // 8).tolist(), nbytes.tolist()):
                bodies[rows[i]] = packed[s : s + n].tobytes()
    frames = [frame_header(int(s), int(n)) + b for s, n, b in zip(sizes, numbers, bodies)]
    lengths = np.array([len(f) for f in frames])
    sums = crc16_many(np.frombuffer(b"".join(frames), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, sums)]


def encode_many(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload (bytes as 8-bit samples, byte b as sample b - 128)."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    starts, sizes, numbers, owner, at = [], [], [], [], 0
    for n, p in enumerate(payloads):
        for k, s in enumerate(range(0, len(p), block)):
            starts.append(at + s)
            sizes.append(min(block, len(p) - s))
            numbers.append(k)
            owner.append(n)
        at += len(p)
    frames: list[list[bytes]] = [[] for _ in payloads]
    starts_, sizes_, numbers_ = np.array(starts), np.array(sizes), np.array(numbers)
    for c in range(0, len(starts), CHUNK):
        some = slice(c, c + CHUNK)
        for n, f in zip(owner[some], encode_frames(data, starts_[some], sizes_[some], numbers_[some])):
            frames[n].append(f)
    out = []
    for p, own in zip(payloads, frames):
        lengths = [len(f) for f in own]
        signed = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        info = block.to_bytes(2, "big") * 2 + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, offset = [], 0
        for k, n in enumerate(lengths):
            points.append((k * block).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(p) - k * block).to_bytes(2, "big"))
            offset += n
        seek = b"".join(points)
        # a metadata block holds 24 bits of length; streams with more seek points have several tables
        most = 18 * 900_000
        tables = [seek[i : i + most] for i in range(0, max(1, len(seek)), most)]
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info
        for k, t in enumerate(tables):
            head += bytes([3 | (0x80 if k == len(tables) - 1 else 0)]) + len(t).to_bytes(3, "big") + t
        out.append(head + b"".join(own))
    return out


def read_metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, their MD5, seek points (sample, offset, samples) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total, digest = 4, False, [], 0, b""
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body, last = stream[at + 4 : at + 4 + n], bool(kind & 0x80)
        if kind & 0x7F == 0:
            total, digest = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
            if int.from_bytes(body[10:18], "big") >> 36 & 31 != 7 or int.from_bytes(body[10:18], "big") >> 41 & 7:
                raise ValueError("only 8-bit mono is stored here")
        elif kind & 0x7F == 3:
            points += [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    return total, digest, points, at


class _Bits:
    """A few fields at the head of a frame."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)


def _signed(v: int, bits: int) -> int:
    return v - (1 << bits) if v >> (bits - 1) else v


def _head(frame: bytes) -> tuple:
    """number, size, kind, order, warm-up, coefficients, shift, Rice parameter, bit at which codes begin."""
    if frame[0] != 0xFF or frame[1] != 0xF8 or frame[3] != 0x02:
        raise ValueError("no frame here")
    first = frame[4]
    extra = 0 if first < 128 else next(k for k in range(1, 8) if not first >> (6 - k) & 1)
    number = first if not extra else first & ((1 << (6 - extra)) - 1)
    for b in frame[5 : 5 + extra]:
        number = number << 6 | b & 63
    at, code = 5 + extra, frame[2] >> 4
    if code == 7:
        size, at = int.from_bytes(frame[at : at + 2], "big") + 1, at + 2
    elif code == 6:
        size, at = frame[at] + 1, at + 1
    else:
        size = 256 << (code - 8) if code >= 8 else 192 if code == 1 else 576 << (code - 2)
    if crc8(frame[:at]) != frame[at]:
        raise ValueError("header checksum")
    at += 1
    kind = frame[at] >> 1
    if frame[at] & 1:
        raise ValueError("no wasted bits are stored here")
    if kind < 2:
        return number, size, CONSTANT if kind == 0 else VERBATIM, 0, (), (), 0, 0, 8 * (at + 1)
    linear = bool(kind & 0x20)
    order = (kind & 31) + 1 if linear else kind & 7
    bits = _Bits(frame[at + 1 : at + 1 + 128])
    warm = tuple(_signed(bits.take(8), 8) for _ in range(order))
    used, coef, shift = 8 * (at + 1) + 8 * order, FIXED[order] if not linear else (), 0
    if linear:
        precision, shift = bits.take(4) + 1, _signed(bits.take(5), 5)
        coef = tuple(_signed(bits.take(precision), precision) for _ in range(order))
        used += 9 + order * precision
    if bits.take(6):
        raise ValueError("only one partition of 4-bit parameters is stored here")
    rice = bits.take(4)
    if rice == 15:
        raise ValueError("no escaped partition is stored here")
    return number, size, LPC if linear else 0, order, warm, coef, shift, rice, used + 10


def decode_frames(data: np.ndarray, whole: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(frame number, bytes) of each frame; data is whole as an array."""
    if len(starts) == 0:
        return []
    ends = starts + lengths
    sums = crc16_many(data, starts, lengths - 2)
    told = data[ends - 2].astype(np.uint16) << np.uint16(8) | data[ends - 1]
    if not np.array_equal(sums, told):
        raise ValueError("frame checksum")
    heads = [_head(whole[s : min(e, s + 160)]) for s, e in zip(starts.tolist(), ends.tolist())]
    out: list = [None] * len(heads)
    groups: dict[tuple, list[int]] = {}
    for n, (number, size, kind, order, *_) in enumerate(heads):
        if kind in (CONSTANT, VERBATIM):
            s = int(starts[n]) + heads[n][8] // 8
            body = data[s : s + (1 if kind == CONSTANT else size)] ^ 0x80
            out[n] = (number, np.repeat(body, size) if kind == CONSTANT else body)
        else:
            groups.setdefault((size, kind, order), []).append(n)
    if not groups:
        return out
    base = int(starts.min())
    part = data[base : int(ends.max())]
    bits = np.unpackbits(part)
    ones = np.flatnonzero(bits).astype(np.int32)
    before = np.cumsum(bits, dtype=np.int32) - bits
    after = np.append(ones, np.int32(len(bits)))[before]  # the next one at or after each bit
    wide = np.concatenate([part, np.zeros(3, np.uint8)]).astype(np.uint32)
    wide = wide[:-3] << 16 | wide[1:-2] << 8 | wide[2:-1]
    for (size, kind, order), own in groups.items():
        k = np.array([heads[n][7] for n in own], dtype=np.int32)
        at = np.array([(int(starts[n]) - base) * 8 + heads[n][8] for n in own], dtype=np.int32)
        m = size - order
        begins, stops = np.empty((m, len(own)), np.int32), np.empty((m, len(own)), np.int32)
        step = k + 1
        for t in range(m):
            begins[t] = at
            stop = after[at]
            stops[t] = stop
            at = stop + step
        low = stops + 1
        rest = (wide[np.minimum(low >> 3, len(wide) - 1)] >> (24 - (low & 7) - k[None]).astype(np.uint32)).astype(np.int32) & ((1 << k[None]) - 1)
        u = (stops - begins) << k[None] | rest
        r = (u >> 1) ^ -(u & 1)
        x = np.empty((size, len(own)), np.int32)
        for j in range(order):
            x[j] = [heads[n][4][j] for n in own]
        if kind == 0 and order == 0:
            x[:] = r
        elif kind == 0 and order == 1:
            x[1:] = r
            np.cumsum(x, axis=0, out=x)
        else:
            coef = np.array([heads[n][5] for n in own], dtype=np.int32).T
            shift = np.array([heads[n][6] for n in own], dtype=np.int32)
            for t in range(order, size):
                guess = coef[0] * x[t - 1]
                for j in range(1, order):
                    guess += coef[j] * x[t - 1 - j]
                x[t] = r[t - order] + (guess >> shift)
        cols = (x + 128).astype(np.uint8).T
        for i, n in enumerate(own):
            out[n] = (heads[n][0], cols[i])
    return out


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, with every checksum tested."""
    metas = [read_metadata(s) for s in streams]
    out = []
    jobs = []  # stream, absolute start, length
    whole = b"".join(streams)
    data, at = np.frombuffer(whole, dtype=np.uint8), 0
    for n, (s, (_, _, points, first)) in enumerate(zip(streams, metas)):
        offs = [p[1] for p in points] + [len(s) - first]
        jobs += [(n, at + first + a, b - a) for a, b in zip(offs, offs[1:])]
        at += len(s)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for c in range(0, len(jobs), CHUNK):
        some = jobs[c : c + CHUNK]
        for (n, _, _), (number, x) in zip(some, decode_frames(data, whole, np.array([j[1] for j in some]), np.array([j[2] for j in some]))):
            if number != len(parts[n]):
                raise ValueError("frame number")
            parts[n].append(x)
    for (total, digest, _, _), own in zip(metas, parts):
        x = np.concatenate(own) if own else np.zeros(0, np.uint8)
        if len(x) != total or hashlib.md5((x ^ 0x80).tobytes()).digest() != digest:
            raise ValueError("samples' checksum")
        out.append(x.tobytes())
    return out


def decode_from(stream: bytes, sample: int) -> bytes:
    """The payload from a sample offset on, beginning with the frame that holds it; earlier frames are not read."""
    _, _, points, first = read_metadata(stream)
    offs = [p[1] for p in points] + [len(stream) - first]
    keep = [i for i, p in enumerate(points) if p[0] + p[2] > sample]
    if not keep:
        return b""
    got = decode_frames(np.frombuffer(stream, dtype=np.uint8), stream, np.array([first + offs[i] for i in keep]), np.array([offs[i + 1] - offs[i] for i in keep]))
    return np.concatenate([x for _, x in got]).tobytes()[sample - points[keep[0]][0] :]


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def feature_of(payload: bytes) -> str:
    """Mean, root mean square, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};peak={int(np.abs(x).max())}"


#: Bytes of payload that go through the coder together.
TOGETHER = 2 << 20


def _grouped(items: list[tuple]) -> Iterator[list[tuple]]:
    group, size = [], 0
    for item in items:
        if group and size + len(item[-1]) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[-1])
    if group:
        yield group


MEDIA = "n_bytes long, media binary"


def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [(i, len(t), payload_of(t)) for i, t in zip(batch.column(0).to_pylist(), (x.as_py() or b"" for x in batch.column(1)))]
        for group in _grouped(items):
            media = encode_many([g[-1] for g in group])
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], batch.column(0).type), pa.array([g[1] for g in group], pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_bytes and the media column: one FLAC stream per row."""
    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(to_media, f"_id {ident_type(docs, id_col)}, {MEDIA}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (m.as_py() for m in batch.column(2))))
        for group in _grouped(items):
            got = decode_many([g[-1] for g in group])
            rows = [(i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(p)) for (i, n, m), p in zip(group, got)]
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the stored streams."""
    return media.mapInArrow(_digests, f"_id {ident_type(media, '_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _pcm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, media in zip(batch.column(0).to_pylist(), (m.as_py() for m in batch.column(2))):
            payload = decode_many([media])[0]
            offs = list(range(0, len(payload), BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(offs), batch.column(0).type), pa.array(offs, pa.int64()), pa.array([(np.frombuffer(payload[o : o + BLOCK], np.uint8) ^ 0x80).tobytes() for o in offs], pa.binary())], ["_id", "sample_offset", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded PCM blocks (signed 8-bit) with their sample offsets."""
    return media.mapInArrow(_pcm, f"_id {ident_type(media, '_id')}, sample_offset long, pcm binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(store(docs)).withColumnRenamed("_id", "doc_id")
