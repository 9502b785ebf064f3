"""FLAC streams for columns of media: many short streams are coded and read together.

The reader follows the public format: metadata, frame headers with their CRC-8, constant, verbatim,
fixed and linear-predictor subframes, Rice residuals in partitions with escapes, stereo
decorrelation, CRC-16 of each frame and the MD5 of all samples. Frames of many streams are decoded
in step: one array operation reads the next residual of every frame. A seek table gives all
frames at once; streams without one are read frame by frame.

The writer makes mono streams of fixed predictors with one Rice partition per frame, or verbatim
frames where these are smaller, and a seek point for each frame.

Defined results: null counts as empty text; a payload is the text's UTF-8 filled with zero bytes
to a positive multiple of 64; equal texts give equal streams; a stream whose checksums do not
match raises an error that fails its task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from paneltide.llm.common import map_texts, written

BLOCK = 4096
UNIT = 64
SAMPLE_RATE = 8000
MAX_ORDER = 2


def crc_table(polynomial: int, width: int) -> np.ndarray:
    table, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        table.append(value)
    return np.array(table, np.uint16)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
CRC8_LIST = CRC8.tolist()


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = CRC8_LIST[value ^ b]
    return value


def crc16(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many pieces of one buffer, in step."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    active = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
    value = np.zeros(len(order), np.uint16)
    for t, a in enumerate(active.tolist()):
        v = value[:a]
        value[:a] = (v << np.uint16(8)) ^ CRC16[(v >> np.uint16(8)) ^ buffer[at[:a] + t]]
    out = np.empty_like(value)
    out[order] = value
    return out


def coded_number(n: int) -> bytes:
    """A number in the extended UTF-8 code of frame headers."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6)) if n < 1 << 36 else 6
    head = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([head | n >> (6 * more), *(0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1))])


# ---------------------------------------------------------------- writing


def put_bits(n_bytes: int, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes with each value (up to 16 bits wide) at its bit position; the positions do not overlap."""
    window = value.astype(np.uint32) << (24 - (at & 7) - width).astype(np.uint32)
    byte = at >> 3
    out = np.zeros(n_bytes + 3)
    for shift in (16, 8, 0):
        made = np.bincount(byte, weights=(window >> np.uint32(shift)) & np.uint32(255), minlength=len(out))
        out += made[: len(out)]
        byte = byte + 1
    return out[:n_bytes].astype(np.uint8)


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream (mono, 8 bits) for each payload; a byte b is the sample b - 128."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    per = -(-sizes // block)
    doc = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(block, sizes[doc] - number * block)
    raw = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - np.int16(128)
    begin = np.cumsum(length) - length
    column = np.arange(block)
    inside = column < length[:, None]
    x = np.zeros((len(doc), block), np.int32)
    x[inside] = raw

    # Residual of each order and the bits that it needs with the best parameter near the mean.
    best_bits = np.where((x == x[:, :1]) | ~inside, True, False).all(axis=1)
    constant = best_bits
    bits = np.full(len(doc), 8, np.int64) + 8 * length  # verbatim
    order, rice = np.full(len(doc), -1), np.zeros(len(doc), np.int64)
    residual, r = np.zeros_like(x), x
    for o in range(min(MAX_ORDER, 4) + 1):
        if o:
            r = np.diff(r, axis=1, prepend=0)
        counts = inside & (column >= o)
        u = np.where(counts, (r << 1) ^ (r >> 31), 0)
        n = np.maximum(1, length - o)
        guess = np.log2(np.maximum(1, u.sum(axis=1) / n)).astype(np.int64)
        for k in (guess - 1, guess, guess + 1):
            k = np.clip(k, 0, 14)
            need = 8 + 8 * o + 10 + (u >> k[:, None]).sum(axis=1) + (length - o) * (k + 1)
            better = (need < bits) & (length > o) & ~constant
            bits[better], order[better], rice[better] = need[better], o, k[better]
            residual[better] = u[better]
    bits[constant] = 16

    heads = [_frame_head(int(i), int(n), block) for i, n in zip(number, length)]
    head_size = np.array([len(h) for h in heads])
    body = (bits + 7) // 8
    start = np.cumsum(head_size + body + 2) - (head_size + body + 2)
    total = int((head_size + body + 2).sum())
    first = 8 * (start + head_size)

    # Fields of all frames: kind of subframe, first samples, residual header, residuals or samples.
    kind = np.where(constant, 0, np.where(order < 0, 1, 8 + order)) << 1
    fixed, verbatim = np.flatnonzero((order >= 0) & ~constant), np.flatnonzero((order < 0) & ~constant)
    at, value, width = [first], [kind], [np.full(len(doc), 8)]
    flat = np.flatnonzero(constant)
    at.append(first[flat] + 8), value.append(x[flat, 0] & 255), width.append(np.full(len(flat), 8))
    for o in range(MAX_ORDER):
        f = fixed[order[fixed] > o]
        at.append(first[f] + 8 + 8 * o), value.append(x[f, o] & 255), width.append(np.full(len(f), 8))
    at.append(first[fixed] + 8 + 8 * order[fixed]), value.append(rice[fixed]), width.append(np.full(len(fixed), 10))
    vf, vt = np.nonzero(inside[verbatim])
    at.append(first[verbatim][vf] + 8 + 8 * vt), value.append(x[verbatim][vf, vt] & 255), width.append(np.full(len(vf), 8))
    ff, ft = np.nonzero(inside[fixed] & (column >= order[fixed][:, None]))
    u, k = residual[fixed][ff, ft], rice[fixed][ff]
    size = (u >> k) + 1 + k
    ends = np.cumsum(size)
    frame_first = np.zeros(len(fixed) + 1, np.int64)
    np.cumsum(np.bincount(ff, weights=size, minlength=len(fixed)).astype(np.int64), out=frame_first[1:])
    code = first[fixed][ff] + 18 + 8 * order[fixed][ff] + ends - size - frame_first[ff]
    at.append(code + (u >> k)), value.append((1 << k) | (u & ((1 << k) - 1))), width.append(k + 1)
    buffer = put_bits(total, np.concatenate(at), np.concatenate(value), np.concatenate(width))
    for s, h in zip(start.tolist(), heads):
        buffer[s : s + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(buffer, start, head_size + body)
    buffer[start + head_size + body], buffer[start + head_size + body + 1] = sums >> 8, sums & 255

    whole, frame_size, out = buffer.tobytes(), (head_size + body + 2), []
    firsts = np.cumsum(per) - per
    for i, payload in enumerate(payloads):
        f = slice(int(firsts[i]), int(firsts[i] + per[i]))
        a = int(start[f][0])
        b = a + int(frame_size[f].sum())
        signed = (raw[int(begin[f][0]) : int(begin[f][0]) + len(payload)].astype(np.int8)).tobytes()
        points = b"".join(struct.pack(">QQH", int(n) * block, int(s) - a, int(k)) for n, s, k in zip(number[f], start[f], length[f]))
        info = struct.pack(">HH", block, block) + int(frame_size[f].min()).to_bytes(3, "big") + int(frame_size[f].max()).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + whole[a:b])
    return out


def _frame_head(number: int, length: int, block: int) -> bytes:
    usual = length == block == 4096
    head = bytes([0xFF, 0xF8, 0xC0 if usual else 0x70, 0x02]) + coded_number(number) + (b"" if usual else struct.pack(">H", length - 1))
    return head + bytes([crc8(head)])


# ---------------------------------------------------------------- reading


@dataclass
class Stream:
    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    first_frame: int
    #: (first sample, byte offset of the frame, samples x channels)
    blocks: list[tuple[int, int, np.ndarray]] = field(default_factory=list)


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, made, seek = 4, False, None, []
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            made = Stream(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), body[18:34], [], 0)
        elif kind == 3:
            seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    if made is None:
        raise ValueError("no stream information")
    made.seek, made.first_frame = seek, at
    return made


class Bits:
    """Reads a few bits of a frame's header fields."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        end = self.at + n
        window = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7)
        self.at = end
        return window & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


@dataclass
class Frame:
    stream: int
    offset: int
    length: int
    channels: int
    assignment: int
    depth: int
    bit: int


def read_frame_head(data: bytes, base: int, offset: int, stream: Stream, index: int) -> Frame:
    b = Bits(data, 8 * (base + offset))
    if b.take(15) != 0x7FFC:
        raise ValueError(f"no frame at byte {offset}")
    b.take(1)
    size, rate, assignment, depth, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
    lead = b.take(8)
    b.take(8 * max(0, 8 - (lead ^ 0xFF).bit_length() - 1) if lead & 0x80 else 0)
    if size == 6:
        length = b.take(8) + 1
    elif size == 7:
        length = b.take(16) + 1
    else:
        length = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = b.at >> 3
    if crc8(data[base + offset : end]) != b.take(8):
        raise ValueError(f"frame header at byte {offset}: CRC-8 does not match")
    depths = {0: stream.depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
    return Frame(index, offset, length, assignment + 1 if assignment < 8 else 2, assignment, depths[depth], b.at)


def rice_step(next_one: np.ndarray, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads n[i] codes with parameter k[i] from bit at[i]: places of the stop bits, code starts, ends."""
    order = np.argsort(-n, kind="stable")
    most = int(n.max(initial=0))
    active = np.searchsorted(-n[order], -np.arange(most), side="left").tolist()
    pos, step = at[order].copy(), (k[order] + 1).astype(pos_type := np.int64)
    stop, start = np.zeros((most, len(n)), pos_type), np.zeros((most, len(n)), pos_type)
    for t, a in enumerate(active):
        start[t, :a] = pos[:a]
        stop[t, :a] = found = next_one[pos[:a]]
        pos[:a] = found + step[:a]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return stop[:, back].T, start[:, back].T, pos[back]


def decode_subframes(data: bytes, raw: np.ndarray, next_one: np.ndarray, frames: list[Frame], depth: list[int]) -> list[np.ndarray]:
    """The next subframe of each frame, all in step; moves each frame's bit on."""
    n = len(frames)
    out: list = [None] * n
    coded = []
    for i, f in enumerate(frames):
        b = Bits(data, f.bit)
        b.take(1)
        kind, wasted = b.take(6), 0
        if b.take(1):
            wasted = 1
            while not b.take(1):
                wasted += 1
        d = depth[i] - wasted
        if kind == 0:
            out[i] = np.full(f.length, b.signed(d), np.int64) << wasted
        elif kind == 1:
            size = d * f.length
            if d == 8 and not b.at & 7:
                out[i] = raw[b.at >> 3 : (b.at >> 3) + f.length].view(np.int8).astype(np.int64) << wasted
                b.at += size
            else:
                out[i] = np.array([b.signed(d) for _ in range(f.length)], np.int64) << wasted
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm, shift, weights = [b.signed(d) for _ in range(order)], 0, None
            if kind >= 32:
                precision = b.take(4) + 1
                shift = b.signed(5)
                weights = [b.signed(precision) for _ in range(order)]
            method, parts = b.take(2), b.take(4)
            if method > 1:
                raise ValueError("reserved residual coding")
            coded.append((i, order, warm, weights, shift, wasted, method, 1 << parts))
        else:
            raise ValueError("reserved subframe type")
        f.bit = b.at
    if coded:
        _decode_residuals(data, raw, next_one, frames, coded, out)
    return out


def _decode_residuals(data, raw, next_one, frames, coded, out) -> None:
    length = np.array([frames[c[0]].length for c in coded])
    order = np.array([c[1] for c in coded])
    parts = np.array([c[7] for c in coded])
    values = np.zeros((len(coded), int(length.max())), np.int64)
    at, done = np.array([frames[c[0]].bit for c in coded], np.int64), order.copy()
    for part in range(int(parts.max())):
        here = np.flatnonzero(parts > part)
        count = length[here] // parts[here] - (order[here] if part == 0 else 0)
        k, raw_width = np.zeros(len(here), np.int64), np.full(len(here), -1)
        for j, h in enumerate(here.tolist()):
            b = Bits(data, int(at[h]))
            size = 5 if coded[h][6] else 4
            k[j] = b.take(size)
            if k[j] == (1 << size) - 1:
                raw_width[j] = b.take(5)
            at[h] = b.at
        escaped = raw_width >= 0
        for j in np.flatnonzero(escaped).tolist():
            h, b = here[j], Bits(data, int(at[here[j]]))
            values[h, done[h] : done[h] + count[j]] = [b.signed(int(raw_width[j])) for _ in range(count[j])]
            at[h] = b.at
        plain = np.flatnonzero(~escaped)
        if len(plain):
            rows, size, kk = here[plain], count[plain], k[plain]
            stop, start, end = rice_step(next_one, at[rows], kk, size)
            low_at = stop + 1
            byte = np.minimum(low_at >> 3, len(raw) - 5)
            window = raw[byte].astype(np.int64)
            for more in range(1, 5):
                window = window << 8 | raw[byte + more]
            width = kk[:, None]
            low = window >> (40 - (low_at - 8 * byte) - width) & ((1 << width) - 1)
            u = (stop - start) << width | low
            r = u >> 1 ^ -(u & 1)
            column = np.arange(r.shape[1])
            i, t = np.nonzero(column < size[:, None])
            values[rows[i], done[rows][i] + t] = r[i, t]
            at[rows] = end
        done[here] += count
    for row, (i, o, warm, weights, shift, wasted, _, _) in enumerate(coded):
        frames[i].bit = int(at[row])
    for o in np.unique(order).tolist():
        rows = [j for j, c in enumerate(coded) if c[1] == o and c[3] is None]
        if rows:  # fixed predictor: the residual is the o-th difference
            x = values[rows]
            for column in range(o):
                x[:, column] = [np.diff(coded[j][2][: column + 1], n=column)[0] for j in rows]
            for column in range(o - 1, -1, -1):
                x[:, column:] = np.cumsum(x[:, column:], axis=1)
            values[rows] = x
        rows = [j for j, c in enumerate(coded) if c[1] == o and c[3] is not None]
        if rows:  # linear predictor
            x = values[rows]
            x[:, :o] = [coded[j][2] for j in rows]
            weights, shift = np.array([coded[j][3] for j in rows])[:, ::-1], np.array([coded[j][4] for j in rows])
            for t in range(o, x.shape[1]):
                x[:, t] += (weights * x[:, t - o : t]).sum(axis=1) >> shift
            values[rows] = x
    for row, c in enumerate(coded):
        out[c[0]] = values[row, : length[row]] << c[5]


def decode(streams: list[bytes]) -> list[Stream]:
    """All samples of the streams, in blocks that know their first sample and byte."""
    if not streams:
        return []
    made = [read_metadata(s) for s in streams]
    data = b"".join(streams)
    base = np.cumsum([0] + [len(s) for s in streams])
    raw = np.frombuffer(data + bytes(8), np.uint8)
    bits = np.unpackbits(raw)
    next_one = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    next_one = np.minimum.accumulate(next_one[::-1])[::-1]
    waiting = [[s.first_frame + p[1] for p in s.seek] or [s.first_frame] for s in made]
    seekable = [bool(s.seek) for s in made]
    while any(waiting):
        frames = [read_frame_head(data, int(base[i]), o, made[i], i) for i, w in enumerate(waiting) for o in w]
        waiting = [[] for _ in made]
        channels: list[list[np.ndarray]] = [[] for _ in frames]
        for c in range(max(f.channels for f in frames)):
            own = [j for j, f in enumerate(frames) if c < f.channels]
            side = [frames[j].depth + (frames[j].assignment in (8, 10) and c == 1 or frames[j].assignment == 9 and c == 0) for j in own]
            for j, x in zip(own, decode_subframes(data, raw, next_one, [frames[j] for j in own], side)):
                channels[j].append(x)
        start = np.array([int(base[f.stream]) + f.offset for f in frames])
        end = np.array([(f.bit + 7) // 8 for f in frames])
        stored = raw[end].astype(np.uint16) << np.uint16(8) | raw[end + 1]
        if (wrong := np.flatnonzero(crc16(raw, start, end - start) != stored)).size:
            raise ValueError(f"frame at byte {frames[wrong[0]].offset}: CRC-16 does not match")
        for f, x, e in zip(frames, channels, end.tolist()):
            s = made[f.stream]
            first = s.blocks[-1][0] + len(s.blocks[-1][2]) if s.blocks else 0
            s.blocks.append((first, f.offset, np.stack(_decorrelated(x, f.assignment), axis=1)))
            if not seekable[f.stream] and e + 2 < base[f.stream + 1]:
                waiting[f.stream] = [e + 2 - int(base[f.stream])]
    for s in made:
        if s.samples != sum(len(b[2]) for b in s.blocks):
            raise ValueError("samples are missing")
        if any(s.md5):
            whole = np.concatenate([b[2] for b in s.blocks])
            width = (s.depth + 7) // 8
            packed = whole.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
            if hashlib.md5(packed).digest() != s.md5:
                raise ValueError("MD5 of the samples does not match")
    return made


def _decorrelated(x: list[np.ndarray], assignment: int) -> list[np.ndarray]:
    if assignment == 8:
        return [x[0], x[0] - x[1]]
    if assignment == 9:
        return [x[0] + x[1], x[1]]
    if assignment == 10:
        mid = x[0] << 1 | x[1] & 1
        return [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return x


# ---------------------------------------------------------------- columns


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def pcm(block: np.ndarray) -> bytes:
    """Unsigned 8-bit samples of a block."""
    return (block[:, 0] + 128).astype(np.uint8).tobytes()


def feature_of(samples: np.ndarray) -> str:
    """Level, peak, zero crossings and a coarse histogram of the samples read back."""
    x = samples.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    share = np.bincount((x + 128) >> 5, minlength=8)
    return f"n={len(x)};sum={int(x.sum())};square={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings};bins={','.join(map(str, share.tolist()))}"


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes of the text and its FLAC stream."""

    def kernel(ids, texts):
        return {"doc_id": ids, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "media": encode([payload(t) for t in texts])}

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of (doc_id, media): any block can be read by its first sample or its byte offset."""

    def kernel(ids, streams):
        out = {k: [] for k in ("doc_id", "block", "first_sample", "n_samples", "byte_offset", "pcm")}
        for doc, s in zip(ids, decode(streams)):
            for k, (first, byte, x) in enumerate(s.blocks):
                for name, value in zip(out, (doc, k, first, len(x), byte, x.astype(f"<i{max(1, (s.depth + 7) // 8) if s.depth <= 16 else 4}").tobytes())):
                    out[name].append(value)
        return out

    return map_texts(media, kernel, "doc_id long, block int, first_sample long, n_samples long, byte_offset long, pcm binary", ["doc_id", "media"])


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as FLAC in the shared folder, reads it back block by block, and describes both forms."""

    def kernel(ids, sizes, streams):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks")}
        for m, s in zip(streams, decode(streams)):
            whole = b"".join(pcm(b[2]) for b in s.blocks)
            samples = np.concatenate([b[2][:, 0] for b in s.blocks])
            made = (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples), len(s.blocks))
            for name, value in zip(out, made):
                out[name].append(value)
        return {"doc_id": ids, "n_bytes": sizes} | out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks int"
    return map_texts(written(stored(df, id_col, text_col), "media", "zstd"), kernel, schema, ["doc_id", "n_bytes", "media"])
