"""Binary formats as plain functions on bytes and numpy arrays: PNG, PGM/PPM, PFM, Radiance HDR, GIF, flow and PLY."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_chunks(data: bytes):
    at = len(PNG_MAGIC)
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def encode_png(img: np.ndarray) -> bytes:
    """8-bit gray (h, w), gray-alpha (h, w, 2), RGB (h, w, 3) or RGBA (h, w, 4)."""
    a = np.ascontiguousarray(img, dtype=np.uint8)
    h, w = a.shape[:2]
    channels = 1 if a.ndim == 2 else a.shape[2]
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    out = np.zeros((h, stride), dtype=np.uint8)
    up = np.zeros(stride, dtype=np.uint8)
    for y in range(h):
        f = raw[y * (stride + 1)]
        line = np.frombuffer(raw, dtype=np.uint8, count=stride, offset=y * (stride + 1) + 1).copy()
        if f == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint64).astype(np.uint8)
        elif f == 2:
            line = line + up
        elif f in (3, 4):
            cur, prev = line.tolist(), up.tolist()
            for i in range(stride):
                a = cur[i - bpp] if i >= bpp else 0
                b, c = prev[i], prev[i - bpp] if i >= bpp else 0
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (cur[i] + guess) & 255
            line = np.array(cur, dtype=np.uint8)
        elif f:
            raise ValueError(f"unknown PNG filter {f}")
        out[y] = up = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, channels) of 8 bits; palettes become RGB, 16 bits keep the high byte. No interlacing."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    idat, palette, head = b"", None, None
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
    w, h, depth, color, _, _, interlace = head
    if interlace:
        raise ValueError("interlaced PNG is not supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = (w * channels * depth + 7) // 8
    lines = _unfilter(zlib.decompress(idat), h, stride, max(1, channels * depth // 8))
    if depth == 16:
        a = lines.reshape(h, w * channels, 2)[:, :, 0]
    elif depth == 8:
        a = lines
    else:
        bits = np.unpackbits(lines, axis=1)[:, : stride * 8].reshape(h, -1, depth)
        a = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : w * channels]
        a = a if color == 3 else a * 255 // ((1 << depth) - 1)
    a = np.asarray(a, dtype=np.uint8)[:, : w * channels].reshape(h, w, channels)
    if color == 3:
        return palette[a[:, :, 0]]
    return a[:, :, 0] if channels == 1 else a


def encode_pnm(img: np.ndarray) -> bytes:
    a = np.ascontiguousarray(img, dtype=np.uint8)
    return f"P{5 if a.ndim == 2 else 6}\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.tobytes()


def _header(data: bytes, n: int) -> tuple[list[bytes], int]:
    """The first n white-space separated fields, comments left out, and where the data after them starts."""
    out, at = [], 0
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        out.append(data[at:end])
        at = end
    return out, at + 1


def decode_pnm(data: bytes) -> np.ndarray:
    (kind, w, h, top), at = _header(data, 4)
    if kind not in (b"P5", b"P6") or int(top) > 255:
        raise ValueError("only 8-bit binary PGM and PPM are read")
    shape = (int(h), int(w)) if kind == b"P5" else (int(h), int(w), 3)
    return np.frombuffer(data, dtype=np.uint8, count=int(np.prod(shape)), offset=at).reshape(shape)


def encode_pfm(img: np.ndarray) -> bytes:
    """32-bit floats, little-endian, bottom row first."""
    a = np.ascontiguousarray(np.asarray(img, dtype="<f4")[::-1])
    return f"{'Pf' if a.ndim == 2 else 'PF'}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + a.tobytes()


def decode_pfm(data: bytes) -> np.ndarray:
    (kind, w, h, scale), at = _header(data, 4)
    shape = (int(h), int(w)) if kind == b"Pf" else (int(h), int(w), 3)
    a = np.frombuffer(data, dtype="<f4" if float(scale) < 0 else ">f4", count=int(np.prod(shape)), offset=at)
    return a.reshape(shape)[::-1].astype(np.float64) * abs(float(scale))


FLOW_MAGIC = 202021.25


def encode_flow(u: np.ndarray, v: np.ndarray) -> bytes:
    uv = np.stack([u, v], axis=-1).astype("<f4")
    return struct.pack("<fii", FLOW_MAGIC, u.shape[1], u.shape[0]) + uv.tobytes()


def decode_flow(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    magic, w, h = struct.unpack("<fii", data[:12])
    if magic != FLOW_MAGIC:
        raise ValueError("not a flow file")
    uv = np.frombuffer(data, dtype="<f4", count=2 * w * h, offset=12).reshape(h, w, 2)
    return uv[..., 0], uv[..., 1]


def encode_hdr(img: np.ndarray) -> bytes:
    """Radiance RGBE without run lengths."""
    a = np.asarray(img, dtype=np.float64)
    top = a.max(axis=2)
    e = np.where(top > 1e-32, np.ceil(np.log2(np.maximum(top, 1e-38))) + (np.log2(np.maximum(top, 1e-38)) % 1 == 0), 0)
    scale = np.where(top > 1e-32, 256.0 / np.exp2(e), 0)
    rgbe = np.concatenate([np.clip(np.floor(a * scale[..., None]), 0, 255), np.where(top > 1e-32, e + 128, 0)[..., None]], axis=2).astype(np.uint8)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {a.shape[0]} +X {a.shape[1]}\n".encode() + rgbe.tobytes()


def decode_hdr(data: bytes) -> np.ndarray:
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    _, h, _, w = data[at:end].split()
    h, w, at = int(h), int(w), end + 1
    if w >= 8 and data[at : at + 2] == b"\2\2":
        lines = np.zeros((h, 4, w), dtype=np.uint8)
        for y in range(h):
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    n = data[at]
                    if n > 128:
                        lines[y, c, x : x + n - 128] = data[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        lines[y, c, x : x + n] = np.frombuffer(data, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        rgbe = lines.transpose(0, 2, 1)
    else:
        rgbe = np.frombuffer(data, np.uint8, h * w * 4, at).reshape(h, w, 4)
    e = rgbe[..., 3].astype(np.float64)
    return np.where(e[..., None] > 0, (rgbe[..., :3] + 0.5) * np.exp2(e - 136)[..., None], 0.0)


def _lzw_encode(values: np.ndarray, bits: int) -> bytes:
    """GIF's variable-width LZW."""
    clear, end = 1 << bits, (1 << bits) + 1
    out, acc, n = bytearray(), 0, 0
    table, width = {}, bits + 1

    def put(code: int) -> None:
        nonlocal acc, n
        acc |= code << n
        n += width
        while n >= 8:
            out.append(acc & 255)
            acc >>= 8
            n -= 8

    put(clear)
    word, nxt = None, end + 1  # the code of the run so far
    for v in values.tolist():
        if word is None:
            word = v
        elif (word, v) in table:
            word = table[word, v]
        else:
            put(word)
            if nxt < 4096:
                table[word, v] = nxt
                if nxt == 1 << width and width < 12:
                    width += 1
                nxt += 1
            else:
                put(clear)
                table, width, nxt = {}, bits + 1, end + 1
            word = v
    if word is not None:
        put(word)
    put(end)
    if n:
        out.append(acc & 255)
    return bytes(out)


def _lzw_decode(data: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, out, prev = list(base), bits + 1, [], None
    acc = n = 0
    for byte in data:
        acc |= byte << n
        n += 8
        while n >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            n -= width
            if code == clear:
                table, width, prev = list(base), bits + 1, None
                continue
            if code == end:
                return b"".join(out)
            if prev is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                if len(table) < 4096:
                    table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
            if len(table) == 1 << width and width < 12:
                width += 1
    return b"".join(out)


def web_palette() -> np.ndarray:
    """The 216 web-safe colours, padded with black to 256."""
    steps = np.array([0, 51, 102, 153, 204, 255])
    grid = np.stack(np.meshgrid(steps, steps, steps, indexing="ij"), axis=-1).reshape(-1, 3)
    return np.concatenate([grid, np.zeros((40, 3), dtype=int)]).astype(np.uint8)


def encode_gif(frames: list[np.ndarray], delays: list[int], palette: np.ndarray | None = None) -> bytes:
    """An animation of RGB or gray frames of one size; colours go to the nearest of the palette. Delays in 1/100 s."""
    pal = web_palette() if palette is None else np.asarray(palette, dtype=np.uint8)
    h, w = frames[0].shape[:2]
    bits = max(2, int(len(pal) - 1).bit_length())
    full = np.zeros((1 << bits, 3), dtype=np.uint8)
    full[: len(pal)] = pal
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | (bits - 1) << 4 | (bits - 1), 0, 0) + full.tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for f, d in zip(frames, delays, strict=True):
        rgb = np.repeat(f[..., None], 3, axis=2) if f.ndim == 2 else f
        flat = rgb.reshape(-1, 3).astype(np.int64)
        colours, back = np.unique(flat, axis=0, return_inverse=True)
        near = ((colours[:, None] - pal[None].astype(np.int64)) ** 2).sum(-1).argmin(1)
        data = _lzw_encode(near[back.ravel()], bits)
        blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
        out += b"\x21\xf9\x04\x04" + struct.pack("<H", d) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + blocks + b"\0"
    return out + b"\x3b"


def decode_gif(data: bytes) -> list[tuple[np.ndarray, int]]:
    """(RGB frame, delay in 1/100 s) of every frame, composed with the disposal methods."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, pal = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        pal = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas, frames, delay, clear, dispose = np.zeros((h, w, 3), dtype=np.uint8), [], 0, None, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label, at = data[at + 1], at + 2
            if label == 0xF9:
                f = data[at + 1]
                dispose, delay, clear = f >> 2 & 7, struct.unpack("<H", data[at + 2 : at + 4])[0], data[at + 4] if f & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, fw, fh, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        local = pal
        if f & 0x80:
            n = 2 << (f & 7)
            local = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits, at, raw = data[at], at + 1, b""
        while data[at]:
            raw += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        idx = np.frombuffer(_lzw_decode(raw, bits)[: fw * fh], np.uint8).reshape(fh, fw)
        if f & 0x40:
            order = np.concatenate([np.arange(s, fh, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(idx)
            straight[order] = idx
            idx = straight
        before = canvas.copy()
        view = canvas[y : y + fh, x : x + fw]
        shown = idx != clear if clear is not None else np.ones(idx.shape, dtype=bool)
        view[shown] = local[idx[shown]]
        frames.append((canvas.copy(), delay))
        if dispose == 2:
            canvas[y : y + fh, x : x + fw] = 0
        elif dispose == 3:
            canvas = before
        delay, clear, dispose = 0, None, 0
    return frames


def encode_ply(points: np.ndarray, normals: np.ndarray | None = None, binary: bool = False) -> bytes:
    cols = points if normals is None else np.concatenate([points, normals], axis=1)
    names = ["x", "y", "z", "nx", "ny", "nz"][: cols.shape[1]]
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex {len(cols)}\n" + "".join(f"property double {n}\n" for n in names) + "end_header\n"
    body = cols.astype("<f8").tobytes() if binary else "".join(" ".join(repr(float(v)) for v in r) + "\n" for r in cols).encode()
    return head.encode() + body


def decode_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertex properties by name."""
    at = data.index(b"end_header\n") + len(b"end_header\n")
    kind, n, props, vertex = "", 0, [], False
    for line in data[:at].decode("ascii").splitlines():
        f = line.split()
        if f[:1] == ["format"]:
            kind = f[1]
        elif f[:1] == ["element"]:
            vertex = f[1] == "vertex"
            n = int(f[2]) if vertex else n
        elif f[:1] == ["property"] and vertex:
            props.append((f[2], {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "int": "i4", "int32": "i4", "short": "i2", "ushort": "u2", "uint": "u4", "char": "i1"}[f[1]]))
    if kind == "ascii":
        rows = np.array([[float(v) for v in x.split()[: len(props)]] for x in data[at:].decode("ascii").splitlines()[:n]]).reshape(n, len(props))
        return {p: rows[:, i] for i, (p, _) in enumerate(props)}
    order = "<" if kind == "binary_little_endian" else ">"
    rec = np.frombuffer(data, dtype=np.dtype([(p, order + t) for p, t in props]), count=n, offset=at)
    return {p: rec[p].astype(np.float64) for p, _ in props}
