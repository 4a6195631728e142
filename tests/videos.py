"""Small video files for tests: frames are any bytes."""

import struct


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4(frames, scale=600, step=20, keys=None, per_chunk=3, late=None, tail=True, wide=False, same=False):
    """Index after the data (``tail``) or before it; 64-bit chunk places if ``wide``; one size for all if ``same``."""
    n = len(frames)
    chunks = [frames[i : i + per_chunk] for i in range(0, n, per_chunk)]

    def movie(start):
        places, at = [], start
        for c in chunks:
            places.append(at)
            at += sum(map(len, c)) + 5  # a gap after each chunk
        full = lambda body: bytes(4) + body
        stsc = [(1, per_chunk, 1)] + ([(len(chunks), n % per_chunk, 1)] if n % per_chunk and len(chunks) > 1 else [])
        if len(chunks) == 1:
            stsc = [(1, n, 1)]
        parts = box(b"stts", full(struct.pack(">III", 1, n, step)))
        if late:
            parts += box(b"ctts", full(struct.pack(">I", n) + b"".join(struct.pack(">II", 1, x) for x in late)))
        if keys is not None:
            parts += box(b"stss", full(struct.pack(f">I{len(keys)}I", len(keys), *(k + 1 for k in keys))))
        parts += box(b"stsc", full(struct.pack(">I", len(stsc)) + b"".join(struct.pack(">III", *x) for x in stsc)))
        parts += box(b"stsz", full(struct.pack(">II", len(frames[0]) if same else 0, n) + (b"" if same else struct.pack(f">{n}I", *map(len, frames)))))
        parts += box(b"co64" if wide else b"stco", full(struct.pack(f">I{len(places)}{'Q' if wide else 'I'}", len(places), *places)))
        head = box(b"mdhd", full(struct.pack(">IIIII", 0, 0, scale, n * step, 0)))
        track = lambda kind, tables: box(b"trak", box(b"mdia", head + box(b"hdlr", full(bytes(4) + kind + bytes(13))) + box(b"minf", box(b"stbl", tables))))
        return box(b"moov", box(b"mvhd", bytes(20)) + track(b"soun", b"") + track(b"vide", parts))

    data = b"".join(b"".join(c) + bytes(5) for c in chunks)
    start = box(b"ftyp", b"isom")
    if tail:
        media = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data  # a long header
        return start + media + movie(len(start) + 16)
    size = len(movie(0))
    return start + movie(len(start) + size + 8) + box(b"mdat", data)


def avi(frames, micros=40_000, keys=(0,), absolute=False):
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<I", micros) + bytes(52)))
    body, index, base = b"movi", b"", 12 + len(head) + 8
    for i, x in enumerate(frames):
        place = len(body) + (base if absolute else 0)
        index += struct.pack("<4sIII", b"01wb", 0, place, 2) if i % 2 else b""
        body += chunk(b"01wb", b"zz") if i % 2 else b""
        place = len(body) + (base if absolute else 0)
        index += struct.pack("<4sIII", b"00dc", 0x10 if i in keys else 0, place, len(x))
        body += chunk(b"00dc", x)
    whole = b"AVI " + head + chunk(b"LIST", body) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(whole)) + whole
