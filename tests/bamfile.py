"""Writes SAM lines as a BAM file, in blocks of any size, for tests."""

import re
import struct
import zlib


def _block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, lines, block=65_000):
    """``lines`` of a SAM text; records go over block borders wherever a block is full."""
    heads = [x for x in lines if x.startswith("@")]
    names = [(re.search("SN:([^\t]+)", x)[1], int(re.search("LN:([0-9]+)", x)[1])) for x in heads if x.startswith("@SQ")]
    text = "\n".join(heads).encode() + b"\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    out += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in names)
    number = {n: i for i, (n, _) in enumerate(names)} | {"*": -1}
    for line in lines:
        if line.startswith("@"):
            continue
        f = line.split("\t")
        ops = [(int(n) << 4) | "MIDNSHP=X".index(o) for n, o in re.findall("([0-9]+)([MIDNSHP=X])", f[5])]
        seq = "" if f[9] == "*" else f[9]
        tags = b""
        if len(ops) > 65_535:
            tags = b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
            ops = [(len(seq) << 4) | 4, (1 << 4) | 3]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes((a << 4) | b for a, b in zip(codes[: len(seq) : 2], codes[1 : len(seq) + 1 : 2]))
        body = struct.pack("<iiBBHHHiiii", number[f[2]], int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, len(ops), int(f[1]), len(seq), -1, -1, 0)
        body += f[0].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq) + tags
        out += struct.pack("<i", len(body)) + body
    with open(path, "wb") as f:
        for i in range(0, len(out), block):
            f.write(_block(out[i : i + block]))
        f.write(_block(b""))
    return str(path)
