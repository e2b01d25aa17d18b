"""A small test tree and image headers."""

from __future__ import annotations

import os
import struct
import zlib


def png(width: int, height: int, color: int = 2, transparent: bool = False) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
    if color == 3:
        body += chunk(b"PLTE", b"\0" * 6)
        if transparent:
            body += chunk(b"tRNS", b"\0")
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def jpeg(width: int, height: int, channels: int = 3) -> bytes:
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10
    table = b"\xff\xff\xdb" + struct.pack(">H", 5) + b"\xff\xc0\x01"
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * channels, 8, height, width, channels)
    return b"\xff\xd8" + app + table + frame + b"\0" * (3 * channels) + b"\xff\xd9"


def _image(spec: str, descriptor: str, version: str, rest: str) -> str:
    return f"p-film12_s-{spec}_d-{descriptor}_v{version}{rest}"


def _folder(spec: str, descriptor: str, version: str) -> str:
    return f"film12/{spec}/{descriptor}/" + _image(spec, descriptor, version, "")


def _tree():
    """Directory, file name, is the row valid, text expected in its file error."""
    whole = _folder("spec001", "harbor", "001")
    for frame in (10, 11, 12, 13):
        yield whole, _image("spec001", "harbor", "001", f"_c0000-0002_f00{frame}.png"), True, None
    grid = _folder("spec001", "harbor", "002")
    for place in ("0000-0001", "0001-0001"):
        for frame in (7, 8, 9):
            yield grid, _image("spec001", "harbor", "002", f"_c{place}_f000{frame}.png"), True, None
    # one asset with every kind of wrong neighbour
    mixed = _folder("spec001", "harbor", "004")
    end = "_c0000-0002_f0021.png"
    yield mixed, _image("spec001", "bridge", "004", end), False, "Invalid asset directory name"
    yield mixed, _image("spec001", "harbor", "004", "_c0000-0002_f0022.png"), False, None
    yield mixed, _image("spec001", "HARBOR", "004", end), False, "Illegal descriptor field token"
    yield mixed, _image("spec001", "harbor", "004", "_c0000-0002_f0023.png"), False, None
    yield mixed, _image("spec0001", "harbor", "004", end), False, "Specification not found"
    yield mixed, "notes.txt", False, "Specification not found"
    plain = _folder("spec002", "meadow", "003")
    for frame in range(5):
        yield plain, _image("spec002", "meadow", "003", f"_f010{frame}.jpg"), True, None
    broken = _folder("spec002", "meadow", "005")
    yield broken, _image("spec002", "meadow", "003", "_f0001.jpg"), False, "Invalid asset directory name"
    yield broken, _image("spec002", "meadow", "005", "_f0002.jpg"), False, None
    yield broken, _image("spec002", "meadow", "005", ""), False, "Expected '_'"
    yield broken, _image("spec002", "meadow", "05", "_f0003.jpg"), False, "Illegal version field token"
    yield "film07/vdb001", "p-film07_s-vdb001_d-cloud_v001.vdb", False, "Specification not found"


FILES: list[tuple[str, str, bool, str | None]] = list(_tree())


def make_tree(root: str) -> None:
    for folder, name, _, _ in FILES:
        path = os.path.join(root, folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data = b""
        if name.endswith(".png"):
            data = png(4, 5)
        elif name.endswith(".jpg"):
            data = jpeg(4, 5)
        with open(path, "wb") as f:
            f.write(data)
