"""Stream filters: Flate and ASCIIHex, with PNG and TIFF predictors."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .objects import PdfError


def inflate(data: bytes) -> bytes:
    """zlib, else raw deflate, else as much as can be had."""
    best = b""
    for window in (15, -15):
        engine, out = zlib.decompressobj(window), b""
        try:
            out = engine.decompress(data) + engine.flush()
            if engine.eof or out:
                return out
        except zlib.error:
            engine, parts = zlib.decompressobj(window), []
            try:
                for at in range(0, len(data), 64):
                    parts.append(engine.decompress(data[at : at + 64]))
            except zlib.error:
                pass
            out = b"".join(parts)
        best = max(best, out, key=len)
    if not best and data:
        raise PdfError("BadStream", "no deflate data")
    return best


def unhex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def predict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8 or not width:
            return data
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out, above = [], np.zeros(width, np.int64)
    for at in range(0, len(data), width + 1):
        line = np.frombuffer(data[at + 1 : at + 1 + width], np.uint8).astype(np.int64)
        line = np.pad(line, (0, width - len(line)))
        mode = data[at]
        if mode == 2:
            line = (line + above) & 255
        elif mode == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif mode in (3, 4):
            row, up = line.tolist(), above.tolist()
            for i in range(width):
                a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if mode == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (row[i] + guess) & 255
            line = np.array(row, np.int64)
        out.append(line.astype(np.uint8).tobytes())
        above = line
    return b"".join(out)


def decode(data: bytes, filters, parms) -> bytes:
    names = filters if isinstance(filters, list) else [filters] if filters else []
    parms = parms if isinstance(parms, list) else [parms]
    for k, name in enumerate(names):
        own = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        if name in ("FlateDecode", "Fl"):
            data = predict(inflate(data), own)
        elif name in ("ASCIIHexDecode", "AHx"):
            data = unhex(data)
        else:
            raise PdfError("UnsupportedFilter", str(name))
    return data
