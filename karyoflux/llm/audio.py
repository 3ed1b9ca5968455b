"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads to resampled PCM.

A payload is kept as the data of a RIFF/WAVE file with the codec's format tag, 8000 Hz, mono, so nothing is lost, and read back
from the stored bytes. Mu-law and A-law expand by a table of 256 entries. ADPCM blocks are independent of each other, so a
batch's blocks are decoded side by side, one numpy step for each position in the block. The 16-bit samples are resampled to
16000 Hz by a half-band filter and stored as a second WAVE file.

Null counts as an empty text; an empty text gives one block of padding. All sums are of integers, so equal payloads give equal
results in any batch. Payloads of any length are decoded whole, in strides of blocks. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import small_batches

#: Payloads are a positive multiple of so many bytes, which is also the ADPCM block.
BLOCK = 192
RATE, RESAMPLED = 8000, 16000
# WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
# IMA ADPCM index adjustment by code, and step sizes.
INDEX_ADJUST = (-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8)
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
#: Half-band interpolation taps for the odd samples, over 256; they sum to 256.
TAPS = (-3, 17, -58, 172, 172, -58, 17, -3)
#: ADPCM blocks decoded at once: bounds memory to some tens of MB.
STRIDE = 1 << 14


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complement, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132) << (code >> 4 & 7)
    return np.where(code & 0x80, 132 - size, size - 132).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every second bit inverted, exponent 0 is linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()
_STEPS, _ADJUST = np.array(STEPS, np.int32), np.array(INDEX_ADJUST, np.int32)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (n, size): a header of sample and index, then two codes a byte, low one first."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for at in range(size - 4):
        for half in (0, 4):
            code = (data[at] >> half & 15).astype(np.int32)
            step = _STEPS[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + _ADJUST[code], 0, len(STEPS) - 1)
            out[1 + 2 * at + (half >> 2)] = value
    return out.T


def decode_payloads(payloads: list[bytes], codec: int) -> list[np.ndarray]:
    """16-bit samples of each payload."""
    if codec in (MULAW, ALAW):
        table = _MULAW if codec == MULAW else _ALAW
        return [table[np.frombuffer(p, np.uint8)] for p in payloads]
    if codec != IMA_ADPCM:
        raise ValueError(f"codec {codec}")
    counts = [len(p) // BLOCK for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    samples = np.concatenate([adpcm_blocks(rows[i : i + STRIDE]) for i in range(0, len(rows), STRIDE)]) if len(rows) else np.empty((0, 1 + 2 * (BLOCK - 4)), np.int16)
    ends = np.cumsum(counts)
    return [samples[e - c : e].reshape(-1) for e, c in zip(ends, counts, strict=True)]


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and between them the half-band filter's value. The ends are held."""
    if not len(pcm):
        return pcm
    half = len(TAPS) // 2
    wide = np.concatenate([np.repeat(pcm[:1], half - 1), pcm, np.repeat(pcm[-1:], half)]).astype(np.int32)
    between = sum(t * wide[i : i + len(pcm)] for i, t in enumerate(TAPS))
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(between + 128 >> 8, -32768, 32767)
    return out


def wav(data: bytes, codec: int, rate: int) -> bytes:
    """A RIFF/WAVE file around data (of even length, or one byte of padding is added after it)."""
    align, bits, extra = {PCM: (2, 16, b""), IMA_ADPCM: (BLOCK, 4, struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)))}.get(codec, (1, 8, struct.pack("<H", 0)))
    per_second = rate * align // (1 + 2 * (BLOCK - 4)) if codec == IMA_ADPCM else rate * align
    form = struct.pack("<HHIIHH", codec, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, data) of a RIFF/WAVE file, by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            if codec is None or at + 8 + size > len(stored):
                break
            return codec, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no whole data chunk")


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK))


def describe(pcm: np.ndarray) -> str:
    """Samples, mean square, peak and sign changes, from integer sums."""
    wide = pcm.astype(np.int64)
    negative = pcm < 0
    return f"{len(pcm)}:{int(wide @ wide) // max(1, len(pcm))}:{int(np.abs(wide).max(initial=0))}:{int((negative[1:] != negative[:-1]).sum())}"


_FIELDS = "n_bytes: long, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, pcm_sha256: string, feature: string"


def telephone(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), codec: int = MULAW, files: bool = False) -> DataFrame:
    """Stores each text's payload as sound of `codec` and reads it back; features come from all three codecs' readings of it.

    Columns: `keep`, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes), media_bytes,
    media_sha256, pcm_sha256 (of the stored resampled PCM of `codec`) and feature; with files=True also media and pcm, the two
    WAVE files themselves.
    """
    kind = _FIELDS + (", media: binary, pcm: binary" if files else "")

    @F.pandas_udf(f"struct<{kind}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = list(s)
            rows: list[tuple] = []
            for part in _parts(texts):
                rows += _rows(part, codec, files)
            yield pd.DataFrame(rows, columns=[f.split(":")[0].strip() for f in kind.split(",")])

    small_batches(df.sparkSession)
    return df.select(*keep, run(F.col(text)).alias("_sound")).select(*keep, "_sound.*")


def _parts(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about `most` characters, so that a batch of long texts is worked off bit by bit."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _rows(texts: list[str | None], codec: int, files: bool) -> list[tuple]:
    sources = [payload(t) for t in texts]
    media = [wav(p, codec, RATE) for p in sources]
    read = [read_wav(m)[2] for m in media]
    sound = {c: decode_payloads(read, c) for c in (MULAW, ALAW, IMA_ADPCM)}
    out = []
    for i, (t, m, p) in enumerate(zip(texts, media, read, strict=True)):
        resampled = resample(sound[codec][i])
        pcm = wav(resampled.astype("<i2").tobytes(), PCM, RESAMPLED)
        feature = f"resampled={describe(resampled)};" + ";".join(f"{name}={describe(sound[c][i])}" for name, c in (("mulaw", MULAW), ("alaw", ALAW), ("adpcm", IMA_ADPCM)))
        n = len((t or "").encode("utf-8", "surrogatepass"))
        row = (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), hashlib.sha256(pcm).hexdigest(), feature)
        out.append(row + ((m, pcm) if files else ()))
    return out
