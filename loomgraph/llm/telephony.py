"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads in WAVE form, decoded to PCM and resampled.

``encode_audio`` wraps payload bytes as coded samples of one of three codecs and so keeps them losslessly: mu-law and A-law
take a byte a sample, IMA ADPCM takes blocks of 64 bytes (a 4-byte header, then 120 four-bit steps). ``decode_audio`` reads
the stored form back, expands mu-law and A-law by lookup tables, decodes all ADPCM blocks of a batch side by side with
numpy (one step for all blocks at a time, as each step needs the one before in its own block only), resamples 8 kHz to
16 kHz by linear interpolation, and describes the signal. ``store_pcm`` writes the resampled PCM as a table.

Codecs go by the payload's checksum in the registered query, so equal texts have equal stored forms.

Defined cases: null and empty texts have a payload of 64 zero bytes; payloads are of any length; repeated rows and null ids
are kept; an ADPCM header's step index over 88 is taken as 88; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8

UNIT, RATE = 64, 8000
#: WAVE format tags: fixed values.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
# IMA ADPCM's index adjustments: fixed values.
INDEX_ADJUST = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# IMA ADPCM's step sizes: fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte (G.711)."""
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte (G.711)."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, size = ((code >> 4) & 7).astype(np.int32), ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, ``(n, bytes)`` to ``(n, 2 * bytes - 7)``; all blocks step together."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), 88)
    body = blocks[:, 4:].T
    out = np.empty((2 * body.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * body.shape[0]):
        nibble = ((body[k // 2] >> (4 * (k & 1))) & 15).astype(np.int32)
        step, size = STEPS[index], nibble & 7
        diff = ((2 * size + 1) * step) >> 3
        value = np.clip(np.where(nibble & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_ADJUST[size], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str) -> bytes:
    """The payload as the data of a WAVE file of the codec."""
    import struct

    block, bits = (UNIT, 4) if codec == "adpcm" else (1, 8)
    per_block = 2 * UNIT - 7
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else struct.pack("<H", 0)
    rate = RATE * UNIT // per_block if codec == "adpcm" else RATE
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, block, bits) + extra
    samples = len(payload) // UNIT * per_block if codec == "adpcm" else len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body


def unwav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAVE file."""
    import struct

    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            return next(k for k, v in TAGS.items() if v == tag), media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean with the next one (the last repeats)."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\0" * ((-len(data)) % unit if data else unit)


def pcm_of(batch: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """Resampled PCM of stored forms read back; the ADPCM blocks of the whole batch are decoded side by side."""
    mulaw, alaw = mulaw_table(), alaw_table()
    held = [p for c, p in batch if c == "adpcm"]
    flat = decode_adpcm(np.frombuffer(b"".join(held), np.uint8).reshape(-1, UNIT)).reshape(-1) if held else None
    at, out = 0, []
    for codec, payload in batch:
        if codec == "adpcm":
            n = len(payload) // UNIT * (2 * UNIT - 7)
            out.append(resample(flat[at : at + n]))
            at += n
        else:
            out.append(resample((mulaw if codec == "mulaw" else alaw)[np.frombuffer(payload, np.uint8)]))
    return out


def describe(pcm: np.ndarray) -> str:
    """Mean, root mean square, peak and zero crossings of PCM."""
    x = pcm.astype(np.float64)
    cross = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};mean={x.mean():.3f};rms={np.sqrt(np.dot(x, x) / len(x)):.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};zero={cross}"


def chunks(sizes: list[int], most: int = 4 << 20):
    """Ranges of rows of at most so many bytes, or one row."""
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_audio(docs: DataFrame, codec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: whole texts as WAVE files; without a codec the payload's checksum takes one of the three."""

    def run(batches):
        import zlib

        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for b in batches:
            for lo, hi in chunks(pa.compute.binary_length(b.column(1)).to_pylist()):
                data = b.column(1)[lo:hi].to_pylist()
                forms = []
                for d in data:
                    p = padded(d)
                    forms.append(wav(p, codec or ("mulaw", "alaw", "adpcm")[zlib.crc32(p) % 3]))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(d) for d in data], pa.int64()), pa.array(forms, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("payload")).mapInArrow(run, "id bigint, n_bytes bigint, media binary")


def decode_audio(media: DataFrame, with_pcm: bool = False) -> DataFrame:
    """``id, n_bytes, codec``, digests of the payload and the stored form, and the signal's description, from stored forms."""
    names = ["id", "n_bytes", "codec", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"] * with_pcm

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for b in batches:
            for lo, hi in chunks(pa.compute.binary_length(b.column(2)).to_pylist()):
                forms = b.column(2)[lo:hi].to_pylist()
                read = [unwav(m) for m in forms]
                pcm = pcm_of(read)
                cols = [
                    b.column(0)[lo:hi],
                    b.column(1)[lo:hi],
                    pa.array([c for c, _ in read], pa.string()),
                    pa.array([len(p) for _, p in read], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for _, p in read], pa.string()),
                    pa.array([zlib.crc32(p[-UNIT:]) for _, p in read], pa.int64()),
                    pa.array([len(m) for m in forms], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in forms], pa.string()),
                    pa.array([f"{c};{describe(x)}" for (c, _), x in zip(read, pcm)], pa.string()),
                ] + [pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary())] * with_pcm
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = "bigint bigint string bigint string bigint bigint string string binary".split()
    return media.select("id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def store_pcm(media: DataFrame, path: str) -> None:
    """Write ``id, codec, pcm`` (16-bit little-endian, 16 kHz) as Parquet."""
    decode_audio(media, with_pcm=True).select("id", "codec", "pcm").write.parquet(path)


def op3_telephony_audio(spark, sf_dir):
    return decode_audio(encode_audio(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
