"""Media columns: texts stored as progressive JPEG files and read back, with RGB tensors.

A payload (the UTF-8 bytes, then zeros up to a positive multiple of 64) is stored in the coefficients
of the file's blocks, 64 bytes to a block: a byte b is the coefficient ``b - OFFSET`` and no quantiser
scales it, so the entropy-coded scans keep every bit. Units of four Y blocks, Cb and Cr take six
blocks at a time; blocks beyond the payload are zero. The payload's length stands in a comment.

Reading accumulates the scans into coefficients, from which come the payload, and by inverse
transform and upsampled chroma the RGB tensor.

Edge cases: null and empty texts give 64 zero bytes; equal texts give equal files and features; a
text alone in a batch is handled whole, whatever its length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .textkernel import chunks

#: Near the middle of common text bytes, so that most coefficients are small.
OFFSET = 104
BATCH_BYTES = 1 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload."""
    units, dims, notes = [], [], []
    for p in payloads:
        m = -(-len(p) // 384)
        wide = math.isqrt(m - 1) + 1
        high = -(-m // wide)
        blocks = np.zeros((wide * high * 6, 64), dtype=np.int16)
        blocks.reshape(-1)[: len(p)] = np.frombuffer(p, dtype=np.uint8)
        blocks.reshape(-1)[: len(p)] -= OFFSET
        units.append(blocks)
        dims.append((wide, high))
        notes.append(struct.pack(">Q", len(p)))
    return jpeg.encode(units, dims, notes) if payloads else []


def decode(files: Sequence[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """The payload and the RGB tensor of each file."""
    if not files:
        return []
    images, coefs = jpeg.decode(list(files))
    blocks = jpeg.samples(images, coefs)
    out = []
    for image in images:
        (size,) = struct.unpack(">Q", image.note)
        wide, high = image.width // 16, image.height // 16
        first = image.grids[0][0]
        own = coefs[first + jpeg.unit_order(wide, high)].reshape(-1)[:size] + OFFSET
        out.append((own.astype(np.uint8).tobytes(), jpeg.rgb(image, blocks)))
    return out


def feature_of(tensor: np.ndarray) -> str:
    """Size, sums of red, green and blue, and a checksum of a tensor."""
    red, green, blue = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{red}:{green}:{blue}:{zlib.crc32(tensor.tobytes()):08x}"


def store(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (text): the columns ``carry``, n_bytes and media (a file)."""
    carry = [c for c in carry if c not in ("n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", BATCH_BYTES):
                made = [payload_of(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for _, n in made], pa.int64()), pa.array(encode([p for p, _ in made]), pa.binary())], [*carry, "n_bytes", "media"])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)


_READ = (("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType()))
_TENSOR = (("payload", pa.binary(), T.BinaryType()), ("height", pa.int64(), T.LongType()), ("width", pa.int64(), T.LongType()), ("rgb", pa.binary(), T.BinaryType()))


def read(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Per row of ``media``: its other columns and what the stored bytes say, which replaces any of the same name.

    With ``tensors``: payload, height, width and rgb (row by row, three bytes a pixel); else digests.
    """
    columns = _TENSOR if tensors else _READ
    others = [c for c in media.columns if c not in ("media", *(n for n, _, _ in columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(files):
                to, size = at + 1, len(files[at])
                while to < len(files) and size + len(files[to]) <= BATCH_BYTES:
                    size += len(files[to])
                    to += 1
                rows = []
                for data, (payload, tensor) in zip(files[at:to], decode(files[at:to]), strict=True):
                    if tensors:
                        rows.append((payload, tensor.shape[0], tensor.shape[1], tensor.tobytes()))
                    else:
                        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(tensor)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[:-1], *(pa.array(v, t) for v, (_, t, _) in zip(zip(*rows, strict=True), columns, strict=True))], [*others, *(n for n, _, _ in columns)])
                at = to

    schema = T.StructType([*(media.schema[c] for c in others), *(T.StructField(n, t) for n, _, t in columns)])
    return media.select(*others, "media").mapInArrow(run, schema)
