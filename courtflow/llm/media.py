"""Media columns: bytes stored losslessly as WebP images of three 8-bit samples a pixel, and read back as pixel arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import vp8l
from .common import in_parts, keyed_text

#: Bytes of a row: 192 pixels of red, green and blue.
WIDTH = 576
FILL = 255


def payload_size(n_bytes: int) -> int:
    return max(WIDTH, -(-n_bytes // WIDTH) * WIDTH)


def padded(data: bytes) -> bytes:
    """data, filled up with bytes 255 to a positive multiple of WIDTH."""
    return data + bytes([FILL]) * (payload_size(len(data)) - len(data))


def store(payload: bytes) -> bytes:
    """A payload as one WebP file of 192 columns; of more where it has over 16,384 such rows, the last one filled up with bytes 255.

    The format's largest image ends at 802 million bytes.
    """
    rows = len(payload) // WIDTH
    across = -(-rows // vp8l.LARGEST_SIDE)
    payload += bytes([FILL]) * (-rows % across * WIDTH)
    samples = np.frombuffer(payload, np.uint8).reshape(-1, across * WIDTH // 3, 3)
    argb = np.full((*samples.shape[:2], 4), 255, np.uint8)
    argb[..., :3] = samples[..., ::-1]
    return vp8l.encode_best(argb.view("<u4")[..., 0])


def load(media: bytes, n_bytes: int) -> np.ndarray:
    """The samples of the stored payload of so many bytes: uint8 (rows, 576)."""
    argb = np.ascontiguousarray(vp8l.decode(media), "<u4")
    samples = argb.view(np.uint8).reshape(-1, 4)[:, 2::-1]
    return np.ascontiguousarray(samples).reshape(-1)[: payload_size(n_bytes)].reshape(-1, WIDTH)


def feature(samples: np.ndarray) -> str:
    """Shape, sum, sum of steps along rows, and counts in 16 equal ranges of brightness."""
    counts = np.bincount(samples.ravel(), minlength=256)
    steps = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum())
    total = int((counts * np.arange(256)).sum())
    return f"{samples.shape[1]}x{samples.shape[0]};sum={total};steps={steps};counts={','.join(map(str, counts.reshape(16, 16).sum(1).tolist()))}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, samples, feature), a row a row of docs.

    media: the stored file. samples: row after row of the pixels that decoding those very bytes gives. A null or empty
    text is one row of filling. Equal texts, repeated rows among them, give equal columns. A text is stored whole, of any length that
    the format takes. Only id and text are read, so no other column can clash; an empty table gives an empty one.
    """
    given = keyed_text(docs, id_col, text_col)
    given = given.select("doc_id", given["text"].cast("binary").alias("text"))
    schema = StructType.fromDDL(f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary, samples binary, feature string")

    def run(batches):
        for batch in in_parts(batches, 1):
            texts = batch.column(1).to_pylist()
            media = [store(padded(t)) for t in texts]
            pixels = [load(m, len(t)) for m, t in zip(media, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array(map(feature, pixels), pa.string())],
                schema.fieldNames(),
            )

    return given.mapInArrow(run, schema)
