"""Operator 6: media columns - progressive JPEGs decoded to full-resolution RGB tensors.

A column of JPEG bytes becomes columns height, width, channels and rgb, the tensor's bytes in row-major order.  Images are decoded where
they lie, an Arrow batch at a time; nothing is shuffled.  See jpeg.py for the decoder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm import jpeg
from heliograph.llm.common import lean, light_batches, table

#: Bytes of tensors that leave a task at once; one larger tensor leaves alone.
AT_ONCE = 16 << 20

_ADDED = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("rgb", T.BinaryType())]


def decode_column(df: DataFrame, column: str = "jpeg", most_pixels: int = jpeg.MOST_PIXELS) -> DataFrame:
    """df with columns height, width, channels (ints) and rgb (binary), replacing any of these names; `column` is dropped.

    A null, empty, broken or unsupported image gives nulls, as does one of more than most_pixels, by default those of the largest tensor that a
    binary value can hold; one cut short decodes as far as it goes, the rest is grey.  Rows, repeated ones too, stay in number and order.
    """
    light_batches(df.sparkSession)
    base = df.drop("height", "width", "channels", "rgb")
    at = base.columns.index(column)
    kept = [f for f in base.schema if f.name != column]
    schema = T.StructType([*kept, *_ADDED])

    def run(batches):
        for batch in batches:
            lo, shapes, tensors, held = 0, [], [], 0
            for hi, x in enumerate(batch.column(at), 1):
                try:
                    rgb = jpeg.decode(x.as_py() or b"", most_pixels)
                    shapes.append(rgb.shape)
                    tensors.append(rgb.tobytes())
                    held += rgb.nbytes
                except jpeg.BadJpeg:
                    shapes.append((None, None, None))
                    tensors.append(None)
                if held < AT_ONCE and hi - lo < 256 and hi < batch.num_rows:
                    continue
                part = batch.slice(lo, hi - lo)
                added = [pa.array([s[i] for s in shapes], pa.int32()) for i in range(3)] + [pa.array(tensors, pa.binary())]
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at] + added, schema.names)
                lo, shapes, tensors, held = hi, [], [], 0

    return base.mapInArrow(lean(run), schema)


def tensor(height: int, width: int, channels: int, rgb: bytes) -> np.ndarray:
    """The numpy tensor of a row that decode_column made."""
    return np.frombuffer(rgb, np.uint8).reshape(height, width, channels)


def picture(vector: np.ndarray, side: int = 20) -> np.ndarray:
    """A side x side RGB picture of an embedding: its values, as a square of grey and its halves of colour, enlarged."""
    v = np.nan_to_num(np.asarray(vector, float), posinf=0.0, neginf=0.0)
    n = max(1, int(np.ceil(np.sqrt(max(len(v), 1)))))
    square = np.zeros(n * n)
    square[: len(v)] = v
    scale = np.abs(square).max() or 1.0
    square = (square / scale * 110 + 128).reshape(n, n)
    at = np.arange(side) * n // side
    red, blue = square[at[:, None], at], square.T[at[:, None], at]
    return np.clip(np.rint(np.stack([red, (red + blue) / 2, blue], 2)), 0, 255).astype(np.uint8)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, jpeg): a progressive JPEG of each embedding - the test tables have no media column of their own. Null for null."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [None if x is None else jpeg.encode(picture(np.array([y or 0.0 for y in x]))) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["vec_id", "jpeg"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lean(run), "vec_id long, jpeg binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(pictures(table(spark, sf_dir, "embeddings")))
