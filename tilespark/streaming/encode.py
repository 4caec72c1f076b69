"""Encoding images as they arrive: each micro-batch of pixels is encoded by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import encode_images


def encode_stream(pixels: DataFrame, width: int, height: int, path: str, checkpoint: str, sx: int = 2, sy: int = 2) -> StreamingQuery:
    """Start a query that appends (image_id, hex, batch) to Parquet files below path.

    pixels: a streaming DataFrame whose micro-batches hold whole images. Encoding keeps no state between batches; a
    batch that runs again after a failure overwrites its own folder, so images appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        encode_images(batch, width, height, sx, sy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
