"""Arrow batches in pieces of bounded text volume, so that a worker's memory does not follow the length of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters or bytes of text that a kernel works on at once; one longer text is a piece of its own.
PIECE = 2_000_000


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold ``most`` bytes at most (or one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def text_buffer(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts and their offsets; null is empty."""
    c = batch.column(text)
    if c.null_count:
        c = c.fill_null("")
    c = c.cast(pa.large_string())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    body = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]
