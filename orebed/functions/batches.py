"""Decoded rows gathered into frames of bounded size: a frame for each file would cost more than decoding it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

MAX_ROWS, MAX_BYTES = 1024, 16 << 20


def decoded_frames(batches: Iterator[pd.DataFrame], decode: Callable[[str, bytes], list[tuple]], columns: list[str], kinds: dict[str, str]) -> Iterator[pd.DataFrame]:
    """The rows that decode gives for each file (path, content). A frame ends once it has MAX_ROWS rows or MAX_BYTES bytes."""
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            found = decode(path, bytes(content))
            rows += found
            held += len(content) + sum(len(v) for row in found for v in row if isinstance(v, bytes))
            if len(rows) >= MAX_ROWS or held >= MAX_BYTES:
                yield pd.DataFrame(rows, columns=columns).astype(kinds)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns).astype(kinds)
