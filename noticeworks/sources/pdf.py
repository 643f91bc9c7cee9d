"""PDF text through an extractor given by the caller; none is bundled.

An extractor takes bytes and returns text, or raises; a table of extractors is
tried in order, and a file that none can read has null text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"%PDF"


def extracted(files: DataFrame, extractors: Sequence[Callable[[bytes], str]]) -> DataFrame:
    """(path, text, status) of (path, content): 'ok', 'not-pdf' or 'failed'."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                text, status = None, "failed"
                if content is None or bytes(content[:4]) != MAGIC:
                    status = "not-pdf"
                else:
                    for extract in extractors:
                        try:
                            text = extract(bytes(content))
                        except Exception:  # noqa: BLE001, S112 - the next extractor may read it
                            continue
                        if text and text.strip():
                            status = "ok"
                            break
                        text = None
                rows.append((path, text, status))
            yield pd.DataFrame(rows, columns=["path", "text", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, status string")
