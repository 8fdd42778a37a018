"""Arrow batches cut to a bounded amount of text, so that a batch of long texts needs no more memory than one of short ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters handled at once; a longer text is handled alone.
CHARS = 3_000_000


def parts(batches: Iterator[pd.DataFrame], text: int = 1, chars: int = CHARS) -> Iterator[pd.DataFrame]:
    """The rows of the batches in order, in frames whose texts (column number `text`) have at most `chars` characters."""
    for p in batches:
        start, held = 0, 0
        for i, t in enumerate(p.iloc[:, text]):
            n = len(t) if isinstance(t, str) else 0
            if held and held + n > chars:
                yield p.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(p) or not len(p):
            yield p.iloc[start:]
