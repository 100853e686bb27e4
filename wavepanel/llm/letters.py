"""Letter sequences of texts as arrays of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wavepanel.llm.bpe import _classes


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, every run of other signs as one 0, a 0 before and after each text.

    Returns the stream and the text of each place.
    """
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    cps = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    place = np.repeat(np.arange(len(texts)), sizes + 1)         # each text with the 0 before it
    cps = np.where(_classes()[cps] == 1, cps, 0)[:-1] if len(texts) else cps[:0]
    stay = np.ones(len(cps), bool)
    stay[1:] = (cps[1:] != 0) | (cps[:-1] != 0) | (place[1:] != place[:-1])
    return cps[stay], place[stay]


def strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
