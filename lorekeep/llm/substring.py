"""Substring dedup by difference-cover anchors.

Anchors start only at places p with p mod v in a difference cover D.  For any
two places i, j some k < v has both i+k and j+k in the cover, so two equal
windows share an anchor at the same offset whatever their places; windows
around shared anchors are then extended to their whole length and compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import keyed, removal, repeated

WINDOW = 20
# Perfect difference sets, period: residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors at least a third of the window."""
    period = max(v for v in (1, *COVERS) if v == 1 or length - v + 1 >= length / 3)
    return period, COVERS.get(period, (0,))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: id, ``n_words``, ``n_removed``,
    ``kept_sha256`` and, if ``keep_text``, ``kept_text``.

    A word is removed if a window of ``window`` words that covers it also
    starts earlier: in a row with a smaller id, or before it in its own row.
    Windows are judged on the input.  Null texts have no words; null ids sort
    last; rows that repeat an id are told apart and ordered by a hash of
    their texts.  Ids that are no whole numbers sort as their type does.
    Texts shorter than a window keep all words; long ones count whole.  Other
    columns are not read, whatever their names.  Empty table: no rows.
    """
    period, residues = cover_for(window)
    inside = np.zeros(period, bool)
    inside[list(residues)] = True

    def select(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
        if len(h) < window:
            return np.empty(0, np.int64)
        return np.flatnonzero(inside[np.arange(len(grams)) % period])

    rows, _ = keyed(docs, id_col, text_col)
    found = repeated(rows, window, window - period + 1, select)
    return removal(rows, found, window, id_col, keep_text)
