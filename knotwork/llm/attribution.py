"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' byte spans follow from the ids and become
character spans (a token inside a character covers that character); the sections' spans and the
tokens' spans, both ascending, are joined by binary search. A token that lies in several sections
goes, by the named rule, to that of its first character (``first``), that of its last (``last``), or
the one that holds most of its characters, the earliest of equals (``majority``). So the counts
of a document's sections add up to the tokens of the whole document.

Sections are the document's lines, each with its line feed.

Cases: a null or empty text has one section, 0, without characters and tokens. Empty lines are
sections too. Repeated rows are counted each for itself. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import byte_bpe
from .shared import arrow_map

RULES = ("first", "last", "majority")


def attribute(start: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token with character span [start, end), and whether it crosses a border.

    Section k ends before ``borders[k]``, where the next begins.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    head, tail = np.searchsorted(borders, start, "right"), np.searchsorted(borders, end - 1, "right")
    crossing = head != tail
    chosen = (tail if rule == "last" else head).copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            inner = borders[head[t] : tail[t]]
            chosen[t] = head[t] + np.argmax(np.diff(np.concatenate(([start[t]], inner, [end[t]]))))
    return chosen, crossing


def sections(docs: DataFrame, tokenizer: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Characters, tokens and border-crossing tokens of every line of every document."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        coder = byte_bpe(tokenizer)
        of, number, chars, tokens, crossed = [], [], [], [], []
        for r, text in enumerate(rows.column(1).to_pylist()):
            raw = data[offsets[r] : offsets[r + 1]]
            at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before a byte
            borders = at[np.flatnonzero(raw == 10) + 1]
            if not len(borders) or borders[-1] < at[-1]:
                borders = np.append(borders, at[-1])
            ends = np.cumsum(coder.sizes[coder.encode(text or "")])
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            begun = at[starts] - (((raw[starts] & 0xC0) == 0x80) if len(starts) else 0)
            chosen, crossing = attribute(begun, at[ends], borders, rule)
            n = len(borders)
            of.append(np.full(n, r))
            number.append(np.arange(n))
            chars.append(np.diff(np.concatenate(([0], borders))))
            tokens.append(np.bincount(chosen, minlength=n))
            crossed.append(np.bincount(chosen[crossing], minlength=n))
        made = [np.concatenate(x) for x in (number, chars, tokens, crossed)]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.concatenate(of)))] + [pa.array(x, pa.int64()) for x in made], [id_col, "section", "n_chars", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, section long, n_chars long, n_tokens long, n_crossing long", work)
