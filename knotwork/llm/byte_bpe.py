"""Byte-level BPE ids, equal to those of the ``tokenizers`` library for the same JSON file.

The file's vocabulary is read as merge ranks by the faster ``tiktoken`` encoder, which splits by
the same published pattern. A text that holds the string of a special token, and one with a run
that the encoder can't take, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Fixed value: the published word pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable() -> dict[str, int]:
    """The characters that stand for bytes in the JSON file: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, json_file: str) -> None:
        import tiktoken

        self.file = json_file
        model = json.loads(Path(json_file).read_text(encoding="utf-8"))
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte = _printable()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.special = tuple(special)
        # a piece's id is its merge rank for the encoder: the file must list its merges in that order
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        made = [model["model"]["vocab"][a + b] for a, b in pairs]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{json_file}: the merges are not in the order of their ids")
        self.encoder = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.sizes[i] = len(piece)
        for piece, i in special.items():
            self.sizes[i] = len(piece.encode())

    @property
    def slow(self):  # noqa: ANN201  a tokenizers.Tokenizer
        if not hasattr(self, "_slow"):
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.file)
        return self._slow

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return np.asarray(self.encoder.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except BaseException as why:  # noqa: BLE001  the encoder's own panic is no Exception
            if not isinstance(why, (ValueError, RuntimeError)) and type(why).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(json_file: str) -> ByteBpe:
    return ByteBpe(json_file)
