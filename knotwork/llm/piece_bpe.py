"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into words: a run of word marks and what follows up to the next mark; no merge crosses
such a border, because no piece has a mark after another character (checked when the model is read;
otherwise a whole text is one word). The distinct new words of a batch lie in one flat symbol array.
Each round finds the smallest pair rank of every word by a segmented minimum, merges its
occurrences at the same time from the left, and compacts the array, until no word has a pair left.
Where a merge could bring forth a pair of a smaller rank than its own, the library would take that
pair first; such merges (``unsafe``) are made one occurrence a round, so the ids are always those
of the library.

Rounds would be many for a very long word. Those of more than ``LONG_WORD`` symbols are merged with a
heap of pairs by (rank, place), the same order at n log n steps.

A model whose text normalisation is not the one that ``words`` does is refused when it is read.

Cases: a null text counts as empty; an empty text has no ids and decodes to nothing. Bytes of
characters that the model doesn't know become byte pieces. Repeated rows get equal answers. Input
columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import arrow_map

MARK = "▁"
#: Words whose ids a worker keeps; beyond that it forgets them all.
KEPT_WORDS = 400_000
#: Symbols of a word from which its merges are taken from a heap.
LONG_WORD = 2_000
#: Texts that tell whether a model normalises as ``words`` does.
PROBES = ("", " ", "a", " a", "a ", "  a  b  ", "a\tb\n c\r", "A\u0301", "\u00c1", "\ufb01", "\uff21", "\u00a0x\u3000", "\u200bz", "\x00y", "\u2028", "\u00df\u0130", "\u1e9b\u0323", "\u2581b")
_NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """The merge table of a model and the encoder of word batches."""

    def __init__(self, model_file: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        self.known = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.split = all(MARK not in p.lstrip(MARK) for p in self.known)
        self.symbols = dict(self.known)
        for p in self.known:
            for c in p:
                self.symbols.setdefault(c, size + len(self.symbols))
        self.base = size + len(self.symbols) + 1
        scores = {i: sp.get_score(i) for i in self.known.values()}
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = np.full(self.base, _NONE, np.int32)
        for i, s in scores.items():
            rank[i] = levels[s]
        found = [(self.symbols[p[:k]] * self.base + self.symbols[p[k:]], i) for p, i in self.known.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        keys, into = np.array(sorted(found), np.int64).reshape(-1, 2).T
        self.keys, self.into, self.rank = np.append(keys, np.int64(-1) + (1 << 62)), np.append(into, 0).astype(np.int32), rank
        of = rank[into]
        self.unsafe = np.zeros(len(levels) + 1, bool)  # by rank
        for side in (keys // self.base, keys % self.base):
            self.unsafe[rank[side[(rank[side] != _NONE) & (of <= rank[side])]]] = True
        made = np.unique(into)
        tied = np.bincount(rank[made], minlength=len(levels) + 1) > 1
        self.unsafe |= tied
        self.names = np.array([str(i) for i in range(size)], object)
        self._forget()
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        flat, at = self.encode(list(PROBES))
        if _lists(flat, at) != sp.encode(list(PROBES)):
            raise ValueError(f"{model_file}: the model normalises texts in another way than by marks for spaces")

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.split else [marked]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        into = self.into[at]
        return np.where(hit, self.rank[into], _NONE), into

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and the number of each word's symbols."""
        large = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not large:
            return self._rounds(words)
        sym, sizes = self._rounds(["" if len(w) > LONG_WORD else w for w in words])
        ends = np.cumsum(sizes)
        made = [self._by_heap(words[k]) for k in large]
        sizes[large] = [len(m) for m in made]
        return np.insert(sym, np.repeat(ends[large], sizes[large]), np.concatenate(made)).astype(np.int32), sizes

    def _by_heap(self, word: str) -> np.ndarray:
        """Symbols of one word: always the pair of the smallest rank, the leftmost of equals."""
        sym = np.array([self.symbols.get(c, -1 - ord(c)) for c in word], np.int32)
        left, right = np.where(sym < 0, self.base, sym), np.where(sym < 0, self.base - 1, sym)
        rank, into = self._look_up(left[:-1], right[1:])
        known = np.flatnonzero((rank != _NONE) & (sym[:-1] >= 0) & (sym[1:] >= 0))
        heap = [(int(rank[k]), int(k), int(into[k]), int(k) + 1) for k in known]
        heapify(heap)
        now, after, before = sym.tolist(), list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        table: dict[tuple[int, int], tuple[int, int] | None] = {}
        while heap:
            r, k, made, other = heappop(heap)
            if now[k] is None or after[k] != other or other >= len(now) or now[other] is None or self._pair(now[k], now[other], table) != (r, made):
                continue
            now[k], now[other] = made, None
            after[k] = after[other]
            if after[k] < len(now):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(now) and (found := self._pair(now[a], now[b], table)) is not None:
                    heappush(heap, (found[0], a, found[1], b))
        return np.array([x for x in now if x is not None], np.int32)

    def _pair(self, left: int, right: int, table: dict[tuple[int, int], tuple[int, int] | None]) -> tuple[int, int] | None:
        """Rank and symbol of a pair, looked up once."""
        if (left, right) not in table:
            found = None
            if left >= 0 and right >= 0:
                rank, into = self._look_up(np.array([left]), np.array([right]))
                found = (int(rank[0]), int(into[0])) if rank[0] != _NONE else None
            table[left, right] = found
        return table[left, right]

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and the number of each word's symbols.

        Characters that no piece holds are -1 - code point.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        ids = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in distinct], np.int32)
        sym = ids[back] if len(points) else np.zeros(0, np.int32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        after = np.append(sym[1:], 0) if len(sym) else sym
        rank, into = self._look_up(np.where(sym < 0, self.base, sym), np.where(after < 0, self.base - 1, after))
        rank[last | (sym < 0) | (after < 0)] = _NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
                going = least != _NONE
                least, sizes = least[going], sizes[going]
                if not len(sym):
                    break
            chosen = rank == np.repeat(least, sizes)
            at = np.flatnonzero(chosen)
            head = np.append(True, (at[1:] != at[:-1] + 1))
            run = np.flatnonzero(head)[np.cumsum(head) - 1]
            take = (np.arange(len(at)) - run) % 2 == 0
            first = np.append(True, word[at][1:] != word[at][:-1])
            take &= first | ~self.unsafe[rank[at]]
            at = at[take]
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            at = place[at]
            new = np.unique(np.concatenate((at, at[at > 0] - 1)))
            tail = np.minimum(new + 1, len(sym) - 1)
            r, t = self._look_up(np.where(sym[new] < 0, self.base, sym[new]), np.where(sym[tail] < 0, self.base - 1, sym[tail]))
            r[(tail == new) | (word[tail] != word[new]) | (sym[new] < 0) | (sym[tail] < 0)] = _NONE
            rank[new], into[new] = r, t
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _forget(self) -> None:
        self.numbers, self.flat, self.at = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words to ``flat``; word k has those from ``at[k]`` to ``at[k + 1]``."""
        sym, sizes = self.merge(words)
        limit = self.library.get_piece_size()
        odd = np.flatnonzero((sym < 0) | (sym >= limit))
        if len(odd):  # characters that are no pieces become the pieces of their UTF-8 bytes
            rare = {v: k for k, v in self.symbols.items() if v >= limit}
            codes = [[self.byte_ids[b] for b in (rare[s] if s >= 0 else chr(-1 - s)).encode("utf-8", "surrogatepass")] for s in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(c) for c in codes]
            of = np.repeat(np.repeat(np.arange(len(words)), sizes), times)
            first = (np.cumsum(times) - times)[odd]
            sym = np.repeat(sym, times)
            place = np.repeat(first - np.cumsum(times[odd]) + times[odd], times[odd]) + np.arange(int(times[odd].sum()))
            sym[place] = list(chain.from_iterable(codes))
            sizes = np.bincount(of, minlength=len(words))
        self.flat = np.concatenate((self.flat, sym))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end."""
        if len(self.numbers) > KEPT_WORDS:
            self._forget()
        cut = [self.words(t) for t in texts]
        word = np.array(list(map(self.numbers.__getitem__, chain.from_iterable(cut))), np.int64)
        if self.numbers.fresh:
            self._learn(self.numbers.fresh)
            self.numbers.fresh = []
        sizes = self.at[word + 1] - self.at[word]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.at[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum([len(ws) for ws in cut], dtype=np.int64))]


class _Numbers(dict):
    """Numbers for words in order of their first look-up; the new ones are listed in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


@lru_cache(maxsize=2)
def merges(model_file: str) -> Merges:
    return Merges(model_file)


def _lists(values: np.ndarray, bounds: np.ndarray) -> list[list]:
    """One list for each text."""
    flat, at = values.tolist(), bounds.tolist()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(texts: list[str], model_file: str) -> list[list[int]]:
    """Ids of each text."""
    return _lists(*merges(model_file).encode(texts))


def tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids`` of every text and ``decoded``, what the library's decode makes of them."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids = encode([t or "" for t in rows.column(1).to_pylist()], model_file)
        back = merges(model_file).library.decode(ids) if ids else []
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, ids array<int>, decoded string", work)


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``tokens``, but counts and digests in place of ids and texts, made where the ids are."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        coder = merges(model_file)
        flat, bounds = coder.encode([t or "" for t in rows.column(1).to_pylist()])
        ids = _lists(flat, bounds)
        named = [sha(",".join(names)) for names in _lists(coder.names[flat], bounds)]
        back = [sha(t) for t in coder.library.decode(ids)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(named), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
