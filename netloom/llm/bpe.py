"""BPE encoding and decoding with tree concatenation.

Text is encoded by the ``tokenizers`` library, in pieces whose encodings can be put together:

* White space ends a pre-token of byte-level BPE in any context, so text that has white space is cut
  before white space, and words seen before are looked up.
* Unsplit text longer than a leaf is halved again and again down to leaves. Leaves are encoded side by
  side; then each join is repaired from the bottom of the tree up: a window around the join is
  encoded anew and grown until both of its ends agree with the tokens outside it. The window's ends lie where
  pre-tokens end, or inside a run of one character class. In such a run two tokens that are
  neighbours in some valid encoding are neighbours in any, so equal end tokens prove that the whole is what encoding
  the text at once would give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import text_steps

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces after each of which a pre-token ends, whatever surrounds them.
PIECES = re.compile(rf"[ \n]?[{LETTERS}]+(?=[ \n.,!?;:])|[.,!?;:]+(?=[ \n])|\s*\S+(?:[^\S \n\t]\s*\S*)*|\s+")
JOINABLE = re.compile(rf"[ \n][{LETTERS}]+")
#: Characters that some libraries take for white space and some don't.
ODD = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")
SPACE = regex.compile(r"\s")
CLASSES = (regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"[^\s\p{L}\p{N}]"))

#: Characters in a leaf, and in the first window to each side of a join.
LEAF, WINDOW = 16_384, 64
#: Bytes of texts that are encoded at a time; each step costs a look at all words remembered.
STEP = 500_000
#: Distinct words that one worker remembers, and their characters; longer words than so many are soon forgotten.
MEMO, MEMO_CHARS, LONG = 400_000, 1 << 24, 64


def _class(c: str) -> int:
    return next((i for i, p in enumerate(CLASSES) if p.match(c)), -1)


class Memo(dict):
    """Numbers words in the order in which they are first looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n


class Codec:
    """Encodes and decodes with the tokenizer file at ``path`` (byte-level BPE)."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tok, self.leaf, self.window, self.most = Tokenizer.from_file(path), leaf, window, memo
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        n = max([*self.tok.get_vocab(with_added_tokens=True).values(), *added]) + 1
        self.bytes_of = np.array([len((added[i].content.encode() if i in added else self.tok.id_to_token(i)) or "") for i in range(n)], np.int64)
        self.model = self.tok.model
        # Byte-level BPE's name of each byte: itself if it is printable, else the next character from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (chr(256 + i) for i in range(256))
        self.byte_names = {b: chr(b) if b in printable else next(rest) for b in range(256)}
        self.longest_added = max([len(x.content) for x in added.values()], default=0)
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.count, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.used = 0

    def _shrink(self) -> None:
        """Keeps the words used most, at most half of what is allowed, and none that is long or used only once."""
        words, uses = list(self.memo), self.uses[: len(self.memo)]
        half = min(self.most // 2, len(uses))
        least = max(2, int(np.partition(uses, -half)[-half]) + (half < len(uses)))
        kept = np.flatnonzero((uses >= least) & (np.fromiter(map(len, words), np.int64, len(words)) <= LONG))
        old = self.flat, self.start[kept], self.count[kept], uses[kept]
        self._forget()
        self.memo.update((words[i], n) for n, i in enumerate(kept.tolist()))
        self.memo.chars = sum(map(len, self.memo))
        ends = np.cumsum(old[2])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(old[1] - (ends - old[2]), old[2])
        self._store(np.arange(len(kept)), old[0][at], old[2])
        self.uses[: len(kept)] = old[3] // 2

    def plain(self, texts: list[str]) -> list[list[int]]:
        """The library's own encoding."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    # -- words ----------------------------------------------------------------------------------

    def _store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keeps the ids of the words with these numbers, which lie in ``ids`` one after another."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.memo) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
            self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[numbers] = counts
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Encodes new words."""
        number = len(self.memo) - len(words)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            apart = np.fromiter((JOINABLE.fullmatch(w) is not None for w in part), bool, len(part))
            numbers = np.arange(number + i, number + i + len(part))
            joined, others = [w for w, x in zip(part, apart, strict=True) if x], [w for w, x in zip(part, apart, strict=True) if not x]
            for which, found in ((apart, self._letters(joined)), (~apart, self._any(others))):
                if found:
                    self._store(numbers[which], np.array([x for ids in found for x in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Letters after a space or a line end: with the space, the letters are one pre-token, so the library's model takes them as they are."""
        if not words:
            return []
        bare = "\0".join(w[w[0] == "\n" :] for w in words).encode().decode("latin-1").translate(self.byte_names).split(self.byte_names[0])
        tokenize, line = self.model.tokenize, self.plain(["\n"])[0]
        found = [[t.id for t in tokenize(w)] for w in bare]
        return [line + ids if w[0] == "\n" else ids for w, ids in zip(words, found, strict=True)]

    def _any(self, words: list[str]) -> list[list[int]]:
        short = iter(self.plain([w for w in words if len(w) <= self.leaf]))
        return [next(short) if len(w) <= self.leaf else self.tree(w).tolist() for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and bounds: text i has ids ``bounds[i]:bounds[i+1]``."""
        if len(self.memo) > self.most or self.memo.chars > MEMO_CHARS:
            self._shrink()
        look = self.memo.__getitem__
        numbers, n_words = [], []
        for t in texts:
            pieces = PIECES.findall(t) if not ODD.search(t) else [t]
            numbers.append(np.fromiter(map(look, pieces), np.int64, len(pieces)))
            n_words.append(len(pieces))
        new, self.memo.new = self.memo.new, []
        self._learn(new)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.uses[: len(self.memo)] += np.bincount(numbers, minlength=len(self.memo))
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - (ends - counts), counts)
        word_ends = np.cumsum(n_words)
        bounds = np.concatenate(([0], np.concatenate(([0], ends))[word_ends])) if len(n_words) else np.zeros(1, np.int64)
        return self.flat[at], bounds

    # -- unsplit text ---------------------------------------------------------------------------

    def tree(self, text: str) -> np.ndarray:
        """Tree concatenation: equals the library's encoding of ``text``."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        level = [(a, b, np.array(ids, np.uint32)) for (a, b), ids in zip(zip(cuts, cuts[1:], strict=False), self.plain([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), strict=True)]
        while len(level) > 1:
            paired = [(x[0], y[1], self._join(text, x, y)) for x, y in zip(level[0::2], level[1::2], strict=False)]
            level = paired + level[len(paired) * 2 :]
        return level[0][2]

    def _cuts(self, text: str, part: tuple[int, int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Token boundaries inside a part that are character boundaries: characters in the text, tokens before."""
        a, b, ids = part
        raw = np.frombuffer(text[a:b].encode(), np.uint8)
        first = np.concatenate(((raw & 0xC0) != 0x80, [True]))
        ends = np.concatenate(([0], np.cumsum(self.bytes_of[ids])))
        chars = np.concatenate(([0], np.cumsum(first[:-1])))
        ok = np.flatnonzero(first[ends])
        return a + chars[ends[ok]], ok

    def _join(self, text: str, left: tuple, right: tuple) -> np.ndarray:
        mid, (lc, lt), (rc, rt) = left[1], self._cuts(text, left), self._cuts(text, right)
        w = max(self.window, 2 * self.longest_added)

        def free(p: int) -> bool:
            return not SPACE.match(text[p - 1]) and bool(SPACE.match(text[p]))

        def inner(p: int) -> bool:
            return text[p] != "'" and (k := _class(text[p])) >= 0 and k == _class(text[p - 1])

        while True:
            i = int(np.searchsorted(lc, mid - w, side="right")) - 1
            while i > 0 and not (free(lc[i]) or inner(lc[i])):
                i -= 1
            j = int(np.searchsorted(rc, mid + w, side="left"))
            while j < len(rc) - 1 and not (free(rc[j]) or inner(rc[j])):
                j += 1
            i, j = max(i, 0), min(j, len(rc) - 1)
            s, e, before, after = int(lc[i]), int(rc[j]), int(lt[i]), int(rt[j])
            ids = np.array(self.plain([text[s:e]])[0], np.uint32)
            agree_left = i == 0 or free(s) or (before < len(left[2]) and len(ids) and ids[0] == left[2][before])
            agree_right = j == len(rc) - 1 or free(e) or (after > 0 and len(ids) and ids[-1] == right[2][after - 1])
            if agree_left and agree_right:
                return np.concatenate((left[2][:before], ids, right[2][after:]))
            w *= 2


_codecs: dict[tuple, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec; later tasks find its words again."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``df``: the id, ``ids array<int>`` and, with ``decode``, ``decoded string``.

    ``tokenizer`` is the path of a ``tokenizers`` file. Whole texts are encoded; a null or empty text has no ids and
    decodes to the empty string; ids may be null or repeated; other columns are not read. No shuffle: rows stay where
    they are read, and a long text's leaves are encoded as one batch."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1), STEP, raw=False):
                ids, bounds = c.encode(texts)
                out = [batch.column(0).slice(a, b - a), id_lists(ids, bounds)]
                if decode:
                    flat = ids.tolist()
                    out.append(pa.array([c.decode(flat[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["k", "ids", "decoded"][: len(out)])

    schema = f"k {kind}, ids array<int>" + ", decoded string" * decode
    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", id_col)
