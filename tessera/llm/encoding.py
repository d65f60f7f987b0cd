"""Ids of whole texts by a public tokenizer, for operators that write or pack them."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, compress
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once, and of words that a worker keeps.
GROUP_BYTES, MEMORY_BYTES = 1 << 20, 48 << 20
#: What Python holds for a known word besides its letters and ids.
CHUNK_BYTES = 150
SPACE = re.compile(rb"[ \t-\r]")
#: ASCII punctuation between a letter or digit and white space, which is a word of its own; not the apostrophe, which may open a contraction.
TAIL = re.compile(rb"([!-&(-/:-@\[-`{-~](?<=[0-9a-z].)[!-&(-/:-@\[-`{-~]*)(?=[ \t-\r]|\Z)")
#: Words of lower-case letters of ASCII and Latin-1 alone.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Encoder:
    """Ids of many whole texts at once.

    The tokenizers served here drop white space and part words from punctuation before anything else, so a text's ids are those of its
    space-separated chunks one after another. A chunk is encoded once and then looked up; its ids lie in one flat array. What is kept has a bound in bytes;
    at the bound the chunks that were looked up since the last time stay, up to half of it, and the others go.
    Tokens that end a word are those named ``...</w>``; a vocabulary without such has its chunks encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.held, self.met = array("I"), array("q", [0]), 0, bytearray()

    def _full(self) -> bool:
        return self.held + 4 * len(self.ids) > MEMORY_BYTES

    def _forget_unmet(self) -> None:
        """Chunks lie in the order of their numbers, the longest known first."""
        met, starts = np.frombuffer(self.met, np.uint8) > 0, np.frombuffer(self.starts, np.int64)
        sizes = np.diff(starts)
        room = np.fromiter(map(len, self.known), np.int64, len(self.known)) + CHUNK_BYTES + 4 * sizes
        met &= np.cumsum(room * met) <= MEMORY_BYTES // 2
        chunks, ids = list(compress(self.known, met)), np.frombuffer(self.ids, np.uint32)[np.repeat(met, sizes)]
        sizes = sizes[met]
        self._forget()
        self._add(chunks, ids, sizes)

    def _add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.starts) - 1
        self.known.update(zip(chunks, range(n, n + len(chunks))))
        self.starts.frombytes((self.starts[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.met.extend(bytes(len(chunks)))
        self.held += sum(map(len, chunks)) + CHUNK_BYTES * len(chunks)

    def _learn(self, new: list[bytes]) -> None:
        """Plain words are encoded many at a time: each gives one token that ends a word, the last of its own."""
        plain, rest = [], []
        for c in new:
            (plain if c.isalpha() and c.islower() or PLAIN.fullmatch(c) else rest).append(c)
        lines = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        for words, e in zip(lines, self._encode([b" ".join(x) for x in lines]), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                self._add(words, ids, np.diff(ends, prepend=0))
            else:
                rest += words
        every = [e.ids for e in self._encode(rest)]
        if rest:
            self._add(rest, np.fromiter(chain.from_iterable(every), np.int64), np.fromiter(map(len, every), np.int64))

    def _encode(self, texts: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        if self._full():
            self._forget_unmet()
        # A special token's own string is matched as it stands; all other text is lowered by the tokenizer anyway.
        cut = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else TAIL.sub(rb" \1", t.lower()) for t in texts], pa.large_string()))
        # Each distinct chunk is looked up once; an empty one, before or after white space, has no ids.
        distinct = cut.flatten().dictionary_encode()
        chunks = distinct.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        before = len(self.known)
        self._learn([c for c in chunks if c not in self.known])
        codes = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if before:
            np.frombuffer(self.met, np.uint8)[codes[codes < before]] = 1
        codes = codes[distinct.indices.to_numpy()]
        starts = np.frombuffer(self.starts, np.int64)
        first, sizes = starts[codes], starts[codes + 1] - starts[codes]
        ends = np.cumsum(sizes)
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        ids = flat[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.cumsum(np.r_[0, cut.value_lengths().to_numpy()])]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; a long text is encoded in pieces that end at white space."""
        if sum(map(len, texts)) <= 2 * GROUP_BYTES:
            yield from self._group(texts)
            return
        for text in texts:
            at, found = 0, []
            while True:
                end = SPACE.search(text, at + GROUP_BYTES)
                found += self._group([text[at:end.start() if end else len(text)]])
                if end is None:
                    break
                at = end.start()
            yield np.concatenate(found)


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder: tasks get this package by value, so what outlives a task is kept in a module of its own."""
    kept = sys.modules.setdefault("_tessera_encoders", ModuleType("_tessera_encoders")).__dict__
    if kept.get("path") != path:
        kept.update(path=path, encoder=Encoder(path))
    return kept["encoder"]


def forget_encoder() -> None:
    """Gives back what ``worker_encoder`` keeps, in tasks of later stages that the same workers run."""
    sys.modules.pop("_tessera_encoders", None)
