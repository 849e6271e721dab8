"""Token ids of whole texts with a public word tokenizer, in Arrow batches.

The tokenizer of ``word_bpe_49k.json`` drops white space, so the ids of a text are the ids of its
white-space separated chunks, one after the other. Each slice of a batch is split and dictionary encoded. Chunks of
Latin-1 letters followed by punctuation are cut into a lower-cased word and its punctuation; the distinct words not met
before are given to the tokenizers library, 2,000 to a call, separated by blanks. Everything else is encoded chunk by
chunk, as it stands. A slice's chunks get their ids once, and the words take theirs from there.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from outagelens.llm.common import as_strings, slices, split_words

#: id appended to each document
END_ID = 1
#: words kept in a worker's cache, and bytes of texts; it is emptied beyond either
CACHE_WORDS, CACHE_BYTES = 400_000, 8 << 20

_PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?*#$%&|]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Caches the ids of words; results equal ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``flat[first[r]:first[r] + size[r]]`` are the ids of row r: of a lower-cased word, of punctuation or of a whole chunk.
    Row 0 is empty, row 1 is the end id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.flat = np.array([END_ID], np.int32)
        self.first, self.size = np.zeros(2, np.int32), np.array([0, 1], np.int32)

    def _raw(self, chunk: str) -> np.ndarray:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, dtype=np.int32)

    def _add(self, names: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        n = len(self.size)
        self.row.update(zip(names, range(n, n + len(names)), strict=True))
        self.held += sum(map(len, names))
        self.flat, self.size = np.concatenate((self.flat, *ids)), np.concatenate((self.size, *sizes)).astype(np.int32)
        self.first = np.cumsum(self.size, dtype=np.int32) - self.size

    def _words(self, words: list[str]) -> np.ndarray:
        """Rows of lower-cased words of letters, each of which ends at the first id with the end-of-word mark."""
        new, ids, sizes = [w for w in words if w not in self.row], [], []
        for lo in range(0, len(new), 2000):
            part = new[lo:lo + 2000]
            got = self._raw(" ".join(part))
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(part):  # cannot happen for plain words; encode them one by one
                each = [self._raw(w) for w in part]
                got, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        if new:
            self._add(new, ids, sizes)
        return np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))

    def _others(self, chunks: list[str]) -> np.ndarray:
        """Rows of chunks that are encoded as they stand; an empty one is row 0."""
        names = ["\0" + c for c in chunks]
        new = [c for c, name in zip(chunks, names, strict=True) if c and name not in self.row]
        if new:
            ids = [self._raw(c) for c in new]
            self._add(["\0" + c for c in new], ids, [np.array([len(x) for x in ids])])
        return np.fromiter((self.row[name] if name != "\0" else 0 for name in names), dtype=np.int64, count=len(chunks))

    def rows(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word row and punctuation row of each distinct chunk."""
        if len(self.row) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        parts = pc.extract_regex(vocab, _PLAIN)
        plain = np.asarray(parts.is_valid())
        both = np.zeros((2, len(vocab)), dtype=np.int64)
        for i, (name, of) in enumerate((("word", self._words), ("marks", self._others))):
            found = pc.struct_field(parts.filter(pa.array(plain)), name)
            enc = (pc.utf8_lower(found) if not i else found).dictionary_encode()
            both[i, plain] = of(_listed(enc.dictionary))[np.asarray(enc.indices)]
        both[0, ~plain] = self._others(_listed(vocab.filter(pa.array(~plain))))
        return both[0], both[1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; start of each text in them)."""
        words = split_words(texts)
        pairs = np.stack(self.rows(words.vocab), axis=1).ravel()
        n = self.size[pairs]
        # ids of each distinct chunk, the last one being the end id
        chunks = np.append(_gathered(self.flat, self.first[pairs], n), END_ID).astype(np.int32)
        size = np.append(n[::2] + n[1::2], 1).astype(np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        count = len(words.starts) - 1
        at = np.empty(len(words.ids) + count, dtype=np.int32)
        ends = words.starts[1:] + np.arange(count)
        inner = np.ones(len(at), dtype=bool)
        inner[ends] = False
        at[ends], at[inner] = len(size) - 1, words.ids
        n = size[at]
        after = np.cumsum(n)
        return _gathered(chunks, first[at], n), np.concatenate(([0], after[ends]))


def _listed(strings: pa.Array) -> list[str]:
    """Faster than ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``flat[first:first + n]``, one after the other."""
    before = np.cumsum(n, dtype=np.int64) - n
    total = int(n.sum())
    return flat[np.repeat((first - before).astype(np.int32), n) + np.arange(total, dtype=np.int32)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process and file."""
    return ChunkTokenizer(path)


def encoded(texts: pa.Array, path: str):
    """Yields (lo, hi, ids, starts) for runs of the batch's texts; a null text is empty."""
    texts = as_strings(texts)
    tok = tokenizer(path)
    for lo, hi in slices(texts):
        ids, starts = tok.encode(texts.slice(lo, hi - lo))
        yield lo, hi, ids, starts


def crc32_le(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
