"""Token ids of whole texts by a word-level BPE file of the ``tokenizers`` library.

The library's pre-tokens hold no white space, so what stands between white
space is encoded independently of the rest: a task encodes each different such
run once and joins the kept ids.  Letters and the punctuation behind them
are one pre-token each, already lower-cased and in the form that the normaliser
leaves; so many of them go to the library's model in one string, without its
normaliser and its pattern, and the ids that end a word tell them apart.  Texts
with a character outside plain Latin letters, digits and punctuation go to the
library whole (its normaliser may change more than letter case there).

As the tokenizer files' description has it, the strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import functools
import os
import re
import weakref
from array import array

import numpy as np
import pyarrow as pa

from .common import TABLES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Anything but characters that NFC keeps and that lower-case one by one.
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u203b]")
#: Punctuation but the apostrophe, which may begin a pre-token of letters.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs that are kept for the length of a task, and as many of those met before.
KEPT = 100_000
#: Words that the model gets in one string.
JOINED = 2000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 13, 32]] = True  # all white space among the usual characters
STOP, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
STOP[list(STOPS.encode())] = True
ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


MADE: weakref.WeakSet = weakref.WeakSet()


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.library.get_vocab(with_added_tokens=False), self.library.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:  # without one, or where a byte can't end a word, ids would not tell words apart
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = all(c + suffix in vocabulary for c in pre_tokenizers.ByteLevel.alphabet())
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        MADE.add(self)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, parts: list[str]) -> list[bytes]:
        """The ids of runs that are one pre-token each."""
        if not self.ends.any():
            return self._library(parts)
        out = []
        for k in range(0, len(parts), JOINED):
            some = parts[k : k + JOINED]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            edge = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(edge) != len(some) + 1:
                raise ValueError("the ids of a run of words do not end as often as words do")
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(edge, edge[1:], strict=False)]
        return out

    def _learn(self, runs: list[str]) -> None:
        if len(self.kept) > KEPT:  # what was not met since the last change of the memo is forgotten
            self.kept, self.old = {}, self.kept
        kept, old = self.kept, self.old
        new = [r for r in runs if r not in kept]
        kept.update((r, old[r]) for r in new if r in old)
        plain = [r for r in new if r not in old and (r.isalpha() or not r.rstrip(STOPS))]
        kept.update(zip(plain, self._plain(plain), strict=True))
        mixed = [r for r in new if r not in kept]
        kept.update(zip(mixed, self._library(mixed), strict=True))

    def _gathered(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of usual characters: runs are numbered, each different one is looked up once, and its ids are copied to its places.

        Punctuation that ends a run behind a letter or digit is a run of its own.
        """
        raw = [text.lower().encode() for text in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        word = ~SPACE[data]
        edge = np.diff(np.r_[False, word].view(np.int8))  # 1 where a run begins, -1 where it has ended
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return [b""] * len(texts)
        last = np.maximum.accumulate(np.where(STOP[data], 0, np.arange(len(data), dtype=np.int32)))[end - 1]
        lead, byte = data[np.maximum(last - 1, 0)], data[last]
        letter = ALNUM[byte] | ((byte >= 0x80) & (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((byte == 0x97) | (byte == 0xB7))))  # a-z, 0-9, and all of U+00C0 to U+024F but the signs of times and division
        tail = last[(last >= start) & (last < end - 1) & letter] + 1
        start = np.sort(np.concatenate([start, tail]), kind="stable")
        before = np.cumsum(word, dtype=np.int32)
        offsets = np.r_[before[start] - 1, before[-1]].astype(np.int32)
        runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[word])).dictionary_encode()
        different, number = runs.dictionary.to_pylist(), runs.indices.to_numpy()
        self._learn(different)
        ids = list(map(self.kept.__getitem__, different))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(sizes) - sizes
        own = sizes[number]
        after = np.cumsum(own)
        out = flat[np.repeat(first[number] - after + own, own) + np.arange(after[-1])].tobytes()
        # Runs, and so ids, up to the end of each text.
        upto = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
        cut = [0, *(4 * np.r_[0, after][upto]).tolist()]
        return [out[i:j] for i, j in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        usual = [UNUSUAL.search(text) is None for text in texts]
        found = iter(self._gathered([text for text, u in zip(texts, usual, strict=True) if u]))
        return [next(found) if u else self._library([text])[0] for text, u in zip(texts, usual, strict=True)]


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _forget() -> None:
    for own in MADE:
        own.kept, own.old = {}, {}


TABLES.append(_forget)
