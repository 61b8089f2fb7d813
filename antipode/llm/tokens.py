"""Token ids of whole texts with a public tokenizer, in tasks of bounded memory.

The vocabulary drops white space before it splits a text, so no token spans two
words and the ids of a text are the ids of its words in a row. Arrow splits the texts of a
batch and numbers their distinct words, so Python meets each word once a batch. Each task keeps the
words it met last with their ids and asks the tokenizers library for the others,
many at a time. Words that are not plain letters, and texts that could hold a special token or a
combining mark, are encoded as they stand.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers, next to those of one batch; a bound on memory only. The half met last stays when the older half goes.
REMEMBERED = 200_000
_LETTERS_PER_CALL = 500
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encode texts to little-endian ids. The same ids as ``Tokenizer.encode`` on the whole text."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers  # noqa: PLC0415

        if path is None:
            import public_tokenizers  # noqa: PLC0415

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        # words of lower-case ASCII letters pass normalization and splitting as they are
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 2**16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.remembered, self.known, self.older = remembered, {b"": b""}, {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, words: Iterable[bytes]) -> None:
        known = self.known
        plain: list[bytes] = []
        others: list[bytes] = []
        tails: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            if w.isalpha():
                plain.append(w)
                continue
            core = w.rstrip(_MARKS)
            if not core.isalpha() and not core.decode("utf-8", "surrogatepass").isalpha():
                known[w] = self._whole(w.decode("utf-8", "surrogatepass")).tobytes()
            elif len(core) == len(w):
                others.append(w)
            else:  # letters, then marks: always two pieces
                tails.append((w, core, w[len(core):]))
        for w in {a for _, a, _ in tails} - known.keys() - set(plain) - set(others):
            (plain if w.isalpha() else others).append(w)
        for t in {t for _, _, t in tails} - known.keys():
            known[t] = self._whole(t.decode()).tobytes()
        for tokenizer, group in ((self.letters, plain), (self.tokenizer, others)):
            self._learn_letters(tokenizer, group)
        known.update((w, known[a] + known[t]) for w, a, t in tails)

    def _learn_letters(self, tokenizer, words: list[bytes]) -> None:
        """Words of letters only, many in one call; a token with a word end closes each."""
        width = self.dtype.itemsize
        for i in range(0, len(words), _LETTERS_PER_CALL):
            part = words[i:i + _LETTERS_PER_CALL]
            text = b" ".join(part).lower().decode("utf-8", "surrogatepass")
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(stops) != len(part) or stops[-1] != len(ids) * width:  # a letter that splits its word
                self.known.update((w, self._whole(w.decode("utf-8", "surrogatepass")).tobytes()) for w in part)
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))

    def _not_known(self, words: list[bytes]) -> list[bytes]:
        """The words to learn; older ones that are met again count as met last."""
        known, older = self.known, self.older
        rest = [w for w in words if w not in known]
        known.update((w, older[w]) for w in rest if w in older)
        return [w for w in rest if w not in older]

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts as the ids of their words, looked up once per distinct word."""
        # a view: bytes are split at ASCII white space, whether or not they are valid UTF-8
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        numbered = split.values.view(pa.binary()).dictionary_encode()
        words = numbered.dictionary.to_pylist()
        if 2 * len(self.known) > self.remembered:
            self.known, self.older = {b"": b""}, self.known
        self._learn(self._not_known(words))
        ids = [self.known[w] for w in words]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(
            np.concatenate([np.zeros(1, np.int64), ends]),
            pa.array(np.frombuffer(b"".join(ids), self.dtype)))
        taken = lists.take(numbered.indices)
        values = taken.flatten().to_numpy()
        at = taken.offsets.to_numpy()[split.offsets.to_numpy()]
        at = at - at[0]
        return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        """Ids of each text (UTF-8 bytes are taken as they are); null is empty."""
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        special = {i for i, b in enumerate(raw) if b"<|" in b}
        # 0xCC leads the combining marks that may join with a letter before it
        plain = [b if b"\xcc" in b else b.lower() for i, b in enumerate(raw) if i not in special]
        got = iter(self._by_words(plain)) if plain else iter(())
        return [self._whole(b.decode("utf-8", "surrogatepass")) if i in special else next(got) for i, b in enumerate(raw)]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordEncoder:
    """One encoder per worker process, so what a task has learned serves the tasks after it."""
    return WordEncoder(path)
