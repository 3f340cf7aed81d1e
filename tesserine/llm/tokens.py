"""Token ids of whole texts by a public tokenizer file, with bounded caches.

The tokenizer drops white space before it splits a text into words, so the ids
of a text are those of its white-space-free runs in turn. Runs repeat, hence a
cache from run to id bytes does most of the work. A run of Latin-1 letters with
punctuation after it splits into these two parts, and letters go to the
tokenizer's model directly, many at once, in its own byte alphabet; marks and
every other run go through the whole tokenizer. Texts are cut at ASCII white space alone.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the cache, the longest run that it keeps, and the characters of the
#: texts that are encoded together.
CACHE_WORDS, CACHE_CHARS, GROUP_CHARS = 200_000, 48, 4 << 20
#: Runs of letters that go to the model in one call, whose result takes about 100 bytes
#: a token.
RUNS = 1 << 12
_SIMPLE = "\\A(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-\x60{-~]*)\\z"


def _byte_alphabet() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update((b, chr(256 + i)) for i, b in enumerate([b for b in range(256) if b not in out]))
    del out[32]  # stays as what separates runs
    return out


_ALPHABET = _byte_alphabet()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, size: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model over runs that are normalized and mapped already
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("a vocabulary with word ends is needed")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.size = size
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of lower-case runs of letters, many in one call of the model."""
        out: dict[str, bytes] = {}
        for i in range(0, len(runs), RUNS):
            some = runs[i : i + RUNS]
            mapped = " ".join(some).encode().decode("latin1").translate(_ALPHABET)
            ids = np.asarray(self.runs.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            out.update((r, data[i:j]) for r, i, j in zip(some, [0, *stops], stops, strict=False))
        return out

    def _of(self, words: list[str], fresh: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """Ids of distinct words or runs, from the cache or from fresh(those not there)."""
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if self.older:
            for i, ids in zip(new, map(self.older.get, [words[i] for i in new]), strict=True):
                out[i] = ids
        made = fresh([words[i] for i in new if out[i] is None])
        for i in new:
            if out[i] is None:
                out[i] = made[words[i]]
        known.update((words[i], out[i]) for i in new if len(words[i]) <= CACHE_CHARS)
        if 2 * len(known) > self.size:  # what is used goes on to the next generation
            self.older, self.known = known, {}
        return out

    def _wholes(self, words: list[str]) -> dict[str, bytes]:
        return {w: self.whole(w) for w in words}

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in turn."""
        group: list[str] = []
        room = GROUP_CHARS
        for text in texts:
            group.append(text or "")
            room -= len(group[-1])
            if room <= 0:
                yield from self._encode(group)
                group, room = [], GROUP_CHARS
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """A word is two pieces, a run of letters and the marks after it, or one piece
        of another kind and an empty one; texts are gathered from distinct pieces."""
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = parts.values.dictionary_encode()
        run, marks = pc.extract_regex(words.dictionary, _SIMPLE).flatten()
        simple = run.is_valid()
        runs, marks = pc.utf8_lower(run).dictionary_encode(), marks.dictionary_encode()
        each = self._of(runs.dictionary.to_pylist(), self._letters)
        at_marks = len(each)
        each += self._of(marks.dictionary.to_pylist(), self._wholes)
        at_others = len(each)
        each += self._of(words.dictionary.filter(pc.invert(simple)).to_pylist(), self._wholes)
        each.append(b"")
        size = np.fromiter(map(len, each), np.int32, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        simple = simple.to_numpy(zero_copy_only=False)
        pieces = np.empty((len(simple), 2), np.int32)
        pieces[simple, 0] = runs.indices.drop_null().to_numpy()
        pieces[simple, 1] = marks.indices.drop_null().to_numpy() + at_marks
        pieces[~simple, 0] = np.arange(at_others, len(each) - 1)
        pieces[~simple, 1] = len(each) - 1
        which = pieces[words.indices.to_numpy()].ravel()
        cuts = 2 * parts.offsets.to_numpy()
        del parts, words, run, runs, marks, each
        n = size[which]
        stops = np.cumsum(n, dtype=np.int64)
        wide = np.int32 if not len(stops) or max(stops[-1], len(flat)) < 1 << 31 else np.int64
        stops = stops.astype(wide)
        at = np.repeat((np.cumsum(size, dtype=np.int64).astype(wide) - size)[which] - (stops - n), n)
        at += np.arange(len(at), dtype=wide)
        ids = flat[at]
        cuts = np.concatenate([np.zeros(1, wide), stops])[cuts].tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield ids[i:j]

    def encode(self, text: str) -> bytes:
        return next(self._encode([text])).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, which stays with its cache for the
    worker's next tasks."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
