"""Token ids of texts whose words repeat: the library looks at each word once, the rest is gathering."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps at hand, and bytes of text looked at together.
MOST, PORTION = 1 << 20, 1 << 23


#: Latin letters, words of them, and words of these and ASCII signs.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_PLAIN, _SIMPLE = re.compile("[a-zß-öø-ÿ]+"), r"^[\x00-\x7fÀ-ÖØ-öø-ÿ]*$"


def portions(batch: pa.RecordBatch, most: int = PORTION, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have at most ``most`` bytes together, or of one longer text."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(int(np.searchsorted(ends, before + most, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def plain_text(column: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets, null as empty."""
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def strings(column: pa.Array) -> list[str]:
    """The values as Python strings, without a scalar object for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of all ``i``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Flat:
    """Rows of unequal length in one array, by number."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.ends = values, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows``, one row after the other, and the size of each."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        return self.values[ragged(self.ends[rows], sizes)], sizes

    def gathered(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows``, and how many come from the first ``counts[0]`` rows, the next ``counts[1]``, ..."""
        values, sizes = self.take(rows)
        before, ends = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return values, np.diff(before[ends])


class WordIds:
    """Ids of whole texts by the tokenizers library, for vocabularies that drop white space.

    White space separates what such a library's normalizer and splitter look at, so the ids of a
    text are those of its words, one after the other. A word of ASCII signs and Latin letters is
    lower-cased first if the normalizer does so, and full stops and commas after a letter or digit
    are a word of their own if the splitter sees them so. The library encodes each different word
    once: by its model if the word is of such letters alone, else thousands together with a space
    or a full stop between. What the normalizer and the splitter do is asked of them at the start.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("AZ") == "az"
        splitter = self.library.pre_tokenizer
        parts = [part for part, _ in splitter.pre_tokenize_str("ab., c7,. .")] if splitter else []
        self.peel = parts == ["ab", ".,", "c", "7", ",.", "."] and len(self.library.encode(".", add_special_tokens=False).ids) == 1
        # Letters whose normal form is their lower case, and what the splitter makes of each.
        letters = "".join(sorted({c.lower() for c in _LETTERS}))
        alone = self.library.normalizer is not None and self.library.normalizer.normalize_str(_LETTERS) == _LETTERS.lower()
        self.signs = {ord(c): "".join(part for part, _ in splitter.pre_tokenize_str(c)) for c in letters} if splitter else {}
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.plain = self.peel and alone and not any(token.strip().isalpha() for token in added) and [
            part for part, _ in splitter.pre_tokenize_str(letters)] == [letters.translate(self.signs)] and self.library.encode(
            letters, add_special_tokens=False).ids == self._model(letters)
        self._forget()

    def _model(self, word: str) -> list[int]:
        return [token.id for token in self.library.model.tokenize(word.translate(self.signs))]

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.known = Flat(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Have the library encode words not met before, thousands together."""
        plain = [word for word in words if self.plain and _PLAIN.fullmatch(word)]
        if plain:
            # Such a word is one piece as it stands, so it goes to the model itself.
            found = list(map(self._model, plain))
            self._add(plain, np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.array([len(ids) for ids in found], np.int64))
            words = [word for word in words if word not in self.numbers]
        stopped = [word for word in words if self.peel and "." not in word]
        others = [word for word in words if not self.peel or "." in word]
        for k in range(0, len(stopped), 4096):
            # No id of these words is that of a full stop, so full stops tell them apart.
            some = stopped[k : k + 4096]
            ids = np.array(self.library.encode(" . ".join([*some, ""]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(ids == ids[-1])
            self._add(some, ids[ids != ids[-1]], np.diff(stops, prepend=-1) - 1)
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            starts = np.cumsum([0, *(len(word) + 1 for word in some[:-1])])
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            owners = np.searchsorted(starts, places, side="right") - 1
            self._add(some, np.array(found.ids, np.uint32), np.bincount(owners, minlength=len(some)))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))
        self.known.add(ids, sizes)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The number of each word."""
        coded = words.dictionary_encode()
        distinct = strings(coded.dictionary)
        new = [word for word in distinct if word not in self.numbers]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        return rows[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if len(self.numbers) > MOST:
            self._forget()
        split = pc.ascii_split_whitespace(plain_text(texts))
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        words, where = coded.dictionary, coded.indices.to_numpy()
        simple = pc.match_substring_regex(words, _SIMPLE) if self.plain else pc.string_is_ascii(words)
        if self.lower:
            words = pc.if_else(simple, pc.utf8_lower(words), words)
        if not self.peel:
            return self.known.gathered(self._rows(words)[where], counts)
        stems = pc.ascii_rtrim(words, ".,")
        apart = pc.and_(simple, pc.match_substring_regex(stems, "[A-Za-z0-9À-ÖØ-öø-ÿ]$"))
        stems = pc.if_else(apart, stems, words)
        sizes = pc.utf8_length(stems).to_numpy().tolist()
        tails = pa.array([word[n:] for word, n in zip(strings(words), sizes)], pa.large_string())
        # A word is its stem and what follows it, which is mostly nothing.
        both = np.stack([self._rows(stems), self._rows(tails)], axis=1).ravel()
        return Flat(*self.known.gathered(both, np.full(len(words), 2))).gathered(where, counts)


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker; it stays from task to task."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]
