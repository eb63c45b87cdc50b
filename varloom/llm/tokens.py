"""Exact tokenizer output, word by word where that is provably the same."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which the word tables below split a text as the tokenizers' own patterns do: ASCII without controls other
#: than tab, line feed and carriage return, and printable Latin letters. A text with any other goes to the library whole.
PLAIN = re.compile("[^\t\n\r -~¡-ſ]")
#: Remembered words a process. A word takes some 150 bytes.
MEMORY = 800_000

_held: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once a process, without padding or truncation."""
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_padding()
        loaded.no_truncation()
        _held[path] = loaded
    return _held[path]


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


class WordIds:
    """Token ids of texts for a tokenizer that drops white space, and so encodes each blank-separated word by itself."""

    def __init__(self, path: str, words: int = MEMORY):
        self.words = words
        self.library = tokenizer(path)
        self.specials = specials(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text."""
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        Arrow splits the texts and numbers their distinct words; only those are looked up, and their ids are laid out by
        position. Texts that the table may not split (see PLAIN) go to the library whole.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, PLAIN.pattern)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        parts = self.lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        held = np.frombuffer(b"".join(parts), np.uint32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        per_word = sizes[codes]
        ends = np.cumsum(per_word)
        from_ = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - per_word), per_word)
        ids = held[from_ + np.arange(len(from_))]
        words = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        counts = np.diff(np.r_[0, np.r_[0, ends][np.cumsum(words)]])
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(whole):
            return ids, counts
        given = {i: np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in whole.tolist()}
        starts, out, last = np.cumsum(counts) - counts, [], 0
        for i, own in given.items():
            out += [ids[last : starts[i]], own]
            last = starts[i]
            counts[i] = len(own)
        return np.concatenate([*out, ids[last:]]), counts

    def lookup(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes; unknown ones are encoded together. When the table is full it becomes the older
        one, from which words that occur again come back, so that frequent words are never forgotten."""
        if len(self.known) > self.words:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        if older:
            known.update((w, older[w]) for w in missing if w in older)
            missing = [w for w in missing if w not in known]
        # The pattern parts a run of letters from a run of stops, and case is dropped: what remains is looked up first.
        parts = {}
        for w in missing:
            core = w.rstrip(".,!?")
            parts[w] = (core.lower(), w[len(core) :]) if core.isalpha() else (w, "")
        new = list({p for pair in parts.values() for p in pair if p and p not in known})
        for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, np.uint32).tobytes()
        known[""] = b""
        for w, (core, stops) in parts.items():
            known[w] = known[core] + known[stops]
        return [known[w] for w in words]


class PieceCounts:
    """Numbers of tokens for a byte-level tokenizer that first splits by `pattern` and encodes each piece by itself."""

    def __init__(self, path: str):
        import regex

        self.library = tokenizer(path)
        self.special = re.compile("|".join(map(re.escape, specials(path))) or r"(?!)")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if PLAIN.search(text) or self.special.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = self.split(text)
        known = self.known
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            pass
        missing = list({p for p in pieces if p not in known})
        if len(known) + len(missing) > MEMORY:
            known.clear()
            missing = list(set(pieces))
        for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            known[p] = len(e.ids)
        return sum([known[p] for p in pieces])


_word_ids: dict[tuple[str, int], WordIds] = {}
_piece_counts: dict[str, PieceCounts] = {}


def word_ids(path: str, words: int = MEMORY) -> WordIds:
    """One table a process, so that later tasks of the same worker find the words of earlier ones; it holds at most twice so many words."""
    if (path, words) not in _word_ids:
        _word_ids[path, words] = WordIds(path, words)
    return _word_ids[path, words]


def piece_counts(path: str) -> PieceCounts:
    if path not in _piece_counts:
        _piece_counts[path] = PieceCounts(path)
    return _piece_counts[path]


def counts(path: str, texts: Iterable[str | None]) -> list[int]:
    """Token counts of texts as the library that belongs to the file gives them, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        if path not in _held:
            _held[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(_held[path].encode(t or "", num_threads=1)) for t in texts]
    loaded = tokenizer(path)
    byte_level = loaded.normalizer is None and "ByteLevel" in str(loaded.pre_tokenizer) and "use_regex=True" in str(loaded.pre_tokenizer) and "add_prefix_space=False" in str(loaded.pre_tokenizer)
    if byte_level and "Sequence" not in str(loaded.pre_tokenizer)[:10]:
        table = piece_counts(path)
        return [table.count(t) for t in texts]
    return [len(loaded.encode(t or "", add_special_tokens=False).ids) for t in texts]
