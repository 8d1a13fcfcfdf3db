"""Ids of a public word-level tokenizer, computed once per distinct word and worker.

The tokenizer cuts at white space before it merges, so the ids of a text are those of its
words in a row. Each Python worker keeps the words it has met; beyond `max_words` it forgets the older
half, which bounds memory and never changes a result.
"""

import itertools
import struct
import unicodedata

#: ASCII punctuation without the apostrophe, which the tokenizer's contractions use
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: byte-level models stand printable characters for the other bytes, in their order
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Words(dict):
    """Ids by word; an unknown word is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        ids = self[word] = self.learn(word)
        return ids


class WordEncoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path, max_words=500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.words = _Words(self._learn)
        self.merge, self.letters = self.tokenizer.model.tokenize, set()
        size = self.tokenizer.get_vocab_size()
        self.whole = any((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size))

    def encode(self, texts):
        return [self._encode(text or "") for text in texts]

    def _encode(self, text):
        # special tokens and the context-dependent sigma are found in unaltered text only
        if not self.whole or "<|" in text or "Σ" in text:
            return self._full(text)
        if len(self.words) > self.max_words:
            newest = itertools.islice(self.words.items(), len(self.words) - self.max_words // 2, None)
            words = _Words(self._learn)
            words.update(newest)
            self.words = words
        return b"".join(map(self.words.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def _full(self, text):
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, word):
        if word.isalpha():
            if not self._letters_only(word):
                return self._full(word)
            # words of letters alone are not cut before they merge: only the model is asked
            return _pack([t.id for t in self.merge(word if word.isascii() else _byte_level(word))])
        core = word.rstrip(PUNCTUATION)
        if core.isalpha():
            return self.words[core] + self.words[word[len(core) :]]
        return self._full(word) if word else b""

    def _letters_only(self, word):
        """Whether the tokenizer neither alters nor cuts `word`."""
        letters = self.letters
        if not letters.issuperset(word):
            letters.update(filter(self._is_letter, set(word) - letters))
            if not letters.issuperset(word):
                return False
        return word.isascii() or unicodedata.is_normalized("NFC", word)

    def _is_letter(self, char):
        normalizer, text = self.tokenizer.normalizer, "a" + char
        if normalizer and normalizer.normalize_str(text) != text:
            return False
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [_byte_level(text)]


def _byte_level(text):
    return text.encode().decode("latin-1").translate(_BYTE_CHARS)


def _pack(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS = {}


def encoder(path):
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
