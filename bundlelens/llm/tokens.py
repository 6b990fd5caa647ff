"""Token ids of whole texts by a tokenizer file, word by word."""

import re
import struct
from collections.abc import Iterable, Iterator

#: Tokenizers already read by this worker, with the ids of the words they have met.
_READ: dict[str, "Encoder"] = {}


class Words(dict):
    """Ids of words; a word not met before is encoded, and kept as long as there are fewer than ``limit``."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        # Letters a-z alone pass a lower-casing tokenizer's normalisation and splitting as they stand, so that its model can be asked at once.
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        probes = ["a", "the", "qzx", "internationalization", "abcdefghijklmnopqrstuvwxyz"]
        self.plain = not any(plain(x.encode()) for x in added) and all(self.whole(x) == self.direct(x) for x in probes)

    def whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def direct(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.direct(word.decode()) if self.plain and plain(word) else self.whole(word.decode("utf-8", "replace"))
        value = little_endian(ids)
        if len(self) < self.limit:
            self[word] = value
        return value


def plain(word: bytes) -> bool:
    """Letters a-z only."""
    return word.isalpha() and word.islower()


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts, as the library gives them for the whole text without special tokens added.

    A token never spans blank space, so a text's ids are those of its words in turn. Words repeat, so each is encoded
    once and kept, up to ``limit`` words; the frequent ones are met early, and what comes later is encoded where it stands. Where no special token can occur, letters A-Z are lowered and ASCII marks
    (but the apostrophe) between a letter a-z and a blank are cut off first, which leads to the same ids (the tokenizer does both)
    and to fewer different words. That holds for lower-casing tokenizers that drop blanks, which the constructor checks.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words(self.tokenizer, limit)
        probe = "Aa bB,\nc. 1\tÉx"
        same = [self.ids([probe])[0], b"".join(self.ids(probe.split())), b"".join(self.ids(["aa", "bb", ",", "c", ".", "1", "Éx"]))]
        if len(set(same)) > 1:
            raise ValueError("the tokenizer doesn't lower case or keeps blank space; its texts must be encoded whole")
        marks = rb"[!-&(-/:-@\[-`{-~]"
        # The letter before the first mark is looked at after it, so that the search can skip to marks.
        self.stop = re.compile(marks + rb"(?<=[a-z].)" + marks + rb"*(?=[\x20\x09-\x0D])")

    def ids(self, texts: list[str]) -> list[bytes]:
        return [little_endian(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        of = self.known.__getitem__
        for text in texts:
            if b"<|" not in text:
                text = self.stop.sub(rb" \g<0>", text.lower())
            yield b"".join(map(of, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _READ:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _READ[path] = Encoder(path)
    return _READ[path]
