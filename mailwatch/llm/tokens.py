"""Token ids of a public tokenizer, with pieces of text encoded once and remembered."""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import batches

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = 2
_REMEMBERED = 200_000
_LONGEST_REMEMBERED = 32


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Patterns of Arrow (RE2), whose \\s knows blanks of ASCII only.
_BLANK_BEFORE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_MARK_BEHIND_NO_LETTER = r"(^|[^\p{L}\p{N}])[.,]"
# One piece for sure: letters that every version of Unicode knows, or digits.
_PLAIN = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+)").fullmatch


def _byte_letters() -> str:
    """The letters that stand for the bytes from 0 to 255 in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}
    return "".join(letters[b] for b in range(256))


class _Pieces(dict[str, bytes]):
    """Ids of a part of a text; those of short parts and of single pieces of the pre-tokenizer are kept, others are put together from them."""

    def __init__(self, tokenizer, split: Callable[[str], list[str]]):
        self.split, self.letters, self.before = split, _byte_letters(), {}
        # A piece goes to the model as it is; everything that the tokenizer does before is done.
        self.merged = tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            pieces = None if _PLAIN(part) else self.split(part)
            if pieces is not None and len(pieces) != 1:
                ids = b"".join(map(self.__getitem__, pieces))
                if len(part) > _LONGEST_REMEMBERED:
                    return ids
            else:
                letters = codecs.charmap_decode(part.encode(), "strict", self.letters)[0]
                ids = array("I", [t.id for t in self.merged(letters)]).tobytes()
        self[part] = ids
        return ids

    def forget(self) -> None:
        """Lets go of what was not used since the last call, if enough was."""
        if len(self) > _REMEMBERED:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Encodes texts part by part.

    The tokenizer never merges over the borders of its own pre-tokenizer, so the ids of a text are
    those of its parts in turn. Texts repeat their parts: each is looked up once a batch, and the ids of the
    some 200,000 to 400,000 used last are kept by each worker (about 80 MB at most). A text with an added token
    (``<|endoftext|>``) is encoded whole.
    """

    def __init__(self, path: str):
        # Here, so that plans can be built where the tokenizers are not installed.
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known = _Pieces(self.tokenizer, regex.compile(public_tokenizers.PATTERN).findall)

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text (uint32); none for null."""
        return [ids for a, b in batches(texts, 1 << 20) for ids in self._some(texts[a:b])]

    def _some(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        self.known.forget()
        whole = {}
        for i, t in enumerate(texts):
            if t and self.special is not None and self.special.search(t):
                whole[i] = np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            elif t and "\0" in t:
                whole[i] = np.frombuffer(self.known[t], np.uint32)
        parts = _split(["" if t is None or i in whole else t for i, t in enumerate(texts)])
        codes = parts.values.dictionary_encode()
        found = list(map(self.known.__getitem__, codes.dictionary.to_numpy(zero_copy_only=False)))
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        # The ids of all parts in turn: a run of flat for each part.
        at = codes.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        ids = flat[np.repeat(starts[at] + sizes[at] - ends, sizes[at]) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[parts.offsets.to_numpy()]
        return [whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _split(texts: Sequence[str]) -> pa.ListArray:
    """Texts, cut where no piece of the pre-tokenizer goes on: before spaces and, if all stand behind letters or digits, marks.

    A text stays whole if a blank stands before a space, as blanks in a row are told apart by what follows them. Texts have no zero bytes.
    """
    given = pa.array(texts, pa.large_string())
    cut = pc.invert(pc.match_substring_regex(given, _BLANK_BEFORE_SPACE))
    marks = pc.and_(cut, pc.invert(pc.match_substring_regex(given, _MARK_BEHIND_NO_LETTER)))
    found = pc.if_else(cut, pc.replace_substring(given, " ", "\0 "), given)
    marked = pc.replace_substring(pc.replace_substring(found, ".", "\0."), ",", "\0,")
    return pc.split_pattern(pc.if_else(marks, marked, found), "\0")


def _parts(text: str) -> list[str]:
    """The parts of one text."""
    return [text] if "\0" in text else _split([text])[0].as_py()


@cache
def encoder(name: str = VOCABULARY) -> Encoder:
    """The encoder of a named public vocabulary, one a worker process."""
    return Encoder(_path(name))


class OrdinaryEncoder:
    """Encodes texts by a vocabulary given as ranks, without added tokens: their strings are ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text (uint32); none for null."""
        return [np.asarray(self.encoding.encode_ordinary(t or ""), np.uint32) for t in texts]


@cache
def ordinary_encoder(name: str = RANKS) -> OrdinaryEncoder:
    """An encoder that never yields an id beyond its ranks, so that such an id can end documents."""
    return OrdinaryEncoder(_path(name))
