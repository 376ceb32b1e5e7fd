"""Token ids of whole texts by a tokenizer file, with a cache of pre-tokens in each Python worker.

Byte-level BPE never merges across the start of white space that follows a visible character, so a
text may be cut there and the pieces encoded alone, with the ids of the whole text as their
concatenation. A special token that a piece contains is found as in the whole text. Where the pre-tokenizer's
pattern also parts letters from symbols, the symbols at a piece's end are encoded apart from it, as words
repeat more often without them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizer's patterns see it; str.isspace() also counts \x1c to \x1f.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PIECES = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD = rf"(?:^|[{_SPACE}])\z"
#: Symbols, without the apostrophe, that no pattern of _APART takes together with a letter or a digit; letters, one each in capitals and small ones, that may stand before them.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE, _LETTERS = r"[A-Za-z0-9À-ÖØ-öø-ÿ]\z", r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: Fixed value: a pattern of pre-tokens, as a tokenizer file has it.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Texts joined for one encoding; much longer ones take more time a text.
_RUN = 64


def _token_bytes(tokenizer, rules: dict) -> np.ndarray | None:
    """Bytes of text behind each id, if ids give back any text without special tokens byte for byte; else None."""
    cut, model = rules["pre_tokenizer"] or {}, rules["model"]
    plain = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True)
    affixes = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
    if rules["normalizer"] or not plain or model["type"] != "BPE" or any(affixes):
        return None
    width = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        width[i] = len(token)  # a byte is one character of a byte-level token
    return width


def _splits_words(rules: dict) -> bool:
    """Whether the pre-tokenizer drops white space and cuts what is left by _APART, after which bytes stand for themselves."""
    cut = rules["pre_tokenizer"] or {}
    found = cut.get("pretokenizers", [])
    if cut.get("type") != "Sequence" or [x["type"] for x in found] != ["Split", "ByteLevel"]:
        return False
    split, after = found
    return split["pattern"] == {"Regex": _APART} and split["behavior"] == "Removed" and split["invert"] and not after["add_prefix_space"] and not after["use_regex"]


def _lowers(rules: dict) -> bool:
    """Whether the normalizer leaves a word of small _LETTERS as it is, and any other of _LETTERS in small ones."""
    found = (rules["normalizer"] or {}).get("normalizers", [])
    return found == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def pieces(text: str) -> list[str]:
    """text cut where white space follows a visible character."""
    return _PIECES.findall(text)


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _marks(holds: pa.Array) -> np.ndarray:
    return holds.to_numpy(zero_copy_only=False)


class PieceEncoder:
    """Ids of texts; full: bytes that the cache may hold, with about 150 for each piece beside its own.

    The usual case is a text whose words one blank separates: it is cut at the blanks, and a cut piece
    stands for itself with the blank before it. A text with other white space before a blank is cut
    by a pattern instead.
    """

    def __init__(self, path: str, full: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[0] if self.special else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())
        self.width = _token_bytes(self.tokenizer, rules)
        self.apart = self.width is not None or _splits_words(rules)
        self.small, self.ends = None, None  # a tokenizer of words in small letters, and the ids that end a word
        if _splits_words(rules) and _lowers(rules) and rules["model"].get("end_of_word_suffix"):
            self.small = Tokenizer.from_str(json.dumps(rules | {"normalizer": None}))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.full, self.known, self.held = full, {}, 0

    def encode(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of short texts. One call serves many that are joined.

        Where tokens have fixed bytes, texts that begin with white space and end visibly are joined as they
        are, and ids belong to the text that holds their bytes. Between other texts a special token stands.
        """
        joined, marked = [], texts
        if self.width is not None:
            joined, marked = [], []
            for x in texts:
                (joined if x and x[0] in _SPACE and x[-1] not in _SPACE else marked).append(x)
        return self._encode_joined(joined) | self._encode_marked(marked)

    def _runs(self, texts: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray | None]]:
        """Texts in parts with the ids of each part, joined in runs; no ids for a part that holds a special token."""
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            whole = "".join(part)
            if any(s in whole for s in self.special):
                yield part, None
                continue
            runs = [between.join([*part[j : j + _RUN], ""]) for j in range(0, len(part), _RUN)]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            yield part, np.fromiter(chain.from_iterable(each), self.dtype)

    def _one_by_one(self, texts: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {x: np.array(e.ids, dtype=self.dtype).tobytes() for x, e in zip(texts, found, strict=True)}

    def _encode_joined(self, texts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for part, ids in self._runs(texts, ""):
            if ids is None:
                out |= self._one_by_one(part)
                continue
            stops = np.cumsum(np.asarray(pc.binary_length(pa.array(part))))
            reached = np.cumsum(self.width[ids])
            ends = np.searchsorted(reached, stops, "right")
            if not np.array_equal(reached[ends - 1], stops):
                raise ValueError("tokens' bytes don't add up to the text's")
            body, start = ids.tobytes(), 0
            for x, end in zip(part, (ends * self.dtype.itemsize).tolist(), strict=True):
                out[x] = body[start:end]
                start = end
        return out

    def _encode_marked(self, texts: list[str]) -> dict[str, bytes]:
        if self.mark is None:
            return self._one_by_one(texts)
        out: dict[str, bytes] = {}
        mark, size = self.tokenizer.token_to_id(self.mark), self.dtype.itemsize
        for part, ids in self._runs(texts, self.mark):
            if ids is None:
                out |= self._one_by_one(part)
                continue
            body, start = ids.tobytes(), 0
            for x, end in zip(part, (np.flatnonzero(ids == mark) * size).tolist(), strict=True):
                out[x] = body[start:end]
                start = end + size
        return out

    def _encode_words(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of blanks with a word of small letters each: one id ends a word, so that they need no marks between them."""
        out: dict[str, bytes] = {}
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            runs = ["".join(part[j : j + _RUN]) for j in range(0, len(part), _RUN)]
            each = [e.ids for e in self.small.encode_batch_fast(runs, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(each), self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(part):
                raise ValueError("words' ends don't add up to the words")
            body, start = ids.tobytes(), 0
            for x, end in zip(part, ends.tolist(), strict=True):
                out[x] = body[start:end]
                start = end
        return out

    def looked_up(self, texts: list[str], words: bool = False) -> list[bytes]:
        """Ids of distinct short texts, from the cache or new; new ones are kept until it is full. words: each is a blank and a word of small letters."""
        out = list(map(self.known.get, texts))
        new = [i for i, x in enumerate(out) if x is None]
        found = (self._encode_words if words else self.encode)([texts[i] for i in new])
        for i in new:
            out[i] = found[texts[i]]
        size = 150 * len(found) + 2 * sum(map(len, found)) + sum(map(len, found.values()))
        if self.held + size <= self.full:
            self.known |= found
            self.held += size
        return out

    def _after_blanks(self, names: pa.Array) -> list[bytes]:
        """Ids of each of distinct names with a blank before it."""
        if not self.apart:
            return self.looked_up([" " + x for x in _strings(names)])
        stems, tails = self._parted(names)
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        own = pc.binary_join_element_wise(pa.scalar(" ", stems.dictionary.type), stems.dictionary, pa.scalar("", stems.dictionary.type))
        if self.small is None:
            found = self.looked_up(_strings(own))
        else:
            word, found = _marks(pc.match_substring_regex(stems.dictionary, _LETTERS)), np.empty(len(own), object)
            small = pc.utf8_lower(own.filter(pa.array(word))).dictionary_encode()
            each = np.array([*self.looked_up(_strings(small.dictionary), words=True), None], object)
            found[word] = each[np.asarray(small.indices)]
            found[~word] = np.array([*self.looked_up(_strings(own.filter(pa.array(~word)))), None], object)[:-1]
        stem, tail = (np.array([*x, None], object)[np.asarray(at.indices)].tolist() for x, at in ((found, stems), (self.looked_up(_strings(tails.dictionary)), tails)))
        return list(map(add, stem, tail))

    def _parted(self, names: pa.Array) -> tuple[pa.Array, pa.Array]:
        """names without the symbols at their end, and those symbols: none where no letter or digit stands before them or the name holds a special token."""
        names = names.cast(pa.large_string())
        stems = pc.utf8_rtrim(names, characters=_SYMBOLS)
        fit = _marks(pc.match_substring_regex(stems, _BEFORE))
        for s in self.special:
            fit &= ~_marks(pc.match_substring(names, s))
        stems = pc.if_else(pa.array(fit), stems, names)
        size = np.asarray(pc.binary_length(names)) - np.asarray(pc.binary_length(stems))
        ends, n = np.cumsum(size), len(names)
        after = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + n + 1][1:] - size
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[np.repeat(after - (ends - size), size) + np.arange(size.sum())]
        return stems, pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per piece of all texts the index of its ids in the list; per text the index of its first piece."""
        cut = pc.split_pattern(texts, " ")
        first = np.asarray(cut.offsets).astype(np.int64)
        first -= first[0]
        named = cut.flatten().dictionary_encode()
        code, names = np.asarray(named.indices).astype(np.int64), named.dictionary
        odd = _marks(pc.match_substring_regex(names, _ODD))[code]
        empty = (np.asarray(pc.binary_length(names)) == 0)[code]
        odd[first[1:] - 1] = False  # nothing follows the last piece
        odd[first[:-1]] &= ~empty[first[:-1]]  # nor does an empty first one hold white space
        irregular = np.flatnonzero(np.logical_or.reduceat(odd, first[:-1]))
        heads = _strings(names.take(pa.array(code[first[:-1]])))
        ids = self._after_blanks(names)
        code[first[:-1]] = len(ids) + np.arange(len(heads))
        unique = list(dict.fromkeys(heads))
        ids += map(dict(zip(unique, self.looked_up(unique), strict=True)).__getitem__, heads)
        if len(irregular):
            parts, at, sizes = [], 0, np.diff(first)
            for i in irregular.tolist():
                own = pieces(texts[i].as_py())
                unique = list(dict.fromkeys(own))
                place = dict(zip(unique, range(len(ids), len(ids) + len(unique)), strict=True))
                ids += self.looked_up(unique)
                parts += [code[at : first[i]], np.array([place[x] for x in own], np.int64)]
                at, sizes[i] = first[i + 1], len(own)
            code = np.concatenate([*parts, code[at:]])
            first = np.concatenate([[0], np.cumsum(sizes)])
        return code, first, ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text of an array without nulls."""
        if not len(texts):
            return np.zeros(0, np.int64)
        code, first, ids = self._cut(texts)
        each = np.array([len(x) for x in ids], np.int64)[code] // self.dtype.itemsize
        return np.add.reduceat(each, first[:-1])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an array without nulls, and where each text's begin, with the end of the last."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        code, first, ids = self._cut(texts)
        pool = np.frombuffer(b"".join(ids), self.dtype)
        size = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        start = np.cumsum(size) - size
        each = size[code]
        ends = np.cumsum(each)
        out = pool[np.repeat(start[code] - (ends - each), each) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends[first[1:] - 1]])


@lru_cache(maxsize=4)
def worker_encoder(path: str, full: int = 48 << 20) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs, so that its cache outlives a task."""
    return PieceEncoder(path, full)
