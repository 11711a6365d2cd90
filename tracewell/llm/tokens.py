"""Encoding with a public tokenizer inside tasks: whole batches of texts as arrays.

The bytes of a batch are cut into pre-tokens by the classes of their characters, as the patterns of
both supported layouts do (byte-level: one blank goes with the word after it; word-end: lower case,
white space dropped). Arrow finds the distinct pre-tokens; each of those is encoded once by the
library's model and remembered, and the ids of texts are gathered as arrays.

Words with characters beyond Latin (over U+024F) are encoded by the library, one distinct word at a
time; texts with special strings, or with other white space beside blanks, as a whole.

Defined results: a null text is the empty one and has no ids but the end; repeated texts have equal ids;
an array of no texts has none; a text of any length is encoded whole, alone if it is over BATCH bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens remembered by one Python worker, in each of two generations: a full one becomes the
#: old one, from which those that come again are taken over.
WORDS = 150_000
#: Bytes of text that are cut at once; a longer text is a batch by itself.
BATCH = 3_000_000
#: Characters of the longest pre-token that is remembered.
LONGEST = 48

#: Classes of characters: others are those of which the library must be asked.
LETTER, DIGIT, SIGN, SPACE, OTHER = range(5)
#: What the patterns part from a word. Fixed values.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _class_of(c: int) -> int:
    ch = chr(c)
    if c in (9, 10, 13, 32):
        return SPACE
    if c < 32 or 0x7F <= c <= 0xA0 or c > 0x24F or c in (0x130, 0x23A, 0x23E):  # the last three grow in lower case
        return OTHER
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(ch)[0], SIGN)


#: Class and lower case of each character below U+0250.
_CLASS = np.array([_class_of(c) for c in range(0x250)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _class_of(c) == LETTER else c for c in range(0x250)], np.uint16)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + length]``, one after another."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat((start - (ends - length)).astype(np.int32), length)
    at += np.arange(ends[-1], dtype=np.int32)
    return flat[at]


def _starts(length: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])


class Encoder:
    """Ids of whole texts by the tokenizers library, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        conf = json.loads(self.lib.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in conf.get("added_tokens") or []]
        self.kind = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not conf.get("normalizer"):
            self.kind = "byte"
        elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] and (conf["model"].get("end_of_word_suffix") or ""):
            first = pre["pretokenizers"][0]
            if first["invert"] and first["behavior"] == "Removed" and [x["type"] for x in (conf.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.kind = "word"
        letters = _byte_letters()
        self.table, self.blank = {b: letters[b] for b in range(256)}, letters[0x20]
        self.others = re.compile("[" + "".join(map(re.escape, map(chr, np.flatnonzero(_CLASS == OTHER).tolist()))) + "]")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _new(self, p: str) -> bytes | None:
        """Ids of a pre-token that ``known`` lacks; None if they depend on what is around it."""
        got = self.old.get(p)
        if got is None:
            if p.isascii() and p.isalnum():
                mapped = p
            elif p[0] == " " and p.isascii() and p[1:].isalnum():
                mapped = self.blank + p[1:]
            elif max(p) < "\u0250" and not self.others.search(p):
                mapped = p.encode().decode("latin-1").translate(self.table)
            else:
                inner = p[1:] if p[0] == " " else p
                return None if self.kind == "byte" and (not inner or inner[0].isspace() or inner[-1].isspace()) else self._kept(p, self._whole(p))
            got = array("I", [t.id for t in self.lib.model.tokenize(mapped)]).tobytes()
        return self._kept(p, got)

    def _kept(self, p: str, ids: bytes) -> bytes:
        if len(p) <= LONGEST:
            if len(self.known) >= WORDS:
                self.known, self.old = {}, self.known
            self.known[p] = ids
        return ids

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of texts (bytes between ``offsets``) start, and the class of each byte.

        Lower-cases ``data`` for a word-end vocabulary. Each text starts a pre-token.
        """
        byte, kind = self.kind == "byte", _CLASS[np.minimum(data, 0x80)]  # of bytes over 0x7f: other
        two = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        code = ((data[two].astype(np.uint16) & 0x1F) << 6) | (data[two + 1] & 0x3F)
        two, code = two[code < 0x250], code[code < 0x250]
        kind[two] = kind[two + 1] = _CLASS[code]
        if not byte:
            low = (data >= 65) & (data <= 90)
            data[low] |= 32
            code = _LOWER[code]
            data[two], data[two + 1] = 0xC0 | (code >> 6), 0x80 | (code & 0x3F)
        begin = offsets[:-1][np.diff(offsets) > 0]
        first = np.zeros(len(data) + 1, bool)  # of texts
        first[begin] = True
        start = first.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        if byte:
            # the last of a run of white space stands alone, and a blank goes with what follows
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
            start[last] = True
            blank = last[data[last] == 32]
            start[blank + 1] = False
        else:
            digits = kind == DIGIT
            digits &= (data & 0xC0) != 0x80
            start[:-1] |= digits
        self._endings(data, start, first)
        if (kind == OTHER).any():
            # a word with other characters is one piece, with its blank before it
            edge = first.copy()
            edge[1:-1] |= space[1:] != space[:-1]
            if byte:
                edge[last] = True
                edge[blank + 1] = False
            word = np.cumsum(edge[:-1], dtype=np.int32)
            mixed = np.zeros(int(word[-1]) + 1, bool)
            mixed[word[kind == OTHER]] = True
            mixed = mixed[word]
            start[:-1] = (start[:-1] & ~mixed) | (edge[:-1] & mixed)
        return np.flatnonzero(start[:-1]), kind

    def _endings(self, data: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
        """Parts 's and the like: at an apostrophe that starts a pre-token."""
        mark = np.flatnonzero((data == 39) & start[:-1])
        if not len(mark):
            return
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        same = [~first[np.minimum(mark + k, len(data))] & (mark + k < len(data)) for k in (1, 2)]
        for e in _ENDINGS:
            hit = same[0] & (ahead[mark + 1] == e[0])
            if len(e) == 2:
                hit &= same[1] & (ahead[mark + 2] == e[1])
            at = mark[hit]
            start[at + 1] = False
            start[at + 1 + len(e)] = True

    def _batch(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n, buffers = len(texts), texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not self.kind or not len(data):
            starts, whole = np.zeros(n + 1, np.int64), np.arange(n)
        else:
            data = data if self.kind == "byte" else data.copy()
            at, kind = self._cut(data, offsets)
            bounds = np.append(at, len(data)).astype(np.int32)
            coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            if self.kind == "word":
                solid = kind[at] != SPACE
                which, at = which[solid], at[solid]
            of_text = np.searchsorted(at, offsets)
            ids = list(map(self.known.get, names))
            bad = []
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self._new(names[i]) if self.kind == "byte" or names[i].strip(" \t\n\r") else b""
                    if ids[i] is None:
                        ids[i] = b""
                        bad.append(i)
            special = np.zeros(n, bool)
            for s in self.special:
                special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            if bad:
                special |= np.diff(_starts(np.isin(which, bad))[of_text]) > 0
            whole = np.flatnonzero(special)
            size = np.append(np.fromiter(map(len, ids), np.int32, len(ids)) >> 2, np.int32(len(end)))
            first = _starts(size)[:-1].astype(np.int32)
            # the end of each text is a pre-token of its own
            which = np.insert(which, of_text[1:], len(size) - 1)
            own = size[which]
            ids = gathered(np.frombuffer(b"".join(ids) + np.array(end, "<u4").tobytes(), "<u4"), first[which], own)
            starts = _starts(own)[of_text + np.arange(n + 1)]
        if len(whole):
            got = dict(zip(whole.tolist(), (np.append(np.frombuffer(self._whole(t), "<u4"), np.array(end, "<u4")) for t in texts.take(pa.array(whole)).to_pylist())))
            each = [got[i] if i in got else ids[starts[i] : starts[i + 1]] for i in range(n)]
            ids, starts = np.concatenate(each), _starts(np.array([len(x) for x in each]))
        return ids, starts

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of strings one after another, each text with ``end_id`` after it, and
        where each text's ids start (and the last's end). A null text is the empty one.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        end = [] if end_id is None else [end_id]
        size = _starts(np.asarray(pc.binary_length(texts)).astype(np.int64) + 1)
        ids, starts, at = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, size[at] + BATCH, "right")) - 1)
            got, where = self._batch(texts.slice(at, stop - at), end)
            ids.append(got)
            starts.append(where[1:] + starts[-1][-1])
            at = stop
        return np.concatenate(ids), np.concatenate(starts)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]


def width_of(enc: Encoder, end_id: int) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary fit in them."""
    return 2 if max(enc.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a worker; path as the executors see it."""
    return Encoder(path)


def vocabulary(name_or_path: str) -> str:
    """The path of a vocabulary file: as given, or that of an installed public one, by its name."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
