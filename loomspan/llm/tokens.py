"""Exact byte-pair encoding in tasks: pieces between safe cuts are encoded once and remembered.

A vocabulary file of the tokenizers library says what each text's ids are.  A column of texts is cut
at spaces; each different piece of a slice of it is encoded once, all of them in one call, and the ids
of the texts are gathered from that table.  Pieces go to a rank-based encoder over the same
vocabulary, or to the library itself if they hold anything unusual.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: The pre-tokenisation patterns that the two vocabulary files name.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(WORD_PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
#: Pieces of other characters than these are left to the library.
_PLAIN = re.compile(r"[\n\t -~À-ɏ‐-‧]*")
_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_UNUSUAL = r"[^ -~À-ɏ‐-‧]|<\|"
REMEMBERED = 50_000
#: Bytes of texts whose pieces are encoded together.
SLICE = 8_000_000
#: Unsplit pieces of more characters are encoded in halves.
LEAF = 4_096


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> little-endian 32-bit ids; fills itself, and starts anew when it is full."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(self.before + piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """ids of whole texts as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = _byte_chars()
        end = spec["model"].get("end_of_word_suffix") or ""
        # Lower-cased text has no "A": where words have an end sign, that byte stands for it.
        self.word_ends = bool(end)
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            stem = token.removesuffix(end) if end else token
            ranks[bytes(chars[c] for c in stem) + (b"A" if end and token.endswith(end) else b"")] = i
        pattern = "\n|[^A\n]*A" if self.word_ends else BYTE_PATTERN
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if not self.word_ends:
            self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
            for raw, i in ranks.items():
                self.bytes_of[i] = raw
            for text, i in self.special.items():
                self.bytes_of[i] = text.encode()
        self.words = regex.compile(WORD_PATTERN)
        self.line = self.ranked.encode_ordinary("\n")[0]
        self.first = _Pieces(self._piece, "")
        self.later = self.first if self.word_ends else _Pieces(self._piece, " ")

    def _piece(self, piece: str) -> list[int]:
        simple = piece.isascii() and piece.isprintable()
        if "<|" in piece or not (simple or _PLAIN.fullmatch(piece)):
            return self.library.encode(piece, add_special_tokens=False).ids
        if self.word_ends:
            words = _ASCII_WORDS.findall(piece.lower()) if simple else self.words.findall(unicodedata.normalize("NFC", piece).lower())
            return self.ranked.encode_ordinary("".join(f"{w}A" for w in words)) if words else []
        if len(piece) > LEAF:
            return join_tree([self.ranked.encode_ordinary(x) for x in halves(piece, LEAF)], self)
        return self.ranked.encode_ordinary(piece)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers.

        A space behind a visible character always begins a new pre-token, so the pieces between
        such spaces are encoded one by one.
        """
        if not text:
            return b""
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        if len(parts) == 1:
            return self.first[text]
        later = self.later.__getitem__
        return b"".join([self.first[parts[0]], *map(later, parts[1:])])

    def _pieces(self, pieces: pa.Array, ascii_only: bool) -> list[np.ndarray]:
        """ids of usual pieces, each behind a space, as one array, and how many each has."""
        if self.word_ends:
            joined = "\n".join(pieces.to_pylist()).lower()
            joined = _ASCII_WORDS.sub(r"\g<0>A", joined) if ascii_only else self.words.sub(r"\g<0>A", joined)
            # what is no word, white space aside from line ends, is not in these pieces
            joined += "\n"
        else:
            joined = " " + "\n ".join(pieces.to_pylist()) + "\n"
        ids = self.ranked.encode_to_numpy(joined, disallowed_special=())
        ends = np.flatnonzero(ids == self.line)
        return [np.delete(ids, ends), np.diff(ends, prepend=-1) - 1]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """``encode_bytes`` of every text of an Arrow column."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
            out += self._encode_slice(texts.slice(i, j - i))
            i = j
        return out

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        whole = texts.to_pylist()
        split = pc.split_pattern(texts, " ")
        flat, starts = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        coded = flat.dictionary_encode()
        at, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        unusual = pc.match_substring_regex(pieces, _UNUSUAL).to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
        long = pc.binary_length(pieces).to_numpy(zero_copy_only=False) > LEAF
        ids, size, first = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        held = 0
        for ascii_only in (True, False):
            own = np.flatnonzero(~unusual & ~long & (plain == ascii_only))
            if len(own):
                found, n = self._pieces(pieces.take(pa.array(own)), ascii_only)
                ids.append(found)
                size[own], first[own] = n, held + np.cumsum(n) - n
                held += len(found)
        # pieces that only begin texts are encoded without a space before them, below
        later = np.ones(len(flat), bool)
        later[starts[:-1]] = False
        needed = np.zeros(len(pieces), bool)
        needed[at[later]] = True
        for k in np.flatnonzero((unusual | long) & (needed | self.word_ends)).tolist():
            found = np.frombuffer(self.later[pieces[k].as_py()], np.uint32)
            ids.append(found)
            size[k], first[k], held = len(found), held, held + len(found)
        if not self.word_ends:
            heads = [np.frombuffer(self.first[p] if p else b"", np.uint32) for p in flat.take(pa.array(starts[:-1])).to_pylist()]
            n = np.array([len(h) for h in heads], np.int64)
            at[starts[:-1]] = len(size) + np.arange(len(heads))
            size, first = np.append(size, n), np.append(first, held + np.cumsum(n) - n)
            ids += heads
        table = np.concatenate([np.zeros(0, np.uint32), *ids])
        n = size[at]
        begin = np.append(0, np.cumsum(n))
        raw = table[np.repeat(first[at] - begin[:-1], n) + np.arange(begin[-1])].tobytes()
        cut = 4 * begin[starts]
        # where a space follows white space, pieces do not begin at every space
        return [self.encode_bytes(t) if _ODD.search(t) else raw[a:b] for t, a, b in zip(whole, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False) for byte-level vocabularies."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def halves(text: str, most: int) -> list[str]:
    """Cut a text into halves again and again until none has more than ``most`` characters."""
    if len(text) <= most:
        return [text]
    return halves(text[: len(text) // 2], most) + halves(text[len(text) // 2 :], most)


def join_tree(leaves: list, encoder: Encoder) -> list[int]:
    """Join neighbouring leaves' ids pairwise, level by level."""
    leaves = [list(x) for x in leaves]
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1], encoder) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


_GUARD = 4


def join(left: list[int], right: list[int], encoder: Encoder) -> list[int]:
    """ids of the texts of ``left`` and ``right`` in one, from the ids of each.

    A window around the join is encoded again and grows until its result agrees with both sides.
    With a safe cut (a space behind a visible character) on each side, everything outside the cuts is
    exact, because no pre-token crosses them.  Where one side has none, the text around the join is one
    unsplit piece; if it is a single run of letters, one of digits or one of symbols, a sequence is
    its encoding if and only if each pair of neighbours is, so ids that agree at both edges prove it.
    Otherwise the window grows to the whole of both sides.
    """
    if not left or not right:
        return left or right
    k = 16
    while True:
        a, b = left[-k:], right[:k]
        whole = len(a) == len(left) and len(b) == len(right)
        try:
            heads = [encoder.bytes_of[i] for i in a]
            tails = [encoder.bytes_of[i] for i in b]
            text = b"".join(heads + tails).decode("utf-8")
        except UnicodeDecodeError:
            if whole:
                raise
            k *= 2
            continue
        if whole:
            return encoder.ranked.encode_ordinary(text) if "<|" not in text else encoder.library.encode(text, add_special_tokens=False).ids
        i = next((j for j in range(1, len(a)) if heads[j][:1] == b" " and _visible(heads[j - 1])), 0 if len(a) == len(left) else None)
        j = next((j for j in range(len(b) - 1, 0, -1) if tails[j][:1] == b" " and _visible(tails[j - 1])), len(b) if len(b) == len(right) else None)
        if i is not None and j is not None:
            middle = b"".join(heads[i:] + tails[:j]).decode("utf-8")
            new = encoder.encode(middle).tolist() if k < 4 * LEAF else encoder.ranked.encode_ordinary(middle)
            return left[: len(left) - len(a) + i] + new + right[j:]
        if _RUN.fullmatch(text):
            new = encoder.ranked.encode_ordinary(text)
            if (len(a) == len(left) or new[:_GUARD] == a[:_GUARD]) and (len(b) == len(right) or new[-_GUARD:] == b[-_GUARD:]):
                before, after = (encoder.bytes_of[left[-k - 1]] if len(left) > k else b""), (encoder.bytes_of[right[k]] if len(right) > k else b"")
                if _same_run(before, text, after):
                    return left[: len(left) - len(a)] + new + right[len(b) :]
        k *= 2


#: A single pre-token's inside: only letters, only digits.
_RUN = regex.compile(r"\p{L}+|\p{N}+")


def _same_run(before: bytes, text: str, after: bytes) -> bool:
    """Whether the neighbouring tokens continue the window's run, or there are none."""
    kind = r"\p{L}+" if regex.fullmatch(r"\p{L}+", text) else r"\p{N}+"
    return all(not x or regex.fullmatch(kind, x.decode("utf-8", "replace").strip(" ")) for x in (before, after))


def _visible(raw: bytes) -> bool:
    """Whether a token surely ends in a character that is not white space."""
    return raw[-1:].isalnum() or raw[-1:] in b".,;:!?)(\"'-/"


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)
