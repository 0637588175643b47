"""Cut whole batches of text into the pre-tokens of a public tokenizer with array operations.

The classes of characters (letter, digit, space, other) are not taken from a Unicode table of ours: each code point is
shown once to the tokenizer's own pre-tokenizer. Texts in which a special token's string occurs, or which the normaliser
changes by more than lower case, are left to the library as a whole.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lapwing.llm import arrays as A

LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 4
#: Suffixes that both pre-tokenizers cut off after an apostrophe.
CONTRACTIONS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
CUT = "\uffff"  # a noncharacter; texts that hold it are left to the library
POINTS = 0x110000
#: Byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bounds of a task's dictionary of distinct pre-tokens; it is made anew beyond them.
KNOWN_PRETOKENS, KNOWN_BYTES = 1_000_000, 64 << 20


class PreTokens:
    """Pre-tokens of a byte-level tokenizer that keeps spaces, or of one that drops them and lower-cases."""

    def __init__(self, path: str, drops_space: bool):
        self.tokenizer, self.drops_space = Tokenizer.from_file(path), drops_space
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.lower = np.zeros(POINTS, np.uint8), np.arange(POINTS, dtype=np.uint32)
        self.odd = np.zeros(POINTS, bool)
        self.odd[ord(CUT)] = True
        self.met_odd = False
        rest = [b for b in range(256) if b not in PRINTABLE]
        self.letters = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known: dict = {}
        self.known_bytes = 0

    def learn(self, points: np.ndarray) -> None:
        """Class and lower case of code points seen for the first time, as the library has them."""
        cut = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        for point in np.unique(points[self.kind[points] == 0]).tolist():
            c = chr(point)
            self.met_odd |= bool(self.odd[point])
            if self.drops_space:
                plain = self.tokenizer.normalizer.normalize_str(f"a{c}a")[1:-1]
                if len(plain) != 1:
                    self.odd[point] = self.met_odd = True
                else:
                    self.lower[point] = ord(plain)
                    c = plain
            if self.drops_space:
                space = cut(c) == 0
                self.kind[point] = SPACE if space else LETTER if cut(f"z{c}") == 1 else OTHER if cut(f"#{c}") == 1 else DIGIT
            else:
                # a space before a letter joins it only if it is no longer run of white space
                self.kind[point] = LETTER if cut(f"z{c}") == 1 else DIGIT if cut(f"1{c}") == 1 else OTHER if cut(f"#{c}") == 1 else SPACE

    def split(self, token: str) -> list:
        """Pieces of one pre-token, from the library's model."""
        return self.model.tokenize(token.encode().decode("latin-1").translate(self.letters))

    def forget(self) -> bool:
        """Empty a dictionary that has grown to its bound, in entries or in bytes."""
        full = len(self.known) > KNOWN_PRETOKENS or self.known_bytes > KNOWN_BYTES
        if full:
            self.known.clear()
            self.known_bytes = 0
        return full

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
        """Distinct pre-tokens of some texts, the number of each pre-token of all texts in a row, how many each text has,
        and texts left to the library (with none here)."""
        raw, offsets = A.joined(texts)
        whole = raw.tobytes()
        left = set()
        for mark in self.special:
            mark, at = mark.encode(), -1
            while (at := whole.find(mark, at + 1)) >= 0:
                left.add(int(np.searchsorted(offsets, at, "right")) - 1)
        string = whole.decode()
        points = np.frombuffer(string.encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            starts = offsets
        else:
            heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            starts = heads[offsets]
        n = len(starts) - 1
        kind = self.kind[points]
        if (fresh := kind == 0).any():
            self.learn(points[fresh])
            kind = self.kind[points]
        if self.drops_space and points.max(initial=0) >= 0x300 and not unicodedata.is_normalized("NFC", string):
            high = np.add.reduceat(np.r_[points >= 0x300, False].astype(np.int64), starts[:-1])
            for i in np.flatnonzero((high > 0) & (np.diff(starts) > 0)).tolist():
                if not unicodedata.is_normalized("NFC", string[starts[i] : starts[i + 1]]):
                    left.add(i)
        if self.met_odd and self.odd[points].any():
            left |= set((np.searchsorted(starts, np.flatnonzero(self.odd[points]), "right") - 1).tolist())
        if self.drops_space:
            points = self.lower[points]
        # a special string may stand across two texts of the row: it is found in none of them then
        for i in [i for i in left if i >= n]:
            left.discard(i)
        head = np.zeros(len(points) + 1, bool)
        head[starts] = True
        changes = head[:-1].copy()
        changes[1:] |= kind[1:] != kind[:-1]
        token = self._dropping(points, kind, changes, head) if self.drops_space else self._keeping(points, kind, changes, head)
        if left:
            gone = np.zeros(n, bool)
            gone[list(left)] = True
            inside = np.repeat(gone, np.diff(starts))
        keep = np.ones(len(points), bool)
        if self.drops_space:
            keep = kind != SPACE
        if left:
            keep &= ~inside
        token &= keep
        summed = np.r_[0, np.cumsum(token)]
        count = summed[starts[1:]] - summed[starts[:-1]]
        kept, heads = points[keep], np.flatnonzero(token[keep])
        data = kept.tobytes().decode("utf-32-le").encode()
        if len(data) == len(kept):
            bounds = np.append(heads, len(kept))
        else:  # UTF-8 bytes before each code point
            width = np.ones(len(kept), np.int64)
            for least in (0x80, 0x800, 0x10000):
                width += kept >= least
            bounds = np.r_[0, np.cumsum(width)][np.append(heads, len(kept))]
        every = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        return every.dictionary.to_pylist(), every.indices.to_numpy(zero_copy_only=False), count, sorted(left)

    def _contracted(self, points, token, ends) -> None:
        """Where a token begins with an apostrophe and one of the suffixes: the two are one token."""
        at = np.flatnonzero(token & (points == ord("'")))
        for suffix, size in CONTRACTIONS.items():
            near = at[at + size < len(points)]
            same = np.ones(len(near), bool)
            for k, c in enumerate(suffix):
                same &= (points[near + 1 + k] == ord(c)) & ~ends[near + 1 + k]
            hit = near[same]
            token[hit + 1] = False
            past = hit[hit + size + 1 < len(points)] + size + 1
            token[past] = True

    def _dropping(self, points, kind, changes, head) -> np.ndarray:
        """Each digit and each run of letters or of others is a token; spaces are none."""
        token = (changes | (kind == DIGIT)) & (kind != SPACE)
        self._contracted(points, token, head)
        return token

    def _keeping(self, points, kind, changes, head) -> np.ndarray:
        """A blank before a run joins it; of other white space before a run, the last character stands alone."""
        space = kind == SPACE
        joins = np.zeros(len(points), bool)  # run starts that take the blank before them
        joins[1:] = changes[1:] & ~space[1:] & (points[:-1] == 32) & ~head[1:-1]
        token = changes & ~joins
        last = np.zeros(len(points), bool)  # last of a white space run that a text goes on after
        last[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
        token |= last
        self._contracted(points, token, head)
        return token


class Counter(PreTokens):
    """Number of pieces of each pre-token, asked of the library's model once for each distinct one."""

    def __init__(self, path: str, drops_space: bool):
        super().__init__(path, drops_space)
        self.pieces = np.zeros(0, np.int64)

    def codes(self, distinct: list[str]) -> np.ndarray:
        """Code of each of some distinct pre-tokens; the pieces of new ones are counted."""
        if self.forget():
            self.pieces = np.zeros(0, np.int64)
        if new := [t for t in distinct if t not in self.known]:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.known_bytes += sum(map(len, new))
            self.pieces = np.concatenate([self.pieces, np.fromiter((len(self.split(t)) for t in new), np.int64, len(new))])
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def counts(self, texts: pa.Array) -> np.ndarray:
        distinct, token, count, left = self.cut(texts)
        code = self.codes(distinct)[token]
        # frequency of each distinct pre-token in each document, joined to its pieces
        width = max(len(self.known), 1)
        both, frequency = np.unique(np.repeat(np.arange(len(count)), count) * width + code, return_counts=True)
        doc, code = np.divmod(both, width)
        out = np.bincount(doc, weights=self.pieces[code] * frequency, minlength=len(count)).astype(np.int64)
        for i in left:
            out[i] = len(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out


class Encoder(PreTokens):
    """Ids of whole texts, put together from the ids of their pre-tokens."""

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        distinct, token, count, left = self.cut(texts)
        self.forget()
        for t in distinct:
            if t not in self.known:
                self.known[t] = array("I", [p.id for p in self.split(t)]).tobytes()
                self.known_bytes += len(t) + len(self.known[t])
        parts = list(map(self.known.__getitem__, distinct))
        # the ids of the distinct pre-tokens in a row, and from them those of all pre-tokens
        flat, size = np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first, own = np.cumsum(size) - size, size[token]
        sizes = np.r_[0, np.cumsum(own)]
        ids = flat[np.repeat(first[token] - sizes[:-1], own) + np.arange(sizes[-1])]
        ends = np.cumsum(count)
        out = sizes[ends] - sizes[ends - count]
        if not left:
            return ids, out
        pieces, at = [], 0
        for i in range(len(out)):
            if i in left:
                own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                out[i] = len(own)
            else:
                own = ids[at : at + out[i]]
                at += out[i]
            pieces.append(own)
        return np.concatenate(pieces) if pieces else ids, out
