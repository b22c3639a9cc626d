"""Token ids of whole texts by the tokenizers library, word by word.

Both vocabularies split text before merging, so a text's ids are the
concatenation of its words' ids where the text is cut at white space that the
library's own split also cuts at. Each task keeps the ids of words it has met
(bounded), and asks the library only for the others, many in one call.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import numpy as np

from .common import one_thread

#: Words remembered per task; beyond it the memory starts anew (results stay the same).
MOST_WORDS = 800_000
#: Words in one string given to the library, which slows down on long ones.
AT_ONCE = 200
#: ASCII punctuation but the apostrophe: after letters, a run of it is one match of both patterns.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


@functools.cache
def _library(path: str):
    one_thread()
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
    return made


def _marked(words: list[str]) -> dict[str, tuple[str, str]]:
    """Of each word of letters and marks after them, both parts."""
    found = ((w, _MARKED.fullmatch(w)) for w in words if not w.isalnum())
    # A letter that is a letter and an accent in lower case or composed form would have the marks join the accent.
    return {w: m.groups() for w, m in found if m and (m[1].isascii() or unicodedata.normalize("NFC", m[1]).lower().isalpha())}


def _stems(words: list[str], parts: dict[str, tuple[str, str]], known: dict[str, bytes]) -> list[str]:
    """The words to ask for: in place of those that end in marks, their stems."""
    rest = set(words).difference(parts)
    rest.update(stem for stem, _ in parts.values() if stem not in known)
    return list(rest)


def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids of each text, without the offsets that the library would else work out."""
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint16).tobytes()


def _join(encoder: ByteLevelWords, parts: dict[str, tuple[str, str]]) -> None:
    """Words that end in marks: their stems' ids, then the marks'."""
    new = list({m for _, m in parts.values()}.difference(encoder.marks))
    encoder.marks.update(zip(new, map(_packed, _ids(encoder.tokenizer, new)), strict=True))
    encoder.known.update((w, encoder.known[stem] + encoder.marks[m]) for w, (stem, m) in parts.items())


class ByteLevelWords:
    """For byte-level BPE whose pattern takes one space before a word.

    A single space between two characters that are no white space always
    starts a new match of that pattern, so texts are cut there.
    """

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        self.heads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.heads[i] = token.startswith("Ġ")
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.odd = re.compile(r"\s\s|\A\s|\s\Z")

    def learn(self, words: list[str]) -> None:
        """Ids of words that each follow a space."""
        parts = _marked(words)
        words = _stems(words, parts, self.known)
        plain = [w for w in words if w.isalnum() or not self.odd.search(w)]
        groups = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        for some, found in zip(groups, _ids(self.tokenizer, [" " + " ".join(g) for g in groups]), strict=True):
            ids = np.array(found, np.uint16)
            starts = np.flatnonzero(self.heads[ids]).tolist()
            if len(starts) == len(some):
                data, ends = ids.tobytes(), [*starts[1:], len(ids)]
                self.known.update(zip(some, (data[2 * a : 2 * b] for a, b in zip(starts, ends, strict=True)), strict=True))
        rest = [w for w in words if w not in self.known]
        self.known.update(zip(rest, map(_packed, _ids(self.tokenizer, [" " + w for w in rest])), strict=True))
        _join(self, parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; null is empty."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
            self.marks.clear()
        pieces = [(t or "").split(" ") for t in texts]
        new = set().union(*(f[1:] for f in pieces)).difference(self.known)
        # Where white space meets white space a space alone may not be cut at.
        bad = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        new -= bad
        tails = {}  # last words that end in white space; they aren't remembered, as elsewhere they may not be cut off
        for i, f in enumerate(pieces):
            if len(f) > 1 and (not f[0] or f[0][-1].isspace() or (bad and not bad.isdisjoint(f[1:]))):
                f = pieces[i] = self.cut.split(texts[i])
                if len(f) > 1 and f[-1][-1].isspace():
                    tails[i] = " " + f.pop()
                new.update(w for w in f[1:] if w not in self.known)
        if new:
            self.learn(list(new))
        ids = list(map(_packed, _ids(self.tokenizer, [*(f[0] for f in pieces), *tails.values()])))
        ends = dict(zip(tails, ids[len(pieces) :], strict=True))
        get = self.known.__getitem__
        return [first + b"".join(map(get, f[1:])) + ends.get(i, b"") for i, (first, f) in enumerate(zip(ids, pieces, strict=False))]


#: An ASCII letter and the marks after it (the apostrophe aside, which may join letters).
_LETTER_MARK = r"([A-Za-z])([!-&(-/:-@\[-`{-~]+)"


def _lowered(text: str | None) -> str:
    """The text in lower case where that is plainly what the library does (Latin-1), so that fewer words differ."""
    text = text or ""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class _Store:
    """Ids of words: a word's row here names its ids among those of all words."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.starts, self.sizes, self.uses = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """words that are new, and their ids end to end."""
        n, m = len(self.rows), len(words)
        while n + m > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m], self.uses[n : n + m] = sizes, 0
        self.used += len(ids)
        self.rows.update(zip(words, range(n, n + m), strict=True))

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' ids end to end, the number of ids of each)."""
        sizes = self.sizes[rows].astype(np.int64)
        places = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.ids[places], sizes

    def thinned(self, most: int) -> _Store:
        """A store of the most used words, at most so many."""
        n = len(self.rows)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[:most])
        words = np.array(list(self.rows), object)[keep]
        out = _Store()
        out.add(words.tolist(), *self.gathered(keep))
        return out


class SpacedWords:
    """For the lower-case vocabulary that drops white space: any white space cuts.

    Texts are cut into words at ASCII white space, and between an ASCII letter
    and the marks after it, which that vocabulary's pattern never joins. Each
    different word is looked up once a batch.
    """

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        self.store = _Store()

    def learn(self, words: list[str]) -> np.ndarray:
        """The rows of words that are new."""
        # A word may hold several pre-tokens; a line of white space can't mark where a word ends, so a marker word stands between.
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        clean = [w for w in words if "\x01" not in w] if len(mark) == 1 else []
        groups = [clean[i : i + AT_ONCE] for i in range(0, len(clean), AT_ONCE)]
        known = self.store.rows
        for some, found in zip(groups, _ids(self.tokenizer, [" \x01 ".join([*g, ""]) for g in groups]), strict=True):
            ids = np.array(found, np.uint16)
            stops = np.flatnonzero(ids == mark[0])
            if len(stops) == len(some):
                self.store.add(some, ids[ids != mark[0]], np.diff(stops, prepend=-1) - 1)
        rest = [w for w in words if w not in known]
        found = _ids(self.tokenizer, rest)
        self.store.add(rest, np.array([i for x in found for i in x], np.uint16), np.array([len(x) for x in found], np.int64))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, the number of ids of each text); null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.store.rows) > MOST_WORDS:
            self.store = self.store.thinned(MOST_WORDS // 2)
        apart = pc.replace_substring_regex(pa.array(map(_lowered, texts), pa.large_string()), _LETTER_MARK, r"\1 \2")
        pieces = pc.ascii_split_whitespace(apart)
        coded = pieces.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.store.rows.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self.learn([words[i] for i in new.tolist()])
        at = np.asarray(coded.indices)
        self.store.uses[rows] += np.bincount(at, minlength=len(words)).astype(np.int32)
        ids, sizes = self.store.gathered(rows[at])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.asarray(pieces.offsets)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, sizes = self.encode_flat(texts)
        ends = np.concatenate([[0], np.cumsum(2 * sizes)]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def words_of(path: str) -> ByteLevelWords | SpacedWords:
    """One encoder per Python worker."""
    kind = SpacedWords if any(t.endswith("</w>") for t in list(_library(path).get_vocab())[:2000]) else ByteLevelWords
    return kind(path)


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """uint32 ids of each text."""
    return [np.frombuffer(x, np.uint16).astype("<u4") for x in words_of(path).encode(texts)]
