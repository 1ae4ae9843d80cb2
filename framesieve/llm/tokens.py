"""Tokenisation of whole texts with the public vocabularies.

A BPE vocabulary of the two kinds used here never merges across the borders that its own pre-tokeniser draws, so the ids
of a text are those of its chunks in a row, and each distinct chunk is encoded once per worker.  Letters followed by
punctuation go to the library's merges directly, all other chunks through its pre-tokeniser too; texts with white space
or control strings that the split below does not treat exactly as the library does go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that only some engines count as such, and the start of control strings, in UTF-8.
_ODD = re.compile(
    rb"[\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|"
)
#: A blank and what follows it, white space before more white space, white space.
_BYTE_CHUNKS = re.compile(rb" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Letters of ASCII and Latin-1, then ASCII punctuation but the apostrophe: two pre-tokens at most.
_PLAIN = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)?( ?[!-&(-/:-@\[-`{-~]+)?")


#: Texts that are split by the rules above instead of at every single blank: blanks or line feeds in a row, a blank at an
#: end, a mark that may belong to what stands before it, and the control that stands for no blank below.
_UNEVEN_MARK = r"[^\p{L}\p{N}][.,][ \n]|\x01"
_UNEVEN = r"[ \n][ \n]| $|" + _UNEVEN_MARK
GLUE = "\x01"

#: GLUE or none, a word of letters as above, marks or none.
_STEM = re.compile(rb"(\x01?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)[!-&(-/:-@\[-`{-~]*")
#: New words that go to the library's merges in one call.
TOGETHER = 32

_MARKS = frozenset((b".", b",", b";", b":", b"!", b"?", b")"))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids by chunk; what is missing is learnt.  lead stands before every key's text.

    A word with a mark behind it is put together from both, so that the table holds words only.
    """

    def __init__(self, coder: ChunkEncoder, lead: bytes):
        super().__init__()
        self.coder, self.lead, self.shown = coder, lead, "\u0120" if lead else ""

    def __missing__(self, chunk: bytes) -> bytes | None:
        coder = self.coder
        if chunk.isalpha():
            text = chunk.decode() if coder.byte_level else chunk.decode().lower()
            ids = array(coder.code, [t.id for t in coder.merges.tokenize(self.shown + text)]).tobytes()
        elif chunk[:1] == b"\x01" and self.lead:
            ids = coder.first[chunk[1:]]
        elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + coder.first[chunk[-1:]]
        else:
            ids = coder.learn(self.lead + chunk)
        if len(chunk) <= coder.max_chunk_bytes and (b"\n" not in chunk or not chunk.strip(b"\n")):
            self[chunk] = ids
        return ids

    def of(self, chunks: list[bytes]) -> list[bytes | None]:
        """What self[chunk] gives for each; new words are learnt many at a time."""
        ids = list(map(self.get, chunks))
        fresh = [n for n, x in enumerate(ids) if x is None]
        if self.lead and self.coder.apart:
            self.coder.learn_words([chunks[n] for n in fresh])
        for n in fresh:
            ids[n] = self[chunks[n]]
        return ids


class ChunkEncoder:
    """Encodes texts given as UTF-8; keeps the ids of at most max_chunks distinct chunks, of max_chunk_bytes each."""

    def __init__(self, path: str, byte_level: bool, max_chunks: int = 400_000, max_chunk_bytes: int = 60):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.byte_level = byte_level
        self.max_chunks, self.max_chunk_bytes = max_chunks, max_chunk_bytes
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        #: By what stands before each of many words: the ids whose text begins with it.  They part the words again, as long as
        #: no entry holds a blank behind letters, or letters and a line feed.
        self.leading = {sign: np.zeros(1 + max(vocabulary.values()), bool) for sign in b" \n"}
        for sign, leads in self.leading.items():
            leads[[i for text, i in vocabulary.items() if text[:1] == self.letters[sign]]] = True
        blank, feed = self.letters[32], self.letters[10]
        plain = {self.letters[b] for b in range(256) if bytes((b,)).isalpha() or b == 0xC3 or 0x80 <= b <= 0xBF}
        reach = (text.replace(blank, "").replace(feed, "") for text in vocabulary if blank in text[1:] or feed in text)
        self.apart = byte_level and not any(text and plain.issuperset(text) for text in reach)
        self.first, self.after = _Chunks(self, b""), _Chunks(self, b" ")

    def _whole(self, raw: bytes) -> bytes:
        ids = self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _merged(self, raw: bytes) -> bytes:
        """Ids of one pre-token of plain characters."""
        if not self.byte_level:  # a kind that lower-cases; composed Latin-1 is normalised already
            raw = raw.decode("utf-8").lower().encode()
        return array(self.code, [t.id for t in self.merges.tokenize(raw.decode("latin-1").translate(self.letters))]).tobytes()

    def _words(self, words: list[bytes], sign: int) -> list[bytes]:
        """Ids of words of letters, with a blank before each (sign 32) or nothing (10): no merge reaches over the sign."""
        found: list[int] = []
        before = bytes((sign,))
        for low in range(0, len(words), TOGETHER):
            text = before.join([b"", *words[low : low + TOGETHER]]).decode("latin-1")
            text = text.replace(chr(sign), self.letters[sign]) if text.isascii() else text.translate(self.letters)
            found += [t.id for t in self.merges.tokenize(text)]
        ids = np.array(found, self.kind)
        item = self.kind.itemsize
        bounds = [*(np.flatnonzero(self.leading[sign][ids]) * item).tolist(), ids.nbytes]
        raw, skip = ids.tobytes(), item if sign == 10 else 0
        return [raw[a + skip : b] for a, b in zip(bounds, bounds[1:])]

    def learn_words(self, chunks: list[bytes]) -> None:
        """Learn the words of letters in chunks that have a blank before them or GLUE, many in one call of the library."""
        led, bare = {}, {}
        for chunk in chunks:
            if stem := _STEM.fullmatch(chunk):
                glue, word = stem.groups()
                if len(word) <= self.max_chunk_bytes:
                    (bare if glue else led)[word] = None
        for known, words, sign in ((self.after, led, 32), (self.first, bare, 10)):
            words = [w for w in words if w not in known]
            known.update(zip(words, self._words(words, sign), strict=True))

    def learn(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk, None where the text around it decides."""
        plain = _PLAIN.fullmatch(chunk)
        if plain and b"<|" not in chunk:
            letters, marks = plain.groups()
            if not letters or not marks:
                return self._merged(chunk) if chunk.strip() else self._spaces(chunk)
            return (self.after[letters[1:]] if letters[:1] == b" " else self.first[letters]) + self.first[marks]
        if _ODD.search(chunk):  # word vocabularies drop all white space, so only control strings reach beyond a chunk
            return None if self.byte_level or b"<|" in chunk else self._whole(chunk)
        if b"\n" in chunk and chunk.strip(b" \n"):
            return self._parts(chunk)
        return self._whole(chunk)

    def _spaces(self, chunk: bytes) -> bytes:
        return self._whole(chunk) if chunk and self.byte_level else b""

    def _parts(self, raw: bytes) -> bytes | None:
        found = []
        for chunk in _BYTE_CHUNKS.findall(raw) if self.byte_level else raw.split():
            led = chunk[:1] == b" " and chunk.strip(b" \n") and chunk[1:2] != b"\x01"  # a text's own, not GLUE
            found.append(self.after[chunk[1:]] if led else self.first[chunk])
        return None if None in found else b"".join(found)

    def _one(self, raw: bytes) -> bytes:
        """Ids of a text whose blanks are no single ones between chunks, or with a chunk that its text decides."""
        ids = self._parts(raw)
        return self._whole(raw) if ids is None else ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind.

        Texts are split and their distinct chunks found in Arrow; each distinct chunk is looked up once, and the ids of
        all chunks are gathered at once.
        """
        if len(self.first) + len(self.after) > self.max_chunks:
            self.first.clear()
            self.after.clear()
        cells = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        odd = pc.match_substring_regex(cells, _UNEVEN if self.byte_level else _UNEVEN_MARK).to_numpy(zero_copy_only=False)
        for mark in ("\n", ". ", ", "):  # these become chunks of their own; GLUE says that no blank leads a chunk
            apart = f" {GLUE}{mark.strip(' ')} " + (GLUE if mark == "\n" else "")
            cells = pc.replace_substring(cells, mark, apart if self.byte_level else f" {mark.strip()} ")
        pieces = pc.split_pattern(cells, " ")
        ends = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.flatten().dictionary_encode()
        at, chunks = flat.indices.to_numpy().astype(np.int64), _cells(flat.dictionary)
        if self.byte_level:  # the first chunk of a text has no blank before it
            heads = ends[:-1]
            ids = self.after.of(chunks) + [self.first[chunks[i]] for i in at[heads].tolist()]
            at[heads] = np.arange(len(chunks), len(ids))
        else:
            ids = list(map(self.first.__getitem__, chunks))
        if None in ids:  # chunks without ids of their own: their texts go to the library whole
            none = np.fromiter((x is None for x in ids), bool, len(ids))
            odd |= np.logical_or.reduceat(none[at], ends[:-1])
            ids = [x or b"" for x in ids]
        item = self.kind.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // item
        known = np.frombuffer(b"".join(ids), self.kind)
        starts = np.cumsum(sizes) - sizes
        width = sizes[at]
        total = np.concatenate(([0], np.cumsum(width)))
        out = known[np.repeat(starts[at] - total[:-1], width) + np.arange(total[-1])].tobytes()
        bounds = (total[ends] * item).tolist()
        found = [out[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd).tolist():
            found[i] = self._one(texts[i])
        return found


def _cells(column) -> list[bytes]:
    """The values of an Arrow column of large binaries without nulls."""
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(places, places[1:])]


@lru_cache(maxsize=2)
def encoder(path: str, byte_level: bool, max_chunks: int = 400_000) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    return ChunkEncoder(path, byte_level, max_chunks)


def slices(column, most_bytes: int = 3_000_000):
    """The values of an Arrow binary column as lists whose bytes stay below a bound (one value at least)."""
    part, size = [], 0
    for value in column:
        raw = value.as_py() or b""
        if part and size + len(raw) > most_bytes:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part
