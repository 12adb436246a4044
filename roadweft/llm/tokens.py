"""Exact token ids by the `tokenizers` library, fast through a cache of chunks.

Both vocabularies encode a text piecewise, and no piece spans certain blanks, so the ids of a text
are the ids of its chunks in order:

* "words": white space is dropped by the tokenizer; chunks are what stands between blanks;
* "bytes": a blank is part of the word that follows; chunks are words with the blank before them.
  Only regular texts (single spaces and line ends, each between other characters) are divided so;
  others are encoded whole by the library.

Within an Arrow batch each distinct chunk is looked up once; unknown ones go to the library. The
cache of a Python worker is bounded: when its newer half is full the older half is dropped.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: By kind: a byte chunk is a word with its case, blank and points, so most of the many are rare.
CACHE_CHUNKS = {"words": 120_000, "bytes": 40_000}
#: What the library encodes at once: its encodings hold about 200 bytes a token until they are read.
CALL_CHUNKS, CALL_CHARS = 4096, 1 << 20
LONG_CHUNK = 64
SLICE_CHARS = 6_000_000
#: Not regular for "bytes": blanks at an end, runs of blanks, and any other white space.
_IRREGULAR = "^[ \\n]|[ \\n]$|[ \\n][ \\n]|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_FIRST = "\r"
#: A Latin-1 word with or without closing points.
_PLAIN = "^(?P<word>[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+)(?P<tail>[.,;:!?]*)$"

_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids of many texts at once; ``kind`` is "words" or "bytes"."""

    def __init__(self, path: str, kind: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = kind
        #: little-endian ids by chunk
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters: dict[int, str] | None = None

    @classmethod
    def of(cls, path: str, kind: str) -> "Encoder":
        """The worker's own encoder, made once."""
        if (path, kind) not in _ENCODERS:
            _ENCODERS[path, kind] = cls(path, kind)
        return _ENCODERS[path, kind]

    def _library(self, texts: list[str]) -> list[bytes]:
        out, start, held = [], 0, 0
        for stop, text in enumerate(texts, 1):
            held += len(text)
            if stop == len(texts) or held >= CALL_CHARS or stop - start >= CALL_CHUNKS:
                out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[start:stop], add_special_tokens=False)]
                start, held = stop, 0
        return out

    def _real(self, chunk: str) -> str:
        """What a chunk stands for in the text."""
        if self.kind == "words" or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == _FIRST else " " + chunk

    def _turn(self) -> None:
        if len(self.known) > CACHE_CHUNKS[self.kind]:  # what is still in use moves on from the older half
            self.known, self.older = {}, self.known

    def _cached(self, chunks: list[str]) -> tuple[list[bytes | None], list[str]]:
        """(ids or None of each chunk, the chunks without)."""
        self._turn()
        found = list(map(self.known.get, chunks))
        if self.older:
            for k, ids in enumerate(found):
                if ids is None and (ids := self.older.get(chunks[k])) is not None:
                    found[k] = self.known[chunks[k]] = ids
        return found, [c for c, ids in zip(chunks, found) if ids is None]

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, by the library where they are new."""
        found, missing = self._cached(chunks)
        if not missing:
            return found
        new = dict(zip(missing, self._library([self._real(c) for c in missing])))
        self.known.update((c, ids) for c, ids in new.items() if len(c) <= LONG_CHUNK)
        return [new[c] if ids is None else ids for c, ids in zip(chunks, found)]

    def _models(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased Latin-1 words, straight from the model: such a word is normal (NFC) as it
        is, and one pre-token."""
        if self.letters is None:
            mapped = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {c: mapped(chr(c))[0][0] for c in range(128, 256) if chr(c).isalpha()}
        found, missing = self._cached(words)
        if not missing:
            return found
        model, letters = self.tokenizer.model.tokenize, self.letters
        new = {w: array("I", [t.id for t in model(w if w.isascii() else w.translate(letters))]).tobytes() for w in missing}
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= LONG_CHUNK)
        return [new[w] if ids is None else ids for w, ids in zip(words, found)]

    def _word_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks: Latin-1 words and the points that close them apart, each distinct
        lower-cased word looked up once, other chunks by the library."""
        split = pc.extract_regex(chunks, pattern=_PLAIN)
        plain = split.is_valid()
        words = pc.utf8_lower(pc.struct_field(split, "word").filter(plain)).dictionary_encode()
        tails = pc.struct_field(split, "tail").filter(plain).dictionary_encode()
        binary = pa.large_binary()
        word_ids = pa.array(self._models(words.dictionary.to_pylist()), binary).take(words.indices)
        tail_ids = pa.array(self._lookup(tails.dictionary.to_pylist()), binary).take(tails.indices)
        joined = pc.binary_join_element_wise(word_ids, tail_ids, pa.scalar(b"", binary))
        others = pa.array(self._lookup(chunks.filter(pc.invert(plain)).to_pylist()), binary)
        # plain ones first, then the others, back in their places
        places = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))
        return pa.concat_arrays([joined.cast(binary), others]).take(pa.array(places))

    def _divided(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.kind == "words":
            marked = pc.replace_substring(texts, "\n", " ")
        else:
            big = pa.large_string()
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST, big), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", big))
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        if self.kind == "words":
            ids = self._word_ids(coded.dictionary)
        else:
            ids = pa.array(self._lookup(coded.dictionary.to_pylist()), pa.large_binary())
        ids = ids.take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1, offset=8 * ids.offset) // 4
        out = np.frombuffer(ids.buffers()[2] or b"", dtype="<u4", count=int(ends[-1] - ends[0]), offset=4 * int(ends[0]))
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return out, np.diff(ends[edges])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as little-endian uint32, number of ids per text); null: none."""
        texts = pc.fill_null(pa.chunked_array([texts.cast(pa.large_string())]).combine_chunks(), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        if not len(texts):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        if self.kind == "words":
            return self._divided(texts)
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._divided(texts)
        whole = [np.frombuffer(i, dtype="<u4") for i in self._library(texts.filter(pa.array(odd)).to_pylist())]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[odd] = [len(i) for i in whole]
        flat, each = self._divided(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, "<u4"), np.empty(0, np.int64))
        counts[~odd] = each
        parts, at, rest = iter(whole), 0, []
        for is_odd, n in zip(odd, counts):
            if is_odd:
                rest.append(next(parts))
            else:
                rest.append(flat[at : at + n])
                at += n
        return np.concatenate(rest), counts


def slices(texts: pa.Array, limit: int = SLICE_CHARS):
    """(start, stop) of runs of texts of about ``limit`` bytes, to bound what is held at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)
