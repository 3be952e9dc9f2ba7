"""Token ids of whole texts, by the tokenizers library, word by word where the tokenizer's own steps make that exact."""

from __future__ import annotations

import codecs
import contextlib
import ctypes
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from podium.llm.hashes import BASE, mixed

#: Stems and other parts of words that a worker keeps (some 45 bytes each); beyond that it starts anew.
KEPT_PARTS = 1_000_000
#: Signs that are cut off a word of letters.
SIGNS = ".,;:!?%&#*$|"
#: Words in one call of the library.
CALL_WORDS = 20_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1_000_000

#: Fixed value: the pattern of a pre-tokenizer that keeps runs of letters, single digits and runs of signs, and drops white space.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Small letters whose case, composition and class are beyond doubt: ASCII and Latin-1.
LETTERS = "[a-zß-öø-ÿ]+"


def whole_words(scheme: dict) -> bool:
    """Whether, by a tokenizer's own description, a text's ids are those of its words in a row, and a word of letters (LETTERS, whatever
    the case of its ASCII letters) and signs has those of its letters and those of its signs.

    That is so if normalisation is by sign, but for composition, which never reaches across white space or a sign; if every run of
    letters and of signs is a pre-token of its own and white space none; and if no added token has white space in it or takes it in.
    """

    def steps(x, inner):
        return [] if x is None else [y for z in x[inner] for y in steps(z, inner)] if x["type"] == "Sequence" else [x]

    normal, cut, model = steps(scheme["normalizer"], "normalizers"), steps(scheme["pre_tokenizer"], "pretokenizers"), scheme["model"]
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain_text = all(x["type"] in ("NFC", "Lowercase") or x == blanks for x in normal) and any(x["type"] == "Lowercase" for x in normal)
    runs = len(cut) == 2 and cut[0] == {"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True}
    by_byte = runs and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
    added = all(x["content"].startswith("<|") and len(x["content"].split()) == 1 and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in scheme["added_tokens"])
    return bool(plain_text and by_byte and added and model["type"] == "BPE" and not model["dropout"] and scheme["truncation"] is None and scheme["padding"] is None)


def scheme_of(tokenizer) -> dict:
    """A tokenizer's description, as its file has it, but for the vocabulary."""
    part = lambda x: None if x is None else json.loads(x.__getstate__())
    names = ("content", "single_word", "lstrip", "rstrip")
    added = [{k: getattr(x, k) for k in names} for x in tokenizer.get_added_tokens_decoder().values()]
    model = {"type": type(tokenizer.model).__name__, "dropout": getattr(tokenizer.model, "dropout", None)}
    return {"normalizer": part(tokenizer.normalizer), "pre_tokenizer": part(tokenizer.pre_tokenizer), "added_tokens": added, "model": model, "truncation": tokenizer.truncation, "padding": tokenizer.padding}


def _gather(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool in a row, and where each begins (one more entry than runs)."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    at = np.repeat((begin - ends[:-1]).astype(np.int32), sizes)  # pools have less than 2^31 ids
    at += np.arange(ends[-1], dtype=np.int32)
    return pool[at], ends


def _string_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell strings apart: up to 15 bytes by themselves and their length, longer ones by a 128-bit hash."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    flat = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(16, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(flat, 16)[offsets[:-1] - offsets[0]]
    rows[np.arange(16) >= sizes[:, None]] = 0
    rows[:, 15] = np.minimum(sizes, 255)
    if len(long := np.flatnonzero(sizes > 15)):
        rows[long] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.as_buffer()) for x in column.take(pa.array(long)).cast(pa.binary())), np.uint8).reshape(-1, 16)
    both = rows.view(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


class Parts:
    """Ids of stems and other parts of words, in arrays sorted by key: a dictionary of strings would need five times the memory."""

    def __init__(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A key that, with `a`, leaves no doubt about b."""
        with np.errstate(over="ignore"):
            return mixed(a * np.uint64(BASE) + b)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each part; -1 of those that aren't there."""
        if not len(self.key):
            return np.full(len(a), -1)
        key = self._key(a, b)
        order = np.argsort(key)  # sorted questions are answered from the processor's cache
        at = np.empty(len(a), np.int64)
        at[order] = np.searchsorted(self.key, key[order])
        np.minimum(at, len(self.key) - 1, out=at)
        at[(self.key[at] != key) | (self.check[at] != a)] = -1
        return at

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Parts that aren't there, with all their ids in a row. Numbers of parts change."""
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        key = self._key(a, b)
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        put = lambda old, new: np.insert(old, at, new[order])
        self.key, self.check, self.begin, self.size = put(self.key, key), put(self.check, a), put(self.begin, begin), put(self.size, sizes.astype(np.int32))


class Encoder:
    """Encodes columns of texts.

    Where the tokenizer's description shows that words are independent (`whole_words`), each distinct stem of a batch is encoded once and
    kept, and a text's ids are put together from them. For any other tokenizer every text goes through the plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = whole_words(scheme_of(self.tokenizer))
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        table = list(map(chr, range(256)))  # the model spells bytes as signs: those of U+00C0 to U+00FF
        for c in range(0xC0, 0x100):
            table[0xC3], table[0x80 + c - 0xC0] = spell(chr(c))[0][0]
        self.spelling = "".join(table)
        self.known = Parts()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, parts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row, and their numbers of ids."""
        stems, others = parts.filter(pa.array(letters)).to_pylist(), parts.filter(pa.array(~letters)).to_pylist()
        tokens = list(map(self.tokenizer.model.tokenize, codecs.charmap_decode("\n".join(stems).encode(), "strict", self.spelling)[0].split("\n") if stems else []))
        sizes = np.empty(len(parts), np.int64)
        sizes[letters] = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = [np.fromiter((t.id for x in tokens for t in x), np.uint32)]
        counts = []
        for k in range(0, len(others), CALL_WORDS):
            part = others[k : k + CALL_WORDS]
            done = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(done.ids, np.uint32))
        if counts:
            sizes[~letters] = np.concatenate(counts)
        begin = np.empty(len(parts), np.int64)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(np.concatenate(ids), begin, sizes)[0], sizes

    def _by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(column)
        bounds = np.asarray(split.offsets, dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        words = coded.dictionary
        low = pc.ascii_lower(words)
        stem = pc.ascii_rtrim(low, characters=SIGNS)
        is_stem = pc.match_substring_regex(stem, f"^{LETTERS}$")
        ends = pc.if_else(is_stem, pc.replace_substring_regex(low, f"^{LETTERS}", ""), "")
        parts = pa.concat_arrays([pc.if_else(is_stem, stem, words), ends]).dictionary_encode()  # a word with other signs is one part as it is
        if len(self.known.key) + len(parts.dictionary) > KEPT_PARTS:
            self.known = Parts()
        a, b = _string_keys(parts.dictionary)
        at = self.known.find(a, b)
        if len(new := np.flatnonzero(at < 0)):
            fresh = parts.dictionary.take(pa.array(new))
            ids, sizes = self._encoded(fresh, np.asarray(pc.match_substring_regex(fresh, f"^{LETTERS}$")))
            self.known.add(a[new], b[new], ids, sizes)
            at = self.known.find(a, b)
            if (at < 0).any():  # two parts with the same key
                return self._whole(column)
        place = at[np.asarray(parts.indices, dtype=np.int64)].reshape(2, -1).T.reshape(-1)  # a word's stem, then its end
        pool, starts = _gather(self.known.ids, self.known.begin[place], self.known.size[place])
        starts = starts[::2]
        word = np.asarray(coded.indices, dtype=np.int64)
        ids, ends = _gather(pool, starts[word], np.diff(starts)[word])
        return ids, ends[bounds - bounds[0]]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self.plain(column.to_pylist())
        return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        return self._by_word(column) if self.by_word and len(column) else self._whole(column)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about `most` bytes of text; one longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Gives memory that a worker's last arrays took back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def encoded(path: str, batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its texts' ids in a row, the end id behind each text's, and where each text's begin (one more entry than texts).

    A null text is empty.
    """
    enc = encoder(path)
    for batch in slices(batches):
        ids, ends = enc.encode(pc.fill_null(batch.column("text"), ""))
        n = batch.num_rows
        whole = np.full(len(ids) + n, end_id, "<u4")
        own = np.ones(len(whole), bool)
        own[ends[1:] + np.arange(n)] = False
        whole[own] = ids
        del ids, own
        yield batch, whole, ends + np.arange(n + 1)
