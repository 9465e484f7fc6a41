"""Token ids of whole texts by the tokenizers library, with the ids of words kept."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Words whose ids a worker keeps; beyond that only half as many stay, those met in the most batches.
MOST_WORDS = 300_000
#: Characters that are split at a time; longer texts are cut.
LONG = 1 << 22
#: How the word tokenizer's file splits and normalises. It drops white space, so words are independent.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: ASCII punctuation after a letter: a token run always ends before it.
AFTER_LETTER = re.compile(rb"[!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Words of Latin letters only: one token run each.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: a for ASCII letters, digits, white space and the bytes of Latin letters, . for other ASCII, X for what starts other characters.
KIND = bytes(ord("a") if chr(i).isalnum() and i < 128 or i in b" \t\n\r\x0b\x0c" or 0x80 <= i < 0xC0 or i == 0xC3 else ord(".") if i < 128 else ord("X") for i in range(256))
JOINED = 128


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) as little-endian bytes, width bytes an id, without special tokens around it.

    Where the tokenizer splits at white space and drops it, a text's ids are its words' ids strung together. Each distinct
    word is then encoded once, which is what most of the time goes to otherwise; any other tokenizer gets whole texts.
    Words of Latin letters need no more of the normalizer than lower case and are one run each: they go to the library's same
    model and byte alphabet without its regular expression, and without its cache, since none comes twice.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre, *after = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        level = len(after) == 1 and after[0]["type"] == "ByteLevel" and not after[0]["use_regex"] and not after[0]["add_prefix_space"]
        model = spec["model"]
        same = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.by_word = norm == NORMALIZERS and pre.get("pattern") == {"Regex": SPLIT} and pre.get("invert") and level and same and not spec.get("post_processor")
        if not self.by_word:
            return
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.letters = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        self._keep(np.empty(0, np.int64))

    def _keep(self, numbers: np.ndarray) -> None:
        """Forget all but these of the known words. Word n has the count[n] ids of pool from first[n] and was met in met[n] batches."""
        if len(numbers):
            words = list(self.words)  # in order of their numbers
            self.pool, self.count, self.met = self._ids(numbers), self.count[numbers], self.met[numbers]
            self.first = np.cumsum(self.count) - self.count
            self.words = {words[n]: i for i, n in enumerate(numbers.tolist())}
        else:
            self.pool, self.first, self.count, self.met = np.empty(0, f"<u{self.width}"), *(np.empty(0, np.int64) for _ in range(3))
            self.words = {}

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words strung together."""
        count = self.count[numbers]
        shift = self.first[numbers] - np.cumsum(count) + count
        return self.pool[np.repeat(shift, count) + np.arange(count.sum())]

    def _pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _spaced(self, text: str) -> bytes:
        """A text with white space between words whose ids, strung together, are the text's, and none around them."""
        data = text.encode()
        if b"<|" in data:  # special tokens may be spelled out, and their case counts
            return data.strip()
        data = data.lower()
        kinds = data.translate(KIND)
        if b"X" in kinds or b".." in kinds or b"\xc3\x97" in data or b"\xc3\xb7" in data:
            return AFTER_LETTER.sub(rb" \g<0>", data).strip()
        # no two characters in a row are neither letter, digit nor space: every full stop and comma is a run of its own
        return data.replace(b".", b" .").replace(b",", b" ,").strip()

    def _parts(self, text: str) -> list[str]:
        """A long text in parts cut before white space."""
        out, at = [], 0
        while len(text) - at > LONG:
            cut = re.compile(r"[ \t-\r]").search(text, at + LONG)
            end = cut.start() if cut else len(text)
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null texts are empty."""
        if not self.by_word:
            return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        owners, batch, chars = [], [], 0
        for own, text in zip(out, texts, strict=True):
            for part in self._parts(text or ""):
                if batch and chars + len(part) > LONG:
                    self._hand_out(owners, batch)
                    owners, batch, chars = [], [], 0
                owners.append(own)
                batch.append(part)
                chars += len(part)
        if batch:
            self._hand_out(owners, batch)
        return [b"".join(x) for x in out]

    def _hand_out(self, owners: list[list[bytes]], texts: list[str]) -> None:
        for own, ids in zip(owners, self._encode(texts), strict=True):
            own.append(ids)

    def _encode(self, texts: list[str]) -> list[bytes]:
        # a batch's words are told apart by Arrow; of those that repeat only one each is looked up; texts without words are null
        split = pc.ascii_split_whitespace(pa.array([self._spaced(t) or None for t in texts], pa.large_binary()).view(pa.large_string()))
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > MOST_WORDS:
            most = np.argsort(-self.met, kind="stable")[: MOST_WORDS // 2]
            self._keep(most[self.met[most] > 1])
            self.met //= 2  # words met long ago count less
        known = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            known[unknown] = np.arange(len(self.words), len(self.words) + len(new))
            self._learn(new)
            self.words.update(zip(new, known[unknown].tolist(), strict=True))
        self.met[known] += 1
        numbers, sizes = known[coded.indices.to_numpy()], np.diff(split.offsets.to_numpy())
        data = self._ids(numbers).tobytes()
        before = np.concatenate([[0], np.cumsum(self.count[numbers])])
        ends = (before[np.cumsum(sizes)] * self.width).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Add the ids of the words with the next numbers."""
        plain = [i for i, w in enumerate(new) if w.isalpha() or LETTERS.fullmatch(w)]
        rest = sorted(set(range(len(new))).difference(plain))
        # many words of one run each in one text: the ids of a word end at the first id that ends a run
        joined = [b" ".join([new[i] for i in plain[at : at + JOINED]]).decode().lower() for at in range(0, len(plain), JOINED)]
        ids = list(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(joined, add_special_tokens=False)))
        own = [e.ids for e in self.tokenizer.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False)]
        ends = np.flatnonzero(self.ends[ids]) + 1 if ids else np.empty(0, np.int64)
        if len(ends) != len(plain):
            raise ValueError("a word of letters is not one token run")
        count = np.empty(len(new), np.int64)
        count[plain] = np.diff(ends, prepend=0)
        count[rest] = np.fromiter(map(len, own), np.int64, len(own))
        order = np.array([*plain, *rest], np.int64)
        first = np.empty(len(new), np.int64)
        first[order] = len(self.pool) + np.cumsum(count[order]) - count[order]
        self.pool = np.concatenate([self.pool, np.array([*ids, *chain.from_iterable(own)], self.pool.dtype)])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about LONG bytes of the texts in column, and one text at least."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // LONG
    cuts = (np.flatnonzero(np.diff(before)) + 1).tolist()
    if len(batch):
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the file at path; a Python worker keeps it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
