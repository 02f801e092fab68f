"""Byte-pair encoding and decoding with a pair occurrence index.

All distinct words of a batch stand in one array of symbols. An index maps each
mergeable pair to all its positions in that array; active ranks are taken in
ascending order, all occurrences of a rank's pair merge at once, and only the
lists of the pairs beside them are updated. Words that were seen before come from a
bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import groups, light_batches, pick, table, utf8_view

#: The word pattern of byte-level BPE; white space is Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Entries that a worker's cache holds at most before it starts anew; this changes speed, not results.
CACHE_ENTRIES = 60_000
#: Bytes of text whose words are encoded together; this bounds memory, not results.
SLICE_BYTES = 4 << 20


def _distinct(at: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) > 1 else at


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of one byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = (left << 32) | right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.words = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.codes[at] == code), self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids, ends): word i has ids[ends[i]:ends[i+1]]; no word is split further."""
        if not words:
            return [], [0]
        data = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        gaps = np.concatenate([[0], np.cumsum(size + 1)])
        sym = self.first[data]
        sym[gaps] = -1
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            edges = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for i, j in zip(edges, edges[1:]):
                r = int(rank[i])
                if r in lists:
                    lists[r].append(at[i:j])
                else:
                    lists[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        add(np.arange(n - 1, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = _distinct(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[(sym[at] == self.left[r]) & (sym[nxt[at]] == self.right[r])]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:
                # In a run of one symbol the pairs overlap: every second one from the left merges.
                head = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                within = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[within % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -2
            nxt[at], prv[after] = after, at
            add(_distinct(np.concatenate([at, prv[at]])))
        alive = sym >= 0
        return sym[alive].tolist(), np.cumsum(alive)[gaps].tolist()

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that encode independently of each other, in order.

        Where every white space stands alone, a part is a run without blanks
        together with the blank before it, or a line feed; else it is a word of the pattern.
        """
        # Only blanks and line feeds as white space, and no two side by side: else take the pattern.
        if not text.replace("\n", "").isprintable() or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
            return self.words.findall(text)
        out = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return out[not out[0] : len(out) - (not out[-1])] if text else []

    def split_words(self, part: str) -> list[str] | tuple[str, ...]:
        """The words of the pattern; plain letters, with one mark behind them, go without it."""
        body = part[1:] if part[:1] == " " else part
        if body.isalpha():
            return (part,)
        if body[:-1].isalpha() and body[-1] in ".,":
            return part[:-1], part[-1]
        return self.words.findall(part)

    def parts(self, text: str) -> list[str]:
        """Pieces of a text, with the special tokens as parts of their own."""
        if self.split and any(x in text for x in self.special):
            return [y for x in self.split.split(text) if x for y in ([x] if x in self.special else self.pieces(x))]
        return self.pieces(text)

    def learn(self, parts: set[str]) -> None:
        """Put the ids of all these parts into the cache, by one run over their distinct words."""
        if len(self.ids) > CACHE_ENTRIES:  # keep what comes again
            again = [x for x in parts if x in self.ids][:CACHE_ENTRIES]
            self.ids, self.decoded = {x: self.ids[x] for x in again}, {x: self.decoded[x] for x in again}
        for text, i in self.special.items():
            self.ids[text], self.decoded[text] = str(i), self.bytes_of[i]
        new = [x for x in parts if x not in self.ids]
        split = [self.split_words(x) for x in new]
        distinct = list({w for ws in split for w in ws})
        flat, ends = self.encode_words([w.encode() for w in distinct])
        names, raws = [str(i) for i in flat], [self.bytes_of[i] for i in flat]
        ids = {w: ",".join(names[i:j]) for w, i, j in zip(distinct, ends, ends[1:])}
        plain = {w: b"".join(raws[i:j]) for w, i, j in zip(distinct, ends, ends[1:])}
        for part, ws in zip(new, split):
            self.ids[part] = ids[ws[0]] if len(ws) == 1 else ",".join([ids[w] for w in ws])
            self.decoded[part] = plain[ws[0]] if len(ws) == 1 else b"".join([plain[w] for w in ws])


_encoders: dict[str, PairIndexBPE] = {}


def encoder(path: str) -> PairIndexBPE:
    """The worker's encoder of a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = PairIndexBPE(path)
    return _encoders[path]


def byte_bpe_path() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, text: str = "text", key: str = "doc_id", *, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and with
    keep_ids ids (array) and decoded (string). A null text counts as empty: no
    tokens and the digests of the empty string. Keys may be null or repeat. Special
    tokens in a text are taken as such; bytes that are no UTF-8 decode to U+FFFD.
    """
    path = path or byte_bpe_path()
    light_batches(docs.sparkSession)
    source = pick(docs, key=key, text=text)
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def sliced(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i, j in groups(utf8_view(batch.column(1))[0], SLICE_BYTES):
                held.append(batch.slice(i, j - i))
                if sum(b.nbytes for b in held) >= SLICE_BYTES:
                    yield pa.concat_batches(held)
                    held = []
        if held:
            yield pa.concat_batches(held)

    def run(batches):
        bpe = encoder(path)
        for batch in sliced(batches):
            texts = batch.column(1)
            seen: set[str] = set()
            for t in texts:
                if t.is_valid:
                    seen.update(bpe.parts(t.as_py()))
            bpe.learn(seen)
            del seen
            n, coded, back, ids_out, text_out = [], [], [], [], []
            for t in texts:
                parts = bpe.parts(t.as_py()) if t.is_valid else []
                ids = ",".join(map(bpe.ids.__getitem__, parts))
                plain = b"".join(map(bpe.decoded.__getitem__, parts)).decode("utf-8", "replace")
                n.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(plain.encode()).hexdigest())
                if keep_ids:
                    ids_out.append([int(i) for i in ids.split(",")] if ids else [])
                    text_out.append(plain)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through byte_bpe_50k: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(table(spark, sf_dir, "documents"))
