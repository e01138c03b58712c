"""Exact tokenizing of whole texts by chunks that no token crosses, with caches.

A tokenizer adapter gives ``safe`` (pairs of bytes between which its tokens always end), ``prepare`` (bytes
of a text as the cuts see them) and ``encode`` (ids of chunks on their own). Each worker keeps the ids of
the chunks it has met; only chunks that are new to it reach the tokenizer's library. A chunk is found by its
hash and then compared byte for byte, so what a worker met before never changes a result.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np

from tessera.llm._bytes import LOWER, SpanTable, chunks, lanes, ragged, span_bytes, span_hashes

WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_workers: dict[str, "ChunkCache"] = {}


class PieceModel:
    """A sentencepiece model. Cuts come from its vocabulary: pairs of neighbouring characters in no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        joined = np.zeros((256, 256), bool)
        joined[:, 0x80:0xC0] = True  # inside a character
        for i in range(self.model.get_piece_size()):
            if self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i):
                continue
            piece = self.model.id_to_piece(i)
            for a, b in zip(piece, piece[1:]):
                for x in {a.encode()[-1], 32} if a == "▁" else {a.encode()[-1]}:
                    for y in {b.encode()[0], 32} if b == "▁" else {b.encode()[0]}:
                        joined[x, y] = True
        self.safe = ~joined.ravel()
        self.lead = len(self.model.encode("\n"))
        self.dtype = np.uint16 if self.model.get_piece_size() <= 1 << 16 else np.uint32

    def prepare(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A space before every text that isn't empty, as the model adds one."""
        full = np.diff(offsets) > 0
        after = np.concatenate([[0], np.cumsum(full)])
        out = np.empty(len(buf) + int(after[-1]), np.uint8)
        to = offsets + after
        out[np.arange(len(buf)) + np.repeat(after[1:], np.diff(offsets))] = buf
        out[to[:-1][full]] = 32
        return out, to

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [x[self.lead :] for x in self.model.encode(["\n" + p for p in parts], num_threads=1)]


class WholeModel:
    """Any tokenizers file: a text is one chunk."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.safe = np.zeros(1 << 16, bool)
        self.dtype = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32

    def prepare(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return buf, offsets

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]


class WordModel(WholeModel):
    """A tokenizers file that drops white space and splits between letters, digits and ASCII punctuation."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        safe = np.zeros((256, 256), bool)
        space = [9, 10, 11, 12, 13, 32]
        letter = [*range(65, 91), *range(97, 123)]
        mark = [c for c in range(33, 127) if chr(c) not in "'<>|" and not chr(c).isalnum()]
        digit = [*range(48, 58)]
        for a, b in ((letter, mark), (mark, letter), (letter, digit), (digit, letter), (digit, mark), (mark, digit), (digit, digit)):
            safe[np.ix_(a, b)] = True
        plain = [c for c in range(128) if c not in space]
        safe[np.ix_(space, plain)] = safe[np.ix_(plain, space)] = safe[np.ix_(space, range(0xC2, 256))] = safe[np.ix_(range(128, 256), space)] = True
        self.safe = safe.ravel()
        self.dtype = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32

    def prepare(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A-Z folded, as the model does, except where a special token's string may stand."""
        return (buf if b"<|" in buf.tobytes() else LOWER[buf]), offsets


def adapter(path: str) -> type:
    """How a model file is cut into chunks; ``ValueError`` for files whose cuts aren't known to be safe."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ Å  x ") != "▁ﬁ▁Å▁▁x▁":
            raise ValueError(f"{path}: only models that keep every character and add a space in front are known")
        return PieceModel
    if not path.endswith(".json"):
        raise ValueError(f"{path}: neither a sentencepiece model nor a tokenizers file")
    spec = json.loads(Path(path).read_text())
    splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return WordModel if WORD_SPLIT in splits and steps == ["NFC", "Replace", "Lowercase"] else WholeModel


class ChunkCache(SpanTable):
    """Ids of the chunks that this worker has met. It starts anew when it holds too many or too long ones."""

    max_bytes = 1 << 26

    def __init__(self, model, bits: int = 21) -> None:
        self.model = model
        super().__init__(bits)

    def clear(self) -> None:
        super().clear()
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 16, self.model.dtype), 0

    def learn(self, h: np.ndarray | None, parts: list[bytes]) -> np.ndarray:
        """Entries of chunks that aren't held, encoded."""
        out = []
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            ids = self.model.encode([p.decode("utf-8", "replace") for p in some])
            at = self.add(None if h is None else h[i : i + 4096], some)
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((x for p in ids for x in p), self.ids.dtype, int(lengths.sum()))
            while self.n > len(self.first):
                self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
            while self.n_ids + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.length[at] = lengths
            self.first[at] = self.n_ids + np.cumsum(lengths) - lengths
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            out.append(at)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def entries(self, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entries of chunks; those that aren't held are encoded."""
        entry = self.table.get(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, back = np.unique(np.maximum(h[new], np.uint64(1)), return_index=True, return_inverse=True)
            some = new[first]
            if self.n and (self.n + len(first) > self.table.limit or self.n_bytes + int(lengths[some].sum()) > self.max_bytes) or len(first) > self.table.limit:
                while len(first) > (1 << self.bits) // 2:
                    self.bits += 1  # one block has more different chunks than the cache held
                self.clear()
                return self.entries(view, starts, lengths, h)
            entry[new] = self.learn(h[some], [span_bytes(view, a, n) for a, n in zip(starts[some].tolist(), lengths[some].tolist())])[back]
        other = np.flatnonzero(~self.equal(entry, view, starts, lengths))  # another chunk with this hash
        if len(other):
            entry[other] = self.learn(None, [span_bytes(view, a, n) for a, n in zip(starts[other].tolist(), lengths[other].tolist())])
        return entry

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """View of a block's bytes, and its chunks: starts, lengths, hashes, counts by row."""
        buf, offsets = self.model.prepare(buf, offsets)
        starts, per_row = chunks(buf, offsets, self.model.safe)
        view, lengths = lanes(buf), np.diff(np.append(starts, len(buf)))
        return view, starts, lengths, span_hashes(view, starts, lengths), per_row

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and tokens by row."""
        view, starts, lengths, h, per_row = self.cut(buf, offsets)
        entry = self.entries(view, starts, lengths, h)
        n = self.length[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(per_row)
        return self.ids[ragged(self.first[entry], n)], total[ends] - total[ends - per_row]


def worker_cache(path: str) -> ChunkCache:
    """This Python worker's cache for a model file; it lasts as long as the worker."""
    if path not in _workers:
        _workers[path] = ChunkCache(adapter(path)(path))
    return _workers[path]
