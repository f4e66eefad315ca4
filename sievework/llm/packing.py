"""Operator 2: vector bin packing of examples into training sequences.

Each task packs its own examples, so nothing is shuffled. An example asks for
three resources: tokens, one segment and its loss-bearing tokens. A sequence is
filled with the example whose demand has the largest dot product with what the
sequence has left; where no example fits whole, one is cut to fill the rest.
A sequence that cannot be filled is cut back to a power of two, the lengths that
need no padding, and what is cut off goes to later sequences.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, tidy


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 4096


class WordIds:
    """Token ids of texts under a vocabulary that drops white space, as little-endian uint32 bytes.

    White space separates tokens there, so each distinct word of a batch is looked up once. A word of letters and then
    punctuation is its letters, lower-cased, which skip the normaliser (it leaves them as they are), and its tail; Arrow's kernels
    cut those with letters as in Western Europe, other words go through Python or the whole tokenizer. Short parts and words are
    remembered, within ``remembered_bytes``; longer ones only for a batch.
    """

    def __init__(self, path: str, remembered_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.suffix = spec["model"].get("end_of_word_suffix")
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True
        self.remembered_bytes, self.bytes = remembered_bytes, 0
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}  # letters, and tails of punctuation
        self.long: list[tuple[dict[str, bytes], str]] = []  # what is not remembered, and where

    def _full(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch(texts, add_special_tokens=False)]

    def _learn_cores(self, new: list[str]) -> None:
        lines = [" ".join(new[i : i + 256]) for i in range(0, len(new), 256)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):  # a vocabulary without word ends
            self.cores.update(zip(new, self._full(new)))
            return
        data = ids.tobytes()
        at = 0
        for word, cut in zip(new, cuts.tolist()):
            self.cores[word] = data[4 * at : 4 * cut]
            at = cut

    def _know(self, cores: Iterable[str], tails: Iterable[str]) -> None:
        """Learn the letters and the tails that are not known yet."""
        new = [c for c in cores if c not in self.cores]
        if new:
            self._learn_cores(new)
        odd = [t for t in tails if t not in self.cores]
        if odd:
            self.cores.update(zip(odd, self._full(odd)))
        self._keep(self.cores, new + odd)

    def _keep(self, known: dict[str, bytes], new: list[str]) -> None:
        self.bytes += 4 * sum(map(len, new)) + REMEMBERED * len(new)
        self.long += [(known, w) for w in new if len(w) > LONG]

    def _learn(self, new: list[str]) -> None:
        plain, odd = [], []
        for word in new:
            if word.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word)):
                low = word.lower()
                core = low.rstrip(string.punctuation)
                if core.isalpha():
                    plain.append((word, core, low[len(core) :]))
                    continue
            odd.append(word)
        self._know({c for _, c, _ in plain}, {t for *_, t in plain})
        for word, core, tail in plain:
            self.words[word] = self.cores[core] + self.cores[tail]
        if odd:
            self.words.update(zip(odd, self._full(odd)))
        self._keep(self.words, new)

    def _plain(self, words: pa.Array) -> pa.Array:
        """Ids of words of letters and then punctuation."""
        core = pc.utf8_lower(pc.utf8_rtrim(words, characters=string.punctuation)).dictionary_encode()
        tail = pc.utf8_ltrim(words, characters=_LETTERS).dictionary_encode()
        cores, tails = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (core, tail))
        self._know(cores, tails)
        heads, ends = (pa.array(list(map(self.cores.__getitem__, x)), pa.large_binary()) for x in (cores, tails))
        return pc.binary_join_element_wise(heads.take(core.indices), ends.take(tail.indices), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        places = cut.values.dictionary_encode()
        words = places.dictionary
        easy = pc.match_substring_regex(words, _PLAIN)
        plain, odd = words.filter(easy), words.filter(pc.invert(easy)).to_pylist()
        self._learn([w for w in odd if w not in self.words])
        known = pa.concat_arrays([self._plain(plain), pa.array([self.words[w] for w in odd], pa.large_binary())])
        first = easy.to_numpy(zero_copy_only=False)
        row = np.where(first, np.cumsum(first) - 1, len(plain) + np.cumsum(~first) - 1)  # of a word in ``known``
        found = known.take(pa.array(row[places.indices.to_numpy()]))
        _, ends, data = found.buffers()
        at = np.frombuffer(ends, "<i8", len(found) + 1)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        self._forget()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:])]

    def _forget(self) -> None:
        for known, w in self.long:
            del known[w]
            self.bytes -= 4 * len(w) + REMEMBERED
        self.long.clear()
        if self.bytes > self.remembered_bytes:
            self.words.clear()
            self.cores.clear()
            self.bytes = 0


_LETTERS = string.ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
_PLAIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*\z"
#: Bytes that a remembered word takes besides its characters: two objects and a place in a dictionary.
REMEMBERED = 240
#: Words of more characters are not remembered.
LONG = 64


def _word_ids(path: str) -> WordIds:
    return kept_in_worker("packing", path, lambda: WordIds(path))


class Packer:
    """Places pieces of examples into sequences under ``Limits``.

    A pool of examples waits; ``add`` packs from it while it holds at least
    ``pool_sequences`` full sequences, ``finish`` packs the rest.
    """

    def __init__(self, limits: Limits, pool_sequences: int = 64):
        self.limits, self.most = limits, pool_sequences * limits.tokens
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.waiting: list[tuple[int, int, int, int]] = []  # example, start, length, loss tokens
        self.tokens = 0
        self.loss_from: dict[int, int] = {}
        self.left: dict[int, int] = {}  # tokens of an example that are not placed yet
        self.sequences = 0
        self.placed: list[tuple[int, int, int, int, int]] = []  # example, start, length, sequence, offset

    def _piece(self, example: int, start: int, length: int) -> tuple[int, int, int, int]:
        return example, start, length, max(0, start + length - max(start, self.loss_from[example]))

    def add(self, example: int, length: int, loss_from: int = 0) -> None:
        self.loss_from[example], self.left[example] = loss_from, length
        start, size = 0, self.limits.tokens
        while length - start >= size and self._piece(example, start, size)[3] <= self.limits.loss_tokens:
            self._close([self._piece(example, start, size)])
            start += size
        if start < length:
            self.waiting.append(self._piece(example, start, length - start))
            self.tokens += length - start
        if self.tokens >= self.most:
            self._pack(self.most // 2)

    def finish(self) -> None:
        self._pack(0)

    def _fitting_head(self, piece: tuple[int, int, int, int], tokens: int, loss: int) -> int:
        """The longest head of ``piece`` within ``tokens`` and ``loss`` loss-bearing tokens."""
        example, start, length, _ = piece
        free = max(0, self.loss_from[example] - start)
        return max(0, min(length, tokens, free + loss))

    def _pack(self, rest: int) -> None:
        pool = self.waiting
        demand = np.array([[n, 1, loss] for *_, n, loss in pool], float).reshape(-1, 3) / self.capacity
        alive = np.ones(len(pool), bool)
        while self.tokens > rest:
            room, bin_ = np.ones(3), []
            while room[1] > 1e-9 and room[0] > 1e-9:
                fits = alive & (demand <= room + 1e-9).all(1)
                if not fits.any():
                    break
                i = int(np.argmax(np.where(fits, demand @ room, -1.0)))
                bin_.append(pool[i])
                alive[i] = False
                room = room - demand[i]
            tokens = self.limits.tokens - sum(p[2] for p in bin_)
            loss = self.limits.loss_tokens - sum(p[3] for p in bin_)
            back = []
            if tokens > 0 and len(bin_) < self.limits.segments and alive.any():
                i = int(np.argmax(np.where(alive, demand[:, 0], -1.0)))
                if head := self._fitting_head(pool[i], tokens, loss):
                    example, start, length, _ = pool[i]
                    bin_.append(self._piece(example, start, head))
                    alive[i] = False
                    if head < length:
                        back.append(self._piece(example, start + head, length - head))
            length = sum(p[2] for p in bin_)
            if length < self.limits.tokens:
                spare = length - (1 << (length.bit_length() - 1))
                while spare:
                    example, start, n, _ = bin_.pop()
                    cut = min(n, spare)
                    if cut < n:
                        bin_.append(self._piece(example, start, n - cut))
                    back.append(self._piece(example, start + n - cut, cut))
                    spare -= cut
            self._close(bin_)
            self.tokens -= sum(p[2] for p in bin_)
            if back:
                pool.extend(back)
                demand = np.vstack([demand, np.array([[n, 1, x] for *_, n, x in back], float) / self.capacity])
                alive = np.append(alive, np.ones(len(back), bool))
        self.waiting = [p for p, a in zip(pool, alive) if a]

    def _close(self, pieces: list[tuple[int, int, int, int]]) -> None:
        offset = 0
        for example, start, length, _ in pieces:
            self.placed.append((example, start, length, self.sequences, offset))
            offset += length
        self.sequences += 1

    def take(self) -> list[tuple[int, int, int, int, int]]:
        out, self.placed = self.placed, []
        return out


def pack_examples(df: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, batch_chars: int = 1 << 20) -> DataFrame:
    """Pack every example of ``df`` into sequences; one row per placed piece.

    Columns: ``id_col``, start, length, ids_crc32, doc_tokens, loss_tokens,
    sequence_id, offset. An example's ids are those of its prompt (if ``prompt_col``
    is given; these bear no loss), then those of its text, then ``end_id``. A null
    text or prompt counts as empty, so each row has at least one id. Repeated rows
    and null ids are packed like any other row, each on its own; ids must be integers, or text that casts to them. Other columns are
    ignored; an empty table gives no rows. Sequence ids are unique over tasks: the
    task's partition in the upper bits, a count in the lower.
    """
    prompt = F.coalesce(F.col(prompt_col), F.lit("")) if prompt_col else F.lit("")
    source = df.select(F.col(id_col).cast("long").alias("id"), prompt.alias("prompt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _word_ids(tokenizer_path), Packer(limits)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        examples: dict[int, tuple[int | None, bytes]] = {}
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            if not (placed := packer.take()):
                return
            out = []
            for example, start, length, sequence, offset in placed:
                key, ids = examples[example]
                loss = packer._piece(example, start, length)[3]
                out.append((key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, loss, first + sequence, offset))
                packer.left[example] -= length
                if not packer.left[example]:
                    del examples[example], packer.left[example], packer.loss_from[example]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            keys, prompts, texts = (c.to_pylist() for c in batch.columns)
            for a, b in _by_size(texts, prompts, batch_chars):
                heads = encoder.encode(prompts[a:b]) if prompt_col else [b""] * (b - a)
                for key, head, ids in zip(keys[a:b], heads, encoder.encode(texts[a:b])):
                    ids = head + ids + end
                    examples[n] = key, ids
                    packer.add(n, len(ids) // 4, len(head) // 4)
                    n += 1
                yield from rows()
        packer.finish()
        yield from rows()

    return source.mapInArrow(tidy(pack), schema)


def _by_size(texts: list[str], prompts: list[str], most: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, (t, p) in enumerate(zip(texts, prompts)):
        size += len(t) + len(p)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
