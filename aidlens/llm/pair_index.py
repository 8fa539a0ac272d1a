"""BPE encoding and decoding (13): an index from each pair of symbols to all its places.

The different pieces of a block of texts are laid out in one line of symbols. The index names,
for each rank of a merge, all places where its pair stands. Active ranks are applied in
ascending order, each to all of its places from left to right, and every merge enters the pairs
that it makes with its neighbours into their lists. A place whose symbols have changed since it
was entered is passed over. So a merge costs the same in a piece of any length.

Ranks can be applied one after the other as the pairs that a merge makes always have a higher
rank than the merge itself. ``Vocabulary`` checks this of a tokenizer's file.
"""

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common, tokens

#: Signs and letters that the normaliser leaves alone but for their case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SHORT = re.compile(b"'(?:s|t|re|ve|m|ll|d)")
#: The kind of each byte of plain chunks: a sign, a letter, a digit, an end of a chunk.
_KIND = np.array([3 if b == 10 else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
#: What a tokenizer's file must say for the rules of this module to be its rules.
_SAME = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Bytes of text of a block to encode, and ids of a block to decode (one longer text is a block).
_BYTES = 3_000_000
_IDS = 500_000
#: The place of a symbol that a merge took, and what parts the chunks of a line.
_GONE = -2


class Vocabulary:
    """Symbols, merges and added tokens of a word-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or any(model.get(k, v) != v for k, v in _SAME.items()):
            raise ValueError(f"{path} is no word-level BPE")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        first_use: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            first_use.setdefault(a, rank)
            first_use.setdefault(b, rank)
        if any(first_use.get(made, rank + 1) <= rank for rank, (_, _, made) in enumerate(self.merges)):
            raise ValueError(f"{path} has a merge before that of its part")
        keys = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.inner = {s: i for s, i in ids.items() if len(s) == 1}
        self.last = {s: ids[s + end] for s in self.inner if s + end in ids}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.names = [""] * (1 + max([*ids.values(), *self.added.values()]))
        for name, i in [*ids.items(), *self.added.items()]:
            self.names[i] = name
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        # the symbols of each byte of a plain piece, inside it and at its end
        self.inner_of, self.last_of = np.full(256, _GONE, np.int32), np.full(256, _GONE, np.int32)
        for letter in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]):
            for byte, sign in zip(letter.encode(), self.split.pre_tokenize_str(letter)[0][0]):
                self.inner_of[byte], self.last_of[byte] = self.inner[sign], self.last[sign]

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge has it."""
        keys = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of plain chunks, each with _GONE after it, and where their pieces begin."""
        if not chunks:
            return np.empty(0, np.int32), np.empty(0, bool)
        held = ("\n".join(chunks) + "\n").lower().encode()
        raw = np.frombuffer(held, np.uint8)
        kind = _KIND[raw]
        starts = np.ones(len(raw), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= 2)
        for at in np.flatnonzero((raw == 39) & starts).tolist():
            short = _SHORT.match(held, at)  # the end of a short form is a piece
            if short:
                starts[at + 1 : short.end()] = False
                starts[short.end()] = True
        line = self.inner_of[raw]
        lasts = np.append(starts[1:], True)
        line[lasts] = self.last_of[raw[lasts]]
        return line, starts

    def other(self, chunk: str) -> tuple[list[int], list[bool]]:
        """The same of any other chunk; an added token is a piece of one symbol."""
        line, starts = [], []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.added:
                line.append(self.added[part])
                starts.append(True)
            elif part:
                for piece, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part)):
                    line += [*[self.inner[c] for c in piece[:-1]], self.last[piece[-1]]]
                    starts += [True, *[False] * (len(piece) - 1)]
        return [*line, _GONE], [*starts, True]


def merged(line: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """``line`` after all merges; the second symbol of each merge is left as _GONE.

    No pair spans the beginning of a piece.
    """
    size = len(line)
    line = np.append(line, np.int32(-1))  # what stands beside the ends of a piece
    after, before = np.arange(1, size + 2, dtype=np.int32), np.arange(-1, size, dtype=np.int32)
    begins = np.flatnonzero(starts)
    before[begins] = size
    after[begins[1:] - 1] = size
    after[size - 1 :] = before[size] = size
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        found = vocabulary.ranks(line[at], line[after[at]])
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if low < high:
                rank = int(found[low])
                if rank not in places:
                    heapq.heappush(active, rank)
                places[rank].append(at[low:high])

    enter(np.arange(size, dtype=np.int32))
    while active:
        rank = heapq.heappop(active)
        a, b, made = vocabulary.merges[rank]
        lists = places.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[(line[at] == a) & (line[after[at]] == b)]  # else an earlier merge took one of the two
        if a == b:
            kept, taken = [], -1
            at = np.sort(at)
            for place, follows in zip(at.tolist(), after[at].tolist()):
                if place != taken:
                    kept.append(place)
                    taken = follows
            at = np.array(kept, np.int32)
        if len(at):
            follows = after[at]
            line[at], line[follows] = made, _GONE
            then = after[follows]
            after[at], before[then] = then, at
            left = before[at]
            enter(np.concatenate([left[line[left] != made], at]))  # two made side by side are entered once
    return line[:-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker keeps it for its next tasks, as it does the encoder."""
    return Vocabulary(path)


class Encoder:
    """Ids of texts, block by block; the first ``keep`` different chunks are remembered."""

    def __init__(self, path: str, keep: int = 400_000):
        self.vocabulary = vocabulary(path)
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of different chunks, four bytes each."""
        v = self.vocabulary
        whole = _PLAIN.fullmatch
        plain = [c for c in chunks if whole(c)]
        if v.cut and v.cut.search(" ".join(plain)):
            plain = [c for c in plain if not v.cut.search(c)]
        others = list(set(chunks).difference(plain)) if len(plain) < len(chunks) else []
        lines, starts = [[x] for x in v.plain(plain)]
        for chunk in others:
            line, start = v.other(chunk)
            lines.append(np.array(line, np.int32))
            starts.append(np.array(start, bool))
        raw = np.concatenate(lines)
        parted = np.cumsum(raw == _GONE) - (raw == _GONE)  # which chunk a symbol belongs to
        line = merged(raw, np.concatenate(starts), v)
        stays = line != _GONE
        ends = np.cumsum(np.bincount(parted[stays], minlength=len(chunks))) * 4
        flat = line[stays].astype("<i4").tobytes()
        return {c: flat[low:high] for c, low, high in zip([*plain, *others], [0, *ends.tolist()], ends.tolist())}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = [c for c in set().union(*split) if c not in self.known]
        found = self._ids(new) if new else {}
        known = self.known
        known.update(found)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for chunk in list(found)[max(0, self.keep - len(known) + len(found)) :]:
            del known[chunk]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _blocks(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most about ``most`` in size each."""
    ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False)))
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + most
        end = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def _extended(df: DataFrame, run, column: str, kind: str) -> DataFrame:
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.mapInArrow(run, f"{names}, `{column}` {kind}" if names else f"`{column}` {kind}")


def _with(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    held = [(n, batch.column(n)) for n in batch.schema.names if n != column]
    return pa.RecordBatch.from_arrays([*[c for _, c in held], values], names=[*[n for n, _ in held], column])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array; other columns stay, one of that name is replaced.

    The ids are those of the tokenizers library without special tokens added; the name of an
    added token within a text is that token, as there. A null or empty text has no ids.
    """
    path = path or f"{tokens.folder()}/{tokens.WORD_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, pc.binary_length(batch.column(text)), _BYTES):
                found = encoder(path).encode(common.texts(part, text))
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                yield _with(part, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))

    common.prepare(docs.sparkSession)
    return _extended(docs.withColumn(text, F.col(text).cast("string")), run, ids, "array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids``: the tokens' names joined by a blank, as the library gives them.

    The file names no decoder, so ends of words stay visible and special tokens stay. Null ids
    are no ids.
    """
    path = path or f"{tokens.folder()}/{tokens.WORD_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(vocabulary(path).names, pa.string())
        for batch in batches:
            for part in _blocks(batch, batch.column(ids).value_lengths(), _IDS):
                lists = part.column(ids)
                ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
                tokens_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(lists.flatten()))
                yield _with(part, text, pc.binary_join(tokens_of, " "))

    common.prepare(encoded.sparkSession)
    return _extended(encoded, run, text, "string")
