"""Vector best-fit packing of tokenised documents into sequences.

A piece needs its tokens, one document slot and its attention cost (tokens squared). All three follow from its
length, so pieces of one length are alike: the plan is made from the number of pieces of each length, a table of at
most `size` rows, by best-fit decreasing over classes of equal bins. A bin must have room in every dimension; among
those that have, the one with the smallest weighted dot product of need and residual capacities (or the smallest norm
of what the piece would leave) gets the piece. Pieces are then numbered within their length by a salted two-level count
and look their bin up in the plan. Pieces that fill a sequence alone, most of a large corpus of long texts, need
neither plan nor number: each gets a sequence of its own (a negative number) where it stands.

Defined results: a null or empty text is one piece holding the end token alone; rows repeated under one doc_id are
packed each on its own; a text of any length is cut into pieces of `size` tokens, the last one shorter; an empty
table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.shared import giving_back, written

#: If a worker remembers more parts, or more words, than this, it forgets them and starts again.
REMEMBERED = 700_000
#: Groups into which the pieces of a length are dealt for numbering.
SALTS = 64


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. None: as much as `tokens` allows, so that only tokens bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


#: Characters below this have lower cases that depend on nothing else, and no combining marks are among them.
_PLAIN_BELOW = 0x130
_LETTERS = "".join(re.escape(chr(c)) for c in range(_PLAIN_BELOW) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(_PLAIN_BELOW) if unicodedata.category(chr(c))[0] == "N")
#: Python's split() takes these for white space too, the tokenizer doesn't.
_NO_BLANKS = "\x1c\x1d\x1e\x1f"
_NOT_PLAIN = re.compile(f"[^\\x00-\\x1b\\x20-{chr(_PLAIN_BELOW - 1)}]")
#: What the tokenizer's pattern finds in plain lower-cased text without white space.
_PLAIN_WORDS = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others for those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


_AS_BYTES = {c: "".join(map(_byte_letters().__getitem__, chr(c).encode())) for c in range(_PLAIN_BELOW)}


class _Remembered(dict):
    """Learns what it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.learn(key)
        return found


# The rules of the tokenizer whose words can be remembered.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _words_apart(rules: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space, finds words by that pattern and codes each on its own."""
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    splits = [s for s in steps if s.get("type") == "Split"]
    coded = [s for s in steps if s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex")]
    pattern = len(splits) == len(coded) == 1 and len(steps) == 2 and splits[0]["pattern"] == {"Regex": _WORD_PATTERN} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
    return pattern and rules["normalizer"] == _NORMALIZER and rules["post_processor"] is None and all(t["content"].startswith("<|") for t in rules["added_tokens"])


class WordIds:
    """Ids of texts by a tokenizer. If it lower-cases, drops white space and finds words by _PLAIN_WORDS' pattern for
    all of Unicode, ids are remembered: of what stands between white space, and of the words in it. Texts that aren't
    plain are then cut at spaces and newlines only, and each part goes through the whole tokenizer. With other rules
    whole texts do."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model, self.apart, self.tokenizer = tokenizer.model, _words_apart(json.loads(tokenizer.to_str())), tokenizer
        packed = lambda ids: np.array(ids, dtype="<u4").tobytes()
        # none of these refers to self: what a task remembers goes with it, and doesn't wait for a collection of cycles
        words = self.words = _Remembered(lambda w: packed([t.id for t in model.tokenize(w.translate(_AS_BYTES))]))
        self.plain = _Remembered(lambda part: b"".join(map(words.__getitem__, _PLAIN_WORDS.findall(part))))
        self.other = _Remembered(lambda part: packed(tokenizer.encode(part, add_special_tokens=False).ids))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.apart:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        for held in (self.words, self.plain, self.other):
            if len(held) > REMEMBERED:
                held.clear()
        if "<|" in text or _NOT_PLAIN.search(text):
            return b"".join(map(self.other.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.plain.__getitem__, text.lower().split()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids themselves if asked for)."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for k, text in enumerate(texts):
                body = words.encode(text) + tail
                for piece, at in enumerate(range(0, len(body), 4 * size)):
                    part = body[at : at + 4 * size]
                    rows.append(k)
                    numbers.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if ids:
                        kept.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids array<long>" if ids else ""))


def plan(counts: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by: str = "dot") -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first, bin, per_bin, offset): from its piece number `first` on, each bin from `bin` on
    gets `per_bin` pieces one behind the other, the first at `offset`. A run ends where the next begins."""
    full = capacity.vector()
    scale = np.asarray(weights, dtype=float) / full.astype(float) ** 2
    loads = np.zeros((0, 3), dtype=np.int64)  # classes of bins with equal loads
    members: list[list[tuple[int, int]]] = []  # of each class, the ranges (first bin, number of bins)
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for length in sorted(counts, reverse=True):
        need, left, number, found = np.array([length, 1, length * length], dtype=np.int64), counts[length], 0, []
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        new_loads: list[np.ndarray] = []
        new_members: list[list[tuple[int, int]]] = []
        used: set[int] = set()

        def place(load: np.ndarray, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
            """Fills bins of one class; gives back the bins that it didn't need."""
            nonlocal left, number
            most = int(((full - load) // need).min())
            rest = []
            for first, n in ranges:
                take = min(n, left // most)
                if take:
                    found.append((number, first, most, int(load[0])))
                    new_loads.append(load + most * need)
                    new_members.append([(first, take)])
                    left, number = left - take * most, number + take * most
                if take < n and 0 < left < most:
                    found.append((number, first + take, left, int(load[0])))
                    new_loads.append(load + left * need)
                    new_members.append([(first + take, 1)])
                    take, number, left = take + 1, number + left, 0
                if take < n:
                    rest.append((first + take, n - take))
            return rest

        fits = np.flatnonzero(((loads + need) <= full).all(axis=1)) if len(loads) else np.zeros(0, dtype=np.int64)
        room = (full - loads[fits]).astype(float)
        # best-fit: the bin whose residual capacities have the smallest weighted product with the need, or leave the smallest norm
        rank = ((room * need) * scale).sum(axis=1) if by == "dot" else (((room - need) ** 2) * scale).sum(axis=1)
        for c in fits[np.argsort(rank, kind="stable")]:
            if not left:
                break
            used.add(int(c))
            if rest := place(loads[c], members[c]):
                new_loads.append(loads[c])
                new_members.append(rest)
        if left:
            most = int((full // need).min())
            n = -(-left // most)
            place(np.zeros(3, dtype=np.int64), [(bins, n)])
            bins += n
        merged: dict[tuple, list[tuple[int, int]]] = {}
        for load, ranges in [*((loads[c], members[c]) for c in range(len(loads)) if c not in used), *zip(new_loads, new_members, strict=True)]:
            if (load + np.array([1, 1, 1]) <= full).all():
                merged.setdefault(tuple(load.tolist()), []).extend(ranges)
        loads = np.array(list(merged), dtype=np.int64).reshape(-1, 3)
        members = list(merged.values())
        out[length] = found
    return out


def pack(made: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by: str = "dot", salts: int = SALTS) -> DataFrame:
    """made(doc_id, piece, start, length, ...) with sequence_id and offset. `made` is read three times: write it first."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    alone = None
    if (np.array([capacity.tokens, 1, capacity.tokens**2], dtype=np.int64) <= capacity.vector()).all():
        full = F.col("length") == capacity.tokens
        alone = made.where(full).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
        made = made.where(~full)
    made = made.withColumn("_salt", salt)
    sums = made.groupBy("length", "_salt").count().collect()  # at most capacity.tokens * salts rows
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(sums, key=lambda r: (r["length"], r["_salt"])):
        before[r["length"], r["_salt"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    spark = made.sparkSession
    runs = {k: np.array(v, dtype=np.int64).reshape(-1, 4) for k, v in plan(counts, capacity, weights, by).items()}
    shared = spark.sparkContext.broadcast((runs, before))

    @giving_back
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before = shared.value
        for batch in batches:
            length, salt_of, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_nth"))
            bin_of, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for at_length in np.unique(length):
                rows = np.flatnonzero(length == at_length)
                number = nth[rows] - 1 + np.array([before[int(at_length), int(s)] for s in salt_of[rows]], dtype=np.int64)
                of = runs[int(at_length)]
                run = of[np.searchsorted(of[:, 0], number, side="right") - 1]
                inside = number - run[:, 0]
                bin_of[rows] = run[:, 1] + inside // run[:, 2]
                offset[rows] = run[:, 3] + inside % run[:, 2] * at_length
            kept = [c for c in batch.schema.names if c not in ("_salt", "_nth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bin_of), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    numbered = made.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")))
    kept = [f for f in numbered.schema.fields if f.name not in ("_salt", "_nth")]
    planned = numbered.mapInArrow(look_up, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")
    return planned if alone is None else planned.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: Capacity = Capacity(), **how) -> DataFrame:
    """Tokenises once, into a table in the shared folder, and packs what it holds."""
    return pack(written(pieces(docs, path, capacity.tokens), "pieces"), capacity, **how)
