"""BPE encoding over a pair occurrence index, and decoding, for vocabularies of words with word ends.

A task gathers the distinct words of a slice of its texts that it has not met yet, lays their symbols out in one linked
sequence and indexes every pair of neighbours that some merge joins: pair -> all its positions. The active ranks stand in a
heap. The least one is taken, its pair is joined at all its positions from left to right, and only the lists of the pairs
that touch them change. A join that brings up a pair of lesser rank hands over to it at once, so each word gets what
merging it alone, least rank first and leftmost first, would give.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cirrostrat.llm.text import in_small_batches, slices

#: Characters that are cut into words at once, words kept from slice to slice, and the longest of those.
PIECE, KEPT_WORDS, KEPT_LENGTH = 1 << 20, 400_000, 48
_SPACE = regex.compile(r"\s")
#: The parts of a tokenizer file that this module stands for.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def known_only(text: str) -> bool:
    """Whether all code points are assigned, so that the libraries' Unicode versions agree on them."""
    return text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(text))


class PairIndexEncoder:
    """A vocabulary file and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shape = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        plain = not (model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"))
        if not plain or [n["type"] for n in spec["normalizer"]["normalizers"]] != _NORMALIZERS or [s["type"] for s in shape] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: not a vocabulary of lower-case words")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens must stand for their own strings")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(shape[0]["pattern"]["Regex"])
        self.inner = [vocab.get(c) for c in byte_symbols()]
        self.last = [vocab.get(c + end) for c in byte_symbols()]
        #: (left, right) -> rank, and by rank (left, right, joined)
        self.ranks: dict[tuple[int, int], int] = {}
        self.joins: list[tuple[int, int, int]] = []
        for rule in model["merges"]:
            a, b = rule if isinstance(rule, list) else rule.split(" ")
            self.ranks[vocab[a], vocab[b]] = len(self.joins)
            self.joins.append((vocab[a], vocab[b], vocab[a + b]))
        self.library = Tokenizer.from_file(path)
        self.kept: dict[str, list[int]] = {}

    def split(self, text: str) -> Iterator[list[str] | int]:
        """The words of a text in pieces of about ``PIECE`` characters, cut at white space; a special token's string as its id."""
        for i, part in enumerate(self.special_cut.split(text) if self.special_cut else [text]):
            if i % 2:
                yield self.special[part]
            elif part and known_only(part):
                whole, at = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower(), 0
                while at < len(whole):
                    cut = len(whole) if len(whole) - at <= PIECE or not (gap := _SPACE.search(whole, at + PIECE)) else gap.start()
                    yield self.words.findall(whole, at, cut)
                    at = cut
            elif part:  # code points newer than some library: by the file's own normaliser and cuts
                symbols = {c: b for b, c in enumerate(byte_symbols())}
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                yield [bytes(symbols[c] for c in word).decode("utf-8") for word, _ in cut]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; all words share one pair index."""
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        where: dict[tuple[int, int], list[int]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            ids = [s for s in [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]] if s is not None]
            at = len(symbol)
            starts.append(at)
            symbol += ids
            after += [*range(at + 1, at + len(ids)), -1] if ids else []
            before += [-1, *range(at, at + len(ids) - 1)] if ids else []
            for i, pair in enumerate(zip(ids, ids[1:], strict=False), at):
                if pair in self.ranks:
                    where.setdefault(pair, []).append(i)
        active = [self.ranks[p] for p in where]
        heapify(active)
        while active:
            rank = heappop(active)
            left, right, joined = self.joins[rank]
            spots = sorted(where.pop((left, right)))
            for done, p in enumerate(spots, 1):
                q = after[p]
                if symbol[p] != left or q < 0 or symbol[q] != right:
                    continue  # joined with another neighbour meanwhile
                symbol[p], symbol[q] = joined, -1
                after[p] = n = after[q]
                if n >= 0:
                    before[n] = p
                lesser = False
                for i, j in ((before[p], p), (p, n)):
                    if i >= 0 and j >= 0 and (new := self.ranks.get(pair := (symbol[i], symbol[j]))) is not None:
                        if pair not in where:
                            where[pair] = []
                            heappush(active, new)
                        where[pair].append(i)
                        lesser |= new < rank
                if lesser and done < len(spots):
                    if (left, right) not in where:
                        where[left, right] = []
                        heappush(active, rank)
                    where[left, right] += spots[done:]
                    break
        return [[s for s in symbol[lo:hi] if s >= 0] for lo, hi in zip(starts, [*starts, len(symbol)][1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the words that no earlier call met are encoded together."""
        cut = [list(self.split(t)) if t else [] for t in texts]
        fresh = [w for w in {w for parts in cut for p in parts if isinstance(p, list) for w in p} if w not in self.kept]
        self.kept |= zip(fresh, self.encode_words(fresh), strict=True)
        found = [list(chain.from_iterable([p] if isinstance(p, int) else chain.from_iterable(map(self.kept.__getitem__, p)) for p in parts)) for parts in cut]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        for w in fresh:
            if len(w) > KEPT_LENGTH:
                self.kept.pop(w, None)
        return found


@lru_cache(maxsize=2)
def _encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> np.ndarray:
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = np.full(max(vocab.values(), default=-1) + 1, None, dtype=object)
    for token, i in vocab.items():
        out[i] = token
    return out


def lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(_encoder(path).encode(batch.column(1).to_pylist()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            texts = []
            for row in batch.column(1):
                ids = np.asarray(row.values.to_numpy(zero_copy_only=False), dtype=float) if row.is_valid else np.empty(0)
                ids = ids[(ids >= 0) & (ids < len(tokens))].astype(np.int64)  # null entries are nan and go too
                texts.append(" ".join(t for t in tokens[ids].tolist() if t is not None) if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every whole text. ``vocabulary``: a tokenizer file that every worker has; its strings of special tokens become their ids.

    Null, empty and blank texts have no ids. Rows that repeat, or have no doc_id, each have their row; other columns are not read. Long
    texts are cut into words piece by piece, at white space; a word is never cut. Nothing is shuffled.
    """
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(_encode(vocabulary), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens of the ids, special ones included, joined by spaces as the vocabulary has no decoder. Null ids give null, ids outside the vocabulary nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encoding_digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
