"""Token counts of byte-level BPE, by rank-synchronous merging in ragged arrays.

A text's pre-tokens are told apart by the vocabulary's pattern. Those not counted
before in a task are laid end to end in one array of symbols. In each round every
sequence applies its own pair of lowest rank, at all places at once; a sequence
without a pair that merges is done, and the symbols it has left are its tokens.

A symbol pair can only be learnt after both its symbols, so applying a pair makes
no pair of lower rank: merging all places of the lowest one, from the left, is what
merging them one at a time comes to. Pre-tokens of more than LONG bytes, which
would need a round over the whole for each of very many ranks, keep the places of
each rank in lists instead, so that a round touches only the places it merges.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import with_fields

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of a pre-token above which places are kept by rank.
LONG = 2_048
#: Pre-tokens whose counts a task remembers, and characters of them; and bytes of pre-tokens merged in one array.
REMEMBERED, REMEMBERED_CHARS, TOGETHER = 1_000_000, 16_000_000, 4_000_000
#: The rank of a pair that does not merge.
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary's file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of symbol pairs, and the ids of what they make; symbols are token ids."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or model["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        vocab = model["model"]["vocab"]
        self.size = len(vocab) + len(model["added_tokens"])
        letters = byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.key, first = np.unique(left * self.size + right, return_index=True)
        self.rank = first.astype(np.int64)
        self.makes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # whole added tokens are found before anything else, and count one
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(model["added_tokens"], key=lambda t: -len(t["content"])))) if model["added_tokens"] else None
        self.pattern = regex.compile(PATTERN)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, NEVER where it doesn't merge."""
        k = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NEVER)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each of ``tokens``, none of them empty."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), size)
        rank = self.ranks(symbols[:-1], symbols[1:])
        rank = np.append(np.where(owner[:-1] == owner[1:], rank, NEVER), NEVER)  # of each symbol with the one after it
        while True:
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(begin, append=len(owner))
            done = least == NEVER
            if done.any():
                out[owner[begin[done]]] = size[done]
                stays = np.repeat(~done, size)
                symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
                least, size = least[~done], size[~done]
                if not len(symbols):
                    return out
            hit = rank == np.repeat(least, size)
            # of places next to each other every second one, from the left of their stretch, which is one pair of the same symbol
            at = np.flatnonzero(hit)
            fresh = np.diff(at, prepend=-2) != 1
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbols[at] = self.makes[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            new = np.cumsum(stays)[at] - 1
            symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            after = np.minimum(touched + 1, len(symbols) - 1)
            mates = (touched + 1 < len(symbols)) & (owner[touched] == owner[after])
            rank[touched] = np.where(mates, self.ranks(symbols[touched], symbols[after]), NEVER)

    def count_long(self, token: bytes) -> int:
        """Symbols that are left of one token: the same rounds, over the places of the lowest rank alone."""
        symbols = self.of_byte[np.frombuffer(token, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), NEVER)
        places: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < NEVER]
            at = at[np.argsort(rank[at], kind="stable")]
            edge = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for some in np.split(at, edge[1:]) if len(at) else []:
                r = int(rank[some[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(order, r)
                places[r].append(some)

        note(np.arange(n))
        left = n
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # as above: of a stretch of places, each the other's next symbol, every second one
            fresh = np.append(True, after[at[:-1]] != at[1:])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            gone = after[at]
            left -= len(at)
            symbols[at] = self.makes[r]
            rank[gone] = NEVER
            after[at] = after[gone]
            more = after[at] < n
            before[after[at][more]] = at[more]
            touched = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            mate = after[touched] < n
            rank[touched[~mate]] = NEVER
            touched = touched[mate]
            rank[touched] = self.ranks(symbols[touched], symbols[after[touched]])
            note(touched)
        return left


#: Fixed value: the pattern that the library's byte-level pre-tokenizer splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def merges_of(vocabulary: str) -> Merges:
    """A vocabulary, read once a process: a path, or the name of one of the public files."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Merges(vocabulary)


class Counter:
    """Token counts of texts; remembers the counts of pre-tokens met before."""

    def __init__(self, merges: Merges):
        self.merges, self.known, self.chars = merges, {}, 0

    def __call__(self, texts: list[str]) -> list[int]:
        m, known = self.merges, self.known
        split, specials, new = [], [], {}
        for text in texts:
            parts = m.special.split(text) if m.special else [text]
            specials.append(len(parts) - 1)
            found = [t for part in parts for t in m.pattern.findall(part)]
            split.append(found)
            new |= dict.fromkeys(t for t in found if t not in known)
        self.chars += sum(map(len, new))
        batch, held = [], 0
        for t in new:
            raw = t.encode()
            if len(raw) > LONG:
                known[t] = m.count_long(raw)
                continue
            batch.append((t, raw))
            held += len(raw)
            if held >= TOGETHER:
                self._merge(batch)
                batch, held = [], 0
        self._merge(batch)
        out = [n + sum(map(known.__getitem__, found)) for n, found in zip(specials, split)]
        if len(known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            known.clear()
            self.chars = 0
        return out

    def _merge(self, batch: list[tuple[str, bytes]]) -> None:
        self.known.update(zip((t for t, _ in batch), self.merges.counts([raw for _, raw in batch]).tolist()))


def _count(vocabulary: str):
    def run(batches):
        counter = Counter(merges_of(vocabulary))
        for batch in batches:
            n = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            # some texts at a time: their pre-tokens are held until all are counted
            first = 0
            while first < len(texts):
                end, held = first, 0
                while end < len(texts) and (end == first or held + len(texts[end]) <= TOGETHER):
                    held += len(texts[end])
                    end += 1
                n += counter(texts[first:end])
                first = end
            yield pa.RecordBatch.from_arrays([batch.column("src"), pa.array(n, pa.int64())], names=["src", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row ``src, n_bytes, n_tokens`` per row of ``docs``; ``src`` holds its columns, or those in ``keep``.

    n_tokens is what the library of a byte-level BPE file gives for the whole
    text, without added tokens at its ends; the strings of special tokens inside
    a text are those tokens. n_bytes is its length in UTF-8. A null text counts
    as empty: 0 and 0. Texts are whole, whatever their length; equal rows get
    equal results; an empty table gives an empty one.
    """
    src = F.struct(*(keep if keep is not None else ["*"]))
    rows = docs.select(F.struct(src.alias("src"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")).alias("src"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_count(vocabulary), with_fields(rows, "src", "n_tokens bigint"))
    return out.select("src.src", "src.n_bytes", "n_tokens")


def op13_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, keep=["doc_id"])
    return out.select(F.col("src.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
