"""BPE encoding and decoding by speculation: greedy longest match proposes, pair checks verify.

A sequence of tokens is what byte-pair merging gives for a word exactly if every two
adjacent tokens are *compatible*: merging their joined characters gives those two again.
Greedy longest match proposes a sequence for each unseen word, all adjacent pairs of a
batch of words are checked at once with numpy, and only words with a failing pair are
merged step by step.

Defined cases: null text is empty; an empty text has no ids and decodes to the empty
string; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces

#: Entries of one generation of a worker's chunk cache (two generations are kept).
CACHE = 200_000
NEVER = np.int64(1 << 60)
NONE = 1 << 60
MARK = "\uffff"
# Splits of the published tokenizer (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def chunks_of(text: str) -> list[str]:
    """Parts of a text between white space; no token crosses white space."""
    if ODD_SPACE.search(text) is not None:  # str.split() takes these four for white space, Unicode does not
        return [x for x in SPACE.split(text) if x]
    return text.split()


def folded(text: str) -> str:
    """Composed and then lower case ahead of the cache, as the file has it; the text itself where that could make
    a special token, depends on context, or would be composed further (small letters with marks that capitals lack)."""
    if "<|" in text or "Σ" in text:
        return text
    low = (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()
    return low if unicodedata.is_normalized("NFC", low) else text


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ChunkCache:
    """Chunk -> ids as little-endian unsigned 32-bit bytes; bounded by two generations."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE):
        self.encode, self.most, self.new, self.old = encode, most, {}, {}

    def fill(self, texts: list[list[str]]) -> dict[str, bytes]:
        """The mapping for all chunks of these texts."""
        seen = set().union(*texts)
        if len(self.new) + len(seen) > self.most:
            self.old, self.new = self.new, {}
        missing = seen.difference(self.new)
        if missing:
            unknown = []
            for c in missing:
                ids = self.old.get(c)
                if ids is None:
                    unknown.append(c)
                else:
                    self.new[c] = ids
            if unknown:
                self.new.update(zip(unknown, self.encode(unknown), strict=True))
        return self.new


class WordBpe:
    """Vocabulary and merges of a word-end BPE file, with the pair checks on arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab = vocab
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        size = self.size = np.int64(len(self.tokens))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank_of = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        # formed[t]: when merging makes t; left/right: from what. Single letters are there from the start.
        self.formed, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for (a, b), k in reversed(self.rank_of.items()):
            t = self.made[k]
            self.formed[t], self.left[t], self.right[t] = k, a, b
        keys = np.fromiter((a * int(size) + b for a, b in self.rank_of), np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.fromiter(self.rank_of.values(), np.int64, len(keys))[order]
        self.letters = byte_letters()
        # In words and in these keys one mark stands for the word end, so that it can't be met letter by letter.
        self.marked = {t[:len(t) - len(self.end)] + MARK if self.end and t.endswith(self.end) else t: i for t, i in vocab.items()}
        self.mark = MARK if self.end else ""
        # Tokens that merging really makes of their own letters may be proposed.
        self.proposable = {t: i for t, i in self.marked.items() if len(t.rstrip(MARK)) <= 1 or self.merge(t) == [i]}
        self.longest = max(map(len, self.proposable), default=1)

    def merge(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost first. The mark belongs to the last letter."""
        parts = [*word[:-2], word[-2:]] if word.endswith(MARK) and len(word) > 1 else list(word)
        ids = [self.marked[p] for p in parts if p in self.marked]
        rank = self.rank_of.get
        ranks = [rank(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NONE)
        return ids

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left; ``word`` ends with the word-end mark."""
        out, at, n, known = [], 0, len(word), self.proposable
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                i = known.get(word[at:to])
                if i is not None:
                    out.append(i)
                    at = to
                    break
            else:
                return []
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair: does merging keep the border between the two tokens?

        Going back in time, the border always lies between a right-end part of the left
        token and a left-end part of the right one. It would be crossed if these two
        can merge before either of them is used up by its own token's next merge.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.size + v
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)
            crossed = (rank < NEVER) & (rank < until_x[live]) & (rank <= until_y[live])  # of equal ranks the leftmost merges first
            good[live[crossed]] = False
            u_at, v_at = self.formed[u], self.formed[v]
            keep = ~crossed & ((u_at >= 0) | (v_at >= 0))
            live, u, v, u_at, v_at = live[keep], u[keep], v[keep], u_at[keep], v_at[keep]
            undo_x = u_at > v_at
            i, j = live[undo_x], live[~undo_x]
            until_x[i], x[i] = u_at[undo_x], self.right[u[undo_x]]
            until_y[j], y[j] = v_at[~undo_x], self.left[v[~undo_x]]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-split words."""
        spelt = ["".join([self.letters[c] for c in w.encode("utf-8")]) + self.mark for w in words]
        found = [self.propose(s) for s in spelt]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(found)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        failed = counts == 0
        if len(inside):
            keys, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            failed[word[inside[~self.compatible(keys // self.size, keys % self.size)[which]]]] = True
        for k in np.flatnonzero(failed):
            found[k] = self.merge(spelt[k])
        return found

    def split_words(self, chunk: str) -> list[str]:
        return WORDS.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def encode_chunks(self, chunks: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of chunks without white space, as little-endian bytes. Special tokens count in the raw text."""
        known = {} if known is None else known
        split = []
        for c in chunks:
            if self.special_split and "<|" in c and self.special_split.search(c):
                split.append([("", self.special[p]) if p in self.special else (w, 0) for p in self.special_split.split(c) if p for w in ([""] if p in self.special else self.split_words(p))])
            else:
                split.append([(w, 0) for w in self.split_words(c)])
        unseen = [w for w in {w for s in split for w, _ in s if w} if w not in known]
        known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(unseen, self.encode_words(unseen), strict=True))
        return [b"".join([known[w] if w else int(i).to_bytes(4, "little") for w, i in s]) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as the file names no decoder."""
        names = self.tokens
        return " ".join([names[i] for i in ids.tolist()])


_LOADED: dict[str, tuple[WordBpe, ChunkCache]] = {}


def loaded(path: str) -> tuple[WordBpe, ChunkCache]:
    """The tokenizer of a worker process, read once."""
    if path not in _LOADED:
        bpe, words = WordBpe(path), {}

        def encode(chunks: list[str]) -> list[bytes]:
            if len(words) > CACHE:
                words.clear()
            return bpe.encode_chunks(chunks, words)
        _LOADED[path] = (bpe, ChunkCache(encode))
    return _LOADED[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    split = [chunks_of(folded(t)) for t in texts]
    ids = loaded(path)[1].fill(split).__getitem__
    return [b"".join(map(ids, s)) for s in split]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) for every document."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t"):
            ids = [np.frombuffer(b, "<i4") for b in encode_texts(path, texts)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[id_col, "ids"])
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the decoded text of each row's ids (null: empty)."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)[0]
        for b in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(out, pa.string())], names=[id_col, "text"])
    return encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("s")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: (id, n_tokens, ids_sha256, decoded_sha256), optionally the ids. No shuffle."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path)[0], hashlib.sha256
        for part, texts in pieces(batches, "t"):
            coded = encode_texts(path, texts)
            cols = [part.column("i"), pa.array([len(b) // 4 for b in coded], pa.int64()), pa.array([sha(b).hexdigest() for b in coded], pa.string()),
                    pa.array([sha(bpe.decode(np.frombuffer(b, "<u4")).encode("utf-8")).hexdigest() for b in coded], pa.string())]
            if with_ids:
                ends = np.cumsum([0, *(len(b) // 4 for b in coded)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)
