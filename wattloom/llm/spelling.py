"""Spelling variants: words one edit apart, by search schemes over suffix-ordered vocabularies.

Two words are *near* if one inserted, deleted or replaced character turns one into the other.
A word's form is its near word of largest count, if that is ``FACTOR`` times its own or more;
following forms to the last gives its root.

Search scheme: an edit leaves one half of a word as it is. So a near word is found by matching
the first half exactly and extending across the second with one error, or, in the mirrored
index (the other direction of the pair), by matching the last half and extending across the
first. A half is matched with its delimiter, thus at a word's end.

On Spark: a word goes, in both directions, to the groups of the halves that it or a word one
character shorter or longer would match, and groups to the tasks by hash. A task puts the
words of its groups, a bounded number at a time, into one delimited text and indexes it: the
suffix order, the characters before the suffixes (BWT), and for each character its places in
it, so that a rank is one binary search. All searches step together: a state is (word, place
in it, interval of suffix ranks, error used), and every step narrows all intervals with numpy.
A group of more than ``CROWD`` words is cut into parts; each part is indexed apart and asked
about by one part at a time, so no task holds the group whole.

Defined cases: null text has no words; equal words are one; repeated rows count each time; a
null id reads as no digits; empty tables give no rows; extra columns are ignored; a long text is
read a bounded block at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import pieces, staged

#: Latin-1 bytes: letters as they are, A-Z small, all others a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
LEAST_LENGTH, LEAST_COUNT, FACTOR, NOISE = 5, 3, 2, 97
CROWD = 20_000  # words of a group that are indexed together
INDEX = 300_000  # characters of an index
STATES = 200_000  # states that step together
HELD = 300_000  # different words that a task counts at once
BLOCK = 1 << 20


# -- vocabulary -------------------------------------------------------------
def runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters A-Z, a-z, U+00C0 to U+00FF of a text, A-Z small, as Latin-1; a bounded block at a time."""
    data, at = text.encode("latin-1", "replace").translate(_FOLD), 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def noised(word: bytes, document: int, every: int = NOISE) -> bytes:
    """A Latin-1 word without one of its characters where ``every`` divides the checksum of ``<doc_id>:<word>`` (``document``: that of its first part)."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), document)
    return word if h % every else word[:(k := h % len(word))] + word[k + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = NOISE) -> DataFrame:
    """(word, n): runs of letters in all texts, thinned by ``noised``, with their numbers of occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def emit() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for part, texts in pieces(batches, "t"):
            for doc, text in zip(part.column("i").to_pylist(), texts, strict=True):
                own: Counter[bytes] = Counter()
                for block in runs(text):
                    own.update(block)
                prefix = zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    word = noised(word, prefix, every)
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield emit()
                    held.clear()
        yield emit()
    parts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# -- index ------------------------------------------------------------------
class Index:
    """Words in one delimited text, read backwards, so that a step of the search extends a match to the right."""

    def __init__(self, words: list[str]) -> None:
        # "$ab$cd$" reversed; 0 stands for the delimiter.
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)[::-1]
        self.letters, text = np.unique(points, return_inverse=True)
        self.size, self.count = len(text), len(self.letters)
        rank, step = text.astype(np.int64), 1
        while True:  # prefix doubling over the text read as a ring
            key = rank * (self.size + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty_like(rank)
            rank[order] = new
            step *= 2
            if new[-1] == self.size - 1 or step > 2 * self.size:
                break
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.places = np.sort(before.astype(np.int64) * self.size + np.arange(self.size))
        # Where a delimiter's suffix starts in the reversed text, the word that was read up to it ends.
        stops = np.nonzero(text == 0)[0]
        self.word = np.full(self.size, -1, np.int64)
        self.word[stops[:-1]] = np.arange(len(words))[::-1]
        self.order = order
        self.before = before

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers of characters; -1 where the index has none."""
        at = np.minimum(np.searchsorted(self.letters, points), self.count - 1)
        return np.where(self.letters[at] == points, at, -1)

    def step(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended by one letter each."""
        # A letter's places follow those of all smaller letters, so the rank comes with their number added.
        return np.searchsorted(self.places, letter * self.size + lo), np.searchsorted(self.places, np.where(letter < 0, -self.size, letter * self.size + hi))

    def grown(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All one-letter extensions that occur: (state, letter, lo, hi)."""
        wide = hi - lo > self.count
        state, letter = [], []
        if wide.any():
            state.append(np.repeat(np.nonzero(wide)[0], self.count - 1))
            letter.append(np.tile(np.arange(1, self.count), wide.sum()))
        narrow = np.nonzero(~wide)[0]
        if len(narrow):
            n = (hi - lo)[narrow]
            at = np.repeat(lo[narrow] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pair = np.unique(np.repeat(narrow, n) * self.count + self.before[at])
            pair = pair[pair % self.count > 0]
            state.append(pair // self.count)
            letter.append(pair % self.count)
        state, letter = np.concatenate(state), np.concatenate(letter)
        new_lo, new_hi = self.step(letter, lo[state], hi[state])
        good = new_hi > new_lo
        return state[good], letter[good], new_lo[good], new_hi[good]

    def near(self, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, word) numbers of all pairs one edit apart whose first ``exact`` characters of the asked one are the same."""
        length = np.array([len(w) for w in asked])
        flat = self.codes(np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32))
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        # A match starts with a delimiter, whose suffixes come first.
        who, lo = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        hi = np.full(len(asked), self.first[1])
        at, off = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        out = []
        while len(who):
            over = at == length[who]
            # At the end of a word with its error made, or made here by one more letter, a delimiter must follow.
            done = np.nonzero(over & off)[0]
            grow = np.nonzero(~off & (at >= exact[who]))[0]
            nexts = [np.nonzero(~over)[0]]
            letter = flat[start[who[nexts[0]]] + at[nexts[0]]]
            a, b = self.step(letter, lo[nexts[0]], hi[nexts[0]])
            new = [(who[nexts[0]], at[nexts[0]] + 1, off[nexts[0]], a, b)]
            if len(grow):
                skip = grow[~over[grow]]  # the asked word's character is left out
                new.append((who[skip], at[skip] + 1, np.ones(len(skip), bool), lo[skip], hi[skip]))
                s, c, a, b = self.grown(lo[grow], hi[grow])
                g = grow[s]
                new.append((who[g], at[g], np.ones(len(g), bool), a, b))  # a letter more
                own = np.where(over[g], -1, flat[np.minimum(start[who[g]] + at[g], len(flat) - 1)])
                other = ~over[g] & (own != c)  # another letter
                new.append((who[g][other], at[g][other] + 1, np.ones(other.sum(), bool), a[other], b[other]))
            if len(done):
                a, b = self.step(np.zeros(len(done), np.int64), lo[done], hi[done])
                hit = b > a
                out.append((who[done][hit], a[hit]))
            who, at, off, lo, hi = (np.concatenate(x) for x in zip(*new, strict=True))
            some = hi > lo
            who, at, off, lo, hi = who[some], at[some], off[some], lo[some], hi[some]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, row = (np.concatenate(x) for x in zip(*out, strict=True))
        word = self.word[self.order[row]]
        return who[word >= 0], word[word >= 0]  # the text's two ends meet in an empty word


def _search(held: list[tuple[str, bool, bool]]) -> Iterator[tuple[str, str]]:
    """Pairs within (word, indexed, asked) rows."""
    index = list(dict.fromkeys(w for w, i, _ in held if i))
    asked = list(dict.fromkeys(w for w, _, a in held if a))
    if not index or not asked:
        return
    found = Index(index)
    for lo in range(0, len(asked), max(1, STATES // 20)):
        some = asked[lo:lo + max(1, STATES // 20)]
        who, word = found.near(some, np.array([len(w) // 2 for w in some]))
        for a, b in zip(who.tolist(), word.tolist(), strict=True):
            if some[a] != index[b]:
                yield some[a], index[b]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows (side, part, word, indexed, asked), which come sorted by side and part."""
    def turned(side: int, held: list[tuple[str, bool, bool]]) -> Iterator[pa.RecordBatch]:
        found = list(dict.fromkeys(_search(held)))
        for lo in range(0, len(found), 50_000):
            a, b = ([w if side == 0 else w[::-1] for w in x] for x in zip(*found[lo:lo + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    held, size, last = [], 0, None
    for batch in batches:
        for side, part, word, indexed, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and (side, part) != last and (size >= INDEX or side != last[0]):
                yield from turned(last[0], held)
                held, size = [], 0
            held.append((word, indexed, asked))
            size += (len(word) + 1) * indexed
            last = (side, part)
    if held:
        yield from turned(last[0], held)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), both ways round, of all words in ``words`` (word) that are one edit apart."""
    length = F.length("word")
    sides = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")),
                                          F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w")))).alias("x")).select("x.side", F.col("x.w").alias("word"))
    half = (length / 2).cast("int")
    # The halves of words one character shorter or longer; the own one is also what the word asks for.
    halves = F.array_distinct(F.array(half, ((length - 1) / 2).cast("int"), ((length + 1) / 2).cast("int")))
    keyed = sides.select("side", "word", F.explode(halves).alias("h")).select(
        "side", "word", F.xxhash64("side", F.substring(F.col("word"), F.lit(1), F.col("h"))).alias("key"), (F.col("h") == (F.length("word") / 2).cast("int")).alias("asks"))
    keyed = staged(keyed, "halves")
    size = staged(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).where("parts > 1"), "crowded_halves")
    known = keyed.join(size, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # As one of an index a word meets all parts that ask, and asking it meets all parts of the index.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    indexed = F.transform(every, lambda x: F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("indexed"), (F.col("asks") & (x == F.col("own"))).alias("asked")))
    asked = F.transform(F.filter(every, lambda x: F.col("asks") & (x != F.col("own"))), lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")))
    rows = known.withColumn("own", own).select("side", "key", "word", F.explode(F.concat(indexed, asked)).alias("x"))
    rows = rows.select("side", F.xxhash64("key", "x.i", "x.j").alias("part"), "word", "x.indexed", "x.asked")
    return rows.repartition("side", "part").sortWithinPartitions("side", "part").mapInArrow(_pairs, "a string, b string").distinct()


# -- forms ------------------------------------------------------------------
def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, every: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that are long and frequent enough."""
    words = staged(vocabulary(docs, every=every).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    pairs = staged(near_pairs(words), "near_pairs")
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # Largest count, then first word in code-point order: the smallest of (-count, word).
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    strong = -F.col("best.m") >= factor * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    forms = staged(forms, "forms")
    # Counts grow by the factor with every form, so chains are short; each round doubles the way that a word has gone.
    most = forms.agg(F.max("n")).first()[0] or 1
    longest = max(1.0, math.log(most) / math.log(factor))
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    for k in range(math.ceil(math.log2(longest)) + 1):
        roots = staged(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("word", F.col("next").alias("root")), f"roots_{k}")
    return forms.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
