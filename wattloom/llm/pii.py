"""Personal data: detected entities get keyed surrogates of their own type and format.

Detection finds e-mail and IPv4 addresses, telephone, card and social-security numbers,
access keys, quoted secrets, and persons after a title. An entity's *value* is what its
spellings share (digits without separators, lower-case address, single names), so all
mentions of it, in all documents, get the same surrogate, each in its own spelling.

Surrogates come from a keyed hash and keep type and format: number of digits, separators,
country code, card issuer and check digit, private address ranges, letter case, script of a
name, gender of a given name. A surrogate that another value has, or that is itself a value
found in the corpus, is drawn again: the smallest value keeps it, the others go on, until
none is left over. So different entities stay different, and no surrogate is a real entity.

Defined cases: null text stays null and has no entity; rows that agree in all columns are
treated alike; overlapping findings: the first, at one place that of the earlier kind; where a
format's whole space is used up, a surrogate grows by a digit or letter. Other columns are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import digest_key, fresh, pieces, staged

#: Titles that make the words after them a person's name, with the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Herrn": "m", "Frau": "f",
          "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f"}
NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]*(?:[-'’][^\W\d_]+)*"
KINDS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("secret", r"(?i:(?<=token = \")|(?<=token: \")|(?<=token=\")|(?<=secret = \")|(?<=secret=\")|(?<=password = \")|(?<=password=\")|(?<=api_key = \")|(?<=api_key=\"))[^\"\s]{8,}(?=\")"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]?\d{2,4}(?:[ .-]\d{2,4})?(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"),
    ("person", rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {NAME}(?: {NAME}){{0,2}}"),
]
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
HINT = re.compile(r"[@\d\"]")
# Syllables of made-up names by script; endings by gender.
SYLLABLES = {
    "LATIN": ("ba be bi bo da de di do fa fi ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi".split(), {"m": "n r s l".split(), "f": "a ia ina".split(), "n": "en el is".split()}),
    "CYRILLIC": ("ба бе бо ва ве ви го да де ди ка ки ла ле ли ма ми мо на не ни но па ра ре ри ро са со та те ти то".split(), {"m": "н р й т".split(), "f": "а ия ина".split(), "n": "ко ич ук".split()}),
    "GREEK": ("βα γα δε δη ζω θε κα κω λε λι μα με νι νο πα πε ρα ρι σα σω τα τε φι χα".split(), {"m": "ος ης ας".split(), "f": "α η ω".split(), "n": "ου ιδης ακης".split()}),
}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order."""
    if not HINT.search(text) and not any(t in text for t in TITLES):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        digits = sum(c.isdigit() for c in m[0])
        if kind == "phone" and not 7 <= digits <= 15:
            continue
        out.append((a, b, kind))
    return out


def script_of(name: str) -> str:
    for c in name:
        word = unicodedata.name(c, "").split(" ")[0]
        if word in SYLLABLES:
            return word
    return "LATIN"


def parts(mention: str, kind: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of a mention's independently replaced parts: itself, or a person's names."""
    if kind == "person":
        title = re.match(r"\w+", mention)[0]
        names = [m for m in re.finditer(NAME, mention[len(title):])]
        out = []
        for k, m in enumerate(names):
            gender = TITLES.get(title, "n") if k < len(names) - 1 else "s"  # the last name is the family's
            value = m[0].lower()
            out.append((m.start() + len(title), m.end() + len(title), f"name_{gender}_{script_of(value)}", value))
        return out
    if kind == "email":
        value = mention.lower()
    elif kind in ("card", "ssn", "phone"):
        value = "".join(c for c in mention if c.isdigit())
        if kind == "phone" and mention.startswith("+1") and len(value) == 11:
            value = value[1:]  # the same number with and without country code
    else:
        value = mention
    return [(0, len(mention), kind, value)]


class Draw:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(what).encode("utf-8"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the same sort."""
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        return c


def check_digit(digits: str) -> str:
    """The digit that makes a card number pass the mod-10 test."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate value that the ``attempt``-th draw gives."""
    d = Draw(key, kind, value, str(attempt))
    more = "".join(str(d.below(10)) for _ in range(attempt // 32))  # the format's space is used up
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        host = Draw(key, "domain", domain, "0")  # one domain, one surrogate domain
        names = labels[:-2] + ([labels[-2]] if labels[-2] != "example" else [])
        new = ["".join(map(host.like, x)) for x in names] + labels[len(names):]
        return "".join(map(d.like, local)) + more + "@" + ".".join(new)
    if kind == "ip":
        octets = value.split(".")
        fixed = {"10": 1, "127": 1}.get(octets[0], 2 if octets[:2] in (["192", "168"], ["169", "254"]) else 0)
        return ".".join(octets[:fixed] + [str(1 + d.below(223 if k == 0 else 254)) for k in range(4 - fixed)]) + more
    if kind == "card":
        body = value[0] + "".join(str(d.below(10)) for _ in value[1:-1]) + more
        return body + (check_digit(body) if check_digit(value[:-1]) == value[-1] else str(d.below(10)))
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}{more}"
    if kind == "phone":
        keep = max(0, len(value) - 10)  # country code
        return value[:keep] + str(2 + d.below(8)) + "".join(str(d.below(10)) for _ in value[keep + 1:]) + more
    if kind == "access_key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in value[4:]) + more
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in value)
        return "".join("0123456789abcdef"[d.below(16)] if hexadecimal else d.like(c) for c in value) + more
    _, gender, script = kind.split("_")
    syllables, endings = SYLLABLES[script]
    end = endings["n" if gender == "s" else gender]
    return "".join(syllables[d.below(len(syllables))] for _ in range(2 + d.below(2) + attempt // 32)) + end[d.below(len(end))]


def render(mention: str, kind: str, value: str, new: str) -> str:
    """The surrogate in the spelling of a mention: separators, country code, letter case."""
    if kind in ("card", "ssn", "phone"):
        digits = sum(c.isdigit() for c in mention)
        source, out = iter(new), []
        skip = digits - len(value)
        for c in mention:
            if c.isdigit() and skip > 0:
                skip -= 1
                out.append(c)
            else:
                out.append(next(source, "") if c.isdigit() else c)
        return "".join(out) + "".join(source)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind.startswith("name_"):
        return new.upper() if len(mention) > 1 and mention.isupper() else new.title() if mention[:1].isupper() else new
    return new


MENTION = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def _detect(schema: T.StructType, where: int, wanted: bool):
    """Rows with (or without) entities; those with them get the list of their parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        names = [f"c{k}" for k in range(len(schema.fields) - wanted)]
        for batch in batches:
            for part, texts in pieces(iter([pa.RecordBatch.from_arrays(batch.columns, names=names)]), names[where]):
                found = [[{"a": a + x, "b": a + y, "kind": k, "value": v} for a, b, kind_ in find(t) for x, y, k, v in parts(t[a:b], kind_)] for t in texts]
                mask = pa.array([bool(f) == wanted for f in found])
                rows = part.filter(mask).columns
                if wanted:
                    rows = [*rows, pa.array([f for f in found if f], kind)]
                yield pa.RecordBatch.from_arrays(rows, names=schema.names)
    return run


def _proposals(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, k, v, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "value", "new"])
    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, new) for different entities (kind, value): a one-to-one choice of surrogates.

    Each round draws for what is left, keeps every surrogate's smallest value, and returns
    the others to the next round. The driver sees counts only; rounds are few, since few
    draws collide.
    """
    entities = staged(entities.distinct(), "entities")
    real = entities.select("kind", F.col("value").alias("new"))
    done, left = None, entities
    for attempt in count():
        drawn = staged(left.mapInArrow(_proposals(key, attempt), "kind string, value string, new string").join(real, ["kind", "new"], "left_anti"), "drawn")
        if done is not None:
            drawn = drawn.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        chosen = staged(drawn.groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new"), "chosen")
        done = chosen if done is None else done.unionByName(chosen)
        left = staged(left.join(chosen, ["kind", "value"], "left_anti"), "left")
        if left.isEmpty():
            return done


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_name: str | None = None) -> DataFrame:
    """``docs`` with surrogates in place of entities; optionally the number of replaced parts.

    Documents without entities pass where they lie; only those with entities meet their
    surrogates in a shuffle.
    """
    where = docs.columns.index(text_col)
    mentions, row, pairs_name = fresh(docs, "mentions_", "row_", "pairs_")
    marked = T.StructType([*docs.schema.fields, T.StructField(mentions, MENTION)])
    dirty = staged(docs.mapInArrow(_detect(marked, where, True), marked).withColumn(row, digest_key(F.col(id_col), F.col(text_col))), "dirty")
    seen = dirty.select(F.col(row).alias("row"), F.explode(mentions).alias("m")).select("row", "m.kind", "m.value").distinct()
    chosen = staged(assign(seen.select("kind", "value"), key), "surrogates")
    per = seen.join(chosen, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "new")).alias("pairs"))  # of one document
    joined = dirty.join(per.select(F.col("row").alias(row), F.col("pairs").alias(pairs_name)), row).drop(row)
    out = docs.schema if not count_name else T.StructType([*docs.schema.fields, T.StructField(count_name, T.LongType())])
    width = len(docs.columns)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, found, pairs in zip(batch.column(where).to_pylist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                new = {(p["kind"], p["value"]): p["new"] for p in pairs}
                at, built = 0, []
                for m in found:
                    built += [text[at:m["a"]], render(text[m["a"]:m["b"]], m["kind"], m["value"], new[m["kind"], m["value"]])]
                    at = m["b"]
                texts.append("".join([*built, text[at:]]))
                sizes.append(len(found))
            cols = batch.columns[:width]
            cols[where] = pa.array(texts, cols[where].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64())][:len(out.fields)], names=out.names)
    clean = docs.mapInArrow(_detect(docs.schema, where, False), docs.schema)
    if count_name:
        clean = clean.withColumn(count_name, F.lit(0).cast("long"))
    return clean.union(joined.mapInArrow(rewrite, out))
