"""Spelling variants, embedding near-duplicates and collocations against brute force; near-dedup groups; odd characters."""

import itertools
import random
import re
import resource
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattloom.llm import bpe, colloc, decontam, embed, hdlang, resemblance, spelling
from wattloom.llm.common import digest_key
from wattloom.llm.queries import ORACLE, tokenizer_path

DOCS = "doc_id long, text string, lang string, word string, lang_ string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", "l", 1) for i, t, lang in rows], DOCS)


# -- spelling ---------------------------------------------------------------
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize(("crowd", "index"), [(20_000, 300_000), (7, 20)])
def test_near_pairs_equal_brute_force(spark, monkeypatch, crowd, index):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "INDEX", index)
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(300)} | {"ab" * 200, "ab" * 200 + "a"})
    found = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(found) == len({(x.a, x.b) for x in found})
    assert {(x.a, x.b) for x in found} == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 20)
    monkeypatch.setattr(spelling, "BLOCK", 50)
    r = random.Random(4)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 8))) for _ in range(12)]
    pool = [w for k, w in enumerate(base) for _ in range(2 ** (k % 6))] + [w[:2] + "x" + w[3:] for w in base] + [w + "s" for w in base] + ["Straße", "Straßen", "ÀÉ×÷ÿ"]
    rows = [(k, " ".join(r.choice(pool) for _ in range(r.randint(0, 60))).title(), "en") for k in range(60)]
    rows += [(None, "Hello hello HELLO, jello jello jello", None), (7, None, None), (8, "", "en"), (9, "Łódź hello-jello", "en"), (9, "Łódź hello-jello", "en")]
    count = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: (b if (b := min(near[w], key=lambda v: (-n[v], v), default=None)) and n[b] >= 2 * n[w] else None) for w in n}

    def root(w):
        return root(form[w]) if form[w] else w
    got = {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(docs_of(spark, rows)).collect()}
    assert got == {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n} and sum(f is not None for f in form.values()) > 3
    assert spelling.variants(docs_of(spark, [])).count() == 0


# -- embeddings -------------------------------------------------------------
EMB = "vec_id long, embedding array<float>, label int, c long, v string, digest string"


def brute_links(rows):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    links = {k: [] for k in range(len(rows))}
    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= 0.93:
            links[a].append(b)
            links[b].append(a)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            todo = [b for a in todo for b in links[a] if b not in seen and not seen.add(b)]
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        out.append((rows[k][0], len(links[k]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 5])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "BUCKET", 20)
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for label in (0, 1):
        for size, noise in ((40, 0.02), (25, 0.045), (6, 0.03), (1, 0)) + ((1, 0),) * 60:
            centre = rng.standard_normal(32)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                rows.append((i, (centre + noise * rng.standard_normal(32)).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, rows[0][1], None), (i + 3, None, 0), (i + 4, [0.0] * 32, 0), (i + 5, [1.0] * 31 + [None], 0),
             (i + 6, [float("nan")] * 32, 0), (i + 7, [], 0), (None, [3.0] * 16, 0), (None, [1.0] * 16, 0), (i + 8, [1.0, 2.0], 1), (i + 9, [2.0, 4.0], 1), (i + 10, [-1.0, -2.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], EMB)
    got = sorted(((x.id, x.n_links, x.component) for x in embed.near_duplicates(frame).collect()), key=str)
    want = brute_links(rows)
    # Pairs at the very threshold meet with probability RECALL; none is invented, and no component is lost.
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) > 1000
    assert embed.near_duplicates(spark.createDataFrame([], EMB)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    d, errors, inside = 64, [], []
    x = np.random.default_rng(1).standard_normal((2, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for seed in range(400):
        r = x @ embed.rotation(d, seed)
        o = np.abs(r[:1]).sum(1) / d ** 0.5
        guess, bound = embed.estimate(np.sign(r[:1]), o, r[1:], np.zeros(1), np.ones(1))
        errors.append(guess[0, 0] - x[0] @ x[1])
        inside.append(abs(errors[-1]) <= bound[0, 0] - embed.SURE / (2 * o[0]))  # nothing is rounded here
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 20 and np.mean(inside) > 0.995


# -- collocations -----------------------------------------------------------
@pytest.mark.parametrize(("block", "pending"), [(1 << 20, 1_000_000), (40, 30)])
def test_collocations_equal_their_sql(spark, monkeypatch, tmp_path, block, pending):
    monkeypatch.setattr(colloc, "BLOCK", block)
    monkeypatch.setattr(colloc, "PENDING", pending)
    r = random.Random(5)
    words = ["the", "of", "New", "york", "city", "x y", "é", "ä", "long" * 30, "a", "b", "a"]
    rows = [(k, "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(r.randint(0, 200))), r.choice(["en", "de", None, "und"])) for k in range(120)]
    rows += [(1, None, "en"), (2, "", None), (None, "New York city of the new york city", "en"), (None, "New York city of the new york city", "en"), (3, "a a a a a a a a a a a a a", "xx")]
    frame = docs_of(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op13_collocations"]).fetchall()
    got = [tuple(x) for x in colloc.ranked(colloc.collocations(frame), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    assert colloc.ranked(colloc.collocations(docs_of(spark, [])), 5).count() == 0


def test_ranking_is_whole_with_ties(spark):
    rows = [("en", f"p{k:03}", 10 + k % 3, 7 * (k % 5)) for k in range(200)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(x.rank, x.phrase) for x in colloc.ranked(frame, 90).orderBy("rank").collect()]
    want = sorted(rows, key=lambda x: (-x[3], -x[2], x[1]))[:90]
    assert got == [(k + 1, x[1]) for k, x in enumerate(want)]


# -- near-dedup of the pipeline ---------------------------------------------
def similar_groups(texts):
    sets = {i: frozenset(resemblance.shingles(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("fewest", "most", "pairs"), [(8, 9, 0), (0, 9, 3000)])
def test_a_group_with_a_common_base_is_not_paired_off(spark, monkeypatch, fewest, most, pairs):
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]

    def edited(k):
        w = list(base)
        for at in r.sample(range(0, 150, 6), k):
            w[at] = f"w{r.randrange(5000)}"
        return " ".join(w)
    texts = {i: edited(r.randint(fewest, most)) for i in range(250)}
    met = []
    monkeypatch.setattr(resemblance, "unlinked_pairs", lambda sets, plain=resemblance.unlinked_pairs: met.append(plain(sets)) or met[-1])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("k", digest_key(F.col("doc_id"), F.col("text")))
    kept = {x.doc_id for x in frame.join(resemblance.first_of_each(frame, "k").select(F.col("key").alias("k")), "k").collect()}
    assert kept == set(similar_groups(texts).values())
    assert met[0].count() <= pairs  # of 31,125


# -- odd characters ---------------------------------------------------------
def test_ids_of_letters_with_marks_equal_the_library(spark):
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = [chr(c) for c in range(0x41, 0x250) if unicodedata.category(chr(c))[0] == "L"]
    texts = [" ".join(a + m for m in marks) for a in letters] + ["J̌", "H̱ T̈", "W̊Y̊", "İ̇ ΑΣ́ Σ"]
    library = Tokenizer.from_file(tokenizer_path())
    frame = docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])
    for x in bpe.round_trip(frame, tokenizer_path(), with_ids=True).collect():
        assert x.ids == library.encode(texts[x.doc_id], add_special_tokens=False).ids, texts[x.doc_id][:20]


def test_marks_alone_are_no_letter(spark):
    rows = [(0, "der hund und die katze", "de"), (1, "the dog and the cat", "en"), (2, "❤️ 1️⃣", None), (3, "́", None), (4, "thé dog", None)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in hdlang.identify(docs_of(spark, rows)).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"


def test_decontamination_counts_characters_in_any_script():
    item = "".join(chr(0x4E00 + (k * 37) % 900) for k in range(60))
    index = decontam.Index([("zh", item)])
    assert index.k[0] == 6
    changed = list(item)
    for k in (5, 20, 35, 50):
        changed[k] = "é"
    doc, _, edits = index.search(["前" * 50 + "".join(changed) + "后" * 50, "前" * 300, item[:25]])
    assert doc.tolist() == [0] and edits.tolist() == [4]


def test_one_character_repeated_takes_bounded_memory():
    index = decontam.Index([("line", "_" * 200), ("text", "an ordinary item of the benchmark, long enough to make more than one window of text")])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    doc, win, edits = index.search(["_" * 500_000, "_" * 63 + "x" * 500])
    assert set(doc.tolist()) == {0, 1} and set(edits[doc == 0].tolist()) == {0}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB; 15 GB before
