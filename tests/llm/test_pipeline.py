"""The pipeline against brute force, its contract, and the guard around the subpackage."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from test_search_operators import similar_groups
from test_text_operators import brute_lines, prose, semi_global
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from wattloom.llm import decontam, golay, resemblance, stages
from wattloom.llm.queries import tokenizer_path

ROOT = Path(__file__).resolve().parents[2]


def corpus():
    r = random.Random(12)
    bench = [prose(900 + k, 30, 600) for k in range(3)]
    texts = [None, "", "123 !!", "short text"]
    for k in range(40):
        lines = [prose(1000 + 10 * k + j, r.randint(4, 30), 400) for j in range(r.randint(1, 6))]
        texts.append("\n".join(lines))
    shared = "\n".join(prose(2000 + j, 9, 400) for j in range(3))
    texts += [texts[10], texts[11] + "\n" + shared, texts[12] + "\n" + shared, texts[13].replace("\n", " \n", 1), prose(3000, 60, 300), prose(3000, 60, 300) + " x",
              prose(3001, 40) + " " + bench[1] + " " + prose(3002, 40), bench[0].upper()]
    return texts, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts, bench = corpus()
    rows = [(k * 3, t, "en" if k % 2 else "de", "src", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}

    docs = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    cleaned = brute_lines(docs, 3, 50)
    docs = [(i, cleaned[i][2]) for i, _ in docs if not (cleaned[i][1] and not cleaned[i][2].strip())]
    groups = similar_groups(dict(docs))
    docs = [(i, t) for i, t in docs if groups[i] == i]
    windows = [w for b in bench for w in decontam.windows_of(b)]
    docs = [(i, t) for i, t in docs if not any(semi_global(w, decontam.normalized(t)) <= decontam.budget(len(w)) for w in windows)]
    tok = Tokenizer.from_file(tokenizer_path())
    assert set(got) == {i for i, _ in docs} and 30 < len(docs) < len(texts) - 5
    for i, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_bear_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, key_ string, c0 string"
    rows = [(None, None, None, None, None, "r", "k", "c"), (1, "one two three", "en", None, None, "r", "k", "c"), (1, "one two three", "en", None, None, "r", "k", "c"),
            (None, "another text of some words", "en", None, None, "r", "k", "c")]
    spark.createDataFrame([(0, "benchmark item text of some length")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        out = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == ([(0, 5), (1, 3)] if data else [])


def test_the_pipeline_is_what_was_asked_for():
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and cp.ORACLE_SQL is None and "pipeline" in entry.queries()
    for n in range(1, 11):
        assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def test_entry_works_without_the_subpackage():
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('wattloom.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) > 190 and 'pipeline' not in e.queries() and not any(q.startswith('op') and '_' in q and q[2:3].isdigit() for q in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)


def jaccard(a, b):
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup_follows_the_rule_of_five_words_and_four_fifths(spark):
    r, texts = random.Random(80), []
    for k in range(60):  # copies with changed words: similarities from about 0.65 to 0.95
        words = prose(5000 + k, 200).split()
        texts.append(" ".join(words))
        for c in range(2):
            copy = list(words)
            for at in r.sample(range(200), 1 + (k + 3 * c) % 8):
                copy[at] = f"changed{k}x{c}x{at}"
            texts.append(" ".join(copy))
    texts += [f"{prose(6000, 300)} {prose(6001 + k, 1)} end{k}" for k in range(300)] + ["alpha beta", "alpha  Beta", "gamma"]  # a crowd, short texts
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    between = 0
    for groups in (range(a, a + 3) for a in range(0, 180, 3)):
        for i in groups:
            for j in groups:
                if i < j:
                    s = jaccard(texts[i], texts[j])
                    between += 0.8 <= s < 0.95
                    if s >= 0.8:
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    kept = {i for i in range(180) if root[i] == i} | {180, 480, 482}
    assert between > 40 and len(kept) > 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in stages.simhash_near_dedup(spark, docs, "").collect()} == kept


def test_bands_miss_next_to_nothing_at_four_fifths():
    r, shared = np.random.default_rng(8), 0
    for _ in range(2000):
        x = r.integers(0, 1 << 63, 180, dtype=np.uint64)
        shared += (resemblance.band_keys(x[:160 + 2]) == resemblance.band_keys(x[18:])).any()  # 144 of 180
    assert shared == 2000


def brute_runs(texts, run=3, words=50):
    """Lines covered by runs of lines, of ``run`` lines or ``words`` words, that begin at an earlier place too."""
    seen, out = set(), []
    for t in texts:
        lines, gone = t.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, min(a + run, len(lines)) + 1):
                part = lines[a:b]
                if any(x.strip(" ") for x in part) and (len(part) == run or len(" ".join(part).split()) >= words):
                    if tuple(part) in seen:
                        gone |= set(range(a, b))
                    seen.add(tuple(part))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_stage_takes_passages_of_fifty_words_in_any_layout(spark):
    r = random.Random(50)
    line = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    passages = [[line(1, 11), line(2, 43)], [line(3, 30), line(4, 40)], [line(5, 25), line(6, 25)], [line(7, 60).replace(" ", "\t")], [line(8, 60)], [line(9, 20), "", line(10, 5)],
                [line(11, 24), line(12, 25)], [line(13, 49)], [line(14, 50).replace(" ", "\u00a0")], [line(15, 49), ""], [line(16, 49), "  " * 30]]
    texts = []
    for k in range(60):
        parts = [[line(1000 + 9 * k + j, r.randint(3, 9))] for j in range(3)] + r.sample(passages, 3)
        r.shuffle(parts)
        texts.append("\n".join(x for p in parts for x in p))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "length(text) AS n_chars")
    got = [x.text for x in stages.line_dedup(spark, docs, "").orderBy("doc_id").collect()]
    expected = brute_runs(texts)
    assert got == expected
    assert sum("w1x0 " in t for t in got) == sum("w5x0 " in t for t in got) == 1 < sum("w11x0 " in t for t in got)


def test_simhash_links_near_copies_without_any_band(spark, monkeypatch):
    texts = [prose(7000 + k, 400) for k in range(6)]
    for k in range(6):  # the last word changed
        texts.append(" ".join([*texts[k].split()[:-1], "changed"]))
    far = " ".join(w for k, w in enumerate(texts[0].split()) if k % 40)  # ten words less: out of reach
    texts += ["", None, far]
    apart = np.bitwise_count(np.array([golay.fingerprint(texts[k]) ^ golay.fingerprint(texts[k + 6]) for k in range(6)], np.uint64))
    assert (apart <= 4).all() and apart.any()
    # no two sets share a band: what is found comes from the fingerprints
    monkeypatch.setattr(resemblance, "band_keys", lambda hashes: np.arange(40, dtype=np.int64) + int(hashes.sum() >> np.uint64(2)) // 64 * 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in stages.simhash_near_dedup(spark, docs, "").collect()}
    assert not kept & set(range(6, 12)) and kept >= set(range(6)) and len(kept & {12, 13}) == 1
