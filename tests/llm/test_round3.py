"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language, quality, resample, secrets, toxicity, trie

CLASHING = ("word", "stem", "toxic", "score", "rank", "part", "at", "before", "class", "depth", "parent", "pos", "key", "tokens")


def wide(df):
    """Extra columns whose names clash with the operators' own."""
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING) if c not in df.columns})


# -- 11 --------------------------------------------------------------------------------------------------------


def test_composition_is_a_cascade():
    rng = random.Random(3)
    parts = [toxicity.within("target", 4, "target", 0.5), toxicity.within("negation", 3, "negated", 0.25), toxicity.within("report", 0, "reported", 2.0)]
    composed = toxicity.compose(toxicity.compose(parts[0], parts[1], toxicity.SYMBOLS), parts[2], toxicity.SYMBOLS)
    for _ in range(300):
        tape = rng.choices(toxicity.SYMBOLS, k=rng.randrange(12))
        out, total = tape, 0.0
        for p in parts:
            out, w = p.read(out)
            total += w
        assert composed.read(tape) == (out, pytest.approx(total))


def marks(tape, i):
    """Marks of the hit at i by looking back through its clause."""
    clause = tape[max([k + 1 for k in range(i) if tape[k] == "end"], default=0) : i]
    back = clause[::-1]
    return tuple(m for m, on in (("target", "target" in back[:4]), ("negated", "negation" in back[:3]), ("reported", "report" in back)) if on)


def test_grammar_marks_hits_by_their_clause():
    composed = toxicity.grammar()
    for tape in product(["insult", "target", "negation", "report", "end", "other"], repeat=5):
        out, _ = composed.read(list(tape))
        assert out == ["+".join((s, *marks(tape, i))) if s == "insult" else s for i, s in enumerate(tape)]


def test_features_score_clauses():
    reader = toxicity.Reader(toxicity.Lexicon({"fool": ("insult", 3.0)}, {"grob": 2.0}, {"you": "target", "not": "negation", "said": "report"}, [4]))
    f = lambda text: dict(zip(toxicity.FEATURES, reader.features(text), strict=True))
    assert f("") == dict.fromkeys(toxicity.FEATURES, 0.0)
    assert f("You FOOL! You are kind.")["target"] == pytest.approx(math.log1p(3)) and f("You are kind. A fool.")["target"] == 0
    assert f("not a fool")["negated"] == pytest.approx(math.log1p(3)) and f("he said you not fool")["reported"] == pytest.approx(math.log1p(3))
    assert f("grobian grobe; fool")["heaviest"] == pytest.approx(math.log1p(4)) and f("grobian")["plain"] == pytest.approx(math.log1p(2))


def test_weights_are_a_minimum():
    rng = np.random.default_rng(1)
    rows = rng.random((400, len(toxicity.FEATURES))) * 3
    toxic = (rows[:, 0] + rng.normal(0, 0.5, 400) > 1.5).astype(int)
    w = toxicity.fit_weights(rows, toxic)
    loss = lambda v: np.sum(np.logaddexp(0, toxicity.design(rows) @ v) - toxic * (toxicity.design(rows) @ v)) + 0.5 * np.sum(toxicity.TRUST * (v - toxicity.BEFORE) ** 2)
    assert all(loss(w) <= loss(w + d) + 1e-7 for d in rng.normal(0, 0.01, (50, len(w))))


def toxic_corpus(n=400):
    rng = random.Random(5)
    syllables = ["ba", "do", "ke", "li", "mu", "na", "po", "ri", "su", "ta"]
    say = lambda k: [rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables) for _ in range(k)]
    rows, labels = [], []
    for i in range(n):
        words, bad = say(60), i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(60), rng.choice(["grunz" + rng.choice(syllables) + rng.choice(syllables), "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if bad else 0))
    copy = "you absolute dunderhead of a zonk, every copy says so"
    rows += [(n + k, copy) for k in range(50)] + [(n + 50, None), (n + 51, ""), (None, "moron"), (n + 52, "xy " * 40_000 + "moron")]
    labels += [(n + k, 1) for k in range(50)] + [(n + 51, None), (None, 1), (0, 0)]
    return rows, labels


def test_toxicity_learns_stems_not_copies(spark):
    rows, labels = toxic_corpus()
    docs, marked = wide(spark.createDataFrame(rows, "doc_id long, text string")), wide(spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = docs.filter("doc_id % 4 = 0 and doc_id % 8 = 4 or doc_id % 8 = 1")
    model = toxicity.learn(docs.join(held.select("doc_id"), "doc_id", "left_anti"), marked)
    assert any("grunz".startswith(s) or s.startswith("grunz") for s in model.lexicon.stems) and not any(s.startswith(("zonk", "dunder")) for s in model.lexicon.stems)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()]
    assert Counter(i for i, _ in got) == Counter(i for i, _ in rows) and all(0 <= s <= 1 for _, s in got)
    by_id, truth = dict(got), dict(labels[:400])
    right = [(by_id[i] >= 0.3) == bool(truth[i]) for i in range(400) if i % 8 in (1, 4)]
    assert sum(right) >= 0.95 * len(right)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "you moron"), (2, "kind words")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()}
    assert got[1] > got[2]


def test_sample_is_bounded_and_distinct(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id long, text string")
    sample, worth = toxicity.sample_labelled(docs, spark.createDataFrame([(i, int(i // 2 % 4 == 0)) for i in range(40)], "doc_id long, toxic int"), 4)
    rows = sample.collect()
    assert Counter(r["toxic"] for r in rows) == {0: 4, 1: 4} and len({r["text"] for r in rows}) == 8 and worth == (15 / 4, 5 / 4)


# -- 12 --------------------------------------------------------------------------------------------------------


def brute_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


TEXTS = ["The cat, the HAT", None, "", "...", "Ünïcode wörds-and 12 numbers_x", "same words here " * 9, "same words here " * 9, "ÀÉ straße " * 30, "a" * 300, "\x00b\tc", "long text of words " * 3000]


@pytest.mark.parametrize(("longest", "piece"), [(1, 1 << 20), (2, 40), (3, 7)])
def test_features(monkeypatch, longest, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    for text in TEXTS:
        stream, n = resample.features((text or "").encode(), longest, 997)
        expected, n_words = brute_features(text, longest)
        assert n == n_words and Counter(stream.tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in expected)


def brute_resample(rows, target, longest, k, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, brute_features(text, longest)[0]))
    for text in target:
        t.update(map(bucket, brute_features(text, longest)[0]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + k) / ((s[b] + 1) * (t.total() + k)))) for b in range(k)]
    out = []
    for i, text in rows:
        fs, n = brute_features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, longest):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choices(["red", "green", "blue", "cat", "hat"], k=rng.randrange(60)))) for i in range(80)] + [(None, "cat hat " * 12)] + [(200, "cat hat " * 15)] * 7
    target = ["the cat in the hat", None, "hat cat"]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=101, percent=30, least_words=10).collect()
    expected, drawn = brute_resample(rows, target, longest, 101, 30, 10)
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(expected)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r["doc_id"], r["score"]) for r in ranked] == [(x[0], x[4]) for x in drawn]


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(some, none).collect()[0]["rank"] is None
    with pytest.raises(ValueError):
        resample.pack_streams(some, buckets=70_000)


def test_run_lengths():
    values = np.array([5, 1, 5, 5, 0, 1], np.uint16)
    assert [x.tolist() for x in resample.run_lengths(values)] == [[0, 1, 5], [1, 2, 3]] and not len(resample.run_lengths(values[:0])[0])


# -- 13 --------------------------------------------------------------------------------------------------------


def brute_trie(rows, every=20, most=4):
    own = defaultdict(list)
    order = lambda x: (x[1] is not None, x[1] or 0, hashlib.sha256(f"{len(x[2] or '')}:{x[2] or ''}{x[3] or ''}".encode()).hexdigest()[:32])
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - int(math.fmod(c, every))
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len((p[-1][1]).encode().split()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return Counter((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], ends(p)) for p in members)


def nodes(df):
    return Counter((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        length = rng.choice([1, 2, 3, 5, 9, 12])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", None, ""])) for t in range(length)]
    rows += [(500 + k, t, "user", f"turn {t}") for k in range(6) for t in range(30)]  # copies, deeper than a block
    rows += [(600, None, "user", "x"), (600, 1, "user", "tie"), (600, 1, "user", "tie"), (600, 1, "bot", "other"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("blocks", [(4, 4, 1 << 16), (1, 1, 1), (2, 3, 5)])
def test_trie(spark, blocks):
    rows = conversations(blocks[0])
    df = wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes(trie.build(df, blocks=blocks)) == brute_trie(rows)


def test_trie_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    bare = [c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 > 0][:2]  # their only turn is replaced by nothing
    for rows in ([(c, 0, "user", "gone") for c in bare], [(40, 0, "user", "stays")]):
        assert nodes(trie.build(spark.createDataFrame(rows, schema))) == brute_trie(rows)
    assert trie.build(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("module", ["trie", "exact_dedup"])
def test_modules_import_the_parts_of_arrow_that_they_use(module):
    done = subprocess.run([sys.executable, "-c", f"import pyarrow, millrace.llm.{module}; pyarrow.compute"], cwd=Path(trie.__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


# -- 10, rows whose ids repeat or are missing ------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_of_one_id_and_of_no_id(spark, weak):
    rows = [(7, f"text {i // 2}") for i in range(600)] + [(None, f"other {i // 3}") for i in range(300)] + [(None, "text 1"), (3, "other 5"), (None, None), (None, " ")]
    options = {"hash_key": lambda b: exact_dedup.hash64(bytes([len(b) % 3]))} if weak else {}
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode().translate(None, b" \t\n\x0b\x0c\r")).hexdigest()].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows) and all(r["group_size"] == len(groups[r["text_sha256"]]) for r in got)
    assert all(r["keep_id"] == (None if min(groups[r["text_sha256"]])[1] else min(groups[r["text_sha256"]])[2]) for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())


def test_exact_dedup_of_many_pairs_of_one_id_is_linear(spark):
    pairs = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 2)).alias("text"))
    got = exact_dedup.exact_duplicates(pairs).agg(F.count("*"), F.count_distinct("text_sha256"), F.count(F.when(F.col("kept"), 1)), F.max("group_size")).first()
    assert tuple(got) == (40_000, 20_000, 20_000, 2)


# -- 1, rules that overlap -------------------------------------------------------------------------------------


def english(rng, n):
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.choice((2, 3, 3, 4, 5, 6, 7, 8)))) for _ in range(600)]
    return ".\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n)) + "."


@pytest.mark.parametrize("text", [b"", b" \n", "Ab ab, --- abcd!\nÄö | x1\n\n(end.)  \n".encode(), "日本。\nA a …".encode(), b"a" * 300, b"...\n. a b? \n"])
def test_quality_statistics(text):
    data = np.frombuffer(b"zz top. " + text, np.uint8)  # a text before, so that borders matter
    found = {k: int(v[1]) for k, v in quality.statistics(data, np.array([0, 8, len(data)])).items()}
    words = [w.decode() for w in text.split()]
    plain = [w for w in words if any(c.isascii() and c.isalnum() or ord(c) > 127 for c in w)]
    chars = Counter(b for b in text.replace(b"\n", b"").replace(b" ", b"").lower())
    entropy = -sum(k / chars.total() * math.log2(k / chars.total()) for k in chars.values())
    ended = [line for line in text.decode().split("\n") if line.strip() and line.rstrip(" \t\"')]").endswith((".", "!", "?", ":", "。", "…"))]
    assert (found["n_words"], found["n_plain"], found["n_distinct"], found["n_short"]) == (len(words), len(plain), len(set(plain)), sum(len(w) <= 3 for w in plain))
    assert found["n_ended"] == len(ended) and found["entropy"] == math.floor(1000 * entropy)


def test_posterior_overrules_a_lone_drop(spark):
    rng = random.Random(11)
    clean = [(k, english(rng, 10)) for k in range(150)]
    verse = [(1000 + k, english(rng, 10).replace(".", "")) for k in range(8)]  # no line ends like a sentence, nothing else is wrong
    junk = [(2000 + k, "\n".join(f"{rng.randrange(10**12)}$$$ &&&" for _ in range(40))) for k in range(25)]
    rows = spark.createDataFrame(clean + verse + junk, "doc_id long, text string")
    found = quality.assess(rows)
    by = {r["doc_id"]: r for r in found.collect()}
    assert all(by[k]["kept"] for k, _ in clean) and not any(by[k]["kept"] for k, _ in junk)
    assert all(by[k]["kept"] and "D" in by[k]["votes"] for k, _ in verse)
    assert quality.overruled(found).first().asDict() == {"n_any_drop": 33, "n_kept_despite": 8, "n_dropped_without": 0}


def test_learning_says_when_it_has_not_settled():
    with pytest.warns(RuntimeWarning, match="not settled"):
        quality.learn({"DK-": 5, "KKD": 9, "K-K": 30}, rounds=1)


# -- 3 and 4 ---------------------------------------------------------------------------------------------------


def test_dictionary_is_filled_to_its_bound(spark):
    rng = random.Random(5)
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:04d}")
    counts = {name(k): n for k, n in enumerate([40] * 3 + [9, 8] + [2] * 30 + [1] * 200)}
    tokens = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(tokens)
    docs = spark.createDataFrame([(i, " ".join(tokens[i::20])) for i in range(20)], "doc_id long, text string")
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    for most in (0, 1, 2, 4, 20, 100, 234, 235, 1000):  # inside of classes, at their ends, and beyond all words
        assert secrets.learn_words(docs, most=most) == ranked[:most]
    assert secrets.learn_words(docs.limit(0)) == []


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(4)] + [(9, "more", None)], "doc_id long, text string, lang string")
    assert len(language.fit(docs, most=4).langs) == 4
    with pytest.raises(ValueError, match="more than 3"):
        language.fit(docs, most=3)


@pytest.mark.parametrize("seed", range(6))
def test_language_set_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.full(200, 0.05), 4).T + 1e-6
    p /= p.sum(axis=0)
    mixture = p @ np.array([[1, 0, 0, 0], [0.7, 0.3, 0, 0], [0.4, 0.3, 0.3, 0]][seed % 3])
    count = rng.multinomial(400, mixture / mixture.sum()).astype(float)
    p, count = p[count > 0], count[count > 0]

    def value(s):
        return language.proportions(p[:, s], count, np.zeros(1, np.int64))[1][0] - 0.5 * math.log(count.sum()) * (len(s) - 1)

    best = max((list(s) for k in range(1, 5) for s in combinations(range(4), k)), key=value)
    assert language.choose(p, count)[0] == best == list(range(seed % 3 + 1))
