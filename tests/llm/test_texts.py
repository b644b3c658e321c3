"""Phrase fingerprints, languages, quality and rules: brute force, held-out accuracy, awkward tables."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.llm import fingerprint as fp
from loglens.llm import language, rules, weak_quality
from loglens.llm.queries import QUERIES

AWKWARD = [
    (5, "one two three", "en", "clash", 9), (4, None, "fr", None, None), (3, "", "de", "s", 0), (2, "123 456 !!", None, "s", 1),
    (9, "w" * 200_000, "en", "s", 2), (7, "the same text again", "en", "s", 3), (7, "the same text again", "en", "s", 3),
    (None, "no id here at all", "es", "s", 4), (1, "é" * 50 + "\n" * 30 + " 漢字 🙂", "xx", "s", 5),
]
SCHEMA = "doc_id bigint, text string, lang string, key string, part int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def phrases(text):
    seen, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
    return seen


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé🙂 ", max_size=120), st.text(alphabet="abé ", max_size=80))
def test_edited_parse_equals_a_fresh_one(text, following):
    edited, own, changed = fp.edited_pair(text, following, 1000)
    assert edited == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    for whole, found in ((text, own), (edited, changed)):
        ends, _ = fp.Parser().feed(whole, 0)
        assert [whole[a:b] for a, b in zip([0, *ends], ends)] == phrases(whole)
        assert np.array_equal(fp.minima(whole, ends, 1000), found) and len(found) == len(ends)


def test_likeness_is_jaccard_of_phrases():
    a, b = "the cat sat on the mat and the dog", "the cat sat on the log and the frog"
    one, two = (fp.minima(t, fp.Parser().feed(t, 0)[0], 10_000) for t in (a, b))
    p, q = set(phrases(a)), set(phrases(b))
    assert fp.likeness(one, two, 10_000) == len(p & q) / len(p | q)
    assert fp.likeness(one, one) == 1 and fp.likeness(one, one[:0]) == 0 and fp.likeness(one[:0], one[:0]) == 1


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_next_document(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fp.with_edits(docs, parts=parts).collect()}
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[key].n_chars, got[key].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    same = {}
    assert all(same.setdefault(text, got[key].fingerprint) == got[key].fingerprint for key, text in rows)


def brute_fingerprint(text):
    """Phrases of a dictionary that starts empty, each one known phrase and a letter; a rest that is known ends the text."""
    phrases, now = set(), ""
    for letter in text:
        now += letter
        if now not in phrases:
            phrases.add(now)
            now = ""
    return phrases | ({now} if now else set())


def test_likeness_row_by_row(spark, sf_dir):
    """Fingerprints and likenesses of whole and edited texts, each made anew from the text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 1")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fp.with_edits(docs, parts=5).collect()}

    def least(text):
        return fp.minima(text, fp.Parser().feed(text, 0)[0], fp.SIZE)

    for (key, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, changed, other = least(text), least(edited), least(following)
        r = got[key]
        assert (r.fingerprint, r.edited_fingerprint) == (fp.written(own), fp.written(changed))
        assert (r.near_edited, r.near_next) == (fp.likeness(own, changed), fp.likeness(own, other))


def test_small_fingerprints_estimate_the_phrase_sets():
    for a, b in (("abcabcabd", "abcabcabe"), ("aaaa bbbb", "aaaa bbbc"), ("x", "y"), ("the cat sat", "the cat sat")):
        one, two = brute_fingerprint(a), brute_fingerprint(b)
        made = [fp.minima(t, fp.Parser().feed(t, 0)[0], fp.SIZE) for t in (a, b)]
        assert fp.likeness(*made) == len(one & two) / len(one | two)


@pytest.mark.parametrize("nulls", [False, True])
def test_many_rows_of_one_id_are_in_several_ranges(spark, nulls):
    rows = [(None if nulls else 7, f"text {k % 150} of many") for k in range(600)] + [(k, f"other {k}") for k in range(100, 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    firsts = fp._firsts(df.selectExpr("coalesce(doc_id, -9223372036854775808) AS key", "doc_id IS NULL AS none", "xxhash64(text) AS tie"), 8)
    assert sum(f[0] == (~-(1 << 63) if nulls else ~7) for f in firsts) >= 4
    got = fp.with_edits(df, parts=8).collect()
    assert len(got) == len(rows)
    # Behind the last of a run of equal rows comes another text, behind the others the same one.
    held = [r for r in got if r.doc_id in (None, 7)]
    assert len(held) == 600 and sum(r.near_next == 1 for r in held) == 450


def test_fingerprint_cases(awkward, none, spark):
    got = fp.with_edits(awkward, parts=3).collect()
    assert len(got) == len(AWKWARD) and sum(r.doc_id is None for r in got) == 1
    assert [r.fingerprint for r in got if r.doc_id in (3, 4)] == ["", ""]
    assert fp.with_edits(none, parts=3).collect() == [] and fp.fingerprints(none).collect() == []
    one = fp.with_edits(spark.createDataFrame(AWKWARD[:1], SCHEMA), parts=4).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_language_held_out(spark, sf_dir):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op3_hierarchical_language"](spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in got if r.held_out]) > 0.95


def test_language_cases(awkward, none):
    model = language.fit(awkward)
    got = language.identified(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    kept = language.kept(awkward, model)
    assert kept.columns == awkward.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    empty = language.fit(none)
    assert language.identified(none, empty).collect() == []
    assert {r.lang_pred for r in language.identified(awkward, empty).collect()} == {"und"}


def test_language_ignores_everything_but_text(awkward):
    model = language.fit(awkward)
    from pyspark.sql import functions as F
    changed = awkward.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1000)
    said = lambda df: sorted((r.lang_pred, r.score) for r in language.identified(df, model).collect())
    assert said(awkward) == said(changed)


def test_quality_follows_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_weak_label_quality"](spark, sf_dir).collect()}
    good = [got[k].kept for k, q in labels.items() if q == 1]
    bad = [got[k].kept for k, q in labels.items() if q == 0]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.2


def test_copies_leave_the_samples_full(spark):
    """A text with many copies must not keep the others of its class or language out of the sample."""
    rng = np.random.default_rng(3)
    common = {"en": "the of and to in is that house water people".split(), "de": "der die und das nicht haus wasser leute ist mit".split()}
    prose = {k: [" ".join(rng.choice(w, 60)) + f" {k}" + "ab"[i % 2] * (1 + i // 2 % 9) for i in range(60)] for k, w in common.items()}
    junk = [" ".join(rng.choice(["#$%", "&|<", "{}[", "~=_", "@@"], 40)) + f" {i}" for i in range(60)]
    rows = [(t, "en") for t in junk] + [(junk[0], "en")] * 6000 + [(t, "de") for t in prose["de"]] + [(t, "en") for t in prose["en"]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = weak_quality.fit(docs, sample=40)
    scores = {r.doc_id: r.score for r in weak_quality.scored(docs.where("doc_id < 60 OR doc_id >= 6060"), model).collect()}
    assert max(scores[i] for i in range(60)) < weak_quality.LEAST_SCORE < min(s for i, s in scores.items() if i >= 6060)
    texts = [(t, "de") for t in prose["de"]] + [(t, "en") for t in prose["en"]] + [(prose["en"][0], "en")] * 6000
    spoken = spark.createDataFrame([(3 * i, *r) for i, r in enumerate(texts)], "doc_id bigint, text string, lang string")
    found = language.identified(spoken.where("doc_id < 360"), language.fit(spoken, sample=20)).collect()
    assert all(r.lang_pred == ("de" if r.doc_id < 180 else "en") for r in found)


def test_label_model_finds_accuracies():
    """Votes drawn from known accuracies: the estimates and the posterior find them again."""
    rng = np.random.default_rng(3)
    n, own = 20_000, len(weak_quality.LABELLERS)
    good = rng.random(n) < 0.8
    kind = rng.integers(0, 2, n)
    says = np.where(rng.random((n, own)) < 0.3, 0, 1)
    noticed = np.where(kind == 0, 3, 9)
    says[np.arange(n)[~good], noticed[~good]] = np.where(rng.random((~good).sum()) < 0.9, -1, 1)
    says[good & (rng.random(n) < 0.01), 3] = -1
    patterns, counts = np.unique(says, axis=0, return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float))
    accuracy = {name: (a, b) for name, a, b in model.accuracies()}
    assert accuracy["symbols"][1] > 0.97 and 0.3 < accuracy["symbols"][0] < 0.7
    sure = model.posterior(says)[:, 0] > 0.5
    assert (sure == good).mean() > 0.96


def test_quality_cases(awkward, none):
    model = weak_quality.fit(awkward)
    got = weak_quality.scored(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.kept for r in got if r.doc_id in (3, 4))
    assert weak_quality.kept(awkward, model).columns == awkward.columns
    assert weak_quality.scored(none, weak_quality.fit(none)).collect() == []


def covered(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)})


@pytest.mark.parametrize("text", [
    None, "", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g", "one\ttwo\x0bthree\r\nfour\x1cfive six",
    "line\nline\n\n \nline", "# * & |", "w" * 50_000, "long " * 5_000, "Ä ö ß 漢字 word", "nbsp here"])
def test_rules_base(spark, text):
    import re
    r = rules.judged(spark.createDataFrame([(1, text, 2)], "doc_id int, text string, words int")).first()
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    repeated = covered(words) if len(words) < 500 else len(words)
    assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
    assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated)
    assert r.base_failed == (len(words) < 10 or 100 * repeated > 20 * len(words)) and not (r.kept and r.base_failed)


def test_rules_cases(awkward, none):
    assert rules.judged(awkward).count() == len(AWKWARD)
    assert rules.judged(none).collect() == []
    assert "Python" not in rules.judged(awkward)._jdf.queryExecution().toString()


def test_label_model_against_brute_force():
    """Expectation maximisation text by text and labeller by labeller."""
    rng = np.random.default_rng(12)
    n, labellers = 60, [name for name, _ in weak_quality.LABELLERS]
    patterns = np.unique(rng.choice([-1, 0, 1], size=(n, len(labellers)), p=[0.2, 0.5, 0.3]), axis=0)
    counts = rng.integers(1, 50, size=len(patterns)).astype(float)
    model = weak_quality.fit_labels(patterns, counts, rounds=7)
    kinds = 1 + len(weak_quality.KINDS)
    share = []
    for p in patterns:
        bad = [sum(p[j] < 0 for j, name in enumerate(labellers) if name in names) for names in weak_quality.KINDS]
        first = [float(not any(bad)), *map(float, bad)]
        share.append([x / sum(first) for x in first])
    for _ in range(7):
        size = [sum(c * s[k] for c, s in zip(counts, share)) for k in range(kinds)]
        prior = [(x + 1) / (sum(counts) + kinds) for x in size]
        said = [[[(sum(c * s[k] for p, c, s in zip(patterns, counts, share) if p[j] == v) + 0.1) / (size[k] + 0.3)
                  for v in (-1, 0, 1)] for j in range(len(labellers))] for k in range(kinds)]
        share = []
        for p in patterns:
            odds = [prior[k] * np.prod([said[k][j][v + 1] for j, v in enumerate(p)]) for k in range(kinds)]
            share.append([x / sum(odds) for x in odds])
    assert np.allclose(model.prior, prior) and np.allclose(model.said, said) and np.allclose(model.posterior(patterns), share)


def test_prediction_against_brute_force():
    """Family by the largest margin, then a vote of the pairs within it, ties by the sum of margins."""
    rng = np.random.default_rng(13)
    languages = {"a": ["a1", "a2", "a3"], "b": ["b1"], "c": ["c1", "c2"]}
    families = {f: rng.normal(size=9) for f in languages}
    pairs = {(x, y): rng.normal(size=9) for held in languages.values() for i, x in enumerate(held) for y in held[i + 1 :]}
    model = language.Model(families, pairs, languages, 8)
    seen = set()
    for _ in range(200):
        x = rng.normal(size=8)
        full = [*x, 1.0]
        margin = {f: sum(a * b for a, b in zip(w, full)) for f, w in families.items()}
        kind = max(margin, key=margin.get)
        wins = {name: [0, 0.0] for name in languages[kind]}
        for (one, two), w in pairs.items():
            if one in wins:
                m = sum(a * b for a, b in zip(w, full))
                wins[one if m >= 0 else two][0] += 1
                wins[one][1] += m
                wins[two][1] -= m
        best = max(wins, key=lambda name: tuple(wins[name]))
        said, score = language.predict(model, x)
        assert said == best and 0 <= score <= 1
        seen.add(said)
    assert len(seen) == 6
