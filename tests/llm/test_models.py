"""Language ID, language-model scores and toxicity on held-out rows and small fixtures."""

import math
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placestat.llm import langid, mixing_lm, toxicity
from placestat.llm.common import LETTERS

def held_out(m):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m



def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(1)
    em, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, _, _ = langid.forward_backward(em, np.array([0, 4]), np.array([4, 3]), trans, start)
    for s, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = start[path[0]] + sum(em[s + t, path[t]] for t in range(n)) + sum(trans[path[t - 1], path[t]] for t in range(1, n))
            for t in range(n):
                total[t, path[t]] += math.exp(w)
        assert np.allclose(post[s : s + n], total / total.sum(axis=1, keepdims=True))


def test_language_id_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.label_languages(d, held_out(3) != 1, per_language=60).withColumn("held", held_out(3) == 1).collect()
    held = [r for r in out if r.held]
    assert len(out) == d.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_crf_labels_code_switched_words(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = langid.training_sample(d, F.lit(True), "doc_id", "text", "lang", 60)
    model = langid.fit_crf(sample)
    words = {lang: [w for t, x in sample if x == lang for w in langid.WORDS.findall(t.lower()) if w != "\n"][:400] for lang in model.langs}
    a, b = model.langs[0], model.langs[1]
    mixed = words[a][:12] + words[b][:12]
    s = langid.WordScores(model)
    post, _, _ = langid.forward_backward(s.rows[s.of(mixed)], np.array([0]), np.array([24]), model.transitions, model.start)
    got = [model.langs[i] for i in post.argmax(axis=1)]
    assert sum(g == w for g, w in zip(got, [a] * 12 + [b] * 12, strict=True)) >= 21


def test_language_id_edge_cases(spark):
    rows = [(i, "the house is red and the tree is green", "en") for i in range(6)] + [(10 + i, "das haus ist rot und der baum ist blau", "de") for i in range(6)]
    rows += [(100, None, None), (101, "", "en"), (102, "12 34 !!", "en"), (103, "das rote haus", None), (103, "das rote haus", None), (None, "the tree", "en"), (104, "haus " * 30000, "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.label_languages(d, F.lit(True)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[None][0] == "en" and got[104][0] == "de"
    assert {r.lang_pred for r in langid.label_languages(d.where("lang IS NULL"), F.lit(True)).collect()} == {"und"}
    assert langid.label_languages(d.limit(0), F.lit(True)).count() == 0


def test_huffman_paths_are_prefix_free():
    sizes, nodes, bits = mixing_lm.huffman([5, 9, 12, 13, 16, 45])
    at = np.concatenate([[0], np.cumsum(sizes)])
    paths = ["".join(map(str, bits[at[i] : at[i + 1]])) for i in range(6)]
    assert sorted(map(len, paths)) == [1, 3, 3, 3, 4, 4]
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)
    assert mixing_lm.huffman([3])[0].tolist() == [0]


@pytest.fixture(scope="module")
def tiny():
    texts = [b"a b a b c", b"a a b", b"c rare word", b""] * 20
    token_lists = [t.split() for t in texts]
    c = Counter(w for t in token_lists for w in [*t, b""])
    top = c.most_common(4)
    code = mixing_lm.Code.build(sorted(top, key=lambda x: (-x[1], x[0])), sum(c.values()) - sum(n for _, n in top))
    bits = 16
    counts = np.zeros(2 << bits, dtype=np.int32)
    for g in mixing_lm.batches(iter(token_lists)):
        for spelled, s, x, _ in mixing_lm.pieces(code, mixing_lm.symbols(code, mixing_lm.Tokens.of(code, g))):
            _, ids, b = mixing_lm.slots(code, s, x, bits, spelled)
            for i in ids:
                np.add.at(counts, i.astype(np.int64) * 2 + b, 1)
    table = np.ascontiguousarray(counts.reshape(-1, 2).T)
    parts = ((spelled, mixing_lm.slots(code, s, x, bits, spelled)) for g in mixing_lm.batches(iter(token_lists)) for spelled, s, x, _ in mixing_lm.pieces(code, mixing_lm.symbols(code, mixing_lm.Tokens.of(code, g))))
    stream = ((ids, b, spelled) for spelled, (_, ids, b) in parts)
    mixer = mixing_lm.fit_mixer(stream, table)
    return code, mixing_lm.pack(table), bits, mixing_lm.Folded.of(mixer)


def test_probabilities_of_all_next_tokens_add_up_to_one_at_most(tiny):
    code, table, bits, mixer = tiny
    score = lambda ts: mixing_lm.text_log10(code, table, bits, mixer, mixing_lm.symbols(code, mixing_lm.Tokens.of(code, ts)), len(ts))
    # texts of at most two tokens of the vocabulary: a sum over a part of all texts stays below 1
    vocabulary = [w for w in code.rank if w]
    texts = [[]] + [[a] for a in vocabulary] + [[a, b] for a in vocabulary for b in vocabulary]
    p = 10 ** score(texts)
    assert 0.3 < p[0] + p[1 : 1 + len(vocabulary)].sum() + p[1 + len(vocabulary) :].sum() < 1.0
    assert np.allclose((10.0 ** mixer.logs.reshape(-1, 2).astype(float)).sum(axis=1), 1, atol=1e-5)


def test_scores_do_not_depend_on_the_batch(tiny):
    code, table, bits, mixer = tiny
    texts = [b"a b c".split(), b"unseen words here".split(), [], b"a".split() * 50000]
    together = mixing_lm.text_log10(code, table, bits, mixer, mixing_lm.symbols(code, mixing_lm.Tokens.of(code, texts)), 4)
    alone = [mixing_lm.text_log10(code, table, bits, mixer, mixing_lm.symbols(code, mixing_lm.Tokens.of(code, [t])), 1)[0] for t in texts]
    assert np.allclose(together, alone)


@pytest.mark.parametrize("vocabulary", [1 << 18, 300])
def test_lm_scores_and_base(spark, vocabulary):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "the")], "doc_id long, text string")
    d = d.union(odd)
    out = mixing_lm.score_texts(d, held_out(7) != 2, vocabulary=vocabulary, max_table_bits=18).collect()
    rows = d.collect()
    train = [mixing_lm.words(r.text) for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t, b""])
    n, v = sum(c.values()), len(c)
    want = {r.doc_id: [*mixing_lm.words(r.text), b""] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        t = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
    assert mixing_lm.score_texts(d.limit(0), F.lit(True)).count() == 0


def test_held_out_scores_beat_the_base(spark):
    """Texts of nearly only known words, as unknown ones are spelled in the score and not in the base."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = mixing_lm.score_texts(d, held_out(7) != 2).where(held_out(7) == 2).where("n_known > 0.9 * n_tokens").collect()
    assert len(out) > 30 and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert sum(r.score > r.base_score for r in out) >= 0.6 * len(out)


def test_blocks_of_counts_come_back():
    c = np.array([0, 1, 254, 255, 70_000, 2**31 - 1, 0], dtype=np.int32)
    assert np.array_equal(mixing_lm.unsqueeze(mixing_lm.squeeze(c)), c)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    some = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0)
    out = toxicity.chain_probabilities(some, train, ["low_quality", "toxic"]).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0).collect()
    caught = [r for r in out if r.toxic and r.p_toxic >= 0.5]
    false = [r for r in out if not r.toxic and r.p_toxic >= 0.5]
    assert len(caught) >= 0.75 * sum(r.toxic for r in out) and len(false) <= 0.02 * len(out)


def test_toxicity_edge_cases(spark):
    rows = [(i, f"you idiot {i % 5} word" if i % 2 else f"kind text {i % 5} word") for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "you idiot")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_bad", F.lit("clash")).withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 1, None if i % 3 else i % 2) for i in range(60)], "doc_id long, bad int, all_one int, sparse int")
    out = toxicity.chain_probabilities(d, labels, ["bad", "all_one", "sparse"]).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert got[1].p_bad > 0.5 > got[2].p_bad and got[None].p_bad > 0.5 and got[1].p_all_one == 1.0
    assert 0 <= got[100].p_bad <= 1 and got[100].p_bad == got[101].p_bad
    assert toxicity.chain_probabilities(d.limit(0), labels, ["bad"]).count() == 0
    assert {r.p_bad for r in toxicity.chain_probabilities(d, labels.limit(0), ["bad"]).collect()} == {0.0}


def test_language_of_a_long_run_without_blanks():
    chars = {"zh": [chr(0x4E00 + i) for i in range(40)], "ja": [chr(0x3042 + i) for i in range(40)]}
    rng = np.random.default_rng(3)
    run = lambda lang, n: "".join(rng.choice(chars[lang], n))
    model = langid.fit_crf([(" ".join(run(lang, 6) for _ in range(40)), lang) for lang in chars for _ in range(10)])
    shared = "x" * 30
    got = langid.text_languages(model, [shared + run(lang, 60) + shared for lang in ("zh", "ja")], langid.WordScores(model))
    assert [g[0] for g in got] == ["zh", "ja"] and all(g[1] > 0.99 for g in got)


def test_signs_that_are_no_letters_have_no_language(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en") for i in range(30)] + [(100 + i, "der schnelle braune fuchs und der faule hund " * 3, "de") for i in range(30)]
    odd = [(200, "½ ² Ⅷ 12_3 — !", "en"), (201, None, "en"), (202, "", None), (203, "½und²der Ⅷ fuchs", None), (204, "und der hund " * 40000, None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.label_languages(d, F.col("doc_id") < 200).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert got[203].lang_pred == got[204].lang_pred == "de"


def test_the_chain_takes_text_ids(spark):
    rows = [(f"d{i}", "nasty awful words here" if i % 2 else "a kind remark there") for i in range(60)]
    labels = spark.createDataFrame([(k, i % 2, i % 2) for i, (k, _) in enumerate(rows)], "doc_id string, low int, toxic int")
    got = {r.doc_id: r.p_toxic for r in toxicity.chain_probabilities(spark.createDataFrame(rows, "doc_id string, text string"), labels, ["low", "toxic"]).collect()}
    assert all((p >= 0.5) == (int(k[1:]) % 2 == 1) for k, p in got.items())


def test_large_counts_keep_their_odds():
    got = mixing_lm.fitted(np.array([2**33, 2**31, 5, 7, 0, 2**31 - 1], dtype=np.int64))
    assert got.tolist() == [2**30, 2**28, 5, 7, 0, 2**31 - 1]


def test_the_table_grows_with_the_corpus():
    assert [mixing_lm.bits_for(n, 25) for n in (0, 1000, 1 << 20, 1 << 24, 1 << 40)] == [16, 16, 16, 20, 25]


def test_the_score_is_the_sum_of_mixed_bits():
    texts = [mixing_lm.words(t) for t in ("a b a c", "b a b", "a c zz a b a")]
    counts = Counter(w for t in texts for w in t)
    counts[mixing_lm.END] = 3
    code = mixing_lm.Code.build([(w, n) for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1], 2)
    rng = np.random.default_rng(3)
    table = mixing_lm.pack(rng.integers(0, 40, (2, 1 << 16)))
    mixer = mixing_lm.Mixer(rng.normal(0.3, 0.1, (4, mixing_lm.GATES)), np.tile(1 / (1 + np.exp(-(np.arange(mixing_lm.STEPS) / 2 - 8))), (mixing_lm.GATES, 1)))
    columns = mixing_lm.symbols(code, mixing_lm.Tokens.of(code, texts))
    got = mixing_lm.text_log10(code, table, 16, mixing_lm.Folded.of(mixer), columns, 3)
    want = np.zeros(3)
    for spelled, sym, contexts, owner in mixing_lm.pieces(code, columns):
        ends, ids, bits = mixing_lm.slots(code, sym, contexts, 16, spelled)
        for k, bit in enumerate(bits):
            seen = [int(table[x[k]]) for x in ids]
            gate = 16 * spelled + 4 * (seen[1] & 3) + (seen[2] & 3)
            x = sum(w[gate] * (v >> 2) / 64 for w, v in zip(mixer.weights, seen, strict=False)) + mixer.weights[3][gate]
            p = 1 / (1 + math.exp(-max(-7.99, min(7.99, x))))
            want[owner[np.searchsorted(ends, k, side="right")]] += math.log10(p if bit else 1 - p)
    assert np.allclose(got, want, rtol=0.02)


def test_letters_are_those_of_category_l_and_cost_little():
    every = list(map(chr, range(sys.maxunicode + 1)))
    random.Random(3).shuffle(every)
    assert re.findall(LETTERS, "".join(every)) == "".join(c if c.isalpha() else " " for c in every).split()
    text = "der schnelle Fuchs, été 2024 naïve; " * 5000

    def seconds(pattern):
        found, best = re.compile(pattern), math.inf
        for _ in range(3):
            start = time.perf_counter()
            found.findall(text)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(LETTERS) < 6 * seconds(r"[^\W\d_]+")


def test_left_out_entries_are_those_of_counts_less_one():
    rng = np.random.default_rng(2)
    counts = np.concatenate([rng.integers(0, 5, (2, 500)), rng.integers(0, 2000, (2, 500))], axis=1).astype(np.int32)
    got = mixing_lm.left_out(counts).reshape(-1, 2)
    for bit in (0, 1):
        less = counts.copy()
        less[bit] = np.maximum(less[bit] - 1, 0)
        assert np.array_equal(got[:, bit], mixing_lm.pack(less))


def test_mixing_weights_are_learned_from_all_training_texts(spark, monkeypatch):
    """Every training text has its bits in the averaged parts, and no text that isn't one."""
    taken = []
    learn = mixing_lm.learn_mixer

    def watched(texts, *more):
        taken.extend(r.t for r in texts.collect())
        return learn(texts, *more)

    monkeypatch.setattr(mixing_lm, "learn_mixer", watched)
    d = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b a c"), F.col("id") % 7, "id").alias("text"))
    assert mixing_lm.score_texts(d, F.col("doc_id") % 5 != 0, max_table_bits=16).count() == 1500
    assert sorted(taken) == sorted(f"a b a c {i % 7} {i}" for i in range(1500) if i % 5)


def test_features_of_a_text_cost_little():
    """A few passes over the characters; hundreds of ranges asked for each took over a second."""
    text = "der schnelle Fuchs, été 2024 naïve; " * 20_000
    best = math.inf
    for _ in range(3):
        start = time.process_time()
        found = toxicity.text_features(text)
        best = min(best, time.process_time() - start)
    assert found == {"der", "schnelle", "schn-", "schne-", "fuchs", "fuch-", "été", "naïve", "naïv-"} and best < 0.5
