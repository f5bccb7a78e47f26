"""Token alignment against a scan over every byte."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from placestat.llm.tokenalign import TOKENIZERS, align_tokens, alignment_statistics, byte_letters, shared_cuts

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """text -> groups of (A ids, B ids), straight from the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: x for x, i in json.load(open(A))["model"]["vocab"].items()}
    letters = byte_letters()

    def groups(text):
        if not text:
            return []
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        wa = [bytes(letters[c] for c in names[i]) for i in a]
        wb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(wa) == b"".join(wb) == (" " + text).encode():
            return []
        ends_a, ends_b = set(np.cumsum(list(map(len, wa))).tolist()), set(np.cumsum(list(map(len, wb))).tolist())
        out, ga, gb, ia, ib, pa, pb = [], [], [], 0, 0, 0, 0
        for end in sorted(ends_a & ends_b):
            while pa < end:
                pa += len(wa[ia])
                ga.append(a[ia])
                ia += 1
            while pb < end:
                pb += len(wb[ib])
                gb.append(b[ib])
                ib += 1
            out.append((ga, gb))
            ga, gb = [], []
        return out

    return groups


def brute(rows, groups):
    cut = [groups(t) for _, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for gs in cut for g in gs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (d, _), gs in zip(rows, cut, strict=True):
        pairs = [(a[-1], b[-1]) for a, b in gs]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((str(d), sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return sorted(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in alignment_statistics(df).select(COLUMNS).collect())


def test_odd_texts(spark, plain):
    texts = [
        "plain words, and more words.", "Straße über naïve façade — “quoted” …", "日本語のテキスト と 한국어", "<|endoftext|> and </s> <s> <unk>", "a▁b", "tab\tand\nlines\r\n  two  spaces ",
        "😀😃 emoji 👩‍👩‍👧", "\u0000 nul", "x" * 3000, "é" * 500 + "́", None, "", " ", "ﬁ ligature ½ ²", "1234567890 3.14159", "plain words, and more words.", "z\u0085y x",
    ]
    rows = [(i % 12, t) for i, t in enumerate(texts)] + [(None, "no id")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, plain)


def test_given_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()], plain)


def test_spans_give_the_texts_back(spark):
    df = spark.createDataFrame([(1, "Zwölf Boxkämpfer jagen Viktor quer."), (2, None), (3, "naïveté")], "doc_id long, text string")
    for r in align_tokens(df, A, B).collect():
        assert len(r.a) == r.n_a and len(r.b) == r.n_b and len(r.cuts) == r.n_groups == sum(r.times)
        if r.n_a:
            assert (r.cuts[-1].a, r.cuts[-1].b) == (r.n_a, r.n_b)
            assert all(x.bytes < y.bytes and x.a < y.a and x.b < y.b for x, y in zip(r.cuts, r.cuts[1:], strict=False))
            assert r.cuts[-1].bytes == len((" " + {1: "Zwölf Boxkämpfer jagen Viktor quer.", 3: "naïveté"}[r.doc_id]).encode())


def test_cuts_of_random_ends():
    rng = random.Random(3)
    for _ in range(300):
        ea, eb, sa, sb, base = [], [], [], [], 0
        for _ in range(rng.randrange(1, 5)):
            n = rng.choice([1, 2, 5, 30, 400])
            share = rng.choice([0.02, 0.3, 0.9])
            ea += [base + i for i in range(1, n) if rng.random() < share] + [base + n]
            eb += [base + i for i in range(1, n) if rng.random() < share] + [base + n]
            sa.append(len(ea))
            sb.append(len(eb))
            base += n
        a, b = shared_cuts(np.array(ea), np.array(eb), np.array(sa), np.array(sb))
        common = sorted(set(ea) & set(eb))
        assert [ea[i - 1] for i in a] == common == [eb[i - 1] for i in b]


def test_empty_table_clashing_columns_and_long_text(spark):
    assert alignment_statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, 6), (2, "longer word " * 100_000, 7, 8)], "doc_id long, text string, row long, n_a long")
    got = {r.doc_id: r for r in alignment_statistics(df).collect()}
    assert got[1].n_a == 2 and got[2].n_a > 200_000 and got[2].n_links == got[2].n_groups
