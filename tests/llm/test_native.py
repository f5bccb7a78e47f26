"""Quality rules, licence scan, line dedup, pseudonyms and mixture against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from placestat.llm import licences, linededup, mixture, pseudonyms, quality

DOC = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s) for i, t, l, s in rows], DOC)


def test_base_counts_match_plain_python(spark, sf):
    def plain(s):
        w = re.findall(r"[^\x20\x09-\x0D]+", s or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (s or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in s or ""), len(lines) - len(set(lines)), len(covered)

    odd = [(-1, None, None, None), (-2, "", "en", "a"), (-3, " \n\t", "en", "a"), (-4, "a b a b a b a b", "en", "a"), (-5, "é é é\né é é", None, "b"), (-6, "x " * 30000, "en", "a")]
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").union(docs(spark, odd))
    for r in quality.base_counts(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.doc_id


def test_sketch_bins_are_ordered_and_tight(spark):
    rows = spark.range(0, 70000, 7).select(F.col("id").alias("x"), quality.sketch_bin(F.col("id")).alias("b")).withColumn("top", quality.bin_top(F.col("b"))).orderBy("x").collect()
    assert all(r.x <= r.top <= r.x * (1 + 1 / 32) + 1 for r in rows)
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:], strict=False))


def test_merging_sketches_is_sketching_the_union(spark, sf):
    d = quality.count_features(spark.read.parquet(f"{sf}/documents.parquet"))
    fine = quality.build_sketches(d, quality.GROUP)
    assert sorted(quality.merge_sketches(fine, []).collect()) == sorted(quality.build_sketches(d, []).collect())


def test_thresholds_follow_the_group(spark):
    text = lambda i, rate, size: " ".join(("#" if k % 100 < rate else "") + f"{'x' * size}{i}y{k}" for k in range(100))
    rows = [(i, text(i, 3 + i % 3, 3), "en", "prose") for i in range(600)] + [(1000 + i, text(i, 40 + i % 20, 3), "en", "code") for i in range(600)]
    rows += [(2000 + i, text(i, 0, 3), "en", "tiny") for i in range(5)] + [(5000, text(1, 98, 3), "en", "prose"), (5001, text(2, 98, 3), "en", "code"), (5002, text(9, 5, 12), "en", "code")]
    got = {r.doc_id: r for r in quality.adaptive_verdict(docs(spark, rows), scatter={"long_words": 1000}).collect()}
    assert not got[5000].kept and got[5000].reasons == ["symbols"] and got[5001].kept
    assert not got[5002].kept and got[5002].reasons == ["long_words"]
    assert all(r.kept for i, r in got.items() if i < 5000)
    counted = quality.count_features(docs(spark, rows))
    limits = {(r["__lang"], r["__source"]): r["__fences"] for r in quality.thresholds(counted, 3.0, quality.SCATTER, 200).collect()}
    assert limits["=en", "=code"][0] > limits["=en", "=prose"][0] + 30


def test_quality_edge_cases(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, clean + f" end{i}", "en", "s") for i in range(120)] + [(500, " ".join(f"w{i}$$$" for i in range(80)), "en", "s"), (501, None, None, None), (502, "", "en", "s")]
    got = {r.doc_id: r for r in quality.adaptive_verdict(docs(spark, rows).withColumn("kept", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(120))
    assert not got[500].kept and got[500].reasons == ["symbols"]
    assert not got[501].kept and not got[502].kept
    assert quality.adaptive_verdict(docs(spark, [])).count() == 0
    clash = quality.adaptive_verdict(docs(spark, rows[:3]).withColumns({"feature": F.lit("mine"), "f0": F.lit(1)}))
    assert {r.feature for r in clash.collect()} == {"mine"}


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Jo Doe\n\n" + mit.upper().replace("SUBLICENSE", "Sub-Licence".replace("-", "")), None, None),
        (2, "Some text.\nreleased under the  MIT licence!\nmore", None, None),
        (3, None, None, None),
        (4, "", None, None),
        (5, "Released under the MIT License. And more", None, None),
    ]
    got = {r.doc_id: r for r in licences.scan_licences(docs(spark, rows), licences.known_licences(spark)).collect()}
    assert got[1].licence == "MIT" and got[2].licence is None and got[2].notices == "MIT" and got[2].n_notices == 1
    assert got[3].licence is None and got[3].text_digest == got[4].text_digest
    assert got[5].n_notices == 0
    assert licences.scan_licences(docs(spark, []), licences.known_licences(spark)).count() == 0


def test_whole_licences(spark):
    texts = {name: text for name, text in licences.KNOWN if "\n" in text}
    assert len(texts) >= 8 and len({d for _, d in licences.DIGESTS}) == len(licences.DIGESTS) >= 10
    wrap = lambda s: re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n   ", s)
    rows = [(i, f"Copyright (c) 19{10 + i} A. Person\n\n{wrap(t)}\n", None, None) for i, t in enumerate(texts.values())]
    rows += [(50, "BSD 3-Clause License\n\nCopyright 2001, X\n\n" + dict(licences.KNOWN[:6])["BSD-3-Clause"].replace("copyright holder", "copyright owner"), None, None)]
    rows += [(60, "The land order of version 2.0 was fulfilled.", None, None), (61, "x " * 100000, None, None)]
    got = {r.doc_id: r.licence for r in licences.scan_licences(docs(spark, rows), licences.known_licences(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts) and got[50] == "BSD-3-Clause"
    assert got[60] is None and got[61] is None
    assert spark.range(1).select(licences.canonical_lines(F.lit("Land order, and/or licence"))[0]).first()[0] == "land order or license"


def plain_chunks(text):
    lines = [x for x in re.findall(linededup.LINE.replace(r"\z", r"\Z"), text) if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    rot = lambda x: ((x << 1) | (x >> 63)) & (2**64 - 1)
    r = [h[i] ^ (rot(h[i - 1]) if i else 0) for i in range(len(h))]
    r = [x - 2**64 if x >= 2**63 else x for x in r]
    bounds = [0] + [i + 1 for i in range(1, len(r) - 1) if r[i] < r[i - 1] and r[i] < r[i + 1]] + [len(lines)]
    return [lines[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def plain_line_dedup(rows, min_words=8):
    cs = {i: plain_chunks(t) for i, t in rows}
    places = defaultdict(list)
    for i in sorted(cs):
        for k, c in enumerate(cs[i]):
            if len(c) >= 2:
                places["".join(c)].append((i, k))
    near = lambda c, k: (sum(c[max(k - 2, 0) : k], [])[::-1], sum(c[k + 1 : k + 3], []))
    gone = defaultdict(set)
    first = {p: v[0] for v in places.values() for p in v[1:]}
    for text, v in places.items():
        for i, k in v[1:]:
            grown = []
            for mine, theirs in zip(near(cs[i], k), near(cs[v[0][0]], v[0][1]), strict=True):
                n = 0
                while n < min(len(mine), len(theirs)) and mine[n] == theirs[n]:
                    n += 1
                grown.append(mine[:n])
            beside = any(first.get((i, k + by)) == (v[0][0], v[0][1] + by) for by in (-1, 1))
            if beside or len(re.findall(r"[^\x20\x09-\x0D]+", "".join(grown[0][::-1]) + text + "".join(grown[1]))) >= min_words:
                at = sum(map(len, cs[i][:k]))
                gone[i] |= set(range(at - len(grown[0]), at + len(cs[i][k]) + len(grown[1])))
    return {i: "".join(x for n, x in enumerate(sum(c, [])) if n not in gone[i]) for i, c in cs.items()}


def test_line_dedup_matches_plain_python(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_line_dedup([(r.doc_id, r.text) for r in d.collect()])
    got = {r.doc_id: r.text for r in linededup.drop_repeated_chunks(d).collect()}
    assert got == want
    assert sum(map(len, got.values())) < sum(len(r.text) for r in d.collect())


def test_line_dedup_finds_pasted_passages(spark):
    passage = " ".join(f"Passage word{i} alpha{i}, beta{i} gamma{i} delta{i}." for i in range(12))
    rows = [(i, " ".join(f"host{i}x{k} says{k} thing{i}." for k in range(20)) + (" " if i % 2 else "\n") + passage + " " + f"tail{i} of{i} the host{i}. End{i}.", "en", "s") for i in range(6)]
    rows += [(10, None, None, None), (11, "", None, None), (12, "one line", None, None), (12, "one line", None, None)]
    out = linededup.drop_repeated_chunks(docs(spark, rows).withColumn("n_chunks_removed", F.lit("x"))).collect()
    assert len(out) == len(rows)
    full = [r.doc_id for r in out if r.text and passage in r.text]
    assert full == [0]
    assert all("host" in r.text for r in out if r.doc_id < 6)
    assert [r.text for r in out if r.doc_id >= 10] and sorted(str(r.text) for r in out if r.doc_id >= 10) == ["", "None", "one line", "one line"]
    assert linededup.drop_repeated_chunks(docs(spark, [])).count() == 0


def test_line_dedup_removes_whole_passages(spark):
    passage = [f"One{i} alpha{i}, beta{i} gamma{i} delta{i}; " for i in range(7)]
    rows = [(i, " ".join(f"host{i}x{k} says{k} thing{i}." for k in range(9)) + " mid " + "".join(passage) + f"tail{i} of{i} it. End{i}.", "en", "s") for i in range(300)]
    out = {r.doc_id: r.text for r in linededup.drop_repeated_chunks(docs(spark, rows), rows_a_part=7).collect()}
    assert out[0] == rows[0][1]
    whole = "".join(passage).split(", ", 1)[1]
    left = [max(n for n in range(len(whole.split()) + 1) if " ".join(whole.split()[:n]) in t or " ".join(whole.split()[-n:] if n else []) in t) for i, t in out.items() if i]
    assert max(left) == 0


def test_line_dedup_with_repeated_ids(spark):
    a, b = (" ".join(f"{p}{i} alpha{i}, beta{i} gamma{i} delta{i}." for i in range(12)) for p in "pq")
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (5, b, "en", "s"), (7, a, "en", "s"), (8, b, None, None), (9, "x\u0001y, z. " + a, "en", "s"), (10, "a " * 60000 + ". " + a, "en", "s")]
    out = sorted((r.doc_id, r.text) for r in linededup.drop_repeated_chunks(docs(spark, rows)).collect())
    assert [t for i, t in out if i == 5] == [a, b, b]
    assert [t for i, t in out if i in (7, 8)] == ["", ""]
    assert out[-2][1] == "x\u0001y, z. " and out[-1][1] == "a " * 60000 + ". "


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PII = [
    ("card", "4952935900253052"), ("card", "4111 1111 1111 1111"), ("card", "5500-0000-0000-0004"), ("phone", "+1 (017) 555-7713"), ("ipv4", "169.122.221.182"),
    ("ipv4", "0.0.0.255"), ("date", "2021-02-28"), ("date", "29.02.2020"), ("date", "01/12/1999"), ("email", "the.72@mail3.example.com"), ("key", '"' + "0a1b2c3d4e" * 4 + '"'),
    ("key", "0A1B2C3D" * 4), ("key", "0a1b2c3d" * 8), ("phone", "+4915112345678"), ("phone", "+33 1 23 45 67 89"), ("phone", "+34 612 34 56 78"), ("phone", "+1 555.123.4567"), ("phone", "(555) 123-4567"),
    ("date", "2021/03/04"), ("date", "04-03-2021"), ("date", "2021.03.04"), ("date", "2021-03-04T10:00:07Z"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "FR14 2004 1010 0505 0001 3M02 606"),
]


def shape(s):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))


def test_pseudonyms_keep_formats_and_come_back(spark):
    rows = [(i, f"before {v} after, {v}!", None, None) for i, (_, v) in enumerate(PII)]
    out = pseudonyms.pseudonymise(docs(spark, rows), "k")
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.drop("found"), "k", inverse=True).collect()}
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs(spark, rows), "k2").collect()}
    for r in out.collect():
        kind, v = PII[r.doc_id]
        assert back[r.doc_id] == rows[r.doc_id][1]
        assert {f.kind for f in r.found} == {kind} and len(r.found) == 2
        assert v not in r.text and other[r.doc_id] != r.text
        new = re.fullmatch(r"before (.*) after, (.*)!", r.text)
        assert new[1] == new[2]
        if kind != "ipv4":
            assert shape(new[1]) == shape(v)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new[1]))
        if kind == "iban":
            assert int("".join(str(int(c, 36)) for c in (lambda x: x[4:] + x[:4])(new[1].replace(" ", "")))) % 97 == 1
        if kind == "ipv4":
            assert all(str(int(x)) == x and int(x) < 256 for x in new[1].split("."))


def test_pseudonyms_leave_the_rest(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, "4952935900253053 and 999.1.1.1 and 2021-02-30 and v1.2.3 and 12-34 and 4.3.2021 and 12/31/2020 and DE88370400440532013000", None, None), (4, "x" * 200000, None, None)]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, rows), "k").collect()}
    assert all(got[i].text == t and got[i].found == [] for i, t, _, _ in rows)


def test_days_are_permuted(spark):
    a = spark.range(pseudonyms.DAYS).select(pseudonyms.feistel_pair(F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773, "k", "date").alias("p"))
    assert a.select("p").distinct().count() == pseudonyms.DAYS


def test_mixture_reaches_targets_and_repeats(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "small") for i in range(4000)] + [(9001, None, None, None), (9002, "n", None, None)]
    d = docs(spark, rows)
    out = mixture.poisson_mixture(d, weights={"big": 0.5, "small": 0.5}, total=6000).collect()
    n = Counter(r.source for r in out)
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 3000) < 250 and n[None] == 0
    again = mixture.poisson_mixture(d.repartition(7), weights={"big": 0.5, "small": 0.5}, total=6000).collect()
    assert [(r.doc_id, r.copy) for r in again] == [(r.doc_id, r.copy) for r in out]
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    assert mixture.poisson_mixture(docs(spark, [])).count() == 0


@pytest.mark.parametrize("mean", [0.3, 4.0, 1200.0])
def test_poisson_moments(spark, mean):
    n = 400
    d = docs(spark, [(i, "t", "en", "s") for i in range(n)])
    counts = Counter(r.doc_id for r in mixture.poisson_mixture(d, total=mean * n).collect())
    got = [counts.get(i, 0) for i in range(n)]
    m = sum(got) / n
    assert abs(m - mean) < 5 * (mean / n) ** 0.5
    assert 0.7 * mean < sum((x - m) ** 2 for x in got) / n < 1.35 * mean


def test_mixture_takes_columns_of_any_name(spark):
    rows = [(i, "ab"[i % 2], f"t{i}", i, i, i) for i in range(40)]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    odd = spark.createDataFrame(rows, "doc_id long, source string, text string, __CDF int, __source int, __parts int")
    pick = lambda df: [(r.doc_id, r.copy) for r in mixture.poisson_mixture(df).select("doc_id", "copy").collect()]
    assert pick(odd) == pick(plain) and {"__CDF", "__source", "__parts"} <= set(mixture.poisson_mixture(odd).columns)


def test_known_licences_have_one_row_a_digest(spark):
    k = licences.known_licences(spark)
    assert k.count() == k.select("digest").distinct().count()
