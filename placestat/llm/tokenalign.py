"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizations of the same bytes share some token ends. An interval of tokens that ends at a shared end is
split at a common end near its middle, found by bisecting the other side's ends for the middle end and, if it
is not among them, for its neighbours outwards; both halves are split in the same way; an interval without a
common end inside is a group. The intervals of all documents of a slice are split side by side, level by level.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import sized_broadcast, stored

TOKENIZERS = "/opt/tokenizers"
#: Characters of text that are tokenized at a time.
SLICE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs that are merged by the slower library, whose time doesn't grow with the square of a run.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


class Vocabulary:
    """A tokenizer made from a vocabulary file's content; ``token_bytes[id]`` are the bytes that a token stands for."""

    def __init__(self, suffix: str, content: bytes):
        self._fast = None
        if suffix == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            self._t = Tokenizer.from_str(content.decode())
            self._t.encode_special_tokens = True
            letters, vocab, given = byte_letters(), self._t.get_vocab(with_added_tokens=True), json.loads(content)
            special = {x["content"] for x in given.get("added_tokens", [])}
            self.token_bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.token_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
            if self._ranked(given):
                import tiktoken

                ranks = {self.token_bytes[i]: i for token, i in vocab.items() if token not in special}
                self._fast = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            self.encode = self._byte_level
        elif suffix == ".model":
            import sentencepiece

            self._t = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.token_bytes = [bytes([int(p[3:5], 16)]) if self._t.is_byte(i) else p.replace("▁", " ").encode() for i in range(self._t.get_piece_size()) for p in [self._t.id_to_piece(i)]]
            self.encode = lambda texts: self._t.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no tokenizer for {suffix} files")
        self.lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)

    @staticmethod
    def _ranked(given: dict) -> bool:
        """Whether merges are in the order of the ids that they make and texts are cut by BYTE_LEVEL alone: then ranks say it all."""
        model, cut = given["model"], given.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and given.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]] if plain else []
        return plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))

    def _byte_level(self, texts: list[str]) -> list[list[int]]:
        if self._fast is None:
            return [e.ids for e in self._t.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [self._t.encode(" " + t, add_special_tokens=False).ids if LONG_RUN.search(t) else self._fast.encode_ordinary(" " + t) for t in texts]

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.token_bytes.__getitem__, ids)) == text


_MADE: dict[bytes, Vocabulary] = {}


def vocabulary(suffix: str, content: bytes) -> Vocabulary:
    """Made once in each Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _MADE:
        _MADE[key] = Vocabulary(suffix, content)
    return _MADE[key]


def shared_cuts(ea: np.ndarray, eb: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to each shared cut, in order.

    ``ea`` and ``eb`` are the token ends in bytes over all documents of a slice; ``a_stop`` and ``b_stop`` the numbers of tokens
    up to the end of each document that has tokens, which are shared cuts. Ends around a middle are bisected one by one
    up to ``reach`` away; where none is common, all ends of the interval are, and the common one nearest to the middle is taken.
    """
    a1, b1 = a_stop.astype(np.int64), b_stop.astype(np.int64)
    a0, b0 = np.concatenate([[0], a1[:-1]]).astype(np.int64), np.concatenate([[0], b1[:-1]]).astype(np.int64)
    cuts = [(a1, b1)]
    while True:
        live = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[live], a1[live], b0[live], b1[live]
        if not len(a0):
            break
        middle, last = (a0 + a1 - 2) // 2, a1 - 2
        cut_a = np.full(len(a0), -1, dtype=np.int64)
        cut_b = cut_a.copy()
        todo = np.arange(len(a0))
        for step in (0, *(s * k for k in range(1, reach + 1) for s in (1, -1))):
            at = middle[todo] + step
            inside = (at >= a0[todo]) & (at <= last[todo])
            at = np.where(inside, at, a0[todo])
            found = np.searchsorted(eb, ea[at])
            hit = inside & (eb[found] == ea[at])
            cut_a[todo[hit]], cut_b[todo[hit]] = at[hit] + 1, found[hit] + 1
            todo = todo[~hit]
            if not len(todo):
                break
        for i in todo[last[todo] - a0[todo] > 2 * reach - 1]:
            inner = np.arange(a0[i], last[i] + 1)
            found = np.searchsorted(eb, ea[inner])
            common = np.flatnonzero(eb[found] == ea[inner])
            if len(common):
                k = common[np.argmin(np.abs(inner[common] - middle[i]))]
                cut_a[i], cut_b[i] = inner[k] + 1, found[k] + 1
        s = cut_a >= 0
        cut_a, cut_b = cut_a[s], cut_b[s]
        cuts.append((cut_a, cut_b))
        a0, a1 = np.concatenate([a0[s], cut_a]), np.concatenate([cut_a, a1[s]])
        b0, b1 = np.concatenate([b0[s], cut_b]), np.concatenate([cut_b, b1[s]])
    return np.sort(np.concatenate([a for a, _ in cuts])), np.sort(np.concatenate([b for _, b in cuts]))


@functools.cache
def marks(ids: int) -> np.ndarray:
    """Texts of ids at 4 id + side: followed by a comma, by the end of A's part of a group (1) or by the end of the group (3)."""
    return np.array([f"{i}{end}" for i in range(ids) for end in (",", "|", ",", ";")], dtype=object)


class Slice:
    """The aligned tokens of some texts."""

    def __init__(self, texts: list[str | None], va: Vocabulary, vb: Vocabulary):
        self.va, self.vb = va, vb
        spaced = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        some = [i for i, t in enumerate(texts) if t]
        ids_a: list[list[int]] = [[] for _ in texts]
        ids_b: list[list[int]] = [[] for _ in texts]
        plain = [texts[i] for i in some]
        for i, a, b in zip(some, va.encode(plain), vb.encode(plain), strict=True):
            if va.spells(a, spaced[i]) and vb.spells(b, spaced[i]):
                ids_a[i], ids_b[i] = a, b
        self.n_a, self.n_b = np.array(list(map(len, ids_a)), dtype=np.int64), np.array(list(map(len, ids_b)), dtype=np.int64)
        flat = lambda ids, n: np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=int(n.sum()))
        self.a, self.b = flat(ids_a, self.n_a), flat(ids_b, self.n_b)
        full = self.n_a > 0
        self.ends_a = np.cumsum(va.lengths[self.a])
        if full.any():
            self.cut_a, self.cut_b = shared_cuts(self.ends_a, np.cumsum(vb.lengths[self.b]), np.cumsum(self.n_a)[full], np.cumsum(self.n_b)[full])
        else:
            self.cut_a = self.cut_b = np.zeros(0, dtype=np.int64)
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.cut_a)  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group; empty without tokens."""
        na, nb, g = len(self.a), len(self.b), len(self.cut_a)
        last_a, last_b = np.zeros(na, dtype=bool), np.zeros(nb, dtype=bool)
        last_a[self.cut_a - 1], last_b[self.cut_b - 1] = True, True
        start_b = np.concatenate([[0], self.cut_b[:-1]]).astype(np.int64) if g else self.cut_b
        group_a = np.repeat(np.arange(g), np.diff(self.cut_a, prepend=0))
        group_b = np.repeat(np.arange(g), np.diff(self.cut_b, prepend=0))
        out = np.empty(na + nb, dtype=np.int64)
        out[np.arange(na) + start_b[group_a]] = 4 * self.a + last_a
        out[np.arange(nb) + self.cut_a[group_b]] = 4 * self.b + 2 + last_b
        pieces = marks(max(len(self.va.token_bytes), len(self.vb.token_bytes)))[out].tolist()
        stops, low, found = np.cumsum(self.n_a + self.n_b).tolist(), 0, []
        for high in stops:
            found.append(hashlib.sha256("".join(pieces[low:high])[:-1].encode()).hexdigest() if high > low else "")
            low = high
        return found

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id << 32 | B id, number): how often each pair of ids ends together in each document."""
        size = len(self.va.token_bytes), len(self.vb.token_bytes)
        both, n = np.unique((self.doc * size[0] + self.a[self.cut_a - 1]) * size[1] + self.b[self.cut_b - 1], return_counts=True)
        doc, pair = np.divmod(both, size[0] * size[1])
        return doc, (pair // size[1] << 32) | pair % size[1], n


def _list(per_doc: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)), pa.array(values, type=kind))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The rows of (id, text) batches in slices of about SLICE characters."""
    for b in batches:
        low, chars, texts = 0, 0, []
        for i, t in enumerate(b.column(1)):
            texts.append(t := t.as_py())
            chars += len(t or "")
            if chars >= SLICE:
                yield b.column(0).slice(low, i + 1 - low), texts
                low, chars, texts = i + 1, 0, []
        if texts:
            yield b.column(0).slice(low), texts


def align_tokens(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Every row's two tokenizations cut into groups: (doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times), and with ``spans`` a, b, cuts.

    A tokenizes a space and the text by a byte-level vocabulary (.json), B the text by a piece model (.model). ``a`` and ``b`` are the
    token ids, ``cuts`` for each group the bytes, A tokens and B tokens up to its end. ``pairs`` are the distinct links as
    A id << 32 | B id with how often (``times``) they end together. Null and empty texts, and those that either side doesn't spell byte for byte,
    have no tokens. Rows may repeat; a null id stays null; other columns are ignored. Texts are tokenized whole.
    """
    files = [(os.path.splitext(p)[1], open(p, "rb").read()) for p in (a_file, b_file)]
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = (vocabulary(*f) for f in shared.value)
        for ids, texts in slices(batches):
            s = Slice(texts, va, vb)
            doc, pair, times = s.links()
            per_doc = np.bincount(doc, minlength=len(texts))
            cols = [ids, pa.array(s.n_a), pa.array(s.n_b), pa.array(s.n_groups), pa.array(s.digests(), pa.string()), _list(per_doc, pair, pa.int64()), _list(per_doc, times, pa.int32())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
            if spans:
                before = np.cumsum(s.n_a) - s.n_a, np.cumsum(s.n_b) - s.n_b
                origin = np.concatenate([[0], s.ends_a])[before[0]]
                cut = [s.ends_a[s.cut_a - 1] - origin[s.doc], s.cut_a - before[0][s.doc], s.cut_b - before[1][s.doc]]
                cuts = pa.StructArray.from_arrays([pa.array(x, type=pa.int32()) for x in cut], names=["bytes", "a", "b"])
                cols += [_list(s.n_a, s.a, pa.int32()), _list(s.n_b, s.b, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.n_groups)]).astype(np.int32)), cuts)]
                names += ["a", "b", "cuts"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", a array<int>, b array<int>, cuts array<struct<bytes:int,a:int,b:int>>" if spans else ""
    return docs.select(id_col, text_col).mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>{more}")


def alignment_statistics(docs: DataFrame, directory: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", max_broadcast_pairs: int = 2_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, see ``align_tokens``.

    An id pair's count is how often it ends together in all rows. ``n_best`` are the row's links whose count is the highest of their B id
    (ties included), ``count_sum`` the sum of the counts over its links. The distinct pairs are counted in the tasks first; their table
    is broadcast up to ``max_broadcast_pairs`` rows and joined by shuffle beyond.
    """
    aligned = align_tokens(docs, f"{directory}/{a}", f"{directory}/{b}", id_col, text_col, spans=False)
    f = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "token-alignments")
    links = f.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = stored(counts, "token-pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    ranked = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    per_row = links.join(sized_broadcast(ranked, max_broadcast_pairs), "pair").groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return f.join(per_row, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
