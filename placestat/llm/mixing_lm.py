"""Language-model scores by logistic mixing of hashed-context bit predictors.

Text is coded as words and an end mark: a frequent word by its path in a Huffman tree, any other by an
escape and its bytes, each by its path in a second tree. Every step of a path is a binary decision. Three
predictors guess it, from the counts of zeros and ones seen at the node alone, after the word before it, and
after the two words before it (in a spelled word: after two, three and four of its bytes); their counts share a hashed table
that grows with the number of training tokens, filled from all training texts. Their log-odds are added with
weights from a set that is selected by how much the two longer contexts have seen (the gate); the weights are
learned online by gradient steps on the coding cost, and the mixed probability is refined by an adaptive
table of its own (indexed by gate and quantised log-odds). Tasks learn weights and table from all training
texts, each from its own; the parts are averaged. A text's bits add up to a proper log-probability.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placestat.operators.graph import checkpoint

END = b""
CONTEXTS, GATES, STEPS, FINE = 3, 32, 33, 513
BLOCKS = 64
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
NODE, FINAL = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII blanks; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path length of each symbol, then all paths' nodes and bits in symbol order, from the root; ties by order."""
    k = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit = np.full(max(2 * k - 1, 1), -1, dtype=np.int32), np.zeros(max(2 * k - 1, 1), dtype=np.int8)
    n = k
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], bit[y] = n, n, 1
        heapq.heappush(heap, (a + b, n))
        n += 1
    nodes, bits, at = [], [], np.arange(k, dtype=np.int32)
    while (up := np.where(at >= 0, parent[at], -1)).max(initial=-1) >= 0:
        nodes.append(up - k)
        bits.append(bit[at])
        at = up
    if not nodes:
        return np.zeros(k, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    node_table, bit_table = np.array(nodes[::-1]).T, np.array(bits[::-1]).T
    there = node_table >= 0
    return there.sum(axis=1).astype(np.int64), node_table[there].astype(np.int64), bit_table[there].astype(np.int64)


@dataclass
class Code:
    """Symbols: words by rank, then the escape, then the 256 bytes."""

    rank: dict[bytes, int]
    escape: int
    starts: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @staticmethod
    def build(vocabulary: list[tuple[bytes, int]], others: int) -> Code:
        """From the frequent words with their counts and the number of all other tokens."""
        ws = [w for w, _ in vocabulary]
        seen = Counter()
        for w, n in vocabulary:
            for b in w + b" ":
                seen[b] += 1
        sizes, nodes, bits = huffman([n for _, n in vocabulary] + [others + 1])
        byte_sizes, byte_nodes, byte_bits = huffman([seen[b] + 1 for b in range(256)])
        sizes = np.concatenate([sizes, byte_sizes])
        nodes = np.concatenate([nodes, byte_nodes + len(ws) + 1])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return Code({w: i for i, w in enumerate(ws)}, len(ws), starts, sizes, nodes.astype(np.uint32), np.concatenate([bits, byte_bits]).astype(np.int32))


@dataclass
class Tokens:
    """Words of texts, each text closed by the end; symbol of each, the escape for a word out of the vocabulary."""

    flat: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(code: Code, texts: list[list[bytes]]) -> Tokens:
        flat: list[bytes] = []
        for ws in texts:
            flat += ws
            flat.append(END)
        ids = np.fromiter(map(code.rank.get, flat, repeat(code.escape)), dtype=np.int64, count=len(flat))
        return Tokens(flat, ids, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)


def symbols(code: Code, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, its three contexts, and its text's number, a word out of the vocabulary spelled out."""
    esc, tok, owner_sizes = code.escape, tokens.ids, tokens.sizes
    owner = np.repeat(np.arange(len(owner_sizes)), owner_sizes)
    first = np.concatenate([[0], np.cumsum(owner_sizes)[:-1]]).astype(np.int64)
    end = np.int64(code.rank.get(END, esc))
    before = np.concatenate([[end], tok[:-1]])
    before[first] = end
    before2 = np.concatenate([[end, end], tok[:-2]])[: len(tok)]
    before2[first] = end
    before2[(first + 1)[owner_sizes > 1]] = end
    c1, c2 = before + 1, (before + 1) * np.int64(1 << 20) + before2 + 1
    is_esc = tok == esc
    rare = [tokens.flat[i] for i in np.flatnonzero(is_esc)]
    c0 = np.zeros(len(tok), dtype=np.int64)
    if not rare:
        return tok, c0, c1, c2, owner
    spelled = np.frombuffer(b" ".join(rare) + b" ", dtype=np.uint8).astype(np.int64)
    lens = np.ones(len(tok), dtype=np.int64)
    lens[is_esc] += np.array([len(w) + 1 for w in rare])
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    total = int(lens.sum())
    place = np.zeros(total, dtype=bool)
    place[at] = True
    sym = np.empty(total, np.int64)
    sym[place], sym[~place] = tok, spelled + esc + 1
    inside = byte_contexts(spelled)
    out = []
    for mine, theirs in zip((c0, c1, c2), inside, strict=True):
        c = np.empty(total, np.int64)
        c[place], c[~place] = mine, theirs
        out.append(c)
    return sym, *out, np.repeat(owner, lens)


def byte_contexts(spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each byte of blank-ended words: two, three and four bytes back, no farther than the word."""
    out, h = [], np.zeros(len(spelled), dtype=np.int64)
    inside = np.ones(len(spelled), dtype=bool)
    for back in range(1, 5):
        b = np.concatenate([np.full(back, 32), spelled[:-back]])[: len(spelled)]
        h = np.where(inside, h * 257 + b + 1, h)
        inside &= b != 32
        if back > 1:
            out.append(-1 - h)
    return tuple(out)


def slots(code: Code, sym: np.ndarray, contexts: tuple[np.ndarray, ...], table_bits: int, spelled: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Where each symbol's binary decisions end; of each decision its slots and the bit. All words or all bytes.

    The contexts have an eighth, a quarter and a half of the table, each half of it for words and half for
    bytes. A word's first context is empty, so its slot is the node itself.
    """
    sizes = code.sizes[sym]
    ends = np.cumsum(sizes)
    inside = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    inside += np.repeat((code.starts[sym] - ends + sizes).astype(np.int32), sizes)
    node = code.nodes.take(inside)
    out, first = [], 0
    mixed = node * NODE
    for j, (c, m) in enumerate(zip(contexts, MULT, strict=True)):
        width = table_bits - 4 + j
        if j == 0 and not spelled and len(code.nodes) and code.escape < 1 << width:
            k = node
        else:
            k = np.repeat(((c.view(np.uint64) * m) >> np.uint64(32)).astype(np.uint32), sizes)
            k ^= mixed
            k *= FINAL
            k >>= np.uint32(32 - width)
            k += np.uint32(first + (spelled << width))
        first += 2 << width
        out.append(k)
    return ends, out, code.bits.take(inside)


def batches(texts: Iterator[list[bytes]], at_most: int = 30_000) -> Iterator[list[list[bytes]]]:
    """Groups of tokenised texts of about so many tokens."""
    group, n = [], 0
    for ws in texts:
        group.append(ws)
        n += len(ws) + 1
        if n >= at_most:
            yield group
            group, n = [], 0
    if group:
        yield group


def pieces(code: Code, columns: tuple[np.ndarray, ...], at_most: int = 40_000) -> Iterator[tuple[bool, np.ndarray, tuple[np.ndarray, ...], np.ndarray]]:
    """(spelled, symbols, contexts, owners): runs of words and runs of bytes, of bounded length."""
    is_byte = columns[0] > code.escape
    for spelled in (False, True):
        part = tuple(np.ascontiguousarray(x[is_byte == spelled]) for x in columns)
        for i in range(0, len(part[0]), at_most):
            sym, *contexts, owner = (x[i : i + at_most] for x in part)
            yield spelled, sym, tuple(contexts), owner


def gates(spelled: bool, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Weight set of each decision: word or byte, and what the longer contexts have seen."""
    return (16 * spelled + second * 4 + third).astype(np.int32)


def confidence(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, [1, 4, 32])


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.3) / (n0 + 0.3)), -7.9, 7.9)


@dataclass
class Mixer:
    weights: np.ndarray
    refine: np.ndarray

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        x = self.weights[CONTEXTS].take(gate)
        for w, o in zip(self.weights, odds, strict=False):
            x += w.take(gate) * o
        return np.clip(x, -7.99, 7.99, out=x)

    def log10_table(self) -> np.ndarray:
        """log10 of the probability of a zero and of a one by gate and mixed log-odds in 32nds: the mean of
        the mixed and the refined probability, the latter interpolated."""
        x = np.arange(FINE) / 32 - 8
        at = np.minimum((x + 8) * 2, STEPS - 1.001)
        low = at.astype(np.int64)
        refined = self.refine[:, low] * (1 - (at - low)) + self.refine[:, low + 1] * (at - low)
        p = np.clip(0.5 * refined + 0.5 / (1 + np.exp(-x)), 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()


def fit_mixer(stream: Iterator[tuple[list[np.ndarray], np.ndarray, bool]], counts: np.ndarray, rate: float = 0.1, step: int = 2048) -> Mixer:
    """One online pass over (slots, bits, spelled) of training texts whose own counts are left out one by one."""
    return fit_left_out(stream, left_out(counts), rate, step)


def fit_left_out(stream: Iterator[tuple[list[np.ndarray], np.ndarray, bool]], left: np.ndarray, rate: float = 0.1, step: int = 2048) -> Mixer:
    """``fit_mixer`` from packed entries without the count of the bit itself (``left_out``)."""
    grid = 1 / (1 + np.exp(-(np.arange(STEPS) / 2 - 8)))
    mixer = Mixer(np.array([[0.6] * GATES, [0.3] * GATES, [0.3] * GATES, [0.0] * GATES]), np.tile(grid, (GATES, 1)))
    for ids, bits, spelled in stream:
        found = [left.take(x.astype(np.int64) * 2 + bits) for x in ids]
        all_gates = gates(spelled, found[1] & 3, found[2] & 3)
        all_odds = [(v >> 2) * np.float32(1 / 64) for v in found]
        for i in range(0, len(bits), step):
            bit, gate, odds = bits[i : i + step], all_gates[i : i + step], [o[i : i + step] for o in all_odds]
            x = mixer.mixed(odds, gate)
            error = bit - 1 / (1 + np.exp(-x))
            uses = np.maximum(np.bincount(gate, minlength=GATES), 1)
            mixer.weights[:CONTEXTS] += rate * np.array([np.bincount(gate, weights=error * o, minlength=GATES) for o in odds]) / (uses + 50)
            mixer.weights[CONTEXTS] += rate * np.bincount(gate, weights=error, minlength=GATES) / (uses + 50)
            row = gate * STEPS + np.rint((x + 8) * 2).astype(np.int64)
            seen, ones = np.bincount(row, minlength=GATES * STEPS), np.bincount(row, weights=bit, minlength=GATES * STEPS)
            met = np.flatnonzero(seen)
            keep = 0.995 ** seen[met]
            flat = mixer.refine.reshape(-1)
            flat[met] = flat[met] * keep + ones[met] / seen[met] * (1 - keep)
    return mixer


@dataclass
class Folded:
    """A mixer for scoring: weights scaled so that packed entries give positions in the table of logs at once
    (the confidence in their last two bits shifts the log-odds by less than their rounding)."""

    weights: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(mixer: Mixer) -> Folded:
        w = mixer.weights * 32
        w[:CONTEXTS] /= 64 * 4
        w[CONTEXTS] += 8 * 32 + 0.5
        return Folded(w.astype(np.float32), mixer.log10_table())

    def log10(self, seen: list[np.ndarray], bits: np.ndarray, spelled: bool) -> np.ndarray:
        """log10 of the probability of each bit, from the packed entries of its contexts."""
        gate = gates(spelled, seen[1] & 3, seen[2] & 3)
        x = self.weights[CONTEXTS].take(gate)
        for w, v in zip(self.weights, seen, strict=False):
            x += w.take(gate) * v.astype(np.float32)
        np.clip(x, 0.5, FINE - 0.5, out=x)
        gate *= FINE
        gate += x.astype(np.int32)
        gate *= 2
        gate += bits
        return self.logs.take(gate)


def pack(counts: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Log-odds in 64ths and confidence of every slot, in 16 bits."""
    out = np.empty(counts.shape[1], dtype=np.int16)
    for i in range(0, len(out), step):
        n0, n1 = counts[0, i : i + step].astype(np.float64), counts[1, i : i + step].astype(np.float64)
        out[i : i + step] = np.rint(log_odds(n0, n1) * 64) * 4 + confidence(n0 + n1)
    return out


def left_out(counts: np.ndarray) -> np.ndarray:
    """Packed entries of every slot with one zero less, then with one one less; slot by slot."""
    small = np.maximum(*counts) < 256
    out = left_out_bytes().take(np.where(small, counts[0] * 256 + counts[1], 0)).view(np.int16)
    big = np.flatnonzero(~small)
    for bit in (0, 1):
        out[big * 2 + bit] = pack(less(counts[:, big], bit))
    return out


def less(counts: np.ndarray, bit: int) -> np.ndarray:
    """Counts of zeros and ones without one of ``bit``."""
    return np.maximum(counts - (np.arange(2) == bit)[:, None], 0)


@cache
def left_out_bytes() -> np.ndarray:
    """Both entries of ``left_out`` in 32 bits for all pairs of counts below 256."""
    pairs = np.array(np.divmod(np.arange(1 << 16), 256))
    return np.stack([pack(less(pairs, bit)) for bit in (0, 1)], axis=1).view(np.int32).ravel()


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words with their counts, most frequent first, that occur so often that at most ``most`` others do.

    The least count is found from the number of words in each eighth of a doubling, so the driver gets
    some hundred rows, then the words.
    """
    eighth = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    left, least = most, None
    for r in counts.groupBy(eighth.alias("e")).agg(F.count("*").alias("words")).orderBy(F.desc("e")).collect():
        if r.words > left:
            break
        left, least = left - r.words, r.e
    if least is None:
        return []
    found = counts.where(eighth >= least).toArrow().to_pydict()
    return sorted(zip(found["word"], found["n"], strict=True), key=lambda x: (-x[1], x[0]))


def text_log10(code: Code, table: np.ndarray, table_bits: int, mixer: Folded, columns: tuple[np.ndarray, ...], texts: int) -> np.ndarray:
    """log10 probability of each of ``texts`` texts whose symbols are in ``columns``."""
    total = np.zeros(texts)
    for spelled, sym, contexts, owner in pieces(code, columns):
        ends, ids, bits = slots(code, sym, contexts, table_bits, spelled)
        logs = mixer.log10([table.take(x) for x in ids], bits, spelled)
        run = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])[np.concatenate([[0], ends])]
        total += np.bincount(owner, weights=np.diff(run), minlength=texts)
    return total


def word_counts(texts: DataFrame, flush: int = 800_000) -> DataFrame:
    """(word, n) over all texts, the end mark once a text; summed in each task first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in frames:
            for t in pdf["t"]:
                c.update(words(t))
                c[END] += 1
                if len(c) > flush:
                    yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                    c = Counter()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fitted(totals: np.ndarray) -> np.ndarray:
    """Pairs of counts of zeros and ones in 32 bits; a pair too large is halved until it fits, which keeps its odds."""
    pairs = totals.reshape(-1, 2).copy()
    while len(over := np.flatnonzero(pairs.max(axis=1) >= 2**31)):
        pairs[over] >>= 1
    return pairs.ravel().astype(np.int32)


def squeeze(counts: np.ndarray) -> bytes:
    """A block of counts: a byte each, compressed, and those over a byte apart."""
    big = np.flatnonzero(counts > 254)
    return pickle.dumps((big.astype(np.int32), counts[big], zlib.compress(np.where(counts > 254, 0, counts).astype(np.uint8).tobytes(), 1)))


def unsqueeze(data: bytes) -> np.ndarray:
    big, values, rest = pickle.loads(data)
    out = np.frombuffer(zlib.decompress(rest), dtype=np.uint8).astype(np.int64)
    out[big] = values
    return out


def slot_counts(texts: DataFrame, code, table_bits: int, fan_in: int = 16) -> np.ndarray:
    """Zeros and ones seen in every slot, over all texts.

    Each task fills a table and gives it up in compressed blocks; blocks are added in rounds of at most
    ``fan_in`` at a time, so no task ever holds more than that many, and only the sum reaches the driver.
    """
    width = (2 << table_bits) // BLOCKS

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        c, counts, any_text = code.value, np.zeros(2 << table_bits, dtype=np.int32), False
        for group in batches(words(t) for pdf in frames for t in pdf["t"]):
            any_text = True
            for spelled, sym, contexts, _ in pieces(c, symbols(c, Tokens.of(c, group))):
                _, ids, bits = slots(c, sym, contexts, table_bits, spelled)
                for x in ids:
                    np.add.at(counts, x.astype(np.int64) * 2 + bits, np.int32(1))
        if any_text:
            part = TaskContext.get().partitionId()
            for b in range(BLOCKS):
                yield pd.DataFrame({"block": [b], "part": [part], "data": [squeeze(counts[b * width : (b + 1) * width])]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for d in pdf["data"]:
            total += unsqueeze(d)
        return pd.DataFrame({"block": [pdf["block"][0]], "part": [pdf["part"][0] // fan_in], "data": [squeeze(fitted(total))]})

    schema = "block int, part int, data binary"
    level = texts.mapInPandas(fill, schema)
    left = max(1, texts.rdd.getNumPartitions())
    while left > 1:
        level = level.withColumn("to", F.floor(F.col("part") / fan_in)).groupBy("block", "to").applyInPandas(add, schema)
        left = -(-left // fan_in)
    counts = np.zeros((2, 1 << table_bits), dtype=np.int32)
    for r in level.toLocalIterator():
        counts[:, r.block * width // 2 : (r.block + 1) * width // 2] = unsqueeze(bytes(r.data)).reshape(-1, 2).T
    return counts


def bits_for(tokens: int, most: int) -> int:
    """log2 of the number of slots: four for a training token, within 2^16 and 2^``most``."""
    return min(max((max(tokens, 1) - 1).bit_length() + 2, 16), most)


def learn_mixer(texts: DataFrame, code, table: np.ndarray, table_bits: int) -> Mixer:
    """Weights and refinement learned from all ``texts`` by an online pass in each task, averaged by decisions."""
    # in compressed blocks, as each executor keeps a copy on its disk
    flat = table.T.reshape(BLOCKS, -1)
    counts = texts.sparkSession.sparkContext.broadcast([squeeze(block) for block in flat])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, seen = code.value, [0]
        left = np.empty(2 << table_bits, dtype=np.int16)
        for b, block in enumerate(counts.value):
            part = left_out(unsqueeze(block).reshape(-1, 2).T)
            left[b * len(part) : (b + 1) * len(part)] = part

        def stream() -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
            for group in batches(words(t) for pdf in frames for t in pdf["t"]):
                for spelled, sym, contexts, _ in pieces(c, symbols(c, Tokens.of(c, group))):
                    _, ids, bits = slots(c, sym, contexts, table_bits, spelled)
                    seen[0] += len(bits)
                    yield ids, bits, spelled

        mixer = fit_left_out(stream(), left)
        values = np.concatenate([mixer.weights.ravel(), mixer.refine.ravel()])
        yield pd.DataFrame({"at": np.arange(len(values), dtype=np.int32), "value": values, "n": float(seen[0])})

    parts = texts.mapInPandas(fit, "at int, value double, n double").where("n > 0")
    mean = parts.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).orderBy("at").toPandas()["value"].to_numpy()
    if not len(mean):
        return fit_left_out(iter(()), np.zeros(2, dtype=np.int16))
    return Mixer(mean[: (CONTEXTS + 1) * GATES].reshape(CONTEXTS + 1, GATES), mean[(CONTEXTS + 1) * GATES :].reshape(GATES, STEPS))


SCORED = "n_tokens long, coded long, base_coded double, score double, rare array<binary>"


def score_texts(
    docs: DataFrame,
    train,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int = 1 << 18,
    max_table_bits: int = 24,
) -> DataFrame:
    """``docs``' ids and texts scored by a model of the rows for which the column ``train`` holds.

    Returns id_col, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null for empty
    text), one row for each row of ``docs``, repeated ids included. A null text is an empty one: its end is
    its only token. Without a training row the model is uniform over the byte tree. ``vocabulary`` bounds
    the words with a code of their own (the rest are spelled). The table has four slots for a training token,
    up to 2^``max_table_bits`` (what a worker holds in memory; beyond, contexts share slots more
    often). Mixing weights are learned from all training texts. Word counts for the base score of words out of the vocabulary are joined, so all words count.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = base.where("train").select("t")
    counts = checkpoint(word_counts(texts))
    n_all, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent_words(counts, vocabulary)
    code = spark.sparkContext.broadcast(Code.build(top, n_all - sum(n for _, n in top)))
    table_bits = bits_for(n_all, max_table_bits)
    table = slot_counts(texts, code, table_bits)
    mixer = learn_mixer(texts, code, table, table_bits)
    base_log = np.log10((np.array([n for _, n in top], dtype=np.float64) + 1) / (n_all + n_words + 1))
    model = spark.sparkContext.broadcast((pack(table), Folded.of(mixer), np.append(base_log, 0.0)))
    whole = n_words <= len(top)

    @F.pandas_udf(SCORED)
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, (packed, mixed, base_logs) = code.value, model.value
        for s in frames:
            out = []
            for group in batches(words(t) for t in s):
                tokens = Tokens.of(c, group)
                found = text_log10(c, packed, table_bits, mixed, symbols(c, tokens), len(group))
                owner, is_rare = np.repeat(np.arange(len(group)), tokens.sizes), tokens.ids == c.escape
                known = np.bincount(owner[~is_rare], minlength=len(group))
                base_sums = np.bincount(owner, weights=base_logs.take(tokens.ids), minlength=len(group))
                rare: list[list[bytes]] = [[] for _ in group]
                for i in np.flatnonzero(is_rare):
                    rare[owner[i]].append(tokens.flat[i])
                out += zip(tokens.sizes.tolist(), known.tolist(), base_sums.tolist(), found.tolist(), rare, strict=True)
            yield pd.DataFrame(out, columns=["n_tokens", "coded", "base_coded", "score", "rare"])

    scored = checkpoint(base.select("id", F.octet_length(F.coalesce("t", F.lit(""))).alias("n_bytes"), score("t").alias("s")).select("id", "n_bytes", "s.*"))
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    rest = F.lit(float(np.log10(1 / (n_all + n_words + 1))))
    if whole:
        found = scored.withColumns({"n_known": F.col("coded"), "base_score": F.col("base_coded") + rest * (F.col("n_tokens") - F.col("coded"))})
    else:
        spread = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
        hits = spread.join(counts, "word").groupBy("row").agg(
            F.sum("tf").alias("hits"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more")
        )
        found = scored.join(hits, "row", "left").withColumns(
            {
                "n_known": F.col("coded") + F.coalesce("hits", F.lit(0)),
                "base_score": F.col("base_coded") + rest * (F.col("n_tokens") - F.col("coded")) + F.coalesce("more", F.lit(0.0)),
            }
        )
    return found.select(
        F.col("id").alias(id_col), "n_tokens", F.col("n_known").cast("long"), F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
