"""Language-model scores from a weighted backoff automaton over word n-grams.

The corpus is dealt into chunks of a few megabytes by a hash of the document. Each chunk asks
for the training counts of all its distinct n-grams: its keys (64-bit hashes, sorted) go, with
the chunk's own counts, to buckets by key range; a bucket adds up and answers every chunk in
the order asked. So every count covers the whole corpus, nothing is broadcast, no key is hot
(a chunk sends it once), and a chunk never holds more of the model than its own n-grams.

Within a chunk the counted n-grams are an automaton. A state is a history that was seen in
training; an arc (history, word) carries the log-probability of the word; a failure arc leads
to the history without its first word and carries the log of the backoff weight. A text is
read from left to right from the begin-of-text state: at each token the state follows its arc,
or fails, adding weights, until a shorter state has one; the empty history knows every word.
Which states and arcs exist at a position depends on its last words only, so the traversal is
done for all positions of a chunk at once, one order after the other.

Probabilities are smoothed by interpolation: ``P(w|h) = (1 - b) c(hw) / c(h) + b P(w|h')`` with
the add-one unigram at the bottom. ``b`` depends on how often the history was seen; it is the
leave-one-out rate at which a word after such a history is new. Both counts are the answered ones
of the whole corpus, so the chunks are read once more for these sums before they are scored, and
scores do not depend on the chunks. For any ``b`` the probabilities add up to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_rules import _ddl
from quire.llm.text import joined, mix, row, utf8, words
from quire.session import settle

ORDER = 2
CHUNK_BYTES = 8 << 20
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BINS = 48


@dataclass
class Grams:
    """The n-grams of a chunk. ``at[k][i]`` is the number of the (k+1)-gram that ends at place i, -1 if there is none."""

    text: np.ndarray  # text number of each place
    token: np.ndarray  # is the place a token (not the begin mark)?
    keys: np.ndarray  # distinct n-gram keys, ascending; the two lowest bits are the order (0: begin mark)
    at: list[np.ndarray]


def grams(texts: pa.Array, order: int) -> Grams:
    """Begin mark, words (A-Z folded) and end token of each text, as n-grams of all orders."""
    n = len(texts)
    data, offsets = utf8(texts)
    _, _, owner, hashes = words(data, offsets, fold=True)
    size = np.bincount(owner, minlength=n) + 2
    last = np.cumsum(size) - 1
    x = np.empty(int(size.sum()), np.uint64)
    inside = np.ones(len(x), bool)
    first = last - size + 1
    x[first], x[last] = BEGIN, END
    inside[first] = inside[last] = False
    x[inside] = hashes
    text = np.repeat(np.arange(n), size)
    place = np.arange(len(x)) - first[text]
    found, where = [], []
    for k in range(1, order + 1):
        i = np.flatnonzero(place >= k - 1)
        key = joined(x, k)[i - k + 1] & ~np.uint64(3) | np.uint64(k)
        if k == 1:
            key[place[i] == 0] &= ~np.uint64(3)
        found.append(key)
        where.append(i)
    keys, number = np.unique(np.concatenate(found), return_inverse=True)
    at, used = [], 0
    for i in where:
        a = np.full(len(x), -1, np.int64)
        a[i] = number[used : used + len(i)]
        used += len(i)
        at.append(a)
    return Grams(text, place > 0, keys, at)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in byte planes, compressed: the high planes are nearly empty."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def chunk_counts(g: Grams, train: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in the chunk's training texts."""
    learned = train[g.text]
    out = np.zeros(len(g.keys), np.int64)
    for a in g.at:
        out += np.bincount(a[(a >= 0) & learned], minlength=len(out))
    return out


def _histories(g: Grams, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a (k+1)-gram that ends in a token: place, number of the n-gram, number of its history."""
    i = np.flatnonzero((g.at[k] >= 0) & g.token)
    return i, g.at[k][i], g.at[k - 1][i - 1]


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BINS - 1)


def novelty(g: Grams, train: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[order, bin of the history's count, (tokens, tokens that would be new)] over the chunk's training texts; ``counts`` are the corpus's."""
    out = np.zeros((len(g.at) - 1, BINS, 2))
    for k in range(1, len(g.at)):
        i, gram, history = _histories(g, k)
        learned = train[g.text[i]]
        bins = _bin(counts[history[learned]])
        out[k - 1, :, 0] = np.bincount(bins, minlength=BINS)
        out[k - 1, :, 1] = np.bincount(bins, counts[gram[learned]] == 1, BINS)
    return out


def backoff_weights(seen: np.ndarray) -> np.ndarray:
    """Backoff weight by order and bin; bins without tokens take the value of the bin before."""
    out = np.full(seen.shape[:2], 0.5)
    for k in range(len(out)):
        value = 0.5
        for b in range(BINS):
            if seen[k, b, 0] > 0:
                value = float(np.clip((seen[k, b, 1] + 0.5) / (seen[k, b, 0] + 1), 0.01, 0.95))
            out[k, b] = value
    return out


@dataclass
class Automaton:
    """Log10 weights by n-gram number: of the arc that reads its last word, and of the failure arc of the state it is."""

    arc: np.ndarray
    fail: list[np.ndarray]
    counts: np.ndarray


def build(g: Grams, counts: np.ndarray, tokens: int, vocabulary: int, weights: np.ndarray) -> Automaton:
    p = (counts + 1.0) / (tokens + vocabulary + 1.0)  # right for single words; longer n-grams follow
    fail = []
    for k in range(1, len(g.at)):
        b = weights[k - 1][_bin(counts)]
        fail.append(np.log10(b))
        i, gram, history = _histories(g, k)
        known = np.flatnonzero(counts[gram] > 0)
        i, gram, history = i[known], gram[known], history[known]
        p[gram] = (1 - b[history]) * counts[gram] / counts[history] + b[history] * p[g.at[k - 1][i]]
        # A longer n-gram that was never seen has no arc, but its shorter ones may: keep the backed-off value.
        i, gram, history = _histories(g, k)
        new = counts[gram] == 0
        factor = np.where(counts[history] > 0, b[history], 1.0)
        p[gram[new]] = (factor * p[g.at[k - 1][i]])[new]
    return Automaton(np.log10(p), fail, counts)


def walk(g: Grams, a: Automaton) -> np.ndarray:
    """Log10 probability of every token place: arcs and failure arcs from the longest state down."""
    total = np.zeros(len(g.text))
    open_ = g.token.copy()
    for k in range(len(g.at) - 1, 0, -1):
        i, gram, history = _histories(g, k)
        state = open_[i] & (a.counts[history] > 0)
        arc = state & (a.counts[gram] > 0)
        total[i[arc]] += a.arc[gram[arc]]
        failed = state & ~arc
        total[i[failed]] += a.fail[k - 1][history[failed]]
        open_[i[arc]] = False
    rest = np.flatnonzero(open_)
    total[rest] += a.arc[g.at[0][rest]]
    return total


def held_out(doc_id) -> F.Column:
    """Rows not learned from: crc32 of the id as text is 2 modulo 7; null ids are learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def score_texts(
    docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(row, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Null and empty texts have the end token only. Rows that repeat count each time. Without training
    rows all counts are zero. ``order`` is at most 3.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    size = docs.select(F.sum(F.octet_length(body).cast("long")).alias("n")).first()["n"] or 0
    n = int(-(-max(1, size) // chunk_bytes))
    id_ = docs[f"`{doc_id}`"]
    dealt = docs.select(
        row(docs, carry).alias("row"), body.alias("text"), held_out(id_).alias("held_out"),
        F.pmod(F.xxhash64(id_, body), F.lit(n)).cast("int").alias("chunk"),
    )

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        train = ~np.asarray(table.column("held_out").combine_chunks())
        g = grams(table.column("text").combine_chunks(), order)
        counts = chunk_counts(g, train)
        bucket = ((g.keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        mine = np.unique(bucket).tolist()
        parts = [slice(a, b) for a, b in zip(np.searchsorted(bucket, mine), np.searchsorted(bucket, mine, "right"))]
        pack = zstandard.ZstdCompressor(level=1)
        return pa.table(
            {
                "bucket": pa.array(mine, pa.int32()),
                "chunk": pa.array([chunk] * len(mine), pa.int32()),
                "keys": pa.array([pack_keys(g.keys[p]) for p in parts], pa.binary()),
                "counts": pa.array([pack.compress(counts[p].tobytes()) for p in parts], pa.binary()),
            }
        )

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        counts = [np.frombuffer(unpack.decompress(c), np.int64) for c in table.column("counts").to_pylist()]
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts), len(distinct)).astype(np.int64)
        single = (distinct & np.uint64(3)) == 1
        ends = np.cumsum(list(map(len, keys)))
        rows = len(keys)
        return pa.table(
            {
                "chunk": table.column("chunk").combine_chunks(),
                "bucket": pa.array([key[0].as_py()] * rows, pa.int32()),
                "totals": pa.array([pack.compress(total[number[e - len(k) : e]].tobytes()) for k, e in zip(keys, ends)], pa.binary()),
                "tokens": pa.array([int(total[single].sum())] + [0] * (rows - 1), pa.int64()),
                "vocabulary": pa.array([int((total[single] > 0).sum())] + [0] * (rows - 1), pa.int64()),
            }
        )

    asked = dealt.select("text", "held_out", "chunk").groupBy("chunk").applyInArrow(
        ask, "bucket int, chunk int, keys binary, counts binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(
        answer, "chunk int, bucket int, totals binary, tokens long, vocabulary long"
    )
    answers = settle(answers, "lm-counts")
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("vocabulary").alias("vocabulary")).first()
    tokens, vocabulary = sums["tokens"] or 0, sums["vocabulary"] or 0
    totals = answers.select("chunk", "bucket", "totals").groupBy("chunk")

    def answered(left: pa.Table, right: pa.Table) -> tuple[Grams, np.ndarray]:
        """The chunk's n-grams and how often each occurs in the corpus."""
        g = grams(left.column("text").combine_chunks(), order)
        unpack = zstandard.ZstdDecompressor()
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist()))
        counts = np.concatenate([np.frombuffer(unpack.decompress(t), np.int64) for _, t in parts])
        if len(counts) != len(g.keys):
            raise ValueError("the answers do not fit the chunk's n-grams")
        return g, counts

    def rates(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        g, counts = answered(left, right)
        seen = novelty(g, ~np.asarray(left.column("held_out").combine_chunks()), counts).ravel()
        return pa.table({"k": pa.array(np.arange(len(seen)), pa.int32()), "v": pa.array(seen, pa.float64())})

    seen = np.zeros(2 * BINS * max(0, order - 1))
    if len(seen):
        texts = dealt.select("text", "held_out", "chunk").groupBy("chunk")
        for r in texts.cogroup(totals).applyInArrow(rates, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            seen[r["k"]] = r["v"]
    weights = backoff_weights(seen.reshape(max(0, order - 1), BINS, 2))

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        g, counts = answered(left, right)
        places = walk(g, build(g, counts, tokens, vocabulary, weights))
        rows = left.num_rows
        at, word = g.text[g.token], g.at[0][g.token]
        base = np.log10((counts[word] + 1.0) / (tokens + vocabulary + 1.0))
        columns = {
            "row": left.column("row").combine_chunks(),
            "held_out": left.column("held_out").combine_chunks(),
            "n_tokens": pa.array(np.bincount(at, minlength=rows), pa.int64()),
            "n_known": pa.array(np.bincount(at, counts[word] > 0, rows).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(rows, tokens), pa.int64()),
            "base_score": pa.array(np.bincount(at, base, rows)),
            "score": pa.array(np.bincount(g.text, places, rows)),
        }
        return pa.table(columns)

    out = f"{_ddl(dealt.select('row'))}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(totals).applyInArrow(score, out)
