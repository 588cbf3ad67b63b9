"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic with at least ``severe`` of the words that pass the screening below
(the labels themselves are 0 or 1; labels with more grades are used as they are). One weight vector is shared by all
thresholds: P(grade > k | x) = sigmoid(w . x - t_k) with t_0 <= t_1. Features are the distinct words of the whole
text, lower-cased and without outer punctuation, and their beginnings of 4 to 7 characters, hashed to ``2 ** bits`` slots. The fit runs on the driver by
proximal gradient steps with an L1 penalty on at most ``max_rows`` labelled documents, those of the least hashes of
their ids (a documented, constant bound); words seen in fewer than ``min_docs`` of them get no weight. Scoring is a
narrow map over every whole text with the few words that have weight. Before the fit, words are screened by the
likelihood-ratio statistic of (word, toxic), at a level divided by the number of words, so that words of chance get none.

Severity is the expected grade, the sum over k of P(grade > k). A document is rejected if P(grade > 0) reaches
``reject`` and its words weigh towards toxic, so one without known words is kept whatever the labels' base rate. Nulls: a null text has no words; it, like an empty one, gets the base severity and is kept. Null labels
are not used. Without any label, or with only one grade, severity is 0 and nothing is rejected. Repeated ids
are scored row by row; extra columns are ignored or, in :func:`keep_clean`, passed through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_BYTES = np.random.Generator(np.random.PCG64(613)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:['-][a-z0-9\x80-\xff]+)*")


def words(text: bytes | None) -> set[bytes]:
    return set(_WORD.findall((text or b"").lower()))


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 7 characters, which let families of words share weight."""
    text = word.decode(errors="replace")
    return [word, *(b"^" + text[:n].encode() for n in range(4, 8) if len(text) > n)]


def slot(word: bytes, bits: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) & ((1 << bits) - 1)


def doc_slots(text: bytes | None, bits: int) -> list[int]:
    return sorted({slot(f, bits) for w in words(text) for f in features(w)})


@dataclass
class Model:
    bits: int = 22
    thresholds: list[float] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)

    def chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of the linear scores ``z``."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(self.thresholds)[None, :], -40, 40)))


def distinct_rows(rows: list, keys: int = 4) -> np.ndarray:
    """Numbers of rows of which none is a copy or near-copy of another: rows that share the two least of their rare slots
    under one of ``keys`` hashes count as one. Else the words of one copied document would look like words of its grade."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, row = np.concatenate(rows).astype(np.int32, copy=False), np.repeat(np.arange(len(rows), dtype=np.int32), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rare = count[inverse] <= max(3, len(rows) // 50)
    flat, row = flat[rare].astype(np.uint64), row[rare]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    firsts = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    seen: dict[tuple, int] = {}
    for k in range(keys if len(row) else 0):
        with np.errstate(over="ignore"):
            h = common.mix64(flat + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        least = np.minimum.reduceat(h, firsts)
        width = np.diff(firsts, append=len(row))
        h[h == np.repeat(least, width)] = 2**64 - 1
        for i, x, y in zip(row[firsts].tolist(), least.tolist(), np.minimum.reduceat(h, firsts).tolist()):
            if y != 2**64 - 1:
                parent[root(seen.setdefault((k, x, y), i))] = root(i)
    return np.unique([root(i) for i in range(len(rows))])


def fit_rows(rows: list[list[int]], grades: np.ndarray, bits: int = 22, l1: float = 0.0003, min_docs: int = 3, level: float = 0.02, severe: int = 3, steps: int = 400) -> Model:
    """Fits weights and ordered thresholds to documents given as lists of slots. FISTA with L1 on the weights."""
    top = int(grades.max()) if len(grades) else 0
    if not len(rows) or top == 0 or not (grades == 0).any() or not any(map(len, rows)):
        return Model(bits)
    one = distinct_rows(rows)
    rows, grades = [rows[i] for i in one], grades[one]
    top = int(grades.max())
    if top == 0 or not (grades == 0).any():
        return Model(bits)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if size.sum() else np.zeros(0, np.int32)
    vocab, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    row_of = np.repeat(np.arange(len(rows)), size)
    toxic = np.bincount(inverse, (grades > 0)[row_of].astype(float), len(vocab))
    base = (grades > 0).mean()
    part = lambda k, share: k * np.log(np.maximum(k, 1e-12) / np.maximum(count * share, 1e-12))
    ratio = 2 * (part(toxic, base) + part(count - toxic, 1 - base))
    tried = max(1, int((count >= min_docs).sum()))
    common_enough = (count >= min_docs) & (ratio >= 2 * np.log(tried / level))
    # The labels tell no severity: a toxic document is of the upper grade if it has several of the words that passed.
    bad = np.bincount(row_of, (common_enough & (toxic > base * count))[inverse].astype(float), len(rows))
    if top == 1:
        grades = np.where((grades > 0) & (bad >= severe), 2, grades)
        top = int(grades.max())
    number = np.cumsum(common_enough) - 1
    use = common_enough[inverse]
    col, row, vocab = number[inverse[use]], row_of[use], vocab[common_enough]
    n, d = len(rows), len(vocab)
    present = [k for k in range(top) if (grades > k).any()]
    y = np.column_stack([grades > k for k in present]).astype(float)
    t = -np.log(np.clip(y.mean(0), 1e-6, 1 - 1e-6) / (1 - np.clip(y.mean(0), 1e-6, 1 - 1e-6)))
    w = np.zeros(d)
    step, v, m = 8.0, w.copy(), 1.0
    loss_before = np.inf
    for _ in range(steps):
        z = np.bincount(row, v[col], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
        g = (p - y).sum(1)
        new = v - step * np.bincount(col, g[row], d) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        z2 = np.bincount(row, new[col], n)
        p2 = 1 / (1 + np.exp(-np.clip(z2[:, None] - t[None, :], -40, 40)))
        loss = -np.mean((y * np.log(p2 + 1e-12) + (1 - y) * np.log(1 - p2 + 1e-12)).sum(1)) + l1 * np.abs(new).sum()
        if loss > loss_before:  # too far: without momentum from where it was, then by shorter steps
            step, v, m = step if m > 1 else step / 2, w.copy(), 1.0
            if step < 1e-3:
                break
            continue
        loss_before = loss
        m2 = (1 + (1 + 4 * m * m) ** 0.5) / 2
        v = new + (m - 1) / m2 * (new - w)
        w, m = new, m2
        t = np.maximum.accumulate(t + 2 * (p2 - y).mean(0))
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(bits, t.tolist(), {int(vocab[i]): float(w[i]) for i in keep})


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, bits: int) -> tuple[list[list[int]], np.ndarray]:
    """Slots and grades of at most ``max_rows`` labelled documents, the same ones for the same table."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text")

    def work(batches):
        import pyarrow as pa

        common.claim("toxicity")

        cache: dict[bytes, tuple[int, ...]] = {}

        def of(word: bytes) -> tuple[int, ...]:
            if word not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[word] = tuple(slot(f, bits) for f in features(word))
            return cache[word]

        for batch in batches:
            slots = [sorted({s for w in words(t) for s in of(w)}) for t in common.utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["doc_id", "grade", "slots"])

    # Few rows of any table, so dealt anew: a table of one row group would leave them to one task.
    joined = joined.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # Bounded by ``max_rows``; as Arrow, whose memory the rows are views of, so the driver holds four bytes a slot.
    found = joined.mapInArrow(work, "doc_id long, grade int, slots array<int>").toArrow()
    rows: list[np.ndarray] = []
    for chunk in found.column("slots").chunks:
        bounds = np.concatenate(([0], np.cumsum(chunk.value_lengths().to_numpy())))
        flat = chunk.flatten().to_numpy()
        rows += [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    return [rows[i] for i in order], found.column("grade").to_numpy().astype(np.int64)[order]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, bits: int = 22, **options) -> Model:
    rows, grades = training_rows(docs, labels, max_rows, bits)
    return fit_rows(rows, grades, bits, **options)


_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[39, 45]] = True


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of :func:`words` in bytes."""
    inside = _PART[data]
    edge = np.concatenate(([False], inside, [False]))
    inside |= _JOINS[data] & edge[:-2] & edge[2:]
    turn = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


class _Scorer:
    """Bytes of texts to linear scores. A word is looked up by its hash; what it weighs is worked out once and forgotten
    beyond ``most`` words. Words of over 64 bytes are worked out each time."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.index = model, most, common.HashIndex(most)
        self._forget()

    def _forget(self) -> None:
        self.index.clear()
        self.slots: list[tuple[int, ...]] = []
        self.weighs = np.zeros(0, bool)

    def _add(self, found: list[bytes]) -> int:
        first = len(self.slots)
        new = [tuple(v for v in (slot(f, self.model.bits) for f in features(w)) if v in self.model.weights) for w in found]
        self.slots += new
        self.weighs = np.concatenate((self.weighs, np.fromiter(map(bool, new), bool, len(new))))
        return first

    def _batch(self, texts: list[bytes]) -> np.ndarray:
        raw = b"\n".join(texts).lower()
        data = np.frombuffer(raw, np.uint8)
        start, end = word_ranges(data)
        if len(self.slots) > self.most:
            self._forget()
        h = common.range_hashes(data, start, end, _BYTES) if len(start) else np.zeros(0, np.uint64)
        h[h == 0] = 1
        short = end - start <= 64
        number = np.full(len(start), -1, np.int32)
        number[short] = self.index.find(h[short])
        new = np.flatnonzero(short & (number < 0))
        if len(new):
            marks, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            first = self._add([raw[a:b] for a, b in zip(start[new[one]].tolist(), end[new[one]].tolist())])
            self.index.learn(marks, first)
            number[new] = first + back
        known, long = len(self.slots), np.flatnonzero(~short)
        if len(long):
            number[long] = self._add([raw[start[i] : end[i]] for i in long.tolist()]) + np.arange(len(long))
        hit = np.flatnonzero(self.weighs[number])
        bounds = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(bounds, start[hit], side="right")
        pairs = sorted({(d, v) for d, n in zip(doc.tolist(), number[hit].tolist()) for v in self.slots[n]})
        if len(long):
            self.slots, self.weighs = self.slots[:known], self.weighs[:known]
        return np.bincount([d for d, _ in pairs], [self.model.weights[v] for _, v in pairs], len(texts)) if pairs else np.zeros(len(texts))

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._batch([t or b"" for t in texts[a:b]]) for a, b in common.text_batches(texts, 512 << 10))])


def score(docs: DataFrame, model: Model, reject: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (most likely), rejected; a narrow map."""

    def work(batches):
        import pyarrow as pa

        common.claim("toxicity")

        z = _Scorer(model)
        for batch in batches:
            n = batch.num_rows
            s = z(common.utf8(batch.column(1)))
            p = model.chances(s) if model.thresholds else np.zeros((n, 1))
            grade = (p >= 0.5).sum(1)
            told = (p[:, 0] >= reject) & (s > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int32)), pa.array(told)], names=["doc_id", "severity", "p_toxic", "grade", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, reject: float = 0.5) -> DataFrame:
    """``docs`` without rejected rows, columns unchanged; a narrow map."""

    def work(batches):
        import pyarrow as pa

        common.claim("toxicity")

        z = _Scorer(model)
        for batch in batches:
            if model.thresholds:
                s = z(common.utf8(batch.column(batch.schema.get_field_index("text"))))
                batch = batch.filter(pa.array((model.chances(s)[:, 0] < reject) | (s <= 0)))
            yield batch

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(work, docs.schema)


def op10_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
