"""Copies of images by local descriptors, with cropped and edited copies.

Images come as bytes in a media column: binary PGM or PPM, or PNG (8 bits, not interlaced). Corners are found on
a pyramid of scales (steps of the root of 2, down to the smallest size that holds a descriptor): by Harris response the
strongest ``corners`` of an image and the strongest ``QUOTA`` of each square of ``CELL`` pixels, so their number grows with
the area. Each gets an orientation by its intensity centroid and a descriptor of 128 binary tests at places turned by
that orientation. Four tables hold 32 bits each; images that agree in one table at two neighbouring corners, and in
``votes`` entries at least, are candidates. A pair is a link if at least ``inliers`` matched corners agree on one turn,
scale and shift (a vote, then a count). Equal pixels become one class first. Candidates are verified in the blocks of
:mod:`.buckets`, most common entries first and only where no link joins them yet, so a common patch or a large group
of copies makes no square number of rows.

Null, empty or unreadable images have no corners and link with nothing; images of one gray level as well. Others with few
corners link with equal pixels only. Repeated ids with equal bytes share a class; extra columns are ignored. Ties: the least id stands for its class.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets, common

BITS, RADIUS, TABLES = 128, 10, 4
CELL, QUOTA = 64, 16
_PAIRS = np.clip(np.random.Generator(np.random.PCG64(31)).normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)


def decode(data: bytes | None) -> np.ndarray | None:
    """Gray levels (rows x columns, float32), or None if the bytes are not an image that this module reads."""
    try:
        if data is None:
            return None
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while end < len(data) and not data[end : end + 1].isspace():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, top = head
            if top > 255:
                return None
            c = 1 if data[:2] == b"P5" else 3
            x = np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c)
            return x.mean(2, dtype=np.float32)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, palette, colour = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if depth != 8 or interlaced:
                return None
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if colour is None or colour == 3 and palette is None:
        return None
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h + 1, w * c + c), np.int32)
    for y in range(h):
        f, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y, c:]
        row = out[y + 1]
        if f == 0:
            row[c:] = line
        elif f == 2:
            row[c:] = line + up & 255
        else:
            for x in range(w * c):
                a, b, d = int(row[x]), int(up[x]), int(out[y, x])
                if f == 1:
                    g = a
                elif f == 3:
                    g = (a + b) // 2
                else:
                    p = a + b - d
                    g = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row[x + c] = int(line[x]) + g & 255
    x = out[1:, c:].reshape(h, w, c)
    if colour == 3:
        x = palette[x[:, :, 0]]
    elif colour in (4, 6):
        x = x[:, :, :-1]
    return x.mean(2, dtype=np.float32)


def _blur(x: np.ndarray, n: int = 1) -> np.ndarray:
    for _ in range(n):
        for axis in (-1, -2):
            p = np.concatenate((np.take(x, [0], axis), x, np.take(x, [-1], axis)), axis)
            m = x.shape[axis]
            x = (np.take(p, range(m), axis) + 2 * np.take(p, range(1, m + 1), axis) + np.take(p, range(2, m + 2), axis)) / 4
    return x


def _scaled(x: np.ndarray, by: float) -> np.ndarray:
    h, w = int(x.shape[0] / by), int(x.shape[1] / by)
    y0, x0 = np.arange(h) * by, np.arange(w) * by
    yi, xi = np.minimum(y0.astype(int), x.shape[0] - 2), np.minimum(x0.astype(int), x.shape[1] - 2)
    fy, fx = (y0 - yi)[:, None], (x0 - xi)[None]
    a, b, c, d = x[yi][:, xi], x[yi][:, xi + 1], x[yi + 1][:, xi], x[yi + 1][:, xi + 1]
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def _pyramid(image: np.ndarray):
    """(scale, image at it), two scales an octave; each octave is halved from the blurred one before it."""
    pair = [(1.0, image), (math.sqrt(2), None)]
    while pair:
        pair = [(s, _scaled(image, s) if x is None and min(image.shape) / s >= 2 * RADIUS + 3 else x) for s, x in pair]
        pair = [(s, x) for s, x in pair if x is not None and min(x.shape) >= 2 * RADIUS + 3]
        yield from pair
        pair = [(2 * s, _scaled(_blur(x), 2)) for s, x in pair]


def _strongest(r: np.ndarray, ys: np.ndarray, xs: np.ndarray, n: int) -> np.ndarray:
    """The n strongest corners and the strongest QUOTA of each cell, in order of strength."""
    order = np.argsort(-r, kind="stable")
    cell = (ys[order] // CELL) * (1 << 20) + xs[order] // CELL
    by = np.argsort(cell, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.searchsorted(cell[by], cell[by])
    return order[(np.arange(len(order)) < n) | (rank < QUOTA)]


def describe(image: np.ndarray | None, corners: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(place, bits): place rows are x, y, angle, scale in pixels of the image; bits rows are 128 tests as four uint32."""
    places, words = [], []
    for s, x in _pyramid(image.astype(np.float32)) if image is not None else ():
        x = _blur(x, 2)
        gy, gx = np.gradient(x)
        a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        core = r[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1]
        around = np.max([r[RADIUS + 1 + dy : r.shape[0] - RADIUS - 1 + dy, RADIUS + 1 + dx : r.shape[1] - RADIUS - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0)
        ys, xs = np.nonzero((core == around) & (core > 1e-3 * max(float(r.max()), 1.0)))
        best = _strongest(core[ys, xs], ys, xs, max(4, int(corners / s)))
        ys, xs = ys[best] + RADIUS + 1, xs[best] + RADIUS + 1
        if not len(ys):
            continue
        g = np.arange(-RADIUS, RADIUS + 1)
        dy, dx = (v[(g[:, None] ** 2 + g[None] ** 2) <= RADIUS**2] for v in np.meshgrid(g, g, indexing="ij"))
        patch = x[ys[:, None] + dy, xs[:, None] + dx]
        angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
        tx = np.clip(np.rint(px * cos - py * sin).astype(int) + xs[:, None, None], 0, x.shape[1] - 1)
        ty = np.clip(np.rint(px * sin + py * cos).astype(int) + ys[:, None, None], 0, x.shape[0] - 1)
        v = x[ty, tx]
        words.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view(">u4").astype(np.uint32))
        places.append(np.column_stack((xs * s, ys * s, angle, np.full(len(xs), s))))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, TABLES), np.uint32)
    return np.concatenate(places), np.concatenate(words)


def agree(p: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray, bits: int = 20) -> int:
    """Matched corners that agree on one turn, scale and shift from (p, a) to (q, b)."""
    if not len(p) or not len(q):
        return 0
    i, j = np.arange(len(p)), np.zeros(len(p), np.int64)
    least, back, own = np.full(len(q), BITS + 1), np.zeros(len(q), np.int64), np.zeros(len(p), np.int64)
    step = max(1, (1 << 21) // len(q))  # large images: some rows of the matrix at a time
    for at in range(0, len(p), step):
        far = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
        j[at : at + step], own[at : at + step] = far.argmin(1), far.min(1)
        low = far.min(0)
        better = low < least
        least[better], back[better] = low[better], at + far.argmin(0)[better]
    ok = (own <= bits) & (back[j] == i)
    i, j = i[ok], j[ok]
    if len(i) < 3:
        return len(i)
    turn, scale = q[j, 2] - p[i, 2], q[j, 3] / p[i, 3]
    cos, sin = np.cos(turn) * scale, np.sin(turn) * scale
    # Each match proposes a similarity; the count of other matches that it carries to within some pixels is its vote.
    x, y = p[i, 0], p[i, 1]
    sx = q[j, 0] - (cos * x - sin * y)
    sy = q[j, 1] - (sin * x + cos * y)
    most, step = 0, max(1, (1 << 21) // len(i))
    for at in range(0, len(i), step):
        k = slice(at, at + step)
        dx = cos[k, None] * x[None] - sin[k, None] * y[None] + sx[k, None] - q[j, 0][None]
        dy = sin[k, None] * x[None] + cos[k, None] * y[None] + sy[k, None] - q[j, 1][None]
        most = max(most, int(((dx * dx + dy * dy) <= 16 * np.maximum(1, scale[k])[:, None] ** 2).sum(1).max()))
    return most


#: One corner: x, y, angle and scale, and the 128 tests.
CORNER = np.dtype([("place", "<f4", 4), ("bits", "<u4", TABLES)])


def features(images: DataFrame, corners: int = 32) -> DataFrame:
    """image_id, pixels (hash of the decoded image; null without contrast), n (corners), corners (as ``CORNER``); narrow."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pixels, n, found = [], [], []
                for data in part.column(1).to_pylist():
                    x = decode(data)
                    p, b = describe(x, corners)
                    flat = x is None or not x.size or x.max() == x.min()
                    pixels.append(None if flat else hashlib.sha256(str(x.shape).encode() + x.astype("<f4").tobytes()).digest()[:16])
                    row = np.empty(len(p), CORNER)
                    row["place"], row["bits"] = p, b
                    n.append(len(p)), found.append(row.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pixels, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["image_id", "pixels", "n", "corners"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(work, "image_id long, pixels binary, n long, corners binary")


def entries(bits: np.ndarray) -> np.ndarray:
    """The distinct table entries of an image's corners: number of the table and its 32 bits."""
    return np.unique(bits.astype(np.int64) + (np.arange(TABLES, dtype=np.int64) << 32))


def neighbours(row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(corner, neighbour): for each corner its k nearest ones of its scale."""
    some = []
    for s in np.unique(row["place"][:, 3]):
        at = np.flatnonzero(row["place"][:, 3] == s)
        x, y = row["place"][at, 0], row["place"][at, 1]
        m = min(k, len(at) - 1)
        for i in range(0, len(at) if m > 0 else 0, 512):
            far = (x[i : i + 512, None] - x[None]) ** 2 + (y[i : i + 512, None] - y[None]) ** 2
            far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
            some.append((np.repeat(at[i : i + 512], m), at[np.argpartition(far, m - 1, axis=1)[:, :m]].ravel()))
    return tuple(np.concatenate(c) for c in zip(*some)) if some else (np.zeros(0, np.int64),) * 2


def _keys(own: DataFrame, k: int) -> DataFrame:
    """(rep, n, key) of images (rep, n, payload): for each table the entries of a corner and of one of its k neighbours, together.

    Plain patches agree in single entries by chance, the more the more images there are; two neighbours rarely do.
    The lesser entry comes first: two corners that are neighbours of each other say the same twice.
    """
    table = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = []
                for load in part.column(2).to_pylist():
                    row = np.frombuffer(load, CORNER)
                    c, d = neighbours(row, k)
                    a, b = row["bits"][c], row["bits"][d]
                    with np.errstate(over="ignore"):
                        both = (np.minimum(a, b).astype(np.uint64) << np.uint64(32) | np.maximum(a, b)) + table
                    keys.append(np.unique(common.mix64(both)).view(np.int64))
                many = [len(x) for x in keys]
                reps, n = (np.repeat(part.column(c).to_numpy(), many) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(n), pa.array(np.concatenate(keys))], names=["rep", "n", "key"])

    return own.mapInArrow(work, "rep long, n long, key long")


def _linked(inliers: int, votes: int, bits: int):
    """Verifies blocks of images: pairs with ``votes`` common entries of which ``inliers`` corners agree, until all are joined that can be."""

    def verify(blocks):
        from .neardup import overlaps

        for is_left, is_right, loads in blocks:
            rows = [np.frombuffer(x, CORNER) for x in loads]
            keys = [entries(r["bits"]) for r in rows]
            left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
            if not len(left) or not len(right):
                yield left[:0], right[:0]
                continue
            shared = overlaps([keys[i] for i in left], [keys[j] for j in right])
            i, j = np.nonzero(shared >= votes)
            p, q, n = left[i], right[j], shared[i, j]
            # A pair with both ends on both sides comes twice.
            both = np.array(is_left) & np.array(is_right)
            some = (p != q) & ((p < q) | ~(both[p] & both[q]))
            p, q, n = p[some], q[some], n[some]
            order = np.argsort(-n, kind="stable")
            parent, found = list(range(len(rows))), []

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(p[order].tolist(), q[order].tolist()):
                a, b = root(x), root(y)
                if a != b and agree(rows[x]["place"], rows[x]["bits"], rows[y]["place"], rows[y]["bits"], bits) >= inliers:
                    parent[max(a, b)] = min(a, b)
                    found.append((x, y))
            yield tuple(np.array(found, np.int64).reshape(-1, 2).T)

    return verify


def copies(images: DataFrame, corners: int = 32, inliers: int = 8, least: int = 6, votes: int = 2, bits: int = 20, near: int = 3, **options) -> DataFrame:
    """image_id, n_corners, component_id of every row of ``images`` (image_id, content).

    least: corners that an image needs to be searched; equal pixels need none. votes: table entries that a pair must share.
    bits: tests of 128 that may differ in matched corners. near: neighbours with which a corner makes its keys.
    """
    found = common.written(features(images, corners), "image-features")
    reps = found.where(F.col("pixels").isNotNull() & F.col("image_id").isNotNull()).groupBy("pixels").agg(F.min("image_id").alias("rep"))
    reps = common.written(reps, "image-classes")
    own = found.join(reps.select(F.col("rep").alias("image_id"), F.col("pixels").alias("p")), "image_id").where((F.col("pixels") == F.col("p")) & (F.col("n") >= least))
    own = common.written(own.select(F.col("image_id").alias("rep"), "n", F.col("corners").alias("payload")), "image-own")
    keyed = buckets.distinct_buckets(common.written(_keys(own, near), "image-keys"))
    comp = buckets.components_of(keyed, own.select("rep", "payload"), _linked(inliers, votes, bits), bytes_of_n=CORNER.itemsize, **options)
    out = found.select("image_id", "n", "pixels").join(reps, "pixels", "left")
    out = out.join(comp.withColumnRenamed("id", "rep"), "rep", "left") if comp is not None else out.withColumn("component", F.col("rep"))
    return out.select("image_id", F.col("n").alias("n_corners"), F.coalesce("component", "rep", "image_id").alias("component_id"))


def mosaics(vectors: DataFrame, id_column: str, column: str, cell: int = 6) -> DataFrame:
    """image_id, content: each vector drawn as a square of cells, one component a cell, as binary PGM. Null vectors: null content."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if not v:
                    out.append(None)
                    continue
                x = np.nan_to_num(np.array([0.0 if e is None else e for e in v]), nan=0.0, posinf=0.0, neginf=0.0)
                top = np.abs(x).max() or 1.0
                x = x / top
                x = 127.5 + 127.5 * x / (np.sqrt((x * x).mean()) * 2.5 or 1.0)
                side = int(np.ceil(np.sqrt(len(x))))
                tiles = np.full(side * side, 127.5)
                tiles[: len(x)] = x
                gray = np.clip(np.rint(tiles), 0, 255).astype(np.uint8).reshape(side, side).repeat(cell, 0).repeat(cell, 1)
                out.append(b"P5 %d %d 255\n" % gray.shape[::-1] + gray.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "content"])

    return vectors.select(F.col(id_column).cast("long").alias("image_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(work, "image_id long, content binary")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so every row of ``embeddings`` is drawn as one, as ``media`` bytes; all are compared."""
    pictures = mosaics(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return copies(pictures).select(F.col("image_id").alias("vec_id"), "n_corners", "component_id", F.coalesce(F.col("image_id") == F.col("component_id"), F.lit(False)).alias("kept"))
