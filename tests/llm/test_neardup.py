"""Near-duplicates of texts (9), vectors (5) and images (8) against brute force over all pairs."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import common, images, multiindex, neardup


def union(n, links):
    p = {i: i for i in n}

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    both = defaultdict(int)
    for ids in by.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                both[a, b] += 1
    return sets, union(sets, [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)])


def test_op9_equals_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").collect()]
    sets, comp = brute(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op9_minmax_hash(spark, sf_dir).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i, _ in rows}


def test_chains_big_groups_and_common_words(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    rows, base = [], word(80)
    for i in range(300):  # a drifting chain: neighbours are alike, ends are not
        base = base[1:] + word(1) if i % 4 == 0 else base
        rows.append((i, " ".join(base)))
    other = word(60)
    rows += [(1000 + i, " ".join(other[: 58 + i % 3] + (["tail"] if i % 7 == 0 else []))) for i in range(200)]
    rows += [(2000 + i, "the of and to " * 30 + " ".join(word(3))) for i in range(50)] + [(3000, "a"), (3001, "A"), (3002, "a b"), (3003, "a  B\n")]
    for k in (4, 5):
        sets, comp = brute(rows, k)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
        assert got == {i: (len(sets[i]), comp[i]) for i, _ in rows}


def test_odd_documents_and_deduplication(spark, odd, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.classes(odd, 5).collect())
    assert len(got) == odd.count()
    assert ("10", 11, "9") in got and got.count(("9", 11, "9")) == 2 and ("5", 0, "5") in got and ("3", 0, "3") in got
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in (5, 4, 3, None, None, 7, 8, 9, 2**62, -3))
    assert neardup.classes(none, 4).count() == neardup.deduplicate(none).count() == 0


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    s = neardup.signature_rows([np.unique(x[:1000]), np.unique(x[200:])], 2000)
    same = s[0] == s[1]
    assert abs(same.mean() - 800 / 1200) < 0.03 and abs(same[:2000].mean() - same[2000:].mean()) < 0.05


def vectors_brute(rows, least=0.93):
    use = [(i, np.array(v, float), str(c)) for i, v, c in rows if c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, *_ in use]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in use])
    c = np.array([c for *_, c in use])
    hit = (x @ x.T >= least) & (c[:, None] == c[None])
    np.fill_diagonal(hit, False)
    n = dict.fromkeys([i for i, *_ in rows], 0) | dict(zip(ids, hit.sum(1).tolist()))
    comp = union([i for i, *_ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit)) if a < b])
    return n, comp, hit.sum() // 2


def test_op5_links(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in common.table(spark, sf_dir, "embeddings").collect()]
    n, comp, _ = vectors_brute(rows)
    got = {r.vec_id: r for r in multiindex.op5_multi_index(spark, sf_dir).collect()}
    assert got.keys() == n.keys()
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.component_id == comp[i] for i, r in got.items()) >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_and_precision_of_links_near_the_bound(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal((150, 32))
    x = np.concatenate([c + rng.standard_normal(c.shape) * s for s in (0, 0.1, 0.2, 0.28, 0.3, 0.35)]).astype(np.float32)
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in enumerate(x)]
    n, _, links = vectors_brute(rows)
    got = multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=32, slice_rows=64).collect()
    assert links > 300 and sum(r.n_links for r in got) >= 0.95 * sum(n.values())
    assert all(r.n_links <= n[r.vec_id] for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [2.0, -0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x")).withColumn("x", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_duplicates(df).collect()}
    for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert got[8] == (2, 8, True) and got[9] == (2, 8, False) and got[10] == (2, 8, False)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n, many in ((8, 30), (16, 20), (1, 6)):
        for x in rng.standard_normal((many, n)):
            rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (x * 2 + rng.standard_normal(n) * 0.02 * (n > 1)).tolist(), 1)]
    want, comp = dict.fromkeys(range(len(rows)), 0), {}
    for k in (8, 16, 1):
        some = [r for r in rows if len(r[1]) == k]
        n, c, _ = vectors_brute(some)
        want, comp = want | n, comp | c
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (want[i], comp[i]) for i in want}


def picture(rng, n=96):
    x = np.full((n, n), 128.0)
    for _ in range(40):
        y0, x0 = rng.integers(0, n - 8, 2)
        h, w = rng.integers(5, 28, 2)
        x[y0 : y0 + h, x0 : x0 + w] = rng.integers(0, 256)
    return np.clip(x, 0, 255).astype(np.uint8)


def pgm(x):
    return b"P5 %d %d 255\n" % x.shape[::-1] + x.tobytes()


def test_cropped_turned_and_edited_copies(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(12):
        x = picture(rng)
        edits = [x, x[8:88, 10:92], np.clip(x * 0.8 + 20, 0, 255).astype(np.uint8), np.rot90(x), np.clip(x + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8)]
        marked = x.copy()
        marked[60:75, 5:50] = 255
        for i, e in enumerate([*edits, marked]):
            rows.append((g * 10 + i, pgm(np.ascontiguousarray(e))))
            want[g * 10 + i] = g * 10
    rows += [(500, None), (501, b""), (502, b"P5 junk"), (503, pgm(np.zeros((90, 90), np.uint8))), (504, pgm(np.zeros((90, 90), np.uint8))), (505, pgm(np.zeros((4, 4), np.uint8)))]
    df = spark.createDataFrame(rows, "image_id long, content binary").withColumn("rep", F.lit(1))
    got = {r.image_id: r.component_id for r in images.copies(df).collect()}
    right = sum(got[i] == c for i, c in want.items())
    assert right >= 0.9 * len(want)
    assert all(got[i] // 10 == i // 10 for i in want)  # no false link
    assert all(got[i] == i for i in (500, 501, 502, 503, 504, 505))
    assert images.copies(df.limit(0)).count() == 0


def test_equal_pictures_with_few_corners(spark):
    smooth = np.tile(np.linspace(0, 255, 90).astype(np.uint8), (90, 1))
    small = picture(np.random.default_rng(3), 16)
    rows = [(1, pgm(smooth)), (2, pgm(smooth)), (3, pgm(small)), (4, pgm(small)), (5, pgm(np.ascontiguousarray(smooth.T)))]
    got = {r.image_id: r.component_id for r in images.copies(spark.createDataFrame(rows, "image_id long, content binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_halves_and_crops_of_a_tenth(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(6):
        x = np.full((400, 400), 128, np.uint8)
        for _ in range(600):
            (y0, x0), (h, w) = rng.integers(0, 390, 2), rng.integers(6, 40, 2)
            x[y0 : y0 + h, x0 : x0 + w] = rng.integers(0, 256)
        half = np.rint(x.reshape(200, 2, 200, 2).mean((1, 3))).astype(np.uint8)
        for i, e in enumerate([x, x[37:163, 210:336], half]):
            rows.append((g * 10 + i, pgm(np.ascontiguousarray(e))))
            want[g * 10 + i] = g * 10
    got = {r.image_id: r.component_id for r in images.copies(spark.createDataFrame(rows, "image_id long, content binary")).collect()}
    assert got == want


def test_mutual_neighbours_make_one_key(spark):
    rng = np.random.default_rng(14)
    x = picture(rng)
    rows = []
    for e in (x, np.ascontiguousarray(x[8:88, 10:92])):
        places, bits = images.describe(e)
        rows.append(np.empty(len(places), images.CORNER))
        rows[-1]["place"], rows[-1]["bits"] = places, bits
    df = spark.createDataFrame([(i, len(r), r.tobytes()) for i, r in enumerate(rows)], "rep long, n long, payload binary")
    got = images._keys(df, 3).collect()
    ordered = [{(t, int(r["bits"][c, t]), int(r["bits"][d, t])) for c, d in zip(*images.neighbours(r, 3)) for t in range(images.TABLES)} for r in rows]
    either = [{(t, min(a, b), max(a, b)) for t, a, b in pairs} for pairs in ordered]
    keys = [{r.key for r in got if r.rep == i} for i in (0, 1)]
    assert all(len(e) < len(o) for e, o in zip(either, ordered))
    assert len(got) == sum(map(len, either)) and [len(k) for k in keys] == [len(e) for e in either]
    assert len(keys[0] & keys[1]) == len(either[0] & either[1]) > 0  # whatever two pictures share is still a shared key
    assert {(t, min(a, b), max(a, b)) for t, a, b in ordered[0] & ordered[1]} <= either[0] & either[1]


def test_png_filters():
    import struct
    import zlib

    x = picture(np.random.default_rng(2), 24)
    raw, up = b"", np.zeros(24, np.int32)
    for y, line in enumerate(x.astype(np.int32)):
        left = np.concatenate(([0], line[:-1]))
        corner = np.concatenate(([0], up[:-1]))
        p = left + up - corner
        paeth = [min((abs(a - q), 0, a), (abs(b - q), 1, b), (abs(c - q), 2, c))[2] for a, b, c, q in zip(left.tolist(), up.tolist(), corner.tolist(), p.tolist())]
        kind = y % 5
        raw += bytes([kind]) + ((line - [0, left, up, (left + up) // 2, np.array(paeth)][kind]) & 255).astype(np.uint8).tobytes()
        up = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 24, 24, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (images.decode(png) == x).all() and (images.decode(pgm(x)) == x).all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(50)] + [(None, 1), (7, 7), (300, 301), (301, 300)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, **dict.fromkeys(range(200, 250), 100), 300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_damaged_pictures_are_unreadable(spark):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = lambda colour: chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, colour, 0, 0, 0))
    body, end = chunk(b"IDAT", zlib.compress(b"\0\1\2\3\4" * 4)), chunk(b"IEND", b"")
    magic = b"\x89PNG\r\n\x1a\n"
    assert images.decode(magic + head(0) + body + end).shape == (4, 4)
    for bad in (magic, magic + body + end, magic + head(3) + body + end, magic + head(0) + end, magic + head(7) + body, magic + head(0)[:20], b"P5 4", b"P5 4 4 255\n\0", b"GIF89a"):
        assert images.decode(bad) is None
    rows = [(i, bytes(x)) for i, x in enumerate((magic, magic + body + end, magic + head(3) + body + end))]
    got = images.copies(spark.createDataFrame(rows, "image_id long, content binary")).collect()
    assert sorted((r.image_id, r.n_corners, r.component_id) for r in got) == [(i, 0, i) for i in range(3)]


def test_big_buckets_take_centres_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(120):  # near copies at many similarities, so that much of the group stays outside its main component
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 8)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    sets, comp = brute(rows, 4)
    assert 3 < len(set(comp.values())) < 115
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, big=12, block=10, weight=400, rounds=2).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i, _ in rows}
