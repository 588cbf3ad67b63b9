"""The pipeline's stages, each on its own input, against plain versions; and the registered queries of scores and pictures."""

import re
import zlib
from collections import Counter

import numpy as np
from test_neardup import brute, union
from test_rows import ADDED, base, goals
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import common, images, secret_scan, tokens, toxicity


def plain_redaction(text):
    if text is None:
        return None
    kinds = [r.kind for r in secret_scan.RULES]
    found = [(s, kinds.index(k), e, k) for k, s, e in base(text)] + [(m.start(), kinds.index(k), m.end(), k) for k, p in ADDED.items() for m in re.finditer(p, text)]
    out, done = [], 0
    for s, _, e, kind in sorted(found):
        if s >= done:
            out += [text[done:s], f"[{kind}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def test_every_stage_of_the_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.written(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            z = np.array([sum(model.weights.get(s, 0.0) for s in toxicity.doc_slots((r.text or "").encode(), model.bits)) for r in before])
            bad = (model.chances(z)[:, 0] >= 0.5) & (z > 0) if model.thresholds else z > 0
            assert sorted(r.doc_id for r in out[name]) == sorted(r.doc_id for r, b in zip(before, bad) if not b)
        if name == "near_duplicates":
            _, comp = brute([(r.doc_id, r.text) for r in before], 5)
            assert sorted(r.doc_id for r in out[name]) == sorted(i for i, c in comp.items() if i == c)
        if name == "secrets":
            assert {r.doc_id: r.text for r in out[name]} == {r.doc_id: plain_redaction(r.text) for r in before}
        if name == "mixing":
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
            of = {r.doc_id: r.source for r in before}
            sizes, taken = Counter(), Counter()
            for i, n in size.items():
                sizes[of[i]] += n
            times = Counter(r.doc_id for r in out[name])
            for i, n in times.items():
                taken[of[i]] += n * size[i]
            want = goals(dict(sizes))
            assert max(times.values()) <= 2 and all(abs(taken[s] - t) <= 2 * max(size[i] for i in size if of[i] == s) for s, t in want.items())
    lib = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in out["mixing"]}
    want = Counter()
    for i, n in Counter(r.doc_id for r in out["mixing"]).items():
        want[i] = n * len(ids[i])
    got = Counter()
    for r in out["packing"]:
        got[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert got == want


def test_pipeline_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_op10_scores_of_words_at_a_time(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.op10_toxicity_ordinal(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z = sum(model.weights.get(s, 0.0) for s in toxicity.doc_slots((texts[r.doc_id] or "").encode(), model.bits))
        p = model.chances(np.array([z]))[0] if model.thresholds else np.zeros(1)
        assert abs(r.severity - p.sum()) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.rejected == (p[0] >= 0.5 and z > 0)


def test_word_scorer_on_odd_bytes():
    rng = np.random.default_rng(2)
    bits = ["bad", "Worse", "it's", "a-b", "'", "-", "--", " ", "\n", "é", "中", "x" * 90, "9", "_", "\x00"]
    texts = [None, b"", *("".join(rng.choice(bits, 12)).encode() for _ in range(600))]
    slots = {s for t in texts for s in toxicity.doc_slots(t, 16)}
    model = toxicity.Model(16, [0.5], {s: float(w) for s, w in zip(sorted(slots), rng.normal(size=len(slots))) if w > 0})
    got = toxicity._Scorer(model, most=50)(texts)
    want = [sum(model.weights.get(s, 0.0) for s in toxicity.doc_slots(t, 16)) for t in texts]
    assert np.allclose(got, want)


def test_op8_links_of_the_table(spark, sf_dir):
    """All pairs of the drawn embeddings against the query's components."""
    pictures = images.mosaics(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding").collect()
    found = {r.image_id: images.describe(images.decode(r.content)) for r in pictures}
    ids = sorted(found)[:220]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if images.agree(*found[a], *found[b]) >= 8]
    comp = union(ids, links)
    got = {r.vec_id: r for r in images.op8_image_copies(spark, sf_dir).collect()}
    assert got.keys() == found.keys() and all(r.n_corners == len(found[i][0]) for i, r in got.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert sum((got[a].component_id == got[b].component_id) for a, b in links) >= 0.9 * len(links)
    assert sum(comp[i] == i for i in ids) <= sum(got[i].component_id == i for i in ids) + 0.1 * len(ids)
