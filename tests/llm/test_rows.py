"""HTML (2), URLs (3), secrets (4), mixing (7) and toxicity (10) against brute force or held-out labels."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import common, htmltext, mixing, secret_scan, toxicity, urlrules


def page(body, host="a.example.net", i=0):
    return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html_blocks_without_furniture():
    text = lambda h: " ".join(b[2] for b in htmltext._content(htmltext.blocks(h)))
    shell = "<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class='cookie-banner'><p>We use cookies</p></div>{}<aside>More</aside><footer>(c)</footer><script>var p='<p>no</p>';</script>"
    assert text(page(shell.format("<article><h1>Title &amp; more</h1><p>One  two\nthree<p>caf&eacute; &#8364;<b>bold</b>face</article>"))) == "Title & more One two three café €boldface"
    assert text(page(shell.format("<main><p>x</p><form><input value='q'>Send</form><section id='comments'><p>Great!</p></section><p>y</p></main>"))) == "x y"
    assert text(None) == text("") == ""
    assert text("<article><p>never closed <b>at all") == "never closed at all"
    assert text("<article><p>a<!-- hidden --> b</p><p hidden>no</p></article>") == "a b"


def test_templates_are_deduced_from_pages_of_a_host(spark):
    rows = [(i, f"http://h.example.net/{i}", f"<html><body><div>Welcome to us</div><div>story {i} tells of {i * 7}</div><div>All rights</div></body></html>") for i in range(12)]
    rows += [(100, None, None), (101, "nohost", ""), (102, "http://h.example.net/0", rows[0][2]), (103, "http://one.example.net/", "<p>single &lt;page&gt;</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {**{i: f"story {i} tells of {i * 7}" for i in range(12)}, 100: "", 101: "", 102: "story 0 tells of 0", 103: "single <page>"}
    assert htmltext.extract(df.limit(0)).count() == 0


def test_op2_returns_every_page(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    rows = htmltext.op2_template_extraction(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) and "<" not in r.text for r in rows)
    assert sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)


def test_furniture_inside_articles():
    def text(html):
        return " ".join(b[2] for b in htmltext._content(htmltext.blocks(html)))

    keep = "<p>One.</p>%s<p>Two.</p>"
    for bad in (
        "<ol class='commentlist'><li>x</li></ol>", "<ul><li class='ad'><div>x</div></li></ul>", "<table><tr class='advert'><td>x</td></tr></table>", "<div class='adBanner'>x</div>",
        "<p><span class='ad'>x <span>y</span> z</span></p>", "<a class='ad'><div>x</div></a>", "<span class=ad>x", "<div hidden>x</div>", "<ul><li class=ad>x<li class=ad>y</ul>", "<form>x</form>", "<nav><p>x</nav>",
    ):
        assert text(f"<article>{keep % bad}</article>") == "One. Two.", bad
    assert text("<article>" + keep % "<div class='share-prices'><p>Up.</p></div>" + "</article>") == "One. Up. Two."
    assert text("<article><p title=it's>Is</p><p data-x='a>b'>it</p><p id=\"q'\">'so'?</article>") == "Is it 'so'?"
    assert text("<article>foo<span class=ad>x</span>bar <b>b</b>az</article>") == "foobar baz"
    assert text("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><dl><dt>h<dd>i</dl></article>") == "a b c d e f g h i"
    assert text("<article><p>a<p>b<div>c</div></article><footer>x</footer>") == "a b c"
    assert text("<article><a href=/x/>a</a> b<br/>c</article>") == "a b c"


def judged(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for verdict, h, p in urlrules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_op3_list(spark, sf_dir):
    urls = {r.page_id: r.url for r in common.table(spark, sf_dir, "pages").collect()}
    rows = urlrules.op3_url_rules(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_mined_rules_follow_the_labels_and_odd_urls(spark):
    rows = [(i, f"https://s{i}.spam.example.net/win/{i}") for i in range(60)] + [(100 + i, f"https://s{i}.news.example.net/en/{i}") for i in range(60)] + [(200, "https://t.spam.org/win/5"), (201, "https://x.news.org/en/1")]
    odd = [(300, None), (301, ""), (302, "no scheme"), (303, "://"), (304, "HTTP://EXAMPLE.NET"), (305, "http://Example.Net/en/?q#f"), (306, "http://xnet/"), (307, "a://b?c://d/e"), (308, "http://net/"), (None, "http://net/"), (309, "http://e\n.net/a\nb?c")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("verdict", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert got[200][3] == "block" and got[201][3] == "allow"
    for i, u in odd:
        host, path, rule, verdict = judged(u)
        assert got[i][:3] == (host, path, rule) and got[i][3] == (verdict or "allow"), u
    assert urlrules.judge(df.limit(0)).count() == 0


BASE = {"assign": (r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def base(text):
    found = []
    for n, (kind, (p, g, least)) in enumerate(BASE.items()):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def sha(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


def test_op4_base_spans(spark, sf_dir):
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    rows = secret_scan.op4_secret_automaton(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert r.base_sha256 == sha(b) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, *_ in b) for x in BASE]
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{s}:{e}" for k, s, e in b}


def test_secrets_of_odd_documents_and_redaction(spark, odd, none):
    tricky = ["PaSSword'  :  \"abc", "api_key=abcdef apiKEY: 'a.b/c+d=e-f_g'", "\u017fecret=abcdefg To\u212aEN=abcdef", "é😀token=zzzzzz AKIA" + "A1" * 9, "0123456789abcdef" * 3 + "G" + "f" * 24 + "\n" + "F" * 30, "token = token = abcdefgh", "tokentoken=abcdef", "secret\n=abcdef secret==abcdef secret=abcde", "AKIA" * 6, "password=" + "x" * 5000]
    rng = np.random.default_rng(5)
    bits = ["token", "=", ":", " ", "'", "abcdef", "AKIA", "Q" * 16, "0a1b" * 6, "é", "secret", "\n", "x", "-----BEGIN RSA PRIVATE KEY-----", "://u:pass@h"]
    tricky += ["".join(rng.choice(bits, 12)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in secret_scan.scan(df).collect():
        b = base(tricky[r.doc_id])
        assert [(x.kind, x.start, x.end) for x in r.found if x.kind in BASE] == b, tricky[r.doc_id]
    assert secret_scan.scan(odd).count() == odd.count()
    clean = secret_scan.redact(odd)
    assert clean.columns == odd.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[8] == "[assign]' and [access]" and texts[5] is None and texts[4] == ""
    assert secret_scan.scan(none).count() == secret_scan.redact(none).count() == 0


ADDED = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url_login": r"[a-z][a-z0-9+.-]+://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$*+=-]{3,}@",
    "prefixed_key": r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]{16,}",
}


def test_automaton_spans_equal_those_of_re():
    """Small rules of every construct over random texts, and the registered rules over pieces of secrets, long ones too."""
    patterns = ["ab*c", "(?i)x(yz|y)+1", "[0-9]{3}", "a[a-z]?b", "q{2,4}r", "é".encode().hex(), "z+"]
    small = secret_scan.compile_rules(tuple(secret_scan.Rule(str(i), "", p) for i, p in enumerate(patterns)))
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcxyzXYZ019qré"), 60)) for _ in range(300)]
    got = small.spans([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert got.get(i, []) == sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t)), t
    data = np.frombuffer(secret_scan.GAP.join(t.encode() for t in texts), np.uint8)[::-1]
    at, masks = small.starts.scan(data, lane=7)
    assert list(zip(at.tolist(), masks.tolist())) == small.starts.run(data.tobytes())
    assert len(secret_scan._minimise(small.starts.table, small.starts.class_of, small.starts.fires).fires) == len(small.starts.fires)
    bits = ["token", "=", ":", " ", "'", "abcdef", "AKIA", "Q" * 16, "0a1b" * 6, "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "PRIVATE KEY", "https://", "u:pass@", "v" * 300 + ":" + "w" * 500 + "@", "eyJ", "abcdefgh.", "ghp_", "sk_live_", "x" * 20, "://", "@", "-"]
    texts = ["".join(rng.choice(bits, 14)) for _ in range(1500)] + ["://" + "a" * 9000, "a" * 9000 + "@", "h" * 3000 + "://" + "u" * 5000 + ":" + "p" * 5000 + "@"]
    got = secret_scan.compile_rules().spans([t.encode() for t in texts])
    kinds = [r.kind for r in secret_scan.RULES]
    for i, t in enumerate(texts):
        want = [(s, kinds.index(k), e) for k, s, e in base(t)] + [(m.start(), kinds.index(k), m.end()) for k, p in ADDED.items() for m in re.finditer(p, t)]
        assert got.get(i, []) == sorted(want), t[:200]


def goals(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    want, fixed = total * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = want - sum(fixed.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: most * sizes[s] for s in over}


def test_op7_targets_and_copies(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    want = goals(total)
    rows = mixing.op7_systematic_mix(spark, sf_dir).collect()
    assert rows and {r.doc_id for r in rows} == size.keys()
    taken = dict.fromkeys(total, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max([size[d] for d in size if source[d] == s]) + 1
    again = mixing.op7_systematic_mix(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_water_level(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50}, {"a": 1000, None: 10}, {"a": 0, "b": 0}, {"a": 5, "b": 5, "c": 5, "d": 5000, None: 7}, {"": 4, None: 4}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        for s, v in goals(sizes).items():
            assert abs(got[s] - v) < 1e-6


def test_mix_of_odd_documents(spark, odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    counts = {(r.doc_id, r.text): r.n_rows for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n_rows")).collect()}
    assert counts and max(counts.values()) <= 4
    assert mixing.mix(none).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = toxicity.score(docs, toxicity.fit(docs, train)).join(test, "doc_id").collect()
    truth, said = np.array([r.toxic for r in got]), np.array([r.rejected for r in got])
    assert truth.sum() > 5
    assert said[truth == 1].mean() >= 0.8 and said[truth == 0].mean() <= 0.02
    severity = np.array([r.severity for r in got])
    assert severity[truth == 1].mean() > severity[truth == 0].mean() + 0.5


def test_grades_share_weights_over_ordered_thresholds():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for i in range(1500):
        g = int(rng.integers(0, 4)) if i % 3 == 0 else 0
        rows.append(sorted({*rng.integers(1000, 1_000_000, 25).tolist(), *rng.choice(30, 4 * g, replace=False).tolist()}))
        grades.append(g)
    m = toxicity.fit_rows(rows, np.array(grades))
    assert len(m.thresholds) == 3 and m.thresholds == sorted(m.thresholds) and set(m.weights) <= set(range(30)) and len(m.weights) > 20
    z = np.array([sum(m.weights.get(s, 0) for s in r) for r in rows])
    expected = m.chances(z).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_toxicity_of_odd_documents(spark, odd, none, sf_dir):
    labels = spark.createDataFrame([(9, None, 1), (7, None, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r.severity <= 2 for r in rows)
    assert not any(r.rejected for r in rows if r.doc_id in (3, 4, 5))
    kept = toxicity.keep_clean(odd, m)
    assert kept.columns == odd.columns
    assert toxicity.score(none, m).count() == toxicity.keep_clean(none, m).count() == 0
    empty = toxicity.fit(odd, labels.limit(0))
    assert toxicity.keep_clean(odd, empty).count() == odd.count()
    assert toxicity.fit(none, labels).thresholds == []


def test_one_frequent_value_is_no_template(spark):
    rows = [(i, f"http://v.example.net/{i}", f"<div>Welcome to us</div><p>{'Yes' if i % 3 else 'No'}</p><p>story {i}</p><div>All rights</div>") for i in range(12)]
    moved = [f"<div>Top</div>{'<p>Moves</p>' if i % 2 else ''}<p>story {i}</p><div>Middle</div><div>Next</div>{'' if i % 2 else '<p>Moves</p>'}<p>more {i}</p><div>End</div>" for i in range(12)]
    rows += [(100 + i, f"http://m.example.net/{i}", h) for i, h in enumerate(moved)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{'Yes' if i % 3 else 'No'} story {i}" for i in range(12))
    assert all("Moves" in got[100 + i] and "Top" not in got[100 + i] and "End" not in got[100 + i] for i in range(12))


def test_layout_names_drop_no_article():
    text = lambda h: " ".join(b[2] for b in htmltext._content(htmltext.blocks(h)))
    for name in ("site has-sidebar", "with-header", "page-with-sidebar", "widget", "sidebar", "site-header"):
        assert text(f"<div class='{name}'><p>x</p><article><p>one</p></article></div>") == "one", name
    assert text("<form id='aspnetForm'><main><p>one</p></main></form>") == text("<a class='related'><article><p>one</p></article></a>") == "one"
    assert text("<article><div class='side-by-side'><p>a</p></div><section id='related-work'><p>b</p></section><div class='post-comments'><article><p>no</p></article></div></article>") == "a b"
    assert text("<article><p>a</p></article><div class='related-box'><article><p>teaser</p></article></div>") == "a"
    assert text("<div hidden><article><p>no</p></article></div><p>b</p>") == "b"
    assert text("<div class='mainNav sidebar-left'><p>no</p></div><div class='cookie-bar'><p>no</p></div><p class=ad>no</p><p>b</p>") == "b"


def test_mined_rules_may_need_four_tokens(spark):
    four = ["h:a", "p:x", "p:y", "p:z"]
    sets = [(four, "block")] * 20 + [([t for t in four if t != out], "allow") for out in four] * 20
    rules = urlrules.mine(spark.createDataFrame(sets, "tokens array<string>, verdict string")).collect()
    assert [(r.tokens, r.verdict) for r in rules if r.verdict == "block"] == [(four, "block")]
