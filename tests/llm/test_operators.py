"""Each operator on small tables against brute force, with nulls, empty texts, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termweave.llm import html, licenses, mixing, neardup, packing, quality, suffixes, toxicity, urls, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, t string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(5)]
    texts = [None, "", " ", "a", "x " * 300, "*" * 50]
    for b in base:
        w = b.split()
        w[30] = "changed"
        texts += [b, b, " ".join(w), "\n".join([b, "one line", "one line"])]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 150))) for _ in range(20)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "é", "a", "z"][i % 4], "clash", len(t or "")) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_counts(spark, docs):
    for i, r in rows(quality.rule_statistics(docs)).items():
        t = corpus()[i] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want


def test_forest_isolates_what_leaves_the_range():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (400, 3)), rng.normal(9, 1, (40, 3))
    x, y = np.vstack([good, bad]), np.repeat([True, False], [400, 40])
    forest, limit = quality.calibrate(x, y, np.zeros(440, bool), 0.98)
    odd = forest.score(x) >= limit
    assert odd[400:].mean() > 0.95 and odd[:400].mean() < 0.05


def test_few_labels_still_reject_what_was_not_seen():
    """Half of about 200 labelled rows fit the forest, the other half is judged; bad rows are of several kinds."""
    rng = np.random.default_rng(4)
    rejected, kept = [], []
    for seed in range(6):
        good = np.abs(rng.normal(0, 0.3, (200, 7)))
        bad = np.abs(rng.normal(0, 0.3, (20, 7)))
        bad[np.arange(20), np.arange(20) % 5] += 3
        x, y = np.vstack([good, bad]), np.repeat([True, False], [200, 20])
        half = np.random.default_rng(seed).permutation(220)
        a, b = half[:110], half[110:]
        forest, limit = quality.calibrate(x[a], y[a], np.zeros(110, bool), 0.99)
        odd = forest.score(x[b]) >= limit
        rejected.append(odd[~y[b]].mean())
        kept.append(1 - odd[y[b]].mean())
    assert np.mean(rejected) > 0.8 and min(rejected) > 0.4 and np.mean(kept) > 0.95


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    cache, whole = packing.WordCache(*files), Tokenizer.from_file(files[1])
    rng = random.Random(3)
    texts = ["", None, " a", "a\n\nb", "don't  we'll", "<|endoftext|> x", "a\u0085b", "a\x00b"] + corpus()
    texts += ["".join(rng.choice("ab '\n\t 1.,é日!") for _ in range(rng.randrange(30))) for _ in range(500)]
    ids, ends = cache.encode(pa.array(texts, pa.string()))
    begin = 0
    for t, end in zip(texts, ends):
        assert ids[begin:end].tolist() == whole.encode(t or "", add_special_tokens=False).ids
        begin = end


def test_tokens_of_batches_with_white_space_at_the_ends():
    """Every pair of texts with leading and trailing white space, in both orders, by a cache that knows no word yet."""
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    whole = Tokenizer.from_file(files[1])
    cache = packing.WordCache(*files)
    edges = ["", " ", "\n", "\n\n", " \n", "\n ", "\t"]
    texts = [f"{a}x{i}{b}y{m}{c}" for i, a in enumerate(edges) for m, c in enumerate(edges) for b in (" ", "\n")]
    want = {t: whole.encode(t, add_special_tokens=False).ids for t in texts}
    rng = random.Random(4)
    batches = [["x\nfoo y", "\nfoo bar"], ["\nfoo bar", "x\nfoo y"], *([a, b] for a in texts[::3] for b in texts[::5]), texts, texts[::-1], rng.sample(texts, len(texts))]
    for batch in batches:
        cache.clear()
        ids, ends = cache.encode(pa.array(batch, pa.string()))
        begin = 0
        for t, end in zip(batch, ends.tolist(), strict=True):
            assert ids[begin:end].tolist() == (want.get(t) or whole.encode(t, add_special_tokens=False).ids), t
            begin = end


def test_packing_is_gapless_and_no_worse_than_best_fit(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_files()[1])
    got = packing.pack(docs, capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    room = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = [k for k, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(64 - n)
    assert len(by) <= len(room)
    for i, t in enumerate(corpus()):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)


def test_signatures_estimate_the_weighted_similarity():
    a, b = np.arange(60, dtype=np.uint64), np.arange(30, 90, dtype=np.uint64)
    wa, wb = np.full(60, 7), np.full(60, 3)
    sig = neardup.bag_minhash(np.concatenate([a, b]), np.repeat([0, 1], 60), np.concatenate([wa, wb]), 2, 4000)
    want = 30 * 3 / (30 * 7 + 30 * 7 + 30 * 3)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_large_groups_of_near_copies_lose_no_link(spark):
    """A passage that all texts share, and one group with edits of every share: classes equal brute force."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    base, passage = rng.choices(words, k=120), rng.choices(words, k=40)
    texts = [" ".join(base)] + [" ".join(rng.choice(words) if rng.random() < share else w for w in base) for share in (0.01, 0.02, 0.03, 0.05, 0.1, 0.3) for _ in range(20)]
    texts += [" ".join(rng.choices(words, k=rng.randint(5, 60)) + passage + rng.choices(words, k=20)) for _ in range(60)]
    texts += [" ".join(base[:k]) for k in range(60, 120, 3)]
    bags = [Counter(neardup.shingles(pa.array([t]))[0].tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if neardup._overlap(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = rows(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(root))


def test_near_duplicate_classes(docs):
    texts = corpus()
    bags = [Counter(neardup.shingles(pa.array([t], pa.string()))[0].tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and neardup._overlap(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = rows(neardup.near_duplicates(docs))
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(root))
    assert {i for i, r in got.items() if r.kept} == set(root)


def test_url_rules_and_globs(spark):
    cases = [("http://A.org/x", "allow", "org/"), ("http://w.example.org/es/1", "block", "example.org/es/"), ("http://x.com/de/1", "block", "com/de/"), ("http://casino.net/a", "block", None), ("http://b.net/a", "allow", None), ("no scheme", "allow", None), (None, "allow", None), ("http://org", "allow", None)]
    got = rows(urls.filter_urls(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string")), "page_id")
    assert [(got[i].verdict, got[i].rule) for i in range(len(cases))] == [(v, r) for _, v, r in cases]
    from fnmatch import fnmatchcase

    rng = random.Random(2)
    globs = tuple("".join(rng.choice("ab*?") for _ in range(rng.randint(1, 9))) for _ in range(60))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    from termweave.llm.common import raw

    found = urls.ShiftAnd(globs).matches(*raw(pa.array(texts)))
    assert found.tolist() == [next((k for k, g in enumerate(globs) if fnmatchcase(t, g)), -1) for t in texts]


def test_mixing_meets_its_targets(docs):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in got:
        assert r.size == len(WORD.findall(corpus()[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert mine[0].source_size == sizes[source] and abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert mixing.fill_targets([10, 10, 10], [5, 2, 1], 45).tolist() == pytest.approx([20, 50 / 3, 25 / 3])


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(4)
    for _ in range(100):
        votes, seats = [rng.randint(1, 500) for _ in range(rng.randint(1, 8))], rng.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[k] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want


def test_html_main_text():
    page = '<html><head><title>t</title></head><body><nav>m</nav><div class="ad">x</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three</p><div class="comments"><p>no</p></div></article><footer>f</footer>'
    assert html.main_text(page, "article") == "A & B\none two\nthree" and html.main_text("") == ""
    w = html.merge(html.skeleton("<article><h1>a</h1><p>b</p></article>"), html.skeleton("<article><p>b</p><p>c</p></article>"))
    assert html.expression(w) == "<article>(<h1>=</>)?(<p>#</>)+</>"


def test_html_by_host(spark):
    def page(body, box="div class=story"):
        return f"<body><nav><a href=x>menu item</a></nav><{box}><p>{body}</p><p>more of {body}</p></{box.split()[0]}><div class=sidebar><p>aside</p></div><footer>end</footer>"

    cases = [(i, f"http://a.org/{i}", page(f"story {i} " * 20)) for i in range(12)]
    cases += [(12, None, None), (13, "http://b.org", ""), (14, "odd", "plain text"), (14, "odd", "plain text"), (None, "http://c.org/", "<article><p>one</p>two &lt; three</article>"), (15, "http://b.org/x", page("é" * 50_000, "article"))]
    df = spark.createDataFrame([(*c, "clash", "clash") for c in cases], "page_id long, url string, html string, host string, article string")
    got = {(r.page_id, r.url): r.text for r in html.extract(df).collect()}
    for i in range(12):
        body = ("story %d " % i * 20).strip()
        assert got[i, f"http://a.org/{i}"] == f"{body}\nmore of {body}"
    assert got[12, None] == got[13, "http://b.org"] == "" and got[14, "odd"] == "plain text" and got[None, "http://c.org/"] == "one\ntwo < three"
    assert len(got[15, "http://b.org/x"]) == 100_009 and html.extract(df).count() == len(cases)
    assert html.extract(df.limit(0)).count() == 0


def test_articles_within_boxes_with_noisy_names():
    body = "<article><p>one</p><p class='no-comment'>two</p><table class=search><tr><td>three</td></tr></table><div class=ad>buy</div><p>four</p></article>"
    want = "one\ntwo\nthree\nfour"
    for page in (f"<form id=aspnetForm>{body}</form>", f"<div class='layout has-sidebar'>{body}</div>", f"<div class='header-fixed'>{body}<nav>menu</nav></div>", f"<div id=sidebar-layout><aside>x</aside>{body}</div>", body):
        key = html.article_key(html.skeleton(page))
        assert key == "article" and html.main_text(page, key) == want == html.main_text(page)
    page = "<div class='header-fixed'><main><p>text</p><div class='comments'><p>bad</p></div></main></div>"
    assert html.main_text(page, html.article_key(html.skeleton(page))) == "text"


def test_the_wrapper_tells_template_from_text(spark):
    """A box with the same text on all pages goes; headings, slots and what only some pages share stay."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)]
    pages, want = [], {}
    for k in range(30):
        host = k % 2
        paragraphs = [" ".join(rng.choices(names, k=8)) for _ in range(rng.randint(1, 4))]
        lead = " ".join(rng.choices(names, k=5))
        pages.append((k, f"http://h{host}.org/{k}", f"<body><nav>m</nav><article><h1 class=t>Title</h1><div class=lead>{lead}</div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class=box>Read more with us</div></article></body>"))
        want[k] = "\n".join(["Title", lead, *paragraphs])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    same = spark.createDataFrame([(k, "http://x.org/", pages[0][2]) for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(same).collect()} == {want[0] + "\nRead more with us"}


def test_alignment_of_long_pages_is_not_quadratic():
    import time

    def page(n, k):
        return "<article>" + "".join(f"<h2>a{i}</h2><p class=c{i % (k + 2)}>b{i}</p>" for i in range(n)) + "</article>"

    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        w = html.merge(html.skeleton(page(n, 1)), html.skeleton(page(n + 7, 2)))
        took.append(time.perf_counter() - began)
        assert html.article_key(w) == "article"
    assert took[1] < 10 * took[0] + 1


def test_html_of_deep_pages(spark):
    def page(k, depth, tag="div"):
        return f"<body><section>tagline</section>{'<div>' * depth}<{tag} class=story><p>story {k}</p><p>more</p></{tag.split()[0]}>{'</div>' * (depth % 2 * depth)}"

    for depth in (61, 200, 6000):  # closed and unclosed ones, also deeper than Python's calls
        w = html.merge(html.skeleton(page(1, depth)), html.skeleton(page(2, depth)))
        assert html.article_key(w) == "div.story" and html.expression(w).count("<div>") == depth
        assert html.packed(html.unpacked(html.packed(w))) == html.packed(w)
    cases = [(k, f"http://{depth}.org/{k}", page(k, depth, tag)) for depth, tag in ((61, "article"), (75, "div"), (3000, "div")) for k in range(4)]
    df = spark.createDataFrame(cases, "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == len(cases) and all(r.text == f"story {r.page_id}\nmore" for r in got)


def covered(tokens, n, wanted):
    """Which places the windows of n tokens with a wanted key cover."""
    cover = bytearray(len(tokens))
    for i in range(len(tokens) - n + 1):
        if wanted(i):
            cover[i : i + n] = b"\1" * n
    return cover


@pytest.mark.parametrize("n, m, seed", [(40, 7, None), (24, 3, 5)])
def test_repeats_equal_brute_force(spark, docs, n, m, seed):
    strings = corpus()
    if seed:  # few letters, periods and partly changed copies: many segments of a name
        rng = random.Random(seed)
        base = ["".join(rng.choices("ab \né", (5, 5, 3, 1, 1), k=150)) for _ in range(4)] + ["ab " * 60]
        strings = [b[rng.randrange(40) :][: rng.randint(1, 150)] + rng.choice("xyz") + rng.choice(base)[rng.randrange(100) :] for b in base for _ in range(9)]
        docs = spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")
    texts = [(t or "").encode() for t in strings]
    spans = [[(x.start(), x.end()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in texts]
    count = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    passages = Counter(b[w[i][0] : w[i + m - 1][1]] for b, w in zip(texts, spans) for i in range(len(w) - m + 1))
    got = rows(suffixes.remove_repeats(docs, n, m))
    for k, (b, w) in enumerate(zip(texts, spans)):
        cover = covered(b, n, lambda i: count[b[i : i + n]] > 1)
        runs = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        left = hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()
        words = sum(covered(w, m, lambda i: passages[b[w[i][0] : w[i + m - 1][1]]] > 1))
        assert tuple(got[k])[1:] == (len(b), sum(cover), runs, left, words)


def test_licences_in_bulk(spark):
    """Base columns of many texts by a search word by word."""
    rng = random.Random(12)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC", "word", "é", "x1"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "1 "]) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "cc by " * 20_000, "cc by"]
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    table = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by"), (3, texts[3])]
    got = licenses.licenses(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert len(got) == len(table)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for i, t in table:
        w = [x.lower() if x.isascii() else x.translate({k: k + 32 for k in range(65, 91)}) for x in word.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))]
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        want[i] = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id] for r in got)


def test_license_scan():
    a = licenses.automaton()
    assert licenses.scan("Licensed under CC BY-NC 4.0. All rights\nreserved", a)[:4] == (2, 2, 7, {"cc-by", "reserved"})
    assert licenses.scan("// SPDX-License-Identifier: MIT OR Apache-2.0", a)[4:] == ({"mit", "apache"}, 0.1)
    two = "spdx-license-identifier: MIT " + "x " * 500 + "SPDX-License-Identifier: (" + "ISC AND " * 200 + "GPL-3.0)\nBSD"
    assert licenses.scan(two, a)[4:] == ({"mit", "isc", "gpl"}, 0.5)
    assert licenses.evaluate("(MIT AND GPL-2.0 WITH x) OR CC0-1.0")[1] == 0.05
    assert licenses.evaluate("MIT AND (")[0] == {"mit"} and licenses.scan("", a)[0] == 0


def test_toxic_clauses():
    machine = toxicity.grammar(*toxicity.Model().classes())

    def count(t):
        got = Counter(label for label, _ in toxicity.clauses(t, machine))
        return [got[k] for k in toxicity.LABELS]

    assert count("You idiot.") == [0, 1, 0, 0, 0] and count("not an idiot here") == [0, 0, 0, 1, 0]
    assert count("he said idiot") [4] + count("he said idiot")[1] == 1 and count("I will kill you.")[0] == 1 and count("") == [0] * 5


def test_composed_machine_equals_its_parts_one_after_the_other():
    """Every clause's label and weight by whole passes over its tokens, and the score of a document from them."""
    model = toxicity.Model(stems=("zzq",))
    known, stems = model.classes()
    weights = dict(zip(toxicity.LABELS, model.weights))
    rng = random.Random(8)
    pool = ["idiot", "zzqab", "kill", "you", "not", "said", "\"", "word", "other", "idiots"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(1, 12))) + rng.choice(".!\n") + " ".join(rng.choices(pool, k=3)) for _ in range(300)]
    for t in texts:
        want = []
        for clause in re.split(r"[.!?;:\n]+", t):
            kinds = ["reported" if x == '"' else "insult" if x.startswith("zzq") else known.get(x, "") for x in re.findall(r"\w+|\"", clause)]
            near = lambda k, mark, reach: mark in kinds[max(0, k - reach) : k]  # noqa: E731, B023
            found = {}
            for k, kind in enumerate(kinds):
                if kind == "insult":
                    label = "negated" if near(k, "negation", 3) else "reported" if near(k, "reported", 12) else "aimed" if near(k, "target", 4) else "insult"
                    found[label] = weights[label]
                elif kind == "target" and near(k, "threat", 3):
                    found["threat"] = weights["threat"]
            best = [k for k in toxicity.LABELS if k in found]
            want += [(best[0], found[best[0]])] if best else []
        got = list(toxicity.clauses(t, toxicity.grammar(known, stems, model.weights)))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    counts = toxicity._matched(pa.RecordBatch.from_pydict({"text": pa.array(texts)}), model)
    assert np.allclose(model.score(counts)[0], 1 / (1 + np.exp(-(model.bias + sum(w * np.log1p(c) for w, c in zip(model.weights, counts[0]))))))


def test_toxicity_learns_its_lexicon(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    table, labels = [(900, None, "c"), (901, "", "c")], []
    for i in range(300):
        w = rng.choices(words, k=40)
        if i % 5 == 0:
            w[rng.randrange(40)] = "zzq" + rng.choice("abcdefgh") * 4
            w[rng.randrange(40)] = "vvrude"
        table.append((i, " ".join(w), "c"))
        labels.append((i, int(i % 5 == 0)))
    got = rows(toxicity.toxicity(spark.createDataFrame(table, "doc_id long, text string, toxic string").drop("toxic"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[900].score == got[901].score < 0.5


def test_toxicity_keeps_seeds_that_labels_do_not_speak_against(spark):
    table = [(i, f"zzq{'ab' if i % 2 else 'ba'} you" if i % 4 == 0 else "what trash is here", "c") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(table, "doc_id long, text string, lang string"), labels)
    assert "moron" in model.words and "trash" not in model.words


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 8))
    x = [(base[i % 20] + rng.normal(size=8) * 0.2).tolist() for i in range(200)]
    table = [(i, v, i % 3) for i, v in enumerate(x)] + [(200, x[0], 0), (201, x[0], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (205, [None] * 8, 0)]
    got = rows(vectors.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")), "vec_id")
    v = np.array([*x, x[0]])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([i % 3 for i in range(200)] + [0])
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(201, dtype=bool)
    comp = np.arange(201)
    for _ in range(201):
        comp = np.array([min(comp[i], comp[link[i]].min()) if link[i].any() else comp[i] for i in range(201)])
    assert [got[i].n_links for i in range(201)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(201)] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(201, 206))


def test_block_pairs_equal_all_pairs_of_boxes(spark):
    """The tree of boxes gives just the pairs of intervals that are near on every axis."""
    rng = np.random.default_rng(5)
    low = {(g, b): rng.uniform(-1, 1, vectors.AXES) for g in (0, 1) for b in range(70 if g else 3)}
    rows_ = [(g, 8, (b * 7) + (g << 32), low[g, b].tolist(), (low[g, b] + 0.4).tolist()) for g, b in low]
    got = {(r.ba, r.bb) for r in vectors.block_pairs(spark.createDataFrame(rows_, "g int, d int, block long, low array<double>, high array<double>"), 0.3).collect()}
    want = {(x[2], y[2]) for x in rows_ for y in rows_ if x[0] == y[0] and x[2] <= y[2] and all(a - 0.3 <= d and c - 0.3 <= b for a, b, c, d in zip(x[3], x[4], y[3], y[4]))}
    assert got == want


def test_vectors_of_many_links_in_small_blocks(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    x = centres[np.arange(300) % 6] + rng.normal(size=(300, 8)) * 0.1
    df = spark.createDataFrame([(i, 0, 8, 1, v.tolist()) for i, v in enumerate(x)], "id long, g int, d int, w long, embedding array<double>").select("g", "d", "id", "w", "embedding")
    n = {r.id: r.n for r in vectors.links(df, 0.93, 16).groupBy("id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(1) - 1
    assert want.sum() > 5000 and [n.get(i, 0) for i in range(300)] == want.tolist()


def test_empty_and_odd_tables_of_the_other_operators(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    long = "http://a.com/" + "x" * 300_000
    pages = spark.createDataFrame([(1, long, 5), (1, long, 5), (None, None, 5)], "page_id long, url string, verdict long")
    assert sorted(r.host for r in urls.filter_urls(pages).collect()) == ["", "a.com", "a.com"]
    v = [1.0, 0.0, 0.5]
    table = [(1, v, 0, 9), (1, v, 0, 9), (2, v, 0, 9), (None, v, 0, 9)]
    got = vectors.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, g int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None")]
    judged = quality.quality(spark.createDataFrame([(None, "a b", 1), (4, "c", 1), (4, "c", 1)], "doc_id long, text string, good int"), spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, text int"))
    assert judged.count() == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (neardup.near_duplicates(none), suffixes.remove_repeats(none), licenses.licenses(none), mixing.mix_sources(none), packing.pack(none)):
        assert df.count() == 0
