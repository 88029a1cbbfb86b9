"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeated rows and clashing columns."""

import functools
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brooklet.llm import op1_site_style, op2_records, op3_cover_tree, op4_packing, op5_toxicity, op6_decontamination, op7_token_counts, op8_secrets, op9_language, op10_jaccard
from brooklet.llm.chunks import ChunkEncoder, encoder
from brooklet.llm.common import components

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a   b", "a\n b", "x <|endoftext|> y", "don't  '", "　b c\xa0 d", "é ́b", "12 345", "中文 😀 ok", None, "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 7, 1) for i, t in enumerate(ODD)] + [(3, "a   b", None, None, 7, 1), (None, "no id here", "en", "s", 7, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, start long")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_of_plain_words(path, monkeypatch):
    """New words of ASCII letters are learned by the short path alone, those with marks after it beside it; both as the library."""
    random.seed(2)
    words = ["".join(random.choices("abcdeinorstABT", k=random.choice([1, 3, 8, 60]))) for _ in range(2000)]
    texts = [" " + " ".join(words), " " + " ".join(w + m for w, m in zip(words, random.choices(["", ",", ".", "...", "?!", ")", "-"], k=2000), strict=True))]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = ChunkEncoder(path, 1 << 18)  # drops chunks and learns them again
    with monkeypatch.context() as m:
        m.setattr(enc.cache, "make", lambda w: 1 / 0)
        assert np.frombuffer(enc.encode(texts[:1])[0], dtype="<u4").tolist() == want[0]
    enc.forget()
    monkeypatch.setattr(enc, "bpe", lambda w: 1 / 0)
    enc.tails.make = enc.tails.plain = ChunkEncoder(path).bpe
    assert np.frombuffer(enc.encode(texts[1:])[0], dtype="<u4").tolist() == want[1]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_over_line_ends(path):
    """Marks and a line end between letters of all kinds, beside chunks that must not be cut there."""
    random.seed(1)
    parts = ["ab", "É", ".\n", "\n", "a.\nB", "é,\nÖl!", "A?!\n\nb", "a\nb", "a.\r\nb", "it's.\nIt", "İ.\nb", "a.\nİ", "a.\n.b", "a. \nb", "ſ.\nK", "3.\nb", "b.\n3", "ß-\nss"]
    texts = [" ".join(random.choices(parts, k=6)) for _ in range(1000)]
    lib = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder(path).encode(texts)] == [x.ids for x in lib]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_learned_once(path, monkeypatch):
    """A word comes to the model once for all texts of a call, whatever marks and line ends stand beside it, even where no cache holds it."""
    random.seed(3)
    words = sorted({"".join(random.choices("abcdeinorst", k=9)) for _ in range(300)})
    texts = ["".join(random.choice(" \n") + w + random.choice(["", ",", "...", ")"]) for w in random.sample(words, len(words))) for _ in range(20)]
    enc, calls = ChunkEncoder(path, 0), Counter()
    plain = enc.cache.plain
    monkeypatch.setattr(enc.cache, "plain", lambda w: calls.update([w]) or plain(w))
    lib = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in enc.encode(texts)] == [x.ids for x in lib]
    assert max(calls.values()) == 1 and {w.lstrip() for w in calls} == set(words)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cuts_beside_odd_characters(path):
    """Where texts are cut changes no id, whatever character stands there, nor do the texts beside in the same call."""
    odd = [chr(c) for c in [*range(0x600), 0x1680, 0x180E, *range(0x2000, 0x2070), *range(0x3000, 0x3010)]]
    texts = [x.format(c) for c in odd for x in ("a.\n{0}b", "x{0}.y", "x {0}y", "x{0} y", "-{0}é\n-z", "\n{0}\nq", "q{0}{0}", " {0} a", "<|endoftext|>{0}\n\n<|endoftext|> {0}")]
    lib = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder(path).encode(texts)] == [x.ids for x in lib]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).distinct().collect())
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_op1(spark):
    html = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav>Menu</nav><div class='x1'>Same note</div><article><h1>Head&amp;line</h1><p>One <b>bo</b>ld<p>two&nbsp;\n three<br>four</p><div class='comments'>me</div></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.b/1", html), (2, "http://a.b/2", None), (3, None, ""), (3, "http://a.b/1", html), (4, "x", "plain < text & more"), (5, "x", "<p>cut <a href='")]
    plain = [(10 + i, "http://c.d/x", f"<div class=w><p>Always the same words</p></div><div><p>story {i} {i * 7}</p><p>more {i}</p></div>") for i in range(12)]
    df = spark.createDataFrame([(*r, 0) for r in rows + plain], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in op1_site_style.extract(df).collect()]
    text = dict((i, t) for i, t, _ in got)
    assert text[1] == "Head&line One bold two three four" and text[2] == ""
    assert sorted(t for i, t, _ in got if i == 3) == ["", text[1]]
    assert text[4] == "plain < text & more" and text[5] == "cut"
    assert text[13] == "story 3 21 more 3"  # what the host repeats is gone
    assert len(got) == 18 and all(n == len(t) for _, t, n in got)
    forced = op1_site_style.extract(df, broadcast_rows=-1)
    assert sorted((r.page_id, r.text) for r in forced.collect()) == sorted((i, t) for i, t, _ in got)
    assert op1_site_style.extract(df.limit(0)).count() == 0


def test_op2(spark, odd, docs, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    both = odd.select("doc_id", "text", "start").unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text", "1L AS start"))
    got = op2_records.token_records(both, BYTE).orderBy("start").collect()
    rows = both.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert op2_records.token_records(odd.limit(0), BYTE).count() == 0
    folder = f"file://{tmp_path}"
    part = op2_records.write_records(docs, BYTE, folder).orderBy("part").first()
    first = op2_records.fetch(folder, part.file, [2, 0])
    assert all(x[-1] == 0 for x in first)
    name = next(tmp_path.glob("*.rec"))
    name.write_bytes(name.read_bytes()[:-2] + b"xx")
    with pytest.raises(op2_records.DamagedRecord):
        read = name.open("rb").read
        while op2_records.unframe(read) is not None:
            pass


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<body class="no-sidebar"><article><p>Real text</p></article></body>', "Real text"),
        ('<article><p title="the hidden gem">Real text</p></article>', "Real text"),
        ('<article><section class="side-effects">Real text</section></article>', "Real text"),
        ('<div class="wp ad-hoc">Real text</div>', "Real text"),
        ('<div class="widget"><p>before</p><article>Real text<div class="share-buttons">x</div></article><p>after</p></div>', "Real text"),
        ('<div class="post-comments">no</div><p>Real text</p><div id="site-footer">no</div><div class=header>no</div>', "Real text"),
        ('<main>Real text<ol class="comment-list"><li><article class="comment">no</article></ol></main>', "Real text"),
        ('<div id=comments><article class="comment">no</article></div><p>Real text</p>', "Real text"),
        ("<nav>no</nav><p>Real &lt;text&gt;</p><form>no</form><aside>no</aside><dialog>no</dialog>", "Real <text>"),
    ],
)
def test_op1_markup(html, want):
    assert op1_site_style.main_text(html) == want


def test_op1_entropy_by_brute_force(spark):
    rng = random.Random(3)
    pages = []
    for i in range(40):
        host = f"h{i % 3}.net"
        menu = "".join(f"<li>{w}</li>" for w in (["home", "news", "about"] if i % 3 else rng.sample(["a", "b", "c", "d", "e", "f", "g"], 3)))
        note = rng.choice(["one note"] * 6 + ["other note"])
        inner = f"<p>{rng.random()}</p>" * rng.randint(1, 3)
        pages.append((i, f"http://{host}/{i}", f"<div class=m><ul>{menu}</ul></div><div class=n>{note}</div><div class=w>{inner}</div>" if i % 5 else f"<div class=m><ul>{menu}</ul></div><table><tr><td>{rng.random()}</table>"))
    pages += [(90 + i, *pages[1][1:]) for i in range(9)]  # copies count once
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.element for r in op1_site_style.low_elements(df).collect()}
    by: dict = {}
    for _, url, html in dict.fromkeys(p[1:] and (0, *p[1:]) for p in pages):
        for path, kind, feature in op1_site_style.features(op1_site_style.Page(html, whole=True)):
            by.setdefault((op1_site_style.host_of(url), path), {}).setdefault(kind, []).append(feature)
    want = set()
    for (host, path), kinds in by.items():
        m = len(kinds[0])
        if m >= 5:
            style = -sum(c / m * np.log(c / m) for c in Counter(kinds[0]).values()) / np.log(m)
            counts = list(Counter(kinds[1]).values())
            content = 1 - np.average([-sum(1 / c * np.log(1 / c) for _ in range(c)) / np.log(m) for c in counts], weights=counts)
            if max(style, content) < 0.3:
                want.add(op1_site_style._element(host, path))
    assert got == want and len(want) >= 4
    text = {r.page_id: r.text for r in op1_site_style.extract(df).collect()}
    assert "home" not in text[1] and "note" not in text[1] and "0." in text[1]  # host without telling tags


def test_op1_whole_pages(spark):
    """Every page of the generated table: its article, word for word; its menus are in the tree."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert pages.select("url", "html").mapInArrow(op1_site_style._features, "host long, element long, kind int, feature long, page long").count() > 10 * pages.count()
    got = {r.page_id: r.text for r in op1_site_style.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<(?:/?b)>", "", article).replace("<", " <")).split()) or got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split()), r.page_id
    long = "<div><p>" + "word " * 400_000 + "</p></div>"
    odd = spark.createDataFrame([(None, None, long), (None, "http://x.y", long), (1, "", "")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in op1_site_style.extract(odd).collect()) == [0, 1_999_999, 1_999_999]


def test_op1_hosts_joined(spark):
    # The join by host finds the same hosts as the broadcast: schemes and hosts in any case.
    schemes = ["http://c.d", "HTTP://c.d", "Https://C.D", "hTTp://u@c.D:80"]
    rows = [(i, f"{schemes[i % 4]}/x", f"<div class=w><p>Always the same words</p></div><div><p>story {i}</p></div>") for i in range(12)]
    df = spark.createDataFrame([*rows, (12, None, "<p>alone</p>")], "page_id long, url string, html string")
    for most in (200_000, -1):
        got = {r.page_id: r.text for r in op1_site_style.extract(df, broadcast_rows=most).collect()}
        assert got == {i: f"story {i}" for i in range(12)} | {12: "alone"}, most


@pytest.mark.parametrize("attrs", ['href="/hidden-gems"', 'title="the hidden cost"', 'href="/view?id=comment-12"', 'data-id="menu"', "data-role='search'", "href=/x?role=search", 'alt="class=nav"', 'data-x = "a" title=\'style="display:none"\'', "aria-hidden=false", "hiddenx", 'title="a"data-hidden'])
def test_op1_other_attributes(attrs):
    for tag in ("a", "p", "section"):
        assert op1_site_style.main_text(f"<article><p>one</p><{tag} {attrs}>two</{tag}></article>") == "one two", tag


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'class = "x nav"', "id=menu", 'title="a"role="search"', "style='color:red; display: none'", 'href="/a" aria-hidden=true', "data-id=x/ hidden"])
def test_op1_own_attributes(attrs):
    assert op1_site_style.main_text(f"<article><p>one</p><section {attrs}>two</section></article>") == "one"


def _links_by_brute_force(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    label = np.arange(len(x))
    while not np.array_equal(label, new := np.array([label[link[i]].min() for i in range(len(x))])):
        label = new
    return link.sum(1) - 1, label


@pytest.mark.parametrize("block", [40, 4096])
def test_op3(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.05, base[:1] + rng.normal(size=(60, 16)) * 0.2, base[:5]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 0), (906, [], 0)]
    rows += [(None, rows[0][1], 0), (907, rows[3][1], 0), (907, rows[3][1], 0), (None, None, 0)]
    got = {}
    for r in op3_cover_tree.threshold_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int"), block=block).collect():
        got.setdefault(r.vec_id, []).append(r)
    x = np.concatenate([x, x[:1], x[3:4], x[3:4]])
    links, label = _links_by_brute_force(x)
    n = len(x) - 3
    assert [got[i][0].n_links for i in range(n)] == links[:n].tolist()
    assert [got[i][0].component_id for i in range(n)] == label[:n].tolist()
    assert all(got[i][0].n_links == 0 and got[i][0].kept for i in (900, 901, 902, 903, 906))
    assert (got[904][0].n_links, got[905][0].component_id, got[905][0].kept) == (1, 904, False)
    assert [(r.n_links, r.component_id, r.kept) for r in got[907]] == [(links[n + 1], label[n + 1], False)] * 2
    assert sorted((r.n_links, r.component_id, r.kept) for r in got[None] if r.n_links) == [(links[n], label[n], False)] and len(got[None]) == 2


def test_op3_empty_and_float(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op3_cover_tree.threshold_links(empty).count() == 0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 300)).astype(np.float32)
    x = np.concatenate([x, x[:9] * 7])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(99, [1e30, 1e30], 0), (98, [1e-30, 1e-30], 0)]
    got = {r.vec_id: r for r in op3_cover_tree.threshold_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links, label = _links_by_brute_force(x.astype(float))
    assert [got[i].n_links for i in range(len(x))] == links.tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()
    assert (got[99].n_links, got[99].component_id) == (1, 98)


def test_op3_threshold_is_exact():
    """Pairs 1e-10 to either side of the threshold, alone and inside dense nodes."""
    rng = np.random.default_rng(7)
    rows, want = [], []
    for k in range(200):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        o = rng.normal(size=64)
        o -= (o @ a) * a
        o /= np.linalg.norm(o)
        c = 0.95 + (1e-10 if k % 2 else -1e-10)
        rows += [a, a + rng.normal(size=64) * 1e-9 if k % 3 == 0 else rng.normal(size=64), c * a + np.sqrt(1 - c * c) * o]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = op3_cover_tree.Tree(x, np.sqrt(0.1))
    links, _, label, _ = op3_cover_tree.joined(tree, tree, True, np.ones(len(x)), np.ones(len(x)), 0.95)
    want = (tree.x @ tree.x.T >= 0.95).sum(1)
    assert np.array_equal(np.rint(links), want)


def test_op3_prunes_node_pairs():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 64)), 100, 0) + rng.normal(size=(3000, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = op3_cover_tree.Tree(x, np.sqrt(0.1))
    ones = np.ones(len(x))
    links, _, _, work = op3_cover_tree.joined(tree, tree, True, ones, ones, 0.95)
    assert np.array_equal(np.rint(links), (tree.x @ tree.x.T >= 0.95).sum(1))
    assert work < 0.05 * len(x) ** 2
    for (start, centre, cover) in tree.levels:  # nested, and covers hold
        assert start[0] == 0 and start[-1] == len(x)
        for k in rng.integers(0, len(centre), 20):
            own = tree.x[start[k] : start[k + 1]]
            assert start[k] <= centre[k] < start[k + 1] and np.linalg.norm(own - tree.x[centre[k]], axis=1).max() <= cover[k] + op3_cover_tree.slack(64)


def test_op4(spark, odd, docs):
    lib = Tokenizer.from_file(WORD)
    both = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "start").unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text", "1L AS start"))
    got = op4_packing.pack(both, WORD, with_ids=True).collect()
    text = dict(both.select("doc_id", "text").collect())
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in rows), dtype="<u4").tolist()
        assert ids == [*lib.encode(text[d] or "", add_special_tokens=False).ids, 1] and rows[0].doc_tokens == len(ids)
        assert [r.start for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
    assert set(by_doc) == set(text)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        assert sum(r.length for r in rows) <= 2048
    assert sum(r.length for r in got) > 0.97 * 2048 * len(by_seq)
    odd_ids = sorted((r.doc_id or -1, r.doc_tokens) for r in op4_packing.pack(odd, WORD).where("start = 0").collect())
    assert odd_ids == sorted((-1 if r.doc_id is None else r.doc_id or -1, len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    assert op4_packing.pack(odd.limit(0), WORD).count() == 0
    random.seed(1)
    for _ in range(30):
        h = Counter(random.choice([random.randint(1, 100), 7]) for _ in range(200))
        assert sum((Counter({x: c * p.count(x) for x in set(p)}) for p, c in op4_packing.shortest_pack_first(h, 100)), Counter()) == h


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_op5(spark, docs):
    terms = ["stupid", "trash", "abcde*", "scum"]
    scorer = op5_toxicity.Scorer(terms)
    random.seed(2)
    for _ in range(4000):
        t = random.choice(terms).rstrip("*")
        w = list(t + random.choice(["", "x", "yz"]))
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = random.choice(["", "q", "s", "tt"])
            w = list("".join(w)) or ["a"]
        w = "".join(w)
        most, want = op5_toxicity.allowed(w), []
        for t in terms:
            row = _levenshtein(t.rstrip("*"), w)
            d = min(row) if t.endswith("*") else row[-1]
            if d <= (most if len(t.rstrip("*")) >= 5 else 0):
                want.append((d, -len(t), t))
        got = scorer.look(w)
        assert (got or None) == ((min(want)[2], min(want)[0]) if want else None), w
    quoted = [q for *_, q in scorer.hits('he said "you are stupid trash" then. You all here are really and truly plain stupid')]
    assert quoted == [True, True, False]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = op5_toxicity.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels)
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x", 3)], "doc_id long, text string, score int")
    rows = op5_toxicity.score(odd, model).collect()
    assert len(rows) == 3 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in rows)
    held = op5_toxicity.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), model).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in held)
    assert hit > 0.97 * len(held)
    assert op5_toxicity.score(odd, op5_toxicity.train(docs.limit(0), labels.limit(0))).count() == 3


def test_op5_weights(spark):
    # 400,000 clean documents and 2,000 toxic ones without a hit: the score is their rate, whatever the number of rows.
    quiet = spark.range(402_000).select(F.col("id").alias("doc_id"), F.lit("quiet words").alias("text"))
    loud = spark.createDataFrame([(500_000 + i, f"one{i} scumbag two{i}") for i in range(60)], "doc_id long, text string")
    docs = quiet.unionByName(loud)
    model = op5_toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") >= 400_000).cast("int").alias("toxic")))
    test = spark.createDataFrame([(1, "quiet words"), (2, "a scumbag here")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in op5_toxicity.score(test, model).collect()}
    assert abs(got[1] - 2000 / 402_000) < 0.0005 and got[2] > 0.3
    x, y, n = np.array([[1.0, 0, 0], [1.0, 0, 0], [1.0, 1, 0.7], [1.0, 1, 0.7]]), np.array([0.0, 1, 0, 1]), np.array([3500.0, 23, 2, 475])
    assert np.allclose(op5_toxicity._logistic(x, y, n, n.sum()), op5_toxicity._logistic(x, y, n * 10**6, n.sum()))


def test_op6(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    filler = "nothing of that kind is in here at all and so it goes on and on for quite a while " * 20
    rows = [(i, f"{filler} {r.text} {filler}") for i, r in enumerate(items)] + [(500, filler), (501, None), (502, ""), (None, items[3].text), (0, f"{filler} {items[0].text}")]
    got = op6_decontamination.contaminated(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, r.item_id) for i, r in enumerate(items)} | {(None, items[3].item_id)}
    assert not {500, 501, 502} & {r.doc_id for r in got}
    blocks = op6_decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_rows=15).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == {(r.doc_id, r.item_id) for r in got}
    made = [(r.item_id, *op6_decontamination.parts_of(r.text)) for r in items]
    b = op6_decontamination.Benchmark(made)
    random.seed(4)
    vocabulary = [w for m in made for w in (*m[1], *m[2])]
    for index in b.indexes:  # WAND against all scores
        for _ in range(60):
            words = random.sample(vocabulary, 40) + random.choice(index.items)[1][:12]
            terms = {b.terms[w] for w in words}
            for k, block in enumerate(index.blocks):
                total = Counter()
                for t in terms:
                    for i, v in zip(*block.get(t, ([], [], 0))[:2], strict=True):
                        total[i] += v
                want = sorted((i, round(v, 9)) for i, v in total.items() if v >= 0.2)
                assert sorted((i, round(v, 9)) for i, v in index.search(k, list(terms), 0.2)) == want
    assert op6_decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert op6_decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_op6_blocks(spark):
    # Scores are of the whole benchmark, however many blocks it is held in.
    random.seed(6)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "is"] * 20
    items = [(i, " ".join(random.choice(words) for _ in range(random.randint(8, 40))) + ". " + " ".join(random.choice(words) for _ in range(5))) for i in range(60)] + [(60, ""), (None, "a b c d e f g. h i j k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = [(i, " ".join(t.split()[random.randint(0, 3) :]) + " " + " ".join(random.choice(words) for _ in range(50))) for i, t in items]
    docs = spark.createDataFrame(cut, "doc_id long, text string")

    def found(rows):
        got = op6_decontamination.contaminated(docs, bench, least=0.6, block_rows=rows).collect()
        return sorted((r.doc_id is None, r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in got)

    one = found(1000)
    assert len(one) >= 40 and found(20) == one and found(5) == one


def test_caches_are_bounded(spark):
    """Texts without spaces and many different words leave bounded caches, and the same results."""
    from brooklet.llm.common import Cache

    c = Cache(10_000, 50)
    for i in range(2000):
        assert c.keep(f"w{i}", i) == i and c.keep("x" * 60 + str(i), i) == i
        assert c.used <= 10_000 and len(c) < 100
    lib = Tokenizer.from_file(BYTE)
    text = "".join(random.Random(1).choice("abcdef0123456789") for _ in range(200_000)) + " tail" * 5
    assert len(encoder(BYTE).whole(text)) // 4 == op7_token_counts.counter(BYTE).count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    assert encoder(BYTE).encode([text])[0] == encoder(BYTE).whole(text) and max(map(len, encoder(BYTE).cache)) <= 256
    small = op5_toxicity.Scorer(["stupid"], most_bytes=2000)
    many = " ".join(f"word{i} stupid" for i in range(500))
    assert len(small.hits(many)) == 500 and small.words.used <= 2000
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[(i * 37 + k) % 3000] for k in range(40)), f"l{i % 300:03d}") for i in range(900)]
    model = op9_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    label = op9_language.Labeller(model, most_bytes=100_000)
    assert len(label.names) > 250  # all languages that aren't held out whole
    whole = op9_language.Labeller(model)
    texts = [r[1] for r in rows[:50]] + ["é" * 300_000 + " w1 w2"]
    assert [label.predict(t) for t in texts] == [whole.predict(t) for t in texts]
    assert len(label.rows) < 3000
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op9_language.train(big)
    small, whole = op9_language.Labeller(model, most_bytes=50_000), op9_language.Labeller(model)
    texts = [r.text for r in big.select("text").limit(400).collect()]
    assert [small.predict(t) for t in texts] == [whole.predict(t) for t in reversed(texts)][::-1]


def test_op5_and_op9_repeats(spark):
    """A sampled id that very many rows have adds one text to the sample; nulls and clashing names are ignored."""
    rows = [(i, f"plain words number {i}", "en", i % 2) for i in range(40)] + [(1, f"copy {k} scumbag", "en", 1) for k in range(300)] + [(None, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = op5_toxicity.train(df, df.select("doc_id", "toxic"))
    assert op5_toxicity.score(df.select("*", F.lit(1).alias("score"), F.lit("").alias("held_out")), model).count() == len(rows)
    names = op9_language.Labeller(op9_language.train(df.withColumn("h", F.lit(1)))).names
    assert names == ["en"]
    got = op9_language.predict(df.select("*", F.lit(1).alias("score"), F.lit("").alias("lang_pred")), op9_language.train(df)).collect()
    assert len(got) == len(rows) and op9_language.predict(df.limit(0), op9_language.train(df)).count() == 0


def test_op6_odd_rows(spark):
    item = "what is the name of the tall tower in the old town by the river. it is called the round tower of stone"
    bench = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, item, 5), (2, None, 5), (3, "", 5)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, item), (1, item), (None, "filler " * 50_000 + item), (4, None), (5, "")], "doc_id long, text string").withColumn("item_id", F.lit(7))
    got = op6_decontamination.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got) == sorted([(1, 1)] * 4 + [(1, 0)] * 2 + [(0, 1)] * 2 + [(0, 0)])


def test_op7_and_chunks(odd, docs):
    for path in (BYTE, WORD):
        e = encoder(path)
        texts = [t or "" for t in ODD] + [r.text for r in docs.select("text").collect()]
        random.seed(6)
        texts += ["".join(random.choice(["a", " ", " ", "\n", "\t", "'s", "é", "1", ".", "%%", "<|endoftext|>", "中", "́", "\xa0", "the"]) for _ in range(random.randint(1, 14))) for _ in range(400)]
        assert e.encode(texts) == [e.whole(t) for t in texts]
        if path == BYTE:
            c = op7_token_counts.counter(path)
            assert [c.count(t) for t in texts] == [len(e.whole(t)) // 4 for t in texts]
    rows = op7_token_counts.token_counts(odd, BYTE).collect()
    assert len(rows) == odd.count()
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert op7_token_counts.token_counts(odd.limit(0), BYTE).count() == 0


def test_op8(spark):
    import hashlib
    import re

    kinds = [("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    texts = [
        None, "", "é😀 password=abcdef12 tail", "Token : 'abc' secret=token = abcdefgh", "AKIA" + "A1" * 8 + " AKIAAKIA12", "x " + "0f" * 20 + " y " + "ab" * 11,
        "API_KEY=\"" + "0a" * 16 + "\" apikey: zz", "secret=secret=secret=abc token=password=a1b2c3", "no secrets", "key Zk9fQx7LmN2pRt5VwYb8DcEg3HjKo4Aa end",
    ]
    rows = [(i, t, f"s{i}", 1) for i, t in enumerate(texts)] + [(2, texts[2], "s2", 1), (None, texts[4], None, 1)]
    rows += [(100 + i, "copied key Qa9fQx7LmN2pRt5VwYb8DcEg3HjKo4Bb example", f"o{i}", 1) for i in range(5)]
    got = op8_secrets.scan_report(spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        want = []
        for rank, (kind, pattern, group, least) in enumerate(kinds):
            want += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text[r.doc_id]) if len(m[group]) >= least]
        base = ",".join(x[2] for x in sorted(want))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text[r.doc_id], r.spans, base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert next(r.spans for r in got if r.doc_id == 9).startswith("opaque:4:")
    assert all(r.spans == "" for r in got if r.doc_id and r.doc_id >= 100)  # many owners: a copied example
    df = spark.createDataFrame(rows[:10], "doc_id long, text string, source string, n int")
    clean = df.join(op8_secrets.find_spans(df), "doc_id").select(op8_secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert "é😀 [REDACTED] tail" in {r.t for r in clean}


def test_op8_many_matches(spark):
    import re
    import time

    random.seed(4)
    runs = [random.choice(["0123456789abcdef" * 2, "é😀 password=abcdef1234567890abcdef1234567890", "plain words", "token: abcdef"]) + str(i) for i in range(100_000)]
    text = " ; ".join(runs)
    df = spark.createDataFrame([(1, text, "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r for r in op8_secrets.scan_report(df).collect()}
    assert got[1].n_hex == len(re.findall("[0-9a-f]{24,}", text)) and got[1].n_assign == sum(len(m[1]) >= 6 for m in re.finditer(r"(?:password|token)[:=]\x20*([A-Za-z0-9+/_.=-]+)", text))
    assert got[2].spans == got[3].spans == ""
    clean = df.join(op8_secrets.find_spans(df), "doc_id").where("doc_id = 1").select(op8_secrets.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    spans, want, at = got[1].spans.split(","), [], 0
    for start, stop in (map(int, x.split(":")[1:]) for x in spans):
        if start >= at:
            want += [text[at:start], "[REDACTED]"]
        at = max(at, stop)
    assert clean == "".join(want) + text[at:]
    assert time.time() - began < 120
    assert op8_secrets.scan_report(df.limit(0)).count() == 0


def test_op9(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op9_language.train(big)
    rows = op9_language.predict(big, model).where("held_out").join(big.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    got = op9_language.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 9, 11)) for r in got if r.doc_id is not None)
    label = op9_language.Labeller(model)
    texts = {r.lang: r.text for r in big.where("length(text) > 2000").select("lang", "text").collect()}
    a, b = sorted(texts)[:2]
    runs = label.spans(" ".join(texts[a].split()[:120]) + " " + " ".join(texts[b].split()[:120]))
    assert {x for x, n in runs if n > 60} == {a, b}
    rng = np.random.default_rng(0)
    for _ in range(40):  # Viterbi against all paths
        s = -rng.random((6, 3)) * 10
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - label.penalty * sum(x != y for x, y in itertools.pairwise(p)))
        score = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - label.penalty * sum(x != y for x, y in itertools.pairwise(p))
        assert abs(score(label.path(s)) - score(best)) < 1e-9
    nothing = op9_language.train(docs.limit(0))
    assert {r.lang_pred for r in op9_language.predict(odd, nothing).collect()} == {"und"}


def test_op9_short_spans(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    greek = ["καλημέρα σας και καλή όρεξη σε όλους τους φίλους μας εδώ"] * 40
    odd = spark.createDataFrame([(10**6 + i, t, "el") for i, t in enumerate(greek)], "doc_id long, text string, lang string")
    label = op9_language.Labeller(op9_language.train(big.unionByName(odd)))
    texts = {r.lang: r.text.split() for r in big.where("length(text) > 2000").orderBy("doc_id").collect()}
    a, b = sorted(texts)[:2]
    host = texts[a][:60]
    for k in (1, 2, 5):  # another script wins, however short
        assert label.spans(" ".join(host[:30] + greek[0].split()[:k] + host[30:])).count(("el", k)) == 1
    hit = 0
    for at in range(0, 200, 10):  # three words of the same script, inside and at an edge
        for text in (host[:30] + texts[b][at : at + 3] + host[30:], host + texts[b][at : at + 3]):
            hit += any(x == b and n >= 2 for x, n in label.spans(" ".join(text)))
    assert hit >= 30
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40, 200):  # the runs that are searched against Viterbi over all words
        for _ in range(60):
            k = int(rng.integers(2, 5))
            s = -rng.random((n, k)) * 12 * (rng.random((n, k)) < 0.6) - 6 * (np.arange(k) != (np.arange(n) // int(rng.integers(2, 12)) % k)[:, None]) * rng.random((n, 1))
            total = s[0]
            for r in s[1:]:
                total = np.maximum(total, total.max() - label.penalty) + r
            got = label.path(s)
            assert abs(s[np.arange(n), got].sum() - label.penalty * (np.diff(got) != 0).sum() - total.max()) < 1e-6


def _brute(rows):
    sets = [set(op10_jaccard.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), []).append(rows[i][0])
    return [(len(sets[i]), min(least[find(i)])) for i in range(len(rows))]


@pytest.mark.parametrize("most_members, hot_least", [(20_000, 16), (3, 16), (20_000, 1), (3, 2)])
def test_op10(spark, monkeypatch, most_members, hot_least):
    """hot_least 1 and 2: all keys are hot, and all that two sets have."""
    if hot_least < 16:
        for name, v in {"HOT_LEAST": hot_least, "HOT_SHARE": 0.0, "SAMPLE": 1}.items():
            monkeypatch.setattr(op10_jaccard, name, v)
    random.seed(8)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(random.choices(words, k=60))
    texts = ["", "  ", "One", "one", "two words", "a b c d e", "A B C D E f", "a b c d e f"]
    for _ in range(25):  # chains of near copies, some around a passage that many texts hold
        t = random.choices(words, k=random.choice([12, 40, 120, 400]))
        for _ in range(random.randint(1, 6)):
            t = list(t)
            for _ in range(max(1, len(t) // random.choice([40, 60, 120]))):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t) + (f" {shared}" if random.random() < 0.5 else ""))
    texts += random.choices(texts, k=10)
    rows = list(enumerate(texts))
    whole = op10_jaccard.class_links
    monkeypatch.setattr(op10_jaccard, "class_links", lambda d, c: whole(d, c, most_members=most_members, broadcast_rows=0))
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(5000, None, 0)], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_jaccard.jaccard_classes(df).collect()}
    assert got.pop(5000) == (0, 5000)
    assert [got[i] for i, _ in rows] == _brute(rows)
    assert op10_jaccard.jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_members", [40, 8_000])
def test_op10_copies_of_one_text(spark, monkeypatch, most_members):
    """Many near copies of one text: their pairs are compared in few regions, and no further round is left to split them."""
    random.seed(14)
    words = [f"w{i}" for i in range(3000)]
    base, rows, rounds, compared = random.choices(words, k=200), [], [], []
    for i in range(240):
        t = list(base)
        for k in random.sample(range(200), random.randint(1, 12)):
            t[k] = random.choice(words)
        rows.append((i, " ".join(t)))
    whole, likely, stored = op10_jaccard.class_links, op10_jaccard._likely, op10_jaccard.stored

    def counted(*args):
        rounds.append(1)
        assert len(rounds) <= 2
        return likely(*args)

    def seen(df, tag):
        out = stored(df, tag)
        if tag == "windows":
            compared.append(out.count())
        return out

    monkeypatch.setattr(op10_jaccard, "class_links", lambda d, c: whole(d, c, most_members=most_members))
    monkeypatch.setattr(op10_jaccard, "_likely", counted)
    monkeypatch.setattr(op10_jaccard, "stored", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_jaccard.jaccard_classes(df).collect()}
    assert [got[i] for i, _ in rows] == _brute(rows)
    assert most_members == 40 or sum(compared) <= 2 * len(rows)


def test_op10_hot_key(spark):
    """A part that all texts hold is found in the sample, and its rows are dealt over all tasks; others stay together."""
    random.seed(13)
    words = [f"w{i}" for i in range(500)]
    shared = " ".join(random.choices(words, k=400))
    rows = [(i, f"{shared} {' '.join(random.choices(words, k=30))}") for i in range(3000)]
    texts = op10_jaccard._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    schema = "key long, cls long, need int"
    sample = texts.where(F.pmod("text_key", F.lit(op10_jaccard.SAMPLE)) == 0)
    hot = op10_jaccard._hot(sample.mapInArrow(functools.partial(op10_jaccard._keys_of, op10_jaccard._no_hot()), schema))
    assert 0 < len(hot.ids) < 500
    met = op10_jaccard._met(texts.mapInArrow(functools.partial(op10_jaccard._keys_of, hot), schema), 8)
    per = met.withColumn("task", F.spark_partition_id()).groupBy("key", "task").agg(F.count("*").alias("n"), F.min("need").alias("need")).toPandas()
    top = per.groupby("key").agg(n=("n", "sum"), tasks=("task", "size"), most=("n", "max"), need=("need", "min"))
    assert (top[top.need > 0].tasks == 1).all() and (top[top.need < 0].tasks == 8).all()
    assert (top.n > 1500).any() and top.most.max() < 3000 / 8 * 1.5
    found, pivots = hot.find(0, top[top.need < 0].index.to_numpy())
    assert found.all() and set(pivots.tolist()) <= {op10_jaccard._class(op10_jaccard.shingle_set(t)) for _, t in rows}


def test_op10_null_ids_and_long_texts(spark):
    random.seed(12)
    words = [random.choice(["alpha", "beta", "gamma", "delta"]) + str(i) for i in range(200)]
    text = lambda drop: " ".join(w if i not in drop else f"x{i}" for i, w in enumerate(words))
    a, b, c = text(set()), text({10, 30}), text({10, 30, 60, 90, 120, 150})
    brute = _brute([(1, a), (2, b), (3, c)])
    assert [x for _, x in brute] == [1, 1, 1] and [x for _, x in _brute([(1, a), (3, c)])] == [1, 3]  # b is the bridge
    long = "word " * 300_000 + "end"
    rows = [(1, a, 0), (None, b, 0), (3, c, 0), (4, long, 0), (5, long.upper(), 0), (None, "quite alone here with six words", 0), (7, a, 0), (7, "another text with the same number", 0), (None, None, 0), (8, "", 0), (3, c, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").select("*", F.lit(1).alias("group"), F.lit(2).alias("cls"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in op10_jaccard.jaccard_classes(df).collect())
    assert got == sorted([(1, 196, 1), (0, 196, 1), (3, 196, 1), (3, 196, 1), (4, 2, 4), (5, 2, 4), (0, 2, 0), (7, 196, 1), (7, 2, 7), (0, 0, 0), (8, 0, 8)])


def test_shingles_by_brute_force(docs):
    """Sets as long as those of plain Python, equal where those are; ASCII white space and letters alone count."""

    def plain(text):
        w = text.encode().lower().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    random.seed(5)
    texts = [r.text or "" for r in docs.select("text").collect()]
    texts += ["", " \t\r", "A\x0bB\x0cc d E f", "a b c d e f", "é\xa0b c", "É\xa0b c", "\x1ca\x85b", "x" * 64, "x" * 65, "x" * 64 + "\0", "x\0", "x", "0" * 200_000]
    texts += [" ".join(random.choice(["a", "b", "B", "c" * 70]) for _ in range(random.randrange(9))) for _ in range(300)]
    got = op10_jaccard.shingle_sets(texts)
    assert [len(s) for s in got] == [len(plain(t)) for t in texts]
    seen: dict = {}
    assert all(seen.setdefault(plain(t), s.tobytes()) == s.tobytes() for t, s in zip(texts, got, strict=True)) and len(set(seen.values())) == len(seen)
    assert all(np.array_equal(op10_jaccard.shingle_set(t), s) for t, s in zip(texts[-310:], got[-310:], strict=True))


def test_ring_guarantee():
    """Linked sets agree on a part that isn't empty, at all sizes."""
    rng = np.random.default_rng(9)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            x = rng.integers(1, 1 << 62, n).astype(np.uint64)
            drop = rng.integers(0, n // 9 + 2)
            y = np.concatenate([x[drop:], rng.integers(1, 1 << 62, rng.integers(0, n // 9 + 2)).astype(np.uint64)])
            x, y = np.unique(x), np.unique(y)
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                assert len(np.intersect1d(op10_jaccard.signatures(x), op10_jaccard.signatures(y)))
                (ra, ka), (rb, kb) = op10_jaccard.sketch(x), op10_jaccard.sketch(y)
                for j in set(ra) & set(rb):
                    a, b = (np.frombuffer(k[r.index(j)], dtype=np.uint8) for k, r in ((ka, ra), (kb, rb)))
                    assert np.count_nonzero(a != b) <= (len(x) + len(y)) // 9
