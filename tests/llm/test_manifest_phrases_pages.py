"""The Merkle manifest, phrase collocations and main texts against brute force: nulls, empty and very long texts, ties, repeated
rows, empty tables, and extra columns with clashing names."""

import collections
import hashlib
import html
import random
import re
import zlib

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

pytest.importorskip("tramline.llm")

from tramline.llm import collocations, main_text, merkle, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, tree string, n string, chunk string, name string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], DOCS)


# --- manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc, _, lang, source, n = row
    return h([field(v) for v in (doc, source, lang, n, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(of, at):
    out = []
    for level in of[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(groups[k], key=lambda r: r[:3]) for k in keys}
    trees = {k: levels([r[2] for r in own[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for t, k in enumerate(keys):
        for pos, (_, _, node, row) in enumerate(own[k]):
            steps = path(trees[k], pos) + path(top, t)
            shown = leaf(row, row[1].translate(LOWER)) if row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else node
            for at, others in steps:
                shown = h([*others[:at], shown, *others[at:]])
            out.append((row[0], node, trees[k][-1][0], top[-1][0], h([x for _, others in steps for x in others]), shown, shown == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found_manifest(docs):
    every_third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return sorted((tuple(r) for r in merkle.documents_manifest(docs, every_third).select(*MANIFEST).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513, 4096])
def test_fractal_traversal_gives_every_path(n):
    nodes = [h([str(k)]) for k in range(n)]
    whole = levels(nodes)
    walk = merkle.FractalTraversal(n, nodes.__getitem__, merkle.levels_of(n))
    for k, found in enumerate(walk.paths()):
        assert found == [others for _, others in path(whole, k)] and merkle.fold(nodes[k], k, found) == whole[-1][0]
        assert sum(len(level) for tree in (*walk.existing, *walk.desired) if tree for level in tree.levels) <= 2 * len(walk.bands) * (64 + 8 + 1)


def test_manifest_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", "s", 0), (2, "Größe É", "de", None, 7), (2, "Größe É", "de", None, 7), (2, "other", "de", "s", None), (3, "X" * 300_000, "é", "s", 3)]
    rows += [(k, "".join(r.choice("aB é\n") for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), "s", k % 5) for k in range(10, 700)]
    assert found_manifest(documents(spark, rows)) == brute_manifest(rows)
    lone = [(5, "One", "en", "s", 3)]
    assert found_manifest(documents(spark, lone)) == brute_manifest(lone) and brute_manifest(lone)[0][4] == h([])
    assert found_manifest(documents(spark, rows).limit(0)) == []


def test_manifest_over_several_tiers(spark):
    large = spark.range(5000).select(F.lit(0).cast("long").alias("tree"), F.lit(5000).cast("long").alias("n"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    whole = levels([h([str(k)]) for k in range(5000)])
    tiers = merkle.tiers_of(large)
    assert len(tiers) == 3 and merkle.roots_of(tiers).collect()[0].root == whole[-1][0]
    paths = {x.pos: merkle._unflat(x.path) for x in merkle.paths_of(tiers).collect()}
    assert all(paths[k] == [others for _, others in path(whole, k)] for k in (0, 7, 4095, 4096, 4999))


def test_the_registered_manifest(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op11_merkle(spark, SMALL)
    assert got.columns == MANIFEST and sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)


# --- phrases


def brute_phrases(rows, least, first, longest=4):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        inside = any(len(q) > len(p) and 100 * f >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), f in frequent.items() if other == lang)
        if not inside:
            score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for lang, own in out.items() for n, (s, a, p, l, r) in enumerate(sorted(own)[:first]))


@pytest.mark.parametrize("chunk", [1 << 25, 2000])
def test_phrases_of_odd_rows(spark, monkeypatch, chunk):
    r = random.Random(2)
    vocabulary = ["of", "the", "New", "york", "city", "\x85odd", "a\xa0b", "é", "und", "x" * 50]
    make = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 1), (2, " .,! ", "en", None, 1), (3, make(3000), None, None, 1), (4, "of the " * 5000, "fr", None, 1)]
    rows += [(k, make(r.randint(1, 60)), r.choice(["en", "fr", None, "und"]), None, 1) for k in range(10, 120)] + [(200, "New york city New york city", "en", None, 1)] * 40
    docs = documents(spark, rows)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    for least, first in ((30, 2000), (5, 7)):
        got = sorted(tuple(x) for x in collocations.collocations(docs, least, first).collect())
        assert got == brute_phrases(rows, least, first) and got
    assert collocations.collocations(docs.limit(0), 1, 10).count() == 0


def test_the_registered_phrases_and_their_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.op12_collocations(spark, SMALL)
    want = db.execute(queries.ORACLE_SQL["op12_collocations"])
    assert got.columns == [c[0] for c in want.description] and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# --- main texts

LONG = "This is a text that goes on for quite a while, and it has what the words of a language are made of, as it should."
PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p {{}}</style><script>var a = "<p>{LONG}</p>";</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG} Cookies.</p></div><div class='ad'>Buy now.</div>
<MAIN><article><header><h2>A &lt;title&gt; &amp; more</h2></header><p>First &eacute; <b>bo</b>ld. {LONG}</p><p>Short.<p>Un<!-- no -->closed   one
 line<br>two.<blockquote>Said.</blockquote><form><label>Name</label><input></form><aside>{LONG} Aside.</aside>
<ul><li>An item of it</li></ul><p>{LONG} End.</p></article></MAIN>
<section id="comments"><article class="comment"><p>{LONG} I say.</p></article></section><div class="sidebar"><p>{LONG}</p></div><footer>&copy; Someone</footer></body></html>"""
TEXT = ["A <title> & more", f"First é bold. {LONG}", "Short.", "Unclosed one line two.", "Said.", "An item of it", f"{LONG} End."]


def test_main_text_of_a_page_with_everything():
    assert main_text.main_blocks(PAGE) == TEXT
    plain = re.sub(r"</?(?:article|MAIN)>", "", PAGE)
    assert set(TEXT) <= set(main_text.main_blocks(plain)) | {"A <title> & more"} and not any("Cookies" in b or "Aside" in b or "I say" in b for b in main_text.main_blocks(plain))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>One</a></nav>", ""), ("<p>Lone.</p>", "Lone."), ("Bare text", "Bare text"), ("<p>a < b &lt; c &#233;&nbsp;d</p>", "a < b < c é d"),
        ("<p title='>'>One</p><p title=it's>Two</p>", "One\n\nTwo"), ("<script>x", ""), ("<p>Kept<!-- open", "Kept"), (f"<div hidden>{LONG}</div><p>{LONG}</p>", LONG), ("<p>a<br><br>b</p>", "a\n\nb"),
        (f"<div>{LONG}</div><div>Between.</div><div>{LONG}</div><div><a href=x>{LONG}</a></div><div>After.</div>", f"{LONG}\n\nBetween.\n\n{LONG}"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert main_text.main_text(page) == text


def truth(page):
    """The article of a page of the test data."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:h1|p)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_registered_main_texts(spark):
    want = [(r.page_id, r.url, truth(r.html), len(truth(r.html))) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = queries.op13_main_text(spark, SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_main_text_of_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "<p>One</p>", "x"), (1, "u", "<p>One</p>", "x"), (2, "", f"<article>{f'<p>{LONG}</p>' * 5000}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in main_text.extract_main_text(pages).collect()), key=repr)
    assert got == sorted([(None, None, 0), (1, "u", 3), (1, "u", 3), (2, "", 5000 * (len(LONG) + 2) - 2)], key=repr)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0
