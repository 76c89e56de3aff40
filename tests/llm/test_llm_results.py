"""Results against brute force, exact round trips, known algorithms and held-out labels, on whole small tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from sentrylake.llm import boosted_trees, bpe, chat, components, html_diff, html_lines, iblt, line_dedup, quality_rules, secret_scan, simhash
from sentrylake.llm.catalog import QUERIES
from sentrylake.llm.lexicon import Lexicon, compile_lexicon
from sentrylake.llm.queries_native import OP2_SQL, OP3_SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def texts():
    return {r.doc_id: r.text or "" for r in read("documents").itertuples()}


@pytest.fixture(scope="module")
def tokenizer():
    return LIBRARY


def rows_of(spark, name):
    return QUERIES[name][0](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_pages_against_their_markup(spark):
    """The pages here mark their article; its blocks are the text."""
    import html

    pages = {r.page_id: r.html for r in read("pages").itertuples()}
    out = rows_of(spark, "op1_html_extract")
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1].replace("<br>", " ")) if article else []
        lines = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(line for line in lines if line) and r["n_chars"] == len(r["text"])


def test_lines_of_a_full_page():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><a href=/>Site</a></header>
    <nav><ul><li>Home<li>About</ul></nav><div id="cookie-notice"><p>We use cookies</p></div><main><article class="post">
    <header class="entry-header"><h1>Big&nbsp;title<br>&amp; more</h1></header><p>First <b>bold</b>
    text<script>var x="</p>";</script> <p>Next <img alt="a>b"> &copy; 2020<blockquote>Quote</blockquote>
    <div class="share-buttons">Share this</div><aside>Related</aside><form>Sign up <input></form><div>plain</div>
    <table><tr><td>a</td><td>b</td></tr></table></article><section id="comments"><article class="comment"><p>Nice!</p></article>
    </section></main><div class="sidebar"><p>Side</p></div><footer><p>Foot</p></footer><div class="ad">Buy"""
    found, kinds = html_lines.lines(page)
    kept = [line for line, kind in zip(found, kinds) if kind != html_lines.BOILERPLATE]
    assert kept == ["Big title & more", "First bold text", "Next © 2020", "Quote", "plain", "a b"]


def kept_lines(page):
    found, kinds = html_lines.lines(page)
    return [line for line, kind in zip(found, kinds) if kind != html_lines.BOILERPLATE]


PROSE = "A long paragraph about the matter itself, longer than all that stands around it on this page, and then some."


@pytest.mark.parametrize("around", [
    '<div class="overflow-hidden">{}</div>', '<div class="content-with-sidebar"><article>{}</article></div>',
    '<div class="layout-sidebar-right">{}</div>', '<main class="page comments-open">{}</main>',
    '<article class="post related-tag">{}</article>', '<div class="article-share-wrapper">{}</div>',
    '<section class="social-policy">{}</section>', '<form id="aspnetForm"><article>{}</article></form>',
    '<head><title>x</title><body><div class="widget"><main>{}</main></div>', '<article>{}</article><div class="comments"><article>short</article></div>',
    '<div class="menu-open"><nav>Menu</nav><article>{}</article><div class="related"><article>Teaser</article></div></div>',
    '<table><tr><td class="sidebar">Menu</td><td>{}</td></tr></table>',
])
def test_classes_are_hints_only(around):
    assert kept_lines(f"<nav>Start</nav>{around.format(f'<p>{PROSE}</p>')}<footer>End</footer>") == [PROSE]


@pytest.mark.parametrize("inside", [
    "<svg><path>", "<svg><g><path d='x'/>", "<noscript>x", "<template>x", "<object>x", "<canvas>x", "<iframe src=x>y", "<svg/>",
])
def test_unclosed_elements_end_with_their_parent(inside):
    page = f"<article><div><p>one</p>{inside}</div><p>two</p></article>"
    assert kept_lines(page) == ["one", "two"]


def test_text_of_formulas_stays_and_drawings_do_not_break_lines():
    assert kept_lines("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>") == ["Let x=1 be"]
    assert kept_lines("<article><p>a <svg><title>I</title><text>no</text></svg> b<object>no</object></p></article>") == ["a b"]
    assert kept_lines("<article><p>one</p><svg><path><p>two</p>") == ["one", "two"]
    assert kept_lines("<article><p>one</p><script>var a = 1;<p>two</p>") == ["one"]
    assert kept_lines('<article><p>a <span class="social">b</span> c</p></article>') == ["a b c"]


def test_deep_nesting_takes_linear_time():
    import time

    page = "<div>" * 20_000 + "text" + "</i>" * 20_000 + "<i>" * 20_000 + "<p>x" * 20_000
    start = time.perf_counter()
    assert len(html_lines.lines(page)[0]) == 20_001
    assert time.perf_counter() - start < 5


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_lines_are_longest(left, right):
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    shared = html_diff.common_lines(left, right)
    rest = iter(right)
    assert len(shared) == best[-1][-1] and all(left[i] in rest for i in shared)


def test_unmarked_pages_lose_what_they_share(spark):
    """Without article elements the shared lines are all there is to go by."""
    menu = "".join(f"<div>Menu {i}</div>" for i in range(3))
    pages = spark.createDataFrame(
        [(i, f"http://h.org/a/{i}", f"{menu}<div>Own text {i}, long enough to differ</div><div>Imprint</div>") for i in range(40)],
        "page_id bigint, url string, html string",
    )
    got = {r["page_id"]: r["text"] for r in html_diff.extract(pages.repartition(7)).collect()}
    assert got == {i: f"Own text {i}, long enough to differ" for i in range(40)}


def test_ids_equal_the_tokenizer(spark, texts, tokenizer):
    out = rows_of(spark, "op4_bpe")
    assert len(out) == len(texts)
    for r in out:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))


ALPHABET = "aAbZ'sStTreLlLvVdDmM d09²ΣσİßéḈ\x1c\x85 \n\t!?#<|>_中٣ʼ​é\U0001f600"
VOCABULARY = bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
EXACT = bpe.Encoder(VOCABULARY)
WORDS = sorted({w.encode() for w in ["the", "there", "here", "hers", "ses", "lles", "ééé", "ab", "abab", "ll"]})
LISTED = bpe.Encoder(VOCABULARY, Lexicon.mapped(compile_lexicon(WORDS, [EXACT.merge(w.decode()) for w in WORDS])))


@given(st.lists(st.one_of(st.text(ALPHABET, max_size=90), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the", "hers"]))))
@settings(max_examples=400, deadline=None)
def test_any_text_is_encoded_as_the_tokenizer_does(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert EXACT.encode([text]).to_pylist() == LISTED.encode([text]).to_pylist() == [want]


def test_a_hundred_thousand_special_tokens():
    text = "<|endoftext|>the" * 50_000 + "<|startoftext|>" * 50_000 + " hers"
    assert EXACT.encode([text]).to_pylist() == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_long_pieces_merge_alike():
    piece = "".join(chr(97 + i * i % 26) for i in range(3000))
    parts = [EXACT.characters[b] for b in piece.encode()]
    assert EXACT._merge_long(list(parts)) == EXACT._merge_short(list(parts))


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=200, deadline=None)
def test_lexicon_holds_its_words_and_no_others(words, others):
    listed = sorted(words)
    lexicon = Lexicon(compile_lexicon(listed, [list(w) for w in listed]))
    ranks = lexicon.ranks([*listed, *others]).tolist()
    assert ranks[: len(listed)] == list(range(len(listed)))
    assert ranks[len(listed) :] == [listed.index(w) if w in words else -1 for w in others]
    assert [lexicon.ids_of(r) for r in range(len(listed))] == [list(w) for w in listed]


def test_lexicon_shares_endings():
    words = sorted(f"{a}{b}ation".encode() for a in "abcdefgh" for b in "xyz")
    lexicon = Lexicon(compile_lexicon(words, [[1]] * len(words)))
    assert len(lexicon.final) == 1 + 1 + len("xation")  # start, after the first letter, then one path


def test_line_hash_is_sparks(spark):
    """The text hash that Python writes is the one that Spark joins on."""
    from pyspark.sql import functions as F

    for text in ["", "a", "é\n中", "x" * 1000]:
        docs = spark.createDataFrame([(1, text + "\n" + "y" * 50)], "doc_id bigint, text string")
        assert line_dedup.line_keys(docs, 40).first()["text_hash"] == docs.select(F.xxhash64("text")).first()[0]


def likeness(a, b):
    a, b = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
    everything = sum((a | b).values())
    return sum((a & b).values()) / everything if everything else 1.0


def test_fingerprints_against_paragraph_sets(spark, texts):
    out = rows_of(spark, "op6_fingerprints")
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        text, after = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited)
        assert r["near_edited"] == pytest.approx(likeness(text, edited))
        assert r["near_next"] == pytest.approx(likeness(text, after))
    prints = {}
    for r in out:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert max(map(len, prints.values())) == 1
    assert np.mean([r["near_edited"] for r in out]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in out])


@given(st.lists(st.integers(0, 60)), st.lists(st.integers(0, 60)))
@settings(max_examples=100, deadline=None)
def test_peeling_recovers_the_difference(left, right):
    a, b = ("\n".join(f"paragraph {x}" for x in own) for own in (left, right))
    sets = iblt.digests([a, b, a])
    owner, key, side = iblt.differences(sets.take(np.array([0, 0])), sets.take(np.array([1, 2])))
    assert not (owner == 1).any()
    mine, other = set(sets.take(np.array([0])).digests.tolist()), set(sets.take(np.array([1])).digests.tolist())
    assert set(key[side == 1].tolist()) == mine - other and set(key[side == -1].tolist()) == other - mine


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in read("labels").itertuples()}
    out = rows_of(spark, "op8_quality_model")
    assert len(out) == len(read("documents"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(unseen) > 10 and np.mean([a == b for a, b in unseen]) >= 0.9


def test_trees_learn_and_are_applied_alike():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = boosted_trees.fit(x[:1500], y[:1500])
    score = trees.score(x[1500:])
    assert np.mean((score > 0.5) == y[1500:]) > 0.97

    def one(row):
        total = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [one(row) for row in x[1500:1550]])


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in sorted(found))


def test_base_secrets(spark, texts):
    out = rows_of(spark, "op9_secret_scan")
    assert len(out) == len(texts)
    for r in out:
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(base)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in base.split(",") if s]
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base.split(",")) * bool(base)


def test_odd_places_of_base_secrets(spark):
    odd = [
        "secret=token=abc", "password=token: abcdefghijk", "\U0001f600é api_key : 'AKIAABCDEFGHIJKL12' ApiKey=\"12345678", "PASSWD==abcdefgh",
        "f" * 31 + "g" + "0" * 32, "AKIA AKIAAKIAAKIAAKIA", " ".join(f"token={i:08d}" for i in range(700)), "Kapi_key=short tokeN\n=abcdefgh1",
    ]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for r in secret_scan.secrets(docs).select("doc_id", secret_scan.written(secret_scan.F.col("base")).alias("w")).collect():
        assert r["w"] == base_spans(odd[r["doc_id"]])


def test_random_tokens_are_found_among_words(spark):
    import random

    dice = random.Random(11)
    keys = ["".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(60)]
    words = ["internationalization", "donaudampfschifffahrt", "aaaaaaaaaaaaaaaa1", "some_long_identifier_name", "CamelCaseIdentifierName", "abcdefghijklmnopqrstuvwxyz0123456789"]
    docs = spark.createDataFrame(
        [(i, f"{words[i % 6]} x {keys[i] if i < 60 else words[(i + 1) % 6]} end") for i in range(600)], "doc_id bigint, text string"
    )
    found = {r["doc_id"]: [s for s in r["spans"] if s["rank"] == 3] for r in secret_scan.secrets(docs).collect()}
    assert sum(bool(found[i]) for i in range(60)) >= 54 and not any(found[i] for i in range(60, 600))


def plain_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_classes(prints):
    """Smallest id of each id's component, from all pairs."""
    values = sorted(set(prints.values()))
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    root, first = classes(pairs, values), {}
    for i, v in sorted(prints.items()):
        first.setdefault(root[v], i)
    return {i: first[root[v]] for i, v in prints.items()}


def test_near_duplicates_against_all_pairs(spark, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    want = near_classes(prints)
    out = rows_of(spark, "op10_simhash")
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == want


@pytest.mark.parametrize("max_bits, blocks, crowd", [(4, 7, 256), (4, 7, 3), (4, 5, 2), (3, 6, 2), (2, 4, 5), (4, 9, 256)])
def test_links_join_all_close_pairs(spark, max_bits, blocks, crowd):
    """Joined pairs and crowded keys give the components of all pairs, and no pair that is too far apart."""
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = set()
    for seed in seeds.tolist():
        for _ in range(60):
            value = seed
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                value ^= 1 << int(bit)
            values.add(value - (1 << 64) if value >> 63 else value)
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = [(r["a"], r["b"]) for r in simhash.links(nodes, max_bits, blocks, crowd).collect()]

    def apart(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count()

    listed = sorted(values)
    every = [(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if apart(a, b) <= max_bits]
    assert all(apart(a, b) <= max_bits for a, b in found)
    assert classes(found, values) == classes(every, values)
    if crowd == 256:
        assert sorted(found) == sorted(every)  # each pair once


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    edges += [tuple(map(int, e)) for e in rng.integers(1000, 1100, (60, 2))]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = classes(edges, nodes | {5})
    assert {r["node"]: r["root"] for r in got} == {n: want[n] for n in nodes}
    assert len(got) == len(nodes)


def test_pipeline_against_brute_force(spark, tokenizer):
    """Every stage worked out plainly on its predecessor's rows; all rows of run() must agree."""
    con = duckdb.connect()
    docs = read("documents")
    con.register("documents", docs)
    kept = set(con.execute(f"SELECT doc_id FROM ({OP3_SQL}) WHERE kept").df()["doc_id"])
    docs = docs[docs.doc_id.isin(kept)].reset_index(drop=True)
    holders = {}

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    for r in docs.itertuples():
        for k in {key(line) for line in (r.text or "").split("\n")}:
            holders.setdefault(k, []).append(r.doc_id)
    repeated = {k: max(own) for k, own in holders.items() if len(k) >= 40 and len(own) >= 5}
    docs["text"] = [
        "\n".join(line for line in (r.text or "").split("\n") if repeated.get(key(line), r.doc_id) == r.doc_id) for r in docs.itertuples()
    ]
    groups = near_classes({r.doc_id: plain_print(r.text) for r in docs.itertuples()})
    docs = docs[[groups[i] == i for i in docs.doc_id]].reset_index(drop=True)
    con.unregister("documents")
    con.register("documents", docs)
    copies = {r.doc_id: r.copies for r in con.execute(OP2_SQL).df().itertuples()}
    want = Counter()
    for r in docs.itertuples():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, r.source, tuple(ids), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += copies[r.doc_id]
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "encoding"]


def extracted(spark, rows):
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in html_diff.extract(pages.repartition(5)).collect()}


def test_copies_and_short_texts_lose_the_menu(spark):
    """Runs of exact and near copies, and pages that are nearly all menu, lose what their site shares."""
    menu = "".join(f"<div>Entry {i} of the long menu of this site</div>" for i in range(30))
    one = "".join(f"<div>Paragraph {i} of the one text that was copied, again and again</div>" for i in range(90))
    text = "\n".join(f"Paragraph {i} of the one text that was copied, again and again" for i in range(90))
    rows = [(f"http://copies.org/a/{i}", f"{menu}{one}") for i in range(5)]
    rows += [(f"http://copies.org/b/{i}", f"{menu}<div>Other text {i}</div>") for i in range(6)]
    rows += [(f"http://near.org/a/{i}", f"{menu}<div>{i}.5.2024</div>{one}") for i in range(5)]
    rows += [(f"http://near.org/b/{i}", f"{menu}<div>Other text {i}</div>") for i in range(8)]
    rows += [(f"http://short.org/{i}", f"{menu}<div>Short {i}</div>") for i in range(9)]
    expected = [text] * 5 + [f"Other text {i}" for i in range(6)] + [f"{i}.5.2024\n{text}" for i in range(5)]
    expected += [f"Other text {i}" for i in range(8)] + [f"Short {i}" for i in range(9)]
    assert extracted(spark, rows) == dict(enumerate(expected))


def test_sharing_decides_inside_articles_too(spark):
    """A prompt in every article goes, a passage that some quote stays, and so does a text outside that is the longer one."""
    def article(host, i, own):
        quote = "<p>A passage that two articles quote</p>" if i in (3, 4) else ""
        return f"http://{host}/{i}", f"<article><p>{own} {i}, of its own</p>{quote}<p>Please support our site today</p></article>"

    rows = [article("many.org", i, "Article") for i in range(9)] + [article("two.org", i, "Article") for i in range(2)]
    menu = "".join(f"<div>Menu entry {i}</div>" for i in range(8))
    long = [f"Main text {i}, in a plain division that is certainly longer than the teaser beside it" for i in range(6)]
    rows += [(f"http://teaser.org/{i}", f"{menu}<article><p>Teaser {i}</p></article><div>{t}</div>") for i, t in enumerate(long)]
    expected = [f"Article {i}, of its own" + ("\nA passage that two articles quote" if i in (3, 4) else "") for i in range(9)]
    expected += [f"Article {i}, of its own\nPlease support our site today" for i in range(2)]
    expected += [f"Teaser {i}\n{t}" for i, t in enumerate(long)]
    assert extracted(spark, rows) == dict(enumerate(expected))


def test_random_keys_of_every_alphabet_and_length(spark):
    import random

    dice = random.Random(5)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {
        "hex": digits + "abcdef", "base32": lower.upper() + "234567", "lower base32": lower + "234567", "lower base36": lower + digits,
        "upper base36": lower.upper() + digits, "base62": lower + lower.upper() + digits, "base64": lower + lower.upper() + digits + "+/",
    }
    planted = [(a, n) for a in alphabets for n in (24, 32, 64, 96, 128, 256)] + [("letters", n) for n in (128, 256)]
    alphabets["letters"] = lower
    keys = [(a, n, "".join(dice.choices(alphabets[a], k=n))) for a, n in planted for _ in range(30)]
    words = ["internationalization", "donaudampfschifffahrtsgesellschaft", "some_long_identifier_name", "thisisalongnameofsomething42"]
    docs = spark.createDataFrame(
        [(i, f"{words[i % 4]} {key} end") for i, (_, _, key) in enumerate(keys)] + [(-1 - i, f"{words[i % 4]} end") for i in range(400)],
        "doc_id bigint, text string",
    )
    found = {(a, n): 0 for a, n in planted}
    for r in secret_scan.secrets(docs).collect():
        spans = [r["spans"][i] for i in range(len(r["spans"])) if r["spans"][i]["rank"] == 3]
        at = len(words[r["doc_id"] % 4]) + 1 if r["doc_id"] >= 0 else None
        assert all(s["start"] == at for s in spans)  # the key, never a word
        if spans:
            found[keys[r["doc_id"]][:2]] += 1
    # 24 or 32 characters of base32 and base36 are less unlike text: fewer of them are discoveries at the rate
    least = {("base32", 24): 5, ("base32", 32): 20, ("base36", 24): 20}
    assert {(a, n): k for (a, n), k in found.items() if k < least.get((a.split()[-1], n), 27)} == {}


@pytest.mark.parametrize("part", [1 << 20, 200])
def test_dialogues_of_every_participant(spark, part):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 40")
    turns = sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in rows.collect())
    found = {}
    for r in chat.dialogues(chat.rotate(rows), part).collect():
        found.setdefault((r["conv_id"], r["perspective"]), []).append((r["start"], r["text"], r["masks"]))
    people = {(conv, role) for conv, _, role, _ in turns if role not in (None, "system")}
    assert set(found) == people
    assert part > 200 or any(len(parts) > 1 for parts in found.values())
    for (conv, who), parts in found.items():
        parts.sort()
        text = "".join(t for _, t, _ in parts)
        want, trained = "", []
        for _, _, role, said in (t for t in turns if t[0] == conv):
            name = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
            want += f"<|im_start|>{name}\n{said}<|im_end|>\n"
            if role == who:
                trained.append(f"{said}<|im_end|>")
        assert text == want
        assert [text[m["start"] : m["stop"]] for _, _, masks in parts for m in masks] == trained
        assert [start for start, _, _ in parts] == [sum(len(t) for _, t, _ in parts[:i]) for i in range(len(parts))]


def test_two_sources_of_different_habits_have_different_fences(spark):
    def group(source, symbols, n):
        return [(i, "en", source, ("word " * 9 + "# " * symbols) * 10) for i in range(n)]

    docs = spark.createDataFrame(group("plain", 0, 900) + group("marked", 4, 900) + group("few", 0, 5), "doc_id bigint, lang string, source string, text string")
    limits = {r["source"]: r["symbols_high"] for r in quality_rules.fences(quality_rules.sketch(quality_rules.measure(docs))).collect()}
    assert limits["marked"] > limits["plain"] + 1500
    # a small group goes by its language, of which half have symbols
    assert limits["plain"] < limits["few"]


def test_fences_change_little_as_a_group_grows(spark):
    def limit(n):
        rows = [(i, "en", "own" if i < n else "other", "word " * 9 * 10 + "# " * (30 if i < n else 0)) for i in range(n + 400)]
        docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
        return {r["source"]: r["symbols_high"] for r in quality_rules.fences(quality_rules.sketch(quality_rules.measure(docs))).collect()}["own"]

    sizes = [limit(n) for n in (198, 199, 200, 201)]
    assert max(sizes) - min(sizes) < 0.02 * max(sizes)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (2, 2), (7, 2), (5, 3)])
def test_runs_do_not_depend_on_batches(spark, batches, fanout):
    """One batch at a time gives the counts of all lines at once, and a key lies in one run."""
    rows = [(i, "\n".join(f"line {k % (3 + i % 11)} that is long enough to have a key" for k in range(i % 6))) for i in range(120)]
    keys = line_dedup.line_keys(spark.createDataFrame(rows + [(None, rows[5][1])], "doc_id bigint, text string"), 20).cache()
    runs = line_dedup.LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(keys.where(f"coalesce(doc_id, 3) % {batches} = {number}"))
    want = {(r["h"], r["g"]): (r["n"], r["last"]) for r in keys.groupBy("h", "g").agg({"*": "count", "doc_id": "max"}).toDF("h", "g", "n", "last").collect()}
    assert {(r["h"], r["g"]): (r["n"], r["last"]) for r in runs.repeated(4).collect()} == {k: v for k, v in want.items() if v[0] >= 4}
    assert runs._runs().count() == len(want) and len(runs.levels) > (batches >= fanout)


def test_blocks_follow_the_number_of_fingerprints():
    found = [simhash.blocks_for(n, 4) for n in (0, 1 << 20, 1 << 25, 1 << 28, 1 << 33, 1 << 36)]
    assert found == sorted(found) and found[0] == found[2] == 7 < found[3] < found[-1] <= 16
