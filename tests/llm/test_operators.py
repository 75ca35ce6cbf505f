"""Operators of the corpus subpackage against brute force, on small tables with nulls, ties, repeats and empties."""

import struct
import zlib

import numpy as np
import pytest

from confluo.llm import cap_filters, dac, html_text, licenses, line_dedup, merge_dropout, ngram_join, packing, quality, shards
from confluo.llm.encoder import Encoder, vocabulary

DOCS = "doc_id long, text string, extra int"
ODD = ["", "  a  b\n\n c\t\td ", "İstanbul ΣΑΣ σ", "don't WE'RE x'll", "a\x1cb \x7f", "日本語 テキスト", "é ß ſ", "<|endoftext|>", "a<|endoftext|>b <|STARTOFTEXT|> 日本<|startoftext|>", " \n a \n", "x" * 200]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(name))
    own = Encoder(vocabulary(name), entries=8)
    for text in ODD:
        ids = own.ids(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain.encode(text, add_special_tokens=False).ids


def test_codes_give_every_token():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 255, 256, 49_000, 70_000], 3_000).astype(np.uint32)
    codes = dac.Codes(dac.encode_ids(ids))
    assert (codes.all() == ids).all()
    assert [codes.token(i) for i in range(0, 3_000, 37)] == ids[::37].tolist()
    assert len(dac.Codes(dac.encode_ids(ids[:0])).all()) == 0
    with pytest.raises(IndexError):
        codes.token(3_000)


def test_token_output(spark):
    texts = ["b a", None, "", "word " * 300, "b a"]
    written, _ = dac.write_segments(docs_of(spark, texts), vocabulary("word_bpe_49k.json"), end_id=2, limit=100)
    rows = sorted(dac.read_digest(written).collect())
    own, at = Encoder(vocabulary("word_bpe_49k.json")), 0
    for r, t in zip(rows, texts, strict=True):
        ids = own.ids(t or "") + struct.pack("<I", 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    asked = spark.createDataFrame([(3, 7), (0, 0), (1, 5)], "doc_id long, position long")
    got = {(r.doc_id, r.position): r.token for r in dac.read_tokens(written, asked).collect()}
    assert set(got) == {(3, 7), (0, 0)}


def test_packing(spark):
    assert packing.cut(1024 + 5) == [1024, 4, 1]
    out = packing.decompose(docs_of(spark, ["hello world " * 900, None, ""]), vocabulary("byte_bpe_50k.json"), end_id=0, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    for doc in {r.doc_id for r in out}:
        parts = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) == parts[0].doc_tokens and all(r.length & (r.length - 1) == 0 for r in parts)
        assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in parts)


def test_quality_counts_and_rules(spark):
    assert quality.counts("a b c a b c")[:5] == (6, 6, 0, 0, 6)
    assert quality.counts("x#y\nx#y\n \nz")[1:4] == (7, 2, 1)
    assert quality.counts("")[0] == 0
    good, bad = "word " * 3, "junk### "
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) + good for k in range(60)] + [" ".join(f"{bad}{k}{i}" for i in range(60)) for k in range(60)] + [None]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.judged(docs, rules).collect()}
    assert rules and all(kept[k] == (k < 60) for k in range(120)) and not kept[120]
    assert quality.keep(docs, rules).count() == 60
    assert quality.fit(docs, labels.limit(0)) == []


def _sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def _components(n, links):
    of = list(range(n))
    for _ in range(n):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(5000)}" for _ in range(60)] for _ in range(4)]
    texts = [None, "", "one two", "one two"]
    for words in base:
        chain = list(words)
        for _ in range(9):
            texts.append(" ".join(chain))
            chain = list(chain)
            chain[int(rng.integers(60))] = f"n{rng.integers(10**6)}"
    sets = _sets(texts, 4)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = _components(len(texts), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, texts), 4, 85).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))}


def test_line_dedup(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank"
    near = line + "s"
    texts = [f"{line}\nshort\n", f"{near}\nshort\n \nsomething else entirely is written in this line", line, None, "", "short\nshort\nshorn\nx"]
    out = {r.doc_id: (r.text, r.gone) for r in line_dedup.dedup(docs_of(spark, texts), removed="gone").collect()}
    assert out == {0: (texts[0], 0), 1: (" \nsomething else entirely is written in this line", 2), 2: ("", 1), 3: (None, 0), 4: ("", 0), 5: ("shorn\nx", 2)}


def test_line_dedup_joins_families(spark, monkeypatch):
    """Variants of one line, each with one other word replaced, link to the base and hardly to each other."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4, raising=False)
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5))
    base = [word() for _ in range(40)]
    lines = [" ".join(base)] + [" ".join([*base[:k], word(), word(), word(), *base[k + 3 :]]) for k in range(0, 38)]
    other = " ".join(word() for _ in range(40))
    out = {r.doc_id: r.gone for r in line_dedup.dedup(docs_of(spark, [*lines, other]), removed="gone").collect()}
    assert [k for k in out if not out[k]] == [0, len(lines)]


@pytest.mark.parametrize("length", [50, 60])
def test_line_dedup_finds_a_changed_letter(spark, length):
    line = "Parcel 4471 left the northern depot on a rainy Monday evening"[:length]
    changed = f"{line[: length // 2]}#{line[length // 2 + 1 :]}"
    out = line_dedup.dedup(docs_of(spark, [line, changed]), removed="gone").collect()
    assert {r.doc_id: r.gone for r in out} == {0: 0, 1: 1}


def test_line_dedup_bands_of_lines_that_repeat_themselves(spark):
    """The bands come from the smallest of all distinct hashes, however often the line repeats them."""
    rng = np.random.default_rng(4)
    phrases = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(8)) for _ in range(8)]
    texts = [t for p in phrases for t in (" ".join([p] * 60), " ".join([p] * 60 + ["x"]))]
    out = {r.doc_id: r.gone for r in line_dedup.dedup(docs_of(spark, texts), removed="gone").collect()}
    assert out == {k: k % 2 for k in range(len(texts))}


def test_cap_filters(spark):
    rng = np.random.default_rng(5)
    center = rng.standard_normal((3, 32))
    x = np.concatenate([c + 0.1 * rng.standard_normal((20, 32)) for c in center] + [rng.standard_normal((40, 32))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 32), (102, [float("nan")] * 32), (103, [])]
    out = {r.vec_id: r for r in cap_filters.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    found = sum(out[k].n_links for k in range(100))
    assert found <= links.sum() - 100 and found >= 0.9 * (links.sum() - 100)
    assert all(out[k].n_links == 0 and out[k].kept for k in (100, 101, 102, 103))


@pytest.mark.parametrize("dim, words", [(64, 32), (64, 256), (64, 1024), (64, 4096), (24, 256), (8, 256), (3, 64), (2, 64)])
def test_cap_filters_recall_at_every_size(dim, words):
    """Pairs at a cosine of just 0.9 have a common filter, whatever the number of vectors that sets the code words."""
    rng = np.random.default_rng([dim, words])
    x = rng.standard_normal((200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((200, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    hit = np.zeros(200, dtype=bool)
    for t in range(cap_filters.TABLES):
        code = cap_filters.Code(dim, words, t)
        hit |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.filters(x), code.filters(y), strict=True)]
    assert hit.mean() >= 0.97


def test_merge_dropout():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, plain, dropped = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.Encoder(path, 0.0, 0), merge_dropout.Encoder(path, 0.3, 7)
    for text in [*ODD, "some ordinary words in a sentence, repeated words", "long" * 200]:
        ids = np.frombuffer(plain.ids(0, text), "<u4")
        assert ids.tolist() == sp.encode(text)
        for k in (None, 1, 2):
            varied = np.frombuffer(dropped.ids(k, text), "<u4")
            assert dropped.decode(varied) == text
    assert plain.decode(np.frombuffer(plain.ids(0, "▁x"), "<u4")) == "▁x"


def test_merge_dropout_draws_for_each_occurrence():
    """Draws are those of each turn's own hash; a word varies within a document, and about the asked share of turns is skipped."""
    path = vocabulary("piece_bpe_32k.model")
    code = merge_dropout.Encoder(path, 0.1, 3)
    keys, bits = code._draws(code.key(9), 400)
    assert all(int(b) >> t & 1 == code.skips(int(k), t) for k, b in zip(keys, bits, strict=True) for t in range(merge_dropout.TURNS))
    assert 0.085 < np.mean([int(b).bit_count() / merge_dropout.TURNS for b in code._draws(code.key(1), 5_000)[1]]) < 0.115
    for word in (" segmentation", " internationalization of everything"[:30], "x"):
        kinds = set()
        for k, b in zip(keys.tolist(), bits.tolist(), strict=True):
            found = code._occurrence(word, code[word][1], k, b)
            assert found == code.long(word, k)
            kinds.add(found)
        assert (len(kinds) > 8) == (len(word) > 1)


def test_merge_dropout_tables(spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = [None, "", "a b", "a b", "naïve café ▁ 日本語 \U0001f600", "word " * 500]
    docs = spark.createDataFrame([(k % 5 if k < 5 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    out = merge_dropout.encode(docs, path, seed=4)
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.decoded for r in rows)
    assert sorted(r.text for r in merge_dropout.decode(out, path).collect()) == sorted(t or "" for t in texts)
    assert [tuple(r) for r in merge_dropout.encode(docs.repartition(3), path, seed=4).where("doc_id = 2").collect()] == [tuple(r) for r in rows if r.doc_id == 2]
    assert merge_dropout.encode(docs.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def learned(spark):
    """Weights from the marked pages of a test table."""
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_html_extraction(learned):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now please</div><article><h1>Head&amp;line</h1><p>First  text\nhere<br>next <b>bo</b>ld</p><div class=comments><p>me too</p></div><p>End.</article><footer>foot</footer>"
    assert html_text.extract(page, learned) == "Head&line\nFirst text here\nnext bold\nEnd."
    assert html_text.extract(None) == "" and html_text.extract("<p></p>") == ""


def test_html_extraction_on_held_out_pages(spark):
    """Weights from some marked pages find the article of others, with their article tags and without."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    sums = html_text.Counter()
    for p in pages[:100]:
        sums.update(html_text.count_page(p))
    w, every = html_text.weights(sums), {"word": 1.0, "link": 1.0, "tag": 0.0}
    for p in pages[100:]:
        want = html_text.extract(re.search("<article>(.*?)</article>", p, re.S)[1], every)
        assert html_text.extract(p, w) == want == html_text.extract(re.sub("</?article>", "", p), w)


def test_html_extraction_keeps_articles_in_named_wrappers(learned):
    article = "<article><h1>Title</h1><p>Over <a href='/the-hidden-valley'>the valley</a> we went on.</p></article>"
    for attributes in ("class='overflow-hidden'", "class='content with-sidebar'", "class=no-sidebar", "class=nav-open", "class=search-results", "class=social-studies", "class=widget"):
        page = f"<body><nav>Menu here</nav><div {attributes}>{article}</div><div class=comments>me too</div><div hidden>no</div></body>"
        assert html_text.extract(page, learned) == "Title\nOver the valley we went on."


def test_html_extraction_drops_nothing_else(learned):
    w = learned | {"c:box": -4.0}
    assert html_text.extract("<article><p>Some first words here</p><section id='search-trees'>four five six</section><p class='notice'>seven &amp; eight</p></article>", w) == "Some first words here\nfour five six\nseven & eight"
    assert html_text.extract("<p>if a < b and c <d or e</p><p>then f</p>") == "if a < b and c <d or e\nthen f"
    assert html_text.extract('<p title="a > b" data-x=\'"\'>one two</p>') == "one two"
    assert html_text.extract("<div class=box>" + "not this " * 9 + "</div><h1>Good</h1><p>" + "yes " * 9 + "</p>", w) == "Good\n" + ("yes " * 9).strip()


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", "<!", "<script>", "<a <b>", "<!--", "<b x='"])
def test_html_extraction_is_linear(piece):
    import time

    began = time.time()
    html_text.extract(piece * 100_000 + "<p>some words</p>")
    assert time.time() - began < 20


def test_html_extraction_tables(spark):
    page = "<body><nav>menu entry</nav><article><p>" + "word " * 40 + "</p></article></body>"
    pages = spark.createDataFrame([(k, p, "t") for k, p in enumerate([page] * 30 + [None, "", "x" * 100_000])], "page_id long, html string, text string")
    w = html_text.fit(pages, rows=5)
    out = {r.page_id: r.text for r in html_text.with_text(pages, w).collect()}
    assert out[0] == out[29] == ("word " * 40).strip() and out[30] == out[31] == "" and out[32] == "x" * 100_000
    assert html_text.fit(pages.limit(0)) == html_text.PLAIN and html_text.with_text(pages.limit(0), w).count() == 0


def test_license_scan(spark):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT")
    texts = ["MIT LICENCE\n\nCopyright (c) 2020 Someone\n" + mit.upper(), "text\nLicensed under the Apache Licence, version 2.0!", None, "nothing"]
    out = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert out == {0: ("MIT", ""), 1: (None, "Apache-2.0"), 2: (None, ""), 3: (None, "")}


def test_shards(spark, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/store")
    docs = docs_of(spark, [f"text {k}" for k in range(100)] + [None])
    for _ in range(2):
        store.append(docs.repartition(4))
    before = store.manifest()
    reader = store.read()
    after = store.compact()
    assert after.n_shards < before.n_shards and after.n_rows == 202 and store.read().count() == 202
    assert reader.count() == 202 and store.read(before.version).count() == 202
    with pytest.raises(shards.Conflict):
        store._commit(after.version, after.schema, store.listed())
    with pytest.raises(ValueError):
        store.append(docs.withColumnRenamed("extra", "other"))
    assert sorted(tuple(r) for r in store.read().collect())[:0] == [] and store.append(docs.limit(0)).n_rows == 202
    store.expire(keep=1)
    assert store.versions() == [store.manifest().version] and store.read().count() == 202


def test_shards_compaction_beside_a_writer(spark, tmp_path):
    """A writer that has its files but no version yet survives a compaction and an expiry; a dead one's files go by age."""
    store = shards.Store(spark, f"file://{tmp_path}/store")
    docs = docs_of(spark, [f"text {k}" for k in range(20)])
    for _ in range(5):
        store.append(docs.coalesce(1))
    written = store._written(docs)
    done = store.compact()
    store.expire()
    late = store._commit(done.version + 1, done.schema, store.listed().union(written))
    assert late.n_rows == 120 and store.read().count() == 120
    store._written(docs)
    folders = len(store._list(store._path("shards")))
    store.expire(abandoned_s=-10)
    assert len(store._list(store._path("shards"))) < folders and store.read().count() == 120


def test_tier_expression(spark):
    sizes = [1, shards.LEAST_BYTES, shards.LEAST_BYTES + 1, 4 * shards.LEAST_BYTES, 17 * shards.LEAST_BYTES, 128 << 20, 1 << 33]
    rows = spark.createDataFrame([(x,) for x in sizes], "n_bytes long").select("n_bytes", shards._tier().alias("t")).collect()
    assert [r.t for r in rows] == [shards.tier_of(r.n_bytes) for r in rows]


def test_line_dedup_compares_what_a_band_leaves_over(spark):
    """Near copies that meet only in a band of many unlike lines are joined, whichever lines the band takes as central."""
    import random

    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    lines, want = [], set()
    for band in range(6):
        unlike = [word() for _ in range(12)]
        lines += [(100 * band + k, band, x) for k, x in enumerate([*unlike, unlike[0][:-1] + "#"])]
        want.add((100 * band, 100 * band + 12))
    keyed = spark.createDataFrame([(b, h, 13) for h, b, _ in lines], "band long, h long, m long")
    texts = spark.createDataFrame([(h, x) for h, _, x in lines], "h long, line string")
    of, _ = line_dedup._components(keyed, texts, 80)
    got = {}
    for r in of.collect():
        got.setdefault(r.component_id, set()).add(r.id)
    assert {tuple(sorted(x)) for x in got.values()} == want


def test_ngram_join_leaves_no_wide_table(spark):
    """The first shingles of all documents are not kept on disk until the end."""
    from pathlib import Path

    from confluo.scratch import shared_dir

    left = lambda: set(Path(shared_dir(spark).removeprefix("file://")).glob("confluo/first-pivots-*"))
    before = left()
    out = ngram_join.join(docs_of(spark, ["a b c d e f g", "a b c d e f g", "x y z u v w"]), width=4, percent=85)
    assert left() == before and sorted(r.component_id for r in out.collect()) == [0, 0, 2]


def test_line_dedup_keeps_no_tables_of_ended_rounds(spark, monkeypatch):
    """Of each kind of table that a round makes, the disk has one or two at a time, whatever the number of rounds."""
    import random
    from collections import Counter

    draw, live, most, kinds, rounds = random.Random(9), {}, Counter(), ("band-central", "line-links", "line-components", "band-marks", "band-rows"), []
    saved, dropped = line_dedup.saved, line_dedup.dropped

    def save(df, name):
        out = saved(df, name)
        live[out[1]] = name
        rounds.append(name)
        most.update({k: max(0, n - most[k]) for k, n in Counter(live.values()).items()})
        return out

    def drop(s, *paths):
        for p in paths:
            live.pop(p, None)
        dropped(s, *paths)

    monkeypatch.setattr(line_dedup, "saved", save)
    monkeypatch.setattr(line_dedup, "dropped", drop)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    base = [draw.choice(words) for _ in range(14)]
    lines = [" ".join(draw.choice(words) if draw.random() < 0.04 * (k % 9) else w for w in base) for k in range(120)]
    line_dedup.removals(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert rounds.count("line-pairs") > 2 and all(most[k] <= 2 for k in kinds)
    assert list(live.values()) == ["lines-gone"]


@pytest.mark.parametrize("block", [4, 1024])
def test_line_dedup_compares_only_what_sketches_leave_open(spark, monkeypatch, block):
    """Unlike lines of a band are told apart without their shingle sets, and no link is lost by it, whatever the size of a block."""
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    lines = []
    for _ in range(12):
        base = draw.sample(words, 30)
        lines += [" ".join(draw.choice(words) if draw.random() < 0.05 else w for w in base) for _ in range(6)]
    lines = sorted(set(lines)) + ["ab", "\U0001f600 five \U0001f601", "\U0001f600 five \U0001f602"]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    links = [(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = _components(len(lines), links)
    compared, linked = [], line_dedup._linked

    def count(pairs, *rest):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return linked(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_linked", count)
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    keyed = spark.createDataFrame([(b, h, len(lines)) for b in range(2) for h in range(len(lines))], "band long, h long, m long")
    of, _ = line_dedup._components(keyed, spark.createDataFrame(list(enumerate(lines)), "h long, line string"), 80)
    got = {r.id: r.component_id for r in of.collect()}
    assert [got.get(k, k) for k in range(len(lines))] == [want[k] for k in range(len(lines))]
    assert len(compared) < 2 * len(links) + len(lines)
