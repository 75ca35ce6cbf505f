"""Empty tables, clashing column names, nulls, ties, repeats, long texts: each operator and the pipeline on small tables."""

import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from confluo.llm import cap_filters, dac, licenses, line_dedup, merge_dropout, ngram_join, packing, quality
from confluo.llm.encoder import vocabulary

CLASH = ("row", "line", "h", "band", "bands", "id", "n", "digest", "shingle", "ids", "length", "start", "lost", "rule", "kept", "n_words", "component_id", "part", "filter", "dim", "_id", "_text", "notices")


def clashing(df):
    """The table with further columns of names that operators use themselves."""
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def docs_of(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


OPERATORS = {
    "op1": lambda docs: dac.read_digest(dac.write_segments(docs, vocabulary("word_bpe_49k.json"), end_id=2)[0]),
    "op3": licenses.scan,
    "op4": lambda docs: ngram_join.join(docs, 4, 85),
    "op5": lambda docs: packing.decompose(docs, vocabulary("byte_bpe_50k.json"), end_id=0),
    "op6": lambda docs: quality.judged(docs.select("doc_id", "text", "row", "line", "h"), []),
    "op8": lambda docs: merge_dropout.encode(docs, vocabulary("piece_bpe_32k.model")),
    "op10": lambda docs: line_dedup.dedup(docs, removed="n_removed"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_tables(spark, name):
    """Null and repeated ids, null, empty and long texts give one result a row; an empty table gives none."""
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, None), (2, ""), (4, " \t\n "), (5, "word " * 40_000), (6, "x" * 70_000)]
    out = OPERATORS[name](docs_of(spark, rows)).collect()
    by_piece = sorted({(r.doc_id, r.doc_tokens) for r in out if r.doc_id is not None}) if name == "op5" else out
    assert len(by_piece) == (6 if name == "op5" else len(rows))
    assert OPERATORS[name](docs_of(spark, rows).limit(0)).collect() == []


def test_vectors_of_a_group_of_copies(spark):
    """Equal vectors count each other as links without being compared; ids may be null."""
    a, b, c = [1.0] + [0.0] * 31, [0.95] + [0.3] + [0.0] * 30, [0.0] * 31 + [2.0]
    rows = [(k, a) for k in range(400)] + [(1_000, b), (1_001, b), (2_000, c), (None, a), (3_000, [1e-200] * 32), (3_001, [1e-200] * 32), (7, a)]
    out = {}
    for r in cap_filters.dedup(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect():
        out.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert out[0] == [(401, 0, True)] and out[7] == [(401, 0, False)] * 2 and out[1_000] == [(401, 0, False)] and out[2_000] == [(0, 2_000, True)]
    assert out[None] == [(0, None, True)] and out[3_000] == [(1, 3_000, True)] and out[3_001] == [(1, 3_000, False)]
    assert cap_filters.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0)).collect() == []


def test_packing_equals_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["hello world " * 900, None, "", "a<|endoftext|>b", "日本語 naïve\n\n  x"]
    out = packing.decompose(docs_of(spark, list(enumerate(texts))), vocabulary("byte_bpe_50k.json"), end_id=0).collect()
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted((r for r in out if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) and r.offset == 0 and r.length & (r.length - 1) == 0


def base(text):
    """The base counts by their definition, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary_ = ["a", "b", "#x", "é", "\U0001f600", "\x1c", "\n", "\t", "  ", "<p>", "\x0b", "ccc"]
    texts = ["".join(rng.choice(vocabulary_) + rng.choice([" ", "", "\n"]) for _ in range(int(rng.integers(0, 160)))) for _ in range(80)] + [None, "", "a " * 200]
    out = {r.doc_id: r for r in quality.judged(docs_of(spark, list(enumerate(texts))).select("doc_id", "text", "h"), []).collect()}
    for k, t in enumerate(texts):
        r, want = out[k], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_ngram_join_of_hot_passages_and_ties(spark, monkeypatch):
    """Documents that share a passage and differ else, and one large group of copies, as brute force has them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(10**6)}"
    passage = " ".join(word() for _ in range(40))
    texts = [f"{passage} " + " ".join(word() for _ in range(int(rng.integers(1, 30)))) for _ in range(60)] + [passage] * 40 + [passage.upper()] * 3 + ["a b c d"] * 2 + [None]
    docs = docs_of(spark, [(len(texts) - k, t) for k, t in enumerate(texts)])
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[len(texts) - k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    want = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs, 4, 85).collect()} == want


def similar(a, b, width=5):
    x, y = ({t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("lengths", [(24, 40), (50, 90), (150, 400)])
def test_line_dedup_recall(spark, lengths):
    """Of lines with random edits and a similarity of 0.8 or more, at least nine in ten are found; others are left."""
    rng = np.random.default_rng(lengths)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(2, 9))))
    pairs = []
    while len(pairs) < 60:
        line = " ".join(word() for _ in range(90))[: int(rng.integers(*lengths))].strip()
        near = line
        for _ in range(30):
            k = int(rng.integers(len(near)))
            changed = near[:k] + rng.choice(letters) + near[k + int(rng.integers(2)) :] if lengths[0] > 30 else near + rng.choice(letters)
            if similar(line, changed) < 0.8:
                break
            near = changed
        if near != line:
            pairs.append((line, near))
    texts = [x for p in pairs for x in p]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs_of(spark, list(enumerate(texts))), removed="n_removed").collect()}
    assert not any(out[k] for k in range(0, len(texts), 2)) and sum(out[k] for k in range(1, len(texts), 2)) >= 54


def test_line_dedup_of_a_hot_passage(spark):
    """Lines that share a passage and are no near copies all stay; a unit repeated 80 or 81 times is one set of shingles."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5))
    passage = " ".join(word() for _ in range(20))
    shared = [" ".join(word() for _ in range(20)) + " " + passage for _ in range(60)]
    units = [unit * n for unit in ("".join(rng.choice(list("abcdefghi"), 9)) for _ in range(20)) for n in (80, 81)]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs_of(spark, list(enumerate(shared + units))), removed="n_removed").collect()}
    assert [out[k] for k in range(len(shared))] == [0] * len(shared)
    assert [out[len(shared) + k] for k in range(len(units))] == [0, 1] * 20


def test_pipeline(spark, tmp_path):
    """Rejected documents, copied lines and near copies go; clean documents pass whole into the sequences."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    prose = lambda n: "\n".join(" ".join(f"w{rng.integers(10**6)}" for _ in range(20)) for _ in range(n))
    clean = [prose(8) for _ in range(30)]
    near = clean[0].replace("\n", " \n") + " more"
    footer = "This very line stands below two of the documents here"
    texts = [*clean, near, prose(6) + "\n" + footer, prose(6) + "\n" + footer, "short", None, "spam " * 300]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    tok, n = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    want = {k: t for k, t in enumerate(texts) if k < 30 or k == 31} | {32: texts[32].rsplit("\n", 1)[0]}
    assert n == {k: len(tok.encode(t).ids) + 1 for k, t in want.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "packing"]
    kept = corpus_pipeline.STAGES[1][1](spark, docs, f"file://{tmp_path}")
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
