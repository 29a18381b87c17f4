"""Cross-tokenizer alignment against a plain count of links, and perfect hashes."""

import bisect
import collections
import os

import numpy as np
import pytest

from layerwood.llm import alignment
from layerwood.llm.alignment import align_documents, aligned, count_vector, encoders, pair_bound
from layerwood.llm.perfect_hash import perfect_hash
from layerwood.llm.queries_alignment import TOKENIZERS, op12_alignment

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no vocabulary files")

ODD = ["", None, " ", "a  b\t\n\n c x\u0085y", "don't we'll I'VE", "<|endoftext|> <s> </s> <unk>", "x" * 30_000, "\x00\x01\x1c", "日本語 ’“ 🙂", "é​", "▁ ▁a", "ＡＢＣ ﬁ",
       "the cat", "the cat", "\r\n", "ƿǀʼ ǅ²³¼ªº", "word " * 3_000, "�", "한"]


def slow_alignment(texts):
    """Byte ends in dictionaries, text by text; links counted in one dictionary."""
    enc = encoders(A, B)
    cut, links = [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = enc.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = enc.b.encode(t) if t else []
        if b"".join(enc.a_bytes[i] for i in a) != whole or b"".join(enc.b_bytes[i] for i in b) != whole:
            a = b = []
        ends_a, ends_b = np.cumsum([len(enc.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(enc.b_bytes[i]) for i in b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        by_a, by_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        groups = collections.defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(both, e)][side].append(str(i))
        mine = [(by_a[x], by_b[x]) for x in both]
        links.update(mine)
        cut.append((a, b, mine, ";".join(f"{','.join(x)}|{','.join(y)}" for _, (x, y) in sorted(groups.items()))))
    best = collections.Counter()
    for (_, j), n in links.items():
        best[j] = max(best[j], n)
    return [(len(a), len(b), len(m), len(m), sum(links[p] == best[p[1]] for p in m), sum(links[p] for p in m), g) for a, b, m, g in cut]


def rows_of(df):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_alignment_equals_a_plain_count(spark, sf_dir, monkeypatch):
    real = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = ODD + real
    df = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string, pair int").repartition(40, "doc_id")
    got = rows_of(align_documents(df, A, B))
    for i, want in enumerate(slow_alignment(texts)):
        assert got[i] == want, (i, texts[i])


def test_texts_that_are_not_utf8_and_no_texts(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'ff41' AS string) AS text UNION ALL SELECT 2L, 'A'")
    got = rows_of(align_documents(df, A, B))
    assert got[1] == (0, 0, 0, 0, 0, 0, "") and got[2][0] == 1
    assert align_documents(df.limit(0), A, B).count() == 0


def test_query_digest(spark, sf_dir):
    row = op12_alignment(spark, sf_dir).filter("n_a > 0").first()
    assert len(row["groups_sha256"]) == 64 and row["n_links"] == row["n_groups"] >= row["n_best"]


def test_fast_encoder_equals_the_file(spark, sf_dir):
    enc = encoders(A, B)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    for t in filter(None, texts):
        assert alignment.encode_a(t.encode(), t, enc).tolist() == enc.a.encode(" " + t, add_special_tokens=False).ids
    assert [len(x.a) > 0 for x in aligned([b"a", None, b"", b"\xff", b"b c"], enc)] == [True, False, False, False, True]


def test_pair_bound_counts_suffixes():
    class Small:
        a_bytes, b_bytes = (b"a", b"ba", b"xy", b""), (b"a", b"cba", b"y")

    pairs = {(x, y) for x in Small.a_bytes for y in Small.b_bytes if x and y and (x.endswith(y) or y.endswith(x))}
    assert pair_bound(Small) == len(pairs)


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False) if n else np.zeros(0, np.int64)
    found = perfect_hash(np.concatenate([keys, keys[:5]]))
    assert len(found) == n and sorted(found.find(keys).tolist()) == list(range(n))
    others = np.random.default_rng(n + 1).integers(1 << 41, 1 << 42, 1_000)
    assert (found.find(others) == -1).all()


def test_count_vector_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "SLICE", 50)
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 400, 3_000), rng.integers(1, 9, 3_000)
    found = perfect_hash(keys)
    sent = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, counts)], "pair long, count long").repartition(31)
    want = np.zeros(len(found), np.int64)
    np.add.at(want, found.find(keys), counts)
    assert count_vector(sent, found).tolist() == want.tolist()
