"""op2, op4 and op8 against brute force, and the sorting they rest on."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from layerwood.llm import jaccard, repeats, scoring, suffixes, warc
from layerwood.llm.components import components
from layerwood.llm.jaccard import jaccard_join
from layerwood.llm.repeats import remove_repeats
from layerwood.llm.scoring import score_documents
from layerwood.llm.text import BLANK, LOWER, cut_words, handing_back, hash_words, joined
from layerwood.session import ARROW_ROWS, materialize, short_batches

SCHEMA = "doc_id long, text string, score double, kept string, class_id string, n_words int"
WORDS = "la le the of and ere ting sho ber ka mi no pu ra".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = sentence(rng, 300), sentence(rng, 120)
    out = [None, "", "   ", "one", "Two words", base, base, base.upper(), passage * 2, "ab" * 900, "é" * 500 + passage]
    for i in range(12):
        words = base.split()
        for at in rng.sample(range(len(words)), i):
            words[at] = "changed"
        out.append(" ".join(words))
    out += [sentence(rng, rng.randint(1, 80)) + " " + passage + " " + sentence(rng, 20) for _ in range(6)]
    out += [sentence(rng, rng.randint(0, 150)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1.0, "k", "c", 3) for i, t in enumerate(texts)]
    rows += [(None, texts[5], None, None, None, None), (5, texts[5], 1.0, "k", "c", 3), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def by_row(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_short_batches(spark):
    @handing_back
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(ARROW_ROWS)
    rows = spark.range(0, 5_000, 1, 2).mapInArrow(sizes, "n long")
    with short_batches(spark, 300):
        held = [r["n"] for r in materialize(rows, "sizes").collect()]
    assert max(held) <= 300 and sum(held) == 5_000 and spark.conf.get(ARROW_ROWS) == before
    with pytest.raises(KeyError), short_batches(spark, 300):
        raise KeyError
    assert spark.conf.get(ARROW_ROWS) == before


def test_words_and_hashes():
    column = pa.array(["Ab  cd", None, "", "cd", " x\ty "])
    flat, starts = joined(column)
    flat = LOWER[flat]
    begins, ends = cut_words(flat, starts, BLANK)
    assert [bytes(flat[b:e]) for b, e in zip(begins, ends)] == [b"ab", b"cd", b"cd", b"x", b"y"]
    h = hash_words(flat, begins, ends)
    assert h[1] == h[2] and len(set(h.tolist())) == 4


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice([[0, 1], [97, 98]][rng.random() < 0.5]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    strings += [b"a" * 70 + s for s in strings] + [b"", b"", b"\0", b"a" * 100]
    group = np.array([i % 3 for i in range(len(strings))])
    order, shared = suffixes.deep_shallow(group, strings, 160, 16)
    place = [(group[i], strings[i]) for i in order]
    assert place == sorted(place)
    for at in range(1, len(order)):
        a, b = order[at - 1], order[at]
        want = -1 if group[a] != group[b] else suffixes.common(strings[a], strings[b])
        assert shared[at] == want


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard_join(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    smallest = {}
    for i, r in enumerate(rows):
        ids = smallest.setdefault(top(i), [])
        ids += [r.doc_id] if r.doc_id is not None else []
    want = collections.Counter((r.doc_id, min(smallest[top(i)], default=None), links[i]) for i, r in enumerate(rows))
    assert by_row(jaccard_join(docs).collect(), "doc_id", "class_id", "n_links") == want


def test_jaccard_join_in_many_blocks(docs, monkeypatch):
    whole = by_row(jaccard_join(docs).collect(), "doc_id", "class_id", "n_links")
    for name, value in (("SMALL", 2), ("DEPTH", 2), ("BLOCK_SETS", 3), ("BLOCK_SHINGLES", 700), ("STRIP", 2)):
        monkeypatch.setattr(jaccard, name, value)
    assert by_row(jaccard_join(docs).collect(), "doc_id", "class_id", "n_links") == whole


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_of(texts, length=400):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        yield sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(d, gone) if not g)


@pytest.mark.parametrize("most", [20_000, 1])
def test_remove_repeats(docs, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), n, bytes(k)) for r, (_, n, k) in zip(rows, repeats_of([r.text for r in rows])))
    got = remove_repeats(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], len(r["spans"] or []), bytes(r["kept"])) for r in got) == want
    assert set(docs.columns) - {"kept"} <= set(got[0].asDict())


@pytest.mark.parametrize("length", [64, 224])
def test_remove_repeats_of_other_lengths(docs, length, monkeypatch):
    # every core and context that repeats takes the way of frequent ones
    monkeypatch.setattr(repeats, "SHARES", 10**9)
    monkeypatch.setattr(repeats, "LEAST_HOT", 1)
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, n, bytes(k)) for r, (_, n, k) in zip(rows, repeats_of([r.text for r in rows], length)))
    got = remove_repeats(docs, length=length).collect()
    assert collections.Counter((r["doc_id"], len(r["spans"] or []), bytes(r["kept"])) for r in got) == want


def test_remove_repeats_in_segments(docs, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, bytes(k)) for r, (_, n, k) in zip(rows, repeats_of([r.text for r in rows])))
    assert collections.Counter((r["doc_id"], bytes(r["kept"])) for r in remove_repeats(docs, send_bytes=0).collect()) == want


def slow_model(texts):
    """Contexts of up to ORDER bytes: counts in the longest, kinds of longer contexts in the others."""
    order, seen = scoring.ORDER, [collections.defaultdict(collections.Counter) for _ in range(scoring.ORDER + 1)]
    for t in texts:
        line = b"\xff" * order + t + b"\xff"
        for i in range(order, len(line)):
            seen[order][line[i - order:i]][line[i]] += 1
    for k in range(order - 1, -1, -1):
        for context, symbols in seen[k + 1].items():
            for s in symbols:
                seen[k][context[1:]][s] += 1
    return seen


def slow_score(seen, t):
    order, total, e = scoring.ORDER, 0.0, scoring.ESCAPE
    line = b"\xff" * order + t + b"\xff"
    for i in range(order, len(line)):
        excluded, symbol = set(), line[i]
        for k in range(order, -1, -1):
            symbols = {s: n for s, n in seen[k].get(line[i - k:i], {}).items() if s not in excluded}
            if not symbols:
                continue
            n = sum(symbols.values())
            if symbol in symbols:
                total += math.log10((symbols[symbol] - e) / n)
                break
            total += math.log10(e * len(symbols) / n)
            excluded |= set(symbols)
        else:
            total += math.log10(1 / (256 - len(excluded)))
    return total


@pytest.mark.parametrize("chunk", [16 << 20, 900])
def test_score_documents(docs, chunk, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(scoring, "CHUNK", chunk)
    monkeypatch.setattr(scoring, "BLOCK", chunk // 2)
    rows = docs.select("doc_id", "text").collect()
    data = [(r.text or "").translate({i: i + 32 for i in range(65, 91)}).encode() for r in rows]
    train = [r.doc_id is not None and r.doc_id % 3 > 0 for r in rows]
    count = collections.Counter(w for d, t in zip(data, train) if t for w in [*d.split(), None])
    n, v, model = sum(count.values()), len(count), slow_model([d for d, t in zip(data, train) if t])
    want = sorted((str(r.doc_id), len(d.split()) + 1, sum(count[w] > 0 for w in [*d.split(), None]), n,
                   round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*d.split(), None]), 4), round(slow_score(model, d), 2))
                  for r, d in zip(rows, data))
    got = score_documents(docs, F.col("doc_id") % 3 > 0).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 2)) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-5, atol=0.02)


def test_model_is_a_distribution():
    seen = slow_model([b"abracadabra", b"bar"])
    start = [slow_score(seen, bytes([c])) for c in range(255)] + [slow_score(seen, b"")]
    after = [slow_score(seen, b"abr" + bytes([c])) - slow_score(seen, b"abr") for c in range(255)]
    assert len(start) == 256 and all(s < 0 for s in start) and len(after) == 255


def test_without_training_rows(docs):
    from pyspark.sql import functions as F

    rows = score_documents(docs, F.lit(False)).collect()
    assert all(math.isclose(r["score"], -(len((r_text(docs, r) or "").encode()) + 1) * math.log10(256), rel_tol=1e-4) for r in rows[:1] if r["doc_id"])
    assert {r["n_known"] for r in rows} == {0} and {r["train_tokens"] for r in rows} == {0}


def r_text(docs, row):
    return docs.filter(docs.doc_id == row["doc_id"]).first()["text"]


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(none).count() == remove_repeats(none).count() == score_documents(none, F.lit(True)).count() == 0


def test_records_at_every_split(tmp_path):
    rng = random.Random(1)
    records, place = [], tmp_path / "a.warc.gz"
    for i in range(12):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))) + warc.MAGIC + bytes(rng.randrange(256) for _ in range(9))
        records.append(warc.record_bytes(i, "response", "http://x/\n", None, hashlib.sha1(payload).hexdigest(), len(payload), payload))
    place.write_bytes(b"".join(map(warc.member_of, records)) + warc.EMPTY_MEMBER)
    size = place.stat().st_size
    for split in (1, 7, 100, 1000, size):
        with place.open("rb") as file:
            got = [r for start in range(0, size, split) for r in warc.records_in(file, start, min(start + split, size))]
        assert got == records
