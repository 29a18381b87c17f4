"""The other operators: their queries against SQL, and the defined cases."""

import collections
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from layerwood.llm.catalog import ORACLES, QUERIES
from layerwood.llm.chat import format_chat, read_chat, text_part
from layerwood.llm.contamination import decontaminate, item_windows, keyed, postings, proximity_matches, rarest_terms, term_counts
from layerwood.llm.langid import LanguageModel, fit_languages, identify, identify_languages
from layerwood.llm.mixing import fair_queue_mix
from layerwood.llm import neighbours
from layerwood.llm.neighbours import nearest
from layerwood.llm.toxicity import fit_toxicity, score_texts, toxicity_score
from layerwood.llm.warc import mark_revisits, read_archives, write_archives
from layerwood.session import new_path
from tools.check_oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, items string, score double"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(corpus_pipeline.QUERIES) - set(ORACLES) - {"op1_language", "op7_neighbours"}))
def test_query_has_rows(spark, sf_dir, name):
    rows = corpus_pipeline.QUERIES[name](spark, sf_dir).count()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0 < rows <= documents if name == "pipeline" else rows == documents


def test_guard_names_both_parts():
    import __spark_entry__

    assert set(corpus_pipeline.QUERIES) <= set(__spark_entry__.queries())


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0, 9, "x", 0.5) for r in rows], DOCS)


EDGE = [(1, "the cat and the dog sat down", "en", "a"), (1, "the cat and the dog sat down", "en", "a"), (2, None, None, None), (None, "", "", ""),
        (3, "der Hund und die Katze sitzen hier", "de", None), (4, "12 34 !!", "en", "b"), (5, "x" * 50_000, "en", "b"), (None, None, None, None)]


def test_languages(spark, sf_dir):
    docs = docs_of(spark, EDGE)
    model = fit_languages(docs)
    rows = {r["doc_id"]: r for r in identify_languages(docs, model).collect() if r["doc_id"] is not None}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "und", "de", "und"]
    assert rows[2]["score"] == 0 and 0 <= rows[1]["score"] <= 1 and rows[1]["size"] == 9
    assert identify_languages(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs, fit_languages(docs.limit(0))).collect()} == {"und"}
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op1_language"](spark, sf_dir).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_languages_with_a_common_opening(spark, sf_dir):
    # nothing but the opening stands in the first 1,024 characters
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 200").select(
        "doc_id", "lang", F.concat(F.lit("licence terms apply to every page of this work " * 30), "text").alias("text"))
    rows = identify_languages(real, fit_languages(real.filter("doc_id % 4 > 0"))).filter("doc_id % 4 = 0").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9


def test_long_texts_are_not_rejected():
    rng = np.random.default_rng(2)
    words = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(1500)] for lang, letters in (("a", "abcdefghik"), ("b", "efghiklmno"))}
    texts = {lang: " ".join(rng.choice(w, 220_000)) for lang, w in words.items()}
    model = LanguageModel(tuple((lang, " ".join(rng.choice(w, 9_000)).encode()) for lang, w in words.items()))
    for lang, text in texts.items():
        found, _, margin = identify(text, model)
        assert found == lang and margin >= model.min_margin


def test_toxicity(spark):
    rows = [(i, ("you idiot " if i % 3 == 0 else "kind ") + f"word{i} of text number {i * 7}", "en", "a") for i in range(200)]
    docs = docs_of(spark, rows + [(None, None, None, None), (900, "", "en", "a")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(3, 0), (None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    scored = docs.withColumn("got", toxicity_score(model, F.col("text"))).collect()
    assert all((r["got"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in scored if r["doc_id"] is not None and r["doc_id"] < 200)
    assert all(0 <= r["got"] <= 1 for r in scored)
    long = "kind " * 600_000 + "you idiot"
    alone = score_texts(["kind " * 20 + "you idiot", long], model)
    assert (alone >= 0.3).all()
    assert score_texts(["x", None], fit_toxicity(docs, labels.limit(0))).max() < 1e-6
    assert score_texts(["x", None], fit_toxicity(docs, labels.filter("toxic = 1"))).min() > 0.999


def test_toxicity_with_copies_of_one_text(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghmnoprstu"), 5)) for _ in range(n))
    rows = [(i, ("you idiot " if i % 4 == 0 else "kind ") + words(8), "en", "a") for i in range(240)]
    copied = words(900)
    docs = docs_of(spark, rows + [(1000 + i, copied, "en", "a") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(1000 + i, 1) for i in range(300)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = score_texts([r[1] for r in rows[160:]], model) >= 0.3
    assert (got == (np.arange(160, 240) % 4 == 0)).all()
    assert score_texts([copied], model)[0] >= 0.3


def filled(sizes):
    """Targets by pouring: repeat until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: 3.0 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", s) for i, s in enumerate(["hot"] * 300 + ["b"] * 60 + ["c"] * 5 + ["d"] * 8 + [None] * 30 + [""] * 3)]
    rows += rows[:4] + [(None, "a b c", None, "hot"), (7, None, None, None)]
    mixed = fair_queue_mix(docs_of(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = filled(sizes)
    assert all(np.isclose(r["target"], want[r["source"]]) for r in mixed) and len(mixed) == len(rows)
    assert np.isclose(sum(want.values()), sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= sum(sizes.values())
    again = fair_queue_mix(docs_of(spark, rows).repartition(5)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, mixed))
    assert fair_queue_mix(docs_of(spark, rows[:1]).limit(0)).count() == 0


def test_archives(spark):
    page = "<p>é</p>" * 200
    rows = [(1, "http://a/ b\n", page), (2, None, page), (2, None, page), (3, "u", "short"), (4, "u", "short"), (None, "u", page), (5, "u", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    path = new_path(spark, "warc-test")
    marked = mark_revisits(pages.drop("payload_digest"), "page_id", F.col("html"))
    write_archives(marked, "page_id", "url", path)
    got = sorted(((r["record_id"], r["url"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode() or b"" if r["payload"] is not None else None)
                  for r in read_archives(spark, path, split_bytes=64).collect()), key=repr)
    body = {i: h for i, _, h in rows}
    want = [(1, "http://a/ b\n", "revisit", 2, None), (2, None, "response", None, body[2]), (2, None, "response", None, body[2]),
            (3, "u", "response", None, "short"), (4, "u", "response", None, "short"), (None, "u", "revisit", 2, None), (5, "u", "response", None, b"")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = new_path(spark, "warc-test")
    write_archives(marked.limit(0), "page_id", "url", empty)
    assert read_archives(spark, empty).count() == 0


def test_contamination(spark):
    passage = " ".join(f"term{i}" for i in range(30))
    docs = docs_of(spark, EDGE + [(10, "Start " + passage.upper() + ", end", "en", "a"), (10, "Start " + passage.upper() + ", end", "en", "a"),
                                  (11, " ".join(passage.split()[:12]), "en", "a"), (12, "say hello world now hello world", "en", "a"),
                                  (13, "term0 filler filler term2 term1", "en", "a")])
    items = spark.createDataFrame([(1, passage), (1, "hello world"), (7, "Hello, World!"), (8, None), (None, "cat and"), (9, "")], "item_id long, text string")
    rows = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate(docs, items).collect())
    assert rows[(10, 32, 30, ("1",))] == 2 and rows[(12, 6, 4, ("1", "7"))] == 1 and rows[(11, 12, 0, ())] == 1
    assert rows[(1, 7, 2, ())] == 2 and rows[(2, 0, 0, ())] == 1 and sum(rows.values()) == docs.count()
    assert decontaminate(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate(docs, items.limit(0)).collect()} == {0}
    texts = keyed(docs, "doc_id", "text")
    windows = item_windows(items, "item_id", "text", 13)
    rare = rarest_terms(windows, term_counts(texts, windows.select(F.explode("words").alias("term")).distinct()))
    lists = postings(texts, rare.select(F.explode(F.array("term1", "term2")).alias("term")).distinct())
    near = proximity_matches(lists, rare, slop=4)
    assert near.filter("abs(pos1 - pos2) > 4").count() == 0 and near.count() > 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200 + i, [1.0] * 6) for i in range(60)]
    bad = [(300, None), (301, [0.0] * 6), (302, [float("nan")] + [1.0] * 5), (303, [None] + [1.0] * 5), (304, [float("inf")] * 6),
           (305, [1.0, 2.0]), (None, [1.0] * 6), (20, rows[20][1])]
    table = spark.createDataFrame([(*r, 1.0) for r in rows + bad], "vec_id long, embedding array<float>, score double")
    x, ids = np.array([v for _, v in rows], np.float32).astype(float), np.array([i for i, _ in rows])
    got = collections.defaultdict(list)
    for r in sorted(nearest(table, F.col("vec_id") % 20 == 0, leaf_rows=8).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for i, found in got.items():
        s = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:20]
        assert [f[0] for f in found] == ids[order].tolist() and np.allclose([f[1] for f in found], s[order])
    few = nearest(table.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["id"] for r in few) == [1, 2]
    assert nearest(table.limit(0), F.lit(True)).count() == nearest(table.filter("vec_id = 300"), F.lit(True)).count() == 0


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = QUERIES["op7_neighbours"](spark, sf_dir).toPandas()
    hits = total = 0
    for i, rows in got.groupby("query_id"):
        s = np.where(ids == i, -np.inf, x @ x[ids == i][0])
        best = set(ids[np.argsort(-s)[:20]])
        hits, total = hits + len(best & set(rows.vec_id)), total + len(best)
    assert hits / total >= 0.9


def test_neighbours_leaves_are_measured(spark):
    # points without structure: a fixed number of leaves finds few of the true neighbours
    x = np.random.default_rng(1).normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(table, F.col("vec_id") % 100 == 0, leaf_rows=16, search_leaves=20).toPandas()
    hits = 0
    for i, rows in got.groupby("query_id"):
        s = np.where(np.arange(len(x)) == i, -np.inf, x.astype(float) @ x[i].astype(float))
        hits += len(set(np.argsort(-s)[:20]) & set(rows["id"]))
    assert hits / (60 * 20) >= 0.9


def test_neighbours_queues_are_arrays():
    # the leaves in the order in which one queue over all trees hands them on
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    forest = [neighbours.grow(x, 9, seed) for seed in range(3)]
    asks = rng.normal(size=(5, 12)).astype(np.float32)
    far = neighbours.queues(forest, asks)
    start = np.cumsum([0] + [len(tree.cuts) + 1 for tree in forest])
    assert far.shape == (5, start[-1])
    for i, point in enumerate(asks):
        queue, seen = [(0.0, t, 0) for t in range(3)], []
        while queue:
            distance, t, node = heapq.heappop(queue)
            while node >= 0:
                side = float(forest[t].normals[node] @ point - forest[t].cuts[node])
                left, right = forest[t].children[node].tolist()
                heapq.heappush(queue, (max(distance, abs(side)), t, left if side >= 0 else right))
                node = right if side >= 0 else left
            seen.append((start[t] - node - 1, distance))
        places, distances = zip(*seen)
        assert sorted(places) == list(range(start[-1])) and np.allclose(far[i][list(places)], distances, atol=1e-5)
        assert all(far[i][neighbours.places_of(forest, point[None])[:, 0]] == 0)


def test_neighbours_floor_is_reached(spark):
    rng = np.random.default_rng(4)
    x, asks, most = rng.normal(size=(400, 8)), rng.normal(size=(30, 8)), 6
    sample = x.astype(np.float32)[:300]
    forest = [neighbours.grow(sample, 9, seed) for seed in range(3)]
    places = neighbours.places_of(forest, sample)
    near = rng.random((30, sum(len(tree.cuts) + 1 for tree in forest))) < 0.1
    near[0], near[1] = True, False
    floor = neighbours.known_floor(asks, near, sample, places, most)
    for i in range(30):
        inside = near[i][places].any(axis=0)
        assert (x[:300][inside] @ asks[i] >= floor[i]).sum() >= most or floor[i] == -np.inf
    assert np.isclose(floor[0], np.sort(x[:300] @ asks[0])[-most]) and floor[1] == -np.inf
    assert all(neighbours.known_floor(asks, near, sample[:5], places[:, :5], most) == -np.inf)


@pytest.mark.parametrize("floors", [True, False])
def test_neighbours_of_a_leaf(floors):
    # lengths of many sizes: what reaches the floor is scored in doubles, whatever the products in single precision say
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 7)) * 10.0 ** rng.integers(-60, 60, 90)[:, None]
    q = rng.normal(size=(40, 7)) * 10.0 ** rng.integers(-60, 60, 40)[:, None]
    scores, most, members = q @ x[10:80].T, 5, slice(10, 80)
    floor = np.sort(scores, axis=1)[:, -3] * (1 - 1e-9) if floors else np.full(40, -np.inf)
    rows = list(neighbours.best_of_leaf(q, neighbours.directions(q), x, neighbours.lengths(x[members]).max(), np.arange(40), members, floor, most))
    asker, member, score = (np.concatenate(part) for part in zip(*rows))
    for i in range(40):
        want = set(10 + np.argsort(-scores[i])[:3 if floors else most])
        got = set(member[asker == i].tolist())
        assert want <= got and all(score[asker == i] >= floor[i])
    assert np.allclose(score, np.einsum("ij,ij->i", q[asker], x[member]), rtol=1e-12)


def test_neighbours_buckets_hand_on_few(spark, monkeypatch):
    # many buckets: a query's points come from the leaves that hold its best, not most of them from every bucket
    monkeypatch.setattr(neighbours, "BUCKET_POINTS", 400)
    x = np.random.default_rng(3).normal(size=(3000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    handed, made = [], neighbours.candidates
    monkeypatch.setattr(neighbours, "candidates", lambda *given: handed.append(made(*given)) or handed[-1])
    rows = nearest(table, F.col("vec_id") % 100 == 0, search_leaves=10**6).toPandas()
    # 90 buckets and all leaves: 21 from each bucket would be 1,890 rows a query
    assert handed[0].count() <= 30 * 21 * 12
    for i, found in rows.sort_values("rank").groupby("query_id"):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        assert found["id"].tolist() == np.argsort(-s, kind="stable")[:20].tolist()


@pytest.mark.parametrize("size, kind", [(3e38, "float"), (1e150, "double"), (1e-150, "double")])
def test_neighbours_of_any_size(spark, size, kind):
    # numbers that the trees' single precision cannot hold, beside ordinary ones
    x = np.random.default_rng(11).uniform(-1, 1, (160, 6))
    x[:40] *= size
    x = x.astype(np.float32) if kind == "float" else x
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = collections.defaultdict(list)
    for r in sorted(nearest(table, F.col("vec_id") % 10 == 0, leaf_rows=8).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["id"], r["score"]))
    x = x.astype(np.float64)
    for i in range(0, 160, 10):
        score = np.einsum("ij,ij->i", x, np.repeat(x[i][None], 160, axis=0))
        assert got[i] == [(j, -s) for s, j in sorted((-s, j) for j, s in enumerate(score) if j != i)[:20]]


def test_neighbours_of_words(spark):
    # ids of text and vectors of doubles; some of them equal
    x = np.random.default_rng(5).normal(size=(150, 5)).round(1)
    x[100:] = x[:50]
    ids = [f"v{i:03d}" for i in range(150)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id string, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(nearest(table, F.col("vec_id").endswith("0"), leaf_rows=8).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["id"], r["score"]))
    assert sorted(got) == [i for i in ids if i.endswith("0")]
    for i, found in got.items():
        score = np.einsum("ij,ij->i", x, np.repeat(x[ids.index(i)][None], 150, axis=0))
        want = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:20]
        assert found == [(j, -s) for s, j in want]


def test_chat_parts(spark):
    rows = [(1, 2, "assistant", "a <|end|> \\s \\l <b"), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (None, None, None, None), (2, 0, "ass<istant", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", text_part(F.col("text")).alias("parts"))
    got = {r["conv_id"]: r for r in read_chat(format_chat(chats)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hi"), ("user", "hi"), ("assistant", "a <|end|> \\s \\l <b")]
    assert got[1]["loss_text"] == "a <|end|> \\s \\l <b" and [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert [tuple(t) for t in got[2]["turns"]] == [("ass<istant", "")]
    span = got[1]["loss_spans"][0]
    assert got[1]["formatted"][span["start"]:span["start"] + span["length"]] == "a \\l|end|> \\ss \\sl \\lb"
    mixed = spark.sql("""SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, array(
        named_struct('kind', 'text', 'text', 'look <', 'uri', null, 'size', null),
        named_struct('kind', 'image', 'text', null, 'uri', 'i.png', 'size', 2D),
        named_struct('kind', 'hologram', 'text', null, 'uri', 'h', 'size', null), null) AS parts""")
    row = format_chat(mixed).first()
    assert "look \\l<|image|><|other|>" in row["formatted"] and row["expanded_tokens"] == 2 + 512 + 1
    assert [(a["kind"], a["uri"], a["tokens"]) for a in row["attachments"]] == [("image", "i.png", 512), ("other", "h", 1)]
    assert format_chat(mixed.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    rng = np.random.default_rng(4)
    words = lambda: " ".join("".join(rng.choice(list("abcdefghmnoprstu"), 5)) for _ in range(12))
    rows = [(i, words(), "en", "ab"[i % 2]) for i in range(60)]
    near = "one two three four five six seven eight nine ten " * 6
    rows += [(100, near + "x", "en", "a"), (101, near + "y", "en", "a"), (100, near + "x", "en", "a"), (102, None, None, None), (None, "lonely text", None, None)]
    rows += [(i, f"{words()} you idiot {words()}", "en", "a") for i in range(200, 230)]
    bench = " ".join(f"bench{i}" for i in range(20))
    rows.append((300, bench, "en", "b"))
    passages = {n: " ".join("".join(rng.choice(list("abcdefghmnoprstu"), 6)) for _ in range(n)) for n in (20, 51, 63, 120)}
    # each stands in two documents that share nothing else, at different places
    for i, (n, passage) in enumerate(passages.items()):
        for side in range(2):
            around = " ".join(words() for _ in range(12))
            rows.append((400 + 2 * i + side, f"{around} {passage} {words()}" if side else f"{words()} {passage} {around}", "en", "a"))
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 200)) for i in [*range(60), *range(200, 230)]], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == corpus_pipeline.COLUMNS
        path = f"{folder}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        left.append(collections.Counter(r["doc_id"] for r in kept.collect()))
        if name == "repeated_passages":
            texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert not [i for i in left[0] if i is not None and 200 <= i < 230] and left[0][100] == 2
    assert left[1][100] == 1 and 101 not in left[1] and left[1][102] == left[1][None] == 1
    assert 300 in left[2] and 300 not in left[3] and all(left[3][i] == 1 for i in range(60))
    before = {r[0]: r[1] for r in rows}
    for i, (n, passage) in enumerate(passages.items()):
        for key in (400 + 2 * i, 401 + 2 * i):
            middle = passage[10:-10]
            assert (middle in texts[key]) == (n == 20), n
            assert len(texts[key]) >= len(before[key]) - len(passage) - 4
    assert all(texts[i] == before[i] for i in range(60))
    mixed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in mixed} <= set(left[3]) and all(r["copies"] >= 1 for r in mixed)


def test_repeats_stage_cuts_once(spark, tmp_path):
    # a second run of the cutting holds a second worker per task
    rng = np.random.default_rng(6)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghmnoprstu"), 6)) for _ in range(n))
    passage, whole, clean = words(60), words(50), words(80)
    rows = [(1, f"left é {passage}"), (2, f"{passage}€ right"), (3, whole), (4, whole), (4, whole), (5, clean), (6, None), (7, ""), (None, f"{whole}!")]
    docs = spark.createDataFrame([(*r, "en", "a", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_repeats(spark, docs, str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect())
    assert got == collections.Counter([(1, "left é ", 7), (2, "€ right", 7), (5, clean, len(clean)), (6, None, 0), (7, "", 0), (None, "!", 1)])


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("scores", [4_000_000, 500])
def test_neighbours_at_ties(spark, scores, monkeypatch):
    # products of signs tie all the time; ids have to decide
    monkeypatch.setattr(neighbours, "SCORES", scores)
    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 1.0], (700, 10))
    ids = rng.permutation(700)
    rows = nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0,
                   search_leaves=10**6).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        score = x @ x[ids == q][0]
        want = sorted((-s, int(i)) for s, i in zip(score, ids) if i != q)[:20]
        assert found == [(i, -s) for s, i in want]
