"""Near duplicates, search and batch inference."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketmill.functions import fixed_values as V
from ticketmill.functions.text import words
from ticketmill.operators import evaluate as E
from ticketmill.operators import inference as I
from ticketmill.operators import neardup as N
from ticketmill.operators import retrieval as R
from ticketmill.operators.profile import METRICS
from ticketmill.session import scratch_path
from ticketmill.sources.readers import scan_csv_tickets


# --- near duplicates against brute force


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}


def cosine(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / math.sqrt(len(a) * len(b))


def brute_clusters(docs, threshold=0.92):
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x) in enumerate(docs):
        for j, y in docs[n + 1 :]:
            if cosine(x, y) >= threshold:
                a, b = sorted([find(i), find(j)])
                root[b] = a
    named = {i: find(i) for i, _ in docs}
    big = {c for c in named.values() if list(named.values()).count(c) > 1}
    return {i: c for i, c in named.items() if c in big}


def family(rng, n, size, prefix=""):
    """Near copies of one text: each has some words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(prefix + " ".join(words))
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(7)
    texts = family(rng, 60, 80) + family(rng, 60, 80) + family(rng, 20, 30, "same start here ")
    texts += ["one two three four five six"] * 90  # copies
    texts += [" ".join(f"r{rng.randrange(50)}" for _ in range(40)) for _ in range(40)]
    texts += ["a", "a b", "a b", "a b c d", "..."]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_clusters_equal_brute_force(spark, documents):
    worded = [(i, t) for i, t in documents if t != "..."]
    df = spark.createDataFrame(documents, "id int, text string")
    found = {r["id"]: r["cluster"] for r in N.near_clusters(df, "id", "text").collect()}
    assert found == brute_clusters(worded)


def test_edges_are_real_and_few(spark, documents):
    df = spark.createDataFrame(documents, "id int, text string")
    edges = N.near_pairs(df, "id", "text").collect()
    texts = dict(documents)
    assert all(abs(cosine(texts[e["a"]], texts[e["b"]]) - e["cosine"]) < 1e-9 for e in edges)
    assert all(e["a"] < e["b"] and e["cosine"] >= 0.92 - 1e-12 for e in edges)
    # 90 copies alone would be 4005 pairs
    copies = [i for i, t in documents if t.startswith("one two")]
    assert sum(e["a"] in copies for e in edges) == len(copies) - 1


def candidates(spark, texts):
    """How many pairs are looked up, with leaders and between clusters, and the clusters."""
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    unique, _ = N.collapse_copies(N.shingle_sets(df, "id", "text"))
    lists = N.prefix_postings(unique, 0.92).persist()
    led = N.leader_pairs(lists, 0.92).persist()
    clusters = N.connected_components(N._verified(led, unique, 0.92))
    return led.count(), N.cluster_pairs(lists, clusters, 0.92).count()


def test_a_phrase_of_many_families_gives_no_pairs_between_them(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(200):
        texts += family(rng, 25, 60, "we are happy to help you with any further question ")
    led, between = candidates(spark, texts)
    assert led <= 2 * len(texts) and between <= 20 * len(texts)


def test_texts_of_one_template_are_not_compared_with_each_other(spark):
    rng = random.Random(12)
    template = " ".join(f"t{i}" for i in range(200))
    texts = [template + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(25)) for _ in range(3000)]
    led, between = candidates(spark, texts)
    assert led + between <= len(texts)


def test_versions_that_change_step_by_step_are_one_cluster(spark):
    rng = random.Random(13)
    words, texts = [f"w{i}" for i in range(150)], []
    for _ in range(120):
        words[rng.randrange(150)] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "id int, text string")
    found = {r["id"]: r["cluster"] for r in N.near_clusters(df, "id", "text").collect()}
    assert found == brute_clusters(docs) and len(found) == 120


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a int, b int")
    found = {r["id"]: r["cluster"] for r in N.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_no_edges_no_components(spark):
    assert N.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_keep_best(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aaaa"), (3, "bbbb"), (4, "c")], "id int, text string")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, cluster int")
    best = N.keep_best(df, clusters, "id", "text")
    assert sorted(r["id"] for r in best.collect()) == [2, 4]


# --- search


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["reset my password", "billing invoice wrong", "password reset link", "", "server down"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "corpus_id bigint, text string")
    return R.embed(df, "text")


def queries_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id bigint, text string")
    return R.embed(df, "text")


def test_scores_and_ranks(spark, corpus):
    queries = queries_of(spark, "password", "invoice & billing", "été server")
    near = R.vector_topk(corpus, queries, 3)
    assert {r["corpus_id"] for r in near.filter("query_id = 0 and rank <= 2").collect()} == {0, 2}
    assert [r["corpus_id"] for r in near.filter("rank = 1").orderBy("query_id").collect()][1:] == [1, 4]


def test_k_above_corpus_size_and_default(spark, corpus):
    queries = queries_of(spark, "password")
    assert R.vector_topk(corpus, queries, 50).count() == 5
    assert R.vector_topk(corpus, queries, 0).count() == 5


def test_vectors_are_cut_into_blocks_by_their_bytes(spark, monkeypatch):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    docs = spark.createDataFrame([(i, vector()) for i in range(100)], "corpus_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, vector()) for i in range(20)], "query_id bigint, embedding array<double>")
    exact = sorted(map(tuple, R.vector_topk(docs, asked, 4).collect()))
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 8 * 7)
    assert sorted(map(tuple, R.vector_topk(docs, asked, 4).collect())) == exact
    everywhere = R.vector_topk_approx(docs, asked, 4, cells=5)
    assert sorted(map(tuple, everywhere.collect())) == exact
    assert R.compared_with_corpus(docs, asked).agg(F.sum("n_compared")).first()[0] == 2000
    sampled = R.build_cells(docs, sample=30).search(asked, 4)
    assert sorted(map(tuple, sampled.collect())) == exact


def gathered(n, dims, centres, spread, seed=1):
    """Vectors around centres, as rows of doubles."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dims)) * spread
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame_of(spark, ids, rows, name):
    table = pa.table({name: pa.array(ids, pa.int64()), "embedding": pa.array(list(rows))})
    return spark.createDataFrame(table)


def test_bounds_find_all_hits_and_compare_few_rows(spark):
    rows = gathered(100_000, 32, 300, 0.35)
    asked = gathered(100_050, 32, 300, 0.35)[100_000:]
    index = R.build_cells(frame_of(spark, range(len(rows)), rows, "corpus_id"))
    queries = frame_of(spark, range(len(asked)), asked, "query_id")
    partial = index.compare(queries, 8).persist()
    compared = partial.agg(F.sum("compared")).first()[0]
    assert compared < 0.2 * len(rows) * len(asked)
    scores = asked @ rows.T
    best = {q: set(np.argsort(-s, kind="stable")[:8].tolist()) for q, s in enumerate(scores)}
    found = {q: set() for q in best}
    for r in index.search(queries, 8).collect():
        found[r["query_id"]].add(r["corpus_id"])
    assert found == best
    # Misses that are allowed save more rows, and no query misses more than that.
    loose = index.compare(queries, 8, recall=0.5)
    assert loose.agg(F.sum("compared")).first()[0] <= compared
    hits = index.search(queries, 8, recall=0.5).groupBy("query_id").agg(F.collect_set("corpus_id").alias("ids"))
    assert all(len(best[r["query_id"]] & set(r["ids"])) >= 4 for r in hits.collect())


def test_where_no_bound_helps_every_row_is_compared(spark):
    rng = np.random.default_rng(3)
    rows, asked = (rng.normal(size=(n, 48)) for n in (3000, 40))
    docs = frame_of(spark, range(3000), rows, "corpus_id")
    queries = frame_of(spark, range(40), asked, "query_id")
    got = R.vector_topk_approx(docs, queries, 5, cells=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.vector_topk(docs, queries, 5).collect()))


def test_cells_with_attributes_ties_zero_vectors_and_too_few_rows(spark):
    rows = [(i, [float(i % 7), 1.0], "ab"[i % 2]) for i in range(60)]
    rows += [(100, [0.0, 0.0], "a"), (101, None, "a"), (102, [1.0, 1.0], None), (103, [2.0, 2.0], "c")]
    docs = spark.createDataFrame(rows, "corpus_id bigint, embedding array<double>, kind string")
    asked = [(1, [3.0, 1.0], "a"), (2, [1.0, -1.0], "b"), (3, [1.0, 1.0], "c"), (4, [0.0, 0.0], "a"), (5, [1.0, 0.0], None)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>, kind string")
    usable = docs.filter("embedding IS NOT NULL")
    for k in (1, 6, 40):
        exact = sorted(map(tuple, R.vector_topk(usable, queries, k, ["kind"]).collect()))
        assert sorted(map(tuple, R.vector_topk_approx(docs, queries, k, ["kind"], cells=4).collect())) == exact
    assert R.vector_topk_approx(docs.limit(0), queries, 3).count() == 0
    silent = docs.filter("corpus_id = 100")
    assert [r["score"] for r in R.vector_topk_approx(silent, queries, 3).collect()] == [0.0] * 4


def test_queries_without_words_have_no_hits(spark, corpus):
    queries = queries_of(spark, "password", "", "!! ?", None)
    for search in (R.vector_topk, R.vector_topk_approx):
        hits = search(corpus, queries, 2)
        assert {r["query_id"] for r in hits.collect()} == {0}
        lists = R.retrieve_text_chunks(queries, hits, corpus, "text").orderBy("query_id").collect()
        assert [len(r["chunks"]) for r in lists] == [2, 0, 0, 0]


def test_filters_on_several_attributes_in_one_pass(spark, corpus):
    language = F.when(F.col("corpus_id") < 3, "en").otherwise("de")
    index = corpus.withColumns({"language": language, "type": F.lit("bug")})
    wanted = F.when(F.col("query_id") == 1, "de").when(F.col("query_id") == 2, "xx").otherwise("en")
    kind = F.when(F.col("query_id") == 3, F.lit(None)).otherwise("bug")
    queries = queries_of(spark, "password", "server", "password", "password").withColumns(
        {"language": wanted, "type": kind}
    )
    hits = R.vector_topk(index, queries, 9, ["language", "type"]).collect()
    found = {q: {r["corpus_id"] for r in hits if r["query_id"] == q} for q in range(4)}
    assert found == {0: {0, 1, 2}, 1: {3, 4}, 2: set(), 3: set()}


def test_the_default_search_of_whole_tables_finds_enough(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["mail", "login", "disk", "screen", "invoice", "cable"], k=6)) for _ in range(300)]
    articles = spark.createDataFrame(list(enumerate(texts)), "corpus_id bigint, text string")
    tickets = spark.createDataFrame([(i, texts[i * 7]) for i in range(40)], "ticket_id bigint, issue_description string")
    answers = I.answer_tickets(tickets, articles, k=1).collect()
    same = sum(sorted(r["retrieved_context"][0].split()) == sorted(r["issue_description"].split()) for r in answers)
    assert len(answers) == 40 and same == 40
    index = R.build_cells(R.embed(articles, "text").withColumn("language", F.lit("xx")), ["language"])
    foreign = I.answer_tickets(tickets, articles, index, k=1)
    assert foreign.filter(F.size("retrieved_context") > 0).count() == 0


def test_a_stored_index_is_read_in_part(spark, corpus):
    path = scratch_path(spark, "index")
    R.write_index(corpus.withColumn("language", F.lit("en")), path)
    index = R.read_index(spark, path, ["corpus_id", "embedding"])
    assert index.columns == ["corpus_id", "embedding"]
    assert "text" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_refresh_embeds_only_changes(spark):
    def source(*texts):
        return spark.createDataFrame(list(texts), "id bigint, text string")

    old = R.build_search_index(source((1, "a"), (2, "b"), (3, "c")), "id", "text", [])
    fresh = R.refresh_index(old, source((1, "a"), (2, "changed"), (4, "new")), "id", "text", [])
    assert {r["id"]: r["refreshed"] for r in fresh.collect()} == {1: False, 2: True, 4: True}


def test_chunks_overlap_and_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "x"), (3, "")], "id int, text string")
    chunks = R.chunk_documents(df, "id", "text", [], 300, 50).orderBy("id", "chunk_no").collect()
    first = [c["chunk_text"] for c in chunks if c["id"] == 1]
    assert first[0] + "".join(c[50:] for c in first[1:]) == text
    assert [c["chunk_text"] for c in chunks if c["id"] != 1] == ["x"]


# --- batch inference


def test_one_bad_prompt_costs_its_own_row(spark):
    def moody_client():
        def complete(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return complete

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "fine")], "id int, p string")
    done = I.batch_complete(df, {"a": F.col("p"), "b": F.col("p")}, moody_client, batch_size=4)
    found = {r["id"]: (r["a"], r["b"], r["errors"]) for r in done.collect()}
    assert found[1] == ("OK", "OK", None) and found[4] == ("FINE", "FINE", None)
    assert found[2] == (None, None, "ValueError: no") and found[3] == (None, None, None)


def test_equal_prompts_are_asked_once(spark):
    def counting_client():
        asked = []

        def complete(prompts):
            asked.extend(prompts)
            return [f"{p}:{asked.count(p)}" for p in prompts]

        return complete

    rows = [(i, p) for i, p in enumerate(["same"] * 50 + ["other", None, ""])]
    df = spark.createDataFrame(rows, "id int, p string")
    done = I.batch_complete(df, {"a": F.col("p")}, counting_client, share_answers=True)
    found = {r["id"]: r["a"] for r in done.collect()}
    assert len(found) == 53 and set(found.values()) == {"same:1", "other:1", ":1", None}


def test_a_prompt_is_sent_once(spark, tmp_path):
    """Whatever is done with the answers: the calls are written down as they are made."""
    calls = str(tmp_path / "calls")

    def client():
        def complete(prompts):
            with open(calls, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [p.upper() for p in prompts]

        return complete

    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id int, p string")
    done = I.batch_complete(df, {"a": F.col("p")}, client)
    assert done.filter("a is not null").count() == 10
    assert done.filter("a like 'P%'").join(done.withColumnRenamed("a", "b"), "id").count() == 10
    with open(calls) as f:
        assert sorted(f.read().split()) == sorted(f"p{i}" for i in range(10))


def test_failures_stay_visible(spark):
    def broken():
        def complete(prompts):
            raise ConnectionError("gone")

        return complete

    df = spark.createDataFrame([("it broke", "en")], "issue_description string, language string")
    row = I.understand_tickets(df, broken).first()
    assert (row["topic"], row["priority_level"]) == ("other", "LOW")
    assert row["topic_error"] == row["priority_error"] == "ConnectionError: gone"
    assert I.classify_topic_intent(df, broken).first()["topic_error"] == "ConnectionError: gone"
    assert I.evaluate_priority(df, broken).first()["priority_error"] == "ConnectionError: gone"


def test_model_answers_are_cleaned(spark):
    def client():
        return lambda prompts: ["Cleaned: fixed" for _ in prompts]

    df = spark.createDataFrame([("b", "a")], "body string, answer string")
    assert I.rewrite_tickets(df, client).first()["cleaned_answer"] == "fixed"


def test_model_labels(spark):
    def client():
        return lambda prompts: ['so {"topic": "bug"}' if "JSON" in p else "very urgent!" for p in prompts]

    df = spark.createDataFrame([("it broke", "en"), ("kaputt", "fr")], "issue_description string, language string")
    out = I.evaluate_priority(I.classify_topic_intent(df, client), client)
    assert {(r["topic"], r["intent"], r["priority_level"]) for r in out.collect()} == {("bug", "question", "URGENT")}


def test_plain_files_are_split(spark):
    path = scratch_path(spark, "csv")
    spark.range(20_000).selectExpr("id", "repeat('x', 100) AS text").coalesce(1).write.option("header", "true").csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 * 1024)
    try:
        split = scan_csv_tickets(spark, path, "id bigint, text string", line_breaks=False)
        whole = scan_csv_tickets(spark, path, "id bigint, text string")
        assert split.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- bounds of workers and of what is moved


def test_sets_are_made_some_words_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 3, 70, 0, 5, 12, 40, 0)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([t.tolist() for t in texts], pa.list_(pa.int64()))], ["id", "hashed"]
    )
    whole = list(N._described(iter([batch])))
    monkeypatch.setattr(N, "WORDS_AT_A_TIME", 20)
    parts = list(N._described(iter([batch])))
    assert len(whole) == 1 and len(parts) >= 4
    assert pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()
    assert [r["id"] for r in whole[0].to_pylist()] == [1, 2, 3, 4, 6, 7, 8]


def test_shingles_are_moved_once_and_sets_are_not(spark, documents):
    df = spark.createDataFrame(documents, "id int, text string")
    unique, _ = N.collapse_copies(N.shingle_sets(df, "id", "text"))
    assert "Exchange hashpartitioning(digest" not in unique._jdf.queryExecution().executedPlan().toString()
    lists = N.prefix_postings(unique, 0.92)
    lists.collect()
    final = lists._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange .*REPARTITION_BY_COL", final)


@pytest.mark.parametrize("few", [0, 10**6])
def test_repeated_rows_and_missing_ids_of_copies(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_COPIES", few)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (9, text), (9, text), (7, text + " w40"), (7, text + " w40"), (3, "alone in this")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {(r["id"], r["cluster"]) for r in N.near_clusters(df, "id", "text").collect()} == {(5, 5), (7, 5), (9, 5)}
    assert N.collapse_copies(N.shingle_sets(df, "id", "text"))[0].count() == 3


def test_a_call_has_prompts_of_a_bounded_batch(spark):
    def make_client():
        return lambda prompts: [str(len(prompts))] * len(prompts)

    df = spark.range(0, 200, 1, 1).withColumn("text", F.repeat(F.lit("x"), 200_000))
    sizes = [int(r["a"]) for r in I.batch_complete(df, {"a": F.col("text")}, make_client).select("a").collect()]
    assert len(sizes) == 200 and max(sizes) <= 22


def test_the_four_prompts_of_a_row_share_a_bounded_batch(spark):
    """Also where calls fail: a failing prompt has the prompts of its call asked one by one."""

    def make_judge():
        def judge(prompts):
            if any("!!" in p for p in prompts):
                raise TimeoutError("no answer")
            return [f'{{"score": 1, "explanation": "{len(prompts)}"}}'] * len(prompts)

        return judge

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 100, 1, 1).select(
        F.col("id").alias("ticket_id"),
        F.lit("why").alias("query"),
        F.lit("so").alias("ground_truth"),
        F.when(F.col("id") == 50, "so!!").otherwise("so").alias("agent_answer"),
        F.repeat(F.lit("x "), 50_000).alias("context"),
    )
    found = {r["ticket_id"]: r for r in E.score_batch(df, make_judge).collect()}
    # Three prompts of a row hold 100 kB of context: 4 MB are 14 rows.
    assert len(found) == 100
    asked = [r[f"{m}_explanation"] for r in found.values() for m in METRICS if r[f"{m}_parse_ok"]]
    assert len(asked) == 398 and max(map(int, asked)) <= 14
    bad = found.pop(50)
    assert bad["judge_error"] == "TimeoutError: no answer" and not bad["faithfulness_parse_ok"]
    assert bad["faithfulness_explanation"] == V.INVALID_RESPONSE and bad["context_recall_parse_ok"]
    assert all(r["judge_error"] is None and r["average_score"] == 1 for r in found.values())


def test_embedding_gets_bounded_batches(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 60, 1, 1).withColumn("text", F.repeat(F.lit("word "), 50_000))
    assert R.embed(texts, "text").filter("abs(embedding[%d] - 1) < 1e-12" % R.word_bucket("word")).count() == 60
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


@pytest.mark.parametrize("n,asked", [(0, 3), (1, 3), (300, 40), (5000, 130)])
def test_tiles_find_what_single_products_find(monkeypatch, n, asked):
    monkeypatch.setattr(R, "TILE_SCORES", 40_000)
    rng = np.random.default_rng(n)
    block = rng.random((n, 16)) ** 2
    block[n // 2 :] = block[: n - n // 2]  # ties, in order of the id
    ids, queries = rng.permutation(n), rng.random((asked, 16))
    found = R._nearest(ids, block, queries, 8)
    plain = [R._best(ids, block @ q, 8) for q in queries]
    assert [(a.tolist(), s.tolist()) for a, s in found] == [(a.tolist(), s.tolist()) for a, s in plain]


def test_tasks_of_a_search_follow_the_pairs(spark):
    schema = "_cell bigint, _shards bigint, _rows bigint, _stripes bigint, _asked bigint"
    rows = R.BLOCK_BYTES // (8 * 64)

    def tasks(shards, stripes):
        row = (1, shards, shards * rows, stripes, stripes * rows)
        return R._tasks(spark.createDataFrame([row], schema), 64)

    assert tasks(1, 1) == 1 and tasks(2, 3) == 6 and tasks(100, 50) == 5000


def test_texts_are_cut_and_hashed_as_words_are(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "Ünd ÜND und", "a\x0bb\x00c", "x" * 55 + " " + "y" * 56 + " " + "ß" * 300, "end ", "日本語 テキスト,a-b_c"]
    texts += ["".join(rng.choices("aB .é日-\n", k=rng.randrange(150))) for _ in range(300)]
    texts += [" ".join("w" * n for n in range(70))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = R.embed(df, "text").withColumn("words", words(F.col("text"))).collect()
    assert len(got) == len(texts)
    for r in got:
        counted = np.zeros(R.DIMS)
        for w in r["words"] or []:
            counted[R.word_bucket(w)] += 1
        assert r["embedding"] == (counted / max(np.sqrt((counted**2).sum()), 1)).tolist(), r["text"]
    # Lists of words are neither made by a pattern nor sent.
    assert "split(" not in R.embed(df, "text")._jdf.queryExecution().executedPlan().toString()


def test_near_ties_and_copies_are_told_apart():
    """Scores nearer to each other than 32-bit products can tell, and vectors that come many times."""
    rng = np.random.default_rng(8)
    middle = np.abs(rng.normal(size=64))
    block = middle + rng.normal(size=(3000, 64)) * 1e-6
    block[500:1500] = block[0]
    block[2000:2300] = block[1]
    block[40:44] = 0
    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)
    ids = rng.permutation(3000)
    ids[600:700] = 5  # rows that repeat an id
    queries = np.concatenate([block[[0, 1, 3]], np.abs(rng.normal(size=(600, 64)))])
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    plain = [R._best(ids, block @ q, 8) for q in queries]
    for floors in (None, np.array([s[-1] for _, s in plain])):
        owner, own, scores = R._hits(ids, block, queries, 8, floors)
        assert owner.tolist() == np.repeat(np.arange(603), 8).tolist()
        assert own.tolist() == np.concatenate([i for i, _ in plain]).tolist()
        assert np.abs(scores - np.concatenate([s for _, s in plain])).max() < 2e-9
    assert len(R._without_more_copies(ids, block, 8)) == 3000 - 1001 + 8 - 301 + 8


def test_blocks_leave_out_what_k_rows_are_known_to_beat(spark):
    rows, asked = gathered(400, 16, 20, 0.5), gathered(410, 16, 20, 0.5)[400:]
    docs, queries = frame_of(spark, range(400), rows, "corpus_id"), frame_of(spark, range(10), asked, "query_id")
    floors = np.sort(asked @ rows.T, axis=1)[:, -3]
    known = spark.createDataFrame(list(enumerate(floors.tolist())), "query_id bigint, _floor double")
    got = R.block_scores(docs, queries.join(known, "query_id"), 8)
    assert got.filter("corpus_id IS NOT NULL").count() == 30
    assert got.agg(F.sum("compared")).first()[0] == 4000


def test_a_few_large_blocks_are_cut_for_all_cores(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAST_PAIRS", 1 << 10, raising=False)
    rows = spark.range(1000).selectExpr("id AS corpus_id", "IF(id < 900, 'en', 'de') AS lang")
    asked = spark.range(200).selectExpr("id AS query_id", "IF(id < 150, 'en', 'de') AS lang")
    grid = {r["lang"]: r for r in R._grid(rows, asked, ["lang"], 64).collect()}
    assert grid["en"]["_shards"] * grid["en"]["_stripes"] >= spark.sparkContext.defaultParallelism
    assert grid["en"]["_rows"] * grid["en"]["_asked"] + grid["de"]["_rows"] * grid["de"]["_asked"] == 140_000
    assert grid["en"]["_shards"] * grid["en"]["_stripes"] <= 8 * R.BLOCKS_PER_CORE * 2
    assert (grid["de"]["_shards"], grid["de"]["_stripes"]) <= (3, 3)


def test_cells_are_chosen_together_as_one_by_one(spark, monkeypatch):
    """Few queries at a time, cells with fewer rows than hits wanted, bounds that help some queries only."""
    monkeypatch.setattr(R, "ASKED", 7)
    rows, asked = gathered(3000, 8, 40, 0.1), gathered(3050, 8, 40, 0.1)[3000:]
    asked[::5] = np.abs(np.random.default_rng(2).normal(size=(10, 8)))
    docs, queries = frame_of(spark, range(3000), rows, "corpus_id"), frame_of(spark, range(50), asked, "query_id")
    exact = sorted(map(tuple, R.vector_topk(docs, queries, 60).collect()))
    index = R.build_cells(docs, cells=90)
    assert sorted(map(tuple, index.search(queries, 60, 1.0).collect())) == exact
    assert index.compare(queries, 60).agg(F.sum("compared")).first()[0] < 3000 * 50
