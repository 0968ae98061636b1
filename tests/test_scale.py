"""What keeps queries within their limits on large tables: plans without windows over streams, and counts made where texts lie."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import codec
from glyphloom.operators import decode, graph, kernel, metrics, sequence, stats, together
from glyphloom.plans import catalog
from glyphloom.sources import corpus

TEXTS = ["a b a b c", "", None, "x", " the cat  the hat\nthe cat ", "b a b a b a", "é ß é ß 世 世", "a a a\ta " * 9, "aaaa" * 200]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def found(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


WORDS = ["csr_row_ptr", "csr_cells", "index_lookup", "dense_indices", "edges_last_run", "refined_edges", "pmi_dice", "isolated_nodes", "lru_nodes", "transition_log_probs", "running_markov", "edges_accumulate", "laplace_probs"]


@pytest.mark.parametrize("name", WORDS)
def test_words_are_paired_where_they_lie(spark, sf, name):
    """No window over the words of a stream."""
    got = plan(catalog.QUERIES[name](spark, sf))
    assert "stream_key#" not in "".join(x for x in got.splitlines() if "Window" in x)


def test_only_open_values_are_composed(spark):
    """values below U+0300 stay in the JVM."""
    texts = ["plain", "é ß ÿ", "é", "Å", "가", "가", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from glyphloom.functions.text import nfc

    got = df.select("i", nfc("t").alias("n"))
    assert [r["n"] for r in got.orderBy("i").collect()] == ["plain", "é ß ÿ", "é", "Å", "가", "가", None, ""]
    assert "RLIKE" in plan(got)


@pytest.mark.parametrize("offset,limit", [(0, 3), (2, 3), (4, 9), (8, 2), (30, 2)])
def test_pages(spark, offset, limit):
    """the rows of a sort of all, by a top-k; equal orders, empty texts and null orders among them."""
    rows = [(1, "b"), (1, "a"), (None, "z"), (2, " "), (3, None), (3, "c"), (3, "c"), (4, "d"), (None, ""), (5, "e"), (3, "c")]
    df = spark.createDataFrame(rows, "i long, text string")
    got = corpus.page_of_rows(df, "i", limit, offset)
    place = F.struct(F.col("i").isNull(), F.col("i"), F.xxhash64("t"))
    every = [(r["i"], r["t"]) for r in df.select("i", F.trim(F.coalesce("text", F.lit(""))).alias("t")).orderBy(place).collect()]
    assert [tuple(r) for r in got.collect()] == [r for r in every[offset:] if r[1]][:limit]
    assert "Offset" not in plan(got)


def test_filter_of_a_vocabulary_is_small():
    """F8: 8 MB and one look at the vocabulary, whatever its size."""
    assert decode.FILTER_BITS <= 1 << 26
    toks = ["a", "ab", "世", "abc" * 30, "b"]
    assert decode._slots(toks, 1 << 20).tolist() == [int(decode._hash_runs(decode._codes(t), [len(t)], 1 << 20)[0][0]) for t in toks]


def test_pairs_of_words(docs):
    words = sequence.whitespace_tokens(docs)
    cols = "stream_key", "pos", "origin", "terminal"
    pairs = sequence.word_pairs(docs)
    assert found(pairs, *cols) == found(graph.bigrams(words), *cols)
    cols = "stream_key", "origin", "terminal", "weight", "more"
    assert found(sequence.word_ends(docs), *cols) == found(graph.stream_ends(pairs), *cols)
    cols = "stream_key", "pos", "origin", "terminal", "parent_count", "edge_count", "degree"
    assert found(sequence.word_markov(docs), *cols) == found(metrics.running_markov(pairs), *cols)


def test_row_pointers(docs):
    pairs = sequence.word_pairs(docs)
    index = graph.dense_index(graph.nodes(pairs))
    want = graph.csr(graph.edges_accumulate(pairs), index)[1]
    assert found(graph.row_pointers(pairs), "dense_idx", "ptr") == found(want, "dense_idx", "ptr")


def test_graphs_past_the_drivers_size_are_decoded(spark, docs):
    """the same tokens and scores without the graph on the driver."""
    edge = graph.edges_accumulate(sequence.stream_pairs(docs))
    rows = spark.createDataFrame([(1, "the cat the"), (2, "ababab"), (2, "aaaa"), (3, None), (4, ""), (5, "??"), (6, "世 é a a")], "item_id long, text string")
    cols = "id", "step", "token_str", "token_id", "score"
    got = decode.decode_over(rows, edge)
    near = lambda df: [(*r[:4], round(r[4], 9)) for r in found(df, *cols)]
    want = near(decode.decode(rows, decode.freeze(edge)))
    assert want and near(got) == want
    assert near(decode.decode_over(rows, sequence.stream_pairs(docs))) == want


def test_boundaries_are_counted_where_texts_lie(docs):
    """F12."""
    want = metrics.boundary_f1(metrics.boundaries(sequence.tokens(docs, compat="lossless")), metrics.space_boundaries(docs))
    assert metrics.f1(sequence.stream_boundary_counts(docs)).first() == want.first()


def test_continuity_is_counted_where_texts_lie(docs):
    """F13."""
    want = metrics.continuity(sequence.tokens(docs, compat="lossless"))
    got = metrics.continued(sequence.stream_continuity(docs))
    assert got.first() == want.first() and want.first()["n_continued"] > 0


def test_tokens_are_joined_where_they_lie(docs):
    """F16."""
    got = sequence.joined_tokens(sequence.tokens(docs, compat="lossless"))
    assert found(got, "stream_key", "text") == [(i, t) for i, t in enumerate(TEXTS) if t]


def test_texts_are_cut_side_by_side():
    """steps of many texts at once, and one by one for the longest, give the cuts of each; past the cache as well."""
    rng = random.Random(3)
    letters = ["ab", "abc de", "aB é世😀", "".join(map(chr, range(33, 999)))]
    texts = ["".join(rng.choice(letters[i % 4]) for _ in range(rng.randrange(400 if i % 9 else 2000))) for i in range(400)] + ["", "x", "a" * 3000]
    codes = [sequence._codes(t) for t in texts]
    assert len(codes) > 2 * together.LEAST > 2 * together.LEAST_MDL
    for capacity in (kernel.GATE_CAPACITY, 50):
        assert [c.tolist() for c in together.all_lz_cuts(codes, capacity)] == [kernel.lz_cuts(c.tolist(), capacity) for c in codes]
    assert [c.tolist() for c in together.all_mdl_cuts(codes)] == [kernel.mdl_cuts(c.tolist()) for c in codes]
    few = codes[:5]
    assert [c.tolist() for c in together.all_mdl_cuts(few)] == [kernel.mdl_cuts(c.tolist()) for c in few]


def test_pairs_are_summed_where_they_lie(docs):
    """F26, F6."""
    cols = "origin", "terminal", "weight"
    assert found(graph.edges_accumulate(sequence.stream_edges(docs)), *cols) == found(graph.edges_accumulate(sequence.stream_pairs(docs)), *cols)


@pytest.mark.parametrize("name", ["csr_cells", "refined_edges", "pmi_dice", "decode_benchmark"])
def test_edges_are_summed_once(spark, sf, name):
    """sums that several joins read are moved once."""
    df = catalog.QUERIES[name](spark, sf)
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert any("ReusedExchange [origin#" in x and ", terminal#" in x and ", sum#" in x for x in done.splitlines())


def streams(spark, key="long"):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde" if rng.random() < 0.7 else "xyz") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(120)] + ["q r", "q r q r", "q r"]
    keys = rng.sample(range(-500, 500), len(texts) - 1)
    rows = [*zip([f"k{k}" if key == "string" else k for k in keys], texts, strict=False), (None, texts[-1])]
    return spark.createDataFrame(rows, f"doc_id {key}, text string").repartition(3)


def check_latest(ends, pairs, cols=("origin", "terminal", "weight")):
    every, few = ends(False), ends(True)
    assert found(graph.merge_ends(few), *cols) == found(graph.merge_ends(every), *cols) == found(graph.edges_last_run(pairs), *cols)
    assert 2 * few.count() < every.count()


@pytest.mark.parametrize("key", ["long", "string"])
def test_ends_that_cannot_count_stay_where_they_are(spark, key):
    """a task gives an origin's ends from their latest break on; null keys are last, runs over several streams whole."""
    docs = streams(spark, key)
    check_latest(lambda latest: sequence.word_ends(docs, latest=latest), sequence.word_pairs(docs))
    check_latest(lambda latest: sequence.stream_ends(docs, latest=latest), sequence.stream_pairs(docs))


def test_ends_are_held_in_parts(spark, monkeypatch):
    """what a task holds is bounded; parts of it give the same edges."""
    monkeypatch.setattr(sequence, "HELD_ENDS", 20)
    import pyarrow as pa

    rows = sequence.word_ends(streams(spark)).toArrow().combine_chunks().to_batches()[0]
    parts = [rows.slice(i, 7) for i in range(0, len(rows), 7)]
    got = pa.Table.from_batches(list(sequence._only_latest(iter(parts))))
    assert len(got) < len(rows) and [len(b) for b in sequence._only_latest(iter([rows[:0]]))] == []
    edges = lambda t: found(graph.merge_ends(spark.createDataFrame(t)), "origin", "terminal", "weight")
    assert edges(got) == edges(pa.Table.from_batches([rows]))


@pytest.mark.parametrize("name", ["edges_last_run", "lz_edges_last_run"])
def test_ends_are_made_once(spark, sf, name):
    """both looks at the ends read one exchange."""
    df = catalog.QUERIES[name](spark, sf)
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert any("ReusedExchange [origin#" in x and ", at#" in x for x in done.splitlines())


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_tokens_are_joined_in_their_buffer(spark, docs, rows):
    """F16: streams that end within a batch, fill it, or go over several; the tokens' lists need not be made."""
    toks = sequence.tokens(docs, compat="lossless", lists=False)
    assert toks.columns == ["stream_key", "tok_pos", "token_str", "is_flush"]
    assert found(toks, *toks.columns) == found(sequence.tokens(docs, compat="lossless"), *toks.columns)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        assert found(sequence.joined_tokens(toks), "stream_key", "text") == [(i, t) for i, t in enumerate(TEXTS) if t]
        assert found(sequence.stream_joined(docs, compat="lossless"), "stream_key", "text") == [(i, t) for i, t in enumerate(TEXTS) if t]
        assert found(sequence.stream_joined(docs, stack="merge"), "stream_key", "text") == found(sequence.joined_tokens(sequence.tokens(docs, stack="merge")), "stream_key", "text")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("key", ["long", "string"])
def test_touches_are_made_where_texts_lie(spark, key, monkeypatch):
    """one row a word and some streams; null keys are first, and what was ever an origin counts as one."""
    monkeypatch.setattr(sequence, "OUT_WORDS", 40)
    docs = streams(spark, key)
    cols = "token", "last_touch_key", "last_touch_pos", "dense_idx"
    pairs, touches = sequence.word_pairs(docs), sequence.word_touches(docs)
    for n in (3, 1000):
        assert graph.lru_of(touches, n).select(*cols).collect() == graph.lru_nodes(pairs, n).select(*cols).collect()
    assert touches.count() < pairs.count()
    o, t = (dict(pairs.groupBy(c).agg(f(F.struct("stream_key", "pos"))).collect()) for c, f in (("origin", F.max), ("terminal", F.min)))
    assert {r["token"]: (r["last_touch_key"], r["last_touch_pos"]) for r in graph.lru_of(touches).collect()} == {k: tuple(v) for k, v in (t | o).items()}


@pytest.mark.parametrize("name", ["transition_log_probs", "lru_nodes"])
def test_edges_are_not_sorted_for_their_origins(spark, sf, name):
    """sums of an origin are joined by hash tables; nodes are not joined at all."""
    df = catalog.QUERIES[name](spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in done and df.count() > 0


def test_numbers_in_bytes():
    """numbers of any size, and none."""
    v = np.array([0, 1, -1, 63, -64, 64, 127, 128, 1 << 40, -(1 << 62), (1 << 63) - 1, -(1 << 63)], np.int64)
    data, ends = codec.pack_numbers(codec.zigzag(v))
    got, at = codec.unpack_numbers(data)
    assert codec.unzigzag(got).tolist() == v.tolist() and at.tolist() == ends.tolist()
    assert ends[:5].tolist() == [1, 2, 3, 4, 5]
    assert codec.unpack_numbers(codec.pack_numbers(np.zeros(0, np.uint64))[0])[0].tolist() == []


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("most", [1, 4, 1 << 21])
def test_places_of_words(spark, monkeypatch, kind, most):
    """null, negative, repeated and far keys; a word's places are one row for some streams, its text is not moved with each."""
    monkeypatch.setattr(sequence, "SUM_WORDS", most)
    monkeypatch.setattr(sequence, "OUT_BYTES", most)
    keys = [5, None, -7, 5, 2147483647, -2147483648, 0, None, 9]
    df = spark.createDataFrame([(k, t) for k, t in zip(keys, TEXTS, strict=True)], "k long, text string").select(F.col("k").cast(kind).alias("k"), "text").repartition(2)
    indexed = graph.dense_index(sequence.word_nodes(df, "k"))
    words = sequence.whitespace_tokens(df, "k").withColumnRenamed("token_str", "token")
    cols = "stream_key", "tok_pos", "dense_idx"
    want = sorted(map(str, graph.by_token(words, indexed).select(*cols).collect()))
    got = sequence.word_indices(df, indexed, "k")
    assert sorted(map(str, got.collect())) == want and any("None" in w for w in want)
    assert dict(got.dtypes)["stream_key"] == dict(df.dtypes)["k"]
    if kind != "string" and most > 4:
        assert sequence.word_places(df.coalesce(1), "k").count() < words.count()


def test_lookup_moves_places(spark, sf):
    """no row a word passes the join."""
    assert "places" in plan(catalog.QUERIES["index_lookup"](spark, sf))


def test_vocabulary(docs):
    """words are made once where they lie; lone words are no nodes."""
    assert found(sequence.word_nodes(docs), "token") == found(graph.nodes(sequence.word_pairs(docs)), "token")
    words = sequence.whitespace_tokens(docs).select(F.col("token_str").alias("token"))
    assert found(stats.untouched(sequence.word_vocabulary(docs)), "token") == found(stats.isolated(words, sequence.word_pairs(docs)), "token") == [("aaaa" * 200,), ("x",)]


@pytest.mark.parametrize("name", ["dense_indices", "isolated_nodes", "node_set"])
def test_words_are_not_moved_one_by_one(spark, sf, name):
    """F15, F21"""
    assert "Generate explode" not in plan(catalog.QUERIES[name](spark, sf))


@pytest.mark.parametrize("most", [1, 4, 1 << 21])
def test_edges_of_words(docs, monkeypatch, most):
    monkeypatch.setattr(sequence, "SUM_WORDS", most)
    cols = "origin", "terminal", "weight"
    assert found(graph.edges_accumulate(sequence.word_edges(docs), summed=True), *cols) == found(graph.edges_accumulate(sequence.word_pairs(docs)), *cols)


def test_edges_are_not_summed_by_whole_tasks(spark, sf):
    """sums of a whole map task passed its memory; below the exchange there are only those of some streams."""
    got = catalog.QUERIES["edges_accumulate"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in got[got.index("REPARTITION_BY_COL") :] and "Aggregate" not in got[got.index("REPARTITION_BY_COL") :]


def test_split_is_clean_text(spark):
    """F25, F28 and all that take words where they lie: every kind of white space, what only looks like it, and empty texts."""
    odd = [chr(c) for c in (*range(0, 33), 0x7F, 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [f"a{c}b{c}{c} c{c}" for c in odd] + ["", " ", None, "\ufeff", "\x1c", " x ", "é\t世  ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [[] for _ in texts]
    for r in sequence.whitespace_tokens(df).orderBy("stream_key", "tok_pos").collect():
        want[r["stream_key"]].append(r["token_str"])
    for some in ([t for t in texts], *([t] for t in texts)):
        words, counts = sequence._split(pa.array(some, pa.string()))
        got = [x.tolist() for x in np.split(np.array(words.to_pylist(), object), np.cumsum(counts)[:-1])]
        assert got == ([want[texts.index(t)] for t in some])
