"""The Spark side: functions, graph, decoding, sources, jobs and streams, on small inputs."""

import math
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphloom.functions import codec, text
from glyphloom.operators import decode, graph, metrics, sequence, stats
from glyphloom.operators.kernel import build
from glyphloom.operators.search import golden_section
from glyphloom.operators.sequence import joined_streams, stream_pairs, tokens, whitespace_tokens
from glyphloom.plans.job import JobConfig, JobRunner
from glyphloom.sources import corpus, files
from glyphloom.streaming.online import stream_tokens


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1, "ababab")], "doc_id long, text string")


def test_clean_text(spark):
    df = spark.createDataFrame([(1, " a\t b\n\nc "), (2, "x　﻿ y"), (3, None), (4, " \n"), (5, "")], "i int, t string")
    assert rows(df.select("i", text.clean_text(F.col("t")).alias("c")), "i", "c") == [(1, "a b c"), (2, "x y"), (3, ""), (4, ""), (5, "")]


def test_codepoints(spark):
    df = spark.createDataFrame([("aé😀世",), ("",), ("a\x00b",)], "t string").withColumn("c", text.codepoints(F.col("t")))
    got = df.select("t", "c", text.from_codepoints(F.col("c")).alias("back")).collect()
    assert [list(r["c"]) for r in got] == [[97, 233, 128512, 0x4E16], [], [97, 0, 98]]
    assert all(r["t"] == r["back"] for r in got)


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("é",), (None,)], "t string").select(text.nfc("t").alias("n"))
    assert [r["n"] for r in df.collect()] == ["é", "é", None]


def test_rounding(spark):
    df = spark.createDataFrame([(0.8333,), (0.0,), (None,), (123456.0,), (0.00123456,)], "x double").select(text.round_significant(F.col("x"), 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [0.83, 0.0, None, 120000.0, 0.0012]


def test_codec_columns(spark):
    cases = [[], [0], [97], [97, 98], [1, 2, 3], [97, 98, 97, 98], [0x4E16]]
    df = spark.createDataFrame([(c,) for c in cases], "a array<int>")
    got = df.select("a", codec.rolling_key(F.col("a")).alias("k"), codec.token_id(F.col("a")).alias("i"), codec.pack_column(F.col("a")).alias("p")).collect()
    for r in got:
        a = list(r["a"])
        assert r["k"] == codec.key_of(a) and r["p"] == codec.pack(a)
        assert r["i"] == (codec.encode_id(a) if len(a) <= 3 else None)
    back = df.where("size(a) <= 3").select("a", codec.token_of_id(codec.token_id(F.col("a"))).alias("b")).collect()
    assert all(list(r["a"]) == list(r["b"]) for r in back)
    un = df.select(codec.unpack_column(codec.pack_column(F.col("a"))).alias("u")).collect()
    assert [list(r["u"]) for r in un] == [codec.unpack(codec.pack(c)) for c in cases]
    neg = spark.createDataFrame([([-1],), ([-2],)], "a array<int>").select(codec.rolling_key(F.col("a")).alias("k"))
    assert [r["k"] for r in neg.collect()] == [2725714650, 2725714649]
    with pytest.raises(Exception, match="Too long"):
        spark.createDataFrame([([1] * 6,)], "a array<int>").select(codec.pack_column(F.col("a"))).collect()


def test_tokens(ab):
    got = tokens(ab).orderBy("tok_pos").collect()
    assert [(r["token_str"], r["is_flush"]) for r in got] == [("", False), ("a", False), ("b", False), ("ab", False), ("ab", True)]
    assert [list(r["token"]) for r in got] == [[], [97], [98], [97, 98], [97, 98]]


@pytest.mark.parametrize("stack,gate,compat", [("int", "lz", "reference"), ("int", "lz", "lossless"), ("boundary", "lz", "reference"), ("merge", "lz", "reference"), ("merge", "lz", "lossless"), ("int", "mdl", "reference"), ("int", "none", "reference")])
def test_tokens_are_the_kernels(spark, stack, gate, compat):
    texts = ["", "a", "aa", "ababab", "世界世界世界", "😀😀😀😀😀", "the cat the hat the cat", None, "a\x00a\x00a", "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in tokens(df, stack=stack, gate=gate, compat=compat).orderBy("stream_key", "tok_pos").collect():
        got[r["stream_key"]].append((list(r["token"]), r["is_flush"]))
        assert r["token_str"] == "".join(map(chr, r["token"]))
    for i, t in enumerate(texts):
        seq = build(stack, gate, compat)
        want = [(x, False) for c in t or "" for x in seq.push(ord(c))] + [(x, True) for x in seq.flush()]
        assert got[i] == want, (t, stack)


def test_pairs(spark, ab):
    assert rows(stream_pairs(ab), "pos", "origin", "terminal") == [(1, "", "a"), (2, "a", "b"), (3, "b", "ab")]
    df = spark.createDataFrame([(i, "the cat sat on the mat the cat" * i) for i in range(5)], "doc_id long, text string")
    assert rows(stream_pairs(df), "stream_key", "pos", "origin", "terminal") == rows(graph.bigrams(tokens(df)), "stream_key", "pos", "origin", "terminal")


def test_default_stack_has_one_edge(spark):
    df = spark.createDataFrame([(1, "aa")], "doc_id long, text string")
    assert rows(graph.bigrams(tokens(df, stack="merge")), "origin", "terminal") == [("", "\x00")]


def test_edge_policies(spark):
    df = spark.createDataFrame([(1, i, "x", t) for i, t in enumerate("yyzy")], "stream_key long, pos long, origin string, terminal string")
    assert rows(graph.edges_last_run(df), "origin", "terminal", "weight") == [("x", "y", 1.0)]
    assert rows(graph.edges_accumulate(df), "origin", "terminal", "weight") == [("x", "y", 3.0), ("x", "z", 1.0)]
    two = df.where("pos < 2")
    assert rows(graph.edges_last_run(two), "origin", "terminal", "weight") == rows(graph.edges_accumulate(two), "origin", "terminal", "weight") == [("x", "y", 2.0)]
    with pytest.raises(KeyError):
        graph.edges(df, "none")


@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("ab"), st.sampled_from("xyz")), max_size=25))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_last_run_is_replacement_in_order(spark, merges):
    merges = sorted(merges, key=lambda m: m[0])
    want: dict = {}
    for _, o, t in merges:
        want[o] = (t, want[o][1] + 1.0) if o in want and want[o][0] == t else (t, 1.0)
    df = spark.createDataFrame([(k, i, o, t) for i, (k, o, t) in enumerate(merges)], "stream_key long, pos long, origin string, terminal string")
    assert rows(graph.edges_last_run(df), "origin", "terminal", "weight") == sorted((o, t, w) for o, (t, w) in want.items())


def test_potentials_and_transitions(ab):
    e = graph.edges_accumulate(stream_pairs(ab))
    pot = {r["token"]: r["log_p"] for r in graph.node_potentials(e).collect()}
    assert pot == pytest.approx({"a": -1.128465251817791, "b": -1.128465251817791, "ab": -1.128465251817791, "": -3.526360524616161})
    assert all(r["log_w"] == 0 for r in graph.transitions(e).collect())


def test_transitions_sum_to_one(spark, sf):
    e = graph.edges_accumulate(stream_pairs(spark.read.parquet(f"{sf}/documents.parquet").limit(20)))
    worst = graph.transitions(e).groupBy("origin").agg(F.sum(F.exp("log_w")).alias("p")).agg(F.max(F.abs(F.col("p") - 1))).first()[0]
    assert worst < 1e-9
    last = graph.edges_last_run(stream_pairs(spark.read.parquet(f"{sf}/documents.parquet").limit(20)))
    assert last.groupBy("origin").count().agg(F.max("count")).first()[0] == 1


def test_csr(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("c", "a", 2.0), ("c", "gone", 9.0)], "origin string, terminal string, weight double")
    idx = graph.dense_index(graph.nodes(e.where("terminal <> 'gone'")))
    assert rows(idx, "dense_idx", "token") == [(0, "a"), (1, "b"), (2, "c")]
    cells, ptr = graph.csr(e, idx)
    assert rows(ptr, "dense_idx", "ptr") == [(0, 0), (1, 2), (2, 2), (3, 3)]
    assert rows(cells, "row_idx", "col_idx", F.round("log_w", 9)) == [(0, 1, round(math.log(0.25), 9)), (0, 2, round(math.log(0.75), 9)), (2, 0, 0.0)]
    assert rows(graph.by_index(spark.createDataFrame([(1,), (9,)], "dense_idx long"), idx), "dense_idx", "token") == [(1, "b")]
    assert [tuple(r) for r in graph.by_token(spark.createDataFrame([("c",), ("q",)], "token string"), idx).orderBy("token").collect()] == [("c", 2), ("q", None)]


def test_lru(spark):
    df = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", "c"), (1, 3, "c", "a")], "stream_key long, pos long, origin string, terminal string")
    got = [r["token"] for r in graph.lru_nodes(df, 2).orderBy("dense_idx").collect()]
    assert got == ["c", "b"]  # the last terminal, a, was there already and is not touched
    assert rows(graph.restrict(graph.edges_accumulate(df), graph.lru_nodes(df, 2)), "origin", "terminal") == [("b", "c"), ("c", "a")]


def test_statistics(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 2.0)], "origin string, terminal string, weight double")
    ent = {r["origin"]: r["entropy"] for r in stats.branching_entropy(e).collect()}
    assert ent == pytest.approx({"a": math.log(2), "b": 0.0})
    ass = {(r["origin"], r["terminal"]): (r["pmi"], r["dice"]) for r in stats.association(e).collect()}
    assert ass["b", "c"] == pytest.approx((math.log(2 * 4 / (2 * 3)), 4 / 5))
    assert rows(stats.top_edges(e, 1), "origin", "terminal", "rank") == [("a", "b", 1), ("b", "c", 1)]
    assert rows(stats.refine(e, 1, -9, 0.1), "origin", "terminal") == [("b", "c")]
    vocab = spark.createDataFrame([("a",), ("lone",)], "token string")
    assert rows(stats.isolated(vocab, e), "token") == [("lone",)]
    v = spark.createDataFrame([(i,) for i in range(1, 101)], "x long")
    assert [r["value"] for r in stats.percentiles(v, "x", (0.5,)).collect()] == [50.5]
    assert 49 <= stats.percentiles(v, "x", (0.5,), exact=False).first()["value"] <= 51
    assert rows(stats.histogram(v, "x"), "bucket", "n") == [(0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 32), (6, 37)]


def test_decode(spark, ab):
    lat = decode.freeze(graph.edges_accumulate(stream_pairs(ab)))
    got, score = lat.segment("abab")
    assert got == ["ab", "ab"] and score == pytest.approx(-22.98019634058199)
    assert lat.segment("aba")[0] == ["ab", "a"] and lat.segment("abx")[0] == [] and lat.segment("")[0] == []
    assert decode.decode_text(lat, "ab") == ["ab"]
    df = spark.createDataFrame([(1, "abab"), (2, "abx"), (3, None), (4, "")], "item_id long, text string")
    out = decode.decode(df, lat)
    assert rows(out, "id", "step", "token_str", "token_id") == [(1, 0, "ab", "205520995"), (1, 1, "ab", "205520995")]
    assert decode.decode(df, lat, as_="ids").first()["token"] is None
    with pytest.raises(ValueError):
        decode.freeze(graph.edges_accumulate(stream_pairs(ab)), most=1)


@given(st.text(alphabet="ab", max_size=14))
@settings(max_examples=40, deadline=None)
def test_decode_against_brute_force(t):
    lat = decode.Lattice({"a": -1.0, "b": -1.5, "ab": -1.7, "ba": -2.2, "aba": -2.0}, {("a", "b"): -0.1, ("ab", "ab"): -0.3, ("b", "a"): -0.2})
    best = {0: (0.0, [])}
    for j in range(1, len(t) + 1):
        for i in range(j):
            tok = t[i:j]
            if i in best and tok in lat.potentials:
                s = best[i][0] + lat.potentials[tok] + (lat.steps.get((best[i][1][-1], tok), graph.MISSING) if best[i][1] else 0.0)
                if j not in best or s > best[j][0]:
                    best[j] = (s, best[i][1] + [tok])
    assert lat.segment(t) == (best[len(t)][1], best[len(t)][0])
    assert "".join(lat.segment(t)[0]) == t


def test_prefixes_of_any_length(spark):
    long = "x" * 20 + "y" * 30
    docs = spark.createDataFrame([(1, f"a {long} b"), (2, "x" * 9), (3, None)], "item_id long, text string")
    vocabulary = spark.createDataFrame([(long,), (long[:40],), ("b",), ("",), (None,), ("b",)], "token string")
    assert rows(decode.prefixes(docs, vocabulary), "id", "pos", "token") == [(1, 2, long[:40]), (1, 2, long), (1, 53, "b")]
    assert decode.prefixes(docs, vocabulary.limit(0)).count() == 0


def test_golden_section():
    m = golden_section(0.01, 2.0, lambda x: (x - 0.7) ** 2)
    assert m.converged and abs(m.x - 0.7) < 1e-3 and m.iters < 60
    assert not golden_section(0, 1, lambda x: x, max_iters=2).converged
    seen = []
    m = golden_section(0.0, 1.0, lambda x: seen.append(x) or abs(x - 0.31), tolerance=1e-3)
    assert len(seen) == len(set(seen)) == m.iters + 3 and m.iters == 15 and abs(m.x - 0.31) < 1e-3
    assert golden_section(1.0, 1.0, lambda x: x) == (1.0, 1.0, 0, True)


def test_ids_of_all_tokens(spark, sf):
    from glyphloom.plans import catalog

    toks = ["a", "ab", "abc", "abcd", "\x00\x00", "\U0010ffff" * 9, "été" * 300]
    df = spark.createDataFrame([(t,) for t in toks], "t string").withColumn("h", codec.token_hex(text.codepoints(F.col("t"))))
    for r in df.withColumn("back", codec.token_of_hex(F.col("h"))).collect():
        cps = [ord(c) for c in r["t"]]
        assert r["h"] == f"{codec.encode_id(cps):X}" and r["back"] == cps
    got = catalog.QUERIES["token_ids"](spark, sf).collect()
    assert max(len(r["token"]) for r in got) > 3
    assert all(r["decoded"] == r["token"] and int(r["id"], 16) == codec.encode_id([ord(c) for c in r["token"]]) for r in got)


def test_metrics(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    assert rows(metrics.space_boundaries(df), "at") == [(2,), (3,)]
    t = spark.createDataFrame([(1, 0, "ab"), (1, 1, " c"), (1, 2, "d")], "stream_key long, tok_pos long, token_str string")
    f = metrics.boundary_f1(metrics.boundaries(t), metrics.space_boundaries(df)).first()
    assert (f["n_found"], f["n_truth"], f["n_both"], f["f1"]) == (2, 2, 1, 0.5)
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "ab"), (1, 3, "a")], "stream_key long, tok_pos long, token_str string")
    got = metrics.continuity(c).first()
    assert (got["n_tokens"], got["n_continued"]) == (4, 1)
    empty = metrics.counters(t.limit(0), spark.createDataFrame([], "n long")).first()
    assert (empty["codepoints_in"], empty["tokens_out"], empty["compression_ratio"]) == (0, 0, None)


def test_continuity_of_long_tokens(spark):
    base = "".join(chr(97 + i * i % 23) for i in range(400))
    toks = [base[:n] for n in (64, 65, 128, 129, 200)] + [base[:199] + "#", base[:64], base[:130], "é" * 70, "é" * 71, base, base[1:150]]
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "stream_key long, tok_pos long, token_str string")
    want = sum(any(len(u) > len(t) and u.startswith(t) for u in toks[i + 1 :]) for i, t in enumerate(toks))
    got = metrics.continuity(c).first()
    assert (got["n_tokens"], got["n_continued"]) == (len(toks), want)


def test_running_markov_is_the_kernels(spark):
    from glyphloom.operators.kernel import MarkovStats

    seq = "abacabadabacaba"
    df = spark.createDataFrame([(1, i, seq[i - 1], seq[i]) for i in range(1, len(seq))], "stream_key long, pos long, origin string, terminal string")
    s, want = MarkovStats(), []
    for i in range(1, len(seq)):
        p, c = ord(seq[i - 1]), ord(seq[i])
        want.append((i, s.parent_count(p), s.edge_count(p, c), s.degree(p)))
        s.push(p, c)
    assert rows(metrics.running_markov(df), "pos", "parent_count", "edge_count", "degree") == want


def test_corpus(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f" t {i}") for i in range(8)], "doc_id long, text string")
    assert rows(corpus.page_of_rows(df, "doc_id", 3, 2), "doc_id", "text") == [(2, "t 2"), (4, "t 4"), (5, "t 5")]
    with pytest.raises(ValueError):
        corpus.page_of_rows(df, "doc_id", 0)
    out = str(tmp_path / "corpus")
    corpus.write_corpus(corpus.page_of_rows(df, "doc_id", 3, 2), out, "doc_id")
    got = "".join(p.read_text() for p in sorted((tmp_path / "corpus").glob("part-*")))
    assert got == "t 2\n\nt 4\n\nt 5\n\n"
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.write_corpus(df, out, "doc_id")
    corpus.write_corpus(df, out, "doc_id", overwrite=True)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_bytes(b"\xef\xbb\xbfa\xffb")
    assert corpus.read_text_files(spark, str(tmp_path / "f")).first()["text"] == "a�b"


def test_files(spark, tmp_path):
    made = {".git/x": "g", "a/node_modules/b.js": "n", "x.log": "l", "keep.log": "k", "src/main.py": "m", "bun.lock": "b", "src/.hidden": "h"}
    for p, body in made.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe\x00")
    listed = files.list_files(spark, str(tmp_path))
    assert {r["path"] for r in listed.select("path").collect()} == {"a/node_modules/b.js", "x.log", "keep.log", "src/main.py", "bun.lock", "bin.dat"}
    kept = files.select_files(listed, "# rules\nnode_modules/\n*.log\n!keep.log\n")
    assert rows(kept, "path") == [("a/node_modules/b.js",), ("bin.dat",), ("keep.log",), ("src/main.py",)]
    kept = files.select_files(listed, "node_modules\n*.log\n!keep.log\n")
    assert rows(kept, "path") == [("bin.dat",), ("keep.log",), ("src/main.py",)]
    assert rows(files.select_files(listed), "path") == [("a/node_modules/b.js",), ("bin.dat",), ("src/main.py",)]
    assert rows(files.bundle(kept), "path") == [("keep.log",), ("src/main.py",)]
    assert files.write_bundle(kept, str(tmp_path / "out"), target="/t", time="now") == 3
    got = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    rule = "#" * 80
    assert got == files.preamble("/t", 3, "now") + "".join(f"\n{rule}\n# FILE PATH: {p}\n{rule}\n\n{body}\n# END OF FILE: {p}\n\n" for p, body in (("keep.log", "k"), ("src/main.py", "m")))
    (tmp_path / ".gitignore").write_text("top\n")
    (tmp_path / "src" / ".gitignore").write_text("below\n")
    assert files.ignore_text(str(tmp_path / "src")).endswith("top\n\nbelow\n")
    assert files.find_project_root(str(tmp_path / "src")) == str(tmp_path.resolve())
    (tmp_path / ".corpus").mkdir()
    (tmp_path / ".corpus" / "c.txt").write_text("c")
    assert files.resolve_file("c.txt", start=str(tmp_path / "src")).endswith("c.txt")
    with pytest.raises(FileNotFoundError):
        files.resolve_file("none", start=str(tmp_path))


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("build/", ["build/", "build/x", "build/a/b"], ["a/build/x", "build", "rebuild/x"]),
        ("*.log", ["x.log", "a/b/x.log", ".log"], ["x.logs", "log"]),
        ("/top", ["top"], ["a/top", "top/x"]),
        ("a/*/c", ["a/b/c"], ["a/c", "a/b/b/c", "x/a/b/c"]),
        ("**/x?.[ch]", ["x1.c", "d/e/x2.h"], ["x.c", "x12.c", "x1.d"]),
        ("a/**/z", ["a/z", "a/b/c/z"], ["z", "a/zz"]),
        ("{a,b}.txt", ["a.txt", "d/b.txt"], ["c.txt"]),
        ("[!a]b", ["cb"], ["ab"]),
        ("a.b+c", ["a.b+c"], ["axb+c", "a.bbc"]),
    ],
)
def test_ignore_patterns(pattern, yes, no):
    import re

    regex = re.compile(files.glob_regex(files.ignore_glob(pattern)))
    assert all(regex.search(p) for p in yes) and not any(regex.search(p) for p in no)


def test_directories_left_out_take_all_below(spark):
    paths = ["build/x", "build/keep.txt", "a/build/x", ".idea/x.xml", ".env.local", "a/.env", "x.min.js", "b/x.log", "x.log", ".next/s", "yarn.lock", "q/yarn.lock", "q/tmp/y/z", "é/ü"]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,), ("",)], "path string")
    kept = lambda ignore: {r["path"] for r in files.select_files(df, ignore).collect()}
    assert kept(None) == {"a/build/x", "a/.env", "x.min.js", "b/x.log", "q/tmp/y/z", "é/ü", ""}
    assert kept("build/\ntmp\n!keep.txt\n!z\n*.xml") == {"a/build/x", ".env.local", "a/.env", "x.min.js", "b/x.log", "x.log", ".next/s", "é/ü", ""}


def test_jobs(spark, ab):
    job = JobRunner(JobConfig(edge_policy="accumulate", meta={"set": "x"})).measure(ab)
    assert job.counters["codepoints_in"] == 6 and job.counters["tokens_out"] == 5 and job.counters["compression_ratio"] == 0.83
    assert job.meta == {"set": "x"} and job.created_at.endswith("Z")
    assert rows(job.edges, "origin", "terminal", "weight") == [("", "a", 1.0), ("a", "b", 1.0), ("b", "ab", 1.0)]
    with pytest.raises(ValueError):
        JobRunner().run(None)
    two = spark.createDataFrame([(2, "cd"), (1, "ab"), (3, None)], "doc_id long, text string")
    one = JobRunner().run(two, stream_key=None, compat="lossless")
    assert "".join(r["token_str"] for r in one.tokens.orderBy("tok_pos").collect()) == "ab\n\ncd"
    runner = JobRunner()
    runner.run(ab, stack="merge")
    assert runner.config.stack == "int"


def test_job_metadata(spark, ab):
    import io
    import re

    runner = JobRunner(JobConfig(meta={"set": "x"}), meta={"who": "me"})
    out = io.StringIO()
    jobs = [runner.measure(ab, out=out), runner.run(ab)]
    ids = [runner.runner_id, *[j.job_id for j in jobs]]
    assert ids == sorted(ids) and all(re.fullmatch("[0-9a-f]{12}7[0-9a-f]{3}[89ab][0-9a-f]{15}", i) for i in ids)
    assert jobs[0].runner_meta == {"who": "me"} and jobs[0].duration_ms > 0 and jobs[1].duration_ms == "incomplete" and jobs[0].process_start_ms
    assert "6 codepoints -> 5 tokens (0.83x compression)" in out.getvalue() and "who\tme" in out.getvalue()


class EveryThird:
    """A gate of the user's own: ends a token at every third integer."""

    def __init__(self, name):
        self.name, self.n = name, 0

    def evaluate(self, current, previous):
        self.n += 1
        return self.n % 3 != 1

    def reset(self):
        self.n = 0

    def snapshot(self):
        return {"name": self.name, "ingested": self.n, "pass_rate": 0.5, "custom_metrics": {"n": float(self.n)}}


class SumKeys:
    def __init__(self):
        self.value = 0

    def update(self, x):
        self.value += x
        return self.value

    def reset(self):
        self.value = 0

    def recalculate(self, ints):
        self.value = sum(ints)
        return self.value


def test_own_gates_keys_and_sequencers(spark):
    from glyphloom.operators.kernel import IntSequencer

    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcd")], "doc_id long, text string")
    got = tokens(df, gate=lambda level: [EveryThird(level)], compat="lossless")
    assert rows(got, "stream_key", "tok_pos", "token_str") == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "gh"), (2, 0, "abc"), (2, 1, "d")]
    assert rows(tokens(df, stack=lambda: IntSequencer([EveryThird("mine")], compat="lossless")), "token_str") == rows(got, "token_str")
    snap = sequence.snapshots(df, stack="int", gate=lambda level: [EveryThird(level)]).where("stream_key = 1").first()["sequencers"][0]
    assert snap["gates"][0]["custom_metrics"] == {"n": 8.0} and snap["duration_ms"] >= 0
    one = spark.createDataFrame([(1, "ababba")], "doc_id long, text string")
    seq = build(keys=SumKeys, compat="lossless")
    want = [x for c in "ababba" for x in seq.push(ord(c))] + seq.flush()
    mine = ["".join(map(chr, x)) for x in want]
    assert [r[1] for r in rows(tokens(one, keys=SumKeys, compat="lossless"), "tok_pos", "token_str")] == mine != [r[1] for r in rows(tokens(one, compat="lossless"), "tok_pos", "token_str")]
    job = JobRunner(JobConfig(gate=lambda level: [EveryThird(level)], compat="lossless", graph_capacity=None)).run(df)
    assert rows(job.edges, "origin", "terminal", "weight") == [("abc", "def", 1.0)]


def test_mdl_config():
    from glyphloom.operators.kernel import MDLGate

    assert MDLGate(c=0.5).config["c"] == 0.5 and MDLGate().config["z_mode"] == "child-degree"


@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=40), st.integers(1, 5), st.sampled_from(["last_run", "accumulate"]))
@settings(max_examples=200, deadline=None)
def test_bounded_graph(merges, capacity, policy):
    from glyphloom.operators.kernel import LRUGraph

    order, out = [], {}  # the same by lists: the least recent first

    def put(x, e):
        if x in order:
            order.remove(x)
        elif len(order) >= capacity:
            del out[order.pop(0)]
        order.append(x)
        out[x] = e

    g = LRUGraph(capacity, policy)
    for o, t in merges:
        g.merge(o, t)
        e = dict(out.get(o, {})) if policy == "accumulate" or t in out.get(o, {}) else {}
        e[t] = e.get(t, 0) + 1
        put(o, e)
        if t not in out:
            put(t, {})
    assert list(g.nodes) == order and g.edges() == [(o, t, w) for o in order for t, w in out[o].items()]


def test_jobs_keep_to_the_graph_capacity(spark):
    from glyphloom.operators.kernel import LRUGraph
    from glyphloom.operators.sequence import stream_pairs

    rnd = random.Random(1)
    df = spark.createDataFrame([(i, "".join(rnd.choice("abcd ") for _ in range(200))) for i in range(6)], "doc_id long, text string")
    pairs = stream_pairs(df).orderBy("stream_key", "pos").collect()
    for policy in ("last_run", "accumulate"):
        g = LRUGraph(20, policy)
        for r in pairs:
            g.merge(r["origin"], r["terminal"])
        runner = JobRunner(JobConfig(edge_policy=policy))
        assert rows(runner.run(df, graph_capacity=20).edges, "origin", "terminal", "weight") == sorted(g.edges())
        free = rows(runner.run(df, graph_capacity=None).edges, "origin", "terminal", "weight")
        assert free == rows(runner.run(df).edges, "origin", "terminal", "weight") == rows(graph.edges(stream_pairs(df), policy), "origin", "terminal", "weight")


def test_ordered_streams(spark):
    rnd = random.Random(2)
    data = [(k, i, "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) if rnd.random() < 0.9 else None) for k in (1, 2, 3) for i in range(20)]
    df = spark.createDataFrame(data, "k long, o long, text string").repartition(5)
    for stack in ("int", "merge"):
        joined = joined_streams(df, "k", "o", "text")
        want = rows(tokens(joined, "k", stack=stack), "stream_key", "tok_pos", "token_str", "is_flush")
        assert rows(sequence.ordered_tokens(df, "k", "o", stack=stack), "stream_key", "tok_pos", "token_str", "is_flush") == want
    assert sequence.ordered_tokens(df.limit(0), "k", "o").count() == 0


def test_large_corpus_files_are_split(spark, tmp_path):
    texts = [f"text {i} é\nsecond line" for i in range(3000)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("\n\n".join(texts) + "\n\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = corpus.read_corpus(spark, str(tmp_path / "c"))
        assert len(df.select(F.spark_partition_id().alias("p")).distinct().collect()) > 1
        assert [r["text"] for r in df.orderBy("path", "at").collect()] == texts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_dense_index_of_alike_tokens(spark):
    toks = sorted({f"common prefix {i * 7919 % 5003}" for i in range(3000)} | {"", "a", "é", "\U0001f600"})
    df = spark.createDataFrame([(t,) for t in toks], "token string").repartition(7)
    indexed = graph.dense_index(df, ranges=8)
    assert rows(indexed, "dense_idx", "token") == list(enumerate(sorted(toks, key=lambda t: t.encode())))
    assert graph.dense_index(df.limit(0)).count() == 0


def test_joined_streams(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (1, 3, None)], "k long, o long, t string")
    assert rows(joined_streams(df, "k", "o", "t", "-"), "k", "t") == [(1, "a-b"), (2, "c")]


def test_words(spark):
    df = spark.createDataFrame([(1, " a  b\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(whitespace_tokens(df), "stream_key", "tok_pos", "token_str") == [(1, 0, "a"), (1, 1, "b")]


@pytest.mark.parametrize("stack", ["int", "merge"])
def test_stream_is_batch(spark, tmp_path, stack):
    texts = {1: "abababcabc", 2: "the cat the hat", 3: "aa"}
    src = str(tmp_path / "in")
    parts = [(k, i, t[i * 4 : i * 4 + 4], False) for k, t in texts.items() for i in range(4)]
    schema = "stream_key long, ord long, text string, is_end boolean"
    for n in range(4):
        spark.createDataFrame([p for p in parts if p[1] == n], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(k, 9, "", True) for k in texts], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = stream_tokens(stream, stack=stack).writeStream.format("memory").queryName(f"toks_{stack}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = rows(spark.table(f"toks_{stack}"), "stream_key", "tok_pos", "token_str", "is_flush")
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got == rows(tokens(df, stack=stack), "stream_key", "tok_pos", "token_str", "is_flush")
    pairs = spark.table(f"toks_{stack}").where("origin_str is not null")
    assert rows(pairs, "stream_key", "tok_pos", "origin_str", "token_str") == rows(graph.bigrams(tokens(df, stack=stack)), "stream_key", "pos", "origin", "terminal")
