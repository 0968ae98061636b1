"""Each corpus operator against brute force, and on nulls, empty, long, tied, repeated and clashing input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphloom.llm import common, decontam, graph, html_extract, langid, minhash, mixing, pii, quality, queries, token_counts, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that carry the names the operators use inside.
CLASH = ("id", "size", "copies", "rate", "target", "n", "bands", "score", "lang_pred", "row", "base", "component", "kept", "key", "copy_no", "f1", "weight", "x_words", "dist", "t")


def odd_docs(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "no id here but some words anyway", "en", "b", 9), (4, long, "en", "b", len(long)), (5, "x" * 300_000, "de", "b", 300_000), (6, "same text for two rows of the same id", "en", "a", 37), (6, "same text for two rows of the same id", "en", "a", 37), (7, "1234 5678 !!!", None, "a", 13), (8, "\x00😀 é", "fr", None, 5)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df, len(rows)


# --- 1 ---


def judge(url, listed, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(UP)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for v, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow"


def test_url_rules_and_list(spark):
    urls = [None, "", "nothing", "http://A.net/x?y#z", "http://a.net", "https://sub.Example.NET/en/1", "https://example.net/english", "http://example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org/listed/", "HTTP://WWW.x.org/listed?ref=1#q", "ftp://x.org:80/listed", "a://b://c.net/d", "http://x.org/listed?q=1", "http://İ.net/x", "http://x.org/" + "p" * 100_000]
    urls += urls[-8:]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("https://x.org/listed",), (None,), ("junk",), ("https://x.org/listed/",)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r = got[i]
        hit = u in ("http://x.org/listed/", "HTTP://WWW.x.org/listed?ref=1#q", "ftp://x.org:80/listed")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(u, hit), u
    empty = url_filter.judge_urls(pages.limit(0), listed.limit(0))
    assert empty.count() == 0 and url_filter.judge_urls(pages, listed.limit(0)).where("is_listed").count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark, monkeypatch):
    keys = spark.range(5000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    other = spark.range(10_000, 30_000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    both = keys.union(other).withColumn("page_id", F.monotonically_increasing_id())
    for c in ("w0", "w1", "w2", "w3", "key", "salt", "found", "block", "copy", "possible", "listed"):
        both = both.withColumn(c, F.lit("clash"))
    for limits in ((url_filter.BROADCAST_BLOCKS, url_filter.BROADCAST_KEYS), (0, 0)):  # broadcast, then shuffled
        monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", limits[0])
        monkeypatch.setattr(url_filter, "BROADCAST_KEYS", limits[1])
        got = url_filter.listed_flag(both, keys, "url", "page_id")
        assert got.columns == [*both.columns, "is_listed"] and got.count() == 25_000 and got.where("is_listed").count() == 5000
    table, blocks = url_filter.build_filter(keys.select(url_filter.canonical_url(F.col("url")).alias("key")), 5000)
    k = other.select(url_filter.canonical_url(F.col("url")).alias("key"))
    assert url_filter.probe(k, "key", table, blocks).where("__possible").count() < 20_000 * 0.02


# --- 2 ---

BASE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    out = [(0, *m.span()) for m in BASE[0].finditer(t)]
    out += [(1, *m.span()) for m in BASE[1].finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in BASE[2].finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in BASE[3].finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


@given(st.text(alphabet=st.sampled_from("a1@. +-()2Z_3é\n%"), max_size=50) | st.text(alphabet="0123456789 -+.", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t)[0] == brute_spans(t)


def test_base_spans_take_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "@" * 100_000, "1." * 200_000, "+1" * 100_000, "a@" * 100_000, "1 " * 200_000, "a@b" * 100_000, "ab@cd.ef, " * 40_000, "a@b.c;" * 60_000):
        pii._mentions(t, pii.base_spans(t)[0])


def test_look_alikes_are_whole():
    name, host = "q" * 90, "w" * 120
    text = f"write to {name}@{host} now"
    assert pii.look_alikes(text, []) == [(9, 9 + 211, (0,))]
    long = "z" * 300
    assert pii.context(f"{long} 4111", 301, 305) == ["l1 ..."] and pii.context(f"one {long[:40]} 4111 {long}", 45, 49) == [f"l2 one {long[:40]}", f"lr {long[:40]} ...", f"l1 {long[:40]}"]
    assert pii.context("a" * 40 + "   Card  No 41", 52, 54) == ["l2 card no", "l1 no"]


def bad_card(i):
    n = f"4{i:015d}"
    return n if not pii.luhn(n) else n[:-1] + str((int(n[-1]) + 1) % 10)


def good_card(i):
    n = f"5{i:014d}"
    return next(n + str(c) for c in range(10) if pii.luhn(n + str(c)))


def planted(spark):
    """Two rounds are needed: seeds make `visa number` a pattern, what that finds makes `reference code` one."""
    rnd = random.Random(3)
    noise = lambda: " ".join(rnd.choice(["river", "stone", "lamp", "cloud", "seven", "green"]) + str(rnd.randrange(50)) for _ in range(5))
    rows, found = [], set()
    for i in range(150):
        rows.append((len(rows), f"{noise()} visa number {good_card(i)} {noise()}"))
    for i in range(40):
        found.add(len(rows))
        rows.append((len(rows), f"{noise()} visa number {bad_card(i % 20)} {noise()}"))
    for i in range(20):
        found.add(len(rows))
        rows.append((len(rows), f"{noise()} reference code {bad_card(i)} {noise()}"))
    found.add(len(rows))
    rows.append((len(rows), f"{noise()} reference code {bad_card(999)} {noise()}"))
    for i in range(60):
        rows.append((len(rows), f"{noise()} serial part {bad_card(5000 + i)} {noise()}"))
    return rows, found


def brute_scores(rows, rounds):
    edges = {}
    for _, text in rows:
        for _, _, seed, kinds, inst, pats in pii._mentions(text, pii.base_spans(text)[0]):
            for k in kinds:
                for p in pats:
                    edges[p, inst, k] = edges.get((p, inst, k), False) or seed == k
    conf, out, history = {}, {}, []
    for _ in range(rounds):
        good, every = Counter(), Counter()
        for (p, i, k), seed in edges.items():
            good[p, k] += 1 if seed else conf.get((i, k), 0)
            every[p, k] += 1
        out = {x: good[x] / (every[x] + 1) for x in good if good[x] >= pii.LEAST_TRUST and good[x] / (every[x] + 1) >= pii.PATTERN_SCORE}
        history.append(set(out))
        miss = {}
        for (p, i, k), seed in edges.items():
            if not seed and (p, k) in out:
                miss[i, k] = miss.get((i, k), 1) * (1 - out[p, k])
        conf = {x: 1 - m for x, m in miss.items()}
    return out, history


def test_bootstrapping_goes_on(spark):
    rows, found = planted(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, history = brute_scores(rows, pii.ROUNDS)
    assert not any("code" in p for p, _ in history[0]) and any("reference code" in p for p, _ in history[1])
    scanned = pii.scan(df)
    got = {(r["pat"], r["k"]): r["score"] for r in pii.pattern_scores(scanned).collect()}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], abs=1e-5) for x in got)
    hits = {r["doc_id"] for r in pii.find(df).where("n_found > 0").collect()}
    assert hits == found  # recall and precision 1
    red = {r["doc_id"] for r in pii.redact(df, chars_col=None).where("text like '%[CARD]%'").collect()}
    assert red == found | set(range(150))


def test_salted_patterns(spark, monkeypatch):
    rows, _ = planted(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, pii.find(df).collect()))
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    assert sorted(map(tuple, pii.find(df).collect())) == want


def pii_docs(spark):
    rows = []
    for i in range(40):
        n = f"4{i:014d}"
        card = next(n + str(c) for c in range(10) if pii.luhn(n + str(c)))
        rows.append((i, f"please charge my visa card {card} today and nothing else", "en", "a", 1))
    bad = "4999999999999990" if not pii.luhn("4999999999999990") else "4999999999999991"
    rows += [(100, f"so charge my visa card {bad} today at once", "en", "a", 1), (101, f"the serial number reads {bad[:-1]}7 on the lid", "en", "a", 1), (102, None, None, None, None), (103, "mail a.b@c.de, +1 (234) 567-8901 or 10.0.0.1", "en", "a", 1), (103, "", "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS), bad


def test_contexts_discover_unseen(spark):
    df, bad = pii_docs(spark)
    got = pii.find(df)
    assert got.count() == df.count()
    by = {r["doc_id"]: r for r in got.where("doc_id <> 103").collect()}
    assert by[100]["n_card"] == 0 and by[100]["n_found"] == 1
    at = df.where("doc_id = 100").first()["text"].index(bad)
    assert by[100]["spans"] == f"card:{at}:{at + 16}" and by[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[101]["n_found"] == 0 and by[102]["spans"] == ""
    full = next(r for r in got.where("doc_id = 103").collect() if r["spans"])
    assert (full["n_email"], full["n_ip"], full["n_card"], full["n_phone"]) == (1, 1, 0, 1)
    assert hashlib.sha256(full["spans"].encode()).hexdigest() == full["base_sha256"]
    for limit in (pii.BROADCAST_PATTERNS, -1):  # patterns sent, then spans joined
        pii.BROADCAST_PATTERNS, was = limit, pii.BROADCAST_PATTERNS
        try:
            red = pii.redact(df)
            assert red.columns == df.columns and red.count() == df.count()
            texts = {r["doc_id"]: r["text"] for r in red.collect() if r["text"] != ""}
        finally:
            pii.BROADCAST_PATTERNS = was
        assert texts[100] == "so charge my visa card [CARD] today at once" and bad[:-1] in texts[101]
        assert texts[103] == "mail [EMAIL], [PHONE] or [IP]" and texts[102] is None


def test_pii_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    for r in queries.op2_pii(spark, sf).collect():
        want = brute_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


def test_redaction_by_rows(spark, monkeypatch):
    df, bad = pii_docs(spark)
    text = df.where("doc_id = 100").first()["text"]
    more = spark.createDataFrame([(None, text), (100, "x" * 10 + text), (100, "clean words " * 9)], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(more)
    want = Counter(map(tuple, pii.redact(df, chars_col=None).collect()))
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", -1)
    got = Counter(map(tuple, pii.redact(df, chars_col=None).collect()))
    assert got == want and got[(100, "clean words " * 9)] == 1
    assert got[(None, text.replace(bad, "[CARD]"))] == 1 and got[(100, "x" * 10 + text.replace(bad, "[CARD]"))] == 1


# --- 3 ---


def edit_distance_within(need, text, e):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(need, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= e


def test_leaks_against_alignment():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 40)))) for i in range(12)]
    index = decontam.Index(items)
    index.ready()
    for _ in range(60):
        k, item = rnd.choice(items)
        sq = "".join(c for c in item if c.isalnum())
        w, e, _ = decontam.budget(len(sq))
        s = rnd.randrange(len(sq) - w + 1)
        y = list(sq[s : s + w])
        for _ in range(rnd.choice([0, 1, e, e + 1, 2 * e + 6])):
            p = rnd.randrange(len(y))
            y[p : p + 1] = rnd.choice([["z"], [], ["z", y[p]]])
        text = " ".join(word() for _ in range(10)) + " " + "".join(y) + " " + " ".join(word() for _ in range(10))
        cps = decontam.squeeze(text)[0]
        got = {x[0] for x in index.leaks(cps)}
        host = "".join(map(chr, cps))
        want = any(edit_distance_within(sq[a : a + w], host, e) for a in range(len(sq) - w + 1))
        assert (k in got) == want


def test_leaks_in_documents(spark):
    item = "The quick brown fox jumps over the lazy dog while seventeen curious badgers watch in silence from a nearby hill"
    loud = item.upper().replace(" ", " *** ")
    rows = [(1, f"before {item} after"), (2, loud), (3, item[:60]), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, "word " * 50_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(9, item), (10, None), (None, "x"), (11, "short")], "item_id long, text string")
    got = decontam.find_leaks(docs, bench).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({1: 1, 2: 1, None: 1, 6: 2, 7: 1})
    one = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][one["start"] : one["end"]] == item and one["edits"] == 0
    assert [r["doc_id"] for r in decontam.clean(docs, bench).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0
    decontam.BLOCK_CHARS, was = 10, decontam.BLOCK_CHARS
    try:  # several passes
        assert decontam.find_leaks(docs, bench).count() == len(got) and decontam.clean(docs, bench).count() == 3
    finally:
        decontam.BLOCK_CHARS = was


def test_items_without_id(spark):
    item = "Seventeen curious badgers watch in silence while the quick brown fox jumps over a lazy dog on the hill"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (5, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs, bench).collect()] == [(1, None, 0)]
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [2]


@pytest.mark.parametrize("block", [10, 1 << 22])
def test_ids_of_any_type_and_short_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    item = "Seventeen curious badgers watch in silence while the quick brown fox jumps over a lazy dog on the hill"
    rows = [("a", f"before {item} after", "x"), ("b", "the answer is forty 2, they say", "x"), ("c", "shorty 2x", "x"), ("d", "forty-2", "x"), (None, "", "x"), ("e", None, "x"), ("f", item, "x"), ("f", item, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, start string")
    for kind, ids in (("string", ["p", "q", "r"]), ("int", [1, 2, 3]), ("long", [1, 2, 3])):
        bench = spark.createDataFrame(list(zip(ids, [item, "Forty 2!", "?!"], strict=True)), f"item_id {kind}, text string")
        got = decontam.find_leaks(docs, bench)
        assert dict(got.dtypes)["item_id"] == dict(bench.dtypes)["item_id"]
        assert Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == Counter({("a", ids[0]): 1, ("b", ids[1]): 1, ("d", ids[1]): 1, ("f", ids[0]): 2})
        b = got.where("doc_id = 'b'").first()
        assert rows[1][1][b["start"] : b["end"]] == "forty 2"
        assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {"c", None, "e"}


def test_common_openings_take_bounded_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(decontam, "HITS", 1 << 14)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    opening = "answer the following question in one short sentence"
    items = [(i, f"{opening} {' '.join(word() for _ in range(20))}") for i in range(400)]
    index = decontam.Index(items)
    index.ready()
    text = " ".join(f"{opening[:18]} {word()} {word()}" for _ in range(300)) + " " + items[77][1] + " " + opening
    cps, at = decontam.squeeze(text)
    tracemalloc.start()
    got = [x[0] for x in index.leaks(cps, at)]
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert got == [77]
    monkeypatch.setattr(decontam, "HITS", 1 << 30)
    assert [x[0] for x in index.leaks(cps[-3000:], at[-3000:])] == [77]


def test_decontamination_query(spark, sf):
    sq = lambda t: "".join(c for c in t.lower() if c.isalnum())
    bench = [(r["item_id"], sq(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: sq(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, sf).collect()}
    holds = {(d, i) for d, t in docs.items() for i, x in bench if x in t}
    assert holds and holds <= got
    for d, i in got - holds:
        x = dict(bench)[i]
        w, e, _ = decontam.budget(len(x))
        assert any(edit_distance_within(x[a : a + w], docs[d], e) for a in range(len(x) - w + 1))


# --- 4 ---


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>No</title></head><body class="has-sidebar"><header>Site</header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies on this site to improve it.</div>
    <div class="content"><article><header><h1>T &lt;x&gt;</h1></header><p>Hello <b>wor</b>ld<br>again<p>Two &#8212; x < y&nbsp;z &amp &copy<div class="ad">buy</div><ul><li>one<li>two</ul><form><input><button>go</button></form><table><tr><td>a<td>b</table><!-- c --></article>
    <aside>side</aside><section class="comments"><article class="comment"><p>nice post that is long enough to be main text, truly. Yes it is.</p></article></section></div><footer>f</footer><script>var a="<p>x</p>"</script><style>p{}</style></body></html>"""
    assert html_extract.main_text(page) == "T <x> Hello world again Two — x < y z & © one two a b"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == html_extract.main_text("<scr") == ""
    bare = "<html><body><div class=menu><a href=1>a</a> <a href=2>b</a></div><p>" + "A sentence of main text that runs on. " * 4 + "</p><p>Short one.</p><p>" + "Another long sentence of the text. " * 4 + "</p><div class='footer'>c</div></body></html>"
    assert html_extract.main_text(bare) == ("A sentence of main text that runs on. " * 4 + "Short one. " + "Another long sentence of the text. " * 4).strip()
    assert len(html_extract.main_text("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 5 - 1
    html_extract.main_text("<div>" * 3000 + "x" + "</div>" * 3000)
    html_extract.main_text('<a href="' * 500)


def test_main_text_layouts():
    long = "This sentence belongs to the text of the page and says something about it."
    main = f"<main><p>Latest news</p><article><p>{long}</p></article></main>"
    assert html_extract.main_text(main) == long
    assert html_extract.main_text(f"<main><p>{long}</p><aside>x</aside></main><div>{long}</div>") == long
    assert html_extract.main_text(f"<div class='header'>Name of the site and its long, long claim. It goes on, too.</div><div class=post-content><p>Hi.</p><p>{long}</p><p>Bye.</p></div><div id=sidebar>{long}</div>") == f"Hi. {long} Bye."
    assert html_extract.main_text(f"<article><div class='article-header'><h1>T</h1></div><p>{long}<math><mi>x</mi></math><footer>f</footer><nav>n</nav><p class=notice>n</p></article>") == f"T {long} x"
    assert html_extract.main_text(f"<div role=banner>{long}</div><div role='main'><p>Short</p></div><div role=contentinfo>{long}</div>") == "Short"


def test_the_cut_overrules_the_classifier(monkeypatch):
    flows = []
    flow = html_extract._source_side
    monkeypatch.setattr(html_extract, "_source_side", lambda *a: flows.append(a) or flow(*a))
    some = "Ten words of text that say something about the matter"
    pages = {  # what the classifier turns down among text stays, what it takes among boilerplate goes
        f"<body><div><p>{some}.</p><p>Aside</p><p>{some}.</p><p>Two words</p><p>{some}.</p></div></body>": ("Aside", True),
        f"<body><div><p>{some}.</p><h2>Heading</h2><p>{some}.</p></div><ul class=menu><li><a href=1>one</a><li><a href=2>two</a></ul></body>": ("Heading", True),
        "<body><div><p>Home</p><p>Login</p><p>Search now.</p><p>Terms</p><p>Imprint</p></div></body>": ("Search now.", False),
    }
    for page, (text, kept) in pages.items():
        bs, has = html_extract.blocks(page)
        alone = {b.text: html_extract.unary(b, has) > 0 for b in bs}
        flows.clear()
        assert alone[text] != kept and (text in html_extract.main_text(page)) == kept and flows
        costs, ties = [html_extract.unary(b, has) for b in bs], html_extract.edges(bs)
        assert all(abs(c) <= html_extract.MOST for c in costs) and max(w for *_, w in ties) > min(map(abs, costs))


def test_names_are_weak_evidence():
    short, long = "He was born at sea.", "His family had moved there some years before, when the harbour was being built, and stayed."
    for page in (f'<article><section id="social-history"><p>{short}</p><p>{long}</p></section></article>', f'<article><div class="share-price"><p>{long}</p></div></article>', f'<div class="related-work"><p>{long}</p><p>{long}</p></div>'):
        assert html_extract.main_text(page) == re.sub(" +", " ", re.sub("<[^>]*>", " ", page)).strip()
    assert html_extract.main_text(f'<article><p>{long}</p><div class="ad-banner"><p>{long}</p></div><p>{short}</p></article>') == f"{long} {short}"


def test_html_takes_time_and_memory_in_proportion():
    import time

    begin = time.perf_counter()
    for page in ("<div>x" * 60_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<p><table>" + "<div>x" * 40_000, "<ul><li>" * 40_000 + "x", ("<p>" + "word " * 25 + ".</p><p>one</p>" * 3) * 20_000):
        html_extract.main_text(page)
    assert time.perf_counter() - begin < 20


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.floats(0, 4)), max_size=14))
@settings(max_examples=300, deadline=None)
def test_minimum_cut_is_minimal(costs, ties):
    ties = [(a, b, w) for a, b, w in ties if a < len(costs) and b < len(costs)]

    def energy(x):
        return sum(max(0, c) if not on else max(0, -c) for c, on in zip(costs, x, strict=True)) + sum(w for a, b, w in ties if x[a] != x[b])

    best = min(energy([bool(m >> i & 1) for i in range(len(costs))]) for m in range(1 << len(costs)))
    assert energy(html_extract.minimum_cut(costs, ties)) == pytest.approx(best, abs=1e-9)


def test_html_query(spark, sf):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        m = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)
        inner = re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", m[1]))
        assert r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "c"), (None, "u", "<p>a</p>", "c"), (1, "u", "", "c")], "page_id long, url string, html string, text string")
    assert html_extract.extract(odd).count() == 3 and html_extract.extract(odd.limit(0)).count() == 0


# --- 5 ---


def test_token_counts(spark, sf):
    enc = token_counts.load_encoding(queries.tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lens = [len(enc.encode_ordinary(t)) for t in texts]
    limits = queries.op5_token_counts(spark, sf)
    rows = sorted(limits.collect(), key=lambda r: r["n_tokens"])
    assert [(r["n_tokens"], r["n_docs"]) for r in rows] == sorted(Counter(lens).items())
    for r in rows:
        L = r["n_tokens"]
        assert r["docs_within"] == sum(x <= L for x in lens) and r["tokens_within"] == sum(x for x in lens if x <= L)
        assert r["docs_over"] == sum(x > L for x in lens) and r["tokens_over"] == sum(x for x in lens if x > L)
        assert r["truncated_total"] == sum(min(x, L) for x in lens)
    for L in (0, 1, 100, 777, 10**6):
        assert token_counts.truncated_total(limits, L) == sum(min(x, L) for x in lens)
    for q in (0.01, 0.5, 0.99, 1.0):
        assert token_counts.length_quantile(limits, q) == sorted(lens)[math.ceil(q * len(lens)) - 1]


def test_pieces_change_nothing():
    enc = token_counts.load_encoding(queries.tokenizer_path())
    t = "It's  a test, 12 of\n\n words   and   blanks.  é " * 40
    t += "naïve,x" * 30 + "abc123" * 30 + "don't.e\u0301a" * 30
    assert max(map(len, token_counts.pieces(t, 7))) < 40
    for size in (1, 7, 50):
        assert [x for p in token_counts.pieces(t, size) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
        assert "".join(token_counts.pieces(t, size)) == t


def test_token_counts_odd(spark):
    df, n = odd_docs(spark)
    counts = token_counts.count_tokens(df, queries.tokenizer_path())
    assert counts.count() == n and counts.where("doc_id in (1, 2) and n_tokens <> 0").count() == 0
    empty = token_counts.token_limits(df.limit(0), queries.tokenizer_path())
    assert empty.count() == 0 and token_counts.length_quantile(empty, 0.5) is None and token_counts.truncated_total(empty, 5) == 0


# --- 6 ---


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, "http://a/3\r\nX: y", "é😀" * 10), (2, None, None), (4, "http://b", ""), (7, "http://c", "z" * 3_000_000), (9, "http://a/3", "é😀" * 10), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(body.encode()) and r["payload_digest"] == warc.base32_sha1(body.encode())
    kinds = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "revisit", 3), (2, "response", None), (3, "response", None), (4, "revisit", 2), (5, "revisit", 3), (7, "response", None), (9, "response", None), (9, "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0
    least = warc.round_trip(pages, least=5).where("record_type = 'revisit'").count()
    assert least == 0
    none = spark.createDataFrame([(None, "u", "x"), (None, "v", "x")], pages.schema[:3])
    assert [r["record_type"] for r in warc.round_trip(none).collect()] == ["response"] * 2


def test_an_attempt_has_archives_of_its_own(spark, tmp_path):
    """Rows dealt otherwise by a second attempt do not change what the first one's rows tell of."""
    pages = spark.createDataFrame([(i, "u", f"{i % 3}") for i in range(12)], "page_id long, url string, html string")
    a = warc.write_monolithic(pages.coalesce(1).orderBy("page_id"), str(tmp_path))
    b = warc.write_monolithic(pages.coalesce(1).orderBy(F.col("page_id").desc()), str(tmp_path))
    assert not {r[0] for r in a.select("archive").collect()} & {r[0] for r in b.select("archive").collect()}
    for written in (a, b):
        for r in written.collect():
            import io

            record = list(warc.records(warc.inflate(io.BytesIO(open(f"{tmp_path}/{r['archive']}", "rb").read()))))[r["seq"]]
            assert record[0]["X-Row-Key"] == str(r["id"])


def test_warc_files(spark, tmp_path):
    """The normalised archive opens member by member, also from many-member input, and the texts come back."""
    import gzip
    import io

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(30)], "page_id long, url string, html string")
    src, dst = str(tmp_path / "mono"), str(tmp_path / "own")
    written = warc.write_monolithic(pages.coalesce(1), src, archive_bytes=8000)
    names = [r[0] for r in written.select("archive").distinct().orderBy("archive").collect()]
    assert len(names) > 1
    done = warc.normalise(written.select("archive").distinct().withColumn("again", F.lit(None).cast("array<struct<seq:bigint,first:string>>")), src, dst)
    assert done.agg(F.sum("n_records")).first()[0] == 30
    for name in names:
        whole = gzip.open(f"{src}/{name}").read()
        assert gzip.open(f"{dst}/{name}").read() == whole
        raw = open(f"{dst}/{name}", "rb").read()
        places = [list(map(int, x.split("\t")[:2])) for x in open(f"{dst}/{name}.idx").read().splitlines()]
        assert sum(n for _, n in places) == len(raw)
        assert b"".join(gzip.decompress(raw[o : o + n]) for o, n in places) == whole
    back = warc.read_archives(done, dst)
    assert {(r["id"], bytes(r["payload"]).decode(), r["url"]) for r in back.collect()} == {(i, f"<p>{i}</p>" * 50, f"http://a/{i}") for i in range(30)}
    raw = open(f"{dst}/{names[0]}", "rb").read()
    assert len(list(warc.records(warc.inflate(io.BytesIO(raw))))) == len(list(warc.records(warc.inflate(io.BytesIO(open(f"{src}/{names[0]}", "rb").read())))))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(open(f"{src}/{names[0]}", "rb").read()[:-200]))))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"junk\r\n\r\n"])))
    assert list(warc.records(warc.inflate(io.BytesIO(b"")))) == []


# --- 7 ---


def shingles(t, k=5):
    w = WORD.findall((t or "").translate(UP))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(sets[d]), top(d)) for d in ids}


def near_docs(seed, n_groups=6, copies=12):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    out = []
    for _ in range(n_groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
    out += ["", None, " ", "one", "ONE", "one two", "One\tTwo", "é É", "É É"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block,percent", [(minhash.BLOCK_SHINGLES, 80), (400, 85)])
def test_near_duplicates(spark, monkeypatch, block, percent):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    docs = near_docs(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bands", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert got == brute_components(docs, percent)


def test_near_duplicates_other_ways(spark, monkeypatch):
    docs = near_docs(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in (("LEAST_HOT", 0), ("HOT_SHARE", 10**9), ("MOST_FILTER", 1), ("BROADCAST_PLAN", -1), ("BLOCK_SHINGLES", 400)):  # every key hot, sets found by a join
        monkeypatch.setattr(minhash, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(docs)


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=14), st.sampled_from([50, 80, 85, 100]))
@settings(max_examples=300, deadline=None)
def test_links_are_a_forest_of_all_that_is_linked(sets, percent):
    def trees(pairs):
        up = list(range(len(sets)))
        for a, b in pairs:
            x = up[a]
            up = [up[b] if u == x else u for u in up]
        return {frozenset(i for i in range(len(sets)) if up[i] == u) for u in up}

    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    arrays = [np.array(sorted(x), np.int64) for x in sets]
    got = minhash._links(np.arange(len(sets)), arrays, np.zeros(len(sets), np.int64), percent)
    assert trees(got) == trees(linked) and len(got) == len(sets) - len(trees(got))


def test_loosely_alike_texts_are_not_all_compared():
    import time

    rnd = np.random.default_rng(2)
    common = rnd.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate((common, rnd.integers(0, 2**62, 60)))) for _ in range(4000)]
    begin = time.perf_counter()
    assert minhash._links(np.arange(4000), sets, np.zeros(4000, np.int64), 80) == []
    assert time.perf_counter() - begin < 10


@pytest.mark.parametrize("limit", [minhash.BROADCAST_IDS, -1])
def test_without(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", limit)
    docs = spark.createDataFrame([(i, f"t{i}", "c") for i in [*range(200), None, 7, 8]], "doc_id long, text string, key string").withColumn("block", F.lit(1))
    gone = spark.createDataFrame([(i,) for i in [*range(0, 200, 2), None, 4, 1000]], "doc_id long")
    got = minhash.without(docs, gone)
    assert got.columns == docs.columns and sorted((r["doc_id"] or -1) for r in got.collect()) == sorted([-1, 7, *range(1, 200, 2)])
    assert minhash.without(docs, gone.limit(0)).count() == 203 and minhash.without(docs.limit(0), gone).count() == 0


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    rows = spark.createDataFrame([(5, "one two"), (3, "one two"), (None, "one two")], "doc_id int, text string")
    got = minhash.near_duplicates(rows)
    assert dict(got.dtypes)["doc_id"] == "int" and {(r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()} == {(5, 3, False), (3, 3, True), (None, None, True)}


def test_bands_keep_to_the_share_missed():
    for percent in (60, 80, 85, 95):
        b, at = minhash.bands_for(percent), (percent / 100) ** (2 * minhash.PERMUTATIONS_PER_BAND)
        assert (1 - at) ** b <= minhash.MISSED < (1 - at) ** (b - 1)


def test_near_duplicates_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op7_minhash(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_odd(spark):
    df, n = odd_docs(spark)
    assert minhash.near_duplicates(df).count() == n and minhash.near_duplicates(df.limit(0)).count() == 0


def test_min_max_estimates_are_unbiased():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    errors = []
    for k in range(40):
        a, b = np.unique(pool[k * 10 : k * 10 + 400]), np.unique(pool[k * 10 + 60 : k * 10 + 460])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(float((minhash.signature(a) == minhash.signature(b)).mean()) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_components(spark, edges):
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == up


# --- 8 ---


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(win)
    hit = {j for i, x in enumerate(win) if count[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n ", "a b c d e", "a b c d e f a b c d e", "x\nx\n\nx \ny", "a " * 30, "#*$ %&|<>\né😀\x0b\x1fz"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60))) + "\n" + "w w\n" * rnd.randint(0, 3) for _ in range(40)]
    texts.append("lorem ipsum " * 20_000)
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS)
    for r in quality.judge_quality(df).collect():
        want = brute_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def mcd_brute(X, steps, share):
    """The same concentration steps in numpy, on fixed-point statistics."""
    floors = np.array(list(quality.FEATURES.values()))
    F_ = np.round(X * quality.SCALE)
    med = np.median(F_, axis=0) / quality.SCALE
    x = F_ / quality.SCALE
    d = (((x - med) / (2 * floors)) ** 2).sum(1)
    for step in range(steps):
        b = np.floor(np.log1p(d) * quality.BINS_PER_UNIT)
        edge = np.sort(b)[math.ceil(len(b) * share - 1e-12) - 1]
        core = x[b <= edge]
        m = core.mean(0)
        cov = (core - m).T @ (core - m) / len(core) + np.diag(floors**2)
        z = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        new = np.linalg.slogdet(cov)[1]
        if step and new >= size:
            break
        d = (z**2).sum(0)
        if step and size - new <= quality.SETTLED:
            break
        size = new
    return d


def test_robust_distances(spark):
    rnd = np.random.default_rng(4)
    X = rnd.normal([6, 5, 0.1, 0.2, 0.02], [0.8, 0.3, 0.05, 0.2, 0.01], (400, 5))
    X[:40] += [0, 4, 2, 1, 0.5]
    cols = ", ".join(f"f{i} long" for i in range(5))
    rows = [(int(i), "g", *map(int, np.round(r * quality.SCALE))) for i, r in enumerate(X)]
    df = spark.createDataFrame(rows, f"id long, k0 string, {cols}")
    got = {r["id"]: r["dist"] for r in quality.outlier_distance(df, ["k0"]).collect()}
    want = mcd_brute(X, quality.STEPS, quality.CORE)
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    assert want[:40].min() > quality.CUTOFF > np.sort(want[40:])[-4]
    again = quality.outlier_distance(df.repartition(7).sortWithinPartitions(F.rand(3)), ["k0"]).collect()
    assert {r["id"]: r["dist"] for r in again} == got  # to the last bit


def test_quality_keeps_the_good(spark, sf):
    lab = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    q = queries.op8_quality(spark, sf.replace("0.001", "0.01")).where("not base_failed").join(lab, "doc_id")
    share = {r["quality"]: r["k"] for r in q.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.7


def test_small_groups_are_judged_by_their_language(spark):
    rnd = random.Random(7)
    text = lambda size: " ".join("".join(rnd.choice("abcdefgh") for _ in range(size)) for _ in range(rnd.randint(40, 80)))
    rows = [(i, text(5), "en", "large", 1) for i in range(200)] + [(1000, text(40), "en", "alone", 1), (1001, text(5), "en", "lone", 1)]
    rows += [(2000, text(40), "fr", "large", 1), (2001, text(5), None, None, 1)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in (1000, 1001, 2000, 2001)] == [False, True, False, True]


def test_quality_odd(spark):
    df, n = odd_docs(spark)
    assert quality.judge_quality(df).count() == n and quality.judge_quality(df.limit(0)).count() == 0


# --- 9 ---


def test_language_accuracy(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    q = queries.op9_language(spark, d).join(docs, "doc_id")
    assert q.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert q.where("score < 0 or score > 1").count() == 0


def ppm_bits(train, text, order=langid.ORDER):
    """The code length by the definition, byte by byte."""
    counts: dict = {}
    for t in train:
        s = bytes(order) + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    total, s = 0.0, bytes(order) + text
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                total -= math.log2(c[s[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


@given(st.binary(max_size=60), st.integers(5, 40))
@settings(max_examples=40, deadline=None)
def test_code_lengths_are_exact(text, chunk):
    train = {"x": [b"the cat sat on the mat", b"the hat"], "y": [b"le chat est la", b"aaaa\xc3\xa9"]}
    m = langid.Model(train)
    langid.CHUNK, was = chunk, langid.CHUNK
    try:
        got = m.code_lengths([memoryview(b""), memoryview(text), memoryview(b"the cat")])
    finally:
        langid.CHUNK = was
    for j, lang in enumerate(m.langs):
        assert got[1][j] == pytest.approx(ppm_bits(train[lang], text), rel=1e-4, abs=1e-3)
        assert got[2][j] == pytest.approx(ppm_bits(train[lang], b"the cat"), rel=1e-4)
    assert not got[0].any()


def test_blocks_of_languages_change_nothing(monkeypatch):
    rnd = random.Random(1)
    train = {f"l{i}": [bytes(rnd.choice(b"abcdefgh "[i % 4 :]) for _ in range(300))] for i in range(7)}
    texts = [memoryview(bytes(rnd.choice(b"abcdefgh ") for _ in range(n))) for n in (0, 1, 50, 400)]
    whole = langid.Model(train).code_lengths(texts)
    monkeypatch.setattr(langid, "TOGETHER", 2)
    parts = langid.Model(train)
    assert len(parts.blocks) == 4 and np.allclose(parts.code_lengths(texts), whole) and langid.Model({}).code_lengths(texts).shape == (4, 0)


def test_training_is_bounded_and_lower_cases_alike(spark, monkeypatch):
    rows = [(i, "ΟΔΟΣ İSTANBUL " * 40, f"l{i % 5}", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(langid, "TRAIN_BYTES", 100_000)
    sample = langid.training_sample(docs).collect()
    assert {r["lang"] for r in sample} == {f"l{i}" for i in range(5)} and sum(len(r["text"].encode()) for r in sample) <= 100_000
    model = langid.train(docs)
    assert langid.Model({"l0": [bytes(langid._lower(langid.pa.array([r["text"]]))[0].as_buffer()) for r in sample if r["lang"] == "l0"]}).code_lengths([memoryview("οδος".encode())])[0, 0] == model.code_lengths([memoryview("οδος".encode())])[0, 0]
    monkeypatch.setattr(langid, "MOST_LANGS", 4)
    with pytest.raises(ValueError):
        langid.train(docs)


def test_language_odd(spark):
    df, n = odd_docs(spark)
    got = langid.identify(df)
    assert got.count() == n and got.where("doc_id in (1, 2, 3, 7) and lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0)).count() == 0
    assert {r[0] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}
    out = langid.predict(df, langid.train(df))
    assert [c for c in out.columns if c not in ("lang_pred", "score")] == [c for c in df.columns if c not in ("lang_pred", "score")]


def test_long_documents_are_trained_on(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en", None, 1) for i in range(40)]
    rows += [(100 + i, "a" * (i % 2) + "ще не вмерла україни ні слава ні воля " * 1500, "uk", None, 1) for i in range(8)]
    df = spark.createDataFrame(rows, DOCS)
    took = [r["text"] for r in langid.training_sample(df).where("lang = 'uk'").collect()]
    assert took and all(langid.TRAIN_DOC_BYTES - 2 < len(t.encode()) <= langid.TRAIN_DOC_BYTES and "\ufffd" not in t for t in took)
    assert {r["lang_pred"] for r in langid.identify(df).where("doc_id >= 100").collect()} == {"uk"}


def test_training_sees_no_held_out_document(spark):
    import zlib

    df = spark.createDataFrame([(i, f"text number {i}", "en", None, 1) for i in range(200)], DOCS)
    seen = {int(r["text"].split()[-1]) for r in langid.training_sample(df, docs_per_lang=1000).collect()}
    assert seen == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert langid.training_sample(df, docs_per_lang=7).count() == 7
    again = df.unionByName(df.withColumn("text", F.concat(F.lit("a"), "text")))
    assert {r["text"] for r in langid.training_sample(again, docs_per_lang=1000).collect()} == {f"atext number {i}" for i in seen}


# --- 10 ---


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by the rounds of the definition."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


@given(st.dictionaries(st.sampled_from(["a", "b", "B", "é", "z", None]), st.integers(0, 1000), min_size=1))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_plan(df, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mixture(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = queries.op10_mixing(spark, d)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in got.collect()}
    sizes: Counter = Counter()
    for i, r in docs.items():
        assert rows[i]["size"] == len(WORD.findall(r["text"]))
        sizes[r["source"]] += rows[i]["size"]
    want = fill(sizes)
    taken: Counter = Counter()
    for i, r in rows.items():
        assert r["target"] == pytest.approx(want[docs[i]["source"]]) and r["source_size"] == sizes[docs[i]["source"]]
        assert r["taken"] in (r["size"] * math.floor(r["rate"]), r["size"] * (math.floor(r["rate"]) + 1)) and r["taken"] <= 3 * r["size"]
        taken[docs[i]["source"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.op10_mixing(spark, d).collect()))


def test_mixture_odd(spark, monkeypatch):
    df, n = odd_docs(spark)
    plan = mixing.plan_copies(df)
    assert plan.count() == n and mixing.plan_copies(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert [c for c in mixed.columns if c != "copy_no"] == [c for c in df.columns if c != "copy_no"]
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # joined by shuffle instead
    assert sorted(map(str, mixing.plan_copies(df).collect())) == sorted(map(str, plan.collect()))


# --- all ---


def test_intermediates_are_deleted(spark):
    import os

    df = common.materialise(spark.range(3).withColumn("written_at", F.lit("clash")), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    common.discard(spark.range(1).withColumn("written_at", F.lit("clash")))
    assert os.path.exists(path) and df.count() == 3
    common.discard(df, df)
    assert not os.path.exists(path)


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_with_sql(spark, sf, name):
    from tests.test_catalog import connect, same

    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
