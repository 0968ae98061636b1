"""The library's queries over the test tables, and SQL for the same rows.

Graph queries come twice: over words, and over the tokens that the gates discover. The fold of one LZ gate is a reduction in
SQL; that of the other gates and sequencers has none, and tests hold the kernel against hand-traced vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import decode as dec
from ..operators import graph, metrics, stats
from ..operators.sequence import joined_streams, ordered_tokens, snapshots, spread, stream_boundary_counts, stream_continuity, stream_edges, stream_ends, stream_joined, stream_pairs, tokens, whitespace_tokens, word_edges, word_ends, word_indices, word_markov, word_nodes, word_pairs, word_touches, word_vocabulary
from ..sources import corpus, files

_W = r"""w AS MATERIALIZED (SELECT stream_key, tok_pos, token_str FROM (SELECT doc_id AS stream_key, unnest(ws) AS token_str, (generate_subscripts(ws, 1) - 1)::BIGINT AS tok_pos
  FROM (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS ws FROM documents)) WHERE token_str <> '')"""
_B = _W + """, b AS MATERIALIZED (SELECT stream_key, tok_pos AS pos, origin, token_str AS terminal FROM (SELECT *, lag(token_str) OVER (PARTITION BY stream_key ORDER BY tok_pos) AS origin,
  row_number() OVER (PARTITION BY stream_key ORDER BY tok_pos) AS n FROM w) WHERE n > 1)"""
_E = _B + ", e AS MATERIALIZED (SELECT origin, terminal, count(*)::DOUBLE AS weight FROM b GROUP BY 1, 2)"
_S = _E + """, s AS MATERIALIZED (SELECT token, sum(i) AS in_weight, sum(o) AS out_weight, sum(di)::BIGINT AS in_degree, sum(d_o)::BIGINT AS out_degree FROM
  (SELECT origin AS token, 0.0::DOUBLE AS i, weight AS o, 0 AS di, 1 AS d_o FROM e UNION ALL SELECT terminal, weight, 0.0::DOUBLE, 1, 0 FROM e) GROUP BY 1)"""
_LAST = """chg AS (SELECT *, CASE WHEN lag(terminal) OVER o IS DISTINCT FROM terminal THEN 1 ELSE 0 END AS chg FROM b WINDOW o AS (PARTITION BY origin ORDER BY stream_key, pos)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY origin ORDER BY stream_key, pos) AS run FROM chg), h AS (SELECT *, max(run) OVER (PARTITION BY origin) AS last_run FROM g)"""
_I = ", n AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY token) - 1 AS dense_idx FROM s)"
# The LZ fold, one step a codepoint: the rolling key, the keys seen, the ends of tokens. Keys are never evicted here, so this is
# right for texts of up to the cache's capacity (70,000 codepoints).
_FOLD = """f AS MATERIALIZED (SELECT stream_key, text, list_append(list_reduce(list_zip(cps, range(len(cps))),
  lambda a, x: CASE WHEN list_contains(a.seen, ((a.h * 31 + x[1]) & 4294967295)::UINTEGER) THEN struct_pack(h := (a.h * 31 + x[1]) & 4294967295, seen := a.seen, ends := a.ends)
    ELSE struct_pack(h := (2166136261 * 31 + x[1]) & 4294967295, seen := list_append(a.seen, ((a.h * 31 + x[1]) & 4294967295)::UINTEGER), ends := list_append(a.ends, x[2]::INTEGER)) END,
  struct_pack(h := 2166136261::BIGINT, seen := []::UINTEGER[], ends := []::INTEGER[])).ends, len(cps)::INTEGER) AS ends
  FROM (SELECT stream_key, text, CASE WHEN text <> '' THEN list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) ELSE []::BIGINT[] END AS cps FROM streams)),
z AS MATERIALIZED (SELECT stream_key, x[3] AS tok_pos, substr(text, x[1] + 1, x[2] - x[1]) AS token_str, x[3] = n - 1 AS is_flush, x[2] AS upto, length(text) AS size
  FROM (SELECT stream_key, text, len(ends) AS n, unnest(list_zip(list_concat([0::INTEGER], ends), ends, range(len(ends)), true)) AS x FROM f))"""
_Z = "streams AS (SELECT doc_id AS stream_key, coalesce(text, '') AS text FROM documents), " + _FOLD
_ZB = _Z + """, b AS MATERIALIZED (SELECT stream_key, tok_pos AS pos, origin, token_str AS terminal FROM
  (SELECT *, lag(token_str) OVER (PARTITION BY stream_key ORDER BY tok_pos) AS origin FROM z WHERE NOT is_flush) WHERE tok_pos > 0)"""
_ZE = _ZB + ", e AS MATERIALIZED (SELECT origin, terminal, count(*)::DOUBLE AS weight FROM b GROUP BY 1, 2)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))


def _words(spark, sf_dir):
    return whitespace_tokens(_docs(spark, sf_dir))


def _pairs(spark, sf_dir):
    return word_pairs(_docs(spark, sf_dir))


def _edges(spark, sf_dir):
    return graph.edges_accumulate(word_edges(_docs(spark, sf_dir)), summed=True)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- text and codecs ---


@query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.nfc("text").alias("text"))


@query(r"""SELECT doc_id, text FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM (SELECT * FROM documents ORDER BY doc_id OFFSET 20)) WHERE text <> '' ORDER BY doc_id LIMIT 300""")
def corpus_page(spark, sf_dir):
    return corpus.page_of_rows(_docs(spark, sf_dir), "doc_id", 300, 20)


@query("SELECT cp::INT AS cp, count(*) AS n FROM (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents WHERE text <> '') GROUP BY 1")
def codepoint_counts(spark, sf_dir):
    return corpus.as_codepoints(_docs(spark, sf_dir), "doc_id").groupBy("cp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text = array_to_string(list_transform(string_split(text, ''), lambda c: chr(unicode(c))), '') AS same, strlen(text)::BIGINT AS n_bytes FROM documents WHERE text <> ''")
def codepoint_round_trip(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text <> ''")
    return d.select("doc_id", (text.from_codepoints(text.codepoints(F.col("text"))) == F.col("text")).alias("same"), F.octet_length(text.to_utf8(F.col("text"))).cast("long").alias("n_bytes"))


@query("SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes FROM documents")
def source_size(spark, sf_dir):
    return corpus.source_size(_docs(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN n_chars * (350 / 1024.0::DOUBLE) < 1024 THEN format('~{:.1f} KB', round(n_chars * (350 / 1024.0::DOUBLE), 1)) ELSE format('~{:.1f} MB', round(n_chars * (350 / 1024.0::DOUBLE) / 1024, 1)) END AS size FROM documents""")
def size_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.estimate_size(F.col("n_chars")).alias("size"))


@query(f"WITH {_W}, t AS (SELECT DISTINCT token_str AS token FROM w) SELECT token, list_reduce(list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 2166136261::BIGINT) AS key FROM t")
def rolling_keys(spark, sf_dir):
    t = _words(spark, sf_dir).select(F.col("token_str").alias("token")).distinct()
    return t.select("token", codec.rolling_key(text.codepoints(F.col("token"))).alias("key"))


@query(f"""WITH {_W}, t AS (SELECT DISTINCT token_str AS token FROM w), d AS (SELECT token, array_to_string(list_transform(string_split(token, ''), lambda c: lpad(bin(unicode(c) + 1), 21, '0')), '') AS bits FROM t),
p AS (SELECT token, repeat('0', ((4 - len(bits) % 4) % 4)::INT) || bits AS bits FROM d)
SELECT token, ltrim(array_to_string(list_transform(range(0, len(bits), 4), lambda i: substr('0123456789ABCDEF', 1 + (strpos('0000,0001,0010,0011,0100,0101,0110,0111,1000,1001,1010,1011,1100,1101,1110,1111', substr(bits, i + 1, 4)) - 1) // 5, 1)), ''), '0') AS id, token AS decoded FROM p""")
def token_ids(spark, sf_dir):
    """Ids of tokens of any length, in hexadecimal, and back."""
    t = _words(spark, sf_dir).select(F.col("token_str").alias("token")).distinct()
    ids = t.withColumn("id", codec.token_hex(text.codepoints(F.col("token"))))
    return ids.withColumn("decoded", text.from_codepoints(codec.token_of_hex(F.col("id"))))


@query(f"WITH {_W}, t AS (SELECT DISTINCT token_str AS token FROM w WHERE length(token_str) <= 5) SELECT token, list_reduce(list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT), lambda v, c: v * 256 + (c & 255), 0::BIGINT) * 256 + length(token) AS packed, length(token)::BIGINT AS n FROM t")
def packed_ngrams(spark, sf_dir):
    t = _words(spark, sf_dir).where(F.length("token_str") <= 5).select(F.col("token_str").alias("token")).distinct()
    p = t.withColumn("packed", codec.pack_column(text.codepoints(F.col("token"))))
    return p.withColumn("n", F.size(codec.unpack_column(F.col("packed"))).cast("long"))


@query(r"SELECT page_id, (NOT regexp_matches(p, '^(.*/)?[^/]*\.(com|net)/en/.*$') OR regexp_matches(p, '^blog\.[^/]*/.*$')) AS kept FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)")
def ignore_rules(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    return p.select("page_id", (~files.ignored(F.col("p"), ["**/*.com/en/**", "**/*.net/en/**"], ["blog.*/"])).alias("kept"))


_PLACES = ("", "build/", "src/build/", "node_modules/", "a/node_modules/", ".git/", "dist/", ".cache/", ".next/a/", "coverage/", "a/coverage/", ".idea/", "a/.idea/", ".vscode/", "src/")
_NAMES = ("x.log", ".env", ".env.local", ".DS_Store", "yarn.lock", "x.min.js", "x.tmp", "main.py", "a.log/x")


@query(rf"""WITH c AS (SELECT page_id, d || n || CASE WHEN page_id % 7 = 0 THEN '' ELSE '.' || page_id END AS path FROM pages, unnest({list(_PLACES)}) AS a(d), unnest({list(_NAMES)}) AS b(n))
SELECT page_id, path, NOT (regexp_matches(path, '^(node_modules|\.git|dist|build|\.cache|\.next|coverage|\.idea|\.vscode)/') OR regexp_matches(path, '^[^/]*\.log(/|$)') OR regexp_matches(path, '^\.env[^/]*$') OR path = '.DS_Store' OR regexp_matches(path, '(^|/)yarn\.lock$')) AS kept FROM c""")
def ignore_fallback(spark, sf_dir):
    """The patterns that hold without an ignore file, over paths at several depths."""
    lists = [F.explode(F.array(*[F.lit(x) for x in xs])) for xs in (_PLACES, _NAMES)]
    rows = _t(spark, sf_dir, "pages").select("page_id", lists[0].alias("d")).select("page_id", "d", lists[1].alias("n"))
    tail = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("."), F.col("page_id").cast("string")))
    return rows.select("page_id", F.concat("d", "n", tail).alias("path")).withColumn("kept", ~files.excluded(F.col("path")))


@query("""SELECT url AS path, chr(10) || repeat('#', 80) || chr(10) || '# FILE PATH: ' || url || chr(10) || repeat('#', 80) || chr(10) || chr(10) || html || chr(10) || '# END OF FILE: ' || url || chr(10) || chr(10) AS body FROM pages WHERE url IS NOT NULL AND html IS NOT NULL""")
def file_bundle(spark, sf_dir):
    return files.bundle(_t(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")))


# --- graphs over words ---


@query(f"WITH {_B} SELECT stream_key, pos, origin, terminal FROM b")
def word_bigrams(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {_E} SELECT * FROM e")
def edges_accumulate(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_B}, {_LAST} SELECT origin, terminal, count(*)::DOUBLE AS weight FROM h WHERE run = last_run GROUP BY 1, 2")
def edges_last_run(spark, sf_dir):
    return graph.merge_ends(word_ends(_docs(spark, sf_dir), latest=True))


@query(f"WITH {_E} SELECT origin AS token FROM e UNION SELECT terminal FROM e")
def node_set(spark, sf_dir):
    return word_nodes(_docs(spark, sf_dir))


@query(f"WITH {_S} SELECT * FROM s")
def node_strengths(spark, sf_dir):
    return graph.strengths(_edges(spark, sf_dir))


@query(f"WITH {_S} SELECT token, in_weight, round(ln((in_weight + 0.1::DOUBLE) / ((SELECT sum(in_weight) FROM s) + 0.1::DOUBLE * (SELECT count(*) FROM s))), 6) AS log_p FROM s")
def node_potentials(spark, sf_dir):
    return graph.node_potentials(_edges(spark, sf_dir)).withColumn("log_p", _r(F.col("log_p")))


@query(f"WITH {_E} SELECT origin, terminal, weight, round(ln(weight) - ln(sum(weight) OVER (PARTITION BY origin)), 6) AS log_w FROM e")
def transition_log_probs(spark, sf_dir):
    return graph.transitions(_edges(spark, sf_dir)).withColumn("log_w", _r(F.col("log_w")))


@query(f"WITH {_S}{_I} SELECT * FROM n")
def dense_indices(spark, sf_dir):
    return graph.dense_index(word_nodes(_docs(spark, sf_dir)))


@query(f"WITH {_S}{_I} SELECT a.dense_idx AS row_idx, c.dense_idx AS col_idx, round(ln(e.weight) - ln(sum(e.weight) OVER (PARTITION BY e.origin)), 6) AS log_w FROM e JOIN n a ON a.token = e.origin JOIN n c ON c.token = e.terminal")
def csr_cells(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return graph.csr(graph.edges_accumulate(p), graph.dense_index(graph.nodes(p)), whole=True)[0].withColumn("log_w", _r(F.col("log_w")))


@query(f"WITH {_S}{_I}, d AS (SELECT n.dense_idx, s.out_degree FROM n JOIN s USING (token)) SELECT 0::BIGINT AS dense_idx, 0::BIGINT AS ptr UNION ALL SELECT dense_idx + 1, sum(out_degree) OVER (ORDER BY dense_idx)::BIGINT FROM d")
def csr_row_ptr(spark, sf_dir):
    return graph.row_pointers(_pairs(spark, sf_dir))


@query(f"WITH {_S}{_I} SELECT w.stream_key, w.tok_pos, n.dense_idx FROM w LEFT JOIN n ON n.token = w.token_str")
def index_lookup(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return word_indices(docs, graph.dense_index(word_nodes(docs)))


@query(f"""WITH {_B}, o AS (SELECT origin AS token, max(struct_pack(k := stream_key, p := pos, s := 0)) AS a FROM b GROUP BY 1), t AS (SELECT terminal AS token, min(struct_pack(k := stream_key, p := pos, s := 1)) AS a FROM b GROUP BY 1),
x AS (SELECT token, coalesce(o.a, t.a) AS a FROM o FULL JOIN t USING (token))
SELECT token, a.k AS last_touch_key, a.p AS last_touch_pos, (row_number() OVER (ORDER BY a DESC, token) - 1)::BIGINT AS dense_idx FROM x ORDER BY a DESC, token LIMIT 50000""")
def lru_nodes(spark, sf_dir):
    return graph.lru_of(word_touches(_docs(spark, sf_dir)))


# --- statistics ---


@query(f"WITH {_S}, q AS (SELECT token_str AS token, count(*) AS strength FROM w GROUP BY 1) SELECT token, strength, coalesce(out_degree, 0) AS degree FROM q LEFT JOIN s USING (token)")
def token_table(spark, sf_dir):
    return stats.token_table(_words(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_S} SELECT origin, terminal, weight, round(ln(weight * (SELECT sum(weight) FROM e) / (a.out_weight * c.in_weight)), 6) AS pmi, round(2 * weight / (a.out_weight + c.in_weight), 6) AS dice FROM e JOIN s a ON a.token = origin JOIN s c ON c.token = terminal")
def pmi_dice(spark, sf_dir):
    return stats.association(_edges(spark, sf_dir)).withColumns({"pmi": _r(F.col("pmi")), "dice": _r(F.col("dice"))})


@query(f"WITH {_E}, p AS (SELECT origin, weight / sum(weight) OVER (PARTITION BY origin) AS p FROM e) SELECT origin, round(abs(-sum(p * ln(p))), 6) AS entropy FROM p GROUP BY 1")
def branching_entropy(spark, sf_dir):
    return stats.branching_entropy(_edges(spark, sf_dir)).withColumn("entropy", _r(F.abs("entropy")))


@query(f"WITH {_E} SELECT origin, terminal, weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY weight DESC, terminal) AS rank FROM e) WHERE rank <= 3")
def top_edges(spark, sf_dir):
    return stats.top_edges(_edges(spark, sf_dir))


@query(f"""WITH {_S}, p AS (SELECT e.*, ln(weight * (SELECT sum(weight) FROM e) / (a.out_weight * c.in_weight)) AS pmi FROM e JOIN s a ON a.token = origin JOIN s c ON c.token = terminal)
SELECT origin, terminal, weight FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY weight DESC, terminal) AS r FROM p WHERE pmi >= 1.0) WHERE r <= 8""")
def refined_edges(spark, sf_dir):
    return stats.refine(_edges(spark, sf_dir), 8, 1.0)


@query(f"WITH {_W}, q AS (SELECT token_str, count(*) AS strength FROM w GROUP BY 1), v AS (SELECT quantile_cont(strength, [0.5, 0.9, 0.99]) AS v FROM q) SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS q, round(unnest(v), 6) AS value FROM v")
def strength_percentiles(spark, sf_dir):
    return stats.percentiles(stats.token_strength(_words(spark, sf_dir)), "strength").withColumn("value", _r(F.col("value")))


@query(f"WITH {_S} SELECT CAST(floor(log2(out_degree::DOUBLE)) AS INT) AS bucket, count(*) AS n FROM s WHERE out_degree > 0 GROUP BY 1")
def degree_histogram(spark, sf_dir):
    return stats.histogram(graph.strengths(_edges(spark, sf_dir)), "out_degree")


@query(f"WITH {_S}, v AS (SELECT DISTINCT token_str AS token FROM w) SELECT token FROM v WHERE token NOT IN (SELECT token FROM s)")
def isolated_nodes(spark, sf_dir):
    return stats.untouched(word_vocabulary(_docs(spark, sf_dir)))


# --- metrics ---


@query(f"WITH {_W} SELECT count(*) AS n_tokens, round(avg(length(token_str)), 6) AS avg_length, round(count(*)::DOUBLE / sum(length(token_str))::DOUBLE, 6) AS tokens_per_char FROM w")
def token_lengths(spark, sf_dir):
    return metrics.length_stats(_words(spark, sf_dir)).withColumns({c: _r(F.col(c)) for c in ("avg_length", "tokens_per_char")})


@query("WITH c AS (SELECT doc_id, string_split(text, '') AS k FROM documents WHERE length(text) > 1) SELECT doc_id AS stream_key, count(*) FILTER (WHERE regexp_matches(a, '^\\s$') <> regexp_matches(z, '^\\s$')) AS n FROM (SELECT doc_id, unnest(k[:-2]) AS a, unnest(k[2:]) AS z FROM c) GROUP BY 1")
def space_boundaries(spark, sf_dir):
    got = metrics.space_boundaries(_docs(spark, sf_dir)).groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"))
    return _docs(spark, sf_dir).where(F.length("text") > 1).select(F.col("doc_id").alias("stream_key")).join(got, "stream_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_MARKOV = _B + """, k AS (SELECT *, count(*) OVER (PARTITION BY stream_key, origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_count,
  row_number() OVER (PARTITION BY stream_key, origin, terminal ORDER BY pos) - 1 AS edge_count FROM b),
m AS (SELECT *, coalesce(sum((edge_count = 0)::BIGINT) OVER (PARTITION BY stream_key, origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS degree FROM k)"""


@query(f"WITH {_MARKOV} SELECT stream_key, pos, origin, terminal, parent_count, edge_count, degree FROM m")
def running_markov(spark, sf_dir):
    return word_markov(_docs(spark, sf_dir))


@query(f"WITH {_MARKOV} SELECT stream_key, pos, round((edge_count + 0.1::DOUBLE) / (parent_count + 0.1::DOUBLE * greatest(degree, 1)), 6) AS p, round(CASE WHEN degree = 0 THEN 0 ELSE pow(least(degree, 2048)::DOUBLE, -0.8) END, 6) AS threshold FROM m")
def laplace_probs(spark, sf_dir):
    got = metrics.laplace(word_markov(_docs(spark, sf_dir)))
    return got.select("stream_key", "pos", _r(F.col("p")).alias("p"), _r(F.col("threshold")).alias("threshold"))


@query("""WITH v AS (SELECT user_id, list(value ORDER BY event_id) AS s FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, round(list_reduce(s, lambda m, x: m * (1 - 0.02::DOUBLE) + x * 0.02::DOUBLE, 0.2::DOUBLE), 6) AS ewma FROM v""")
def ewma_values(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value is not null")
    return metrics.ewma(e, "value", key_col="user_id", order_col="event_id").withColumn("ewma", _r(F.col("ewma")))


@query(f"WITH {_W}, c AS (SELECT sum(length(text))::BIGINT AS codepoints_in FROM documents), t AS (SELECT count(*) AS tokens_out FROM w) SELECT codepoints_in, tokens_out, round(tokens_out::DOUBLE / codepoints_in, CAST(1 - floor(log10(tokens_out::DOUBLE / codepoints_in)) AS INT)) AS compression_ratio FROM c, t")
def word_counters(spark, sf_dir):
    return metrics.counters(_words(spark, sf_dir), _docs(spark, sf_dir).select(F.length("text").alias("n")))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def joined_streams_by_turn(spark, sf_dir):
    return joined_streams(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# --- discovered tokens ---


@query(f"WITH {_Z} SELECT stream_key, tok_pos, token_str, is_flush FROM z")
def lz_tokens(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), lists=False)


@query(f"WITH {_ZB} SELECT * FROM b")
def lz_pairs(spark, sf_dir):
    return stream_pairs(_docs(spark, sf_dir))


@query(f"WITH {_ZE} SELECT * FROM e")
def lz_edges_accumulate(spark, sf_dir):
    return graph.edges_accumulate(stream_edges(_docs(spark, sf_dir)))


@query(f"WITH {_ZB}, {_LAST} SELECT origin, terminal, count(*)::DOUBLE AS weight FROM h WHERE run = last_run GROUP BY 1, 2")
def lz_edges_last_run(spark, sf_dir):
    return graph.merge_ends(stream_ends(_docs(spark, sf_dir), latest=True))


@query(f"""WITH {_ZE}, s AS (SELECT token, sum(w) AS in_weight FROM (SELECT origin AS token, 0.0::DOUBLE AS w FROM e UNION ALL SELECT terminal, weight FROM e) GROUP BY 1)
SELECT token, in_weight, round(ln((in_weight + 0.1::DOUBLE) / ((SELECT sum(in_weight) FROM s) + 0.1::DOUBLE * (SELECT count(*) FROM s))), 6) AS log_p FROM s""")
def lz_potentials(spark, sf_dir):
    return graph.node_potentials(graph.edges_accumulate(stream_edges(_docs(spark, sf_dir)))).withColumn("log_p", _r(F.col("log_p")))


@query()
def boundary_tokens(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), stack="boundary")


@query()
def merge_tokens(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), stack="merge")


@query()
def merge_tokens_lossless(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), stack="merge", compat="lossless")


@query()
def mdl_tokens(spark, sf_dir):
    return tokens(_docs(spark, sf_dir), gate="mdl")


@query(f"WITH streams AS (SELECT conv_id AS stream_key, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1), {_FOLD} SELECT stream_key, tok_pos, token_str, is_flush FROM z")
def conversation_tokens(spark, sf_dir):
    """Streams of many rows each, pushed through one sequencer a stream in order."""
    return ordered_tokens(_t(spark, sf_dir, "conversations"), "conv_id", "turn").drop("token")


@query("SELECT doc_id AS stream_key, text FROM documents")
def lz_joined_tokens(spark, sf_dir):
    """The tokens of a stream put together again are its text."""
    got = stream_joined(_docs(spark, sf_dir), compat="lossless")
    empty = _docs(spark, sf_dir).where("text is null or text = ''").select(F.col("doc_id").alias("stream_key"), "text")
    return got.unionByName(empty)


@query()
def sequencer_snapshots(spark, sf_dir):
    return snapshots(_docs(spark, sf_dir))


@query(f"WITH {_Z}, c AS (SELECT sum(length(text))::BIGINT AS codepoints_in FROM documents), t AS (SELECT count(*) AS tokens_out FROM z) SELECT codepoints_in, tokens_out, round(tokens_out::DOUBLE / codepoints_in, CAST(1 - floor(log10(tokens_out::DOUBLE / codepoints_in)) AS INT)) AS compression_ratio FROM c, t")
def lz_counters(spark, sf_dir):
    return metrics.counters(tokens(_docs(spark, sf_dir), lists=False), _docs(spark, sf_dir).select(F.length("text").alias("n")))


@query(f"""WITH {_Z}, k AS (SELECT stream_key, string_split(text, '') AS k FROM streams WHERE length(text) > 1),
g AS (SELECT stream_key, unnest(range(1, len(k))) AS place, unnest(k[:-2]) AS a, unnest(k[2:]) AS y FROM k),
t AS (SELECT stream_key, place FROM g WHERE regexp_matches(a, '^\\s$') <> regexp_matches(y, '^\\s$')),
q AS (SELECT DISTINCT stream_key, upto AS place FROM z WHERE upto > 0 AND upto < size),
x AS (SELECT (SELECT count(*) FROM q) AS n_found, (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM q JOIN t USING (stream_key, place)) AS n_both)
SELECT n_found, n_truth, n_both, round(n_both::DOUBLE / n_found, 6) AS precision, round(n_both::DOUBLE / n_truth, 6) AS recall, round(2 * n_both::DOUBLE / (n_found + n_truth), 6) AS f1 FROM x""")
def lz_boundary_f1(spark, sf_dir):
    got = metrics.f1(stream_boundary_counts(_docs(spark, sf_dir)))
    return got.withColumns({c: _r(F.col(c)) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_Z}, y AS (SELECT stream_key, tok_pos, token_str AS tok FROM z WHERE token_str <> ''),
l AS (SELECT stream_key, tok, max(tok_pos) AS last FROM y GROUP BY 1, 2),
h AS (SELECT stream_key, substr(tok, 1, n) AS tok, max(last) AS later FROM (SELECT *, unnest(range(1, length(tok))) AS n FROM l) GROUP BY 1, 2)
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE later > tok_pos) AS n_continued, round(count(*) FILTER (WHERE later > tok_pos)::DOUBLE / count(*), 6) AS continuity FROM y LEFT JOIN h USING (stream_key, tok)""")
def lz_continuity(spark, sf_dir):
    return metrics.continued(stream_continuity(_docs(spark, sf_dir))).withColumn("continuity", _r(F.col("continuity")))


@query()
def decode_benchmark(spark, sf_dir):
    return dec.decode_over(_t(spark, sf_dir, "benchmark"), stream_edges(_docs(spark, sf_dir)))


@query(f"""WITH {_W}, v AS MATERIALIZED (SELECT DISTINCT token_str AS token FROM w), l AS (SELECT DISTINCT length(token) AS n FROM v), p AS (SELECT item_id AS id, text, unnest(range(0, length(text))) AS pos FROM benchmark),
c AS (SELECT id, pos, substr(text, pos + 1, n) AS token FROM p JOIN l ON pos + n <= length(text)) SELECT id, pos::INT AS pos, token FROM c JOIN v USING (token)""")
def prefix_search(spark, sf_dir):
    vocabulary = _words(spark, sf_dir).select(F.col("token_str").alias("token"))
    return dec.prefixes(_t(spark, sf_dir, "benchmark"), vocabulary)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to tokens to edges to potentials: the 20 most probable tokens."""
    pot = graph.node_potentials(graph.edges_accumulate(stream_edges(_docs(spark, sf_dir))))
    return pot.orderBy(F.col("log_p").desc(), "token").limit(20)
