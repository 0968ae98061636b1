"""Personal data by bootstrapped contextual extraction.

Seeds are what strict rules find: e-mail addresses, IP addresses, payment cards, phone numbers. The words
around the seeds are lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the share of trust in the instances it holds, an unseen instance as trusted as its
patterns together make it, and so one pattern's finds support the next. In the end the high-confidence patterns take in look-alikes that
the strict rules turned down (a wrong check digit, a missing plus, no top-level domain).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; they end when a round changes no pattern.
ROUNDS = 6
#: A pattern counts from so much trust among its instances on (a seed is worth 1, others their confidence), and with such a
#: share of it (one more is added to what it holds).
LEAST_TRUST, PATTERN_SCORE = 5, 0.8
#: An unseen instance is taken in from this confidence on.
ACCEPT = 0.8
#: Confidences and their logarithms are whole numbers of 1 / UNIT: sums do not depend on their order.
UNIT = 1 << 20
#: Up to so many patterns (some 100 bytes each) are sent to the tasks; beyond, they are joined by shuffle.
BROADCAST_PATTERNS = 100_000
#: Copies of each pattern in such a join, so that one which a third of all mentions share does not end in one task.
SALTS = 16
#: A word of more characters than this is no context of its own: all such are one and the same.
LONG_WORD = 40
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CHAIN = re.compile(r"(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
_IP_LIKE = re.compile(r"[0-9]++(?:\.[0-9]++){3,}")
_DIGIT = re.compile(r"[0-9]")
#: What an e-mail look-alike is made of on either side of its @.
_PIECE = re.compile(r"""[^\s@,;:<>()\[\]{}"'|]+""")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time.

    Found from each @: the local part is the run before it, as far as the match before allows.
    """
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], bool]:
    """([(kind number, start, end)], whether there is anything to look at twice). Sorted by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    digits = _DIGIT.search(text)
    if digits is None:
        return out, "@" in text
    at = max(0, digits.start() - 1)
    for m in _IP.finditer(text, at):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text, at):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text, at):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append((3, *m.span()))
    return out, True


def look_alikes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, kinds it may be) of identifier-like runs outside the base spans, whole however long they are."""
    first, last = [], []  # the base spans' union
    for s, e in sorted((s, e) for _, s, e in base):
        if last and s <= last[-1]:
            last[-1] = max(last[-1], e)
        else:
            first.append(s)
            last.append(e)
    out = []

    def free(s: int, e: int) -> bool:
        at = bisect_right(last, s)
        return at == len(first) or e <= first[at]

    at, before = text.find("@"), None
    if at >= 0:
        for m in _PIECE.finditer(text):
            if before is not None and text[m.start() - 1] == "@" and before.end() == m.start() - 1 and free(before.start(), m.end()):
                out.append((before.start(), m.end(), (0,)))
                before = None
            else:
                before = m
    for m in _CHAIN.finditer(text):
        s, e = m.span()
        n = len(_DIGIT.findall(m.group()))
        kinds = ((1,) if _IP_LIKE.fullmatch(m.group()) else ()) + ((2,) if 13 <= n <= 19 else ()) + ((3,) if 9 <= n <= 15 else ())
        if kinds and free(s, e):
            out.append((s, e, kinds))
    return out


def _shape(text: str, s: int, e: int) -> str:
    return "..." if e - s > LONG_WORD else _DIGIT.sub("0", text[s:e].lower())


def context(text: str, s: int, e: int) -> list[str]:
    """The lexical patterns of a mention: two words before it, one on either side, one before it.

    Words are whole, in lower case, digits as 0; what is glued to the mention counts as a word. All words of more than
    LONG_WORD characters are one, and nothing is looked for beyond such a word, so a mention costs bounded time.
    """
    left: list[str] = []
    at = s
    while len(left) < 2:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        b = at
        while b > 0 and at - b <= LONG_WORD and not text[b - 1].isspace():
            b -= 1
        if b == at:
            break
        left.append(_shape(text, b, at))
        if at - b > LONG_WORD:
            break
        at = b
    at = e
    while at < len(text) and text[at].isspace():
        at += 1
    b = at
    while b < len(text) and b - at <= LONG_WORD and not text[b].isspace():
        b += 1
    out = []
    if len(left) == 2:
        out.append(f"l2 {left[1]} {left[0]}")
    if left and b > at:
        out.append(f"lr {left[0]} {_shape(text, at, b)}")
    if left:
        out.append("l1 " + left[0])
    return out


def instance(text: str, s: int, e: int) -> str:
    """What a mention is known by: its letters and digits."""
    return "".join(c for c in text[s:e].lower() if c.isalnum() or c == "@")


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, seed kind or -1, kinds, instance, patterns) of base spans and look-alikes."""
    seeds = [(s, e, k, [k], instance(text, s, e), context(text, s, e)) for k, s, e in base]
    return seeds + [(s, e, -1, list(ks), instance(text, s, e), context(text, s, e)) for s, e, ks in look_alikes(text, base)]


_MENTION = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("inst", pa.string()), ("pats", pa.list_(pa.string()))])
_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base, mentions) for every document: one pass over the texts, written by the caller.

    ``row`` numbers the rows, so that equal or null ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            base, mentions = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found, more = base_spans(text)
                base.append([{"k": k, "s": s, "e": e} for k, s, e in found])
                mentions.append([dict(zip(("s", "e", "seed", "kinds", "inst", "pats"), m, strict=True)) for m in _mentions(text, found)] if more else [])
            rows = pa.array(range(row, row + len(base)), pa.int64())
            row += len(base)
            yield pa.RecordBatch.from_arrays([rows, b.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))], names=["row", "id", "base", "mentions"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"row long, id {kind}, base array<struct<k:int,s:long,e:long>>, mentions array<struct<s:long,e:long,seed:int,kinds:array<int>,inst:string,pats:array<string>>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def _enough(accept: float) -> int:
    """The doubt, in units of its logarithm, that makes a confidence of ``accept``."""
    return round(-math.log(1 - accept) * UNIT)


def pattern_scores(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pat, k, score, doubt) of the patterns that reach PATTERN_SCORE after some rounds over the pattern-instance graph.

    The graph has one edge for each distinct pattern, instance and kind, however often they meet; scores are sums
    with partial aggregation on either side. Seeds stay at 1; an instance that no rule finds has the confidence
    1 - product of (1 - score) over the accepted patterns that hold it, and counts with that towards other patterns in
    the next round. So trust spreads from pattern to pattern, until a round changes nothing or ``rounds`` are done.
    ``doubt`` is -ln(1 - score) in units of 1 / UNIT; such numbers add up exactly.
    """
    m = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    edges = m.select(F.explode("kinds").alias("k"), "inst", "seed", "pats").select("k", "inst", "seed", F.explode("pats").alias("pat"))
    edges = edges.groupBy("pat", "inst", "k").agg(F.max(F.col("seed") == F.col("k")).alias("seed"))
    edges = materialise(edges, "pii-edges")
    trusted, score, state = None, None, None
    whole = F.lit(UNIT).cast("long")
    for n in range(rounds):
        conf = F.when(F.col("seed"), whole).otherwise(F.lit(0).cast("long") if trusted is None else F.coalesce("conf", F.lit(0).cast("long")))
        held = edges if trusted is None else edges.join(trusted, ["inst", "k"], "left")
        rate = held.groupBy("pat", "k").agg(F.sum(conf).alias("good"), F.count(F.lit(1)).alias("all")).where(F.col("good") >= LEAST_TRUST * UNIT)
        rate = rate.select("pat", "k", (F.col("good") / ((F.col("all") + 1) * UNIT)).alias("score")).where(F.col("score") >= PATTERN_SCORE)
        older = score
        score = materialise(rate.withColumn("doubt", F.round(-F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))) * UNIT).cast("long")), f"pii-patterns-{n}")
        if older is not None:
            discard(older)
        was, state = state, score.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pat", "k", "doubt").cast("decimal(20,0)"))).first()
        if state == was or not state[0]:
            break
        if n + 1 < rounds:
            doubt = _with_patterns(edges.where("not seed"), score, "inst").groupBy("inst", "k").agg(F.sum("doubt").alias("doubt"))
            trusted = doubt.select("inst", "k", F.floor((1 - F.exp(-F.col("doubt") / UNIT)) * UNIT).cast("long").alias("conf"))
    discard(edges)
    return score


def _with_patterns(rows: DataFrame, patterns: DataFrame, by: str) -> DataFrame:
    """rows (pat, k) joined with the patterns: sent to the tasks if their number allows, else salted by ``by``."""
    if patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(patterns), ["pat", "k"])
    salted = patterns.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["pat", "k", "__salt"]).drop("__salt")


def discovered(scanned: DataFrame, patterns: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(row, found: spans) of the look-alikes that the patterns take in; of several kinds the most trusted, then the first."""
    m = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*").where("seed < 0")
    m = m.select("row", "s", "e", "pats", F.explode("kinds").alias("k")).select("row", "s", "e", "k", F.explode("pats").alias("pat"))
    conf = _with_patterns(m, patterns, "row").groupBy("row", "s", "e", "k").agg(F.sum("doubt").alias("doubt")).where(F.col("doubt") >= _enough(accept))
    best = conf.groupBy("row", "s", "e").agg(F.max(F.struct("doubt", -F.col("k"))).alias("b")).select("row", (-F.col("b")["col2"]).cast("int").alias("k"), "s", "e")
    return best.groupBy("row").agg(F.collect_list(F.struct("k", "s", "e")).alias("found"))


def _own_patterns(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, __pats): the patterns that the look-alikes of each scanned row stand in."""
    m = scanned.select("id", F.explode("mentions").alias("m")).select("id", "m.*").where("seed < 0")
    m = m.select("id", "pats", F.explode("kinds").alias("k")).select("id", "k", F.explode("pats").alias("pat")).distinct()
    return _with_patterns(m, patterns, "id").groupBy("id").agg(F.collect_list(F.struct("pat", "k", "doubt")).alias("__pats"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans) for every row of docs.

    Counts and digest are of the base spans; ``spans`` has all, by kind and start; n_found counts what the method
    added, n_spans all. Offsets are code points, ends exclusive. Null texts are empty, and have no spans, as have empty
    ones. Rows are told apart by their place: null and repeated ids each get their row. Texts are searched whole, in
    time proportional to their length. Other columns are left out; an empty table gives an empty result.
    """
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    found = discovered(scanned, pattern_scores(scanned))
    rows = scanned.select("row", "id", "base").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: x == k), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(
        F.col("id").alias(id_col),
        *counts,
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
    )


def cover(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; where spans overlap, the one that starts first, then the longest, names the run."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs, same columns, with every base span and every discovered span replaced by its kind. Null texts stay null.

    The patterns go to the tasks after their number is checked, so texts do not move. Past BROADCAST_PATTERNS the
    rows are written with a number, and each gets the patterns it needs by that; ids play no part, and the result is the
    same. Empty texts stay empty, equal rows are redacted alike, other columns pass through whatever their names.
    """
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    patterns = pattern_scores(scanned)
    columns = docs.columns
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    if few:
        scores = {(r["pat"], r["k"]): r["doubt"] for r in patterns.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(scores)
        rows = docs
    else:
        shared = None
        numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
        known = _own_patterns(materialise(scan(numbered, "__row", text_col), "pii-scan"), patterns)
        rows = numbered.join(known.withColumnRenamed("id", "__row"), "__row", "left").select(*columns, "__pats")
    names, schema = list(columns), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            joined = b.column(len(names)).to_pylist() if shared is None else None
            for i, t in enumerate(b.column(names.index(text_col))):
                text = t.as_py()
                if text:
                    spans, more = base_spans(text)
                    if more:
                        scores = shared.value if joined is None else {(x["pat"], x["k"]): x["doubt"] for x in joined[i] or ()}
                        spans = spans + list(_accepted(text, spans, scores))
                    text = cover(text, spans) if spans else text
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if n == text_col else pa.array([None if t is None else len(t) for t in texts], b.schema.field(i).type) if n == chars_col else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(tidy(run), schema)


def _accepted(text: str, base: list[tuple[int, int, int]], scores: dict) -> Iterator[tuple[int, int, int]]:
    least = _enough(ACCEPT)
    for s, e, kinds in look_alikes(text, base):
        around = context(text, s, e)
        best = max((sum(scores.get((p, k), 0) for p in around), -k) for k in kinds)
        if best[0] >= least:
            yield -best[1], s, e
