"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes long, with counts from a bounded training
sample and escape probabilities (a context seen n times with d different successors escapes with
d / (n + d)). Counts are frozen after training, so the cost of a byte depends on the ORDER bytes before it
alone: the trees are flattened into hash tables from byte strings to costs in bits, for TOGETHER languages
at once, and scoring is a handful of array lookups a byte. The predicted language is the one whose model
gives the shortest code for the whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bytesops import utf8_rows
from .common import materialise, tidy

#: Longest context in bytes.
ORDER = 4
#: The training sample: at most so many documents a language, in the order of a hash of the id, of each its first so many bytes.
TRAIN_DOCS, TRAIN_DOC_BYTES = 400, 1 << 16
#: Bytes of all languages' samples together; each language has an equal part of it at most. It bounds what the driver trains
#: on, and the models, whose tables hold some 30 bytes for each different byte string of up to ORDER + 1 bytes.
TRAIN_BYTES = 64 << 20
#: More languages than this are an error: the column then holds something else.
MOST_LANGS = 1_000
#: Languages whose costs share tables. Tables have a column a language, so that size does not grow with the square of their number.
TOGETHER = 8
UNDETERMINED = "und"
CHUNK = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Table:
    """Open-addressing hash table from byte strings (as integers) to row numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]] = keys[left[take]]
            self.rows[slot[take]] = left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MUL) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that are not in the table."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(open_):
            s = (slot[open_] + 1) & self.mask
            slot[open_] = s
            there = self.keys[s]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[s[hit]]
            open_ = open_[~hit & (there != _EMPTY)]
        return out


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Integers of the ``length`` bytes that end at each position from ORDER on."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(length):
        out = (out << np.uint64(8)) | data[ORDER - length + 1 + i : len(data) - length + 1 + i]
    return out


class Model:
    """Costs in bits under each language, in blocks of TOGETHER languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        self.blocks = [_Block({x: samples[x] for x in self.langs[i : i + TOGETHER]}) for i in range(0, len(self.langs), TOGETHER)]

    def code_lengths(self, texts: list[memoryview]) -> np.ndarray:
        """Bits (texts, languages) of whole texts."""
        return np.concatenate([b.code_lengths(texts) for b in self.blocks], axis=1) if self.blocks else np.zeros((len(texts), 0))


class _Block:
    """Costs in bits under each of some languages; see the module's text."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            data = [np.frombuffer(bytes(ORDER) + t, np.uint8).astype(np.uint64) for t in samples[lang] if t]
            per = []
            for k in range(ORDER + 1):
                grams = np.concatenate([_grams(d, k + 1) for d in data]) if data else np.zeros(0, np.uint64)
                per.append(np.unique(grams, return_counts=True))
            counts.append(per)
        n = len(self.langs)
        self.tables: list[_Table] = []
        self.costs: list[np.ndarray] = []
        #: escapes[k]: bits to leave a context of k bytes, by the row of that context among ``contexts[k]``.
        self.contexts: list[_Table] = []
        self.escapes: list[np.ndarray] = []
        lower = None
        for k in range(ORDER + 1):
            union = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.zeros(0, np.uint64)
            ctx = np.unique(union >> np.uint64(8))
            cost = np.empty((len(union), n), np.float32)
            esc = np.zeros((len(ctx), n), np.float32)
            suffix = union & np.uint64((1 << (8 * k)) - 1)
            for j, c in enumerate(counts):
                grams, number = c[k]
                own = np.searchsorted(ctx, grams >> np.uint64(8))
                total, kinds = np.bincount(own, number, len(ctx)), np.bincount(own, minlength=len(ctx))
                seen = kinds > 0
                esc[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                base = np.full(len(union), 8.0) if lower is None else lower[0][np.searchsorted(lower[1], suffix), j]
                cost[:, j] = base + esc[np.searchsorted(ctx, union >> np.uint64(8)), j]
                cost[np.searchsorted(union, grams), j] = -np.log2(number / (total[own] + kinds[own]))
            self.tables.append(_Table(union))
            self.costs.append(cost)
            self.contexts.append(_Table(ctx))
            self.escapes.append(esc)
            lower = (cost, union)

    def byte_costs(self, data: np.ndarray) -> np.ndarray:
        """Costs (bytes, languages) of data[ORDER:], each byte after the ORDER before it."""
        n = len(self.langs)
        out = np.zeros((len(data) - ORDER, n), np.float32)
        wide = data.astype(np.uint64)
        full = _grams(wide, ORDER + 1)
        open_ = None
        for k in range(ORDER, -1, -1):
            grams = (full if open_ is None else full[open_]) & np.uint64((1 << (8 * (k + 1))) - 1)
            row = self.tables[k].find(grams)
            hit = row >= 0
            if open_ is None:
                np.take(self.costs[k], np.maximum(row, 0), axis=0, out=out)
                open_ = np.flatnonzero(~hit)
                out[open_] = 0
                grams = grams[open_]
            else:
                out[open_[hit]] += self.costs[k][row[hit]]
                open_, grams = open_[~hit], grams[~hit]
            if not len(open_):
                return out
            row = self.contexts[k].find(grams >> np.uint64(8))
            met = row >= 0
            out[open_[met]] += self.escapes[k][row[met]]
        out[open_] += 8.0
        return out

    def code_lengths(self, texts: list[memoryview]) -> np.ndarray:
        """Bits (texts, languages) of whole texts. Long ones are scored in runs that overlap by their context."""
        total = np.zeros((len(texts), len(self.langs)))
        buf: list[np.ndarray] = []
        spans: list[tuple[int, int, int]] = []
        size = 0
        zero = np.zeros(ORDER, np.uint8)

        def score() -> None:
            nonlocal buf, spans, size
            if spans:
                cost = self.byte_costs(np.concatenate(buf))
                edges = np.array([(a - ORDER, b - ORDER) for _, a, b in spans]).ravel()
                sums = np.add.reduceat(np.concatenate((cost, np.zeros((1, cost.shape[1]), np.float32))), edges, axis=0, dtype=np.float64)[::2]
                np.add.at(total, [i for i, _, _ in spans], sums)
            buf, spans, size = [], [], 0

        for i, view in enumerate(texts):
            data = np.frombuffer(view, np.uint8)
            for at in range(0, len(data), CHUNK):
                run = data[at : at + CHUNK]
                before = zero if at == 0 else data[at - ORDER : at]
                buf += [before, run]
                spans.append((i, size + ORDER, size + ORDER + len(run)))
                size += ORDER + len(run)
                if size >= CHUNK:
                    score()
        score()
        return total


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS, doc_bytes: int = TRAIN_DOC_BYTES) -> DataFrame:
    """(lang, text): for each language the first docs_per_lang usable documents by a hash of the id, of long ones the first doc_bytes bytes.

    The ids of each language are counted first, and only those whose hash lies among the lowest, twice as many as
    are wanted, are ranked: a language's task sees about 2 * docs_per_lang ids, however large the input. The counts
    are broadcast: a row a language, of which there are MOST_LANGS at most (else it is an error). With many languages
    each has fewer documents or bytes, so that the sample keeps to TRAIN_BYTES. Rows that repeat an id and a language count
    as one, the first text in order. Rows without id, language or text are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & (F.octet_length("text") > 0))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 52).cast("long")) / F.lit(float(1 << 52)))
    known = materialise(rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")), "langid-known")
    n_langs = known.limit(MOST_LANGS + 1).count()
    if n_langs > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values: is it the language?")
    each = TRAIN_BYTES // max(1, n_langs)
    doc_bytes = min(doc_bytes, max(1 << 12, each // docs_per_lang))
    docs_per_lang = max(1, min(docs_per_lang, each // doc_bytes))
    low = rows.select("lang", "id", "u").join(F.broadcast(known), "lang").where(F.col("u") * F.col("n") < 2 * docs_per_lang + 100).select("lang", "id", "u").distinct()
    picked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id"))).where(F.col("r") <= docs_per_lang).select("lang", "id")
    # A character that the cut runs through goes.
    start = F.rtrim(F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, doc_bytes).cast("string")), F.lit("\ufffd"))
    rows = rows.withColumn("text", F.when(F.octet_length("text") > doc_bytes, start).otherwise(F.col("text")))
    return rows.join(F.broadcast(picked), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case, the same for what is trained on and what is judged."""
    return pc.utf8_lower(texts)


def train(docs: DataFrame, **kw) -> Model:
    """A model from training_sample(docs), TRAIN_BYTES of which reach the driver at most. No usable row gives a model without languages."""
    samples: dict[str, list[bytes]] = {}
    for row in training_sample(docs, **kw).toLocalIterator():
        samples.setdefault(row["lang"], []).append(bytes(_lower(pa.array([row["text"]], pa.string()))[0].as_buffer()))
    return Model({k: sorted(v) for k, v in samples.items()})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score, the posterior of the language under equal priors.

    Null texts and texts without a letter are `und` with score 0, as is everything if the model has no language.
    Equal scores go to the first language in order. Other columns pass through; lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(shared.value)
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = [UNDETERMINED] * len(text), np.zeros(len(text))
            if m.langs:
                bits = m.code_lengths(list(utf8_rows(_lower(text))))
                best = bits.argmin(axis=1)
                gap = bits - bits[np.arange(len(bits)), best][:, None]
                scores = np.where(letters, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1), 0.0)
                langs = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; trained on the rows of docs that are not held out.

    Null texts and texts without a letter are `und` with score 0. A null id is not held out, yet never trained on. Rows
    that repeat an id each get their row; an empty table gives an empty result; other columns are left out.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = predict(rows, model, "id", "text")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
