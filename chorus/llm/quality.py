"""Operator 3: quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters (case kept, white space runs as one blank), of order three, trained on
all trusted text. A trigram is one long: three code points of 21 bits, so contexts and suffixes are
bit operations and every count table is a plain Spark table keyed by such longs.

1. Counts: tasks count the trigrams of their trusted texts, Spark adds the counts up. Continuation
   counts and the contexts' discount counts are grouped from that table.
2. Documents become chunks: for every trigram of a chunk the documents that hold it and how often,
   written once. Text is read once for this and is never shuffled.
3. Sharded count joins: the distinct trigrams are joined with the count tables, which Spark deals
   out by key, to get their log probability; that is joined back to the chunks that hold them.
4. Each chunk adds up its documents' log probabilities: perplexity is exp(-mean).
5. Limits are learned from documents labelled good, each scored by a model that has not seen its text:
   trusted texts are dealt into folds, and a fold's texts are scored by the counts of the others. The
   excess over the language's median, divided by how much chance spreads texts of that length, has one
   quantile ``keep`` a language; a document is kept while its own excess is at most that. Languages with
   fewer than ``enough`` documents labelled good take the wider of their own and the spread of all, around
   the higher of their own and the median of all; languages without any use the limit of all.

What is gathered grows with the corpus: no table is cut, pruned or hashed down.

Defined results: null, empty or white text has no perplexity and is not kept; without any trusted
text, or with fewer than ``FEWEST`` documents to learn limits from, nothing can be judged and every document with text is kept; a null language is a
language of its own; repeated rows get equal results and rows that share an id are judged together;
a null id is not kept; other columns are not read, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import give_back, map_arrow, small_or_plain, written
from chorus.llm.wordsplit import slices

BITS, MASK = 21, (1 << 21) - 1
BEGIN, END = MASK - 1, MASK
#: Bytes of text in one chunk (one document at least), the most documents, and bytes cut at a time.
CHUNK, CHUNK_DOCS, PIECE = 8_000_000, 60_000, 400_000
#: Parts the trusted texts are dealt into, equal texts to one, to score each by a model of the others.
FOLDS, FEW = 4, 64
#: Documents that limits can be learned from, at least; with fewer there are none.
FEWEST = 10


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols, owner of each): two begin marks, the text, an end mark; nothing for no text."""
    parts, size = [], []
    for t in texts:
        t = " ".join((t or "").split())
        parts.append(t)
        size.append(len(t) + 3 if t else 0)
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array(size, np.int64)
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    there = size > 0
    first, last = (ends - size)[there], ends[there] - 1
    out[first] = out[first + 1] = BEGIN
    out[last] = END
    out[out < 0] = flat
    return out, np.repeat(np.arange(len(texts)), size)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, document number, how often), sorted by trigram, then document."""
    sym, owner = symbols(texts)
    if len(sym) < 3:
        none = np.empty(0, np.int64)
        return none, none, none
    seen = np.zeros(MASK + 1, bool)
    seen[sym] = True
    letters = np.flatnonzero(seen)
    rank = (np.cumsum(seen) - 1)[sym]
    a, d = len(letters), len(texts)
    inside = owner[2:] == owner[:-2]
    if a ** 3 * d < 1 << 62:
        grams = ((rank[:-2] * a + rank[1:-1]) * a + rank[2:])[inside]
        joint = np.sort(grams * d + owner[2:][inside])
        cut = np.flatnonzero(np.diff(joint, prepend=-1))
        local, doc = np.divmod(joint[cut], d)
        x, y, z = letters[local // (a * a)], letters[local // a % a], letters[local % a]
        key = (x << 2 * BITS) | (y << BITS) | z
        total = len(joint)
    else:  # more different characters than fit: sort by two columns
        key, doc = ((sym[:-2] << 2 * BITS) | (sym[1:-1] << BITS) | sym[2:])[inside], owner[2:][inside]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        cut = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        total, key, doc = len(key), key[cut], doc[cut]
    return key, doc, np.diff(cut, append=total)


def chunk_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``trigrams`` of a chunk, cut piece by piece to bound memory."""
    parts = []
    for lo, hi in slices(texts, PIECE):
        key, doc, n = trigrams(texts.slice(lo, hi - lo).to_pylist())
        parts.append((key, (doc + lo).astype(np.uint16), n.astype(np.uint32)))
    if len(parts) == 1:
        return parts[0]
    key, doc, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")  # pieces follow each other, so documents stay in order
    return key[order], doc[order], n[order]


def dealt(trusted: DataFrame) -> Column:
    """The fold of a text: by its hash, or, where there are ``FEW`` different texts or less, by their hashes' ranks,
    so that two texts never share all that is trusted in one fold."""
    h = F.xxhash64("text")
    some = trusted.filter("text is not null").select(h.alias("h")).distinct().limit(FEW + 1).collect()
    by_hash = F.pmod(h, F.lit(FOLDS)).cast("int")
    if not some or len(some) > FEW:
        return by_hash
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(sorted(some)) for x in (r[0], i % FOLDS)])
    return F.coalesce(F.element_at(ranks, h), by_hash)


def trigram_counts(docs: DataFrame, fold: Column) -> DataFrame:
    """(fold, key, n) over all rows (text)."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), CHUNK):
                part = batch.slice(lo, hi - lo)
                fold = part.column(1).to_numpy()
                for f in np.unique(fold):
                    key, _, n = chunk_trigrams(part.column(0).filter(pa.array(fold == f)))
                    n = n.astype(np.int64)
                    cut = np.flatnonzero(np.diff(key, prepend=-1))
                    yield pa.record_batch([pa.array(np.full(len(cut), f, np.int32)), pa.array(key[cut]),
                                           pa.array(np.add.reduceat(n, cut) if len(cut) else n)], names=["fold", "key", "n"])

    return map_arrow(docs.select("text", fold.alias("fold")), run, "fold int, key long, n long", give_back).groupBy("fold", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from counts of counts."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


class KneserNey:
    """The count tables of the models of ``trigram_counts``, written below the shared folder.

    The model ``ALL`` has all rows; with ``folds`` there is one more for each fold, of all others, for the texts
    of that fold. All are rows of the same tables, so that more models take no more jobs and joins.
    """

    ALL = -1

    def __init__(self, counts: DataFrame, folds: bool = False):
        self.models = [self.ALL, *range(FOLDS if folds else 0)]
        every = counts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("fold") == f, F.col("n"))).alias(f"n{f}") for f in self.models[1:]])
        rest = [F.struct(F.lit(f).alias("m"), (F.col("n") - F.coalesce(F.col(f"n{f}"), F.lit(0))).alias("n")) for f in self.models[1:]]
        every = every.select("key", F.inline(F.array(F.struct(F.lit(self.ALL).alias("m"), "n"), *rest))).filter("n > 0")
        self.c3 = written(every.select("m", "key", "n"), "kn-c3")
        self.c2 = written(self.c3.groupBy("m", (F.col("key").bitwiseAND((1 << 2 * BITS) - 1)).alias("key"))
                          .agg(F.count(F.lit(1)).alias("n")), "kn-c2")
        self.c1 = written(self.c2.groupBy("m", (F.col("key").bitwiseAND(MASK)).alias("key")).agg(F.count(F.lit(1)).alias("n")), "kn-c1")
        self.d3, self.d2, self.d1 = (self._learned(t) for t in (self.c3, self.c2, self.c1))
        self.ctx3 = written(self._contexts(self.c3, F.shiftright("key", BITS), self.d3), "kn-ctx3")
        self.ctx2 = written(self._contexts(self.c2, F.shiftright("key", BITS), self.d2), "kn-ctx2")
        whole = {r["m"]: r for r in self._contexts(self.c1, F.lit(0), self.d1).collect()}
        self.kinds = {m: whole[m]["kinds"] if m in whole else 0 for m in self.models}
        self.total1 = {m: float(whole[m]["total"]) if m in whole else 1.0 for m in self.models}
        # one more kind for a character never seen
        self.floor = {m: (whole[m]["gamma"] if m in whole else 1.0) * (1.0 / (self.kinds[m] + 1)) for m in self.models}

    def empty(self, m: int) -> bool:
        return self.kinds[m] == 0

    def _learned(self, table: DataFrame) -> dict[int, list[float]]:
        """The discounts of every model."""
        found = {r[0]: r[1:] for r in table.groupBy("m").agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).collect()}
        return {m: _discounts(found.get(m, (0, 0, 0, 0))) for m in self.models}

    def _of(self, values: dict[int, float], models: list[int]) -> Column:
        """The value of the row's model, of these ``models``."""
        out = F.lit(values[models[-1]])
        for m in models[:-1]:
            out = F.when(F.col("m") == m, values[m]).otherwise(out)
        return out

    def _discount(self, n: Column, d: dict[int, list[float]], models: list[int]) -> Column:
        one, two, more = (self._of({m: d[m][i] for m in models}, models) for i in range(3))
        return F.when(n == 1, one).when(n == 2, two).otherwise(more)

    def _contexts(self, table: DataFrame, context: Column, d: dict[int, list[float]]) -> DataFrame:
        """(m, ctx, total, gamma, kinds): how often a context occurs, the mass its discounts set free, what follows it."""
        found = table.groupBy("m", context.alias("ctx")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
            *[F.count(F.when(F.col("n") == i + 1, 1) if i < 2 else F.when(F.col("n") > 2, 1)).alias(f"f{i}") for i in range(3)])
        freed = sum(self._of({m: d[m][i] for m in self.models}, self.models) * F.col(f"f{i}") for i in range(3))
        return found.select("m", "ctx", "total", (freed / F.col("total")).alias("gamma"), "kinds")

    def log_probability(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of distinct trigrams (key): joins with every order's counts and contexts.

        Of distinct (fold, key) it is (fold, key, logp), by the model for the texts of that fold.
        """
        low2, low1 = (1 << 2 * BITS) - 1, MASK
        folds = "fold" in keys.columns
        models = self.models[1:] if folds else [self.ALL]
        k = keys.select(F.col("fold").alias("m") if folds else F.lit(self.ALL).alias("m"), "key", F.col("key").bitwiseAND(low2).alias("k2"),
                        F.col("key").bitwiseAND(low1).alias("k1"), F.shiftright("key", BITS).alias("x3"),
                        F.shiftright(F.col("key").bitwiseAND(low2), BITS).alias("x2"))
        on = ["m"] if folds else []  # one model needs no column of its own

        def named(t: DataFrame, key: str, order: str, *values: str) -> DataFrame:
            t = t if folds else t.filter(F.col("m") == self.ALL)
            return t.select(*on, F.col("ctx" if "ctx" in t.columns else "key").alias(key), *[F.col(v).alias(v + order) for v in values])

        k = k.join(named(self.c1, "k1", "1", "n"), [*on, "k1"], "left").join(named(self.c2, "k2", "2", "n"), [*on, "k2"], "left") \
            .join(named(self.ctx2, "x2", "2", "total", "gamma"), [*on, "x2"], "left") \
            .join(named(self.c3, "key", "3", "n"), [*on, "key"], "left") \
            .join(named(self.ctx3, "x3", "3", "total", "gamma"), [*on, "x3"], "left")
        one = lambda n, d, total: F.coalesce((n - self._discount(n, d, models)) / total, F.lit(0.0))
        p1 = one(F.col("n1"), self.d1, self._of(self.total1, models)) + self._of(self.floor, models)
        p2 = one(F.col("n2"), self.d2, F.col("total2")) + F.coalesce("gamma2", F.lit(1.0)) * p1
        p3 = one(F.col("n3"), self.d3, F.col("total3")) + F.coalesce("gamma3", F.lit(1.0)) * p2
        return k.select(*[F.col("m").alias("fold")][:folds], "key", F.log(p3).alias("logp"))


def chunks(docs: DataFrame, fold: Column) -> DataFrame:
    """(chunk, fold, ids, keys, docs_per_key, doc, n): packed postings of consecutive rows (doc_id, text) of one fold."""

    def run(batches):
        made = 0
        for batch in batches:
            folds = batch.column(2).to_numpy()
            for f in np.unique(folds):
                rows = batch if (folds == f).all() else batch.filter(pa.array(folds == f))
                for lo, hi in slices(rows.column(1), CHUNK):
                    for at in range(lo, hi, CHUNK_DOCS):
                        part = rows.slice(at, min(CHUNK_DOCS, hi - at))
                        key, doc, n = chunk_trigrams(part.column(1))
                        cut = np.flatnonzero(np.diff(key, prepend=-1))
                        pack = lambda a, t: pa.compress(a.astype(t).tobytes(), "zstd", asbytes=True)
                        number = TaskContext.get().partitionId() * (1 << 32) + made
                        made += 1
                        yield pa.record_batch([
                            pa.array([number]), pa.array([f], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                            pa.array([key[cut].tolist()], pa.list_(pa.int64())),
                            pa.array([pack(np.diff(cut, append=len(key)), "<u4")]), pa.array([pack(doc, "<u2")]), pa.array([pack(n, "<u4")]),
                            pa.array([len(key)])], names=["chunk", "fold", "ids", "keys", "docs_per_key", "doc", "n", "postings"])

    return map_arrow(docs.select("doc_id", "text", fold.alias("fold")), run, "chunk long, fold int, ids array<long>, keys array<long>, "
                     "docs_per_key binary, doc binary, n binary, postings long", give_back)


def scored(docs: DataFrame, model: KneserNey, fold: Column | None = None) -> DataFrame:
    """(doc_id, n_symbols, logp) of every row (doc_id, text); n_symbols 0 and logp 0 without text.

    Each text is scored by the model for its ``fold``, without by that of all.
    """
    packed = written(chunks(docs, F.lit(0) if fold is None else fold), "kn-chunks")
    on = ["key"] if fold is None else ["fold", "key"]
    asked = written(packed.select("chunk", "fold", F.explode("keys").alias("key")), "kn-asked").select("chunk", *on)
    answers = written(model.log_probability(asked.select(*on).distinct()), "kn-answers")
    told = asked.join(answers, on).groupBy("chunk").agg(F.collect_list(F.struct("key", "logp")).alias("told"))
    rows = packed.drop("keys", "fold").join(told, "chunk", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("ids", "docs_per_key", "doc", "n", "postings", "told")}
                ids, p = row["ids"].as_py(), row["postings"].as_py()
                get = lambda c, t, size: np.frombuffer(pa.decompress(row[c].as_py(), size * np.dtype(t).itemsize, "zstd", asbytes=True), t)
                total, size = np.zeros(len(ids)), np.zeros(len(ids))
                if p:
                    told = row["told"].values
                    key = told.field("key").to_numpy()
                    logp = told.field("logp").to_numpy()[np.argsort(key)]  # the chunk lists its trigrams in ascending order
                    doc, n = get("doc", "<u2", p), get("n", "<u4", p).astype(np.float64)
                    total = np.bincount(doc, np.repeat(logp, get("docs_per_key", "<u4", len(key))) * n, len(ids))
                    size = np.bincount(doc, n, len(ids))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(size.astype(np.int64)), pa.array(total)],
                                      names=["doc_id", "n_symbols", "logp"])

    return map_arrow(rows, run, "doc_id long, n_symbols long, logp double", give_back)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return written(labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct(), "trusted")


def judge(docs: DataFrame, labels: DataFrame, keep: float = 0.99, enough: int = 200, short: float = 1000.0,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, limit, kept), one row per input row.

    ``keep``: the quantile; ``enough``: trusted documents a language needs for one of its own;
    ``short``: symbols of a text whose loss spreads by chance as much as long texts' losses differ.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang"))
    trusted = src.join(small_or_plain(trusted_ids(labels)), "doc_id", "left_semi")
    fold = dealt(trusted)
    model = KneserNey(written(trigram_counts(trusted, fold), "kn-folds"), folds=True)
    # rows that share an id are judged together; only documents labelled good need a score by a model that has not seen them
    one_each = lambda rows, loss: rows.filter("doc_id is not null").distinct().groupBy("doc_id").agg(
        F.sum("n_symbols").alias("n_symbols"), F.sum("logp").alias("logp")).select(
            "doc_id", "n_symbols", F.when(F.col("n_symbols") > 0, -F.col("logp") / F.col("n_symbols")).alias(loss))
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = written(src.select("doc_id", "lang").join(one_each(scored(src, model), "loss"), "doc_id", "left").withColumn("key", key), "kn-scores")
    fine = written(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "kn-fine")
    seen = [f for f in range(FOLDS) if not model.empty(f)]  # an empty model says nothing
    judged = src.join(small_or_plain(fine), "doc_id", "left_semi").withColumn("fold", fold).filter(F.col("fold").isin(seen) if seen else F.lit(False))
    unseen = one_each(scored(judged, model, F.col("fold")), "unseen").drop("n_symbols")
    basis = written(rows.join(unseen, "doc_id").filter("unseen is not null"), "kn-basis")
    middle = lambda c: F.percentile_approx(c, 0.5, 10000)
    upper = lambda c: F.percentile_approx(c, keep, 10000)
    wide = F.sqrt(1 + short / F.col("n_symbols"))
    mids = written(basis.groupBy("key").agg(middle("unseen").alias("mid"), F.count(F.lit(1)).alias("n")), "kn-middles")
    every, n = basis.agg(middle("unseen"), F.count(F.lit(1))).first()
    if n < FEWEST:
        basis, every = basis.filter(F.lit(False)), None
    over = basis.join(small_or_plain(mids), "key").select("key", "mid", "n", ((F.col("unseen") - F.col("mid")) / wide).alias("own"),
                                                          ((F.col("unseen") - F.lit(every).cast("double")) / wide).alias("all"))
    spread, reach = over.agg(upper("own"), upper("all")).first()
    few = F.col("n") < enough
    by_lang = over.groupBy("key", "mid", "n").agg(upper("own").alias("q")).select(
        "key", F.when(few, F.greatest("mid", F.lit(every))).otherwise(F.col("mid")).alias("mid"),
        F.when(few, F.greatest("q", F.lit(spread))).otherwise(F.col("q")).alias("q"))
    out = rows.join(small_or_plain(written(by_lang, "kn-limits")), "key", "left")
    out = out.withColumns({"mid": F.coalesce("mid", F.lit(every).cast("double")), "q": F.coalesce("q", F.lit(reach).cast("double"))})
    allowed = F.col("mid") + F.col("q") * wide
    return out.select("doc_id", "lang", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.exp("loss").alias("perplexity"),
                      F.exp(F.col("mid") + F.col("q")).alias("limit"),
                      F.coalesce((F.col("loss") <= allowed) | (F.col("loss").isNotNull() & F.col("mid").isNull()), F.lit(False)).alias("kept"))
