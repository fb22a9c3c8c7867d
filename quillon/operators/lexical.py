"""The lexical lane: a stored inverted index of stemmed, folded words that follows its entries, and weighted BM25 over it.

An index is a folder of Parquet tables:

    postings     a row for a word, a corpus and a block of ids: the entries that have it, their weighted frequencies,
                 lengths and places; and the largest frequency and smallest length of the block. Folders by bucket (a hash
                 of the word), rows in order of the word, so that a search reads the row groups of its words.
    dictionary   a row for a word and a corpus: entries that have it, the largest frequency, the smallest length
    entries      a row for an entry: hash of its texts, length, its distinct words
    statistics   entries and words of each corpus
    removed      entries whose rows of earlier generations don't count any more

A generation is what one change of the source adds to each of them; counts of later generations are differences, so the
tables are added up where they are read. ``commits`` names the generations that are whole.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..config import EngineConfig
from ..functions.text import query_phrases, stemmed_tokens
from ..sources.followed import source_signature
from ..workspace import discard, new_folder, written

#: The indexed columns, in the order of their codes; a place is code << PLACE_BITS | number of the word in the column.
COLUMNS, PLACE_BITS = ("title", "summary", "content"), 28
#: Texts that are sent in one Arrow batch; ids of a block; folders of postings; words that are pushed to the scan.
CHUNK, SPAN, BUCKETS, PUSHED = 200, 4096, 32, 1000
#: Postings that a task puts together at once; rows of blocks in one Arrow batch; tasks that write a bucket.
GATHERED, SENT, SHARES = 1_000_000, 20_000, 4
#: Units of a score's part: parts are below 100, so thousands of them stay below 2**63.
FINE = 1 << 46
#: Queries that a block is scored for at once, about.
ASKING = 256
FORWARD = "corpus string, id long, hash long, dl int, words array<struct<term:string,f:double,places:array<int>>>"
POSTINGS = "term string, corpus string, block long, n int, max_f double, min_dl int, ids array<long>, fs array<double>, dls array<int>, places array<array<int>>, gen int, bucket int"
BLOCKS = "term string, corpus string, block long, n int, max_f double, min_dl int, ids array<long>, fs array<double>, dls array<int>, places array<array<int>>"
HITS = "phrase string, prefix boolean, corpus string, block long, n long, ids array<long>, fs array<double>, dls array<int>"
HITS_ARROW = pa.schema([
    ("phrase", pa.string()), ("prefix", pa.bool_()), ("corpus", pa.string()), ("block", pa.int64()), ("n", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("fs", pa.list_(pa.float64())), ("dls", pa.list_(pa.int32())),
])
TABLES = {
    "postings": POSTINGS,
    "dictionary": "term string, head string, corpus string, df long, max_f double, min_dl int, gen int",
    "entries": "corpus string, id long, hash long, dl int, terms array<string>, gen int",
    "statistics": "corpus string, n long, words long, gen int",
    "removed": "corpus string, id long, gen int",
}


@dataclass(frozen=True)
class Index:
    """The tables of an index, as they are read."""

    postings: DataFrame
    dictionary: DataFrame
    entries: DataFrame
    statistics: DataFrame
    removed: DataFrame
    changed: bool  # whether entries were removed since the first generation

    def of(self, corpora: list[str]) -> Index:
        """The index of some corpora."""
        some = F.col("corpus").isin(corpora)
        return Index(*(t.where(some) for t in (self.postings, self.dictionary, self.entries, self.statistics, self.removed)), self.changed)


# --- Making it ------------------------------------------------------------------------------------------------------


def content_hash() -> Column:
    return F.xxhash64(*(F.coalesce(c, F.lit("")) for c in COLUMNS))


def forward(entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """corpus, id, hash, dl (words in all indexed columns) and words: each distinct one with its occurrences, weighted by
    column, and places. An entry's words are counted where it is read: no exchange."""
    weights = [float(cfg.bm25[c]) for c in COLUMNS]
    worth = np.array(weights)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                corpus, number, hash_, *texts = batch.slice(at, CHUNK).columns
                terms, sizes, where, lengths = [], [], [], []  # of all words of the slice; words of each entry
                each = [0]
                for row in zip(*(t.to_pylist() for t in texts)):
                    places: dict[str, list[int]] = {}
                    n = 0
                    for code, text in enumerate(row):
                        words = stemmed_tokens(text or "")
                        n += len(words)
                        for k, term in enumerate(words, code << PLACE_BITS):
                            if term in places:
                                places[term].append(k)
                            else:
                                places[term] = [k]
                    terms.extend(places)
                    sizes.extend(map(len, places.values()))
                    where.extend(chain.from_iterable(places.values()))
                    lengths.append(n)
                    each.append(len(terms))
                ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                flat = np.array(where, np.int32)
                f = np.add.reduceat(worth[flat >> PLACE_BITS], ends[:-1]) if len(flat) else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                found = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(f), lists], names=["term", "f", "places"])
                words = pa.ListArray.from_arrays(pa.array(each, pa.int32()), found)
                yield pa.RecordBatch.from_arrays([corpus, number, hash_, pa.array(lengths, pa.int32()), words], names=["corpus", "id", "hash", "dl", "words"])

    return entries.select("corpus", "id", content_hash().alias("hash"), *COLUMNS).mapInArrow(run, FORWARD)


def blocks(made: DataFrame) -> DataFrame:
    """Postings of ``forward`` rows. A block is a run of SPAN ids, so its size is bounded however frequent its word is.

    They are put together where the entries are read, GATHERED postings at a time, and nothing is sent for it. A block
    whose entries are read in several goes has a row for each.
    """

    def posted(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        words = t["words"].combine_chunks() if t.num_rows else None
        if words is None or not len(words.values):
            return
        owner = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        e = words.flatten()
        term, f, places = e.field("term").dictionary_encode(), e.field("f").to_numpy(), e.field("places")
        corpus = t["corpus"].combine_chunks().dictionary_encode()
        ids, dl = t["id"].to_numpy()[owner], t["dl"].to_numpy()[owner]
        key = [term.indices.to_numpy(), corpus.indices.to_numpy()[owner], np.sign(ids) * (np.abs(ids) // SPAN)]
        order = np.lexsort((ids, key[2], key[1], key[0]))
        w, c, b = (k[order] for k in key)
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (b[1:] != b[:-1])])
        offsets = pa.array(np.r_[first, len(order)], pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        f, dl = f[order], dl[order]
        made = [
            term.dictionary.take(pa.array(w[first])), corpus.dictionary.take(pa.array(c[first])), pa.array(b[first]), pa.array(np.diff(np.r_[first, len(order)]), pa.int32()),
            pa.array(np.maximum.reduceat(f, first)), pa.array(np.minimum.reduceat(dl, first)), lists(pa.array(ids[order])), lists(pa.array(f)), lists(pa.array(dl)), lists(places.take(pa.array(order))),
        ]
        whole = pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in BLOCKS.split(", ")])
        for at in range(0, whole.num_rows, SENT):
            yield whole.slice(at, SENT)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column(3).values)
            if n >= GATHERED:
                yield from posted(held)
                held, n = [], 0
        if held:
            yield from posted(held)

    return made.select("corpus", "id", "dl", "words").mapInArrow(run, BLOCKS)


def bucket(term: Column | str) -> Column:
    return (F.crc32(F.col(term) if isinstance(term, str) else term) % BUCKETS).cast("int")


def _write(spark: SparkSession, path: str, gen: int, made: DataFrame, gone: DataFrame | None, first: bool) -> None:
    """A generation: ``made`` (``forward`` rows) is added; ``gone`` (corpus, id, dl, terms) is taken out."""
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/gen={gen}")
    made = written(made, "forward")
    posted = blocks(made).withColumn("bucket", bucket("term"))
    order = ["bucket", "term", "corpus", "block"]
    # dealt by bucket and a hash of the word: ranges would be sampled, which makes the postings twice
    posted.repartition("bucket", F.expr(f"pmod(xxhash64(term), {SHARES})")).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")
    posted = spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(f"{path}/postings/gen={gen}")
    words = posted.groupBy("term", "corpus").agg(F.sum("n").cast("long").alias("df"), F.max("max_f").alias("max_f"), F.min("min_dl").alias("min_dl"))
    counts = made.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("words"))
    if gone is not None:
        left = gone.select("corpus", F.explode("terms").alias("term")).groupBy("term", "corpus").agg((-F.count("*")).alias("df"))
        words = words.unionByName(left.withColumns({"max_f": F.lit(0.0), "min_dl": F.lit((1 << 31) - 1)}))
        words = words.groupBy("term", "corpus").agg(F.sum("df").alias("df"), F.max("max_f").alias("max_f"), F.min("min_dl").alias("min_dl"))
        counts = counts.unionByName(gone.groupBy("corpus").agg((-F.count("*")).alias("n"), (-F.sum("dl")).cast("long").alias("words"))).groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    dictionary = words.select("term", F.substring("term", 1, 2).alias("head"), "corpus", "df", "max_f", "min_dl")
    put(dictionary.repartitionByRange("term", "corpus").sortWithinPartitions("term"), "dictionary")
    put(made.select("corpus", "id", "hash", "dl", F.col("words.term").alias("terms")), "entries")
    put(counts, "statistics")
    put(gone.select("corpus", "id") if gone is not None else made.select("corpus", "id").limit(0), "removed")
    spark.range(1).select(F.lit(gen).alias("gen"), F.lit(first).alias("first")).write.mode("append").parquet(f"{path}/commits")
    discard(made)


def generations(spark: SparkSession, path: str) -> list[int]:
    """The whole generations of an index, from the last one that began it anew."""
    rows = sorted((r.gen, r.first) for r in spark.read.parquet(f"{path}/commits").collect())
    return [gen for gen, _ in rows[max(k for k, (_, first) in enumerate(rows) if first) :]]


def build(entries: DataFrame, cfg: EngineConfig, path: str) -> None:
    """A new index of all entries (corpus, id, title, summary, content), beside what ``path`` already has."""
    spark = entries.sparkSession
    try:
        last = generations(spark, path)[-1]
    except Exception:  # nothing is there yet
        last = -1
    _write(spark, path, last + 1, forward(entries, cfg), None, True)


def read(spark: SparkSession, path: str) -> Index:
    gens = generations(spark, path)
    of = lambda name: spark.read.schema(TABLES[name]).option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/gen={g}" for g in gens))
    return Index(*map(of, ("postings", "dictionary", "entries", "statistics", "removed")), len(gens) > 1)


def living(index: Index) -> DataFrame:
    """Entries of the index without what was removed after they came in."""
    if not index.changed:
        return index.entries
    return _alive(index.entries, index, "id")


def _alive(rows: DataFrame, index: Index, key: str) -> DataFrame:
    """Rows (corpus, ``key``, gen) whose entry wasn't removed in a later generation."""
    last = index.removed.groupBy("corpus", F.col("id").alias(key)).agg(F.max("gen").alias("_last"))
    return rows.join(last, ["corpus", key], "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col("gen"))).drop("_last")


def changes(entries: DataFrame, index: Index) -> DataFrame:
    """corpus, id, change (new, changed, gone) of entries against an index, by their texts' hashes."""
    now = entries.select("corpus", "id", content_hash().alias("_now"))
    both = now.join(living(index).select("corpus", "id", F.col("hash").alias("_then")), ["corpus", "id"], "full_outer")
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_then"), "changed")
    return both.select("corpus", "id", change.alias("change")).where("change is not null")


def refresh(entries: DataFrame, cfg: EngineConfig, path: str) -> dict[str, int]:
    """Bring an index up to its entries by a generation that has only what changed; the numbers of changes by kind.

    Only new and changed entries are tokenised, only their postings are written; the words of changed and gone ones come
    from the stored entries. Nothing is written if nothing changed.
    """
    spark, index = entries.sparkSession, read(entries.sparkSession, path)
    found = written(changes(entries, index), "changes")
    counts = {r.change: r["count"] for r in found.groupBy("change").count().collect()}
    if counts:
        fresh = entries.join(found.where("change <> 'gone'").select("corpus", "id"), ["corpus", "id"], "left_semi")
        gone = living(index).join(found.where("change <> 'new'").select("corpus", "id"), ["corpus", "id"], "left_semi")
        _write(spark, path, generations(spark, path)[-1] + 1, forward(fresh, cfg), gone.select("corpus", "id", "dl", "terms"), False)
    discard(found)
    return counts


def index_of(entries: DataFrame, cfg: EngineConfig, path: str | None = None) -> Index:
    """An index of entries, in a new folder unless one is given."""
    path = path or new_folder(entries.sparkSession, "lexical")
    build(entries, cfg, path)
    return read(entries.sparkSession, path)


def statistics(index: Index) -> DataFrame:
    """corpus, n (entries), avgdl (words of an entry in all indexed columns)."""
    sums = index.statistics.groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return sums.where("n > 0").select("corpus", "n", (F.col("words") / F.col("n")).alias("avgdl"))


def document_frequency(index: Index) -> DataFrame:
    """corpus, term, df: entries of the corpus that have the word."""
    return index.dictionary.groupBy("corpus", "term").agg(F.sum("df").alias("df")).where("df > 0")


# --- Searching it ---------------------------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("prefix", T.BooleanType())])))
def _phrases(text):
    return text.fillna("").map(lambda t: [{"tokens": tokens, "prefix": prefix} for tokens, prefix in query_phrases(t)])


def phrases(queries: DataFrame) -> DataFrame:
    """qid, phrase (its stemmed words, joined by spaces), prefix: what each query searches for; words with one stem count each."""
    found = queries.select("qid", F.explode(_phrases("text")).alias("p"))
    return found.select("qid", F.array_join("p.tokens", " ").alias("phrase"), "p.prefix", F.size("p.tokens").alias("words"))


def spelled(index: Index, wanted: DataFrame) -> DataFrame:
    """phrase, prefix, words, k, term, corpus, df, max_f, min_dl, bucket: the words of the index that the distinct phrases
    ``wanted`` (phrase, prefix, words) stand for; k: place in the phrase.

    Beginnings are looked up among words with the same two letters, so neither side is broadcast or spelled out.
    """
    d = index.dictionary.drop("gen")
    shape = ["phrase", "prefix", "words"]
    named = wanted.where("words > 1").select(*shape, F.posexplode(F.split("phrase", " ")).alias("k", "term"))
    named = named.union(wanted.where("words = 1 and not prefix").select(*shape, F.lit(0).alias("k"), F.col("phrase").alias("term")))
    begin = wanted.where("words = 1 and prefix").withColumn("k", F.lit(0))
    two = d.join(begin.where("length(phrase) > 1").withColumn("head", F.substring("phrase", 1, 2)), "head").where(F.startswith("term", F.col("phrase")))
    one = d.withColumn("_first", F.substring("head", 1, 1)).join(begin.where("length(phrase) = 1").withColumn("_first", F.col("phrase")), "_first")
    columns = [*shape, "k", "term", "corpus", "df", "max_f", "min_dl"]
    rows = reduce(DataFrame.union, (x.select(columns) for x in (d.join(named, "term"), two, one)))
    rows = rows.groupBy(*shape, "k", "term", "corpus").agg(F.sum("df").alias("df"), F.max("max_f").alias("max_f"), F.min("min_dl").alias("min_dl"))
    return rows.where("df > 0").withColumn("bucket", bucket("term"))


def pruned(index: Index, words: DataFrame) -> DataFrame:
    """The postings that a table of words (term, bucket) can need: row groups of the words where these are few enough to
    be told to the scan, and folders of their buckets in any case (BUCKETS at most)."""
    few = words.select("term", "bucket").distinct().limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        return index.postings.where(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("term").isin(sorted({r.term for r in few})))
    return index.postings.where(F.col("bucket").isin([r.bucket for r in words.select("bucket").distinct().collect()]))


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    """The values of a column of lists, one after the other."""
    return rows[name].combine_chunks().flatten().to_numpy()


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column, and each row's number among them."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where rows of a new key begin."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _runs(phrase, ids, dls, rows: pa.Table, owner: np.ndarray, live: np.ndarray, worth: np.ndarray) -> list[np.ndarray]:
    """phrase, id, f, dl of runs of places, of the living postings of phrases of several words."""
    places = rows["places"].combine_chunks().flatten()
    sizes = np.diff(places.offsets.to_numpy())
    entry = np.repeat(np.arange(len(sizes)), sizes)
    k, wanted = rows["k"].to_numpy()[owner][entry], rows["words"].to_numpy()[owner][entry]
    at = places.flatten().to_numpy() - k
    order = np.lexsort((k, at, ids[entry], phrase[entry]))
    order = order[live[entry[order]]]
    e, at, k, wanted = entry[order], at[order], k[order], wanted[order]
    once = _starts(phrase[e], ids[e], at, k)
    e, at, wanted = e[once], at[once], wanted[once]
    first = _starts(phrase[e], ids[e], at)
    whole = first[np.diff(np.r_[first, len(e)]) == wanted[first]]
    e, f = e[whole], worth[at[whole] >> PLACE_BITS]
    first = _starts(phrase[e], ids[e])
    return [phrase[e[first]], ids[e[first]], np.add.reduceat(f, first) if len(first) else f, np.maximum.reduceat(dls[e], first) if len(first) else dls[:0]]


def hits(index: Index, words: DataFrame, cfg: EngineConfig) -> DataFrame:
    """phrase, prefix, corpus, block, n, ids, fs, dls: what the phrases of ``words`` (rows of ``spelled``) find, a row for a
    phrase and a block of ids.

    Postings of a block meet in one task, as arrays; no row is made for an entry. What a task gets at once is bounded by
    the texts of the block's entries. Postings of entries that were removed later are left out.
    """
    worth = np.array([float(cfg.bm25[c]) for c in COLUMNS])
    key, kinds = ["term", "corpus", "bucket"], HITS_ARROW

    def posted(some: DataFrame, places) -> DataFrame:
        found = pruned(index, some).join(some.select("phrase", "prefix", "words", "k", *key), key)
        return found.select("phrase", "prefix", "words", "k", "corpus", "block", "gen", "ids", "fs", "dls", places.alias("places"))

    rows = posted(words.where("words = 1"), F.lit(None).cast("array<array<int>>"))
    if words.where("words > 1").limit(1).count():
        rows = rows.unionByName(posted(words.where("words > 1"), F.col("places")))
    gone = index.removed.select("corpus", F.expr(f"id div {SPAN}").alias("block"), "id", F.col("gen").alias("until"))

    def meet(rows: pa.Table, gone: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kinds.empty_table()
        names, code = _codes(rows["phrase"])
        code = code * 2 + rows["prefix"].to_numpy()
        rows = rows.append_column("code", pa.array(code)).take(np.argsort(code, kind="stable"))
        found = []
        for several in (False, True):
            wanted = pc.equal(pc.greater(rows["words"], 1), several)
            if not pc.any(wanted).as_py():
                continue
            some = rows if pc.all(wanted).as_py() else rows.filter(wanted)
            owner = np.repeat(np.arange(some.num_rows), pc.list_value_length(some["ids"]).to_numpy())
            phrase, ids, fs, dls = some["code"].to_numpy()[owner], _flat(some, "ids"), _flat(some, "fs"), _flat(some, "dls")
            live = np.ones(len(ids), bool)
            if gone.num_rows:
                number, until = gone["id"].to_numpy(), gone["until"].to_numpy()
                order = np.lexsort((-until, number))
                number, until = number[order], until[order]
                at = np.minimum(np.searchsorted(number, ids), len(number) - 1)
                live = (number[at] != ids) | (until[at] <= some["gen"].to_numpy()[owner])
            if several:
                found.append(_runs(phrase, ids, dls, some, owner, live, worth))
                continue
            phrase, ids, fs, dls = phrase[live], ids[live], fs[live], dls[live]
            order = np.argsort(phrase * (4 * SPAN) + ids % (2 * SPAN), kind="stable")  # runs of ids, which merge quickly
            phrase, ids = phrase[order], ids[order]
            first = _starts(phrase, ids)
            if len(first):
                found.append([phrase[first], ids[first], np.add.reduceat(fs[order], first), np.maximum.reduceat(dls[order], first)])
        phrase, ids, fs, dls = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        first = _starts(phrase)
        offsets = pa.array(np.r_[first, len(phrase)], pa.int32())
        lists = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
        one = lambda name: pa.repeat(rows[name][0], len(first))
        made = [
            names.take(pa.array(phrase[first] // 2)), pa.array(phrase[first] % 2 == 1), one("corpus"), one("block"), pa.array(np.diff(np.r_[first, len(phrase)]), pa.int64()),
            lists(ids, pa.int64()), lists(fs, pa.float64()), lists(dls, pa.int32()),
        ]
        return pa.table(made, schema=kinds) if len(first) else kinds.empty_table()

    at = ["corpus", "block"]
    return rows.groupBy(*at).cogroup(gone.groupBy(*at)).applyInArrow(meet, HITS)


def _weighted(df: DataFrame, stats: DataFrame) -> DataFrame:
    """phrase, prefix, corpus, idf, avgdl of df rows; the idf of what more than half of the entries have is a small constant."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(stats, "corpus").withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf)).drop("n", "df")


KEY = ["phrase", "prefix", "corpus"]


def bm25(index: Index, queries: DataFrame, cfg: EngineConfig, direct: int | None = None) -> DataFrame:
    """qid, corpus, id, score (smaller is better), rank: the best ``lexical_limit`` entries of each corpus for ``queries`` (qid, text).

    Ranks are those of the scores before they are rounded, ties by id. Each distinct phrase of all queries is looked up
    once. A query without terms finds nothing. Parts of a score are added as multiples of 1.4e-14 (FINE), so the sum does
    not depend on their order, and equal entries tie.

    Every posting of a query's phrases is scored, as arrays: a task gets what a block of ids has of the phrases of
    about ASKING queries, adds up one query after another, and gives ``lexical_limit`` rows at most for each. ``direct``
    (postings up to which all were scored) has no effect any more. The result is a written table of ``lexical_limit`` rows
    at most for a query and corpus; other tables that were written for it are deleted.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    asked = kept(phrases(queries), "phrases")
    words = kept(spelled(index, asked.select("phrase", "prefix", "words").distinct()), "words")
    stats = F.broadcast(statistics(index))  # a row for each corpus
    found = kept(hits(index, words, cfg), "hits")
    weights = _weighted(found.groupBy(*KEY).agg(F.sum("n").alias("df")), stats)
    shares = queries.count() // ASKING + 1
    asking = asked.groupBy("phrase", "prefix", F.expr(f"cast(pmod(xxhash64(qid), {shares}) as int)").alias("share")).agg(F.collect_list("qid").alias("qids"))
    terms = kept(weights.join(asking, ["phrase", "prefix"]), "terms")
    k1, b, limit = cfg.bm25["k1"], cfg.bm25["b"], cfg.lexical_limit

    def best(rows: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(rows["ids"]).to_numpy()
        each = lambda name: np.repeat(rows[name].to_numpy(), sizes)
        ids, f = _flat(rows, "ids"), _flat(rows, "fs")
        parts = each("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * _flat(rows, "dls") / each("avgdl")))
        units = np.rint(parts * FINE).astype(np.int64)  # whole numbers: the same sum in any order
        ends, base = np.r_[0, np.cumsum(sizes)], ids.min()
        place, sums = ids - base, np.zeros(ids.max() - base + 1, np.int64)
        qids = rows["qids"].combine_chunks()
        names, code = _codes(pa.chunked_array([qids.flatten()]))
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(qids).to_numpy())
        order = np.argsort(code, kind="stable")
        out: list[list[np.ndarray]] = []
        for q, mine in enumerate(np.split(row[order], _starts(code[order])[1:])):
            sums[:] = 0
            for r in mine:
                sums[place[ends[r] : ends[r + 1]]] += units[ends[r] : ends[r + 1]]
            at = np.flatnonzero(sums)
            score = -sums[at] / float(FINE)
            if len(at) > limit:
                near = score <= np.partition(score, limit - 1)[limit - 1]
                at, score = at[near], score[near]
            first = np.lexsort((at, score))[:limit]
            out.append([np.full(len(first), q), at[first] + base, score[first]])
        q, ids, score = map(np.concatenate, zip(*out))
        return pa.table({"qid": names.take(pa.array(q)), "corpus": pa.repeat(rows["corpus"][0], len(q)), "id": pa.array(ids, pa.int64()), "_score": score})

    of = found.select(*KEY, "block", "ids", "fs", "dls").join(terms, KEY).drop("phrase", "prefix")
    kind = queries.schema["qid"].dataType.simpleString()
    scores = of.groupBy("share", "corpus", "block").applyInArrow(best, f"qid {kind}, corpus string, id long, _score double")
    rank = F.row_number().over(W.partitionBy("qid", "corpus").orderBy("_score", "id"))
    ranked = scores.withColumn("rank", rank).where(F.col("rank") <= limit)
    out = written(ranked.select("qid", "corpus", "id", (F.round("_score", 4) + F.lit(0.0)).alias("score"), "rank"), "lexical-ranks")
    discard(*made)
    return out


class LexicalIndex:
    """The stored index of a corpus, which follows its entries.

    ``build`` makes it anew, ``refresh`` brings it up to changes, if the source's signature tells of any. A source that
    can't be read or a change that can't be written leaves the index as it is and gives a reason, fixed words without
    anything of a query; so does an index that can't be read.
    """

    name = "lexical index"

    def __init__(self, spark: SparkSession, path: str, source, cfg: EngineConfig, recheck: float = 30.0, clock=time.monotonic):
        self.spark, self.path, self.source, self.cfg, self.recheck, self.clock = spark, path, source, cfg, recheck, clock
        self.version: int | None = None
        self.signature = None
        self.checked_at = float("-inf")
        self.reasons: Counter = Counter()

    def _now(self) -> DataFrame:
        return self.source().select("corpus", "id", *COLUMNS)

    def build(self) -> None:
        rows = self._now()
        signature = source_signature(rows)
        build(rows, self.cfg, self.path)
        self.signature, self.version = signature, generations(self.spark, self.path)[-1]

    def refresh(self) -> str | None:
        """Follow the source, which is looked at once in ``recheck`` seconds; the reason if that fails."""
        now = self.clock()
        if now - self.checked_at < self.recheck:
            return None
        self.checked_at = now
        try:
            rows = self._now()
            signature = source_signature(rows)
        except Exception as e:
            return self.degraded(f"source fingerprint failed ({type(e).__name__})")
        if signature == self.signature and self.version is not None:
            return None
        try:
            if self.version is None:
                self.build()
            else:
                refresh(rows, self.cfg, self.path)
                self.signature, self.version = signature, generations(self.spark, self.path)[-1]
        except Exception as e:
            return self.degraded(f"{self.name} rebuild failed ({type(e).__name__})")
        return None

    def table(self) -> tuple[Index | None, str | None]:
        """The index as it is now, or why there is none."""
        try:
            return read(self.spark, self.path), None
        except Exception:
            return None, self.degraded(f"{self.name} unusable")

    def lookup(self, queries: DataFrame) -> tuple[DataFrame, str | None]:
        """``bm25`` of the current index; without one no rows, and the reason."""
        index, reason = self.table()
        if index is None:
            return self.spark.createDataFrame([], "qid long, corpus string, id long, score double, rank int"), reason
        return bm25(index, queries, self.cfg), None

    def degraded(self, reason: str) -> str:
        """Said once for each different reason."""
        self.reasons[reason] += 1
        if self.reasons[reason] == 1:
            print(f"[{self.name}] {reason}", flush=True)
        return reason
