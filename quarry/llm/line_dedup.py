"""Removal of lines that are like an earlier one, by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line of the corpus, by
document id and line number, has a Jaccard similarity of at least PERCENT % with it; lines
are judged on the input, not on what is left. Lines without words stay.

1. Words stand in one order, the same for all lines, in which rare words should come first:
   by their length, then by their hash. Where the lists of step 4 would be long so (more than
   PAIRS_A_SET pairs a set, by the squares of COUNTERS counters), words are counted over all
   documents in as many counters by hash, and stand by their counter, on a logarithmic scale,
   less their length, as counters hold other words too.
2. Equal sets form one class; all its lines but the first go. Classes are numbered in
   the order in which they first stand, so of two numbers the smaller is the earlier line's.
3. Each class is compared with the earliest one that has the same two words, for neighbours
   among its LEAD rarest words. This settles most of a large group of near copies in a number
   of pairs in proportion to the classes. The HUBS classes that most others proved to be like
   then meet all open classes in their lists, and settle most of the rest of it.
4. What is open still meets every earlier class in its lists: two sets alike share a word
   among the first n - ceil(PERCENT n / 100) + 1 of each, and in a shorter prefix of the
   smaller set, so only these are listed, of two open sets the shorter prefix of the smaller.
   A pair must pass the length and the positional filter and a bound on the words that differ
   by the bits that they turn over.
5. After each of these all words of the pairs found are compared.

DataFrame functions only, on the driver as on the executors. Words are told apart by
55-bit, sets by 64-bit hashes.

Defined results: a null text has no lines, an empty one has one line without words. Of
documents with one id, and of null ids, which come first, the order is that in which they
are read, and each of such rows has its own result. Ties and repeated rows: the copy that
comes first stays. An empty table gives no rows. Texts of any length are split as a whole,
in one row of its document's task. Other columns are not read and may have any name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W  # noqa: F401  with numpy, for the helper that a test holds; the query takes neither
from .scratch import discard, freed_at_once, materialise, new_path, only, reclaim, small, spare

PERCENT = 80
COUNTERS = 1 << 16
#: So many cost about what counting the words does.
PAIRS_A_SET = 2000
#: Of a word's key, those of its hash; above them stands its place.
_BITS = 55
#: Bytes of a word beyond which its length no longer counts, and what each is worth on the scale of the counters.
_LENGTH, _WORTH = 31, 2
#: A set's words turn over a bit each in the first; in larger sets those of half the words also in the second, which parts them into two.
_MAPS = ["bits0", "bits1"]
_LARGE = 16
#: Sets of fewer words are alike only if they are equal.
LEAST = 4
#: At most LEAST.
LEAD = 3
HUBS = 10_000
#: What parts words within a line besides spaces.
_OTHER_SPACE = "\t\x0b\x0c\r"


def _line_offsets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of the texts (each with its line feed), and the text of each line. Over buffers in memory; the query does not use it."""
    begin = np.concatenate((off[:-1], np.flatnonzero(buf == 10) + 1))
    text = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, np.flatnonzero(buf == 10), side="right") - 1))
    order = np.lexsort((begin, text))
    return np.append(begin[order], len(buf)), text[order]


def word_places(docs: DataFrame, text_col: str = "text") -> Column:
    """An array of COUNTERS constants: the logarithm of each counter, raised by what a word's length takes off at most."""
    words = raw_lines(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))).select(F.explode(F.split("words", " ")).alias("word")).filter("word != ''")
    counted = words.select(_counter(F.xxhash64("word")).alias("counter")).groupBy("counter").agg(F.least(F.lit(126), F.floor(F.log2(F.count(F.lit(1)) + 1) * 4)).cast("int").alias("place"))
    places = [str(_WORTH * _LENGTH)] * COUNTERS
    for r in counted.collect():  # at most COUNTERS rows
        places[r["counter"]] = str(r["place"] + _WORTH * _LENGTH)
    return F.split(F.lit(",".join(places)), ",").cast("array<smallint>")


def _counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def raw_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (of its document), line, words (a text, with spaces alone between them); a document without a text has one row, line null."""
    text = F.col(text_col).cast("string")
    plain = F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in _OTHER_SPACE)), F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE))).otherwise(text)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), plain.alias("text"))
    return own.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line", "words"))


def with_keys(lines: DataFrame, places: Column | None) -> DataFrame:
    """In place of the lines' words: keys, those of the distinct words, rare ones first; n, their number; id, of the set."""
    # arrays without nulls are sorted as plain numbers
    def place(w: Column) -> Column:
        length = F.least(F.octet_length(w), F.lit(_LENGTH))
        if places is None:
            return F.shiftleft((F.lit(_LENGTH) - length).cast("long"), _BITS)
        counted = F.coalesce(F.get(places, _counter(F.xxhash64(w))).cast("int"), F.lit(_WORTH * _LENGTH))
        return F.shiftleft((counted - length * _WORTH).cast("long"), _BITS)

    words = F.coalesce("words", F.lit(""))
    found = F.split(words, " ")
    found = F.when(F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit("  ")), F.array_remove(found, "")).otherwise(found)
    keys = F.transform(found, lambda w: place(w).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 64 - _BITS)))
    own = [c for c in lines.columns if c != "words"]
    keyed = lines.select(*own, F.sort_array(F.array_distinct(keys)).alias("keys"))
    return keyed.select(*own, "keys", F.size("keys").alias("n"), F.xxhash64("keys").alias("id"))


def _turned(which: str = "1L") -> Column:
    """The bits that the keys turn over, those for which which is 1; a shift of a long takes the last six bits of its distance."""
    return F.expr(f"aggregate(keys, 0L, (s, k) -> s ^ shiftleft({which}, cast(k & 63L as int)))")


def lines(docs: DataFrame, places: Column | None = None) -> DataFrame:
    """doc_id, row, line, n, id (of the set of words), rare (the prefix, LEAD words at least, by 32 bits) and bits; a document without a text has one row, line null."""
    # by 32 bits, as a pair that shares no word is refused later
    rare = F.transform(F.slice("keys", 1, F.greatest(_listed(F.col("n")), F.lit(LEAD))), lambda k: F.hash(k))
    own = {"rare": rare, _MAPS[0]: _turned(), _MAPS[1]: F.when(F.col("n") > _LARGE, _turned("shiftright(k, 6) & 1L")).otherwise(F.lit(0).cast("long"))}
    return with_keys(raw_lines(docs), places).select("doc_id", "row", "line", "n", "id", *(F.when(F.col("n") >= LEAST, c).alias(name) for name, c in own.items()))


def _listed(n: Column) -> Column:
    """The length of the prefix of a set of n words."""
    return (n - F.ceil(n * PERCENT / 100) + 1).cast("int")


def _listed_smaller(n: Column) -> Column:
    """The same where the other set is not smaller, so that more words must be equal."""
    return (n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT)) + 1).cast("int")


def _leads() -> Column:
    """Every two of a set's LEAD rarest words that stand next to one another, or but one, in their order."""
    word = lambda i: F.get("rare", F.lit(i)).cast("long")
    near = [(i, i + d) for d in (1, 2) for i in range(LEAD - d)]
    return F.array(*(F.shiftleft(word(i), 32).bitwiseOR(word(j).bitwiseAND(F.lit((1 << 32) - 1))) for i, j in near))


def _can(n: Column, m: Column, bits: list[Column], other: list[Column]) -> Column:
    """Whether sets of n and m words may be alike: by length, and by the words that their bits prove to differ."""
    in_reach = (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)
    few = lambda differ: differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT)
    every, half = (a.bitwiseXOR(b) for a, b in zip(bits, other, strict=True))
    return in_reach & few(F.bit_count(every)) & ((n <= _LARGE) | (m <= _LARGE) | few(F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(f"{prefix}_{c}" for c in df.columns))


def _maps(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{b}") for b in _MAPS]


def _hashes(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as written, and where; no dictionary of hashes is tried."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    writer = df.write
    for c in ("id", "rare.list.element", *_MAPS):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _classes(every: DataFrame) -> DataFrame:
    """The sets of all lines, numbered (rank) in the order in which they first stand."""
    found = every.filter("n > 0").groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("at"), F.first("n").alias("n"), F.first(F.struct("rare", *_MAPS)).alias("own"))
    return found.sort("at").select(F.monotonically_increasing_id().alias("rank"), "id", "at", "n", "own.*")


def pairs_listed(able: DataFrame) -> float:
    """About how many pairs of sets the lists hold: the squares of counters by hash, less what different words in one counter add to them."""
    counted = able.select(F.explode(F.slice("rare", 1, _listed(F.col("n")))).alias("item")).groupBy(F.pmod("item", F.lit(COUNTERS)).alias("counter")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    r = counted.agg(F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("k").alias("k")).first()
    k = r["k"] or 0.0
    return max(0.0, (r["squares"] or 0.0) - k * k / COUNTERS) / 2


class _Corpus:
    """The classes of a corpus, and the comparison of all words of pairs of them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        spark = docs.sparkSession
        self.places: Column | None = None
        every, path = self._classify()
        if pairs_listed(self.able) > PAIRS_A_SET * self.classes.count():
            discard(spark, path)
            self.places = word_places(self.docs)
            every, path = self._classify()
        self.lines = materialise(every.select("doc_id", "row", "line", "n"), "lines")
        discard(spark, path)
        reclaim(spark)

    def _classify(self) -> tuple[DataFrame, str]:
        """Sets the classes in the order that the places make; all lines, and where they are written."""
        every, path = _hashes(lines(self.docs, self.places), "listed")
        self.classes, _ = _hashes(_classes(every), "classes")
        self.able = self.classes.filter(F.col("n") >= LEAST)
        return every, path

    def alike(self, pairs: DataFrame) -> DataFrame:
        """pairs: later, earlier. For each later set that is alike one of its earlier ones: rank, hub (the first of these)."""
        ranks = pairs.select(F.col("later").alias("rank")).union(pairs.select("earlier")).distinct()
        wanted = materialise(self.classes.join(small(ranks), "rank", "left_semi").select("rank", "id", "at.doc_id", "at.line"), "wanted")
        found = only(raw_lines(only(self.docs, wanted, ["doc_id"])).drop("row"), wanted, ["doc_id", "line"])
        place = [F.col("doc_id").eqNullSafe(F.col("w_doc_id")), F.col("line") == F.col("w_line"), F.col("id") == F.col("w_id")]
        sets = with_keys(found, self.places).join(small(_named(wanted, "w")), place).select(F.col("w_rank").alias("rank"), "keys").dropDuplicates(["rank"])
        sets = materialise(sets, "sets")
        both = F.size(F.array_intersect("x_keys", "y_keys"))
        met = pairs.join(_named(sets, "x"), F.col("later") == F.col("x_rank")).join(_named(sets, "y"), F.col("earlier") == F.col("y_rank"))
        met = met.filter(both * 100 >= PERCENT * (F.size("x_keys") + F.size("y_keys") - both))
        found = materialise(met.groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("hub")), "alike")
        reclaim(self.docs.sparkSession)
        return found

    def by_leads(self) -> DataFrame:
        """Pairs of a set and the earliest one that has the same two rare words, if their bits allow it."""
        keyed = self.able.select("rank", F.explode(_leads()).alias("key"))
        first = materialise(keyed.groupBy("key").agg(F.min("rank").alias("earlier"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "earlier"), "first")
        met = keyed.join(small(first), "key").filter("earlier < rank").select(F.col("rank").alias("later"), "earlier").distinct()
        met, maps = materialise(met, "met"), self.able.select("rank", "n", *_MAPS)
        reclaim(self.docs.sparkSession)
        both = met.join(_named(maps, "x"), F.col("later") == F.col("x_rank"))
        both = both.join(_named(maps, "y"), (F.col("earlier") == F.col("y_rank")) & _can(F.col("x_n"), F.col("y_n"), _maps("x"), _maps("y")))
        return materialise(both.select("later", "earlier"), "pairs")

    def by_list(self, gone: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
        """Pairs of an open set and an earlier one, of the hubs if they are given, that may be alike; one word of their prefixes is equal."""
        state = self.able.join(small(gone.select("rank", F.lit(True).alias("gone"))), "rank", "left").withColumn("open", F.col("gone").isNull())
        n, is_open = F.col("n"), F.col("open")
        if hubs is None:
            other = _entries(state, F.when(is_open, _listed_smaller(n)).otherwise(_listed(n)), is_open)
        else:  # few
            other = small(materialise(_entries(self.able.join(small(hubs), "rank", "left_semi"), _listed(n), F.lit(False)), "hubs"))
        pairs = materialise(_mates(_entries(state.filter(is_open), _listed(n), is_open), other), "pairs")
        reclaim(self.docs.sparkSession)
        return pairs


def _entries(sets: DataFrame, length: Column, is_open: Column) -> DataFrame:
    """item, rank, own and bits for each word of the sets' prefixes of that length; size, place and whether a set is open stand in own."""
    listed = sets.select("rank", "n", is_open.alias("open"), *_MAPS, F.posexplode(F.slice("rare", 1, length)).alias("pos", "item"))
    own = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos") * 2 + F.col("open").cast("long")
    return listed.select("item", "rank", own.alias("own"), *_MAPS)


def _mates(part: DataFrame, other: DataFrame) -> DataFrame:
    """later, earlier: the open sets of part with those of other that may be alike, by one equal word: with open ones that are smaller, or as large and earlier; with any other earlier one."""
    size, place = (lambda c: F.shiftright(F.col(c), 32)), (lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)), 1))
    n, m, before = size("x_own"), size("y_own"), F.col("y_rank") < F.col("x_rank")
    mine = F.when(F.col("y_own").bitwiseAND(F.lit(1)) == 1, (m < n) | (m == n) & before).otherwise(before)
    # the first word that both have: behind it the smaller of what is left of either must do
    possible = F.least(n - place("x_own"), m - place("y_own")) * (100 + PERCENT) >= (n + m) * PERCENT
    pairs = _named(part, "x").join(_named(other, "y"), (F.col("x_item") == F.col("y_item")) & mine & possible & _can(n, m, _maps("x"), _maps("y")))
    return pairs.select(F.greatest("x_rank", "y_rank").alias("later"), F.least("x_rank", "y_rank").alias("earlier")).distinct()


def _hubs(gone: DataFrame) -> DataFrame:
    """The HUBS classes that most others were found to be like; what they leave open meets its lists."""
    return gone.groupBy(F.col("hub").alias("rank")).agg(F.count(F.lit(1)).alias("k")).sort(F.desc("k"), "rank").limit(HUBS).select("rank")


def find_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: all lines (doc_id, row, line, n), and the lines that stay (doc_id, row, line)."""
    with freed_at_once(docs.sparkSession):
        corpus = _Corpus(docs, id_col, text_col)
        gone = corpus.alike(corpus.by_leads())
        gone = gone.unionByName(corpus.alike(corpus.by_list(gone, _hubs(gone))))
        gone = gone.unionByName(corpus.alike(corpus.by_list(gone)))
        kept = corpus.classes.join(small(gone), "rank", "left_anti").select("at.doc_id", "at.row", "at.line")
        return corpus.lines, materialise(kept, "kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (the numbers of the removed lines, from 0)."""
    every, kept = find_lines(docs, id_col, text_col)
    stays = kept.groupBy("row").agg(F.collect_list("line").alias("stay"))
    own = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("line").alias("n_lines"), F.collect_list(F.when(F.col("n") > 0, F.col("line"))).alias("worded"))
    removed = F.array_sort(F.array_except("worded", F.coalesce("stay", F.array().cast("array<int>"))))
    return own.join(stays, "row", "left").select("doc_id", "n_lines", removed.alias("removed")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unique by id, with their removed lines taken out of the text."""
    key, gone = spare("gone_id", docs.columns), spare("gone", docs.columns)
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    taken = removed.select(F.col("doc_id").alias(key), F.col("removed").alias(gone))
    return docs.join(taken, F.col(id_col).eqNullSafe(F.col(key)), "left").withColumn(text_col, F.when(F.size(gone) > 0, kept).otherwise(F.col(text_col))).select(*docs.columns)
