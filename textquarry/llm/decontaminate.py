"""Benchmark passages in a corpus, by a distributed positional inverted index.

The index is a table of postings (term, document row, word position) of every
word that any test item uses, made in one pass over the texts and stored. Each
window of ten item words is looked up by its two rarest terms: their postings,
shifted by the term's place in the item, have to meet on one alignment. Where
they do, the postings of all other item words are intersected on that alignment,
and the windows all of whose words are there are exact matches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import ROW, filled, with_rows, without_rows
from textquarry.session import materialise

# Which letters are lower-cased and what a word is.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Share of an item's different words that a near match holds.
SHARE = 2 / 3
#: Stands after the last word of a document, so that its position is the word count.
END = "\x00"


def words(text: Column) -> Column:
    """Words in order, A to Z in lower case; null has none."""
    known = filled(text)
    ascii_only = F.octet_length(known) == F.char_length(known)
    lowered = F.when(ascii_only, F.lower(known)).otherwise(
        F.translate(known, UPPER, UPPER.lower()))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


class Tests(NamedTuple):
    """items: (item, item_id, q, term), a row per word; vocabulary: (word, term)."""

    items: DataFrame
    vocabulary: DataFrame


def read_tests(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Tests:
    numbered = benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialise(numbered.select(
        "item", "item_id", F.posexplode(words(F.col("text"))).alias("q", "word")), "item-words")
    distinct = rows.select("word").distinct().select(
        "word", F.monotonically_increasing_id().alias("term"))
    end = rows.sparkSession.createDataFrame([(END, -1)], "word string, term long")
    vocabulary = materialise(distinct.unionByName(end), "vocabulary")
    return Tests(materialise(rows.join(vocabulary, "word").drop("word"), "items"), vocabulary)


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(row, doc_id, pos, term): the stored postings, and per document the end mark.

    Spark broadcasts the vocabulary if its stored size allows, else it joins by
    shuffling.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    numbered = docs.select(
        row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    tokens = numbered.select("row", "doc_id", F.posexplode(
        F.array_append(words(F.col("text")), F.lit(END))).alias("pos", "word"))
    return materialise(tokens.join(vocabulary, "word").select("row", "doc_id", "pos", "term"),
                       "index")


def _windows(items: DataFrame, counts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(item, q, term) of the rarest terms, and (item, windows): where each window
    starts, how many words it has, and which two places look it up."""
    sizes = items.groupBy("item").agg(F.count("*").alias("n"))
    spans = sizes.select("item", F.least("n", F.lit(width)).alias("len"), F.explode(F.sequence(
        F.lit(0), F.greatest(F.col("n") - width, F.lit(0)).cast("int"))).alias("s"))
    known = items.join(counts, "term", "left").select(
        "item", "q", "term", F.coalesce("count", F.lit(0)).alias("count"))
    places = known.join(spans, "item").where(
        (F.col("q") >= F.col("s")) & (F.col("q") < F.col("s") + F.col("len")))
    rank = F.row_number().over(Window.partitionBy("item", "s").orderBy("count", "q"))
    rarest = materialise(places.withColumn("rank", rank).where("rank <= 2"), "anchors")
    pairs = rarest.groupBy("item", "s", "len").agg(F.min("q").alias("q1"), F.max("q").alias("q2"))
    return (rarest.select("item", "q", "term").distinct(),
            pairs.groupBy("item").agg(F.collect_list(F.struct("s", "len", "q1", "q2")).alias("windows")))


def matches(index: DataFrame, tests: Tests, width: int = WINDOW) -> DataFrame:
    """(row, item, shift, found, covered): exact matches of windows.

    ``found`` are the windows of the item that occur, as first word and length;
    ``covered`` the word positions of the document inside them.
    """
    postings = index.where(F.col("term") >= 0).select("row", "pos", "term")
    counts = materialise(postings.groupBy("term").count(), "term-counts")
    anchors, windows = _windows(tests.items, counts, width)
    windows = materialise(windows, "windows")
    hits = postings.join(materialise(anchors, "anchor-places"), "term").select(
        "row", "item", (F.col("pos") - F.col("q")).alias("shift"), "q")
    aligned = hits.groupBy("row", "item", "shift").agg(F.collect_set("q").alias("qs"))
    candidates = materialise(aligned.join(windows, "item").where(F.exists(
        "windows", lambda w: F.array_contains("qs", w["q1"]) & F.array_contains("qs", w["q2"])))
        .select("row", "item", "shift"), "alignments")
    # only postings of documents with an alignment meet the other words of the item
    near = postings.join(candidates.select("row").distinct(), "row", "left_semi")
    expected = candidates.join(tests.items, "item").select(
        "row", "item", "shift", "q", (F.col("shift") + F.col("q")).alias("pos"), "term")
    there = expected.join(near, ["row", "pos", "term"]).groupBy("row", "item", "shift").agg(
        F.collect_set("q").alias("qs"))
    inside = F.filter("windows", lambda w: F.size(F.filter(
        "qs", lambda q: (q >= w["s"]) & (q < w["s"] + w["len"]))) == w["len"])
    found = there.join(windows, "item").withColumn("found", inside).where(F.size("found") > 0)
    covered = F.filter("qs", lambda q: F.exists(
        "found", lambda w: (q >= w["s"]) & (q < w["s"] + w["len"])))
    return found.select(
        "row", "item", "shift",
        F.transform("found", lambda w: F.struct(w["s"], w["len"])).alias("found"),
        F.transform(covered, lambda q: q + F.col("shift")).alias("covered"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document: how many of its words lie in a benchmark window.

    A window is ``width`` consecutive words of an item; an item of fewer words is
    one window, an item without words has none. Null texts have no words. Rows
    that repeat an id are documents (items) of their own; an item without an id
    hits words but is not listed. An empty benchmark hits nothing; an empty corpus
    gives no rows. Further columns are ignored.
    Columns: doc_id, n_words, n_hit, n_items, item_ids, contaminated.
    """
    return _decided(docs, benchmark, width, id_col, text_col, item_col, item_text_col).drop("row")


def _decided(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    tests = read_tests(benchmark, item_col, item_text_col)
    index = build_index(docs, tests.vocabulary, id_col, text_col)
    names = tests.items.select("item", F.col("item_id").cast("string").alias("name")).distinct()
    hits = matches(index, tests, width).join(names, "item").groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_hit"),
        F.array_sort(F.collect_set("name")).alias("item_ids"))
    ends = index.where(F.col("term") < 0).select("row", "doc_id", F.col("pos").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    item_ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return ends.join(hits, "row", "left").select(
        "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"),
        (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that hold no window, with all their columns, row by row: ids may repeat
    or be null. Null and empty texts stay; without a benchmark all do."""
    keyed = with_rows(docs)
    return without_rows(keyed, _decided(keyed, benchmark, width).where("contaminated"))


def proximity(index: DataFrame, tests: Tests, within: int, share: float = SHARE) -> DataFrame:
    """(row, item, distance): documents where at least ``share`` of the different words of
    an item stand together, in any order, the first and the last at most ``within``
    words apart; the least distance. An item of one word is found at distance 0.

    Of an item's k words, m of them needed, two of the k - m + 2 rarest (one of one, if
    one is needed) have to stand together, so these choose the candidates and no match
    is lost; then the positions of all words of the item are compared.
    """
    postings = index.where(F.col("term") >= 0).select("row", "pos", "term")
    counts = materialise(postings.groupBy("term").count(), "term-counts")
    distinct = tests.items.select("item", "term").distinct()
    needed = distinct.groupBy("item").agg(F.count("*").alias("k")).select("item", "k", F.greatest(
        F.lit(1), F.ceil(F.lit(share) * F.col("k") - F.lit(1e-9))).cast("int").alias("need"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("count", F.lit(0)), "term"))
    words_of = materialise(distinct.join(counts, "term", "left").withColumn("rank", rank).join(
        needed, "item").select("item", "term", "k", "need", "rank"), "item-terms")
    rarest = words_of.where(F.col("rank") <= F.col("k") - F.col("need") + F.least("need", F.lit(2)))
    hits = postings.join(rarest.select("item", "term", "need"), "term")
    order = Window.partitionBy("row", "item").orderBy("pos")
    # the nearest two different words are neighbours in the merged list
    near = (F.lag("term").over(order) != F.col("term")) & (F.col("pos") - F.lag("pos").over(order) <= within)
    candidates = materialise(hits.withColumn("near", (F.col("need") == 1) | near).where("near").select(
        "row", "item").distinct(), "near-candidates")
    there = candidates.join(words_of.select("item", "term", "need"), "item").join(postings, ["row", "term"])
    again = F.lead("pos").over(Window.partitionBy("row", "item", "term").orderBy("pos"))
    ending = there.withColumn("again", again).withColumn("before", F.collect_list(
        F.struct("pos", "again")).over(order.rangeBetween(-within, 0)))
    # the last place of each word up to here; the window starts at the need-th from the end
    lasts = F.filter("before", lambda x: x["again"].isNull() | (x["again"] > F.col("pos")))
    return ending.select("row", "item", "pos", "need", F.array_sort(F.transform(
        lasts, lambda x: x["pos"])).alias("lasts")).where(F.size("lasts") >= F.col("need")).select(
        "row", "item", (F.col("pos") - F.element_at("lasts", -F.col("need"))).alias("distance")).groupBy(
        "row", "item").agg(F.min("distance").alias("distance"))


_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
          rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# DuckDB counterpart of contamination over ``documents`` and ``benchmark``, with
# the item ids as a digest.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s, w
        FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM win),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.n, p.s, g.item_id
         FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM places) p
         JOIN grams g USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""
