"""Spelling variants: words one edit apart, by composition of finite automata.

A is the minimal acyclic acceptor of a set of words, T the transducer that copies
symbols but for one that it inserts, deletes or replaces. The pairs that A ∘ T ∘ A
accepts are the near words. Before the edit both sides of the composition have read
the same symbols and are in the same state; after it only common endings are left,
so a state of the composition is a pair of states of A, and pairs without a common
ending are found once and pruned.

The composition is cut by its initial states, so that no task holds the whole
vocabulary. A part is the set of words with a common beginning, its edits any of
those further on. Where a beginning has too many words, its symbol next in line is
read in advance: edits of just that symbol leave both sides with the same rest, so
they are dealt by a hash of the word without it, and the longer beginnings become
parts of their own. An edit counts where the two words first differ, hence each pair
is accepted in one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import filled, keyed_text, sql_crc32
from textquarry.session import materialise

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of the runs, one in so many loses a code point.
SLIP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A variant's form occurs at least so many times as often.
RATIO = 2
#: Words of a part, about.
PART_WORDS = 10_000
_BOTH, _LONG, _SHORT = "", "<", ">"


class Acceptor:
    """Minimal acyclic acceptor, built from words in ascending order."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        self._register: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            self._minimise(path, last, shared)
            for symbol in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][symbol] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = word
        self._minimise(path, last, 0)
        self._common: dict[tuple[int, int], bool] = {}

    def _minimise(self, path: list[int], word: str, keep: int) -> None:
        """Replace the states past ``keep`` symbols by equivalent ones, from the end."""
        while len(path) > keep + 1:
            state = path.pop()
            known = self._register.setdefault((self.final[state], tuple(self.edges[state].items())), state)
            self.edges[path[-1]][word[len(path) - 1]] = known

    def _steps(self, a: int, b: int) -> Iterator[tuple[str, int, int]]:
        few, many = self.edges[a], self.edges[b]
        if len(few) > len(many):
            for symbol, to in many.items():
                if symbol in few:
                    yield symbol, few[symbol], to
        else:
            for symbol, to in few.items():
                if symbol in many:
                    yield symbol, to, many[symbol]

    def common(self, a: int, b: int) -> bool:
        """Whether some ending is accepted from both states."""
        known, stack = self._common, [(a, b)]
        while stack:
            pair = stack[-1]
            if pair not in known:
                if pair[0] == pair[1] or (self.final[pair[0]] and self.final[pair[1]]):
                    known[pair] = True
                else:
                    further = [(x, y) for _, x, y in self._steps(*pair)]
                    if any(known.get(p) for p in further):
                        known[pair] = True
                    else:
                        unknown = [p for p in further if p not in known]
                        if unknown:
                            stack.append(unknown[0])
                            continue
                        known[pair] = False
            stack.pop()
        return known[a, b]

    def endings(self, a: int, b: int) -> Iterator[str]:
        """All endings accepted from both states."""
        if self.final[a] and self.final[b]:
            yield ""
        symbols: list[str] = []
        stack = [self._steps(a, b)]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if symbols:
                    symbols.pop()
                continue
            symbol, x, y = step
            if self.common(x, y):
                symbols.append(symbol)
                if self.final[x] and self.final[y]:
                    yield "".join(symbols)
                stack.append(self._steps(x, y))

    def _edits(self, long: int, short: int | None) -> list[tuple[str, str, int, int]]:
        """Edits by which both sides differ from here on: symbols read, states reached."""
        found = []
        after = list(self.edges[long].items())
        for i, (a, x) in enumerate(after):
            found.extend((a, b, x, y) for b, y in after[i + 1:] if self.common(x, y))
            if short is not None:
                if self.final[x] and self.final[short]:
                    found.append((a, "", x, -1))
                # the shorter word goes on with another symbol, or they would differ later
                for b, y in self.edges[short].items():
                    if b != a and b in self.edges[x] and self.common(self.edges[x][b], y):
                        found.append((a + b, b, self.edges[x][b], y))
        return found

    def pairs(self, first: int, last: int | None = None) -> Iterator[tuple[str, str]]:
        """Accepted pairs that first differ at a symbol from ``first`` to ``last``.

        Words marked ``<`` take part as the longer word or as one of equal length, those
        marked ``>`` as the shorter one; without marks all words do both.
        """
        start = self.edges[0]
        if _LONG in start or _SHORT in start:
            long, short = start.get(_LONG), start.get(_SHORT)
        else:
            long, short = 0, 0
        if long is None:
            return
        edits: dict[tuple[int, int | None], list] = {}
        stack: list[tuple[str, int, int | None]] = [("", long, short)]
        while stack:
            begun, x, y = stack.pop()
            if len(begun) >= first:
                if (x, y) not in edits:
                    edits[x, y] = self._edits(x, y)
                for a, b, to_a, to_b in edits[x, y]:
                    for ending in [""] if to_b < 0 else self.endings(to_a, to_b):
                        yield begun + a + ending, begun + b + ending
            if last is None or len(begun) < last:
                below = {} if y is None else self.edges[y]
                stack.extend((begun + symbol, to, below.get(symbol)) for symbol, to in self.edges[x].items())


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run) of every maximal run of letters, A-Z in lower case; null texts have none."""
    found = F.regexp_extract_all(filled(F.col("text")), F.lit(RUN), F.lit(0))
    return keyed_text(docs, id_col, text_col).select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))


def slipped(run: Column, doc_id: Column, every: int = SLIP) -> Column:
    """The run, without one code point if its hash with the document's id says so."""
    drawn = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (drawn % F.char_length(run)).cast("int")
    return F.when(drawn % every == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough, stored."""
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return materialise(counted.where(F.col("n") >= least_count), "vocabulary")


def parts(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(part, depth, at, mark, word, n): the words of every part, stored.

    Edits of a part are at symbol ``at``, or where that is -1 at ``depth`` or later. Rounds
    go on while some beginning has more than ``part_words`` words, a symbol at a time.
    """
    depth, left, dealt = 0, words, []
    while True:
        begun = left.withColumn("begin", F.left("word", F.lit(depth)))
        sizes = materialise(begun.groupBy("begin").count(), "beginnings")
        hot = sizes.where(F.col("count") > part_words)
        dealt.append(begun.join(hot, "begin", "left_anti").select(
            F.concat(F.lit(f"{depth}:"), "begin").alias("part"), F.lit(depth).alias("depth"),
            F.lit(-1).alias("at"), F.lit(_BOTH).alias("mark"), "word", "n"))
        rows = hot.agg(F.sum("count")).first()[0]
        if not rows:
            break
        crowded = materialise(begun.join(hot.select("begin"), "begin", "left_semi").select("word", "n"), "crowded")
        longer = crowded.where(F.char_length("word") > depth)
        buckets = -(-2 * rows // part_words)
        for side, mark, rest in (
                (longer, _LONG, F.concat(F.left("word", F.lit(depth)), F.substr("word", F.lit(depth + 2)))),
                (crowded, _SHORT, F.col("word"))):
            bucket = F.pmod(F.xxhash64(rest), F.lit(buckets)).cast("string")
            dealt.append(side.select(
                F.concat(F.lit(f"at {depth}:"), bucket).alias("part"), F.lit(depth).alias("depth"),
                F.lit(depth).alias("at"), F.lit(mark).alias("mark"), "word", "n"))
        left, depth = longer, depth + 1
    whole = dealt[0]
    for rows in dealt[1:]:
        whole = whole.unionByName(rows)
    return materialise(whole, "parts")


def _composed(part: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(part["word"], part["n"]))
    acceptor = Acceptor(sorted(set(part["mark"] + part["word"])))
    at, depth = int(part["at"].iloc[0]), int(part["depth"].iloc[0])
    near: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}
    for pair in acceptor.pairs(depth, None if at < 0 else at):
        for word, other in (pair, pair[::-1]):
            near[word] = near.get(word, 0) + 1
            rank = (-counts[other], other)
            if word not in best or rank < best[word]:
                best[word] = rank
    # plain objects: an empty column of pandas' own texts does not pass through Arrow
    return pd.DataFrame({"word": pd.Series(list(near), dtype=object), "near": list(near.values()),
                         "best_n": [-best[w][0] for w in near],
                         "best": pd.Series([best[w][1] for w in near], dtype=object)})


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of words (word, n) that have a near one: how many, and
    the most frequent of them (of several the first in code-point order)."""
    found = parts(words, part_words).groupBy("part").applyInPandas(
        _composed, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def variants(words: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """One row per word of (word, n) with its form and the root its forms lead to.

    Two words are near if they differ by exactly one inserted, deleted or replaced code
    point. A word's form is its most frequent near word (ties: the first in code-point
    order) if that occurs at least ``ratio`` (2 or more) times as often. Frequencies
    grow along forms, so they never lead in a circle. No words, no rows.
    Columns: word, form, root, n, n_near, form_n.
    """
    known = near_words(words, part_words)
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = materialise(words.join(known, "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    # every join doubles the way; a form at least doubles the frequency, so there are few
    way = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(way.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "way")
        way = moved.select("word", "root")
        if moved.where("went").isEmpty():
            break
    return formed.join(way, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      part_words: int = PART_WORDS) -> DataFrame:
    """The variants among the words of whole texts, one run in 97 with a slip.

    Null and empty texts have no words; a null id counts as an empty one in the draw of
    slips; repeated rows count as often as they occur. Further columns are ignored.
    """
    words = runs(docs, id_col, text_col).where(F.char_length("run") >= LEAST_LENGTH)
    return variants(vocabulary(words.select(slipped(F.col("run"), F.col("doc_id")).alias("word"))),
                    part_words=part_words)


# DuckDB counterpart of spelling_variants over ``documents``.
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{UPPER.lower()}') AS run
    FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
drawn AS (SELECT *, {sql_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, c FROM drawn)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON b.word = a.rest),
ranked AS (SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
ways AS (SELECT word, word AS root FROM formed
  UNION ALL SELECT w.word, f.form FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word
JOIN formed g ON g.word = w.root AND g.form IS NULL"""
