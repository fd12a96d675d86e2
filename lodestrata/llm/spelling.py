"""Spelling variants: words one edit apart, by errata tries.

The words' trie is cut into heavy paths: at every node the child with most words below is heavy, the other children, and the
end of a word at the node itself, are light. Small-to-large, only words below light children are moved, each
by one edit at that node, into the larger side:

* their character is replaced: by the heavy one, where they may meet a word below the heavy child, or by a mark, where the
  words of several light children meet;
* their character is skipped, where they may meet any word below the node;
* the heavy character is put before theirs (or before the end), which is the skip of the heavy character seen from the
  shorter word.

Two words of which one is the other with one edit part at exactly one node, and one of them is light there, so each pair is found
once, by terminals that coincide: the moved word's spelling equals a word, an equi-join. A word lies below at most
log2(words) light children, and moves as often, where deletion neighbourhoods move every word at every character.

On Spark: a node is the hash of a prefix; counts of words per node are an aggregate, heavy children another, over at most one
row per character of the alphabet and node. Prefixes are needed only as far as a word shares them with a neighbour in sorted
order; tasks find that on a range-sorted table, and keep all of them for a partition's first and last word. Members
of a mark differ in one character, so no group is larger than the alphabet.

Defined results: words with fewer than ``least_n`` occurrences or fewer than ``least_length`` code points are no words; a
null or empty text has none; a null id hashes like an empty text; repeated rows count each; a word of any length
is taken whole; ties of a form go to the smaller word in code-point order; an empty table gives an empty result. Nodes are
told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, table

LEAST_LENGTH = 7
LEAST_N = 2
#: A form is at least so many times as frequent as its word.
RATIO = 10
#: Of 31 runs, one loses a character.
DAMAGE = 31
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for any character; no letter.
MARK = "\u0001"


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, damage: int = DAMAGE) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, one in ``damage`` without one of its characters.

    Runs that are too short for a word, however they are damaged, are not split off at all.
    """
    run = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, UPPER.lower()), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cutout = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cutout).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``depth``: how far a word's prefixes can have other words below, plus one; words come sorted."""
    held: tuple | None = None  # the word before, with what it shares with the one before it
    first = True

    def row(wid: int, word: str, n: int, depth: int) -> pa.RecordBatch:
        return (wid, word, n, min(len(word), depth))

    def shared(a: str, b: str) -> int:
        if b.startswith(a):
            return len(a)
        low, high = 0, min(len(a), len(b))
        while low < high:  # words may be long
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    def send(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("wid", "word", "n", "depth"), r)) for r in rows], pa.schema([("wid", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("depth", pa.int32())]))

    for batch in batches:
        out = []
        for wid, word, n in zip(*(batch.column(c).to_pylist() for c in ("wid", "word", "n"))):
            if held is not None:
                both = shared(held[1], word)
                out.append(row(*held[:3], len(held[1]) if first else max(held[3], both) + 1))
                first = False
            else:
                both = 0
            held = (wid, word, n, both)
        yield send(out)
    if held is not None:  # the last word of the partition: what follows is elsewhere
        yield send([row(*held[:3], len(held[1]))])


def node(prefix: Column) -> Column:
    """128 bits that tell prefixes apart."""
    return F.struct(F.xxhash64(prefix).alias("a"), F.xxhash64(F.lit(7), prefix).alias("b"))


def light_moves(words: DataFrame) -> DataFrame:
    """wid, at, heavy: the words below light children, with the depth of the node and its heavy character (null without one).

    ``words`` has wid, word, n, depth. The end of a word is a light child whose ``at`` is the word's length.
    """
    steps = words.select("wid", "word", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("i"))
    steps = steps.select(
        "wid", "i", node(F.substring("word", F.lit(1), F.col("i"))).alias("node"), node(F.substring("word", F.lit(1), F.col("i") - 1)).alias("up"),
        F.substring("word", F.col("i"), F.lit(1)).alias("c"),
    )
    sizes = cut(steps.groupBy("node", "up", "c").agg(F.count("*").alias("below")))
    heavy = sizes.groupBy("up").agg(F.max_by("c", F.struct("below", "c")).alias("heavy"))  # an alphabet of rows a node at most
    light = sizes.join(heavy, "up").where("c <> heavy").select("node", "heavy")
    moved = steps.join(light, "node").select("wid", (F.col("i") - 1).cast("int").alias("at"), "heavy")
    ends = words.where(F.col("depth") == F.length("word")).select("wid", F.length("word").alias("at"), node(F.col("word")).alias("up"))
    return moved.unionByName(ends.join(heavy, "up").select("wid", "at", "heavy"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words one inserted, deleted or replaced code point apart, once in each direction.

    ``words`` has distinct word and n.
    """
    bound_batches(words.sparkSession)
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id())
    ordered = cut(ordered.select("wid", "word", "n").mapInArrow(_depths, "wid long, word string, n long, depth int"))
    moves = cut(light_moves(ordered).join(ordered.select("wid", "word", "n"), "wid"))
    ahead, rest = F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, F.length("word"))
    char, tail = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring(F.col("word"), F.col("at") + 2, F.length("word"))
    inside = F.col("at") < F.length("word")
    # The character is skipped unless the next is the same: the pair then parts one node further down.
    skip = F.when(inside & ~tail.startswith(char), F.concat(ahead, tail))
    spelt = F.array(F.when(inside, F.concat(ahead, F.col("heavy"), tail)), skip, F.concat(ahead, F.col("heavy"), rest))
    found = moves.select("word", "n", F.explode(F.array_compact(spelt)).alias("other"))
    pairs = found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # Light children of one node that agree behind the mark.
    marked = moves.where(inside).select(F.concat(ahead, F.lit(MARK), tail).alias("key"), F.struct("word", "n").alias("m"))
    marked = marked.groupBy("key").agg(F.collect_list("m").alias("all")).where(F.size("all") > 1)  # an alphabet at most
    marked = marked.select(F.explode("all").alias("m"), "all").select("m.word", "m.n", F.explode("all").alias("o")).where("word <> o.word")
    return pairs.unionByName(marked.select("word", "n", F.col("o.word").alias("other"), F.col("o.n").alias("other_n")))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: a form is the most frequent near word, if it is ``ratio`` times as frequent."""
    near = near_pairs(words)
    # The smallest word of the largest n: Spark keeps one row a key and task before the shuffle.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))
    out = words.join(best, "word", "left")
    enough = F.col("other_n") >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("other_n")).alias("form_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root: the root is the last of the forms that follow one another.

    Each form is ``ratio`` times as frequent as the one before, so chains end, and pointers that double reach the end in a
    number of rounds that is the logarithm of the longest chain.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 lets forms go round")
    found = cut(forms(words, ratio))
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(links.join(onward, "root", "left"))
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next is not null").isEmpty():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of ``documents``."""
    words = cut(counts(table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: By another way: the polynomial's table and one step a byte for crc32, marks at every character for near words.
ORACLE = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
dealt AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM dealt, tab),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN w y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN w y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, f.form, CASE WHEN f.form IS NOT NULL THEN b.top END AS form_n
  FROM w LEFT JOIN best b USING (word)
  LEFT JOIN (SELECT p.word, min(p.other) AS form FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.top JOIN w ON w.word = p.word WHERE b.top >= 10 * w.n GROUP BY p.word) f USING (word)),
walk(word, root) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL)
SELECT form.word, form.form, walk.root, form.n, form.n_near, form.form_n
FROM form JOIN walk USING (word) JOIN form fin ON walk.root = fin.word AND fin.form IS NULL
"""
