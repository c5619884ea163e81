"""Spelling variants by a dictionary of trie-node pairs (operator 11).

Words that differ by exactly one inserted, deleted or replaced code point are
near. Every distinct beginning of a word is a node of the forward trie, every
distinct ending one of the reversed trie, and nodes are numbered. Cutting a word
at a place gives a pair of integers (node of the beginning, node of the ending):

* leaving the character at the cut out gives a "skip" pair,
* leaving nothing out gives an "insert" pair, which names the word itself.

Two words with a common skip pair differ by a replacement there; a skip pair
equal to another word's insert pair means that the word with one more
character there is near. The pairs are equal if and only if the strings are, so
the join is exact. A word skips within a stretch of equal characters at the first of
them only when it meets insert pairs, so every near pair meets at exactly one place.

Numbering. The sorted words are dealt by range; each task walks its words in
order, keeps the path of nodes that a word shares with the one before, and
numbers the others (task number and a counter). Where a task's first word continues the
last word of the task before, the shared nodes take the earlier numbers: two words per
task reach the driver for that. A word's own node numbers follow the words' order.

Scale. Words are counted with map-side aggregation, so the hottest word costs one row
a task. The dictionary has 2 length + 1 pairs a word, as integers; strings of
all beginnings are never made. A skip pair is shared by at most one word per
character of the alphabet ``[a-z\\u00C0-\\u00FF]`` (90), whatever the table, and no
pair of words is ever a row: each group of a dictionary entry tells its words
their number of partners and their best one. Forms multiply n by 10 at least, so
roots are reached in ``JUMPS`` pointer jumps.

Defined cases: null and empty texts have no words; a null id counts as empty
text in the hash that decides which occurrences lose a character; repeated
rows count as often as they come; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

MIN_LENGTH, MIN_COUNT = 7, 2
FORM_FACTOR = 10
LOSE_ONE_IN = 31
JUMPS = 5          # 2^5 > 18 steps, by which n would pass 2^63
COUNTER_BITS = 40  # nodes of one task
RUN = r"[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts, after the occurrences hit by the hash lost a character."""
    # shorter runs cannot become words: deleting only shortens them
    long_runs = RUN[:-1] + "{%d,}" % MIN_LENGTH
    word = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(long_runs), 0))
    runs = (docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), word.alias("run"))
            .select("id", lower_ascii(F.col("run")).alias("run")))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return (runs.withColumn("h", h).select(F.when(F.col("h") % LOSE_ONE_IN == 0, less).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= MIN_COUNT))


def _shared(a: str, b: str) -> int:
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def _walk(batches):
    """Number the trie nodes of a task's sorted words: key, part and the word's path of nodes."""
    part = TaskContext.get().partitionId()
    base, used, last, path = part << COUNTER_BITS, 0, "", []
    for batch in batches:
        words = batch.column(1).to_pylist()
        flat, ends = [], [0]
        for word in words:
            path = path[:_shared(last, word)]
            fresh = len(word) - len(path)
            path = path + list(range(base + used + 1, base + used + fresh + 1))
            used, last = used + fresh, word
            flat += path
            ends.append(len(flat))
        paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([part] * len(words), pa.int32()), paths], ["key", "word", "part", "path"])


def numbered(words: DataFrame, name: str) -> DataFrame:
    """key, word, path: the trie nodes of every beginning of ``word``, numbered alike in all rows."""
    spark = words.sparkSession
    local = written(words.repartitionByRange("word").sortWithinPartitions("word")
                    .mapInArrow(_walk, f"key {words.schema['key'].dataType.simpleString()}, word string, part int, path array<long>"), name)
    ends = (local.groupBy("part").agg(F.min("word").alias("first"), F.max(F.struct("word", "path")).alias("last"))
            .orderBy("part").collect())  # two words a task
    mask, alias, before, before_path = (1 << COUNTER_BITS) - 1, [], "", []
    for e in ends:
        own = before_path[:_shared(before, e["first"])]
        if own:
            alias.append((e["part"], own))
        before = e["last"]["word"]
        before_path = [own[(v & mask) - 1] if (v & mask) <= len(own) else v for v in e["last"]["path"]]
    if not alias:
        return local.select("key", "word", "path")
    # the first word's path has the numbers 1, 2, ...: those that it shares are replaced
    table = spark.createDataFrame(alias, "part int, shared array<long>")
    count = F.lit(mask)
    renamed = F.transform("path", lambda v: F.when(v.bitwiseAND(count) <= F.size("shared"),
                                                   F.element_at("shared", v.bitwiseAND(count).cast("int"))).otherwise(v))
    return (local.join(F.broadcast(table), "part", "left")
            .select("key", "word", F.when(F.col("shared").isNull(), F.col("path")).otherwise(renamed).alias("path")))


def _pairs(f: str, b: str, letters: str) -> Column:
    """All (x, y, kind) of a word: kind 0 skip, 1 skip that meets insert pairs, 2 insert.

    ``f`` and ``b`` start with the roots (node 0); ``b`` runs from the end of the word.
    """
    n = F.size(f) - 1
    again = (lambda i: (i > 1) & (F.element_at(letters, i) == F.element_at(letters, F.greatest(i - 1, F.lit(1)))))
    skips = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at(f, i).alias("x"), F.element_at(b, n - i + 1).alias("y"),
        F.when(again(i), 0).otherwise(1).alias("kind")))
    inserts = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.struct(
        F.element_at(f, i).alias("x"), F.element_at(b, n - i + 2).alias("y"), F.lit(2).alias("kind")))
    return F.concat(skips, inserts)


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, word, n, n_near, best_n, best_id of ``words`` (word, n): best has the largest n, ties the smallest word."""
    from_root = F.concat(F.array(F.lit(0).cast("long")), "path")
    forward = written(numbered(words.select(F.col("n").alias("key"), "word"), "beginnings")
                      .select(F.element_at("path", -1).alias("key"), "word", F.col("key").alias("n"), from_root.alias("f")), "words")
    backward = numbered(forward.select("key", F.reverse("word").alias("word")), "endings").select("key", from_root.alias("b"))
    # arrays are columns of their own, so that no function makes them anew for every place in a word
    entries = (forward.withColumn("letters", F.split("word", "")).join(backward, "key")
               .select("key", "n", F.explode(_pairs("f", "b", "letters")).alias("p"))
               .select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), "key", "n", F.col("p.kind").alias("kind")))
    # one group per dictionary entry: at most one word a character of the alphabet, and one that it names
    groups = (entries.repartition("x", "y").groupBy("x", "y")
              .agg(F.collect_list(F.struct("n", (-F.col("key")).alias("k"), "kind")).alias("m"))
              .where(F.size("m") > 1).select(F.reverse(F.array_sort("m")).alias("m")))
    skips = F.filter("m", lambda e: e.kind < 2)
    meets = F.filter("m", lambda e: e.kind > 0)     # met by the word that the entry names
    named = F.filter("m", lambda e: e.kind == 2)
    told = groups.select(skips.alias("skips"), meets.alias("meets"), named.alias("named"), F.explode("m").alias("own"))
    own_kind = F.col("own.kind")
    partners = F.when(own_kind == 2, F.filter("meets", lambda e: e.kind == 1)).when(
        own_kind == 1, F.reverse(F.array_sort(F.concat(F.filter("skips", lambda e: e.k != F.col("own.k")), "named")))).otherwise(
        F.filter("skips", lambda e: e.k != F.col("own.k")))
    best = (told.select((-F.col("own.k")).alias("key"), partners.alias("p")).where(F.size("p") > 0)
            .select("key", F.size("p").alias("c"), F.element_at("p", 1).alias("b"))
            .groupBy("key").agg(F.sum("c").alias("n_near"), F.max(F.struct(F.col("b.n").alias("n"), F.col("b.k").alias("k"))).alias("b")))
    return (forward.select("key", "word", "n").join(best, "key", "left")
            .select(F.col("key").alias("word_id"), "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.col("b.n").alias("best_n"), (-F.col("b.k")).alias("best_id")))


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of counted words (word, n)."""
    near = written(neighbours(words), "near")
    steps = written(near.where(F.col("best_n") >= FORM_FACTOR * F.col("n"))
                    .select("word_id", F.col("best_id").alias("form_id"), F.col("best_n").alias("form_n")), "steps")
    reach = steps.select("word_id", F.col("form_id").alias("root_id"))
    for _ in range(JUMPS):
        on = reach.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("further"))
        reach = written(reach.join(on, "root_id", "left").select("word_id", F.coalesce("further", "root_id").alias("root_id")), "reach")
    names = near.select(F.col("word_id").alias("form_id"), F.col("word").alias("form"))
    roots = near.select(F.col("word_id").alias("root_id"), F.col("word").alias("root"))
    found = (steps.join(reach, "word_id").join(names, "form_id").join(roots, "root_id")
             .select("word_id", "form", "form_n", "root"))
    return (near.join(found, "word_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n."""
    return grouped(written(word_counts(docs, id_col, text_col), "words"))


def oracle_sql() -> str:
    """The counts, near words, forms and roots in DuckDB SQL; the CRC is computed bit by bit (reflected 0xEDB88320)."""
    return rf"""WITH RECURSIVE runs AS (SELECT COALESCE(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hexed AS (SELECT run, hex(id || ':' || run) AS x FROM runs WHERE length(run) >= {MIN_LENGTH}),
bits AS (SELECT run, list_transform(range(0, 4 * len(x)), lambda i:
  (('0x' || x[2 * (i // 8) + 1:2 * (i // 8) + 2])::BIGINT >> (i % 8)) & 1) AS b FROM hexed),
crc AS (SELECT run, xor(list_reduce([4294967295::BIGINT] || b, lambda c, v:
  xor(c >> 1, CASE WHEN xor(c & 1, v) = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) AS h FROM bits),
made AS (SELECT CASE WHEN h % {LOSE_ONE_IN} = 0 THEN run[:(h % length(run))::INTEGER] || run[(h % length(run))::INTEGER + 2:] ELSE run END AS word FROM crc),
words AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
less AS (SELECT word, i, word[:(i - 1)::INTEGER] || word[(i + 1)::INTEGER:] AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT less.word AS a, words.word AS b FROM less JOIN words ON words.word = less.d),
near AS (SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
ranked AS (SELECT a, b, w.n AS bn, count(*) OVER (PARTITION BY a) AS n_near,
  row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place FROM near JOIN words w ON w.word = b),
told AS (SELECT word, n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= {FORM_FACTOR} * n THEN b END AS form,
  CASE WHEN bn >= {FORM_FACTOR} * n THEN bn END AS form_n FROM words LEFT JOIN ranked ON a = word AND place = 1),
path(word, last) AS (SELECT word, form FROM told WHERE form IS NOT NULL
  UNION ALL SELECT path.word, told.form FROM path JOIN told ON told.word = path.last WHERE told.form IS NOT NULL),
ends AS (SELECT path.word, path.last FROM path JOIN told ON told.word = path.last WHERE told.form IS NULL)
SELECT word, form, COALESCE(ends.last, word) AS root, n, n_near, form_n FROM told LEFT JOIN ends USING (word)"""


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    """Plain version for tests: word -> (form, root, n, n_near, form_n)."""
    import re
    import zlib
    from collections import Counter
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % LOSE_ONE_IN == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= MIN_LENGTH and c >= MIN_COUNT}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))
    partners = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= FORM_FACTOR * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(partners[w]), form[w] and n[form[w]]) for w in n}
