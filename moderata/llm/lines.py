"""Line dedup by a segment-partition edit join (operator 1), DataFrame functions only.

A line (between line feeds, trimmed of ASCII white space) is dropped where an
earlier line equals it or lies within ``tau`` edits of it. "Earlier" follows
(doc_id, text hash, line number). Near matches are looked for between lines of
``MIN_CHARS`` characters or more; shorter lines are compared exactly. ``tau``
None stands for ``BANDS``: the number of edits grows with the length of the
shorter line; a number holds for lines of any length. op1_line_dedup takes one
edit, as its SQL does; the pipeline's stage takes the bands.

The join follows the pigeonhole principle: a line is cut into tau + 1 segments,
and a line within tau edits holds one of them unchanged. The segments have one
size and fixed places per length class (``CLASSES``); each line puts them into
an index keyed by (class, segment number, segment), and probes the indexes of
its own and, if it is at most tau longer, the next lower class with the
substrings that a segment can have moved to: (i, move) with
max(-i, i - tau) <= move <= i. Some segment i is whole and has exactly i edits
before it, hence moves at most i, and at most tau - i after it. Candidates are
verified by a banded edit distance.

The dedup asks only whether an earlier line is near. Lines of keys that ``FEW``
or more different lines share are not paired: each looks for an earlier line in
a semi-join, which ends at the first it finds and returns lines, not pairs; two
lines are compared under one of the keys they share. What comes out grows with
the lines, while a line that nothing is near to is still compared with every
earlier line of its keys that sizes and letters do not rule out.

``classes`` needs all links. There, keys that many lines share are found on a
sample of the lines (the sample only chooses the way, not the result) and are
refined: the segment is cut out and the rest, which may hold tau edits as well,
is partitioned again, so that lines must agree on more of their text to meet.

Scale. Equal lines are one line to the join, and one narrow row per occurrence
is aggregated by a 128-bit hash (the join itself knows a line by 64 bits). Texts
are shuffled only where a bitmap of bounded size (``WORDS``), sent to every
task, cannot rule it out: lines that occur again, lines of candidate pairs,
documents with a dropped line; an exact join or grouping follows, so a bit that
two keys share costs time only. Signature rows hold two longs, a size and a
flag, never text. They are made from the distinct lines inside the job that joins them, a
part of the segment numbers at a time (``PARTS`` jobs), and never stored; their
shuffle files go when a job ends. No candidate is dropped and nothing is
collected. Narrow intermediate tables are written to the shared checkpoint
folder, which keeps each plan small and cuts the lineage.

Defined cases: a null text stays null with 0 lines; blank lines are always
kept and not counted; null ids come last in the order; rows that repeat both id
and text are one document for the order and get the same result; other columns,
whatever their names, pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .minhash import merged

TAU = 1
MIN_CHARS = 16
SAMPLE = 32         # one line in 32 takes part in finding busy keys
BUSY = 8            # sampled lines that make a key busy (about 256 lines)
#: (length of the shorter line from which it holds, edits), and the starts of the length classes
BANDS = ((16, 1), (32, 2), (64, 4), (100, 7))
CLASSES = (16, 24, 32, 48, 64, 80, 100, 144, 208, 304, 448, 672, 1024, 2048, 4096)
LEVELS = {1: 3, 2: 2}   # refinements of busy keys by edits; one beyond
PARTS = 4           # jobs that the signatures are dealt over, by segment number
FEW = 16            # lines of a key that are paired at once
CROWD = 256         # lines of a key that one task compares with the key's other lines
MOST = 64           # tasks that a key's lines are dealt over at most
WORDS = 1 << 20     # words of 64 bits in a bitmap of keys
SHARES = 16         # tasks that a larger key's lines are dealt over where all its links are asked for
_BLANK = " \t\u000b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within(pattern: Column, text: Column, tau: int) -> Column:
    """True if the edit distance of two strings is at most ``tau`` (only a band of 2 tau + 1 diagonals is computed)."""
    return F.levenshtein(pattern, text, tau) >= 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (the document's key and place in the order), t (its text) and all columns in one cell."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2 ** 63 - 1)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("k2"), F.col(f"`{text_col}`").alias("t"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("cell"))


def _lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(text: Column) -> Column:
    return F.transform(_lines_of(text), lambda x: F.trim(x, F.lit(_BLANK)))


def _letters(line: Column) -> Column:
    """How often some frequent letters stand in a line: what lies far apart here needs no edit distance."""
    size = F.char_length(line)
    return F.array(*[(size - F.char_length(F.translate(line, c, ""))).cast("int") for c in "etaoinsrhldu "])


def _codes(letters: Column) -> Column:
    """``letters`` in two longs, eight bits a count: two counts differ by at least as many as their bits do."""
    ring = F.array(*[F.lit((1 << n) - 1 if n <= 8 else 255 ^ (1 << n - 8) - 1) for n in range(16)]).cast("array<long>")
    bits = F.transform(letters, lambda n: F.element_at(ring, n % 16 + 1))
    return F.array(*[F.aggregate(F.slice(bits, at, 8), F.lit(0).cast("long"), lambda x, y: F.shiftleft(x, 8).bitwiseOR(y)) for at in (1, 9)])


def _bitmap(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """(word, bits) of the low bits of 64-bit keys: ``WORDS`` rows at most, whatever the number of keys."""
    return written(keys.select(key.bitwiseAND(64 * WORDS - 1).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
                   .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")), name)


def _maybe(rows: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: false only where the key is none of the bitmap's."""
    told = rows.withColumn("at", key.bitwiseAND(64 * WORDS - 1)).withColumn("word", F.shiftright("at", 6))
    return told.join(F.broadcast(bitmap), "word", "left").withColumn("hit", F.coalesce(F.expr(
        "shiftright(bits, cast(at % 64 as int)) & 1 = 1"), F.lit(False))).drop("at", "word", "bits")


def _bands(tau: int | None) -> tuple:
    return BANDS if tau is None else ((MIN_CHARS, tau),)


def _edits(size: Column, bands: tuple) -> Column:
    """The edits that ``bands`` allow for a shorter line of ``size`` characters."""
    out = F.lit(0)
    for low, tau in bands:
        out = F.when(size >= low, F.lit(tau)).otherwise(out)
    return out


def _cuts(bands: tuple, key: Column, rest: Column, low: Column, tau: Column, probe: bool, own: bool, keep_rest: bool,
          part: int | None = None) -> Column:
    """Signatures of a string in the length class from ``low`` on: its segments, or its probes (``own``: unmoved ones too)."""
    span = F.floor(low / (tau + 1)).cast("int")
    places = F.lit(None)
    for t in sorted({t for _, t in bands}):
        moves = [(i, m) for i in range(t + 1) if part is None or i % PARTS == part
                 for m in (range(max(-i, i - t), i + 1) if probe else [0])]
        moves = [F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in moves if own or m or not probe]
        moves = (F.array(*moves) if moves else F.array()).cast("array<struct<i:int,m:int>>")
        places = F.when(tau == t, moves) if t == bands[0][1] else places.when(tau == t, moves)

    def cut(place):
        at = place["i"] * span + place["m"]
        cells = [F.xxhash64(key, place["i"], F.substring(rest, at + 1, span)).alias("key"), F.lit(probe).alias("probe")]
        if keep_rest:
            cells.append(F.concat(F.substring(rest, F.lit(1), at), F.substring(rest, at + span + 1, F.char_length(rest))).alias("rest"))
        return F.struct(*cells)
    return F.transform(places, cut)


def _classed(size: Column, bands: tuple) -> Column:
    """(low, tau, own) of the length classes that a line is indexed in (own) or only probes."""
    out = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 2 ** 31 - 100)):
        tau = max(t for start, t in bands if start <= low)
        out.append(F.when((size >= low) & (size < high + tau), F.struct(
            F.lit(low).alias("low"), F.lit(tau).alias("tau"), (size < high).alias("own"))))
    return F.array_compact(F.array(*out))


def _index(lines: DataFrame, bands: tuple, part: int | None = None) -> DataFrame:
    """(key, id, size, probe) of each line's own segments; ``lines``: id, line, size, one row a line."""
    marks = _cuts(bands, F.col("c.low"), F.col("line"), F.col("c.low"), F.col("c.tau"), False, True, False, part)
    return (lines.select("id", "line", "size", F.explode(_classed(F.col("size"), bands)).alias("c")).where("c.own")
            .select("id", "size", F.explode(marks).alias("e")).select("e.key", "id", "size", "e.probe"))


def _signatures(lines: DataFrame, bands: tuple, part: int | None = None) -> DataFrame:
    """(key, id, size, probe) of each line's segments and probes; a line's own segment serves as its unmoved probe."""
    cells = [bands, F.col("c.low"), F.col("line"), F.col("c.low"), F.col("c.tau")]
    marks = F.when(F.col("c.own"), F.concat(_cuts(*cells, False, True, False, part), _cuts(*cells, True, False, False, part))
                   ).otherwise(_cuts(*cells, True, True, False, part))
    return (lines.select("id", "line", "size", F.explode(_classed(F.col("size"), bands)).alias("c"))
            .select("id", "size", F.explode(marks).alias("e")).select("e.key", "id", "size", "e.probe"))


def _refined(rows: DataFrame, bands: tuple, probe: bool) -> DataFrame:
    """(key, id, size, probe) of busy keys' lines, the text beside the shared segment cut again; ``rows``: key, id, size, line."""
    cells = [bands, F.col("key"), F.col("rest"), F.col("low"), F.col("tau")]
    found = (rows.withColumn("c", F.explode(_classed(F.col("size"), bands))).where("c.own" if not probe else "true")
             .select("id", "size", "key", "c.low", "c.tau", F.explode(_cuts(
                 bands, F.col("c.low"), F.col("line"), F.col("c.low"), F.col("c.tau"), probe, True, True)).alias("e"))
             .where("e.key = key").select("id", "size", "key", "e.rest", "low", "tau"))
    less = F.col("low") - F.floor(F.col("low") / (F.col("tau") + 1)).cast("int")
    levels = {t: LEVELS.get(t, 1) for _, t in bands}
    for level in range(max(levels.values())):
        go = F.lit(False)
        for t, most in levels.items():
            go = go | ((F.col("tau") == t) & F.lit(most > level))
        found = found.withColumn("low", F.when(go, less).otherwise(F.col("low")))
        same = F.array(F.struct("key", F.lit(probe).alias("probe"), "rest"))
        found = (found.select("id", "size", "low", "tau", F.explode(F.when(go, _cuts(*cells, probe, True, True)).otherwise(same))
                              .alias("e")).select("id", "size", "e.key", "e.rest", "low", "tau"))
    return found.select("key", "id", "size", F.lit(probe).alias("probe"))


def _met(index: DataFrame, marks: DataFrame, bands: tuple) -> DataFrame:
    """Pairs (a < b) of lines that meet under a key and whose sizes allow it."""
    index = index.select("key", F.col("id").alias("i"), F.col("size").alias("si"))
    other = marks.select("key", F.col("id").alias("o"), F.col("size").alias("so"), "probe")
    fits = F.expr("i < o or probe and i > o") & (F.abs(F.col("si") - F.col("so")) <= _edits(F.least("si", "so"), bands))
    return (index.hint("shuffle_hash").join(other, "key").where(fits)
            .select(F.least("i", "o").alias("a"), F.greatest("i", "o").alias("b")).distinct())


def _within_band(a: Column, b: Column, tau: Column, bands: tuple) -> Column:
    """True if two strings lie within ``tau``, one of the edits of ``bands``."""
    test = F.lit(False)
    for t in sorted({t for _, t in bands}):
        test = F.when(tau == t, within(a, b, t)).otherwise(test)
    return test


def _apart(a: Column, b: Column) -> Column:
    """How far two ``letters`` lie apart; an edit changes at most two counts by one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x)


def _near(pairs: DataFrame, told: DataFrame, bands: tuple) -> DataFrame:
    """The pairs (a, b) within the edits of their band; ``told``: id, line, size, letters."""
    names = ("id", "line", "size", "letters")
    left, right = (told.select(*[F.col(c).alias(side if c == "id" else c + side) for c in names]) for side in "ab")
    tau = _edits(F.least("sizea", "sizeb"), bands)
    near = (pairs.join(left, "a").join(right, "b").where(_apart(F.col("lettersa"), F.col("lettersb")) <= 2 * tau)
            .withColumn("tau", tau))
    return near.where(_within_band(F.col("linea"), F.col("lineb"), F.col("tau"), bands)).select("a", "b").distinct()


def _dealt(index: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of large keys, each key's lines dealt over ``SHARES`` tasks."""
    def key(share):
        return F.xxhash64("key", share).alias("key")
    part = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")
    return (index.select(key(part), "id", "size", "probe"),
            marks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).select(
                key(F.col("share")), "id", "size", "probe"))


def _candidates(lines: DataFrame, bands: tuple, sample: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that meet under calm keys, (key, id, size, probe) of busy keys, and texts and letters of all their lines."""
    some = lines.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0)
    busy = written(_index(some, bands).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("key"), "busy")
    found = None
    for part in range(min(PARTS, max(t for _, t in bands) + 1)):
        calm = [marks.join(busy, "key", "left_anti") for marks in (_index(lines, bands, part), _signatures(lines, bands, part))]
        met = written(_met(*calm, bands), "pairs")
        found = met if found is None else found.union(met)
    many = written(_signatures(lines, bands).join(busy, "key", "left_semi"), "many")
    needed = found.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct()
    needed = written(needed, "needed")
    likely = _maybe(lines, F.col("id"), _bitmap(needed, F.col("id"), "bits")).where("hit").drop("hit")
    known = written(likely.join(needed, "id", "left_semi").withColumn("letters", _letters(F.col("line"))), "known")
    return found, many, known


def _links(lines: DataFrame, bands: tuple) -> DataFrame:
    """All links (a, b)."""
    found, many, known = _candidates(lines, bands, SAMPLE, BUSY)
    texts = known.select("id", "line")
    refined = written(_refined(many.where("not probe").join(texts, "id"), bands, False).union(
        _refined(many.select("key", "id", "size").distinct().join(texts, "id"), bands, True)).distinct(), "refined")
    large = refined.groupBy("key").agg(F.countDistinct("id").alias("c")).where(F.col("c") > FEW).select("key")
    small = refined.join(large, "key", "left_anti")
    big = written(refined.join(large, "key", "left_semi"), "hot")
    found = found.union(_met(small.where("not probe"), small, bands)).union(_met(*_dealt(big.where("not probe"), big), bands))
    return _near(written(found.distinct(), "pairs"), known, bands)


def _later(lines: DataFrame, firsts: DataFrame, bands: tuple) -> DataFrame:
    """The ids of the lines that an earlier line is near to.

    Lines of busy keys look for one such line in a semi-join, which makes no
    pairs; two lines are compared once, under the shared key that comes first
    in an order of the later line's own, which spreads a group over its keys.
    """
    found, many, known = _candidates(lines, bands, 1, FEW)
    place = firsts.groupBy("id").agg(F.min(F.struct("k1", "k2", "pos")).alias("place"))
    links = written(_near(written(found.distinct(), "pairs"), known, bands), "links")
    ends = links.join(place.toDF("a", "pa"), "a").join(place.toDF("b", "pb"), "b")
    told = written(ends.select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct(), "later")
    rows = many.select("key", "id").distinct()
    keys = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
    shares = rows.groupBy("key").agg(F.least(F.lit(MOST), F.ceil(F.count(F.lit(1)) / CROWD)).cast("int").alias("shares"))
    full = (rows.join(shares, "key").join(keys, "id").join(known, "id").join(place, "id")
            .withColumn("codes", _codes(F.col("letters"))).withColumn("x", F.col("codes")[0]).withColumn("y", F.col("codes")[1]))
    names = ("size", "line", "x", "y", "place")
    late = (full.join(told, "id", "left_anti").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
            .select("key", "share", "id", *names, F.filter("keys", lambda k: F.xxhash64(k, "id") < F.xxhash64("key", "id")).alias("before")))
    early = full.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(
        "key", "share", *[F.col(c).alias(c + "_e") for c in names], "keys")
    tau = _edits(F.least("size", "size_e"), bands)
    near = F.when((F.col("place_e") < F.col("place")) & (F.abs(F.col("size") - F.col("size_e")) <= tau)
                  & (F.expr("bit_count(x ^ x_e) + bit_count(y ^ y_e)") <= 2 * tau) & ~F.arrays_overlap("before", "keys"),
                  _within_band(F.col("line"), F.col("line_e"), tau, bands)).otherwise(False)
    late, early = late.alias("l"), early.hint("merge").alias("e")
    more = late.join(early, (F.col("l.key") == F.col("e.key")) & (F.col("l.share") == F.col("e.share")) & near, "left_semi")
    return told.union(more.select("id")).distinct()


def line_links(docs: DataFrame, tau: int | None = TAU, id_col: str = "doc_id", text_col: str = "text", every: bool = False):
    """The tables behind the dedup: keyed documents, occurrences, first occurrences, links, a bitmap of lines that occur again.

    ``every`` asks for all links between different lines: their number grows with
    the square of a group of lines that are all near each other. Without it the
    links are not made: the table holds the ids of lines near an earlier one.
    """
    keyed = _keyed(docs, id_col, text_col)
    # sizes travel with the lines: counting characters anew for every segment would cost most of the time
    told = written(keyed.select("k1", "k2", F.posexplode(_trimmed(F.col("t"))).alias("pos", "line")).where("line <> ''").select(
        F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), "k1", "k2", "pos", "line",
        F.char_length("line").cast("int").alias("size")), "told")
    occ = told.select("id", "id2", "k1", "k2", "pos")
    firsts = written(occ.groupBy("id", "id2").agg(F.min(F.struct("k1", "k2", "pos")).alias("f"), F.count(F.lit(1)).alias("n"))
                     .select("id", "id2", "f.*", "n"), "firsts")
    again = _bitmap(firsts.where("n > 1"), F.col("id"), "again")
    lines = _maybe(told.where(F.col("size") >= MIN_CHARS).select("id", "line", "size"), F.col("id"), again)
    twice = written(lines.where("hit").drop("hit").dropDuplicates(["id"]), "twice")
    lines = lines.where("not hit").select("id", "line", "size").union(twice.select("id", "line", "size"))
    return keyed, occ, firsts, written(
        _links(lines, _bands(tau)) if every else _later(lines, firsts, _bands(tau)), "links"), again


def dedup_lines(docs: DataFrame, tau: int | None = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """t, cell (all columns) and marks: per dropped line its number and why it goes."""
    keyed, occ, firsts, later, twice = line_links(docs, tau, id_col, text_col)
    near = firsts.join(later, "id").select("k1", "k2", "pos", F.lit(True).alias("near"))
    again = (_maybe(occ, F.col("id"), twice).where("hit")
             .join(firsts.where("n > 1").select("id", "id2", F.struct("k1", "k2", "pos").alias("f")), ["id", "id2"])
             .where(F.struct("k1", "k2", "pos") != F.col("f")).select("k1", "k2", "pos"))
    marks = (near.select("k1", "k2", F.struct("pos", F.lit(False).alias("exact"), "near").alias("m"))
             .union(again.distinct().select("k1", "k2", F.struct("pos", F.lit(True).alias("exact"), F.lit(False).alias("near")).alias("m")))
             .groupBy("k1", "k2").agg(F.collect_list("m").alias("marks")))
    marks = written(marks, "marks")
    key, none = F.xxhash64("k1", "k2"), F.array().cast("array<struct<pos:int,exact:boolean,near:boolean>>")
    rows = _maybe(keyed.select("k1", "k2", "cell"), key, _bitmap(marks, key, "bits"))
    hit = rows.where("hit").join(marks, ["k1", "k2"], "left").select("cell", F.coalesce("marks", none).alias("marks"))
    rows = hit.union(rows.where("not hit").select("cell", none.alias("marks")))
    return rows.select(F.col("cell").getField(text_col).alias("t"), "cell", "marks")


def _kept_text(text: Column) -> Column:
    gone = F.transform(F.filter("marks", lambda m: m["exact"] | m["near"]), lambda m: m["pos"])
    lines = _lines_of(text)
    return F.when(F.size(gone) == 0, text).otherwise(let(gone, lambda g: F.array_join(
        F.filter(lines, lambda x, k: ~F.array_contains(g, k)), "\n")))


def report(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per document row: lines, dropped lines, and the digest of the kept text."""
    text = F.col("t")
    count = F.size(F.filter(_lines_of(text), lambda x: F.trim(x, F.lit(_BLANK)) != ""))
    return dedup_lines(docs, tau).select(
        F.col("cell.doc_id").alias("doc_id"),
        F.when(text.isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.size(F.filter("marks", lambda m: m["exact"])).cast("long").alias("n_exact"),
        F.size(F.filter("marks", lambda m: m["near"])).cast("long").alias("n_near"),
        F.sha2(_kept_text(text), 256).alias("kept_sha256"))


def classes(docs: DataFrame, tau: int | None = TAU) -> DataFrame:
    """One row per document row: its lines (not blank) with their classes, repeated lines included.

    A class is a component of the links; its id is the document and the line
    number (from 0) of its earliest line. ``class_links`` counts the links of
    the class, all pairs of different lines within ``tau`` edits. Defined cases: a null id stays null; a text
    without a line, or null, gets an empty list; rows that repeat id and text get
    the same lines; an empty table gives an empty table; of the other columns,
    whatever their names, none is returned.
    """
    keyed, occ, firsts, links, _ = line_links(docs, tau, every=True)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = merged(ends.select("id", F.col("id").alias("comp")), links)
    first = firsts.join(nodes, "id").groupBy("comp").agg(F.min(F.struct("k1", "k2", "pos")).alias("c"))
    count = links.join(nodes, links["a"] == nodes["id"]).groupBy("comp").agg(F.count(F.lit(1)).alias("class_links"))
    linked = nodes.join(first, "comp").join(count, "comp").select("id", "c", "class_links")
    of_line = written(firsts.join(linked, "id", "left").select(
        "id", "id2", F.coalesce("c", F.struct("k1", "k2", "pos")).alias("c"),
        F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links")), "classes")
    cell = F.struct(F.col("pos").alias("line"), F.nullif("c.k1", F.lit(2 ** 63 - 1)).alias("class_doc_id"),
                    F.col("c.pos").alias("class_line"), "class_links")
    told = (occ.distinct().join(of_line, ["id", "id2"]).select("k1", "k2", cell.alias("x"))
            .groupBy("k1", "k2").agg(F.sort_array(F.collect_list("x")).alias("lines")))
    return keyed.join(told, ["k1", "k2"], "left").select(
        F.col("cell.doc_id").alias("doc_id"), F.coalesce("lines", F.array().cast(told.schema["lines"].dataType)).alias("lines"))


def drop_lines(docs: DataFrame, tau: int | None = None) -> DataFrame:
    """The rows of ``docs`` with their kept lines; rows that lose their last line go.

    ``n_chars``, where present, becomes the length of the kept text.
    """
    found = dedup_lines(docs, tau)
    kept = found.withColumn("kept", _kept_text(F.col("t")))
    had = F.size("marks") > 0
    kept = kept.where(~had | F.col("t").isNull() | F.col("kept").rlike(r"[^\s]"))
    out = []
    for c in docs.columns:
        col = F.col("cell").getField(c)
        if c == "text":
            col = F.col("kept")
        elif c == "n_chars":
            col = F.char_length("kept").cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return kept.select(*out)


def _plain_links(rows: list[tuple[int, str | None]], tau: int | None) -> tuple[dict, dict]:
    """Plain version for tests: each line's first place and its near lines."""
    def distance(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) > most:
                break
        return min(row) if min(row) > most else row[-1]

    def edits(a, b):
        return max(t for low, t in _bands(tau) if low <= min(len(a), len(b)))
    first = {}
    for i, t in sorted((i, t) for i, t in rows if t is not None):
        for k, line in enumerate(t.split("\n")):
            if line.strip(_BLANK):
                first.setdefault(line.strip(_BLANK), (i, k))
    linked, by_length = {t: [] for t in first}, {}
    for t in first:
        if len(t) >= MIN_CHARS:
            reach = _bands(tau)[-1][1]
            for n in range(len(t) - reach, len(t) + reach + 1):
                for u in by_length.get(n, []):
                    if distance(t, u, edits(t, u)) <= edits(t, u):
                        linked[t].append(u)
                        linked[u].append(t)
            by_length.setdefault(len(t), []).append(t)
    return first, linked


def brute_force(rows: list[tuple[int, str | None]], tau: int | None = None) -> dict[int, tuple]:
    """Plain version for tests: id -> (n_lines, n_exact, n_near, kept text); ids must differ."""
    first, linked = _plain_links(rows, tau)
    out = {}
    for i, t in rows:
        n = exact = near = 0
        kept = []
        for k, raw in enumerate([] if t is None else t.split("\n")):
            line = raw.strip(_BLANK)
            n += bool(line)
            if line and first[line] != (i, k):
                exact += 1
            elif line and any(first[u] < (i, k) for u in linked[line]):
                near += 1
            else:
                kept.append(raw)
        out[i] = (n, exact, near, None if t is None else "\n".join(kept))
    return out


def brute_classes(rows: list[tuple[int, str | None]], tau: int | None = None) -> dict[int, list]:
    """Plain version for tests: id -> (line number, class document, class line) of each line; ids must differ."""
    first, linked = _plain_links(rows, tau)
    of = {}
    for line in sorted(first, key=first.get):
        todo = [] if line in of else [line]
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = first[line]
                todo += linked[x]
    return {i: [(k, *of[x.strip(_BLANK)]) for k, x in enumerate((t or "").split("\n")) if x.strip(_BLANK)] for i, t in rows}


def oracle_sql() -> str:
    """``report`` for one edit in DuckDB SQL: lines that share half their characters, then ``levenshtein``."""
    return rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
f AS (SELECT line, min((doc_id, pos)) AS f, length(line) AS n FROM t WHERE line <> '' GROUP BY line),
c AS (SELECT a.line AS a, b.line AS b, a.f AS fa, b.f AS fb FROM f a JOIN f b
    ON b.n = a.n AND substr(a.line, 1, a.n // 2) = substr(b.line, 1, b.n // 2) WHERE a.n >= {MIN_CHARS} AND a.line < b.line
  UNION SELECT a.line, b.line, a.f, b.f FROM f a JOIN f b
    ON b.n = a.n AND substr(a.line, a.n // 2 + 1) = substr(b.line, b.n // 2 + 1) WHERE a.n >= {MIN_CHARS} AND a.line < b.line
  UNION SELECT a.line, b.line, a.f, b.f FROM f a JOIN f b
    ON b.n = a.n + 1 AND substr(a.line, 1, a.n // 2) = substr(b.line, 1, (b.n - 1) // 2) WHERE a.n >= {MIN_CHARS}
  UNION SELECT a.line, b.line, a.f, b.f FROM f a JOIN f b
    ON b.n = a.n + 1 AND substr(a.line, a.n // 2 + 1) = substr(b.line, (b.n - 1) // 2 + 2) WHERE a.n >= {MIN_CHARS}),
k AS (SELECT * FROM c WHERE levenshtein(a, b) <= {TAU}),
both_ways AS (SELECT a AS line, fa AS f, fb AS g FROM k UNION ALL SELECT b, fb, fa FROM k),
near AS (SELECT line, bool_or(g < f) AS near FROM both_ways GROUP BY line),
m AS (SELECT t.*, line <> '' AND (doc_id, pos) <> f.f AS exact,
    (doc_id, pos) = f.f AND COALESCE(near, false) AS near
  FROM t LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
d AS (SELECT doc_id, count_if(line <> '') AS n_lines, count_if(exact) AS n_exact, count_if(near) AS n_near,
    COALESCE(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT COALESCE(exact, false) AND NOT COALESCE(near, false)), '') AS kept
  FROM m GROUP BY doc_id)
SELECT doc_id, COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_exact, 0)::BIGINT AS n_exact,
  COALESCE(n_near, 0)::BIGINT AS n_near,
  CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id)"""
