import hashlib
import random

import pytest
from pyspark.sql import functions as F

from moderata.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, n, letters):
    out = list(text)
    for _ in range(n):
        k, kind = r.randrange(len(out) + 1), r.random()
        if kind < 0.35 and out:
            out.pop(k - 1)
        elif kind < 0.7:
            out.insert(k, r.choice(letters))
        elif out:
            out[k - 1] = r.choice(letters)
    return "".join(out)


def test_bit_parallel_distance_equals_plain(spark):
    r = random.Random(3)
    pairs = []
    for _ in range(500):
        a = "".join(r.choice("abé\U0001d518") for _ in range(r.randint(1, 14)))
        pairs.append((a, edited(r, a, r.randint(0, 4), "abé\U0001d518") or "z"))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", *[lines.within(F.col("a"), F.col("b"), t).alias(f"t{t}") for t in (1, 2, 3)]).collect()
    for row in rows:
        for t in (1, 2, 3):
            assert row[f"t{t}"] == (distance(row.a, row.b) <= t)


@pytest.mark.parametrize("tau,busy", [(1, False), (2, True)])
def test_dedup_equals_brute_force(spark, monkeypatch, tau, busy):
    if busy:  # every key goes through the refinement
        monkeypatch.setattr(lines, "BUSY", 1)
        monkeypatch.setattr(lines, "SAMPLE", 1)
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(12, 40))) for _ in range(12)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3]), "abc") for _ in range(r.randint(0, 6))))
            for i in range(50)]
    got = {x.doc_id: x for x in lines.report(spark.createDataFrame(rows, "doc_id long, text string"), tau).collect()}
    for i, (n, exact, near, kept) in lines.brute_force(rows, tau).items():
        x = got[i]
        assert (x.n_lines, x.n_exact, x.n_near) == (n, exact, near)
        assert x.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_odd_rows_and_columns(odd_docs, no_docs):
    out = lines.drop_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert 2 not in by          # its only line stands in document 1
    assert by[3][0].text is None and by[5][0].text == " \t\n \n" and by[4][0].text == ""
    assert by[9][0].text == "one line\nanother line of some length"
    assert 12 not in by and by[11][0].text == "two words" and None in by
    assert by[1][0].k1 == "k1" and by[1][0].cell == "cell"
    assert lines.drop_lines(no_docs).count() == 0


@pytest.mark.parametrize("busy", [False, True])
def test_bands_equal_brute_force(spark, monkeypatch, busy):
    """Edits grow with length: lines with a word replaced go, also where every key is refined and large."""
    if busy:
        for name, value in (("BUSY", 1), ("SAMPLE", 1), ("FEW", 2)):
            monkeypatch.setattr(lines, name, value)
    r = random.Random(8)
    words = ["the", "erble", "and", "ones", "of", "that", "moruf", "salin", "ta", "vo", "quenda"]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (4, 6, 7, 10, 14, 20, 22, 28, 31, 45, 70)]
    rows = []
    for i in range(36):
        told = []
        for _ in range(r.randint(1, 5)):
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(words)
            told.append(edited(r, " ".join(w), r.choice([0, 0, 1, 3, 5]), "ab "))
        rows.append((i, "\n".join(told)))
    rows += [(50, "a" * 40 + " that erble " + "b" * 60), (51, "a" * 40 + " the erble " + "b" * 60)]
    plain = lines.brute_force(rows)
    got = {x.doc_id: x.text for x in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for i, (n, e, near, t) in plain.items() if not (e + near) or t.strip()}
    told = {x.doc_id: [tuple(v)[:3] for v in x.lines]
            for x in lines.classes(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert told == lines.brute_classes(rows)
    assert 51 not in got and sum(x[2] for x in plain.values()) > sum(x[2] for x in lines.brute_force(rows, 1).values()) + 10


def test_classes_of_odd_rows_and_columns(odd_docs, no_docs):
    out = lines.classes(odd_docs)
    assert out.columns == ["doc_id", "lines"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {None} <= {x.doc_id for x in rows}
    by = {x.doc_id: [tuple(v)[:3] for v in x.lines] for x in rows}
    assert by[3] == by[4] == by[5] == [] and by[1] and by[2][0][1] == 1
    assert lines.classes(no_docs).count() == 0


def test_large_group_of_near_lines_needs_few_pairs(spark, monkeypatch):
    """Lines one edit from a common one meet its centre, not each other."""
    for name, value in (("BUSY", 2), ("SAMPLE", 1)):
        monkeypatch.setattr(lines, name, value)
    base = "the committee met on tuesday and heard the report of the treasurer on the harbour"
    rows = [(i, base[:k] + "#" + base[k + 1:]) for i, k in enumerate(range(0, len(base)), 1)] + [(0, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.line_links(docs, None)[3].count() < 12 * len(rows)
    assert {x.doc_id for x in lines.drop_lines(docs).collect()} == {0}
    told = {x.doc_id: [tuple(v)[:3] for v in x.lines] for x in lines.classes(docs, None).collect()}
    assert told == lines.brute_classes(rows)


def test_classes_tie_repeats_and_near_lines(spark):
    """Copies of a linked line have its class and link count; a chain of links is one class."""
    x = "a line of some length here"
    rows = [(1, "short\n" + x), (2, x + "s\n\nshort"), (3, x), (4, x + "st\nanother line, quite apart"), (5, None), (6, x)]
    got = {r.doc_id: [tuple(v) for v in r.lines]
           for r in lines.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 1, 0, 0), (1, 1, 1, 2)], 2: [(0, 1, 1, 2), (2, 1, 0, 0)], 3: [(0, 1, 1, 2)],
                   4: [(0, 1, 1, 2), (1, 4, 1, 0)], 5: [], 6: [(0, 1, 1, 2)]}


@pytest.mark.parametrize("tau", [1, None])
def test_classes_count_every_link_of_a_large_group(spark, monkeypatch, tau):
    """Lines that are all near each other: no link between different lines is left out."""
    for name, value in (("BUSY", 2), ("SAMPLE", 1), ("FEW", 4)):
        monkeypatch.setattr(lines, name, value)
    base = "the committee met on tuesday and heard the report of the treasurer on the harbour"
    rows = [(i, base[:40] + c + base[41:]) for i, c in enumerate("abcdefghijklmnopqrstuvwx")]
    rows += [(100 + i, base[:k] + "#" + base[k + 1:]) for i, k in enumerate(range(20))] + [(200, "another line of the same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, linked = lines._plain_links(rows, tau)
    assert lines.line_links(docs, tau, every=True)[3].count() == sum(map(len, linked.values())) // 2
    got = {x.doc_id: x.lines[0] for x in lines.classes(docs, tau).collect()}
    assert {i: (x.class_doc_id, x.class_line) for i, x in got.items()} == {
        i: v[0][1:] for i, v in lines.brute_classes(rows, tau).items()}
    for i, t in rows:
        own = [u for j, u in rows if got[j].class_doc_id == got[i].class_doc_id]
        assert got[i].class_links == sum(len(linked[u]) for u in own) // 2


def test_only_texts_in_question_are_moved(spark, monkeypatch):
    """Lines that come once are neither made distinct nor, without a candidate, looked up again."""
    tables, plain = {}, lines.written

    def noted(df, name):
        tables[name] = plain(df, name)
        return tables[name]
    monkeypatch.setattr(lines, "written", noted)
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcdefghij ") for _ in range(50)) + "z") for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[1][1][:-1] + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_exact, x.n_near) for x in lines.report(docs).collect()}
    assert got == {i: (int(i == 300), int(i == 301)) for i, _ in rows}
    assert tables["twice"].count() == 1 and tables["known"].count() == 2
    hit = lines._maybe(docs, F.xxhash64("doc_id"), lines._bitmap(docs.where("doc_id > 250"), F.xxhash64("doc_id"), "bits"))
    assert hit.where("hit").count() < 10 and {300, 301} <= {x.doc_id for x in hit.where("hit").collect()}


def test_full_bitmaps_change_no_result(spark, monkeypatch):
    """Where every key shares its bit with others, the exact joins behind the bitmaps decide."""
    monkeypatch.setattr(lines, "WORDS", 1)
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(12, 40))) for _ in range(12)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3]), "abc") for _ in range(r.randint(0, 6))))
            for i in range(120)]
    got = {x.doc_id: x for x in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (n, exact, near, kept) in lines.brute_force(rows, 1).items():
        assert (got[i].n_lines, got[i].n_exact, got[i].n_near) == (n, exact, near)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_versions_of_one_line_far_apart_are_not_paired(spark, monkeypatch):
    """Lines that share most of their text, few of them near: no pairs are made of them, and the right ones go."""
    tables, plain = [], lines.written

    def noted(df, name):
        out = plain(df, name)
        tables.append((name, out))
        return out
    monkeypatch.setattr(lines, "written", noted)
    monkeypatch.setattr(lines, "CROWD", 10)
    r = random.Random(4)
    words = [["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(24)]]
    for i in range(60):
        told = list(words[0] if i % 6 else r.choice(words))
        for _ in range(3 if i % 6 else 1):
            told[r.randrange(24)] = "".join(r.choice("klmnopqrst") for _ in range(5))
        words.append(told)
    rows = list(enumerate(" ".join(w) for w in words))
    want = lines.brute_force(rows)
    got = {x.doc_id for x in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, (_, _, near, _) in want.items() if not near} and 4 < len(got) < 61
    assert sum(t.count() for name, t in tables if name in ("pairs", "links")) < 12 * len(rows)


def test_codes_rule_out_only_what_counts_do(spark):
    """Bits of the codes differ by no more than the counts, and for near lines by no more than two an edit."""
    r = random.Random(6)
    pairs = []
    for _ in range(200):
        a = "".join(r.choice("etaoinsrhldu xé") for _ in range(r.randint(10, 400)))
        n = r.randint(0, 7)
        pairs.append((a, edited(r, a, n, "etu z"), n))
    df = spark.createDataFrame(pairs, "a string, b string, n int").select(
        "n", *[lines._letters(F.col(c)).alias("l" + c) for c in "ab"]).select(
        "n", lines._apart(F.col("la"), F.col("lb")).alias("apart"), lines._codes(F.col("la")).alias("x"), lines._codes(F.col("lb")).alias("y"))
    rows = df.selectExpr("n", "apart", "bit_count(x[0] ^ y[0]) + bit_count(x[1] ^ y[1]) AS bits").collect()
    assert all(x.bits <= x.apart and x.bits <= 2 * x.n for x in rows) and any(x.bits == x.apart > 4 for x in rows)
