"""File sources: training CSV (quoted multi-line text, NULL identity labels)."""
import os
import tempfile

from moderata.functions.classes import IDENTITY_COLUMNS, REACTION_COLUMNS, TRAINING_TOXICITY_COLUMNS
from moderata.functions.columns import display_name
from moderata.sources import files as FI


def test_training_csv(spark):
    d = tempfile.mkdtemp(prefix="moderata-csv-", dir="/tmp")
    header = ["id", "comment_text"] + TRAINING_TOXICITY_COLUMNS + IDENTITY_COLUMNS + REACTION_COLUMNS
    row1 = ["1", '"line one\nline ""two"""'] + ["0.5"] * 7 + [""] * 24 + ["1"] * 5
    row2 = ["2", "plain"] + ["0.9"] * 7 + ["0.25"] * 24 + ["0"] * 5
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write(",".join(header) + "\n" + ",".join(row1) + "\n" + ",".join(row2) + "\n")
    df = FI.read_training_csv(spark, d)
    rows = {r.id: r for r in df.collect()}
    assert rows[1].comment_text == 'line one\nline "two"'
    assert rows[1].severe_toxic == 0.5 and rows[1].asian is None
    assert rows[2].white == 0.25 and rows[2].funny == 0
    assert "severe_toxicity" not in df.columns
    pq = FI.training_csv_to_parquet(spark, d, os.path.join(d, "train.parquet"), partitions=2)
    assert sorted(tuple(r) for r in pq.collect()) == sorted(tuple(r) for r in df.collect())


def test_display_name(spark):
    r = spark.createDataFrame([("joe", "1234")], "n string, d string") \
        .select(display_name("n", "d").alias("x")).collect()[0]
    assert r.x == "joe#1234"


def test_spread_is_a_no_op_for_many_splits(spark):
    from moderata.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 10_000, 1, 4 * cores)
    assert spread(many) is many                     # enough splits: untouched
    one = spark.range(0, 10_000, 1, 1)
    spread_one = spread(one)
    assert spread_one.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in spread_one.collect()) == list(range(10_000))


def test_training_csv_by_name_keeps_bad_rows_apart(spark):
    d = tempfile.mkdtemp(prefix="moderata-csv-", dir="/tmp")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("extra,toxic,comment_text,id,insult\nx,0.5,hello,1,0.25\ny,n/a,broken,2,0.5\nz,,fine,3,1.0\n")
    rows = {r.id: r for r in FI.read_training_csv(spark, d).collect()}
    assert set(rows) == {1, 3} and rows[1].toxic == 0.5 and rows[1].insult == 0.25 and rows[3].toxic is None
    assert "extra" not in rows[1] and rows[1].white is None
    bad = FI.corrupt_training_rows(spark, d).collect()
    assert len(bad) == 1 and "broken" in bad[0].line


def test_configuration_gives_reply_lists(spark):
    cfg = FI.load_persona_config(spark=spark, path="file://" + FI.PERSONA_CONFIG)
    assert cfg == FI.load_persona_config()
    assert set(FI.reply_lists(cfg)) == {"toxic_replies", "apology_replies"}
    assert FI.reply_lists({"user": {}}) == {}
