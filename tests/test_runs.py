"""Runs over state tables: what is left after one run, after a second, and after one that broke off."""

from pyspark.sql import functions as F

from lexispark.operators import classify
from lexispark.plans import pipeline, runs
from lexispark.sources import io

HISTORY = "clm_id long, clm_ln_id long, orig_desc string, received_date string, processed_flag string, last_name string, first_name string, clm_rcv_dt string"


def laid_out(spark, root):
    rows = [
        (1, 1, "red bolt", "d1", "Unprocessed", "A", "B", "2026-01-01"), (1, 1, "red bolt", "d1", "Unprocessed", "A", "B", "2026-01-01"), (2, 1, "blue widgt", "d1", "Unprocessed", None, "B", "2026-01-01"),
        (3, 1, None, None, "Unprocessed", None, None, None), (4, 1, "zzz", "d1", "Processed", "A", "B", None), (5, 1, "red bolt", "d1", "Processed", "A", "B", None), (6, 1, "", "d1", None, "A", "B", None),
    ]
    spark.createDataFrame(rows, HISTORY).write.parquet(f"{root}/history")
    old = [(4, 1, "zzz", "d1", "Pending", 0.2), (5, 1, "red bolt", "d1", "Approved", 0.3), (7, 1, "gone", "d1", "Pending", 0.99)]
    spark.createDataFrame(old, "clm_id long, clm_ln_id long, orig_desc string, received_date string, rev_stat string, conf_score double").write.parquet(f"{root}/report")
    spark.createDataFrame([("red bolt", "p"), ("blue widget", "q")], "orig_desc string, chrg_cls string").write.parquet(f"{root}/training")


def said(spark, root):
    return sorted((r.clm_id, r.chrg_cls, r.rev_stat, r.conf_score) for r in spark.read.parquet(f"{root}/report").collect())


WANT = [(1, "p", "No Review Necessary", 1.0), (1, "p", "No Review Necessary", 1.0), (2, "q", "No Review Necessary", 0.97), (3, "", "Pending", 0.0), (4, "", "Pending", 0.0), (5, None, "Approved", 0.3), (7, None, "No Review Necessary", 0.99)]


def test_classification_run(spark, tmp_path):
    root = str(tmp_path)
    laid_out(spark, root)
    n = runs.classification_run(spark, root, None).first().asDict()
    assert n == {"no_of_rec": 5, "unique_rec": 4, "new_rec": 3, "unique_new_rec": 3, "no_of_chrg_cls": 2, "high_conf_covg": 1.0}
    assert said(spark, root) == WANT
    flags = [(r.clm_id, r.processed_flag) for r in spark.read.parquet(f"{root}/history").orderBy("clm_id").collect()]
    assert flags == [(1, "Processed"), (1, "Processed"), (2, "Processed"), (3, "Processed"), (4, "Processed"), (5, "Processed"), (6, None)]
    row = spark.read.parquet(f"{root}/report").where("clm_id = 2").first()
    assert (row.patient_nm, str(row.exp_dt), row.ftr1, row.ftr2, row.ftr3, row.origin) == (", B", "2026-01-04", "blue", "widgt", "", "fuzzy")
    assert runs.classification_run(spark, root, None).first().no_of_rec == 2  # those that are still Pending come again
    assert said(spark, root) == WANT


def test_a_run_that_broke_off_is_run_again(spark, tmp_path):
    root = str(tmp_path)
    laid_out(spark, root)
    before = spark.createDataFrame(spark.read.parquet(f"{root}/history").collect(), HISTORY)
    runs.classification_run(spark, root, None)
    io.replace(before, f"{root}/history")  # the report had been swapped, the history had not
    runs.classification_run(spark, root, None)
    assert said(spark, root) == WANT and spark.read.parquet(f"{root}/history").where("processed_flag = 'Unprocessed'").isEmpty()


def test_first_run_and_empty_work(spark, tmp_path):
    root = str(tmp_path)
    laid_out(spark, root)
    (tmp_path / "report").rename(tmp_path / "other")
    assert runs.classification_run(spark, root, None).first().no_of_rec == 4
    io.replace(spark.read.parquet(f"{root}/history").limit(0), f"{root}/history")
    n = runs.classification_run(spark, root, None).first()
    assert (n.no_of_rec, n.unique_rec, n.high_conf_covg) == (0, 0, 1.0) and len(said(spark, root)) == 4


def test_training_run(spark, tmp_path):
    root = str(tmp_path)
    words = {"p": "red bolt", "q": "blue gear"}
    rows = [(f"{words['pq'[i % 2]]} x{i}", f"{words['pq'[i % 2]]} x{i}", "pq"[i % 2], "RETROSPECTIVE", i) for i in range(60)] + [(None, "odd", None, None, 99)]
    spark.createDataFrame(rows, "orig_desc string, norm_desc string, chrg_cls string, flag string, own int").withColumn("create_dt", F.to_date(F.lit("2000-01-01"))).write.parquet(f"{root}/training")
    spark.createDataFrame([("red bolt x0", "z", 1, 1), ("red bolt x0", "q", 2, 2), ("none", "q", 1, 3)], "orig_desc string, chrg_cls_new string, rev_dt int, unlearn_desc_id int").write.parquet(f"{root}/requests")
    reviews = [
        (1, "blue gear x1", "blue gear x1", None, "blue cog x1", "q", "Approved", 0.2, "u", 1), (2, "blue gear x1", "blue gear x1", None, "blue cogs x1", "p", "Approved", 0.2, "u", 2), (3, "blue gear x1", "n", None, "m", "z", "Pending", 0.2, "u", 3),
        (4, "red bolt x2", "red bolt x2", None, "red bolt x2", "q", "Approved", 0.95, "", 1), (5, "new*text", "new text", None, "new text", "p", "Approved", 0.95, "u", 1), (6, "new text", "new text", None, "new text", "q", "Approved", 0.1, "u", 1),
    ]
    spark.createDataFrame(reviews, "rev_id int, orig_desc string, norm_desc string, chngs string, norm_desc_new string, chrg_cls_new string, rev_stat string, conf_score double, updated_by string, updated_date int").write.parquet(f"{root}/reviews")
    corpus = spark.createDataFrame([("gear", "cog", "x1", "old", 0), ("a", "b", "", "old", 0)], "word string, match string, surrounding_word string, assignee string, date int")
    corpus.write.parquet(f"{root}/spellings")
    corpus.limit(0).write.parquet(f"{root}/abbreviations")
    which = [c for c in classify.registry(False) if c.name == "NaiveBayes"]
    for again in range(2):
        judged = runs.training_run(spark, root, f"{root}/models", f"2026010{again + 1}000000", "2026-01-02", which=which, least=10)
        assert [(r.clf, r.keep) for r in judged.collect()] == [("NaiveBayes", True)]
        t = {r.orig_desc: (r.norm_desc, r.chrg_cls, r.flag, str(r.create_dt), r.own) for r in spark.read.parquet(f"{root}/training").collect()}
        assert len(t) == 62 and t["red bolt x0"][1:4] == ("q", "RETROSPECTIVE", "2000-01-01") and t[None] == ("odd", None, None, "2000-01-01", 99)
        assert t["blue gear x1"] == ("blue cogs x1", "p", "ONLINE", "2026-01-02", 1) and t["red bolt x2"][1] == "p"  # the gate holds red bolt x2 back
        assert t["new text"] == ("new text", "q", "ONLINE", "2026-01-02", None)  # equal after cleaning: the higher rev_id
        found = sorted(tuple(r) for r in spark.read.parquet(f"{root}/spellings").collect())
        assert found == [("a", "b", "", "old", 0), ("gear", "cog", "x1", "u", 1), ("gear", "cogs", "x1", "u", 2)]
    assert [*pipeline.Trained.load(spark, f"{root}/models", ["NaiveBayes"]).models] == ["NaiveBayes"]
    io.replace(spark.read.parquet(f"{root}/requests").limit(0), f"{root}/requests")
    io.replace(spark.read.parquet(f"{root}/reviews").where("rev_stat = 'Pending'"), f"{root}/reviews")
    assert runs.training_run(spark, root, f"{root}/models", "20260103000000", "2026-01-03", which=which, least=10) is None


def test_work_list_takes_one_join(spark, tmp_path):
    """Lines with settled and Pending rows at once, with neither, and with a status of null."""
    root = str(tmp_path)
    laid_out(spark, root)
    history, report = spark.read.parquet(f"{root}/history"), spark.read.parquet(f"{root}/report")
    more = [(1, 1, "red bolt", "d1", None, 0.1), (2, 1, "blue widgt", "d1", "Approved", 0.1), (2, 1, "blue widgt", "d1", "Pending", 0.1), (3, 1, None, None, "Pending", 0.1), (3, 1, None, None, "Pending", 0.1), (6, 1, "", "d1", "Pending", 0.1)]
    work = runs.work_list(history, report.unionByName(spark.createDataFrame(more, report.schema)))
    assert sorted(r.clm_id for r in work.collect()) == [1, 1, 3, 4, 6] and work.columns == history.columns
    assert work._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
