"""Files, folders of models and incremental batches."""

from pyspark.sql import functions as F

from lexispark.functions.similarity import register
from lexispark.plans import pipeline
from lexispark.sources import io
from lexispark.streaming.incremental import classify_keyed, classify_new, latest, requeued


def test_sentences(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("One two three. Four five!\nSix seven eight nine")
    assert sorted(len(r.tokens) for r in io.read_sentences(spark, str(tmp_path)).collect()) == [3, 4]


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    io.append(spark.range(3), path)
    io.replace(spark.range(2), path)
    io.append(spark.range(1), path)
    assert spark.read.parquet(path).count() == 3
    assert pipeline.table_exists(spark, path) and not pipeline.table_exists(spark, path + "x")


def test_training_load(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text('desc,cls\n"a, b",x\n')
    io.load_training(spark, str(csv), "desc string, cls string", str(tmp_path / "t"))
    row = spark.read.parquet(str(tmp_path / "t")).first()
    assert row.desc == "a, b" and row.create_dt is not None


def test_folders_rotate(spark, tmp_path):
    class Model:
        def save(self, path):
            spark.range(1).write.parquet(path)

    f = io.ModelFolders(spark, str(tmp_path / "models"), keep=2)
    assert f.folders() == [] and f.newest(["a"]) is None
    for stamp in ("20200101000000", "20200102000000", "20200103000000"):
        f.save({"a": Model()}, stamp)
    assert len(f.folders()) == 2 and f.newest(["a"]).endswith("20200103000000") and f.newest(["a", "b"]) is None


def test_models_are_the_same_when_loaded(spark, tmp_path):
    from lexispark.operators import classify

    words = {"p": "red bolt hot", "q": "blue gear old", "r": "small ring kit"}
    rows = [(i, f"{words['pqr'[i % 3]]} x{i % 7} {words['pqr'[(i + i // 9) % 3]].split()[0]}", "pqr"[i % 3]) for i in range(90)]
    d = spark.createDataFrame(rows, "k long, d string, c string")
    which = [c for c in classify.registry(False) if c.name in ("Jaro", "Logistic_OvR", "DeepNN", "BoostedLinear", "NaiveBayes")]
    model = pipeline.train(d, "d", "c", "k", which, {"colour": ["red", "blue"], "size": ["small"]}, size=8)
    model.save(spark, str(tmp_path), "20200101000000")
    again = pipeline.Trained.load(spark, str(tmp_path), [c.name for c in which])
    said = lambda m: sorted(tuple(r) for r in m.classified(d, "k").select("row_id", "vote", "n_agree", "algorithms").collect())
    assert said(model) == said(again) and [*again.models] == [c.name for c in which]
    assert sum(v == "pqr"[i % 3] for i, v, *_ in said(again)) > 80
    assert pipeline.Trained.load(spark, str(tmp_path), ["Stacking"]) is None
    alone = pipeline.train(d, "d", "c", "k", which[:1])
    alone.save(spark, str(tmp_path / "texts"), "20200101000000")
    assert said(alone) == said(pipeline.Trained.load(spark, str(tmp_path / "texts"), ["Jaro"]))


def test_replace_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    io.append(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t._old")  # broke off between the renames
    assert io.recovered(spark, path) and spark.read.parquet(path).count() == 3 and not io.recovered(spark, path)
    io.replace(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_incremental(spark, tmp_path):
    src, to, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "id long").write.mode("append").parquet(src)
        classify_new(spark, src, "id long", lambda d: d.selectExpr("id", "id % 2 as cls"), to, ck, ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(to).collect()) == list(range(5))


def test_pending_rows_come_again(spark, tmp_path):
    src, to, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    known = {0}
    classify = lambda d: d.select("id", "name", F.when(F.col("id").isin(sorted(known)), "No Review Necessary").otherwise("Pending").alias("rev_stat"))
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    rows(0, 1, 1).write.parquet(src)
    classify_new(spark, src, "id long, name string", classify, to, ck, ["id"], "rev_stat").awaitTermination()
    known.add(1)
    again = requeued(rows(0, 1), latest(spark, to, ["id"]), ["id"])
    assert [r.id for r in again.collect()] == [1]
    again.unionByName(rows(0, 2)).write.mode("append").parquet(src)  # 0 has been settled, 2 is new
    classify_new(spark, src, "id long, name string", classify, to, ck, ["id"], "rev_stat").awaitTermination()
    assert sorted(tuple(r) for r in latest(spark, to, ["id"]).collect()) == [(0, "n0", "No Review Necessary"), (1, "n1", "No Review Necessary"), (2, "n2", "Pending")]
    assert spark.read.parquet(to).count() == 4


def test_keyed_state(spark, tmp_path):
    """Three batches with re-queued, repeated and null keys, a batch that fails once, and a new query for each."""
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "id long, part string, n int, at timestamp"
    known, fails = {0, 2**60 + 1}, [False]

    def classify(d):
        if fails.pop():
            raise RuntimeError("lost")
        return d.withColumn("rev_stat", F.when(F.col("id").isin(sorted(known)), "No Review Necessary").otherwise("Pending"))

    def batch(run, to, check, *ids):
        rows = [(i, "a", None if i == 0 else 7, None) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        for broken in (True, False) if run is classify_keyed else (False,):
            fails[:] = [False] * 9 + [broken]
            query = run(spark, src, schema, classify, to, check, ["id", "part"], "rev_stat")
            try:
                query.awaitTermination()
            except Exception as e:
                assert broken and "lost" in str(e)

    batches = ([0, 1, 1, None, 2**60 + 1], [1, 0, 2, None], [2, 1, 3, 2**60 + 1])
    for i, ids in enumerate(batches):
        batch(classify_keyed, str(tmp_path / "keyed"), ck, *ids)
        known.add(i + 1)
    got = spark.read.parquet(str(tmp_path / "keyed"))
    assert sorted((r.batch, -1 if r.id is None else r.id, r.rev_stat) for r in got.collect()) == [
        (0, -1, "Pending"), (0, 0, "No Review Necessary"), (0, 1, "Pending"), (0, 2**60 + 1, "No Review Necessary"), (1, -1, "Pending"), (1, 1, "No Review Necessary"), (1, 2, "Pending"), (2, 2, "No Review Necessary"), (2, 3, "Pending"),
    ]
    assert {(r.id, r.n) for r in got.where("batch = 0").collect()} == {(0, None), (1, 7), (None, 7), (2**60 + 1, 7)}


def test_sql_functions(spark):
    register(spark)
    assert tuple(spark.sql("SELECT round(jaro_sim('dear', 'bear'), 2), dl_sim('ca', 'abc'), clean_text('a-b')").first()) == (0.83, 0.33, "a b")


def test_classify_lines(spark):
    train = spark.createDataFrame([(1, "red bolt", "p"), (2, "blue widget", "q")], "k long, d string, c string")
    new = spark.createDataFrame([(10, "red bolt"), (11, "blue widgt"), (12, "zzz")], "k long, d string")
    got = {r.k: (r.c, r.origin) for r in pipeline.classify_lines(new, train, None, "d", "c", "k").collect()}
    assert got == {10: ("p", "exact"), 11: ("q", "fuzzy"), 12: (None, "none")}
