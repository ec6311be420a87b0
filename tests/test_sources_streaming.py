"""Readers, sinks, model persistence and streaming == batch."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from neurotab import fixtures as fx
from neurotab.learn import models as md
from neurotab.operators.training import job_status
from neurotab.sources import readers as rd
from neurotab.sources import writers as wr
from neurotab.streaming import jobs


def test_reader_registry():
    assert rd.get_reader("wide_csv") is rd.read_wide_csv
    with pytest.raises(ValueError):
        rd.get_reader("no_such_dataset")


def test_wide_csv_with_timestamp_header(spark, tmp_path):
    p = tmp_path / "rec.csv"
    p.write_text("timestamp,F3,F4\n0.0000,1.5,2.5\n0.0078,1.25,\n")
    long = rd.read_wide_csv(spark, str(p), ["F3", "F4"]).orderBy("time", "channel").collect()
    assert [(r.time, r.channel, r.value) for r in long] == [(0.0, "F3", 1.5), (0.0, "F4", 2.5), (0.0078, "F3", 1.25)]


def test_xml_fallback_tags(spark):
    docs = spark.createDataFrame([
        (1, "<s><feltArsl>3</feltArsl><feltArsl>4</feltArsl><feltVlnc>6</feltVlnc></s>"),
        (2, "<s><feltArsl>3</feltArsl><selfValence>7</selfValence></s>"),
        (3, "<s><feltArsl>3</feltArsl></s>"),
    ], "session_id long, xml string")
    got = {r.session_id: (r.arousal, r.valence) for r in rd.xml_ratings(docs).collect()}
    assert got == {1: (4.0, 6.0), 2: (3.0, 7.0)}


def test_xml_goes_through_a_parser(spark):
    docs = ["<s><x><feltArsl unit='a'>5</feltArsl></x><feltVlnc>6</feltVlnc></s>", "<s><feltArsl>5</feltArsl><feltVlnc>6</feltVlnc><!--<feltArsl>9</feltArsl>--></s>",
            "<s><feltArsl>5</feltArsl><feltVlnc>6</feltVlnc>", "<s><feltArsl/><feltVlnc>6</feltVlnc></s>", "no xml", "", None,
            "<s><feltArsl>&#53;</feltArsl><feltVlnc><![CDATA[6]]></feltVlnc></s>", "<s><feltArsl>5</feltArsl><feltVlnc>6</feltVlnc></s>x",
            "<s><feltArsl>bad</feltArsl><feltArsl>5</feltArsl><feltVlnc>6</feltVlnc></s>", "<s><AROUSAL>5</AROUSAL><valences>1</valences><valences>6</valences></s>"]
    df = spark.createDataFrame(list(enumerate(docs)), "session_id long, xml string")
    got = {r["session_id"]: (r["arousal"], r["valence"]) for r in rd.xml_ratings(df).collect()}
    assert got == {k: (5.0, 6.0) for k in (0, 1, 7, 10)}


def test_wide_csv_layouts(spark, tmp_path):
    (tmp_path / "one.csv").write_text('note,F4,time,F3\n"x,y ""z""",4,0,3\n\n,5,0.5,bad\n')
    (tmp_path / "two of it.csv").write_text("\ufefftimestamp, F3\r\n1.0,7\r\n1.5,\r\n")
    long = rd.read_wide_csv(spark, str(tmp_path), ["F3", "F4"])
    assert sorted((r["time"], r["channel"], r["value"]) for r in long.where("value is not null").collect()) == [
        (0.0, "F3", 3.0), (0.0, "F4", 4.0), (0.5, "F4", 5.0), (1.0, "F3", 7.0)]
    assert [tuple(r) for r in rd.bad_cells(long).where("n_bad > 0").collect()] == [("F3", 1)]
    (tmp_path / "third.csv").write_text("F3,F4\n1,2\n")
    with pytest.raises(ValueError, match="1 files without a 'time' column.*third"):
        rd.read_wide_csv(spark, str(tmp_path), ["F3"])
    assert rd.read_wide_csv(spark, str(tmp_path), ["F3"], missing="skip").count() == 3


def test_nested_trials_transpose(spark):
    df = spark.createDataFrame([(1, 1, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), (1, 2, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])],
                               "subject_id int, trial_id int, eeg array<array<double>>")
    out = {(r.trial_id, r.channel_idx, r.sample_idx): r.value for r in rd.nested_trials(df).collect()}
    assert out[(1, 1, 0)] == 4.0 and out[(2, 1, 0)] == 2.0 and out[(2, 0, 2)] == 5.0


def test_history_sink_appends_by_run(spark, tmp_path):
    h = spark.createDataFrame([("a", 0, 1, 0.5), ("b", 0, 1, 0.7)], "run_id string, fold int, epoch int, val_loss double")
    wr.append_history(h, str(tmp_path / "hist"))
    wr.append_history(h.withColumn("epoch", F.lit(2)), str(tmp_path / "hist"))
    back = spark.read.parquet(str(tmp_path / "hist"))
    assert back.count() == 4 and back.where("run_id = 'a'").count() == 2


def test_model_save_and_load_round_trip(spark, tmp_path):
    """A stored scorer scores as the one in memory: scaler, numbers, Spark model, neighbour table and members."""
    data = fx.feat_wide(spark, SMALL).select("id", "label", "features")
    members = [md.fit_logreg(data, max_iter=20), md.fit_discriminant(data)]
    fitted = [*members, md.fit_knn(data), md.fit_random_forest(data, trees=5, depth=3), md.scorer_of("soft_vote", "vote", members=members)]
    for i, scorer in enumerate(fitted):
        md.save_scorer(scorer, spark, str(tmp_path / f"m{i}"))
        loaded = md.load_scorer(spark, str(tmp_path / f"m{i}"))
        assert loaded.name == scorer.name
        assert loaded.score(data).orderBy("id").collect() == scorer.score(data).orderBy("id").collect()


def test_tumbling_stream_equals_batch(spark, tmp_path):
    ev = fx.table(spark, SMALL, "events")
    src = str(tmp_path / "events")
    ev.write.parquet(src)
    q = jobs.start_tumbling(spark, src, ev.schema, str(tmp_path / "ck"), str(tmp_path / "out"), window="1 day",
                            watermark="1 day", rename={"user_id": "recording_id", "event_type": "channel"})
    q.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.tumbling_features(ev.withColumnRenamed("user_id", "recording_id")
                                   .withColumnRenamed("event_type", "channel"), window="1 day")
    # append mode emits only windows closed by the watermark; each must equal the batch row
    stream = stream.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    j = stream.join(batch, ["recording_id", "channel", "window_start"])
    assert stream.count() > 0 and j.count() == stream.count()
    assert j.where(F.abs(stream["mean"] - batch["mean"]) > 1e-9).count() == 0


def test_job_status_stream_equals_batch(spark, tmp_path):
    ev = fx.job_events(spark, SMALL)
    src = str(tmp_path / "jobs")
    ev.write.parquet(src)
    q = jobs.start_job_status(spark, src, ev.schema, str(tmp_path / "ck2"), str(tmp_path / "out2"))
    q.awaitTermination()
    s = jobs.latest_status(spark, str(tmp_path / "out2"))
    b = job_status(ev)
    assert s.count() == b.count()
    assert s.join(b, ["job_id", "current_epoch", "status"]).count() == b.count()


def test_sql_surface(spark):
    from neurotab.functions.sql_surface import register_sql_functions
    register_sql_functions(spark)
    rows = spark.sql("SELECT epoch_id, values FROM epochs(array(1.0D, 2.0D, 3.0D, 4.0D, 5.0D), 2)").collect()
    assert [(r.epoch_id, list(r.values)) for r in rows] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    short = spark.sql("SELECT values FROM epochs(array(1.0D), 3)").first()
    assert list(short.values) == [1.0, 0.0, 0.0]
    psd = spark.sql("SELECT welch_psd(transform(sequence(0, 63), i -> CAST(i AS DOUBLE))) AS p").first().p
    assert len(psd) == 33


def test_model_factory_and_progress(spark):
    from neurotab.learn import validation as va
    with pytest.raises(ValueError):
        md.get_model("no_such_model")
    data = fx.feat_wide(spark, SMALL).select("id", "label", "features")
    from neurotab.operators.folds import stratified_folds
    data = stratified_folds(data, k=3)
    seen = []
    va.cross_validate(data, md.get_model("lda"), k=3, progress=lambda step, info: seen.append(step))
    assert seen == [0, 1, 2]


def test_streaming_progress_listener(spark, tmp_path):
    ev = fx.job_events(spark, SMALL)
    src = str(tmp_path / "jobs_l")
    ev.write.parquet(src)
    got = []
    listener = jobs.ProgressListener(lambda b, info: got.append(info["input_rows"]))
    spark.streams.addListener(listener)
    try:
        jobs.start_job_status(spark, src, ev.schema, str(tmp_path / "ck3"), str(tmp_path / "out3")).awaitTermination()
        import time
        for _ in range(50):
            if got:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(got) == ev.count()
