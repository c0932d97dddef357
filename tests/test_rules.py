"""Rules that must hold whatever the data: names of emoji against a list written
by hand, sinks that never lose runs, splits with null labels, clear errors."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from mojiframe.functions import text as TX
from mojiframe.operators import errors as ER
from mojiframe.operators import features as FT
from mojiframe.operators import models as ML
from mojiframe.operators import splits as SP
from mojiframe.sources import io as IO
from mojiframe.sources import runs as RN

# emoji -> name, by hand (the lexicon is not used)
NAMES = """
😀 grinning_face|😂 face_with_tears_of_joy|😊 smiling_face_with_smiling_eyes|😍 smiling_face_with_heart-eyes|😎 smiling_face_with_sunglasses
😒 unamused_face|😭 loudly_crying_face|😱 face_screaming_in_fear|🙄 face_with_rolling_eyes|🤔 thinking_face|🤣 rolling_on_the_floor_laughing
🥰 smiling_face_with_hearts|😴 sleeping_face|😢 crying_face|😘 face_blowing_a_kiss|😉 winking_face|😇 smiling_face_with_halo|😐 neutral_face
🙃 upside-down_face|😅 grinning_face_with_sweat|👍 thumbs_up|👎 thumbs_down|👏 clapping_hands|🙌 raising_hands|🙏 folded_hands|💪 flexed_biceps
👌 OK_hand|👋 waving_hand|✌️ victory_hand|👊 oncoming_fist|❤️ red_heart|💔 broken_heart|💙 blue_heart|💚 green_heart|💛 yellow_heart|💜 purple_heart
🖤 black_heart|⭐ star|🌟 glowing_star|☀️ sun|☁️ cloud|🔥 fire|💯 hundred_points|💩 pile_of_poo|💀 skull|👀 eyes|🎉 party_popper|🏆 trophy
🚀 rocket|📷 camera|🍕 pizza|☕ hot_beverage|⚽ soccer_ball|✅ check_mark_button|❌ cross_mark|⚠️ warning|™️ trade_mark|©️ copyright
🇫🇷 France|🇩🇪 Germany|🇬🇧 United_Kingdom|🇺🇸 United_States|🏴󠁧󠁢󠁥󠁮󠁧󠁿 England|🏴󠁧󠁢󠁳󠁣󠁴󠁿 Scotland|👍🏽 thumbs_up_medium_skin_tone|👋🏿 waving_hand_dark_skin_tone
👨‍👩‍👧 family_man_woman_girl|🇳🇿 New_Zealand|🇧🇦 Bosnia_&_Herzegovina|🇭🇰 Hong_Kong_SAR_China|🇪🇺 European_Union|🇽🇽 flag_XX|🥺 pleading_face|🥴 woozy_face|🤪 zany_face|🥵 hot_face|🤮 face_vomiting|🥳 partying_face|🤞 crossed_fingers|🙋 person_raising_hand|🏃 person_running|1️⃣ keycap_1|#️⃣ keycap_#
"""


def _names():
    return [tuple(x.split(" ", 1)) for x in NAMES.strip().replace("\n", "|").split("|")]


def test_emoji_names_and_removal(spark):
    rows = _names()
    assert len(rows) >= 60
    df = spark.createDataFrame([(f"a {e} b", f"a  {n}  b") for e, n in rows], "t string, want string")
    got = df.select("want", TX.demojize("t").alias("got"), TX.remove_emoji_sequences("t").alias("bare")).collect()
    assert [(r.want, r.got) for r in got if r.want != r.got] == []
    assert {r.bare for r in got} == {"a  b"}  # no residue of tags, tones, selectors


def test_runs_are_kept_and_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda run, p: spark.createDataFrame([(run, 1, 0, 1, p)], "run string, id long, y_true int, y_pred int, p double")
    IO.write_predictions(rows("a", 0.1), path)
    with pytest.raises(FileExistsError):
        IO.write_predictions(rows("a", 0.2).union(rows("b", 0.2)), path)
    IO.write_predictions(rows("a", 0.2).union(rows("b", 0.3)), path, existing="keep")
    assert sorted((r.run, r.p) for r in IO.read_predictions(spark, path).collect()) == [("a", 0.1), ("b", 0.3)]


def test_leaderboard_warns_of_lost_runs(spark, tmp_path):
    board = spark.createDataFrame([("a", 0.5)], "run_folder string, test_macro_f1 double")
    IO.write_leaderboard(board, spark.createDataFrame([("a",), ("b",)], "run string"), str(tmp_path / "l"))
    assert [r.run for r in spark.read.json(str(tmp_path / "l/warnings")).collect()] == ["b"]


def test_errors_are_stored_by_run_and_kind(spark, tmp_path):
    top = E.queries()["l2_top_errors"](spark, SF001)
    IO.write_errors(top, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.where("kind = 'fp'").count() == top.where("kind = 'fp'").count()


def test_only_a_missing_folder_is_empty(spark, tmp_path):
    assert IO.read_json_table(spark, str(tmp_path / "none"), RN.CONFIG_SCHEMA).count() == 0
    with pytest.raises(Exception):
        IO.read_json_table(spark, "nosuchscheme://x/y", RN.CONFIG_SCHEMA).count()


def test_null_labels_have_an_exact_share(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 2).cast("int")).alias("label"))
    s = SP.stratified_split(df, 0.15, 3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"dev": 30, "train": 170}


def test_sample_split_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    a, b = (SP.sample_split(df.repartition(n), 0.2, 5) for n in (1, 7))
    assert a.exceptAll(b).count() == 0 and 450 < a.where("split = 'dev'").count() < 750


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="has_emoji"):
        ER.top_errors(spark.createDataFrame([("a", 1, 0, 1, 0.5)], "run string, id long, y_true int, y_pred int, p double"), columns=["p"])


def test_unknown_config_fields_are_refused(spark):
    raw = spark.createDataFrame([('{"run_name": "x", "lr": "2e-5", "colour": 1}',)], "raw string")
    with pytest.raises(Exception, match="colour"):
        RN.parse_configs(raw).collect()
    row = RN.parse_configs(raw, strict=False).first()
    assert row.unknown_fields == ["colour"] and row.lr == 2e-5


def test_sorted_errors_have_no_window_over_runs(spark):
    df = E.queries()["l1_sorted_errors"](spark, SF001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    ranks = df.groupBy("run", "kind").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n for r in ranks)


def test_vocabulary_and_predictions_do_not_depend_on_partitions(spark):
    c = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    c = c.withColumn("x_text", F.concat(F.when(F.col("label") == 1, "oh totally ").otherwise("plainly fine "), (F.col("id") % 17).cast("string"), F.lit(" word"),
                                        (F.col("id") % 29).cast("string")))
    vocab, scores = [], []
    for parts in (1, 5):
        model = ML.train_baseline(c.repartition(parts), "x_text", max_features=20, max_iter=50)
        vocab.append(model.stages[0].stages[1].vocabulary)
        scores.append({r.id: (round(r.p, 6), r.y_pred) for r in ML.score(model, c, "x").collect()})
    assert vocab[0] == vocab[1] and scores[0] == scores[1]


def test_vocabulary_cut_is_by_count_then_term(spark):
    d = spark.createDataFrame([(f"t{i:02d}", 1, 5 if i < 3 else 1) for i in range(40)], "term string, df long, total long")
    got = {r.term for r in FT.vocabulary(d, 10).collect()}
    assert got == {f"t{i:02d}" for i in range(10)}


def test_ablation_arms_and_saved_model(spark, tmp_path):
    c = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("label"))
    word = F.when(F.col("label") == 1, "sure great day").otherwise("this is fine")
    c = c.select("*", word.alias("x_text"), F.concat(word, F.lit(" aa")).alias("x_full"), F.when(F.col("label") == 1, "xx yy").otherwise("zz").alias("x_emoji"))
    models = ML.train_fusion_ablation(c, max_features=50, max_iter=20)
    assert sorted(models) == ["lr_concat", "lr_emoji_only", "lr_full", "lr_text_only"]
    for name, m in models.items():
        assert all(r.y_true == r.y_pred for r in ML.score(m, c, name).collect())
    path = str(tmp_path / "m")
    ML.save_model(models["lr_concat"], path)
    a, b = ({r.id: r.p for r in ML.score(m, c, "x").collect()} for m in (models["lr_concat"], ML.load_model(path)))
    assert a == b


def test_configs_in_yaml(spark):
    doc = ("---\n# comment\nmodel_type: gated_fusion\npretrained_name: 'roberta-base'   # quoted\nmax_len: 128\nlr: 2e-5\nepochs: \"4\"\n"
           "seed: 42 # last\nrun_name: \"a # \\\"b\\\"\"\ntext_col: it''s\nemoji_col: ~\nbatch_size:\ntrain_label_counts: {\"0\": 3, \"1\": 4}\n")
    r = RN.parse_configs(spark.createDataFrame([(doc,)], "raw string")).first()
    assert (r.model_type, r.pretrained, r.max_len, r.lr, r.epochs, r.seed) == ("gated_fusion", "roberta-base", 128, 2e-5, 4, 42)
    assert (r.run, r.text_col, r.emoji_col, r.batch_size, r.train_label_counts) == ('a # "b"', "it''s", None, None, {"0": 3, "1": 4})


@pytest.mark.parametrize("raw", ['{"run_name": "x", "lr": "fast"}', "run_name: x\nlr: fast\n", "run_name: x\nepochs: 2.5\n", "run_name: x\n  nested: 1\n"])
def test_bad_numbers_fail_by_field(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    with pytest.raises(Exception, match="lr is no|epochs is no|nested"):
        RN.parse_configs(df).collect()
    if "nested" not in raw:
        row = RN.parse_configs(df, strict=False).first()
        assert row.run == "x" and row.lr is None and row.epochs is None
