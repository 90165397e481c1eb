"""Small hand-computed cases: ties, unseen keys, empty groups and known oddities."""

import math

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import columns as C
from tarnfold.operators import encode, ensemble, geo, metrics, ordering, stats, text, windows


def values(df, column, key="id"):
    return [r[column] for r in df.orderBy(key).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pct_rank_averages_ties(spark):
    df = frame(spark, [(1, "g", 1.0), (2, "g", 2.0), (3, "g", 2.0), (4, "g", 4.0), (5, "g", None)], "id long, g string, x double")
    assert values(windows.group_pct_rank(df, "g", "x"), "x_rank") == [0.25, 0.625, 0.625, 1.0, None]


def test_rank_against_both_directions(spark):
    ref = frame(spark, [(i, "g", float(i)) for i in (1, 2, 3, 4)], "id long, g string, x double")
    df = frame(spark, [(1, "g", 2.0), (2, "other", 2.0)], "id long, g string, x double")
    assert values(windows.rank_against(df, ref, "g", "x"), "x_rank") == [0.5, None]
    assert values(windows.rank_against(df, ref, "g", "x", direction="greater"), "x_rank") == [0.5, None]


def test_single_row_group_has_no_zscore(spark):
    df = frame(spark, [(1, "a", 1.0), (2, "b", 1.0), (3, "b", 3.0)], "id long, g string, x double")
    z = values(windows.group_zscore(df, "g", ["x"]), "x_z")
    assert z[0] is None and z[1] == pytest.approx(-1 / (math.sqrt(2) + 0.01))


def test_unseen_group_has_no_zscore(spark):
    train = frame(spark, [(1, "a", 1.0), (2, "a", 3.0)], "id long, g string, x double")
    test = frame(spark, [(1, "a", 2.0), (2, "new", 2.0)], "id long, g string, x double")
    fitted = windows.fit_group_stats(train, "g", ["x"])
    assert values(windows.apply_group_zscore(test, fitted, "g", ["x"]), "x_z") == [0.0, None]


def test_target_encoding_of_a_key_in_one_fold_is_the_mean(spark):
    df = frame(spark, [(1, "only", 1, 0), (2, "k", 0, 0), (3, "k", 1, 1), (4, "k", 0, 1)], "id long, k string, y int, fold int")
    out = values(encode.target_encode_oof(df, ["k"], "y", m=20.0), "k_te")
    assert out[0] == pytest.approx(0.5)
    assert out[1] == pytest.approx((1 + 20 * 0.5) / 22)


def test_target_encoding_value_and_fallback(spark):
    rows = [(i, "k", i % 2) for i in range(4)] + [(i, "z", 0) for i in range(4, 8)]
    train = frame(spark, rows, "id long, k string, y int")
    fitted = encode.fit_target_encoding(train, ["k"], "y", 20.0)
    test = frame(spark, [(1, "k"), (2, "never"), (3, None)], "id long, k string")
    out = values(encode.apply_target_encoding(test, fitted, ["k"]), "k_te")
    assert out == pytest.approx([(2 + 5) / 24, 0.25, 0.25])


def test_bins_are_right_closed(spark):
    df = frame(spark, [(1, 0.0), (2, 5.0), (3, 5.1), (4, 150.0), (5, 151.0)], "id long, x double")
    labels = ("new", "young", "mid", "old", "ancient")
    out = df.select("id", C.bucketize("x", (0, 5, 15, 30, 50, 150), labels).alias("b"))
    assert values(out, "b") == [None, "new", "young", "ancient", None]


def test_combo_key_keeps_missing_parts(spark):
    df = frame(spark, [(1, "a", None), (2, "a", "b")], "id long, x string, y string")
    assert values(df.select("id", C.combo_key(["x", "y"]).alias("k")), "k") == ["a_nan", "a_b"]


def test_indicator_of_a_missing_value_is_zero(spark):
    df = frame(spark, [(1, "Gas"), (2, None)], "id long, f string")
    assert values(C.one_hot(df, "f", ["Gas"]), "is_gas") == [1, 0]


def test_safe_ratio_does_not_fail_on_zero(spark):
    df = frame(spark, [(1, 1.0, -0.5)], "id long, a double, b double")
    assert values(df.select("id", C.safe_ratio("a", "b", 0.5).alias("r")), "r") == [None]


def test_exact_quantiles_interpolate(spark):
    df = frame(spark, [(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "x double")
    row = ordering.exact_quantiles(df, ["x"], [0.0, 0.5, 0.75, 1.0]).first()
    assert (row.q0, row.q1, row.q2, row.q3) == (1.0, 2.0, 4.0, 10.0)


def test_adjusted_skew(spark):
    df = frame(spark, [(float(v),) for v in (1, 2, 2, 3, 10)], "x double")
    assert df.agg(stats.skew("x").alias("s")).first().s == pytest.approx(2.0286991)


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, [(1.0, 0), (1.0, 1)], "x double, y int")
    assert stats.corr_with(df, ["x"], "y").first()["corr"] is None


def test_flat_histogram_has_a_unit_range(spark):
    df = frame(spark, [(3.0,), (3.0,)], "x double")
    rows = stats.histogram(df, ["x"], 2).orderBy("bin").collect()
    assert [(r.left_edge, r.n) for r in rows] == [(2.5, 0), (3.0, 2)]


def test_auc_and_ap_with_ties(spark):
    df = frame(spark, [(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)], "y int, score double")
    row = metrics.ranking_scores(df).first()
    assert row.auc == pytest.approx(0.875) and row.ap == pytest.approx(0.8333333)
    flipped = metrics.roc_auc(df.withColumn("score", -F.col("score"))).first().auc
    assert row.auc + flipped == pytest.approx(1.0)


def test_one_class_has_no_auc(spark):
    df = frame(spark, [(1, 0.5), (1, 0.6)], "y int, score double")
    row = metrics.ranking_scores(df).first()
    assert row.auc is None and row.ap == 1.0


def test_f1_of_a_class_never_predicted_is_zero(spark):
    df = frame(spark, [(0, 0), (1, 0), (2, 2)], "y int, pred int")
    f1 = {r["class"]: r.f1 for r in metrics.f1_per_class(df, [0, 1, 2, 3]).collect()}
    assert f1 == {0: pytest.approx(2 / 3), 1: 0.0, 2: 1.0, 3: 0.0}
    assert metrics.weakest_two_f1(df, [0, 1, 2, 3]).first().weakest_two == 0.0


def test_mean_of_the_two_weakest(spark):
    f1s = frame(spark, [(0.9,), (0.2,), (0.5,), (0.4,)], "f1 double")
    assert metrics.weakest_two(f1s).first().weakest_two == pytest.approx(0.3)


def test_argmax_takes_the_first_of_equals(spark):
    df = frame(spark, [(1, [0.4, 0.4, 0.1, 0.1])], "id long, p array<double>")
    pred = df.select("id", ensemble.weighted_argmax("p", [1.0] * 4).alias("c"))
    assert values(pred, "c") == [0]


def test_weighted_mean_of_probabilities(spark):
    df = frame(spark, [(1, [1.0, 0.0], [0.0, 1.0])], "id long, a array<double>, b array<double>")
    out = df.select("id", ensemble.weighted_proba(["a", "b"], [3, 1]).alias("p"))
    assert values(out, "p") == [[0.75, 0.25]]


def test_best_config_takes_the_first_of_equals(spark):
    board = frame(spark, [(0, 0.1), (1, 0.7), (2, 0.7)], "config_id long, score double")
    assert stats.best_config(board, "score", "config_id").first().config_id == 1


def test_folds_are_balanced_in_every_class(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    for y in (0, 1):
        sizes = [
            r["count"] for r in windows.stratified_folds(df, "y", 5).filter(f"y = {y}").groupBy("fold").count().collect()
        ]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_sample_has_the_asked_size(spark):
    df = spark.range(1000)
    assert windows.seeded_sample(df, 37).count() == 37
    assert windows.seeded_sample(df, fraction=0.25).distinct().count() == 250


KEYWORDS = {
    "cancel_order": {"en": ["cancel"], "de": ["stornier"]},
    "request_refund": {"en": ["refund"], "de": ["erstattung"]},
}


def test_english_keywords_count_three_in_english(spark):
    df = frame(
        spark,
        [(1, "A REFUND please", "en"), (2, "refund, Erstattung", "de"), (3, "nada", "es"), (4, "refund", "xx"), (5, None, "en")],
        "id long, text string, lang string",
    )
    dictionary = text.weighted_dictionary(text.dictionary_frame(spark, KEYWORDS))
    out = text.keyword_classify(df, dictionary).orderBy("id").collect()
    assert [(r.label, r.score) for r in out] == [
        ("request_refund", 3.0), ("request_refund", 3.0), (None, 0.0), ("request_refund", 1.0), (None, 0.0),
    ]


def test_keyword_tie_goes_to_the_first_label(spark):
    df = frame(spark, [(1, "cancel refund", "en")], "id long, text string, lang string")
    dictionary = text.weighted_dictionary(text.dictionary_frame(spark, KEYWORDS))
    assert text.keyword_classify(df, dictionary).first().label == "cancel_order"


def test_learned_words_skip_accented_and_short_ones(spark):
    df = frame(spark, [("café the big big ab dog2", "x")], "text string, label string")
    rows = text.learn_keywords(df).collect()
    assert [(r.word, r.n, r["rank"]) for r in rows] == [("big", 2, 1)]


def test_translation_keeps_the_length_rule(spark):
    df = frame(spark, [(1, "Cancel  my (order) order!")], "id long, text string")
    assert values(df.select("id", text.dictionary_translate("text", "de").alias("t")), "t") == [
        "stornieren my bestellungr) bestellung!"
    ]


def test_pattern_rules_in_order(spark):
    labels = frame(spark, [("cancel_order",), ("delete_account",), ("aaa",)], "label string")
    df = frame(spark, [(1, "remove my compte"), (2, "please stop"), (3, "nothing")], "id long, text string")
    assert values(text.pattern_fallback(df, labels), "label") == ["delete_account", "cancel_order", "aaa"]


def test_label_matching(spark):
    labels = frame(spark, [("cancel_order",), ("track_order",), ("get_refund",)], "label string")
    df = frame(
        spark,
        [(1, " Track Order "), (2, "the cancel-order intent"), (3, "refund_please_get"), (4, "zzz"), (5, "")],
        "id long, response string",
    )
    assert values(text.match_label(df, labels), "label") == [
        "track_order", "cancel_order", "cancel_order", "cancel_order", "cancel_order",
    ]
    assert values(text.match_label(df, labels, mode="overlap"), "label")[2] == "get_refund"


POINT = "id long, latitude double, longitude double, c string, x double, y int"


def test_isolated_point(spark):
    df = frame(spark, [(1, 0.0, 0.0, "a", 1.0, 1), (2, 50.0, 50.0, "a", 2.0, 0)], POINT)
    row = geo.neighbor_features(df, None, [(5, 200)]).orderBy("id").first()
    assert row.nn5_max200_target_mean is None and row.nn5_max200_count == 0 and row.nn5_max200_dist_mean is None


def test_pairs_cross_the_date_line_and_the_pole(spark):
    df = frame(
        spark,
        [(1, 0.0, 179.9, "a", 1.0, 1), (2, 0.0, -179.9, "a", 1.0, 0), (3, 89.9, 0.0, "a", 1.0, 0), (4, 89.9, 180.0, "a", 1.0, 1)],
        POINT,
    )
    pairs = {(r.id, r.n_id): r.km for r in geo.radius_join(df, df, 50.0, exclude_self=True).collect()}
    assert set(pairs) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert pairs[(1, 2)] == pytest.approx(22.24, abs=0.01)


def test_combined_order_differs_from_distance_order(spark):
    df = frame(
        spark,
        [(1, 0.0, 0.0, "a", 0.0, 0), (2, 0.0, 0.1, "b", 0.0, 1), (3, 0.0, 1.0, "a", 0.0, 0)],
        POINT,
    )
    mixed = geo.neighbor_features(df, None, [(1, 200)], ["c"], [], 1.0, 1.0, 0.0).filter("id = 1").first()
    plain = geo.neighbor_features(df, None, [(1, 200)]).filter("id = 1").first()
    assert mixed.nn1_max200_target_mean == 0.0 and plain.nn1_max200_target_mean == 1.0


def test_prompt_lists_all_labels_unless_asked(spark):
    from tarnfold.operators import text

    labels = spark.createDataFrame([(f"label{n:03d}",) for n in range(80)], "label string")
    rows = spark.createDataFrame([(1, "hola", "es")], "id int, text string, lang string")
    every = text.render_prompt(rows, labels, "A\n", "\n", "\n").first().prompt
    some = text.render_prompt(rows, labels, "A\n", "\n", "\n", first_labels=30).first().prompt
    assert every.count("- label") == 80 and some.count("- label") == 30 and "label029" in some


def test_mapper_gets_only_the_rows_of_its_language(spark):
    from pyspark.sql import functions as F

    from tarnfold.operators import text

    rows = spark.createDataFrame(
        [(n, f"text {n}", "de" if n % 10 == 0 else ("fr" if n % 10 == 1 else None if n % 10 == 2 else "en")) for n in range(1000)],
        "id int, text string, lang string",
    )

    sent = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def reversed_text(texts):
        sent.add(len(texts))
        return texts.str[::-1]

    got = text.route_by_language(rows, {"de": reversed_text}).collect()
    assert len(got) == 1000
    assert all(r.routed == (r.text[::-1] if r.lang == "de" else r.text) for r in got)
    assert sent.value == 100


def test_null_groups_keep_their_share(spark):
    from tarnfold.operators import stats

    rows = spark.createDataFrame([(None if n < 4 else "a", n % 2, float(n)) for n in range(12)], "g string, y int, x double")
    shares = {(r.g, r.y): r.share for r in stats.class_distribution(rows, "y", ["g"]).collect()}
    assert shares == {(None, 0): 0.5, (None, 1): 0.5, ("a", 0): 0.5, ("a", 1): 0.5}
    boxes = {r.g: (r.n, r.q25, r.median, r.q75) for r in stats.box_stats(rows, ["x"], "g").collect()}
    assert boxes == {None: (4, 0.75, 1.5, 2.25), "a": (8, 5.75, 7.5, 9.25)}
