from tallyfield.llm import chat_format as cf


def test_prefix_prompt_and_masks(spark):
    turns = [
        (1, 0, "user", "hi", 9), (1, 1, "assistant", "yes", 9), (1, 2, "user", "more", 9), (1, 3, "assistant", "ok", 9),
        (2, 0, "user", "hi", 9), (2, 1, "assistant", "yes", 9), (2, 2, "user", "other", 9),
        (3, 0, "user", None, 9), (4, 0, "user", "", 9), (4, 1, None, "x", 9), (None, 0, "user", "hi", 9), (5, None, "user", "hi", 9),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, pair_id int")
    pairs = cf.opening_pairs(df)
    got = {r.pair_id: r for r in cf.format_pairs(df, pairs).collect()}
    assert set(got) == {1, 3}
    one = got[1]
    assert (one.chosen_id, one.rejected_id, one.n_shared) == (1, 2, 2)
    assert one.prompt == "<|user|>\nhi\n<|assistant|>\nyes\n"
    assert (one.chosen, one.chosen_mask) == ("<|user|>\nmore\n<|assistant|>\nok\n", "01")
    assert (one.rejected, one.rejected_mask) == ("<|user|>\nother\n", "0")
    assert (got[3].chosen_id, got[3].n_shared, got[3].rejected, got[3].chosen_mask) == (4, 1, "", "0")
    assert cf.format_pairs(df.limit(0), pairs).count() == 0


def test_equal_conversations_and_one_alone(spark):
    df = spark.createDataFrame([(i, 0, "user", "same") for i in range(5)], "conv_id long, turn int, role string, text string")
    got = cf.format_pairs(df, cf.opening_pairs(df)).collect()
    assert len(got) == 2 and all(r.n_shared == 1 and r.chosen == r.rejected == "" for r in got)
