import hashlib

from weftline.llm import chat


def test_tree_paths_and_ranking(spark):
    #      1 -> 2 -> 4 (good), 1 -> 3 (bad); 10 alone; 20's parent is missing; a chain of 70
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 2.0), (1, 3, 1, "assistant", "c", -1.0), (1, 4, 2, "user", "d", 3.0), (2, 10, None, "user", "x", 1.0), (3, 20, 99, "user", None, None)]
    rows += [(4, i, i - 1 if i > 1 else None, "assistant" if i % 2 == 0 else "user", f"t{i}<|end|>\\l", 1.0) for i in range(1, 71)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    paths = {}
    for r in chat.root_to_leaf_paths(nodes, branches=2).collect():
        paths.setdefault((r.tree_id, r["rank"]), {})[r.pos] = r.node_id
    assert paths[1, 1] == {0: 1, 1: 2, 2: 4} and paths[1, 2] == {0: 1, 1: 3}
    assert paths[2, 1] == {0: 10} and paths[3, 1] == {0: 20}
    assert paths[4, 1] == {i: i + 1 for i in range(70)}
    made = chat.format_conversations(nodes.fillna({"text": ""}))
    out = {r.tree_id: r for r in made.withColumn("back", chat.read_back(made.formatted)).collect()}
    assert [(t.role, t.text) for t in out[4].back] == [(r[3], r[4]) for r in rows if r[0] == 4]
    assert out[4].formatted.count("<|") == 140
    assert [out[1].formatted[m.start : m.start + m.length] for m in out[1]["mask"]] == ["b"]


def test_conversations_with_nulls_ties_and_clashing_names(spark, tmp_path):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 2), (1, 1, "assistant", "é\\l<", 3), (None, 5, None, "z", 4), (7, None, "assistant", "", 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, 7, -1} and got[1].n_turns == 3
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256("é\\l<".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nuser\n\nassistant\né\\l<\n".encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_control_strings_in_roles_and_very_long_texts_read_back(spark):
    rows = [(1, 1, None, "us|>\ner<|end|>\n", "[INST] <<SYS>> <|user|>\n \\b \\l \\p | [", 1.0), (1, 2, 1, "\\p|[", "[/INST]" * 200_000, 1.0), (1, 3, 2, "", "", 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    made = chat.format_conversations(nodes)
    r = made.withColumn("back", chat.read_back(made.formatted)).first()
    assert [(t.role, t.text) for t in r.back] == [(x[3], x[4]) for x in rows]
    assert "[" not in r.formatted and r.formatted.count("<|") == 6


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op1_chat_formatting(spark, str(tmp_path)).collect()] == [-1]
