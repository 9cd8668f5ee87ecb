"""Reply trees with repeated rows and cycles, and token ids of texts that hold added tokens."""

import numpy as np
import pytest

from latticelake.llm import chat, packing, queries

NODES = "tree_id string, node_id long, parent_id long, role string, text string, score double"


def formed(spark, rows, **more):
    return {(r.tree_id, r.leaf_id): [t for _, t in chat.parse(r.formatted)] for r in chat.format_trees(spark.createDataFrame(rows, NODES), **more).collect()}


def test_repeated_rows_count_once(spark):
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 2, "user", "c", 1.0)]
    want = {("t", 3): ["a", "b", "c"]}
    assert formed(spark, rows) == formed(spark, rows + rows[:2] + rows[1:2]) == want
    other = [("t", 2, 1, "assistant", "z", 1.0), ("t", 2, 1, "assistant", "b", 2.0)]
    assert formed(spark, rows + other) == formed(spark, other + rows) == want


def test_cycles_cost_their_own_messages_only(spark):
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 10, 11, "user", "x", 0.0), ("t", 11, 12, "user", "y", 0.0), ("t", 12, 10, "user", "z", 0.0), ("t", 13, 10, "user", "below", 0.0), ("u", 1, 1, "user", "self", 0.0), ("u", 2, 1, "user", "s", 0.0),
            (None, 1, None, "user", "n", 0.0), (None, 2, 1, "user", "m", 0.0), (None, None, 2, "user", "lost", 0.0), ("v" * 70, 5, 99, "user", "orphan", 0.0)]
    assert formed(spark, rows) == {("t", 2): ["a", "b"], (None, 2): ["n", "m"], ("v" * 70, 5): ["orphan"]}
    assert sorted((r.tree_id, r.node_id) for r in chat.cyclic(spark.createDataFrame(rows, NODES)).collect()) == [("t", 10), ("t", 11), ("t", 12), ("t", 13), ("u", 1), ("u", 2)]
    assert chat.cyclic(spark.createDataFrame(rows[:2], NODES)).count() == 0


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "a<|endoftext|>b", "<|ENDOFTEXT|> hi <|StartOfText|>", "<|endoftext|>.", "Hi<|endoftext|>  There, x.<|endoftext|>\n<|startoftext|>", "<|EndOfText|><|endoftext|> A", "", "< |endoftext|>"])
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Some other Text. ", text, "x"]
    got = packing.WordTokenizer(path).encode_batch([t.encode() for t in texts])
    assert [np.asarray(x).tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
