"""Literal cases for texts, messages, answers, names and token arrays."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from reasonset.functions import answers, arrays, messages, names, prompts, schedule, text

THINK = re.compile(r"<think>(.*?)</think>", re.DOTALL)


def test_strip_like_python(one):
    values = ["\n a \t", " x ", "", "  ", "\x1c b\x85", "plain", "é😀 "]
    assert one(text.strip, values) == [v.strip() for v in values]
    assert one(text.rstrip, values) == [v.rstrip() for v in values]


def test_split_reasoning(one):
    values = [
        "plain  ", "<think> a </think> b ", "before <think>x</think> after", "<think>open", "</think><think>",
        "<think>1</think>mid<think>2</think>end", "<think>line\nbreak</think>\n\nout", "</think> <think>a</think>b", "",
        "é😀<think>ü</think>😀",
    ]
    expected = []
    for v in values:
        m = THINK.search(v)
        expected.append((m.group(1).strip(), v[m.end():].strip()) if m else ("", v.strip()))
    assert [tuple(r) for r in one(text.split_reasoning, values)] == expected


def test_split_reasoning_multi(one):
    cases = {
        " plain ": (None, " plain "),
        "<think> a </think> b ": ("a", "b"),
        "x <thinking>a</thinking> b": ("a", "x  b"),
        "<|thinking|>a\nb<|/thinking|>c": ("a\nb", "c"),
        "<thinking>t</thinking><think>a</think>r": ("a", "<thinking>t</thinking>r"),
        "<think>1</think>m<think>2</think>": ("1", "m"),
        "<think>open <thinking>t</thinking>": ("t", "<think>open"),
    }
    assert [tuple(r) for r in one(text.split_reasoning_multi, list(cases))] == list(cases.values())


def test_cut_and_brief(one):
    values = ["a" * 80, "a" * 81, " a\nb ", "\n\n"]
    assert one(text.brief, values) == ["a" * 80, "a" * 80 + "...", "a b", ""]
    values = ["x" * 500, "x" * 501]
    assert one(lambda v: text.cut(v, 500), values) == ["x" * 500, "x" * 500 + "..."]


def test_json_string(one):
    values = ["plain", 'q"\\/', "é😀\n\x01\x7f", "", None]
    assert one(text.json_string, values) == [json.dumps(v) for v in values]


def test_stats_key(spark):
    from reasonset.sinks.writers import stats_key

    filters = [
        {"source": "a/b", "domain": None, "difficulty_min": "null", "difficulty_max": "8"},
        {"source": "é", "domain": "all", "difficulty_min": None, "difficulty_max": None},
    ]
    rows = spark.createDataFrame(filters, "source string, domain string, difficulty_min string, difficulty_max string")
    found = [r["stats_key"] for r in stats_key(rows).collect()]
    assert found == [hashlib.md5(json.dumps(f, sort_keys=True).encode()).hexdigest() for f in filters]


MESSAGES = [
    [("system", "be kind"), ("user", "abcd"), ("assistant", "abc"), ("assistant", "abcdefg")],
    [("human", "é😀xy"), ("gpt", "")],
    [("system", "abcdefg")],
    [],
    None,
]


def test_messages(one):
    dtype = messages.MESSAGES
    assert one(messages.total_tokens, MESSAGES, dtype) == [1 + 1 + 0 + 1, 1, 1, 0, 0]
    assert one(messages.browse_tokens, MESSAGES, dtype) == [(7 + 4 + 3 + 7) // 4, 1, 1, 0, 0]
    assert one(lambda m: messages.first_text(m, ["gpt", "assistant"]), MESSAGES, dtype) == ["abc", "", "", "", ""]
    assert one(messages.preview, MESSAGES, dtype) == [
        "abcd", "é😀xy", "No user message found", "No conversation", "No conversation",
    ]
    marked = one(messages.mark_target, MESSAGES, dtype)
    assert [[m["is_target"] for m in c] for c in marked[:4]] == [
        [False, False, False, True], [False, True], [True], [],
    ]
    assert [m["role"] for m in marked[0]] == ["assistant", "user", "assistant", "assistant"]


def test_decode_messages(spark):
    from reasonset.sources.corpus import decode_messages

    texts = [
        '[{"from": "human", "value": "q"}, {"role": "assistant", "content": "a"}]',
        '[{"role": "user", "content": null}, {"value": "x"}]',
        "[]",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "conversations string")
    found = [[tuple(m) for m in r["messages"]] for r in decode_messages(rows).collect()]
    assert found == [[("human", "q"), ("assistant", "a")], [("user", ""), ("", "x")], []]
    nested = spark.createDataFrame([([("human", "q")],)], "conversations array<struct<`from`:string,value:string>>")
    assert [tuple(m) for m in decode_messages(nested).first()["messages"]] == [("human", "q")]


ANSWERS = {
    r"first \boxed{1} then \boxed{2}": "2",
    r"\boxed{\text{12}}": r"\text{12}",
    # Two levels of inner braces do not match the nested pattern; the simple one stops early.
    r"\boxed{\frac{1}{\sqrt{2}}}": r"\frac{1",
    "so\nanswer:  7 \nAnswer: 8": "8",
    r"\boxed{}": "",
    "no answer": "",
    r"ANSWER: 3 and \boxed{ 4 }": "4",
}


def test_extract_answer(one):
    assert one(answers.extract_answer, list(ANSWERS)) == list(ANSWERS.values())


@pytest.mark.parametrize(
    ("answer", "target", "agree"),
    [
        ("1,024", "1024", True), ("$7$", "7", True), ("007", "7", True), ("+7", "7", True), ("-3", "3", False),
        ("x=5", "5", True), ("-0", "0", True), ("9" * 40, "0" + "9" * 40, True), ("9" * 40, "9" * 39 + "8", False),
        ("", "", True), ("abc", "abc", True), ("abc", "abd", False), ("a-5b6", "-5", True), ("--5", "-5", True),
        ("000", "0", True), ("+-4", "-4", True), ("", "0", False), ("x", "0", False), ("line\n12", "12", True),
    ],
)
def test_same_answer(one, answer, target, agree):
    assert one(lambda v: answers.same_answer(v, F.lit(target)), [answer]) == [agree]


def test_normalise_answer(one):
    assert one(answers.normalise_answer, ["$1,0$", " x ", "a+12b", "-7"]) == ["10", "x", "+12", "-7"]


def test_letters(one):
    values = [r"\boxed{A} or \boxed{B}", r"\boxed{a}", r"\boxed{AB}", r"x \boxed{D}", ""]
    assert one(answers.extract_letter, values) == ["A", "", "", "D", ""]


def test_extract_code(one):
    cases = {
        "```python\na\n``` and ```\nb\n```": "b\n",
        "```\n\n``` x": "\n",
        "no fence": None,
        "```py\n<code>x = 1</code> tail\n```": "x = 1",
        "```\n```": None,
        "```python3\nx\n```": None,
    }
    assert one(answers.extract_code, list(cases)) == list(cases.values())


def test_outputs(one):
    assert one(answers.expected_output, [" 1 2 -", "a-b ", "-", "x - \n", "a--"]) == ["1 2", "a-b", "", "x", "a-"]
    assert one(lambda v: answers.same_output(v, F.lit("5 -")), ["5\n", " 5", "5 -"]) == [True, True, False]


def test_reward(one):
    solution = F.lit("We add 1,000 and 24.\n#### 1,024")
    values = [r"so \boxed{1024}", r"so \boxed{1,024}", "1024", r"\boxed{}", r"\boxed{1} no \boxed{01024}"]
    assert one(lambda v: answers.reward(v, solution), values) == [1.0, 1.0, 0.0, 0.0, 1.0]
    assert one(lambda v: answers.reward(v, F.lit("no mark")), [r"\boxed{1}"]) == [0.0]


def test_names(one):
    name = "corpus_code_all_sources_t4096_n1000_s0.9_bs32_lr1e-05_e13_Org_Net-4B-Instruct-2507"
    with_parts = name.replace("_e13_", "_e13_r32_cgrouped_shuffle_")
    found = one(names.run_config, [name, with_parts, "something else"])
    legacy, current, other = (r.asDict() for r in found)
    assert legacy == {
        "dataset": "corpus_code_all_sources_t4096_n1000", "train_split": 0.9, "batch_size": 32, "learning_rate": 1e-05,
        "epochs": 13, "rank": None, "curriculum": "none", "model": "Org/Net-4B-Instruct-2507",
    }
    assert current == {**legacy, "rank": 32, "curriculum": "grouped_shuffle"}
    assert set(other.values()) == {None}
    assert one(names.max_tokens_of, [legacy["dataset"], "x"]) == [4096, None]


def test_run_keys(one):
    paths = [
        "file:/a/cfg/20250101_000000/choice/step_000020/r.jsonl", "file:/a/cfg/1/code/r.jsonl",
        "file:/a/cfg/1/code/step_x/r.jsonl", "hdfs://h/out/config=c%20d/run=r1/eval=code/step=5/part-0.json",
        "hdfs://h/out/config=c%252Fd/run=r+1/eval=code/step=-1/part-0.json",
    ]
    assert [tuple(r) for r in one(names.run_keys, paths)] == [
        ("cfg", "20250101_000000", "choice", 20), ("cfg", "1", "code", -1), ("cfg", "1", "code", None),
        ("c d", "r1", "code", 5), ("c/d", "r+1", "code", -1),
    ]


def test_model_names(one):
    paths = ["logs/corpus_all_t1_s0.9_Org_Net-8B/comparisons/s.txt", "logs/other_a_b/s.txt", "corpus_x/y"]
    assert one(names.model_name, paths) == ["Org/Net-8B", "Unknown", "Unknown"]
    assert one(names.model_type, ["a-Instruct-1", "a-Base", "a"]) == ["Instruct", "Base", "Full"]


def test_options(spark):
    rows = spark.createDataFrame([("q", ["a", "b", "a", "c"], "a")], "q string, o array<string>, c string")
    shuffled = prompts.shuffle_options(F.col("q"), F.col("o"))
    first = rows.select(shuffled.alias("s"), prompts.answer_letter(shuffled, F.col("c")).alias("l")).first()
    assert sorted(first["s"]) == ["a", "a", "b", "c"]
    assert "ABCD".index(first["l"]) == first["s"].index("a")


def test_schedule(one):
    found = one(lambda s: schedule.lr_multiplier(s, 20), list(range(21)), "bigint")
    assert found[:3] == [0.0, 0.5, 1.0] and found[-1] == pytest.approx(0)
    assert one(lambda s: schedule.lr_multiplier(s, 5), [0], "bigint") == [1.0]
    assert one(lambda s: schedule.due(s, 0), [0], "bigint") == [False]


def test_training_arrays(spark):
    rows = spark.createDataFrame([([5, 6, 7, 8], 2, [0.5, 0.25], 1.5), ([5, 6, 7], 2, [0.5, 0.5], 1.0)],
                                 "t array<int>, p int, l array<double>, a double")
    found = rows.select(arrays.training_arrays(*[F.col(c) for c in "tpla"]).alias("x")).select("x.*").collect()
    good, bad = found
    assert (good["inputs"], good["targets"]) == ([5, 6, 7], [6, 7, 8])
    assert (good["logprobs"], good["advantages"], good["lengths_ok"]) == ([0.0, 0.5, 0.25], [0.0, 1.5, 1.5], True)
    assert not bad["lengths_ok"]
