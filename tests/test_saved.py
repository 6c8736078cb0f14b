"""Round trips through files, plans that write, and the metrics stream."""

import json

import pytest
from pyspark.sql import functions as F

from reasonset.functions import messages
from reasonset.operators import corpus, turns
from reasonset.plans.statistics import precompute
from reasonset.plans.subsets import generate_subset, validate
from reasonset.session import saved_once, shared_folder
from reasonset.sinks import writers
from reasonset.sources import results, saved
from reasonset.sources.corpus import decode_messages, read_corpus
from reasonset.streaming.metrics import current_metrics, log_metrics


def nested(spark, sf_dir):
    import workload.views as views

    examples = views.conv_examples(spark, sf_dir)
    return examples.join(turns.nest_turns(views.marked_turns(spark, sf_dir)), "id")


def test_nested_and_long_forms_agree(spark, sf_dir):
    import workload.views as views

    df, long = nested(spark, sf_dir), views.marked_turns(spark, sf_dir)

    def rows(frame, *columns):
        return sorted(map(tuple, frame.select("id", *columns).collect()))

    tokens = ("_total_tokens", "_assistant_tokens")
    assert rows(corpus.with_tokens(df), *tokens) == rows(turns.with_tokens(long), *tokens)
    shown = ("difficulty", "source", "domain", "tokens", "preview")
    key = str
    assert sorted(rows(corpus.browse_table(df), *shown), key=key) == sorted(
        rows(turns.browse_table(views.conv_examples(spark, sf_dir), long), *shown), key=key
    )
    marked = df.select("id", F.posexplode(messages.mark_target(F.col("messages"))).alias("turn", "m")).select("id", "turn", "m.*")
    assert rows(marked, "turn", "role", "text", "is_target") == rows(turns.mark_target(long), "turn", "role", "text", "is_target")
    chosen = corpus.make_subset(df, 700, 30, 400).select("id")
    of_turns = corpus.make_subset_of_turns(views.conv_examples(spark, sf_dir), long, 700, 30, 400).select("id")
    assert rows(chosen) == rows(of_turns) and len(rows(chosen)) == 30


def test_a_conversation_is_one_row(spark):
    df = spark.range(25_000).select(F.lit(1).alias("id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = turns.nest_turns(df).collect()
    assert [[m["text"] for m in r["messages"]] for r in rows] == [[str(i) for i in range(25_000)]]
    examples = spark.createDataFrame([(1, "s", "d", 1), (2, "s", "d", 1)], "id int, source string, domain string, difficulty int")
    assert corpus.make_subset_of_turns(examples, df, 10**6, 1).count() == 1


def test_corpus_without_ids(spark, tmp_path):
    stored = [(f"s{i % 2}", "d", i % 3, [("human", f"question {i}"), ("gpt", "a" * 40)]) for i in range(40)]
    schema = "source string, domain string, difficulty int, conversations array<struct<`from`:string,value:string>>"
    spark.createDataFrame(stored, schema).coalesce(1).write.parquet(str(tmp_path / "corpus"))
    df = decode_messages(read_corpus(spark, str(tmp_path / "corpus"), order_key=True))
    stored_order = ("file_name", "row_index")
    subset = corpus.make_subset(df, 4096, 5, source="s1", key=stored_order)
    assert sorted(m[0]["text"] for m in (r["messages"] for r in subset.collect())) == sorted(f"question {i}" for i in (1, 3, 5, 7, 9))
    shown = corpus.page(df.select(*stored_order, "difficulty"), 2, 15, key=stored_order).collect()
    assert [r["row_index"] for r in shown] == list(range(15, 30))


def test_scan_cap(spark, sf_dir):
    df = nested(spark, sf_dir)
    first = {r["id"] for r in df.orderBy("id").limit(20).collect()}
    capped = {r["id"] for r in corpus.make_subset(df, 700, 100, scan_cap=20).collect()}
    assert capped == {r["id"] for r in corpus.with_tokens(df).filter("_total_tokens <= 700").collect()} & first


def test_generate_subset(spark, sf_dir, tmp_path):
    df = nested(spark, sf_dir)
    root = str(tmp_path / "subsets")
    name = generate_subset(df, root, 900, 7, source="src1", base_dataset="base", created_at="2025-01-01T00:00:00")
    assert name == "corpus_all_domains_src1_t900_n7"
    rows = saved.read_subset(spark, root, name).collect()
    assert 0 < len(rows) <= 7 and {r["source"] for r in rows} == {"src1"}
    other = generate_subset(df, root, 700, 5)
    assert generate_subset(df, root, 0, 5, source="src2") is None
    meta = {r["name"]: r for r in saved.read_catalog(spark, root).collect()}
    assert set(meta) == {name, other}
    assert meta[name]["stats"]["total_rows"] == len(rows) and meta[name]["filters"]["max_assistant_tokens"] is None
    assert meta[name]["stats"]["avg_total_tokens"] == pytest.approx(sum(r["_total_tokens"] for r in rows) / len(rows))
    texts = list((tmp_path / "subsets" / "samples" / f"subset={name}").glob("sample=*/*.txt"))
    assert len(texts) == len(rows) and texts[0].read_text().startswith("# Sample ")
    report = writers.catalog_report(saved.read_catalog(spark, root), "corpus_all_domains_").collect()
    assert [r["config_name"] for r in report] == ["all_sources_t700_n5", "src1_t900_n7"]


def test_validate(spark):
    options = spark.createDataFrame([(["a"], ["x"])], "sources array<string>, domains array<string>")
    validate(options, "a", "all")
    with pytest.raises(ValueError, match="unknown source"):
        validate(options, "b")


def test_absent(spark, tmp_path):
    assert saved.read_subset(spark, str(tmp_path), "none") is None
    assert saved.read_stats(spark, str(tmp_path)) is None


def test_precompute_keeps_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 6), ("b", "y", None)], "source string, domain string, difficulty int")
    root = str(tmp_path)
    assert precompute(df, root).count() == 9
    more = df.union(spark.createDataFrame([("c", "x", 1)], df.schema))
    assert precompute(more, root).count() == 9
    assert precompute(more, root, force=True).count() == 12


def test_results_in_the_stored_layout(spark, tmp_path):
    def put(path, *rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")

    sample = {"content": "t", "extracted_answer": "A", "is_correct": True}
    base = tmp_path / "cfg" / "20250101_000000"
    put(base / "choice" / "step_000005" / "choice_results.jsonl",
        {"index": 0, "samples": [sample], "is_correct": True, "step": 5}, {"index": 1, "is_correct": False})
    put(base / "code" / "code_results.jsonl", {"index": 0, "samples": [{"sample_idx": 3, "content": "c", "error": "e"}]})
    put(base / "code" / "step_bad" / "code_results.jsonl", {"index": 9})
    read = results.read_results(spark, str(tmp_path))
    keys = sorted((r["config"], r["run"], r["eval"], r["step"], r["index"]) for r in read.collect())
    assert keys == [("cfg", "20250101_000000", "choice", 5, 0), ("cfg", "20250101_000000", "choice", 5, 1),
                    ("cfg", "20250101_000000", "code", -1, 0)]
    long = {(r["eval"], r["problem"]): r for r in results.explode_samples(read).collect()}
    assert long["choice", 0]["answer"] == "A" and long["choice", 1]["response"] == ""
    assert long["code", 0]["sample_idx"] == 3 and long["code", 0]["is_correct"] is False
    assert long["choice", 1]["sample_idx"] == 0


def test_results_keep_their_verdict_and_broken_lines_fail(spark, tmp_path):
    folder = tmp_path / "cfg" / "20250101_000000" / "code"
    folder.mkdir(parents=True)
    (folder / "code_results.jsonl").write_text('{"index": 2, "is_correct": true, "prompt": "p", "correct_answer": "7"}\n')
    row = results.explode_samples(results.read_results(spark, str(tmp_path))).first()
    assert (row["is_correct"], row["sample_idx"], row["response"], row["prompt"], row["target"]) == (True, 0, "", "p", "7")
    (folder / "more_results.jsonl").write_text('{"index": 3, "is_corr\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read_results(spark, str(tmp_path)).collect()


def test_results_are_one_record_per_problem_and_replaced(spark, tmp_path):
    rows = [("c", "20250101_000000", "code", 1, 7, i, "t", "a", i == 20_000, "") for i in (0, 20_000)]
    samples = spark.createDataFrame(rows, "config string, run string, eval string, step int, problem long, sample_idx long, response string, answer string, is_correct boolean, error string")
    for _ in range(2):
        writers.write_results(samples, str(tmp_path / "out"))
    found = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r["index"], r["pass_at_k"], r["is_correct"], len(r["samples"])) for r in found] == [(7, 2, True, 2)]


def test_empty_subset_replaces_the_old_one(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    writers.write_rows(rows, str(tmp_path), "a b")
    writers.write_rows(rows, str(tmp_path), "other")
    writers.write_rows(rows.limit(0), str(tmp_path), "a b")
    assert {r["subset"] for r in spark.read.parquet(str(tmp_path / "dataset")).collect()} == {"other"}


def test_summaries(spark, tmp_path):
    folder = tmp_path / "corpus_all_t1_Org_Net-8B-Base" / "comparisons"
    folder.mkdir(parents=True)
    (folder / "summary.txt").write_text(
        "r1:\n  Passed: 5/8 (62.5%)\nr2:\n  Passed: 4/8 (50.0%)\nTotal outcome differences found: 1\n"
        "Same outcome, different response: 2 total\n"
    )
    empty = tmp_path / "other" / "comparisons"
    empty.mkdir(parents=True)
    (empty / "summary.txt").write_text("nothing here")
    parsed = results.read_summaries(spark, f"{tmp_path}/*/comparisons/summary.txt")
    found = {r["model"]: r for r in results.summary_table(parsed).collect()}
    base = found["Org/Net-8B-Base"]
    assert (base["model_type"], base["accuracy_range"], base["outcome_flips"], base["identical_pct"]) == ("Base", "50-62%", 1, 62.5)
    assert (found["Unknown"]["accuracy_range"], found["Unknown"]["total_questions"]) == ("N/A", 100)


def test_metrics_stream(spark, tmp_path):
    schema = "run string, step int, metric string, value double, seq int"
    inbox, log = tmp_path / "in", str(tmp_path / "log")
    inbox.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(inbox))
    rows = [[("r", 0, "a", 1.0, 1), ("r", 1, "a", 2.0, 2)], [("r", 0, "a", 3.0, 3), ("r", 1, "a", 9.0, 0)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        query = log_metrics(stream, log, str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    state = current_metrics(spark.read.parquet(log))
    assert sorted(map(tuple, state.collect())) == [("r", 0, "a", 3.0), ("r", 1, "a", 2.0)]


def test_order_key(spark, sf_dir):
    from reasonset.operators.position import block_bucket, with_position

    df = read_corpus(spark, f"{sf_dir}/doc*.parquet", order_key=True)
    assert df.select("file_name", "row_index").distinct().count() == df.count()
    buckets = [F.col("file_name"), block_bucket(F.col("row_index"), 100)]
    keys = df.select("file_name", "row_index")
    placed = with_position(keys, [F.col("row_index")], buckets).orderBy("position").collect()
    assert [r["row_index"] for r in placed] == [r["position"] for r in placed] == list(range(df.count()))


def test_saved_once(spark):
    assert saved_once(spark.range(5).toDF("id"), "t").count() == 5
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
