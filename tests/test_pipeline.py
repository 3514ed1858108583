import csv
import json

import pytest
from pyspark.sql import functions as F

from mooring import cli
from mooring.operators import generation as G
from mooring.plans import pipeline, report
from mooring.schemas import METRIC_RECORD, METRIC_ROW, RAW_GENERATION, REQUEST
from mooring.sources import jsonl
from mooring.streaming import generation as stream


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def example(i, methods=("NEU", "SUP", "AUG-SUP", "SSR")):
    text = lambda s: {m: f"{s} {i} {m} the answer of it" for m in methods}
    trace = {m: f"first step {i}\n\nthen {m} the second\n\nof it the third part\n\nand the answer of {m}" for m in methods}
    return {"id": f"r{i}", "questions": text("why"), "answers": text("because"), "contexts": text("ctx"), "reasonings": trace}


def test_jsonl_numbers_and_strictness(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"id": "é"}, "", "  ", {"id": None, "questions": {"B": "1", "A": "2"}})
    got = jsonl.read_jsonl(spark, p, METRIC_ROW, numbered=True).orderBy("line_no").collect()
    assert [(r.line_no, r.row_no, r.id) for r in got] == [(0, 0, "é"), (3, 1, None)]
    keys = jsonl.read_jsonl(spark, p, METRIC_ROW).where("id is null").select(F.map_keys("questions").alias("k")).first().k
    assert keys == ["B", "A"]
    bad = lines(tmp_path / "b.jsonl", {"id": "x"}, "{oops")
    with pytest.raises(Exception, match="line 1"):
        jsonl.read_jsonl(spark, bad, METRIC_ROW, numbered=True).collect()
    assert jsonl.read_jsonl(spark, bad, METRIC_ROW, strict=False).count() == 1


def test_metric_records(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    with pytest.raises(FileNotFoundError):
        jsonl.read_metric_records(spark, str(d))
    lines(d / "metrics_rank0.jsonl", '{"method": "A", "sample_idx": 1, "lexical_anchoring": NaN, "entropy_anchoring": 0.5, "Aprob": -Infinity}')
    lines(d / "valid_data_rank0.jsonl", {"id": 1})
    r = jsonl.read_metric_records(spark, str(d)).collect()
    assert len(r) == 1 and r[0].lexical_anchoring != r[0].lexical_anchoring and r[0].Aprob == float("-inf")
    assert pipeline.metrics_complete(spark, str(d), ["A"]) and not pipeline.metrics_complete(spark, str(d), ["A", "B"])


def test_write_and_append(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, None, 0.5, 0.1)], METRIC_RECORD)
    p = str(tmp_path / "o")
    assert jsonl.write_jsonl(df, p) == 1 and jsonl.append_jsonl(df, p) == 1
    rows = [json.loads(r._line) for r in jsonl.numbered_lines(spark, p).collect()]
    assert len(rows) == 2 and rows[0]["lexical_anchoring"] is None
    assert jsonl.beside("/a/x.metric.jsonl", "rejected.jsonl") == "/a/x.metric.rejected.jsonl" and jsonl.beside("x.jsonl", "summary.json") == "x.summary.json"


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    """Files in the order of their names, whatever their sizes; many splits a file; blank lines count as physical ones."""
    texts = {"b.jsonl": [f"b{i}" if i % 7 else " " for i in range(4000)], "a.jsonl": [f"a{i}" for i in range(40)], "c.jsonl": ["", "c"]}
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    every = [x for name in sorted(texts) for x in texts[name]]
    full = [x for x in every if x.strip()]
    want = [(i, full.index(x), x) for i, x in enumerate(every) if x.strip()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in ((1 << 20, 0), (1000, 0), (3000, 100), (1 << 20, 1 << 22)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            df = jsonl.numbered_lines(spark, str(tmp_path))
            assert sorted(map(tuple, df.collect())) == want, (size, cost)
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_later_appended_rows_win(spark, tmp_path):
    """A later batch wins, be it larger or smaller, also over files written before."""
    p = str(tmp_path / "raw")
    row = lambda i, text: (i, None, "NEU", text, None, None, None, None, None)
    write = lambda rows, f: f(spark.createDataFrame(rows, RAW_GENERATION).coalesce(1), p)
    write([row(0, "FIRST"), row(1, "old")], jsonl.write_jsonl)
    write([row(0, "SECOND")] + [row(i, "x" * 500) for i in range(10, 400)], jsonl.append_jsonl)
    assert {r.row_idx: r.raw_output for r in jsonl.read_completed(spark, p).where("row_idx < 10").collect()} == {0: "SECOND", 1: "old"}
    write([row(0, "THIRD")], jsonl.append_jsonl)
    for n in range(9):
        write([row(0, f"batch {n}"), row(0, f"last {n}")], jsonl.append_jsonl)
    assert {r.row_idx: r.raw_output for r in jsonl.read_completed(spark, p).where("row_idx < 10").collect()} == {0: "last 8", 1: "old"}


def test_records_of_any_fields(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    lines(d / "metrics_rank0.jsonl", {"model": "1", "method": "A", "sample_idx": 1, "Aprob": 0.5, "entropy_anchoring": 0.2, "speed": 3}, {"model": "2", "method": "A", "sample_idx": 2, "Aprob": 1, "entropy_anchoring": 0.9, "note": "x"}, '{"model": "1", "Aprob": NaN, "entropy_anchoring": 0.1}')
    lines(d / "valid_data_rank0.jsonl", {"id": "1", "questions": {"A": "q"}})
    got = pipeline.aggregate_file(spark, str(d), str(tmp_path / "agg.json"), "model")
    assert got["1"] == {"N": 1, "skipped_nan": 1, "means": {"Aprob": 0.5, "entropy_anchoring": 0.2, "speed": 3.0}, "quadrants": {"Reason": 0.0, "Encode": 1.0, "Cloze": 0.0, "Copy": 0.0}}
    assert set(got) == {"1", "2"} and got["2"]["means"] == {"Aprob": 1.0, "entropy_anchoring": 0.9}
    assert set(pipeline.aggregate_file(spark, str(d), str(tmp_path / "b.json"))) == {"A"}
    lines(d / "metrics_rank0.jsonl", {"x": 1})
    assert pipeline.aggregate_file(spark, str(d), str(tmp_path / "agg.json")) == {} == json.loads((tmp_path / "agg.json").read_text())


def test_completed(spark, tmp_path):
    assert jsonl.read_completed(spark, str(tmp_path / "none")).count() == 0
    p = lines(tmp_path / "raw.jsonl", {"row_idx": 0, "method": "NEU", "raw_output": "x"}, {"row_idx": 0, "method": "NEU", "raw_output": "y"}, {"row_idx": 1, "raw_output": "z"})
    assert {(r.row_idx, r.method): r.raw_output for r in jsonl.read_completed(spark, p).collect()} == {(0, "NEU"): "y", (1, "R0"): "z"}


def test_markdown_and_csv():
    assert report.markdown_table(["A", "N"], [["x", 6.25], ["y", 0.35], ["z", 18.75], ["w", 3]]).splitlines()[2:] == ["| x | 6.2 |", "| y | 0.3 |", "| z | 18.8 |", "| w | 3 |"]
    assert report.csv_text(["a", "b"], [["x", 0.1 + 0.2]]) == "a,b\r\nx,0.30000000000000004\r\n"


def test_whole_pipeline_and_its_reuse_rules(spark, tmp_path):
    src = lines(tmp_path / "in.jsonl", *[example(i) for i in range(6)])
    run = tmp_path / "run"
    manifest = pipeline.run(spark, src, str(run))
    assert json.loads((run / "manifest.json").read_text()) == manifest and manifest["input"] == src and manifest["method_metrics"] == f"{run}/metrics/methods"
    text = (run / "report.md").read_text()
    assert "## Zones by method" in text and "## Metrics of the controlled variants" in text
    with (run / "figures" / "methods" / "methods_table1_metrics.csv").open(newline="") as f:
        assert [r["Method"] for r in csv.DictReader(f)] == ["NEU", "SUP", "AUG-SUP", "SSR"]
    made = json.loads((run / "figures" / "controlled" / "controlled_summary.json").read_text())
    assert made["method_order"] == ["Real CoT", "+Prob Anchor", "+Entropy Anchor", "Response as CoT"]
    assert made["summary"]["Response as CoT"]["metrics"]["Alex"] == pytest.approx(100)
    before = (run / "metrics" / "methods").stat().st_mtime
    pipeline.run(spark, src, str(run))
    assert (run / "metrics" / "methods").stat().st_mtime == before
    with pytest.raises(FileExistsError):
        pipeline.run_metrics(spark, str(run / "inputs" / "example.metric.jsonl"), str(run / "metrics" / "methods"), ["other"], None)
    with pytest.raises(FileNotFoundError):
        pipeline.run_metrics(spark, src, str(tmp_path / "nowhere"), ["NEU"], None, skip=True)
    nested = pipeline.aggregate_file(spark, str(run / "metrics" / "methods"), str(tmp_path / "agg.json"))
    assert set(nested) == {"NEU", "SUP", "AUG-SUP", "SSR"} and nested["NEU"]["N"] == 6 and json.loads((tmp_path / "agg.json").read_text()) == nested
    assert "| NEU | 6 | 0 |" in report.aggregate_text(nested) and "check the field names" in report.aggregate_text({})
    bad = lines(tmp_path / "bad.jsonl", example(0), {**example(1), "answers": None})
    with pytest.raises(Exception, match="invalid"):
        pipeline.run(spark, bad, str(tmp_path / "run2"))
    (run / "figures" / "methods" / "methods_table2_zones.md").unlink()
    with pytest.raises(FileNotFoundError):
        report.write_report(spark, str(run))


def test_build_only(spark, tmp_path):
    src = lines(tmp_path / "in.jsonl", example(0), "", example(1))
    raw = lines(tmp_path / "raw.jsonl", *[{"row_idx": 0, "method": m, "raw_output": f"<reason>{m}</reason>"} for m in ("NEU", "SSR")], {"row_idx": 1, "method": "NEU", "raw_output": " "})
    s = pipeline.build_only(spark, src, raw, str(tmp_path / "o.metric.jsonl"), methods=["NEU", "SSR"])
    assert (s["input_rows"], s["complete_rows"], s["rejected_rows"], s["parse_counts"]) == (2, 1, 1, {"tagged": 2, "raw": 1})
    assert json.loads((tmp_path / "o.metric.summary.json").read_text()) == s
    assert json.loads(spark.read.text(s["rejected_output"]).first().value) == {"row_idx": 1, "id": "r1", "missing": ["NEU", "SSR"]}
    s = pipeline.build_only(spark, src, raw, str(tmp_path / "p.jsonl"), mode="r0", methods=["NEU"])
    assert (s["complete_rows"], s["rejected_rows"]) == (1, 1)


def test_generate_goes_on_where_it_ended(spark, tmp_path):
    src, raw = lines(tmp_path / "in.jsonl", example(0), example(1)), str(tmp_path / "raw")
    first = pipeline.generate_missing(spark, src, raw, G.echo_generator, methods=["NEU"])
    again = pipeline.generate_missing(spark, src, raw, G.echo_generator, methods=["NEU", "SSR"])
    assert (first["generated"], again["generated"], again["pending"]) == (2, 2, 2)
    s = pipeline.build_only(spark, src, raw, str(tmp_path / "o.jsonl"), methods=["NEU", "SSR"])
    assert (s["complete_rows"], s["parse_counts"]) == (2, {"tagged": 4})
    cli.main(["generate", "--input", src, "--raw-output", raw, "--mode", "r0", "--method-name", "Q0", "--output", str(tmp_path / "q.jsonl"), "--rejected-output", str(tmp_path / "bad"), "--summary-output", str(tmp_path / "sum.json")])
    assert jsonl.read_completed(spark, raw).where("method = 'Q0'").count() == 2
    assert json.loads((tmp_path / "sum.json").read_text())["complete_rows"] == 2 and (tmp_path / "bad").exists()


def test_a_failure_costs_one_wave(spark, tmp_path):
    src, raw = lines(tmp_path / "in.jsonl", *[example(i) for i in range(12)]), str(tmp_path / "raw")
    flag = tmp_path / "down"
    last = max(range(12), key=lambda i: spark.range(1).select(F.pmod(F.xxhash64(F.lit(i), F.lit("R0")), F.lit(4)).alias("w")).first().w)

    def failing():
        echo = G.echo_generator()

        def run(prompts):
            if flag.exists() and any(f"why {last} NEU" in p for p in prompts):
                raise RuntimeError("engine is down")
            return echo(prompts)

        return run

    assert any(f"why {last} NEU" in r.prompt for r in G.r0_requests(pipeline._indexed(spark, src)).collect())
    flag.touch()
    with pytest.raises(Exception, match="engine is down"):
        pipeline.generate_missing(spark, src, raw, failing, mode="r0", methods=["R0"], wave_rows=3)
    kept = jsonl.read_completed(spark, raw).count()
    flag.unlink()
    left = pipeline.generate_missing(spark, src, raw, failing, mode="r0", methods=["R0"], wave_rows=3)
    assert left["pending"] == left["generated"] == 12 - kept and jsonl.read_completed(spark, raw).count() == 12
    assert 0 < kept < 12


class Template:
    def apply_chat_template(self, messages, tokenize, add_generation_prompt, **kw):
        if kw.get("enable_thinking") is not False:
            raise AssertionError
        return "|".join(f"{m['role']}:{m['content'][-5:]}" for m in messages)


class OldTemplate:
    def apply_chat_template(self, messages, tokenize, add_generation_prompt):
        return f"{len(messages)} messages"


def test_chat_templates(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", {"NEU": "q one"}, {}, {})], "row_idx int, id string, questions map<string,string>, answers map<string,string>, contexts map<string,string>")
    prompt = lambda t: G.r0_requests(rows, template=t).first().prompt
    assert prompt(G.tokenizer_template(Template)).endswith("|user:q one") and prompt(G.tokenizer_template(OldTemplate)) == "2 messages"
    assert prompt(G.tokenizer_template(object)) == prompt(G.chat)


def test_cli(spark, tmp_path, capsys):
    src = lines(tmp_path / "in.jsonl", example(0), {**example(1), "answers": {}})
    cli.main(["validate", "--input", src, "--output", str(tmp_path / "v")])
    assert json.loads(capsys.readouterr().out)["written"] == 1
    conv = lines(tmp_path / "c.jsonl", {"id": "a", "reasoning_trace": "r", "conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]})
    cli.main(["convert", "--input", conv, "--output", str(tmp_path / "c")])
    assert json.loads(capsys.readouterr().out)["written"] == 1
    cli.main(["controlled", "--input", src, "--output", str(tmp_path / "k"), "--base-method", "SSR"])
    assert json.loads(capsys.readouterr().out)["written"] == 1
    got = json.loads(spark.read.text(str(tmp_path / "k")).first().value)
    assert list(got["reasonings"]) == ["Real CoT", "+Prob Anchor", "+Entropy Anchor", "Response as CoT"]


def test_streaming_generation_resumes(spark, tmp_path):
    todo, out, state = tmp_path / "req", str(tmp_path / "raw"), str(tmp_path / "state")
    todo.mkdir()
    req = lambda i, m: {"row_idx": i, "sample_id": str(i), "method": m, "prompt": f"p {i}", "prompt_context": f"c {i}", "source_method": m}
    lines(todo / "1.json", req(0, "NEU"), req(1, "NEU"))
    stream.generate_stream(stream.request_stream(spark, str(todo)), out, G.echo_generator, state).awaitTermination(120)
    lines(todo / "2.json", req(1, "NEU"), req(2, "NEU"), req(2, "NEU"))
    stream.generate_stream(stream.request_stream(spark, str(todo)), out, G.echo_generator, state).awaitTermination(120)
    got = stream.read_raw(spark, out)
    assert sorted(r.row_idx for r in got.collect()) == [0, 1, 2]
    assert G.pending(spark.read.schema(REQUEST).json(str(todo)), got).count() == 0
    assert [f.name for f in RAW_GENERATION] == got.drop("seq").columns


def test_streaming_windows(spark, tmp_path, small):
    src = tmp_path / "s"
    spark.read.parquet(f"{small}/metric_records.parquet").limit(500).repartition(2).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    q = stream.window_summary(spark.readStream.schema(schema).parquet(str(src)), late="3650 days").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n").alias("n")).first().n == spark.read.parquet(str(src)).where("scored_at is not null").count()


def test_score_command_writes_shards(spark, tmp_path, capsys):
    src, out = lines(tmp_path / "in.jsonl", *[example(i) for i in range(5)], {"id": "none", "questions": {}}, {**example(9), "answers": {}}), str(tmp_path / "m")
    for rank in (0, 1):
        cli.main(["score", "--input", src, "--output-dir", out, "--rank", str(rank), "--world-size", "2"])
    got = [json.loads(x) for x in capsys.readouterr().out.replace("}\n{", "}\x00{").split("\x00")]
    assert [(g["total"], g["valid"], g["discarded"]) for g in got] == [(4, 3, 1), (3, 2, 0)]
    recs = jsonl.read_metric_records(spark, out)
    assert recs.count() == 20 and {r.sample_idx for r in recs.collect()} == set(range(5))


def test_figure_cells_count_every_point(spark):
    from mooring.operators import summary

    rows = [("A", 0.5, 0.5, 1.0), ("A", 0.5001, 0.5001, 0.0), ("A", 1.0, 1.0, 0.3), ("A", float("nan"), 0.1, 0.1), ("B", -0.2, 7.0, None), (None, 0.1, 0.1, 0.1)]
    got = summary.figure_cells(spark.createDataFrame(rows, "method string, x double, y double, c double"), 100).collect()
    assert sorted((r.method, r.x, r.y, r.c, r.n) for r in got) == [("A", 0.505, 0.505, 0.5, 2), ("A", 0.995, 0.995, 0.3, 1), ("B", 0.005, 0.995, None, 1)]
