"""Operators against plain Python versions on small random tables, with nulls, ties, hot keys and empty tables."""

import collections
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import audit, dedup, folds, mixture, runs, tokens, vectors


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    # Key "h" holds a third of the rows and more.
    return [(i, "h" if i % 3 else rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), rng.randint(0, 50)) for i in range(400)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "i bigint, k string, c string, n int").repartition(5).cache()


def test_first_wins(df, rows):
    want = {}
    for i, k, c, _ in rows:
        want.setdefault((k, c), i)
    key = F.concat_ws("|", F.coalesce("k", F.lit("-")), "c")
    assert {r.i for r in dedup.first_wins(df, key, F.col("i")).collect()} == set(want.values())
    marks = {r.i: r.is_duplicate for r in dedup.mark_duplicates(df, key, F.col("i")).collect()}
    assert marks == {i: want[k, c] != i for i, k, c, _ in rows}
    assert dedup.first_wins(df.limit(0), key, F.col("i")).count() == 0
    nulls = dedup.first_wins(df, F.col("k"), F.col("i"))
    assert nulls.count() == len({k for _, k, _, _ in rows})


def test_not_seen_and_union(spark, df):
    old, new = df.where("i < 200"), df.where("i >= 200")
    seen = {r.n for r in old.collect()}
    assert {r.i for r in dedup.not_seen(new, old, F.col("n"), F.col("n")).collect()} == {r.i for r in new.collect() if r.n not in seen}
    u = dedup.union_sources([df.select("i"), df.select("i", "k")])
    assert u.count() == 800 and u.where("source_ord = 0 and k is not null").count() == 0


def test_running_total(df, rows):
    for keys in (["k"], []):
        for ranges in (2, 16):
            got = {r.i: r.before for r in mixture.running_total(df, keys, "i", F.col("n"), "before", ranges).collect()}
            run, want = collections.Counter(), {}
            for i, k, _, n in rows:
                want[i] = run[k if keys else 0]
                run[k if keys else 0] += n
            assert got == want
    assert mixture.running_total(df.limit(0), ["k"], "i", F.col("n")).count() == 0


def test_running_total_with_ties(df, rows):
    got = {r.i: r.before for r in mixture.running_total(df, [], "n", F.lit(1), "before", tie="i").collect()}
    assert got == {i: p for p, (n, i) in enumerate(sorted((n, i) for i, _, _, n in rows))}


def test_limits(df, rows):
    want, docs, chars = set(), collections.Counter(), collections.Counter()
    for i, k, _, n in rows:
        if docs[k] < 30:
            docs[k] += 1
            if chars[k] < 500:
                chars[k] += n
                want.add(i)
    assert {r.i for r in mixture.limit_documents(df, "i", F.col("n"), 30, 500, ["k"]).collect()} == want


def test_quotas_and_caps(df, rows):
    quotas, caps, target = {"x": 700, "y": 900}, {"h": 2000}, 2500
    src, cat, total, want = collections.Counter(), collections.Counter(), 0, set()
    for i, k, c, n in rows:
        if k in caps and src[k] >= caps[k]:
            continue
        src[k] += n
        if c in quotas and cat[c] >= quotas[c]:
            continue
        cat[c] += n
        if total >= target:
            break
        total += n
        want.add(i)
    got = {r.i for r in mixture.quotas_and_caps(df, "i", F.col("n"), quotas, caps, target, "c", "k").collect()}
    assert got == want


def test_token_quota(df, rows):
    used, want = collections.Counter(), {}
    for i, _, c, n in rows:
        w = n if c == "z" else min(n, max(0, {"x": 300, "y": 100}[c] - used[c]))
        used[c] += n
        if w:
            want[i] = w
    assert {r.i: r.written for r in mixture.token_quota(df, "i", "n", {"x": 300, "y": 100}, "hard", (), "c").collect()} == want
    with pytest.raises(ValueError):
        mixture.token_quota(df, "i", "n", {}, "other")


def test_apportion(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 0.0), ("e", None)], "category string, weight double")
    assert {r.category: r.quota for r in mixture.apportion(w, 100).collect()} == {"a": 34, "b": 33, "c": 33}
    assert mixture.apportion(w.limit(0), 100).count() == 0


def test_folds(df, rows):
    left, want = {"x": 300, "y": 50}, set()
    for i, _, c, n in rows:
        if c not in left or n <= left[c]:
            want.add(i)
            if c in left:
                left[c] -= n
    assert {r.i for r in folds.strict_cap(df, "c", "i", "n", {"x": 300, "y": 50}).collect()} == want
    kept, other, want = 0, 0, {}
    for i, _, c, n in rows:
        if c != "x":
            other += n
            want[i] = True
        else:
            want[i] = kept / max(other, 1) < 0.1
            kept += n if want[i] else 0
    assert {r.i: r.keep for r in folds.evolving_share(df, "i", "n", F.col("c") == "x", 0.1).collect()} == want


def test_shard_exact_equals_windows_where_no_limit_binds(df):
    d = df.withColumn("hit", F.col("i") % 7 == 0)
    a = {r.i: r.written for r in folds.shard_exact(d, "i", "n", "c", "hit", {"x": 300}, 10**9, 10**9).collect()}
    b = {r.i: r.written for r in mixture.token_quota(df, "i", "n", {"x": 300}, "hard", (), "c").collect()}
    assert a == b
    total = collections.Counter()
    for r in folds.shard_exact(d, "i", "n", "c", "hit", {"x": 300}, 1000, 50).collect():
        total[r.split] += r.written
    assert total == {"train": 1000, "val": 50}


def test_chunks(spark):
    row = spark.createDataFrame([("aa\nbb\n\ncc  \ndddd\n", ["a" * 60, "b", "c", "d" * 70], ["12345", "123", None, "1", "1"])], "t string, c array<string>, s array<string>")
    r = row.select(folds.chunk_text(F.col("t"), 5).alias("a"), folds.merge_short_chunks(F.col("c")).alias("b"), folds.group_short(F.col("s"), 2, 6, 4).alias("g")).first()
    assert r.a == ["aa\nbb", "cc", "dddd"] and r.b == ["a" * 60, "b\nc", "d" * 70] and r.g == ["1234\n123", "1\n1"]


def test_audit(df, rows):
    got = {(r.k, r.i) for r in audit.first_per_group(df, "k", "i", 3, ["i"]).collect()}
    per = collections.defaultdict(list)
    for i, k, _, _ in rows:
        per[k].append(i)
    assert got == {(k, i) for k, v in per.items() for i in v[:3]}
    s = audit.sample_per_group(df, "k", "i", 5, 1)
    assert {r.i for r in s.collect()} == {r.i for r in audit.sample_per_group(df.repartition(2), "k", "i", 5, 1).collect()}
    assert sorted(r.position for r in audit.shuffled(df, "i", 4).collect()) == list(range(400))
    p = audit.page(df, "i", 99, 10)
    assert p.count() == 400 - 24 * (400 // 24) and p.first().total_pages == 17


def test_tokens(spark, rows):
    d = spark.createDataFrame([(i, n) for i, _, _, n in rows], "i bigint, n_tokens bigint")
    pieces = tokens.shard_pieces(tokens.positions(d, "i", "n_tokens"), 64).collect()
    fill = collections.Counter()
    for r in pieces:
        fill[r.shard] += r.taken
    total = sum(n for *_, n in rows)
    assert fill == {s: min(64, total - 64 * s) for s in range(-(-total // 64))}
    sp = tokens.stream_split(d, "i", "n_tokens", 0.1).agg(F.sum("train_tokens").alias("a"), F.sum("val_tokens").alias("b")).first()
    assert (sp.a, sp.b) == (math.floor(total * 0.9), total - math.floor(total * 0.9))
    assert tokens.small_split(100, 0.1, 20) == ((0, 90), (80, 100)) and tokens.small_split(1000, 0.1, 20) == ((0, 900), (900, 1000))
    t = spark.createDataFrame([(1, "low low lower"), (2, "newest newest lowest"), (3, None)], "i int, text string")
    m = tokens.train_bpe(t, "text", 3).collect()
    assert (m[0].left, m[0].right, m[0].n) == ("e", "s", 2)
    v = tokens.char_vocabulary(t, specials=tokens.SPECIALS)
    e = tokens.decode_chars(tokens.encode_chars(spark.createDataFrame([("lo☃",), (None,)], "text string"), v, unknown=1), v, skip=(1,)).collect()
    assert e[0].decoded == "lo" and e[0].ids[2] == 1 and e[1].ids is None
    x = tokens.next_token_pairs(spark.createDataFrame([(list(range(9)),), ([1],)], "ids array<int>"), "ids", 4).collect()
    assert [(r.x, r.y) for r in x] == [([0, 1, 2, 3], [1, 2, 3, 4]), ([4, 5, 6, 7], [5, 6, 7, 8])]
    assert sorted(r["rank"] for r in tokens.epoch_order(d, "i", 1, 2).collect()) == list(range(400))


def test_bpe_learns_from_every_word(spark):
    """55,000 words that share one pair: all of them count, in the order of merges too."""
    letters = "abcdefghijklmnoprs"
    rare = ["qz" + a + b + c + d for a in letters for b in letters for c in letters for d in letters][:55_000]
    t = spark.createDataFrame([(" ".join(rare[i : i + 500]),) for i in range(0, len(rare), 500)] * 2 + [("xy " * 105_000,), (None,)], "text string")
    m = tokens.train_bpe(t, "text", 2).collect()
    assert [(r.rank, r.left, r.right, r.n) for r in m] == [(0, "q", "z", 110_000), (1, "x", "y", 105_000)]


def test_bpe_merges_from_left_to_right(spark):
    t = spark.createDataFrame([("aaaa aaaa aaaaa aaaaa",)], "text string")
    assert [(r.left, r.right, r.n) for r in tokens.train_bpe(t, "text", 9).collect()] == [("a", "a", 14), ("aa", "aa", 4), ("aaaa", "a", 2)]
    assert tokens.train_bpe(t.limit(0), "text", 9).count() == 0


def test_runs(spark):
    log = [(j, "r", j, float(j), "eval" if j % 3 else "heartbeat") for j in range(101)]
    d = spark.createDataFrame([(a, b, c, x, s, 1000.0, None) for a, b, c, x, s in log], "log_id bigint, run_id string, step bigint, train_loss double, status_source string, tokens_per_second double, val_loss double")
    for points in (1, 2, 7, 50, 101, 500):
        n = 101
        want = {n - 1} if points == 1 else set(range(n)) if n <= points else {round(k * (n - 1) / (points - 1)) for k in range(points)} | {0, n - 1}
        assert {r.step for r in runs.downsample(d, points).collect()} == want, points
    assert runs.downsample(d, 0).count() == 0 and runs.tail(d, 5).count() == 5
    nan = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.0), (4, None), (5, 2.5)], "i int, x double")
    assert {r.i: r.y for r in nan.select("i", runs.finite("x").alias("y")).collect()} == {1: None, 2: None, 3: 0.0, 4: None, 5: 2.5}
    row = spark.range(1).select(runs.first_truthy(F.lit(0), F.lit(None).cast("int"), F.lit(7)).alias("a"), runs.number(F.lit("1,234.5")).alias("b"), runs.number(F.lit("x")).alias("c")).first()
    assert (row.a, row.b, row.c) == (7, 1234.5, None)
    p = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c"), ("z", None)], "run_id string, parent_id string")
    assert {(r.run_id, r.ancestor, r.depth) for r in runs.lineage(p).collect()} >= {("c", "b", 1), ("c", "a", 2), ("b", "a", 1)} and runs.lineage(p).where("depth > 2").count() == 0


def test_merge_precedence(spark):
    schema = "run_id string, step bigint, log_id bigint, status_source string"
    own = spark.createDataFrame([("r", 1, 10, "eval"), ("r", 1, 11, "heartbeat"), ("r", 2, 12, "eval"), ("r", None, 13, "eval")], schema)
    up = spark.createDataFrame([("r", 2, 1, "eval", 1), ("r", 3, 2, "heartbeat", 1), ("r", 3, 3, "eval", 2), ("r", 4, 4, "heartbeat", 2), ("r", 4, 5, "heartbeat", 1)], schema + ", depth int")
    assert sorted((r.step or -1, r.log_id) for r in runs.merge_logs(own, up).collect()) == [(-1, 13), (1, 11), (2, 12), (3, 3), (4, 5)]


def test_merged_log_of_a_long_chain(spark, tmp_path):
    """Run r18 has the rows of the 16 runs before it, not of r01; at a step of two ancestors the first eval of the earlier run stands."""
    from textlake import catalog

    rows = [(f"r{k:02d}", k, k, "eval") for k in range(1, 19)] + [("r02", 100, 20, "eval"), ("r17", 100, 21, "eval")]
    spark.createDataFrame(rows, "run_id string, step bigint, log_id bigint, status_source string").write.parquet(str(tmp_path / "training_log.parquet"))
    got = {(r.run_id, r.step): r.log_id for r in catalog.merged_log(spark, str(tmp_path)).collect()}
    assert {step: i for (run, step), i in got.items() if run == "r18"} == {k: k for k in range(2, 19)} | {100: 20}


def test_alerts(spark):
    s = spark.createDataFrame([("a", "running", 10, 10, 5.0, 5.0, 25, 0, 0, None, None, 1.0, None, 0.1), ("b", "odd", 10, 10, 1000.0, None, 25, 2, 2, 1, None, float("nan"), float("inf"), None)], "run_id string, state string, step long, local_step long, status_age double, heartbeat_age double, heartbeat_interval int, eval_interval int, checkpoint_interval int, last_eval_step int, checkpoint_step int, train_loss double, val_loss double, learning_rate double")
    a = runs.alerts(s)
    assert {r.key for r in a.collect() if r.run_id == "b"} == {"status_stale", "heartbeat_missing", "unexpected_state", "train_loss_missing_or_nonfinite", "val_loss_nonfinite", "learning_rate_missing", "eval_stale_by_step", "checkpoint_missing"} and a.where("run_id = 'a'").count() == 0
    c = {(r.key, r.change) for r in runs.alert_changes(a.where("key like 'status%'"), a.where("key like 'h%'")).collect()}
    assert c == {("heartbeat_missing", "opened"), ("status_stale", "resolved")}


@pytest.mark.parametrize("name, at", [("constant", {0: 1.0, 99: 1.0}), ("linear", {0: 1.0, 50: 0.5, 200: 0.0}), ("cosine", {0: 1.0, 50: 0.5, 100: 0.0}), ("warmup_linear", {0: 0.0, 5: 0.5, 10: 1.0, 55: 0.5}), ("warmup_cosine", {5: 0.5, 10: 1.0, 100: 0.0}), ("resume_ramp_cosine", {0: 0.0, 25: 0.5, 30: 1.0, 100: 0.0})])
def test_learning_rate(spark, name, at):
    start = 20 if name == "resume_ramp_cosine" else 0
    for step, want in at.items():
        got = spark.range(1).select(runs.learning_rate(F.lit(step), name, 1.0, 0.0, 10 if "_" in name else 0, 0.0, 100, start).alias("x")).first().x
        assert got == pytest.approx(want, abs=1e-9), step


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    got = collections.defaultdict(list)
    for r in sorted(vectors.nearest(d.where("vec_id < 10"), d, 5).collect(), key=lambda r: (r.query, r["rank"])):
        got[r.query].append(r.vec_id)
    for q in range(10):
        assert got[q] == sorted((j for j in range(60) if j != q), key=lambda j: (-round(sim[q, j], 9), j))[:5]
    p = d.where("vec_id = 0").select(vectors.softmax(F.col("embedding"), 0.5).alias("p")).first().p
    e = np.exp(x[0] / 0.5)
    assert np.allclose(p, e / e.sum())
    for crossing, n in ((True, 2), (False, 1)):
        one = spark.createDataFrame([(1, [math.log(0.5), math.log(0.3), math.log(0.2)])], "k int, l array<double>")
        assert vectors.nucleus(one, "k", "l", 0.6, crossing).count() == n
    assert np.abs(vectors.layout(x[:5])).max() == pytest.approx(1.0)
    s = vectors.sample_token(d.where("embedding is not null"), "vec_id", "embedding", temperature=0)
    assert {r.vec_id: r.token for r in s.collect()} == {i: int(r.argmax()) for i, r in enumerate(x)}


def test_readers(spark, tmp_path):
    from textlake.sources import readers as R

    recs = [{"text": " hi "}, {"question": "q", "answer": "a", "context": "c"}, {"instruction": "i", "output": "o"}, {"conversations": [{"from": "human", "value": "x"}]}, {"dialogue": ["a", "b"]}, {"body": "b"}, {"deep": {"list": ["short", "a longer one"]}}]
    f = tmp_path / "a.jsonl"
    f.write_text("\n".join(json.dumps(r) for r in recs) + "\n\nnot json\n")
    with pytest.raises(Exception):
        R.read_lines(spark, str(f)).select(R.record_text(F.col("value"))).collect()
    assert R.read_lines(spark, str(f), "drop").count() == 7 and R.read_lines(spark, str(f), "count").where("value is null").count() == 1
    kept = R.read_lines(spark, str(f), "keep").select(R.record_text(F.col("value")).alias("t")).collect()
    assert [r.t for r in kept] == ["hi", "问题：q\n补充：c\n回答：a", "指令：i\n回答：o", "用户：x", "甲：a\n乙：b", "b", None, "not json"]
    assert R.read_lines(spark, str(f), "drop").select(R.discover_text(F.col("value")).alias("t")).collect()[-1].t == "a longer one"
    assert [(r.line_no, r.line) for r in R.numbered_lines(spark, str(f), 8, 5).collect()] == [(8, ""), (9, "not json")]
    assert R.tail_lines(spark, str(f), 2).count() == 2
    (tmp_path / "c.txt").write_text(f"one\n\n{R.T.DOC_SEPARATOR}\n\ntwo\nlines\n\n{R.T.DOC_SEPARATOR}\n\n \n")
    assert [r.text for r in R.read_separated(spark, str(tmp_path / "c.txt")).collect()] == ["one", "two\nlines"]
    (tmp_path / "m.json").write_text(json.dumps({"a": {"text": "x"}, "b": {"text": "y"}}))
    docs = R.read_source(spark, R.SourceConfig("s", "t", path=str(tmp_path / "m.json")))
    assert sorted(r.text for r in docs.collect()) == ["x", "y"] and docs.columns == [c.name for c in R.DOCUMENT]
    (tmp_path / "d.json").write_text(json.dumps({"dialogues": [["a"], ["b"]]}))
    assert R.read_dialogue_files(spark, str(tmp_path / "d.json")).count() == 2
    files = spark.createDataFrame([("/x/a_1.jsonl", 5), ("/x/a_2.jsonl", 5), ("/x/a_3.jsonl", 0), ("/x/b.jsonl", 1)], "path string, size bigint")
    assert {r.path for r in R.largest_per_family(files).collect()} == {"/x/a_1.jsonl", "/x/b.jsonl"}
    R.write_jsonl(docs, str(tmp_path / "o"))
    with pytest.raises(Exception):
        R.write_jsonl(docs, str(tmp_path / "o"))
    R.write_corpus(docs, str(tmp_path / "corpus"))
    assert R.read_separated(spark, str(tmp_path / "corpus")).count() == 2
    R.write_json(str(tmp_path / "j" / "x.json"), {"b": 1})
    assert R.signature({"a": 1, "b": 2}) == R.signature({"b": 2, "a": 1}) and "| a |" in R.markdown(spark.createDataFrame([("x|y",)], "a string"), "T")
    with pytest.raises(ValueError):
        R.read_source(spark, R.SourceConfig("s", "t", path="x.bin"))


def test_streams(spark, tmp_path):
    from textlake.operators import rules
    from textlake.streaming import ingest

    src = str(tmp_path / "in")
    text = "这是一段足够长的正文内容，用来测试增量接收的去重。"
    mk = lambda rows: spark.createDataFrame(rows, "i bigint, text string, source_name string, source_type string").coalesce(1).write.mode("append").parquet(src)
    mk([(1, text, "s", "t"), (2, text + " ", "s", "t"), (3, "短", "s", "t")])
    args = (str(tmp_path / "out"), str(tmp_path / "cp"), "i")
    ingest.ingest(ingest.stream(spark, src, "i bigint, text string, source_name string, source_type string"), *args).awaitTermination()
    assert [r.i for r in spark.read.parquet(args[0]).collect()] == [1]
    mk([(4, text, "s", "t"), (5, text + "新的一句。", "s", "t")])
    ingest.ingest(ingest.stream(spark, src, "i bigint, text string, source_name string, source_type string"), *args, profile=rules.ZH).awaitTermination()
    assert sorted(r.i for r in spark.read.parquet(args[0]).collect()) == [1, 5]
    a = str(tmp_path / "alerts")
    mk2 = lambda rows: spark.createDataFrame(rows, "run_id string, key string").coalesce(1).write.mode("append").parquet(a)
    mk2([("r", "slow")])
    run = lambda: ingest.alert_events(ingest.stream(spark, a, "run_id string, key string"), str(tmp_path / "ev"), str(tmp_path / "cp2")).awaitTermination()
    run()
    mk2([("r", None)])
    run()
    assert sorted((r.key, r.change) for r in spark.read.parquet(str(tmp_path / "ev")).collect()) == [("slow", "opened"), ("slow", "resolved")]
    w = spark.createDataFrame([("running", 5, 0, False), ("running", 500, 0, False), ("running", 500, 3, False), ("x", 1, 0, True)], "state string, age_seconds int, restarts int, done boolean")
    assert [r.action for r in ingest.watchdog(w, 100, 3).collect()] == ["wait", "restart", "blocked", "complete"]


def test_late_additions(spark):
    from textlake.sources import readers as R

    row = spark.createDataFrame([("a\n b\n \nc", "x\ny\n")], "p string, q string").select(R.paragraphs(F.col("p")).alias("p"), R.paragraphs(F.col("q")).alias("q")).first()
    assert row.p == ["a\n b", "c"] and row.q == ["x", "y"]
    assert R.first_available(None, spark.range(0), spark.range(2)).count() == 2 and R.first_available(None) is None
    m = spark.createDataFrame([('{"sources":[{"name":"s","group":"g","reported_by_chatlm":{"raw_rows":5},"sampling_plan":{"max_docs":3}}]}',)], "j string").select(F.parse_json("j").alias("value"))
    assert R.plan_rows(m).first().asDict() == {"source_name": "s", "group": "g", "category": None, "rows": 5, "max_rows": None, "max_docs": 3, "max_chars": None}
    shards = spark.createDataFrame([("t", 0, 100), ("t", 1, 0), ("t", 2, 900), ("t", 3, None)], "split string, shard_index int, tokens bigint")
    w = tokens.weighted_windows(shards, 200, 32, 1).collect()
    assert len(w) == 200 and {r.shard_index for r in w} == {0, 2} and 100 < sum(r.shard_index == 2 for r in w) and all(0 <= r.first_token <= 900 - 32 for r in w)
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id int, token string")
    assert [r.id for r in vectors.resolve_targets("#1", v).collect()] == [1] and [r.id for r in vectors.resolve_targets("cab", v, 2).collect()] == [2, 0]
    s = runs.vocabulary_sizes(spark.createDataFrame([(32768, 100), (8192, 130)], "vocab_size int, tokens bigint")).orderBy("vocab_size").first()
    assert s.token_increase == 0.3 and s.parameter_saving == 24576 * 640


def test_frames_of_split_runs_are_exact(spark):
    rng = random.Random(9)
    rows = [(j, "hot" if j % 4 else "cold", rng.randint(0, 60), rng.choice([1.0, 2.0, 9.0, float("nan"), None]), rng.choice([100.0, 20.0, None])) for j in range(600)]
    d = spark.createDataFrame(rows, "log_id bigint, run_id string, step bigint, train_loss double, tokens_per_second double")
    for f, cols in ((runs.loss_spikes, ("rolling_mean", "rolling_stdev", "is_spike")), (runs.median_spikes, ("baseline", "is_spike")), (runs.throughput_drops, ("recent_median",))):
        a, b = ({r.log_id: tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in cols)) for r in f(d, split_rows=n).collect()} for n in (10**9, 1))
        assert a == b and len(a) > 300
