import os

import pytest
from pyspark.sql import functions as F

from postbag import workspace
from postbag.operators import drafts as D


def echo():
    def model(prompts):
        if any("bad" in p[-1][1] for p in prompts):
            raise RuntimeError("cannot answer")
        return [f"{len(p)}:{p[-1][1]}" for p in prompts]

    return model


def test_prompts(spark):
    df = spark.createDataFrame([("sum", " ", "write {x} [y]"), ("sum", " Be brief. ", None)], "s string, p string, i string")
    mail = D.mail_messages(F.col("s"), F.col("p"), F.col("i"))
    rows = [[tuple(m) for m in r.m] for r in df.select(mail.alias("m")).collect()]
    assert rows[0] == [
        ("system", D.MAIL_SYSTEM),
        ("human", "write {x} [y]"),
        ("human", "Generate email in english."),
        ("human", "Here is receiver profile: sum"),
    ]
    assert [m[1] for m in rows[1][1:3]] == [D.MAIL_INSTRUCTIONS, "Be brief."]
    flat = df.select(D.flat_text(D.subject_messages(F.col("s"))).alias("t")).first().t
    assert flat == f"system: {D.SUBJECT_SYSTEM}\nhuman: Here is email you need to generate subject for: sum"


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_each_prompt_is_asked_once_and_errors_stay_alone(spark, tmp_path, hot_rows):
    told = str(tmp_path / "told")

    def make_model():
        answer = echo()

        def model(prompts):
            with open(told, "a") as f:
                f.writelines(p[-1][1] + "\n" for p in prompts if len(prompts) == 1)
            return answer(prompts)

        return model

    text = F.when(F.col("id") % 3 == 0, "same").when(F.col("id") == 10, "bad").when(F.col("id") == 11, None)
    df = spark.range(60).withColumn("text", text.otherwise(F.col("id").cast("string")))
    messages = F.when(F.col("text").isNotNull(), D.chat(("human", F.col("text"))))
    done = D.complete(df, messages, make_model, "answer", ["id"], hot_rows, batch=1)
    asked_after = open(told).read().split()
    got = {r.id: r.answer for r in done.collect()}
    done.collect()
    assert open(told).read().split() == asked_after
    assert len(asked_after) == len(set(asked_after)) == 40
    assert got[10].asDict() == {"value": None, "error": "cannot answer"}
    assert got[11].asDict() == {"value": None, "error": None}
    assert got[0].value == got[57].value == "1:same" and got[59].value == "1:59" and len(got) == 60


def test_one_bad_prompt_does_not_take_its_batch(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "text string")
    done = D.complete(df, D.chat(("human", F.col("text"))), echo, "answer", ["text"], batch=32)
    assert {r.text: r.answer.value for r in done.coalesce(1).collect()} == {"a": "1:a", "bad": None, "c": "1:c"}


def test_wrong_number_of_answers():
    assert D._answer(lambda prompts: [], [[("human", "x")]]) == [(None, "1 prompts, but 0 answers")]


def test_personalize(spark):
    df = spark.createDataFrame([(1, "page"), (2, "bad"), (3, None), (4, "page")], "id long, page_text string")
    rows = {r.id: r for r in D.personalize(df, echo, ["id"]).collect()}
    assert rows[1].summary == rows[4].summary == "2:page"
    assert rows[1].body == "4:Here is receiver profile: 2:page"
    assert rows[1].subject == f"2:Here is email you need to generate subject for: {rows[1].body}"
    assert (rows[2].body, rows[2].subject, rows[2].error) == (None, None, "cannot answer")
    assert (rows[3].summary, rows[3].error) == (None, None) and len(rows) == 4


def test_personalize_keeps_rows_whose_ids_are_missing_or_repeat(spark):
    given = [("r", 0, "u1", "one"), ("r", 0, "u2", "two"), (None, None, "u3", "three"), (None, None, "u4", "one"), ("r", None, "u5", None)]
    df = spark.createDataFrame(given, "run_id string, row_pos long, profile_url string, page_text string")
    out = D.personalize(df, echo, ["run_id", "row_pos"])
    assert sorted(out.columns) == sorted([*df.columns, "summary", "body", "subject", "error"])
    got = sorted((r.profile_url, r.page_text, r.summary) for r in out.collect())
    assert got == sorted((u, p, p and f"2:{p}") for _, _, u, p in given)


def test_checks(spark):
    nine, ten = " ".join("w" * 9), " ".join("w" * 10)
    df = spark.createDataFrame(
        [("Hello!", nine, "- **Name**: Bo\n- **About**: x"), ("Hello [First name]!", ten, ""), ("[]", "", None)],
        "body string, subject string, summary string",
    )
    rows = D.check_output(df, summary="summary").collect()
    assert [(r.body_ready, r.subject_short) for r in rows] == [(True, True), (False, False), (True, True)]
    assert (rows[0].has_name, rows[0].has_about, rows[0].has_headline) == (True, True, False)
    assert df.select(D.summary_field(F.col("summary"), "Name")).first()[0] == "Bo"


def test_answers_lie_in_the_shared_folder(spark):
    root = workspace.root(spark)
    assert root == (spark.conf.get("spark.checkpoint.dir", None) or root)
    path = workspace.fresh(spark, "kept")
    kept = workspace.keep(spark.range(5), "kept", path)
    assert path.startswith(root) and os.path.isdir(path) and path in kept.inputFiles()[0]


@pytest.fixture
def asked(spark):
    text = F.when(F.col("id") % 3 == 0, "same").when(F.col("id") == 10, "bad").otherwise(F.col("id").cast("string"))
    return spark.range(60).withColumn("text", F.when(F.col("id") != 11, text))


def told_to(path):
    """A model that writes a line per call of a task: how many prompts it got by then, then what it was asked."""

    def make_model():
        answer, name = echo(), os.path.join(path, os.urandom(8).hex())

        def model(prompts):
            with open(name, "a") as f:
                f.writelines(p[-1][1] + "\n" for p in prompts)
            return answer(prompts)

        return model

    return make_model


def test_answers_outlive_a_run(spark, tmp_path, asked):
    """New prompts only are asked, failed ones again, and no task asks more than it may."""
    messages = F.when(F.col("text").isNotNull(), D.chat(("human", F.col("text"))))
    store, runs = workspace.fresh(spark, "store"), []
    for n, rows in enumerate([asked.where("id < 30"), asked, asked.where("id <> 10"), asked.where("false")]):
        path = tmp_path / str(n)
        path.mkdir()
        done = D.complete(rows, messages, told_to(str(path)), "answer", ["id"], batch=1, store=store, calls=7)
        got = {r.id: r.answer for r in done.collect()}
        per_task = [f.read_text().split() for f in path.iterdir()]
        assert all(len(t) <= 7 for t in per_task) and len(got) == rows.count()
        runs.append((got, sorted(x for t in per_task for x in t)))
    (first, asked_first), (second, asked_second), (third, asked_third), (none, asked_none) = runs
    assert len(asked_first) == len(set(asked_first)) == 20 and "same" in asked_first
    new = {str(i) for i in range(30, 60) if i % 3}
    assert asked_second == sorted(new | {"bad"}) and asked_third == [] and asked_none == [] and none == {}
    assert second[10].error == "cannot answer" and second[0].value == second[57].value == "1:same"
    assert second[11].asDict() == {"value": None, "error": None} and second[59].value == "1:59"
    assert {i: a for i, a in second.items() if i != 10} == third and all(second[i] == a for i, a in first.items())


def test_stores_answers_of_two_runs_once(spark):
    store = workspace.fresh(spark, "store")
    for batch, value in (("a", "x"), ("b", "y")):
        rows = [("p", 1, value, None), ("q", 1, None, "failed")]
        workspace.keep(spark.createDataFrame(rows, D.ANSWERS), "answers", f"{store}/{D.ANSWER_BATCH}={batch}")
    assert [tuple(r) for r in D.stored_answers(spark, store).collect()] == [("p", "x", None)]


def test_a_task_does_not_hold_all_its_prompts(spark):
    """600 prompts of 200 KB each in one task: the memory of its worker does not grow with their number."""

    def make_model():
        def held():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096 // 1_000_000

        start = held()
        return lambda prompts: [str(held() - start)] * len(prompts)

    asked = spark.range(600).select(F.to_json(D.chat(("human", F.concat("id", F.repeat(F.lit("x"), 200_000))))).alias("_asked"))
    answers = D.ask_model(asked, make_model, parallelism=1).collect()
    assert len(answers) == 600 and max(int(r["_value"]) for r in answers) < 100


def test_new_prompts_are_placed_by_their_digests(spark, asked, monkeypatch):
    """Texts are not part of the tables written to find out what is new, and a prompt with copies is asked once."""
    kept, keep = [], workspace.keep
    monkeypatch.setattr(workspace, "keep", lambda df, label, *more: kept.append((label, df.columns)) or keep(df, label, *more))
    store = workspace.fresh(spark, "store")
    prompts = asked.select(F.to_json(D.chat(("human", F.col("text")))).alias("_asked")).where("id % 3 < 2 AND id NOT IN (10, 11)")
    for _ in range(2):
        answers = D.ask_model(prompts, echo, store=store)
        assert {r["_value"] for r in answers.collect()} == {"1:same", *(f"1:{i}" for i in range(60) if i % 3 == 1 and i != 10)}
    ordered = [columns for label, columns in kept if label == "ordered"]
    assert len(ordered) == 2 and not any("_asked" in columns for columns in ordered)
