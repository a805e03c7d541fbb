import datetime as dt

import pytest
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators.drafts import check_output
from postbag.operators.quota import plan_days
from postbag.plans.outbox import draft_messages, outcomes, schedule
from postbag.sources.contacts import read_contacts



def now():
    return F.lit("2024-01-10 03:00:00").cast("timestamp_ntz")
HEADER = "Person Linkedin Url,Email,First Name,Last Name,Company\n"


def model():
    return lambda prompts: [f"About {p[-1][1][-6:]}" for p in prompts]


def code(name):
    return f'<code>{{"data":{{"data":{{"{S.ID_MARKER}":{{"*elements":["urn:{name}"]}}}}}}}}</code>'


@pytest.fixture(scope="module")
def contacts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("c") / "c.csv"
    path.write_text(HEADER + "".join(f"u{i},,Al,Fox{i},{'' if i == 3 else 'Y'}\n" for i in range(8)))
    return read_contacts(spark, str(path)).withColumn("run_id", F.lit("r"))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"u{i}", f"<main>Profile {i}<main>x</main></main>{code(f'P{i}') if i != 5 else ''}") for i in range(7)]
    return spark.createDataFrame(rows, S.PAGES)


def test_every_contact_has_one_outcome(spark, contacts, pages):
    drafts = draft_messages(contacts, pages, model)
    pressed = F.when(F.col("row_pos") == 0, "Enter").when(F.col("row_pos") == 1, "Backspace")
    result = outcomes(drafts, now(), F.col("row_pos") < 3, pressed, F.col("row_pos") == 4)
    got = {r.profile_url: (r.status, r.error_message, r.is_logged) for r in result.collect()}
    assert result.count() == 8 and result.select("message_id").distinct().count() == 8
    assert got == {
        "u0": ("Ready", None, True),
        "u1": ("Skipped", "User skipped sending.", True),
        "u2": ("Failed", "Timeout waiting for user input.", True),
        "u3": ("Failed", "No address could be inferred.", True),
        "u4": (None, None, False),
        "u5": ("Failed", "Profile ID extraction failed.", True),
        "u6": ("Ready", None, True),
        "u7": ("Failed", "No page is stored.", True),
    }
    bodies = {r.profile_url: r.body for r in result.collect()}
    assert bodies["u7"] == "" and bodies["u0"].startswith("About ")
    assert drafts.where("profile_url = 'u0'").first().page_text == "Profile 0 x\nx"
    assert check_output(drafts).where("NOT body_ready").count() == 0


def test_schedule_follows_what_is_logged(spark, contacts, pages):
    result = outcomes(draft_messages(contacts, pages, model), now(), no_recipient=F.col("row_pos") == 1)
    planned = plan_days(
        contacts.join(result.select("profile_url", "is_logged"), "profile_url"), 3, 1, F.col("is_logged")
    )
    assert [r.send_day for r in planned.orderBy("row_pos").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    opened = schedule(contacts, now(), 3, 1, dense=True).orderBy("row_pos").collect()
    assert [r.send_day for r in opened] == [0, 0, 1, 1, 1, 2, 2, 2]
    assert sorted({r.send_after for r in opened}) == [
        dt.datetime(2024, 1, 10, 3), dt.datetime(2024, 1, 11, 4), dt.datetime(2024, 1, 12, 4),
    ]
