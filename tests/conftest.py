from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

from rulewright import TextRule, build_session, read_table  # noqa: E402
from rulewright.operators.rulebook import BY_NAME  # noqa: E402

PEOPLE = [
    ("1", "Ada Abel", "ada.abel@example.org", "first"),
    ("2", "Bruno Costa", "b_costa@mail.example.net", "copy to c@x.io"),
    ("3", "Chen Galli", "chen.galli@example.com", "none"),
    ("4", "Dalia Fischer", "", "no address"),
    ("5", "Egon Berger", "not-an-address", "wrong"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("people") / "people.csv"
    lines = ["ID,Name,Email,Notes", *[",".join(row) for row in PEOPLE]]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def people(spark, people_csv):
    return read_table(spark, people_csv)


@pytest.fixture
def email_rule():
    return TextRule(BY_NAME["email"].pattern)


def by_id(frame, key="ID"):
    return {row[key]: row.asDict() for row in frame.collect()}


def total(frame, counter="__matched"):
    return sum(row[counter] for row in frame.select(counter).collect())
