"""States as code and back, as columns: by hand, and against the parser in Python on generated programs."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import code, parsing

MAP = "map<string,string>"


def value(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "slot, new, prior, texts, want",
    [
        ("restaurant-area", "north", {"hotel-area": "north"}, ["", "same area"], "hotel-area"),
        ("restaurant-area", "north", {"hotel-area": "North|x"}, ["", "same area"], "hotel-area"),
        ("restaurant-area", "north", {"hotel-area": "north"}, ["", "in the north"], None),
        ("restaurant-area", "centre", {"hotel-area": "centre"}, ["", "in the center"], None),
        ("restaurant-area", "dontcare", {"hotel-area": "dontcare"}, ["", ""], None),
        ("taxi-departure", "fenditton", {"hotel-name": "fenditton"}, ["from fen ditton", ""], None),  # mended before it is looked for
        ("taxi-departure", "acorn", {"train-destination": "acorn", "hotel-name": "acorn"}, ["", ""], "hotel-name"),  # the first domain
        ("restaurant-book people", "6", {"hotel-book stay": "6"}, ["", "please"], None),  # numbers need the same name
        ("restaurant-book people", "6", {"hotel-book people": "6"}, ["", "for 16"], "hotel-book people"),  # said as a word only
        ("restaurant-book people", "6", {"hotel-book people": "6"}, ["", "for 6 of us"], None),
        ("hotel-internet", "yes", {"hotel-parking": "yes"}, ["", ""], None),
        ("hotel-stars", "4", {"restaurant-book people": "4"}, ["", ""], "restaurant-book people"),  # stars are no whole number by type
    ],
)
def test_references(spark, slot, new, prior, texts, want):
    r = code.reference(F.col("s"), F.col("v"), F.col("p"), F.col("t"))
    assert value(spark, f"s string, v string, p {MAP}, t array<string>", (slot, new, prior, texts), r) == want


def test_statements(spark):
    s = code.statements(F.col("d"), F.col("p"), F.col("t"))
    row = ({"hotel-area": "north", "hotel-stars": "4", "taxi-leaveat": "[DELETE]", "hotel-book stay": "3", "train-departure": 'a "b"', "restaurant-area": "east"}, {"attraction-area": "east"}, ["", ""])
    assert value(spark, f"d {MAP}, p {MAP}, t array<string>", row, s).split("\n") == [
        "del agent.state.taxi.depart_time",
        'agent.state.hotel = agent.find_hotel(area="north", book_number_of_days=3, stars="4")',
        'agent.state.train = agent.find_train(leave_from="a \\"b\\"")',
        "agent.state.restaurant = agent.find_restaurant(area=agent.state.attraction.area)",
    ]
    assert value(spark, f"d {MAP}, p {MAP}, t array<string>", ({}, {}, []), s) == code.NO_CHANGE


def test_reference_values(spark):
    row = ({"restaurant-area": "north", "hotel-stars": "dontcare", "bus-x": "1"}, {"hotel-area": "north|east"}, ["same area"])
    r = code.reference_values(F.col("d"), F.col("p"), F.col("t"), ("hotel", "restaurant"))
    assert value(spark, f"d {MAP}, p {MAP}, t array<string>", row, r) == ["hotel-starsdontcare", "restaurant-area-state.hotel.area"]


def test_prompts_in_code(spark):
    prior = {"taxi-leaveat": "10:15", "hotel-book stay": "3", "hotel-area": "state.taxi.area", "zoo-x": "a|b"}
    turn = '    agent.state = BeliefState.from_dict({"hotel": {"area": state.taxi.area, "book_number_of_days": 3}, "taxi": {"depart_time": "10:15"}, "zoo": {"x": "a"}})\n    print("user: hi")\n'
    schema = f"p {MAP}, sys string, usr string, examples array<struct<context:{MAP},sys:string,usr:string,delta:{MAP}>>"
    row = (prior, None, "hi", [({}, "yes?", "north", {"hotel-area": "north"})])
    prompt = lambda *a, **k: value(spark, schema, row, code.code_prompt(*a, F.col("examples"), F.col("p"), F.col("sys"), F.col("usr"), **k))
    m = prompt("s", "rules\n")
    assert [x["role"] for x in m] == ["system", "user", "assistant", "user"] and m[-1]["content"] == "\n    #### Example 2 ####\n" + turn
    assert m[1]["content"] == 'rules\n    \n\n    #### Example 1 ####\n    agent.state = BeliefState.from_dict({})\n    print("system: yes?")\n    print("user: north")\n'
    assert m[2]["content"] == '    agent.state.hotel = agent.find_hotel(area="north")\n'
    r = prompt("s", "", reverse=True)
    assert r[1]["content"].endswith('find_hotel(area="north")\n') and r[-1]["content"] == "\n    #### Example 2 ####\n"


VALUES = ['"north"', "'a b'", '"it\'s"', '"q\\"x"', "4", "12", "None", "True", "agent.state.hotel.area", "state.train.depart_time", "agent.state.taxi.leave_from", "05", "-3", "x()", '"a, b=c"', '"(y)"', "4.5", '"open']
NAMES = ["area", "stars", "depart_time", "book_people", "leave_from"]


def program(r):
    lines = []
    for _ in range(r.randrange(1, 5)):
        d, kind = r.choice(["hotel", "train", "taxi"]), r.random()
        if kind < 0.5:
            args = [f"{a}={r.choice(VALUES)}" for a in r.sample(NAMES, r.randrange(4))]
            lines.append(f"{r.choice(['agent.state.', 'state.', 'agent.state.', ''])}{d} = agent.find_{d}({', '.join(args)}{r.choice(['', '', ',']) if args else ''})")
        elif kind < 0.7:
            lines.append(f"del agent.state.{d}.{r.choice(NAMES)}")
        elif kind < 0.9:
            lines.append(f"agent.state.{d}.{r.choice(NAMES)} = {r.choice(VALUES[:-2])}")
        else:
            lines.append(r.choice(["", "   ", "# no", code.NO_CHANGE, f"agent.state.{d} = agent.find_hotel(area=1)", "import os", f"agent.state.{d} = agent.find_{d}(1)"]))
    return "\n".join(lines)


def test_parsed_code_equals_the_parser(spark):
    r = random.Random(4)
    rows = [(program(r), {k: r.choice(["north", "x", "5"]) for k in r.sample(["hotel-area", "train-leaveat", "taxi-departure", "hotel-stars"], r.randrange(4))}) for _ in range(2500)]
    rows = [x for x in rows if "4.5" not in x[0]] + [("", {"a-b": "c"}), ("hotel = evil()", {"hotel-area": "north"})]
    df = spark.createDataFrame(rows, f"t string, s {MAP}")
    got = df.select("t", "s", code.parsed_code(F.col("t"), F.col("s")).alias("g")).collect()
    assert len(got) > 1500
    for x in got:
        assert x.g == parsing.parse_python_completion(x.t, x.s), x.t


def test_no_python_a_row(spark):
    df = spark.createDataFrame([({"hotel-area": "x"}, {}, ["a"])], f"d {MAP}, p {MAP}, t array<string>")
    said = code.statements(F.col("d"), F.col("p"), F.col("t"))
    plan = df.select(code.parsed_code(said, F.col("p")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
