"""Prompts by format, and texts as they are put on file."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnloom.functions import formats
from turnloom.functions import text as X

MAP = "map<string,string>"
SCHEMA = f"c {MAP}, s string, u string, d array<string>, x array<struct<context:{MAP},sys:string,usr:string,delta:{MAP}>>"
CARDS = {n: f"{n} card.\n" for n in ("Bank", "Bus", "Hotel", "Movie", "Music", "Train")}


def prompt(spark, name, row=({"a-b": "c|d"}, "yes?", "hi", ["Train", "Zoo"], [({}, "none", "go", {"a-b": "c|e"})]), **how):
    p = formats.prompt(name, "be good", F.col("x"), F.col("c"), F.col("s"), F.col("u"), **how)
    return spark.createDataFrame([row], SCHEMA).select(p.alias("p")).first().p


def test_pairs(spark):
    m = prompt(spark, "nl", guidelines="rules\n")
    assert [x.role for x in m] == ["system", "user", "assistant", "user"]
    shot = formats.TITLE.replace("{}", "1") + formats.BEFORE + "{}" + formats.LATEST + formats.USER + 'go"\n\n' + formats.INSTRUCTIONS
    assert m[1].content == formats.GUIDELINES + "rules\n" + shot and m[2].content == "            {'a-b': 'c'}\n"
    last = formats.TITLE.replace("{}", "2") + formats.BEFORE + "{'a-b': 'c'}" + formats.LATEST + formats.SYSTEM + 'yes?"\n' + formats.USER + 'hi"\n\n'
    assert m[3].content == last + formats.INSTRUCTIONS
    bare = prompt(spark, "nl", every_turn=False)
    assert bare[3].content == last and formats.GUIDELINES not in bare[1].content


def test_services(spark):
    m = prompt(spark, "SGD-nl", domains=F.col("d"), cards=CARDS, every_turn=False)
    drawn = [random.Random(n).choice(list(CARDS)) for n in range(4)]
    want = "".join(f"  {i}. {CARDS[n]}" for i, n in enumerate(["Train", *drawn[1:]], 1))
    assert m[1].content.startswith(formats.GUIDELINES + want + formats.TITLE.replace("{}", "1"))
    assert formats.SERVICE_INSTRUCTIONS not in m[1].content and m[3].content.endswith(formats.SERVICE_INSTRUCTIONS)
    many = ({}, None, "hi", list(CARDS), [])
    m = prompt(spark, "sgd", many, domains=F.col("d"), cards=CARDS)
    assert m[1].content.startswith(formats.GUIDELINES + "".join(f"  {i}. {c}" for i, c in enumerate(CARDS.values(), 1)) + formats.TITLE.replace("{}", "1"))
    with pytest.raises(ValueError):
        formats.prompt("sgd", "s", F.col("x"), F.col("c"), F.col("s"), F.col("u"), cards=CARDS)


def test_code(spark):
    m = prompt(spark, "python-prompt", guidelines="rules")
    assert m[1].content.startswith("rules    \n\n    #### Example 1 ####") and m[2].content == '    agent.state.a = agent.find_a(b="c|e")\n'
    r = prompt(spark, "python-prompt-NULL")
    assert r[1].content.endswith('agent.find_a(b="c|e")\n') and r[3].content == "\n    #### Example 2 ####\n"


def plain_numbers(t):
    """Phone numbers, then postcodes, then runs of number words, one after the other."""
    t = re.sub(X.PHONE, lambda m: m[1] + m[2] + m[3], t)
    t = re.sub(X.POSTCODE, lambda m: "".join(m.groups()), t)
    out = []
    for w in t.replace("-", " ").replace("(", "").replace(")", "").split():
        if out and w.isdecimal() and out[-1].isdecimal():
            out[-1] += w
        else:
            out.append(w)
    return " ".join(out)


def test_clean_text_equals_a_plain_version(spark):
    r = random.Random(6)
    parts = ["123", "4567", "89012", "1", "22", "(012)", "555-", "-", " ", "  ", "cb", "c b", "1 2", "ab ", "cb1 2ab", "x", " a b 1  2 c d "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_text(F.col("t")).alias("c"))
    for x in df.collect():
        assert x.c == plain_numbers(x.t), x.t


def test_clean_text(spark):
    cases = {
        "Call 01223-456789 or (012) 345 67890!": "call 01223456789 or 01234567890 !",
        " It's CB1 2AB, b&b;  ok? ": "it is cb12ab , bed and breakfast , ok ?",
        "10.30 am, 7/8": "10.30 am , 7 and 8",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", X.clean_text(F.col("t"), [("it s", "it is")]).alias("c"))
    assert {x.t: x.c for x in df.collect()} == {**cases, None: None}
