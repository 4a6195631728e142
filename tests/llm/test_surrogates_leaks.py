"""Names of more words, initials and capitals; short addresses beyond their own space; code and moments are left alone."""

import re

from tracewright.llm import surrogates as s


def replaced(spark, *texts):
    out = s.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])]


def test_three_hundred_short_addresses(spark):
    short = [f"{a:x}::{b:x}" for a in range(16) for b in range(16)] + [f"{a}::{b:x}0" for a in range(1, 10) for b in range(1, 8)]
    short = [x for x in dict.fromkeys(short) if re.search(r"\d", x)]
    assert len(short) >= 250
    got = replaced(spark, *(f"at {x} now" for x in short))
    new = [t.split()[1] for t in got]
    assert len(set(new)) == len(short) and not set(new) & set(short)
    assert all(re.fullmatch(r"[0-9a-f:]+", x) for x in new)


def test_every_type_grows_beyond_its_form(spark):
    from pyspark.sql import functions as F

    kinds = {"ipv4": "10.0.0.%d", "ssn": "12345678%d", "card": "453957876362148%d", "phone": "101755577%02d"}
    for kind, form in kinds.items():
        e = spark.range(5).select(F.lit(kind).alias("kind"), F.format_string(form, "id").alias("canon"))
        a, b = (e.select(s.draw(F.col("canon"), F.col("kind"), r, "k").alias("x")).collect() for r in (0, s.GROW_ROUND + 3))
        assert {len(r["x"].split(".") if kind == "ipv4" else r["x"]) for r in b} == {len(a[0]["x"].split(".") if kind == "ipv4" else a[0]["x"]) + 2}


def test_names_of_many_words_initials_and_capitals(spark):
    texts = [
        "Dr. Martin Luther King spoke. King left.", "Mr. J. Smith and Mr. J. R. Smith, J. Smith.", "Mr John Smith wrote. Signed JOHN SMITH, john smith, SMITH; a smith.", "Mrs Anna Maria van Smith",
    ]
    a, b, c, d = replaced(spark, *texts)
    m = re.fullmatch(r"Dr\. (\w+) (\w+) (\w+) spoke\. (\w+) left\.", a)
    assert m[3] == m[4] and not {"Martin", "Luther", "King"} & set(m.groups())
    m = re.fullmatch(r"Mr\. ([A-Z])\. (\w+) and Mr\. ([A-Z])\. ([A-Z])\. (\w+), ([A-Z])\. (\w+)\.", b)
    assert m[1] == m[3] == m[6] and m[2] == m[5] == m[7] != "Smith"
    m = re.fullmatch(r"Mr (\w+) (\w+) wrote\. Signed (\w+) (\w+), (\w+) (\w+), (\w+); a smith\.", c)
    assert (m[3], m[4], m[5], m[6], m[7]) == (m[1].upper(), m[2].upper(), m[1].lower(), m[2].lower(), m[2].upper()) and m[2] != "Smith"
    assert re.fullmatch(r"Mrs \w+lia \w+ van Smith", d)


def test_code_and_moments_stay(spark):
    code = ["use abc::def() and dead::beef, a::b", "ts=1719848400123", "std::vec2::len(x) c0::f1(y) A_1::b2"]
    assert replaced(spark, *code) == code
    card = replaced(spark, "pay 4539578763621486 and 378282246310005")[0]
    assert not re.search("4539578763621486|378282246310005", card) and [len(x) for x in re.findall(r"\d+", card)] == [16, 15]


def test_mails_keep_their_capitals(spark):
    (got,) = replaced(spark, "John.Smith@Example.COM or john.smith@example.com or JOHN.SMITH@EXAMPLE.COM")
    a, b, c = re.findall(r"\S+@\S+", got)
    assert a.lower() == b == c.lower() and c.isupper()
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@[A-Z][a-z]{6}\.example\.COM", a)
