import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import surrogates as s

# Python's re lacks \p classes; the test data is Latin-1, where these agree
PY = s.PATTERN.replace(r"[\p{L}\p{N}._%+-]++", r"[\w.%+-]+").replace(r"[\p{L}\p{N}._%+-]", r"[\w.%+-]").replace(r"[\p{L}\p{N}-]", r"[\w-]").replace(r"\p{Lu}", "[A-ZÀ-ÞА-ЯΑ-Ω]").replace(r"[\p{L}'-]", r"[^\W\d_'-]").replace(r"\p{L}", r"[^\W\d_]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10


def test_replacements(spark):
    rows = [
        (1, "Write to Ann.Lee7@mail3.example.com or ANN.LEE7@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713 / +1 017 555 7713."),
        (2, "cards 4539578763621486 and 4539 5787 6362 1486 and 1234567890123456 7536784127813050, ip 97.51.17.173."),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 04DBEBAB91AB85687D33EEAAF9AC699E1188F962'),
        (4, "Mr. Smith met Mrs Anna Jones; Mr Smith left. Frau Müller, госпожа Анна Петрова, Κύριος Νίκος came. MR Nobody"),
        (5, None), (6, ""), (7, "clean text 1.2.3 and 12345, a@b"), (1, "clean"), (8, "97.51.17.173"), (None, "x 97.51.17.173"), (9, "+1 (017) 555-7713+1 (018) 555-7713"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    out = s.replace_pii(docs, "k1")
    assert out.columns == ["doc_id", "key", "n_pii", "text"] and out.count() == len(rows)
    got = {(r["doc_id"], r["n_pii"]): r["text"] for r in out.collect()}
    one = got[1, 4]
    a, b = re.findall(r"\S+@\S+\w", one)
    assert a.lower() == b.lower() and b.isupper() and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@[a-z]{4}\d\.example\.com", a) and a.lower() != "ann.lee7@mail3.example.com"
    p, q = re.findall(r"\+1 [\d() -]+\d", one)
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713" and p[3] == "(" and q[3] != "("
    two = re.findall(r"\d{16}|(?:\d{4} ){3}\d{4}", got[2, 5])
    assert two[0] == two[1].replace(" ", "") and luhn(two[0]) == 0 and luhn("4539578763621486") == 0 and luhn(two[2]) != 0
    ip = re.search(r"2[45]\d\.\d+\.\d+\.\d+", got[2, 5]).group()
    assert got[8, 1] == ip and got[None, 1] == "x " + ip
    x, y = re.findall(r"[0-9a-fA-F]{40}", got[3, 2])
    assert x.upper() == y and x != "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    four = got[4, 6]
    assert re.match(r"Mr\. (\w+) met Mrs \w+lia \w+; Mr \1 left\. Frau [A-Z]\w+, госпожа [А-Я]\w+ля [А-Я]\w+, Κύριος [Α-Ω]\w+ came\. MR Nobody$", four) and "Smith" not in four
    assert got[5, 0] is None and got[6, 0] == "" and got[7, 0] == rows[6][1]
    assert len(set(re.findall(r"\d{3}-\d{4}", got[9, 2]))) == 2
    other = {(r["doc_id"], r["n_pii"]): r["text"] for r in s.replace_pii(docs, "k2").collect()}
    assert other[2, 5] != got[2, 5] and s.replace_pii(docs.where("false"), "k").count() == 0


def test_collisions_are_drawn_again(spark, monkeypatch):
    ids = spark.range(300).select(F.lit("card").alias("kind"), F.format_string("%03d", "id").alias("canon"))
    true = s.draw
    # the first rounds draw from a third of the space, in which all entities lie
    monkeypatch.setattr(s, "draw", lambda c, k, r, key: F.format_string("%03d", F.pmod(F.xxhash64(c, F.lit(r)), F.lit(1000))))
    out = s.assign(ids, "k", 200).collect()
    new = {r["surrogate"] for r in out}
    assert len(out) == len(new) == 300 and not new & {f"{i:03d}" for i in range(300)}
    monkeypatch.setattr(s, "draw", true)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in s.op4_pii_surrogates(spark, f"/root/testdata/{sf}").collect()}
    assert before.keys() == after.keys()
    real, where = set(), {}
    for i, t in before.items():
        found = re.findall(PY, t)
        real |= set(found)
        assert after[i]["n_pii"] == len(found)
        assert [x for x in re.split(PY, t)] == [x for x in re.split(PY, after[i]["text"])]
        for a, b in zip(found, re.findall(PY, after[i]["text"])):
            assert where.setdefault(a, b) == b
    assert len(real) > 20 and len(set(where.values())) == len(where)
    assert not [x for x in real for r in after.values() if x in r["text"]]
