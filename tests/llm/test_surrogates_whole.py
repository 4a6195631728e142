from pyspark.sql import functions as F

from tracewright.llm import surrogates as s


def test_more_names_than_short_surrogates(spark, monkeypatch):
    # two different syllables: 16 surrogates of four
    monkeypatch.setattr(s, "_SYLLABLES", {k: [v[0], v[1]] * 8 for k, v in s._SYLLABLES.items()})
    kind = F.element_at(F.array(*map(F.lit, ("name_male", "name_female", "name_neutral"))), (F.col("id") % 3 + 1).cast("int"))
    names = spark.range(60).select(kind.alias("kind"), F.format_string("x%02d", "id").alias("canon"))
    out = s.assign(names, "k").collect()
    assert len(out) == len({r["surrogate"] for r in out}) == len({r["canon"] for r in out}) == 60
    assert min(len(r["surrogate"]) for r in out) == 8
