"""Labels that begin alike are told apart before their pattern is tried."""

from dossier.operators import ground as R


def test_labels_of_one_first_word_are_told_apart_before_the_pattern(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(R.X, "whole_word", lambda label, text: tried.append(1) or R.F.lit(True))
    ent = spark.createDataFrame([(str(i), f"Supplier#{i:05d} Ltd") for i in range(300)] + [("s", "supplier"), ("d", "#00007")], "id string, label string")
    chunk = spark.createDataFrame([("1", "the Supplier#00007 ltd owns Supplier#00009 Ltd."), ("2", "supplier 00007")], "id string, body string")
    got = {(r.entity, r.chunk) for r in R.mentions(ent, chunk).collect()}
    assert tried and got == {("7", "1"), ("9", "1"), ("s", "1"), ("s", "2"), ("d", "1"), ("d", "2")}
