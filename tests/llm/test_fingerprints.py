"""Homomorphism, likeness and the edited texts against plain Python."""
import hashlib

from pyspark.sql import functions as F

from gridlake.llm import fingerprints as fp

ROWS = [(5, "ä one. two.\nthree. four", "x"), (2, None, "x"), (9, "", "x"), (7, "three. four\n\n  \nä one. two.", "x"), (30, "😀b" * 3000 + "\n" + "z. " * 999, "x"),
        (31, "a", "x"), (40, "\n\n", "x"), (41, "ä one. two.\nthree. four", "x")]


def edited(rows):
    rows = sorted(rows)
    for k, (i, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        yield i, t, t[:len(t) - h] + nxt[:h], nxt


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, print string")
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    assert len(got) == len(ROWS)
    prints = {}
    for i, t, e, nxt in edited(ROWS):
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest(), i
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert (prints.setdefault(e, r["edited_fingerprint"])) == r["edited_fingerprint"]
        if t == nxt:
            assert r["near_next"] == 1
    assert got[5]["fingerprint"] == got[7]["fingerprint"] == got[41]["fingerprint"] != got[31]["fingerprint"]
    assert fp.fingerprints(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs.limit(1)).first()["near_next"] == 1


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("a. b\nc", "d\na. b", "c\nd\na. b\na. b")], "x string, y string, z string")
    for c in "xyz":
        df = fp.with_fingerprint(df, F.col(c), f"p{c}")
    df = df.withColumn("s", fp.added("px", "py")).withColumn("m", fp.removed("pz", "py"))
    r = df.first()
    assert r["s"] == r["pz"] and r["m"] == r["px"] and r["px"] != r["py"]


def test_next_over_many_buckets(spark):
    ids = [k * k % 1009 for k in range(400)] + [None, 3, 3]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, v string").repartition(3)
    got = fp.with_next(df, {"v": "w"}, buckets=37)
    order = sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((str(a), str(b)) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((r["v"], r["w"]) for r in got.collect()) == want


def test_likeness_tells_edits_from_strangers(spark, sf_small="/root/testdata/sf0.001"):
    r = fp.fingerprints(spark.read.parquet(f"{sf_small}/documents.parquet").filter("n_chars > 1000")).agg(
        F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > 0.4 and r[1] < 0.2
