import random

from pyspark.sql import functions as F

from spanguard.functions import tokens, validators
from spanguard.functions.restoring import Known, Restorer
from spanguard.functions.synth import surrogate
from spanguard.operators import detect, pseudonymize, restore

TALK = [
    (1, 0, "I am a@b.io, call 415-555-1234"),
    (1, 1, "a@b.io again, and 10.1.2.3"),
    (1, 2, "nothing here"),
    (2, 0, "a@b.io in another talk; card 4532015112830366"),
    (2, 1, None),
]


def talk(spark):
    return detect.detect(spark.createDataFrame(TALK, "conv_id long, turn long, text string"))


def test_vault_and_roundtrip(spark):
    rows = talk(spark)
    v = pseudonymize.vault(detect.explode(rows, ["conv_id", "turn"]), ["turn", "start"])
    got = {(r.conv_id, r.original): r for r in v.collect()}
    assert [got[1, x].ordinal for x in ("a@b.io", "415-555-1234", "10.1.2.3")] == [0, 1, 2]
    assert got[1, "a@b.io"].synthetic != got[2, "a@b.io"].synthetic
    assert len({r.token_id for r in got.values()}) == len(got)
    for form in ("bare", "xml"):
        masked = pseudonymize.rewrite(rows, v, ["conv_id", "turn"], form=form)
        for r in restore.restore_messages(masked, v).collect():
            assert r.restored == r.text
            assert not any(s.text in r.masked for s in r.spans or [])


def test_token_vector_and_seed(spark):
    row = spark.range(1).select(tokens.token_id(F.lit("conv-abc"), F.lit(0)), tokens.vault_seed(F.lit("x")).cast("string")).first()
    assert row[0] == "TVcSlVjz"
    import hashlib

    assert row[1] == str(int.from_bytes(hashlib.sha1(b"x").digest()[:8], "little"))


def test_surrogates_are_valid_and_differ(spark):
    df = spark.range(300).select(F.lit("c").alias("conv"), F.col("id").alias("k"))
    made = df.select("k", *[surrogate("conv", "k", f"'{e}'", f"'{o}'").alias(e) for e, o in (("CREDIT_CARD", "5105-1051"), ("CPF_NUMBER", "x"), ("EMAIL", "x"), ("URL_WITH_CREDS", "https://a:b@host.example/x"), ("OTHER", "abc"))])
    got = made.select("*", validators.luhn(F.col("CREDIT_CARD")).alias("luhn"), validators.cpf(F.col("CPF_NUMBER")).alias("cpf")).collect()
    assert all(r.luhn and r.cpf and r.CREDIT_CARD[0] == "5" and r.URL_WITH_CREDS.endswith("@host.example/x") for r in got)
    for c in ("CREDIT_CARD", "CPF_NUMBER", "EMAIL", "URL_WITH_CREDS", "OTHER"):
        assert len({r[c] for r in got}) == len(got)


def test_merge_latest_insert(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 1)], "conv_id long, original string, version int")
    b = spark.createDataFrame([(9, "x", 2), (9, "z", 2)], "conv_id long, original string, version int")
    assert sorted(r.original for r in pseudonymize.merge_vaults(a, b, F.lit(1).cast("long")).collect()) == ["x", "y", "z"]
    assert [r.version for r in pseudonymize.latest(a.unionByName(b.withColumn("conv_id", F.lit(1).cast("long"))), ["conv_id"], "version").collect()] == [2, 2]


def test_replacements_by_offset(spark):
    df = spark.sql("SELECT 'call Ann now' AS t, array(named_struct('start', 5, 'end', 8, 'display_value', 'Eve', 'pii_type', 'N'), named_struct('start', 6, 'end', 99, 'display_value', '?', 'pii_type', 'N')) AS r")
    assert df.select(pseudonymize.apply_replacements(F.col("t"), F.col("r"))).first()[0] == "call Eve now"


def test_stream_buffer_gives_the_same_text_for_any_chunks():
    rnd = random.Random(7)
    keys = {"Brown": "B", "Alice Brown": "AB", "555-0001": "P", "<x": "L"}
    ids, shown = {"T1": "a@b.io"}, {"Eve": "Ann"}
    pieces = ['<pii id="T1">zz</pii>', '<pii id="??">Eve</pii>', "<pii>Eve</pii>", '<pii id="q">w</pii>', "Brown", "Alice ", "Alice Brown", "555-", "0001", "<pi", "<", "<pii", " and ", "<x"]
    for _ in range(400):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8)))
        whole = Restorer(Known(ids, shown, keys))
        want = whole.feed(text) + whole.finish()
        r, out, at = Restorer(Known(ids, shown, keys)), "", 0
        while at < len(text):
            n = rnd.randint(1, 5)
            out += r.feed(text[at : at + n])
            at += n
        assert out + r.finish() == want


def test_stream_query_restores_everything(spark):
    from spanguard.plans.queries import stream_restore

    assert stream_restore(spark, "/root/testdata/sf0.001").where("equal IS NOT TRUE").count() == 0
