"""Pseudonyms of dates are permutations of each format, and of other kinds that were left in the clear before."""

from pyspark.sql import functions as F

from marginalia.llm import pseudonyms


def test_all_dates_of_a_cycle_in_every_format(spark):
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("t"))
    forms = [F.date_format("t", f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "MM/dd/yyyy", "M/d/yyyy", "M/dd/yyyy", "dd/MM/yyyy", "d/M/yyyy")]
    texts = days.select(F.explode(F.array(*forms)).alias("text")).distinct().repartition(4)
    got = pseudonyms.pseudonymise(texts.withColumn("before", F.col("text")), "key").select("before", F.col("text").alias("after"), "_n_replaced")

    def shape(c):
        return F.regexp_replace(c, "[0-9]", "0")

    def late(c):
        return c.rlike("^[0-9]+/") & (F.regexp_extract(c, "^[0-9]+", 0).cast("int") > 12)

    counts = got.agg(
        F.count(F.lit(1)).alias("n"), F.sum((shape(F.col("before")) == shape(F.col("after"))).cast("int")).alias("form"), F.sum((late(F.col("before")) == late(F.col("after"))).cast("int")).alias("reading"),
        F.count_distinct("after").alias("results"), F.sum(F.col("before").isin("x").cast("int")).alias("x"), F.sum((F.col("before") != F.col("after")).cast("int")).alias("moved"),
    ).first()
    assert counts.n == counts.form == counts.reading == counts.results
    assert counts.moved > 0.99 * counts.n
    same = {r.before: r.after for r in got.where("before in ('2024-02-29', '29.02.2024', '02/29/2024')").collect()}
    y, m, d = same["2024-02-29"].split("-")
    assert same["29.02.2024"] == f"{d}.{m}.{y}" and same["02/29/2024"] == f"{m}/{d}/{y}"


def after(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(docs, "key").orderBy("doc_id").collect()]


def rest97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_values_that_once_stayed(spark):
    long_name = "a" * 90
    before = [
        f"mail {long_name}@mail.example.com", "password" + " " * 9 + "= hunter2x", "api_key: 4fZ09aQx", "Authorization: Bearer abc.DEF-123", "secret=q9w8e7", "call +44 20 7946 0958", "call +12125551234",
        "to GB82 WEST 1234 5698 7654 32 now", "card 4041 8949 7460 8795 12", "\x01 mail bob@x.example.com \x01\x02 password=a\x01b",
    ]
    new = after(spark, *before)
    assert all(a != b and len(a) == len(b) for a, b in zip(before, new)), new
    assert new[0].endswith("@mail.example.com") and long_name not in new[0]
    assert new[3].startswith("Authorization: Bearer ") and "abc" not in new[3]
    assert new[5].startswith("call +44 ") and [c.isdigit() for c in new[5]] == [c.isdigit() for c in before[5]]
    assert new[6][5:7] == "+1" and after(spark, "call 212-555-1234")[0][5:].replace("-", "") == new[6][7:]
    iban = new[7][3:-4].replace(" ", "")
    assert iban[:2] == "GB" and rest97("GB82WEST12345698765432") == 1 == rest97(iban) and iban[4:8].isalpha()
    assert new[8].endswith(" 12") and new[8][:24] == after(spark, "card 4041 8949 7460 8795")[0]
    assert new[9].startswith("\x01 mail ") and "@x.example.com \x01\x02 password=" in new[9]


def test_values_that_stay(spark):
    before = ["the secret: be kind", "a token of thanks, password protected", "+1 000 000 0000", "GB83 WEST 1234 5698 7654 32", "10/13/20 and 13/13/2020 and 2/30/2020", "in 1999-2003, 100+200", "author ization: none", ""]
    assert after(spark, *before) == before


def test_a_named_value_of_another_kind_stays_linked(spark):
    a, b = after(spark, "password=bob.42@mail.example.com", "mail bob.42@mail.example.com")
    assert a[9:] == b[5:] and "bob" not in a
