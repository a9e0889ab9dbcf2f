from pyspark.sql import functions as F

from riskweave.sources import files


def test_card_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "TransactionID,Timestamp,Amount,MerchantCategory,PaymentMethod,NewDeviceFlag,Country,AvgTxSize,TxFrequency,Fraudulent\n"
        "T1,2025-01-12 06:18:00,5.21,Grocery,UPI,1,IN,21.69,1,0\nT2,2025-05-27 17:58:00,4915.74,Jewelry,Debit,0,US,798.14,15,1\n")
    got = files.read_csv(spark, str(tmp_path / "t.csv"), files.CARD_TRANSACTIONS)
    assert got.count() == 2 and got.agg(F.sum("Amount"), F.sum("Fraudulent")).first()[1] == 1
    assert files.normalize_columns(got).columns[0] == "transactionid"


def test_multiline_answers_round_trip(spark, tmp_path):
    answers = [("Q1", 'line one\nline "two", end', "Pending"), ("Q2", "", "Pending"), ("Q3", None, "Pending")]
    df = spark.createDataFrame(answers, files.STORED_ANSWERS)
    files.write_csv(df, str(tmp_path / "out"))
    got = files.read_csv_multiline(spark, str(tmp_path / "out"), files.STORED_ANSWERS)
    assert {r[0]: r[1] for r in got.collect()} == {"Q1": 'line one\nline "two", end', "Q2": "", "Q3": None}


def test_json_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("i int, s string").json(str(tmp_path / "j")).collect())) == [(1, "a"), (2, None)]
    assert [r[0] for r in files.as_json(df).orderBy("record").collect()] == ['{"i":1,"s":"a"}', '{"i":2,"s":null}']
    files.write_report(spark.createDataFrame([("x\ny",)], "block string"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["x", "y"]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, s string")
    good, bad = files.quarantine_invalid(df, F.col("s") == "ok")
    assert [r["i"] for r in good.collect()] == [1] and sorted(r["i"] for r in bad.collect()) == [2, 3]


def test_image_folders(spark, tmp_path):
    jpeg, png = b"\xff\xd8\xff\xe0data\xff\xd9", bytes.fromhex("89504E470D0A1A0A") + b"data" + bytes.fromhex("AE426082")
    for folder, name, content in [("Cat", "1.jpg", jpeg), ("Cat", "2.jpg", jpeg[:-2]), ("Dog", "1.jpg", png), ("Dog", "2.jpg", b""), ("Dog", "3.jpg", jpeg)]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    df = files.labelled_files(spark, str(tmp_path))
    assert {r["folder"] for r in df.collect()} == {"Cat", "Dog"}
    assert {r["subset"] for r in df.collect()} <= {"training", "validation"}
    got = files.quarantine_counts(df, F.col("folder"), files.looks_like_image(F.col("content")))
    assert {tuple(r) for r in got.collect()} == {("Cat", 1, 1), ("Dog", 2, 1)}
