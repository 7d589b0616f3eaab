import hashlib

from pyspark.sql import functions as F

from verbarium.llm import warc

TRAP = "head\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n tail é" * 4


def run(spark, rows):
    return sorted(map(tuple, warc.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as size", "'d' as digest").repartition(3)).collect()), key=repr)


def brute(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        again = len(raw) >= 100 and bool(same) and page != min(same)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    long = "x" * 99
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>" * 30) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", long), (103, "u", long), (104, "a\r\nb", long + "y"), (105, "u", long + "y"), (None, "u", long + "y"), (None, "u", "only null " * 20)]
    rows += [(106, "u", TRAP), (107, "u", TRAP), (108, "u", TRAP + "!"), (109, "u", "WARC/1.1\r\n"), (3, "again", rows[3][2]), (110, "u", "\r\n" * 300), (111, "u", "é" * 200000)]
    assert run(spark, rows) == brute(rows)


def test_crowded_map_of_revisits(spark, monkeypatch):
    """Pages that share a bit with a revisit are told from it."""
    monkeypatch.setattr(warc, "MAP_BITS", 16)
    monkeypatch.setattr(warc, "ROW_BITS", 8)
    rows = [(i, f"http://a/{i}", f"<p>{i % 90}</p>" * 30) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_map_has_every_revisit(spark):
    again = spark.range(2000).selectExpr("if(id = 7, null, id * 31) as _id", "id * id * 977 as _mark")
    bits = 1 << 20
    place = warc._place(bits, "_id", "_mark")
    held = again.join(warc._bits(again, bits), F.floor(place / warc.ROW_BITS) == F.col("_row")).where(warc._bit("_map", place % warc.ROW_BITS))
    others = spark.range(5000, 9000).selectExpr("id as _id", "id as _mark")
    assert held.count() == 2000 and others.join(warc._bits(again, bits), F.floor(place / warc.ROW_BITS) == F.col("_row")).where(warc._bit("_map", place % warc.ROW_BITS)).count() < 40


def test_empty(spark):
    assert run(spark, []) == []


def test_payloads_and_small_splits(spark, tmp_path):
    """Splits far smaller than records: chains cross many of them."""
    rows = [(i, "u", (TRAP * (i % 3) + f"page {i} ") * (1 + 40 * (i % 5))) for i in range(40)]
    path = str(tmp_path / "a")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, path, payloads=True).where("type = 'response'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    seen, expected = set(), {}
    for page, _, html in rows:
        if html not in seen:
            seen.add(html)
            expected[f"<urn:page:{page}>"] = html
    assert got == expected
