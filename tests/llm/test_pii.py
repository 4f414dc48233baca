import re

from pyspark.sql import functions as F

from corpweave.llm import pii

TEXT = (
    "Mail iork.24@mail7.example.com, call +1 (743) 555-3824 4663622617512349 or 4742 6047 9395 6271. ip 57.14.248.132, 999.1.1.1 1.2.3.4.5; "
    "born 1980-02-29 29.02.1981 13/02/1980 02/13/1980 ssn 123-45-6789 000-12-3456; DE89 3704 0044 0532 0130 00. +44 20 7946 0958; 1234567890123456 iork.24@mail7.example.com"
)
KINDS = ["email", "phone", "card", "card", "ipv4", "iso_date", "slash_date", "slash_date", "ssn", "iban", "phone", "email"]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))


def run(spark, rows, key="k", **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as f", "2 as `a.b`")
    return pii.pseudonymised(df, key, findings_col="found", **options)


def test_kinds_spans_and_formats(spark):
    out = run(spark, [(1, TEXT), (2, TEXT)]).collect()
    r = out[0]
    assert out[1].text == r.text and [f.kind for f in r.found] == KINDS
    at, rest = 0, ""
    for f in r.found:
        assert TEXT[f.start - 1 : f.start - 1 + len(f.value)] == f.value and f.pseudonym != f.value
        rest += TEXT[at : f.start - 1] + f.pseudonym
        at = f.start - 1 + len(f.value)
        if f.kind != "ipv4":
            assert shape(f.pseudonym) == shape(f.value)
        if f.kind == "card":
            assert luhn(f.pseudonym) % 10 == 0 and f.pseudonym[0] == f.value[0]
        if f.kind == "ipv4":
            assert all(0 <= int(x) < 256 for x in f.pseudonym.split("."))
        if f.kind == "iban":
            flat = f.pseudonym.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert r.text == rest + TEXT[at:]
    assert r.found[0].pseudonym == r.found[-1].pseudonym
    assert run(spark, [(1, TEXT)], key="other").first().text != r.text
    again = run(spark, [(1, r.text)]).first()
    assert [f.kind for f in again.found] == KINDS, "pseudonyms pass the same validation"


def feistel(values, radices, key, tag):
    import hashlib

    v = list(values)
    for r in range(pii.ROUNDS):
        other = ",".join(str(y) if j % 2 != r % 2 else "" for j, y in enumerate(v))
        h = lambda i: int(hashlib.sha256("|".join([key, tag, str(r), str(i), other]).encode()).hexdigest()[:12], 16)  # noqa: E731,B023
        v = [(x + h(i)) % radices[i] if i % 2 == r % 2 else x for i, x in enumerate(v)]
    return v


def test_permutation_equals_plain_feistel_and_is_one_to_one(spark):
    df = spark.range(12 * 7 * 3).selectExpr("id", "array(cast(id % 12 as bigint), cast(id div 12 % 7 as bigint), cast(id div 84 as bigint)) as v")
    rows = df.select("v", F.expr(pii.permuted("v", "array(12, 7, 3)", pii._sql("it's"), "t")).alias("p")).collect()
    assert all(r.p == feistel(r.v, [12, 7, 3], "it's", "t") for r in rows)
    assert len({tuple(r.p) for r in rows}) == len(rows)


def test_different_values_stay_different(spark):
    rows = [(i, f"id 10.{i // 250}.{i % 250}.9 and 2001-0{i % 9 + 1}-{i % 28 + 1:02d}") for i in range(1500)]
    found = [(f.value, f.pseudonym) for r in run(spark, rows).collect() for f in r.found]
    assert len({v for v, _ in found}) == len({p for _, p in found}) == len(set(found))


def dates_of(spark, frame, form):
    rows = frame.selectExpr(f"date_format(d, '{form}') as text")
    return {r.text: r.found for r in pii.pseudonymised(rows.withColumn("was", F.col("text")), "k", findings_col="found").selectExpr("was as text", "text as found").collect()}


def test_slash_dates_stay_different_and_keep_their_reading(spark):
    """All days of two centuries, month first and day first."""
    days = spark.range(0, 73000, 1, 8).selectExpr("date_add(date'1900-01-01', cast(id as int)) as d")
    month_first, day_first = dates_of(spark, days, "MM/dd/yyyy"), dates_of(spark, days.where("day(d) > 12"), "dd/MM/yyyy")
    all_ = month_first | day_first
    assert len(all_) == len(month_first) + len(day_first) and len(set(all_.values())) == len(all_)
    assert all(int(p[:2]) <= 12 for p in month_first.values()) and all(int(p[:2]) > 12 and int(p[3:5]) <= 12 for p in day_first.values())
    assert not any(v == p for v, p in all_.items() if v[:2] != p[:2])


def test_dates_of_all_years_are_replaced(spark):
    days = spark.range(0, 3652059, 997, 8).selectExpr("date_add(date'0001-01-01', cast(id as int)) as d")
    for form in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"):
        found = dates_of(spark, days, form)
        assert len(set(found.values())) == len(found) and all(shape(v) == shape(p) for v, p in found.items())
        assert sum(v == p for v, p in found.items()) <= 2
        near = [v for v in found if "1900" <= re.search(r"\d{4}", v)[0] <= "2100"]
        assert near and all("1900" <= re.search(r"\d{4}", found[v])[0] <= "2101" for v in near)
    r = run(spark, [(1, "13.05.1899 01/02/2150 2024-05-01T10:00 0000-01-01 2023-02-29 12024-05-01")]).first()
    assert [f.value for f in r.found] == ["13.05.1899", "01/02/2150", "2024-05-01"]


def test_longest_valid_part_of_a_number(spark):
    rows = [(1, "4111 1111 1111 1111 12/25"), (2, "4111 1111 1111 1111 123 x"), (3, "DE89 3704 0044 0532 0130 00 EUR"), (4, "NL91 ABNA 0417 1643 00 AB1"), (5, "4111-1111-1111-1111 7")]
    for r in run(spark, rows).collect():
        text = dict(rows)[r.doc_id]
        assert len(r.found) == 1 and r.text != text and shape(r.text) == shape(text), text
        tail = {1: " 12/25", 2: " 123 x", 3: " EUR", 4: " AB1", 5: " 7"}[r.doc_id]
        assert r.text.endswith(tail)


def test_no_key_in_a_plan(spark):
    secret = "a very secret key"
    df = run(spark, [(1, TEXT)], key=secret)
    df.collect()
    execution = df._jdf.queryExecution()
    plans = [spark._jvm.PythonSQLUtils.explainString(execution, mode) for mode in ("simple", "extended", "cost", "formatted", "codegen")]
    plans += [execution.toString(), execution.analyzed().toString(), execution.optimizedPlan().toString(), execution.executedPlan().toString()]
    keys = [pii.derived(secret, k) for k in ("date", *pii.PATTERNS)]
    assert not any(k in p for p in plans for k in (secret, *keys))
    assert pii.derived("a", "card") != pii.derived("b", "card") != pii.derived("b", "iban")


def brute_digits(value, kept, key, tag):
    """The plain Feistel on the digits of a value after the first ``kept``."""
    tail = [int(c) for c in value[kept:]]
    return value[:kept] + "".join(map(str, feistel(tail, [10] * len(tail), key, tag)))


def test_whole_table_equals_plain_python_for_cards_and_addresses(spark, sf):
    """Every card number and IPv4 address of the table, found and permuted by plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = 0
    for r in pii.pseudonymised(docs, "k", findings_col="found").collect():
        for f in r.found:
            if f.kind == "card" and re.fullmatch(r"\d+", f.value):
                head = brute_digits(f.value[:-1], 1, pii.derived("k", "card"), "card")
                assert f.pseudonym[:-1] == head and luhn(f.pseudonym) % 10 == 0
                seen += 1
            if f.kind == "ipv4":
                assert f.pseudonym == ".".join(map(str, feistel([int(x) for x in f.value.split(".")], [256] * 4, pii.derived("k", "ipv4"), "ipv4")))
                seen += 1
    assert seen > 10


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.pseudonymised(docs, "k", findings_col="found").collect()
    assert {r.doc_id for r in rows} == before.keys() and sum(len(r.found) for r in rows) > 30
    loose = re.compile(r"[\w.]+@[\w.]+\.[a-z]+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b")
    for r in rows:
        values = {f.value for f in r.found}
        for v in loose.findall(before[r.doc_id]):
            if not re.fullmatch(r"\d{16}", v) or luhn(v) % 10 == 0:
                assert v in values or not all(int(x) < 256 for x in v.split(".") if x.isdigit())
        assert not any(v in r.text for v in values if len(v) > 12)
        if not values:
            assert r.text == before[r.doc_id]


def test_odd_rows_and_native_plan(spark):
    rows = [(1, None), (2, ""), (3, "a@" * 50000), (4, "1.2." * 50000), (5, "9" * 100000), (6, "x" * 300000 + "@"), (None, "57.14.248.132"), (8, "57.14.248.132"), (8, "57.14.248.132")]
    df = run(spark, rows)
    got = df.collect()
    assert len(got) == len(rows) and got[0].text is None and got[0].found == [] and [r.text for r in got[1:6]] == [t for _, t in rows[1:6]]
    assert got[6].text == got[7].text == got[8].text != "57.14.248.132"
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert run(spark, rows).limit(0).count() == 0 and set(df.columns) == {"doc_id", "text", "f", "a.b", "found"}
