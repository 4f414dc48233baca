import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from corpweave.llm import queries
from corpweave.llm import trie as T
from tests.util import same


def rebuilt(rows):
    """conv_id -> turns (role, text), as the query rebuilds them, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, m), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: sorted(c for c in m if len(convs[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def wanted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def plain(spark, convs, parts=8):
    """Conversations as the operator takes them."""
    rows = [(c, k, r, x) for c, t in convs.items() for k, (r, x) in enumerate(t)]
    df = T.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("id", "turns")
    none = [(c,) for c, t in convs.items() if not t]
    if none:
        df = df.unionByName(spark.createDataFrame(none, "id long").select("id", F.slice(F.array(F.struct(F.lit("").alias("digest"), F.lit(0).alias("size"))), 1, 0).alias("turns")))
    return df.repartition(parts)


def blocks(spark, parts):
    """Sorted tables are dealt to so many blocks."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def whole(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_equals_its_oracle(spark, sf, duck):
    same(queries.queries()["op13_prefix_trie"](spark, sf), duck.sql(queries.oracle_sql()["op13_prefix_trie"]))


def test_query_equals_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(queries.queries()["op13_prefix_trie"](spark, sf)) == wanted(brute(rebuilt(rows)))


def test_runs_over_many_blocks(spark):
    rnd = random.Random(2)
    for parts, alphabet, n in ((13, "ab", 150), (40, "a", 80), (7, "abcdef", 200), (1, "ab", 60)):
        convs = {c: [("user", rnd.choice(alphabet)) for _ in range(rnd.randrange(7))] for c in rnd.sample(range(-500, 5000), n)}
        blocks(spark, parts)
        try:
            assert got(T.nodes(plain(spark, convs))) == wanted(brute(convs)), (parts, alphabet)
        finally:
            whole(spark)


def test_hot_prefixes_and_copies(spark, monkeypatch):
    """A third of all conversations are copies, most begin alike, one is very long."""
    rnd = random.Random(4)
    convs = {c: [("user", "hello"), ("assistant", "é" * 3)] + [("user", str(rnd.randrange(9))) for _ in range(rnd.randrange(4))] for c in range(200)}
    convs |= {c: [("user", "hello"), ("assistant", "x"), ("user", "y")] for c in range(1000, 1120)} | {5000: [("user", "hello")] * 400, 5001: [("user", "hello")] * 399 + [("user", "")]}
    blocks(spark, 23)
    monkeypatch.setattr(T, "PIECE", 3)
    try:
        assert got(T.nodes(plain(spark, convs))) == wanted(brute(convs))
    finally:
        whole(spark)


def test_query_with_odd_rows(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(-7, 25)]), rnd.choice([None, 0, 1, 1, 2, 5]), rnd.choice([None, "", "user"]), rnd.choice([None, "", "a", "long " * 5000])) for _ in range(150)]
    rows += rows[:5] + [(c, t, "user", "same") for c in (105, 106, 107) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as near", "3 as `a.b`")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    query, sql = queries.queries()["op13_prefix_trie"], queries.oracle_sql()["op13_prefix_trie"]
    assert got(query(spark, str(tmp_path))) == wanted(brute(rebuilt(rows)))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same(query(spark, str(tmp_path)), c.sql(sql))
    df.where("false").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert query(spark, str(tmp_path / "none")).collect() == []


def test_common():
    a, b = b"".join(hashlib.md5(x).digest() for x in (b"1", b"2", b"3")), b"".join(hashlib.md5(x).digest() for x in (b"1", b"4", b"3"))
    assert T.common(a, a) == 3 and T.common(a, b) == 1 and T.common(a, a[:16]) == 1 and T.common(b"", a) == 0
    assert T.common(b"\0" * 31 + b"\1", b"\0" * 32) == 1 and T.common(b"\0" * 16, b"\1" + b"\0" * 15) == 0
