import hashlib
import re

from pyspark.sql import functions as F

from salesengine.llm import queries, secret_scan
from tests.llm.helpers import SF001, docs, read

KINDS = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute(text):
    spans = []
    for rank, (kind, p) in enumerate(KINDS.items()):
        for m in p.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m):
                spans.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def check(out, pairs):
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out)
    want = []
    for i, t in pairs:
        b = brute(t)
        want.append((i, *(sum(x.startswith(k) for x in b) for k in KINDS), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert got == sorted(want)


def test_registered_query_against_brute_force(spark):
    d = read("documents")
    check(queries.op10_secret_scan(spark, SF001).collect(), list(zip(d["doc_id"], d["text"], strict=True)))


def test_patterns(spark, tmp_path):
    key = "0f" * 20
    texts = [None, "", f"token = \"{key}\"", f"é文 {key}é{key}g", "PASSWORD: abc", "Api_Key='abcd1234' apikey:xx token=token=12345678", "AKIA" + "Z" * 11, "AKIAAKIA" + "9" * 12, "xAKIA" + "A1" * 8,
             "paſſword=longenough1 toKen=longenough2", f"{key}\n" * 3000, f"{'a' * 31} {'a' * 32}", "-----BEGIN RSA PRIVATE KEY-----\nsecret = 'x.y/z+aaaa'"]
    pairs = [*enumerate(texts), (3, texts[3]), (50, texts[2])]
    folder = str(tmp_path)
    docs(spark, pairs).write.parquet(f"{folder}/documents.parquet")
    out = queries.op10_secret_scan(spark, folder).collect()
    check(out, pairs)
    assert [r["spans"] for r in out if r["doc_id"] == 12] == ["pem:0:31,assign:32:52"]


def test_ledger_is_incremental(spark):
    def versions(rows):
        return spark.createDataFrame(rows, "path string, version int, text string").withColumn("blob", F.lit("clash"))

    v1 = versions([("a", 1, "token = 12345678"), ("b", 1, "token = 12345678"), ("c", 1, "nothing"), ("c", 2, None)])
    rules = len(secret_scan.BASE_RULES + secret_scan.EXTRA_RULES)
    ledger = spark.createDataFrame(secret_scan.scan(v1).collect(), secret_scan.LEDGER_SCHEMA)
    assert ledger.count() == 3 * rules  # three contents

    v2 = v1.unionByName(versions([("a", 2, "nothing"), ("d", 1, "AKIA" + "B" * 16)]))
    fresh = secret_scan.scan(v2, ledger=ledger).collect()
    assert len(fresh) == rules  # only the one unseen content

    newer = (secret_scan.Rule("assign", secret_scan.BASE_RULES[0].pattern, 2, 2, 8, True), *secret_scan.BASE_RULES[1:])
    again = secret_scan.scan(v1, newer, ledger).collect()
    assert [(r["rule"], r["rule_version"]) for r in again] == [("assign", 2)] * 3

    full = ledger.unionByName(spark.createDataFrame(fresh, secret_scan.LEDGER_SCHEMA))
    at = {(r["path"], r["version"]): [(f["rule"], f["start"], f["end"]) for f in r["found"]] for r in secret_scan.findings(secret_scan.addressed(v2), full).collect()}
    assert at == {("a", 1): [("assign", 0, 16)], ("b", 1): [("assign", 0, 16)], ("c", 1): [], ("c", 2): [], ("a", 2): [], ("d", 1): [("access", 0, 20)]}


def test_repeated_versions_with_other_texts(spark):
    v = spark.createDataFrame([("a", 1, "token = 12345678"), ("a", 1, "clean"), ("a", 1, "clean"), (None, None, "AKIA" + "B" * 16)], "path string, version int, text string")
    addresses = secret_scan.addressed(v)
    out = secret_scan.findings(addresses, secret_scan.scan(v, addresses=addresses)).collect()
    assert sorted(len(r["found"]) for r in out) == [0, 0, 1, 1]
    none = spark.createDataFrame([], "path string, version int, text string")
    assert secret_scan.scan(none).count() == 0
