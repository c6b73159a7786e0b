import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from riskgraph.llm import secrets
from riskgraph.session import scratch_path

SF = "/root/testdata/sf0.01"
BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return (*(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(spans.encode()).hexdigest(), spans)


def result(df, ledger):
    return {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in r.spans.split(",") if s.split(":")[0] != "pem"))
            for r in secrets.digest(secrets.secrets(df, ledger)).collect()}


@pytest.fixture
def ledger(spark):
    return scratch_path(spark, "ledger-test")


def test_table(spark, ledger):
    t = pq.read_table(f"{SF}/documents.parquet")
    want = {i: brute(x) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())}
    assert sum(w[0] + w[1] + w[2] for w in want.values()) > 10
    assert result(spark.read.parquet(f"{SF}/documents.parquet"), ledger) == want


def test_made(spark, ledger):
    rng = random.Random(1)
    parts = ["password=", "Token : ", "secret:", "API_KEY='", "apikey\"=\"", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, " ", "é\U0001f600", "\n",
             "token=secret=", "x" * 13, "token=ab:", "AKIAAKIA", "-----BEGIN RSA PRIVATE KEY-----", "f", "g"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "token=secret:abcdefghijklmnopq"), (1003, "deadbeefdeadbeef " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, ledger) == {i: brute(t) for i, t in rows}
    pem = {r.doc_id for r in secrets.secrets(df, ledger).collect() if any(f.kind == "pem" for f in r.findings)}
    assert pem == {i for i, t in rows if t and "-----BEGIN RSA PRIVATE KEY-----" in t}


def test_ledger_scans_only_unseen_pairs(spark, ledger):
    one = [secrets.RULES[2]]
    old = spark.createDataFrame([(1, "deadbeefdeadbeef"), (2, "deadbeefdeadbeef"), (3, "none")], "doc_id long, text string")
    secrets.secrets(old, ledger, one).count()
    rows = lambda: sorted((r.blob[:4], r.rule, r.version, len(r.spans)) for r in spark.read.parquet(ledger).collect())
    first = rows()
    assert len(first) == 2  # two blobs, one rule
    new = old.union(spark.createDataFrame([(4, "cafecafecafecafe"), (2, "none")], old.schema))
    got = secrets.secrets(new, ledger, one)
    assert sorted((r.doc_id, len(r.findings)) for r in got.collect()) == [(1, 1), (2, 0), (2, 1), (3, 0), (4, 1)]
    assert len(rows()) == 3  # the new blob alone
    secrets.secrets(new, ledger, secrets.RULES[:3]).count()
    assert len(rows()) == 9  # two more rules for each of three blobs
    changed = secrets.Rule("hex", 2, "[0-9a-f]+", 0, 17)
    assert all(r.findings == [] for r in secrets.secrets(new, ledger, [changed]).collect())
    assert len(rows()) == 12
    secrets.secrets(new, ledger, [changed, *secrets.RULES[:3]]).count()
    assert len(rows()) == 12  # nothing left to scan


def test_empty_and_clashing_columns(spark, ledger):
    df = spark.createDataFrame([(None, "deadbeefdeadbeef", "x"), (1, "deadbeefdeadbeef", "y"), (1, "deadbeefdeadbeef", "y")], "doc_id long, text string, blob string")
    assert secrets.digest(secrets.secrets(df.limit(0), ledger)).collect() == []
    assert sorted(((r.doc_id, r.n_hex) for r in secrets.digest(secrets.secrets(df, ledger)).collect()), key=str) == [(1, 1), (1, 1), (None, 1)]
