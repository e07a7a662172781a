import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import secrets


def brute_spans(text):
    """The contract's patterns as stated, matched without a least length and filtered afterwards."""
    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")).replace("_?", "_?") + ")"
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef", "é", "AKIA", "AKIAABCDEFGH1234567", "0123456789abcdef", "deadbeef", "\n", "==", "A", "ſ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_spans(text)


def test_models_tell_random_from_ordinary(spark, sf):
    model = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{sf}/documents.parquet")))
    r = random.Random(1)
    rand = ["".join(r.choices(string.ascii_letters + string.digits, k=32)) for _ in range(200)]
    found = [bool(secrets.random_spans(f"see {x} here", model, [])) for x in rand]
    assert sum(found) >= 190
    plain = ["getCustomerAccountBalance2024", "the_maximum_number_of_retries_2", "internationalization18andlocalization10", "/usr/local/share/applications/v2", "2024-01-15T10-20-30", "a" * 4000 + "1"]
    assert not [x for x in plain if secrets.random_spans(x, model, [])]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    assert not [d for d in docs if secrets.random_spans(d.text, model, secrets.base_spans(d.text))]


def test_op1_edges(spark):
    key = "q7Xk2Lw9ZpT4vB8nR3sD6fG1hJ5mC0yA"
    rows = [(1, f"é {key} token: abcdef"), (2, None), (3, ""), (None, "a" * 30), (4, "x" * 2_000_000 + " AKIA" + "B" * 16), (4, "dup")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, spans int, id string")
    out = {(r.doc_id, r.spans): r for r in secrets.op1(docs).collect()}
    assert len(out) == 6
    assert (1, f"random:2:{2 + len(key)},assign:35:48") in out
    assert out[4, "access:2000001:2000021"].n_access == 1 and (None, "hex:0:30") in out
    assert out[2, ""].base_sha256 == out[3, ""].base_sha256 and out[2, ""].n_hex == 0
    assert secrets.op1(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.op1(docs).collect():
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [(int(a), secrets.KINDS.index(k), int(z)) for k, a, z in spans if k != "random"] == brute_spans(texts[r.doc_id])
