import base64
import json
import random
import re
import uuid

from lemmata.llm import secrets

SCHEMA = "doc_id long, text string, extra string, n_chars long"


def test_base_spans():
    spans = secrets.base_spans
    assert spans("Password: hunter22 x") == [(0, 0, 18)]
    assert spans("token=abc") == []
    assert spans("secret:token: abcdef") == []  # the failing match has eaten the keyword
    assert spans("paſſword=abcdefgh") == []  # only ASCII letters in either case
    assert spans("AKIA" + "A" * 15) == [] and spans("xAKIA" + "A1" * 8) == [(1, 1, 21)]
    assert spans("é " + "0a" * 12) == [(2, 2, 26)]
    assert spans("api_key = \"abcdef0123456789abcdef0123\"") == [(0, 0, 37), (11, 2, 37)]


def test_models_separate_keys_from_words():
    model = secrets.ratio_model(["ordinary", "words", "thatthe", "running", "ciónmente"] * 50)
    keys = secrets.random_samples(400, seed=99)
    names = secrets.identifier_samples(400, seed=98)
    hit = sum(secrets.score(k, model) > secrets.THRESHOLD for k in keys if len(k) >= secrets.MIN_TOKEN)
    false = sum(secrets.score(n, model) > secrets.THRESHOLD for n in names)
    assert hit > 0.8 * len(keys) and false <= 2


def test_scan_and_redaction(spark):
    key = "q9Zx7LmW2pTn8RbVkY4sHd6J"
    texts = ["token = 'abcdef123' end", f"use {key} now", None, "", "plain words only", f"AKIA{'7' * 16} {'0123456789abcdef' * 2}"]
    docs = spark.createDataFrame([(i, t, "e", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "e", 1)], SCHEMA)
    model = secrets.ratio_model(["plain", "words", "only", "end", "now"] * 20)
    out = {r["doc_id"]: r for r in secrets.scan_secrets(docs, model).collect()}
    assert (out[0]["n_assign"], out[0]["spans"]) == (1, "assign:0:18")
    assert out[1]["n_hex"] == 0 and out[1]["spans"] == f"random:4:{4 + len(key)}"
    assert out[2]["spans"] == out[3]["spans"] == out[4]["spans"] == ""
    assert re.fullmatch(r"access:0:20,hex:21:53", out[5]["spans"])
    clean = secrets.redact_secrets(docs, model).collect()
    assert len(clean) == 7 and clean[0].asDict().keys() == {"doc_id", "text", "extra", "n_chars"}
    got = {r["doc_id"]: r["text"] for r in clean}
    assert got[1] == "use [SECRET] now" and got[0] == "[SECRET]' end" and got[2] is None and got[4] == texts[4]
    assert secrets.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_that_holds_a_base_span_goes_whole():
    model = secrets.ratio_model(["plain", "words", "only", "end", "now"] * 20)
    key = "0123456789abcdef01234567" + "ZqX9TvK2LmW7RbY4PjH8"
    text = f"use {key} now"
    spans = secrets.all_spans(text, secrets.base_spans(text), model)
    assert secrets.base_spans(text) == [(4, 2, 28)] and (4, 2, 28) in spans
    assert secrets.redacted(text, spans) == "use [SECRET] now"
    text = "token = 0123456789abcdef01234567"  # lies within
    assert secrets.all_spans(text, secrets.base_spans(text), model) == secrets.base_spans(text)


def test_ordinary_words_come_from_whole_documents(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(secrets, "ratio_model", lambda words, secret: taken.append(list(words)))
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(5000)), 0), (2, "b c", 0)], "doc_id long, text string, n int")
    secrets.fitted(docs)
    assert len(taken[0]) == 5002 and "a4999" in taken[0]
    monkeypatch.setattr(secrets, "TRAIN_WORDS", 5001)
    secrets.fitted(docs)
    assert len(taken[1]) in (2, 5000)  # whole documents only


def scanned(text):
    """The base spans, character by character, without regular expressions."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    word = lambda c, extra: c.isascii() and c.isalnum() or c in extra
    out, at = [], 0
    while at < len(text):
        found = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            i = at + len(name)
            if lower[at:i] != name:
                continue
            i += text[i : i + 1] in ("'", '"') and i < len(text)
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "="):
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            i += text[i : i + 1] in ("'", '"') and i < len(text)
            end = i
            while end < len(text) and word(text[end], "+/_.=-"):
                end += 1
            if end > i:
                found = (i, end)
                break
        if found and found[1] - found[0] >= 6:
            out.append((at, 0, found[1]))
        at = found[1] if found else at + 1
    for kind, start, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(start)
            while end < len(text) and text[end] in chars:
                end += 1
            if text[at : at + len(start)] == start and end > at + len(start):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_spans_against_a_plain_scanner():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "api", "_", "key", "'", '"', " ", "  ", ":", "=", "abc", "x.y-z", "AKIA", "AKI", "A1B2C3D4E5", "0a1b2c3d4e5f", "f00", "é", "ſ", "K", "\n", "/+", "Z"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets.base_spans(text) == scanned(text), text


def test_added_spans_are_the_scored_tokens():
    rng = random.Random(5)
    model = secrets.ratio_model(["plain", "words", "only", "end", "now"] * 20)
    alphabet = "abcXYZ019+/_=- .,\n"
    for _ in range(300):
        text = " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 50))) if rng.random() < 0.5 else rng.choice(["token=abcdef12", "0123456789abcdef" * 2]) for _ in range(8))
        base, want = secrets.base_spans(text), []
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in secrets.ALPHABET:
                end += 1
            if end - at >= secrets.MIN_TOKEN and secrets.score(text[at:end], model) > secrets.THRESHOLD and not any(s <= at and end <= e for s, _, e in base):
                want.append((at, 3, end))
            at = max(end, at + 1)
        assert secrets.all_spans(text, base, model) == sorted(base + want)


def test_keys_of_another_make(spark):
    """Keys made by other means than the training samples, among the long tokens of documents that do not train."""
    rng = random.Random(6)
    b58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    data = lambda n: bytes(rng.getrandbits(8) for _ in range(n))
    keys = [base64.b64encode(data(rng.randint(18, 48))).decode() for _ in range(200)]
    keys += ["ghp_" + "".join(rng.choices(b58, k=36)) for _ in range(200)] + ["sk_live_" + "".join(rng.choices(b58, k=24)) for _ in range(200)]
    keys += [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)]
    keys += [base64.urlsafe_b64encode(json.dumps({"u": rng.getrandbits(60), "k": data(12).hex()}).encode()).decode() for _ in range(200)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = secrets.fitted(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ordinary = [m.group() for t in texts for m in secrets.TOKEN.finditer(t) if not secrets.base_spans(t[max(0, m.start() - 40) : m.end() + 40])]
    words = sorted({w for t in texts[:400] for w in re.findall("[a-z]{3,}", t)})
    ordinary += ["_".join(rng.sample(words, 4)) for _ in range(300)] + ["/".join(rng.sample(words, 5)) for _ in range(300)] + ["".join(map(str.capitalize, rng.sample(words, 4))) for _ in range(300)]
    ordinary = [w for w in ordinary if len(w) >= secrets.MIN_TOKEN]
    found = sum(secrets.score(k, model) > secrets.THRESHOLD for k in keys)
    false = sum(secrets.score(w, model) > secrets.THRESHOLD for w in ordinary)
    print("recall", found / len(keys), "precision", found / (found + false), "ordinary", len(ordinary))
    assert found / len(keys) > 0.9 and found / (found + false) > 0.95


def test_text_of_ten_megabytes():
    model = secrets.ratio_model(["plain", "words", "only", "end", "now"] * 20)
    text = "plain words only " * 600_000 + "token=abcdefgh " * 1000 + "q9Zx7LmW2pTn8RbVkY4sHd6J"
    spans = secrets.all_spans(text, secrets.base_spans(text), model)
    assert len(spans) == 1001 and spans[-1][1:] == (3, len(text))
