import hashlib
import random
import re
from collections import Counter

import pytest
from cases import AWKWARD, documents

from twinweave.llm.secret_scan import literal_weight, name_weight, secret_digest, secret_scan, spans_of

HEX = "0123456789abcdef"
KEY = "9fQ2xL7vB4mZ8tR1"


def base_brute(text):
    """The three patterns, each scanned for itself over code points, failing matches dropped."""
    text, out = text or "", []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def noisy(rng):
    pieces = ["é ", "日本 ", "\n", " ", "word ", "token", "Token", "PASSWORD", "api_key", "apikey", "API_KEY", "passwd", "secret", '"', "'", " = ", "=", ": ", ":", "  ", "AKIA", "ſecret=abcdefgh1 ", "toKen = ", "🙂"]
    out = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.6:
            out.append(rng.choice(pieces))
        elif kind < 0.75:
            out.append("".join(rng.choice(HEX) for _ in range(rng.choice([3, 31, 32, 40, 64]))))
        elif kind < 0.85:
            out.append("AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(rng.choice([3, 11, 12, 16]))))
        else:
            out.append("".join(rng.choice("abcXYZ019+/_.=-") for _ in range(rng.choice([2, 7, 8, 20]))))
    return "".join(out)


def test_fixed_patterns_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, noisy(rng)) for i in range(600)] + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    rows += [(2000, "password = secret: abcdefghijk"), (2001, "a" * 31 + " " + "a" * 32), (2002, "AKIAAKIAAKIAAKIAZZ"), (2003, "x" * 300_000 + " token='" + HEX * 4 + "'")]
    got = secret_digest(secret_scan(documents(spark, rows).repartition(3))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = base_brute(text[r.doc_id])
        counts = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"]), text[r.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        told = [s for s in r.spans.split(",") if s and not s.startswith("literal")]
        assert ",".join(told) == joined


def literals(text):
    return [text[a:b] for k, a, b, _, _ in spans_of(text.encode()) if k == "literal"]


@pytest.mark.parametrize("text", [
    f'db_pwd = "{KEY}"', f"DB_PWD={KEY}", f'{{"clientCredentials": "{KEY}"}}', f"signing_key: {KEY}", f"auth_key := `{KEY}`", f'config["private_key"] = "{KEY}"', f"'encryption_key' => '{KEY}'",
    f'K = "{KEY}"\nuser = "bob"\nx = K\ndb_pwd = x', f"é日本🙂 db_pwd = '{KEY}'", f'self.base.k = "{KEY}"\nauth_key = k', f'pwd: str = "{KEY}"', f"export DB_PWD='{KEY}'", f'db_pwd ?= "{KEY}"',
])
def test_literals_of_sensitive_names(text):
    assert literals(text) == [KEY]


def test_joined_parts_are_told_each():
    assert literals('db_pwd = "9fQ2xL7v" + "B4mZ8tR1"') == ["9fQ2xL7v", "B4mZ8tR1"]
    assert literals('A = "9fQ2xL7v"\nauth_key = A + "B4mZ8tR1"') == ["9fQ2xL7v", "B4mZ8tR1"]


@pytest.mark.parametrize("text", [
    'db_pwd = "changeme123"', 'db_pwd = "${DB_PWD_VALUE}"', f'public_key_name = "{KEY}"', f'title = "{KEY}"', "the key: a matter of taste and of time", f'if db_pwd == "{KEY}":', "password: the quick brown fox", "auth_key = get_key('x9y8z7w6v5')",
    "key words: somewhere over http://host1234:8080/auth_key", 'db_pwd = ""', "pwd =", f'K = "{KEY}"\nK = "other"\ntitle = K', "x" * 10 + " = ", 'db_pwd = "correcthorse"', "pass: 12345678 people", "author: 1a2b3c4d5e6f",
])
def test_what_is_no_secret(text):
    assert literals(text) == []


def test_the_last_assignment_before_a_use_counts():
    text = f'K = "first"\nK = "{KEY}"\ndb_pwd = K\nK = "later99later"\n'
    assert literals(text) == [KEY]
    assert literals(f'db_pwd = K\nK = "{KEY}"') == []


def test_a_literal_in_a_fixed_span_is_not_told_again():
    assert [s[0] for s in spans_of(f'api_key = "{KEY}"'.encode())] == ["assign"]
    assert [s[0] for s in spans_of(f'K = "{KEY}"; api_key = K'.encode())] == ["literal"]


def test_weights():
    assert name_weight("dbPassword") == 1.0
    assert name_weight("AWS_SECRET_ACCESS_KEY") == 1.0
    assert name_weight("monkey") == name_weight("title") == 0.0
    assert name_weight("token_count") < 0.45
    assert literal_weight(b"aaaaaaaaaaaa1") == 0.0
    assert literal_weight(KEY.encode()) == 1.0


def test_long_and_hostile_texts(spark):
    rows = [(1, 'a = "x1y2z3w4" + a\n' * 20_000), (2, "k='" * 100_000), (3, "pwd" + " " * 300_000 + "= 'q1w2e3r4t5y6'"), (4, "=" * 200_000 + "key"), (5, "pwd: " * 50_000)]
    got = {r.doc_id: r.spans for r in secret_digest(secret_scan(documents(spark, rows))).collect()}
    assert set(got) == {1, 2, 3, 4, 5}


def test_general_interface(spark):
    found = secret_scan(documents(spark, [(1, f'db_pwd = "{KEY}"', "en", "web"), (None, None), (2, "")]), keep=("source",)).collect()
    assert found[0].source == "web"
    assert found[0].secrets[0].name == "db_pwd"
    assert [r.secrets for r in found[1:]] == [[], []]
    assert secret_digest(secret_scan(documents(spark, []))).collect() == []
